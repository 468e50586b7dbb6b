import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rinkline import build_session

    s = build_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=tmp_path_factory.mktemp("shared").as_uri())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
