"""Wrong decodings made on purpose come back."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rinkline.llm.encoding import damaged_rows, repair

NAMES = ["Åke Öberg", "Jörgen Källsnöre", "Théo Ödentorpe", "João Strömfjället", "Örjan Åskvgärdh", "Väinö Pöyhtäri"]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1252", "cp850"), ("cp1252", "mac_roman")]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("put,read", WRONG)
def test_round_trip(name, put, read):
    try:
        bad = name.encode(put).decode(read)
    except UnicodeDecodeError:
        pytest.skip("not a text in that set")
    assert repair(bad) == (name, True, False)


@pytest.mark.parametrize("name", NAMES)
def test_twice(name):
    once = name.encode().decode("latin-1")
    assert repair(once.encode().decode("latin-1"))[:2] == (name, True)


@pytest.mark.parametrize("name", [*NAMES, "ÅKE ÖBERG", "åke öberg", "Jiří Dvorněcký", "JOÃO", "Ask Oberg", "", "Bo – Ek", "Ærlig Þorvin"])
def test_clean_names_stay(name):
    assert repair(name) == (name, False, False)


def test_loss():
    assert repair("Br?dna")[1:] == (True, True)
    assert repair("Br�dna")[1:] == (True, True)
    assert repair("Vem vet?", True) == ("Vem vet?", False, False)
    assert repair("Vem v?t?", True)[1:] == (True, True)


def test_entities():
    assert repair("Br&auml;nna &amp; Co")[0] == "Bränna & Co"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="bcdfghijå äé", min_size=1, max_size=30))
def test_any_plain_text_survives_utf8_read_as_latin1(s):
    assert repair(s.encode().decode("latin-1"))[0] == s


def test_rows(spark):
    long = "Åke " * 20_000
    rows = [(1, "Ã…ke"), (2, "Åke"), (3, None), (4, ""), (5, "Ã…ke"), (6, long), (7, long.encode().decode("cp1252"))]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "k long, name string, garbled string, lost boolean")
    got = {r.row_key: (r.restored, r.lost) for r in damaged_rows(df, "k", "name").collect()}
    assert got == {1: ("Åke", False), 5: ("Åke", False), 7: (long, False)}
    assert damaged_rows(df.limit(0), "k", "name").count() == 0


def test_every_damaged_name_is_suspicious(spark):
    from pyspark.sql import functions as F

    from rinkline.llm.encoding import suspicious

    bad = [(n.encode(p).decode(r, "replace"),) for n in NAMES for p, r in WRONG]
    df = spark.createDataFrame([b for b in bad if repair(b[0])[1]], "s string")
    assert df.where(~suspicious(F.col("s"))).count() == 0


def test_a_search_of_many_states_is_not_cut():
    from rinkline.llm.encoding import repair

    assert repair("uppdaterad â€“ uppgifter: thã©o ã–denã¥skar nã¤ra glimmvrã¥ ik", True)[0] == "uppdaterad – uppgifter: théo Ödenåskar nära glimmvrå ik"


CLEAN = "Ñandú|Łukasz Wiśniewski|Jiří Šlégr|Dvořák|François Beauséjour|João Gonçalves|Søren Kierkegård|Þórður Guðjónsson|Иван Петров|Ivan Петров|Γιώργος Παπαδόπουλος|Müller-Straße|Zoë Øvergård|Nguyễn Văn Đức|Ştefan Ţurcanu|Çağlar Söyüncü|Õunapuu Märt|Jānis Bērziņš|Žižek Đorđe|Señor Muñoz|Ægir Ólafsson|Hélène Béranger|Citroën|O’Brien|Čech Radovan|Gyula Kőszegi|Åsa Ö|İlkay Gündoğan|Sílvio Araújo".split("|")


def test_clean_names_of_other_languages_stay():
    from rinkline.llm.encoding import repair

    assert [n for n in CLEAN if repair(n)[1] or repair(n)[0] != n] == []


def test_what_cannot_be_told_is_not_garbled_another_way():
    from rinkline.llm.encoding import repair

    for n in ("Ïåòøîâ", "Ivan Петров"):
        assert repair(n)[0] == n
    assert repair("eetu ã…skwklinth") == ("eetu Åskwklinth", True, False)
