"""The greedy title pass against the plain sequential one, over all sources and days."""

import difflib
import re
from pathlib import Path

import numpy as np
import pytest

from rinkline.operators.similar import pairs_over
from rinkline.plans import content

DATA = Path("/root/testdata/sf0.001")


def plain(title):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (title or "").lower())).strip()


def greedy(rows):
    kept = []
    for item, title in sorted(rows):
        t = plain(title)
        if t and not any(difflib.SequenceMatcher(None, t, s).ratio() > 0.70 for _, s in kept):
            kept.append((item, t))
    return [item for item, _ in kept]


def test_pairs_are_those_of_the_ratio():
    texts = ["", "ab", "ba", "klar för norrvik", "klar nu för norrvik hk", "x" * 70 + "abc", "x" * 66 + "abd", "o" * 130, "helt annat", "noål 𝒳"]
    ids = np.arange(len(texts))
    want = {(i, j) for i in ids for j in ids if j < i and difflib.SequenceMatcher(None, texts[i], texts[j]).ratio() > 0.70}
    assert set(pairs_over(texts, ids, texts, ids, 0.70, False)) == want
    assert {i for i, _ in pairs_over(texts, ids, texts, ids, 0.70, True)} == {i for i, _ in want}


def test_no_shared_word_is_needed(spark):
    rows = [("", 1, "Hallbergsson"), ("", 2, "Hallbergson"), ("", 3, "a b c"), ("", 4, "A B, c")]
    assert sorted(r.item_id for r in content.greedy_distinct(spark.createDataFrame(rows, "batch string, item_id long, title string")).collect()) == [1, 3]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_titles_of_all_sources_and_days_meet(spark, monkeypatch):
    monkeypatch.setattr(content, "FIRST", 20)
    monkeypatch.setattr(content, "BLOCK", 16)
    rows = [(r.item_id, r.title) for r in spark.read.parquet(f"{DATA}/tmp_latest_silly.parquet").select("item_id", "title").collect()]
    assert sorted(r.item_id for r in content.near_duplicate_titles(spark, str(DATA)).collect()) == greedy(rows)
