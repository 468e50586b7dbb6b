"""Text statistics, scores and tails; labels as held-out truth."""

from pathlib import Path

import pytest

from rinkline.llm.textstats import STATISTICS, describe, text_quality

PROSE = "Efter matchen var tränaren nöjd med att laget hade vunnit på bortais. Det är inte så ofta som det händer, sade han."


def test_describe():
    assert describe("") == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    d = dict(zip(STATISTICS, describe(PROSE), strict=True))
    assert d["running_share"] == 1.0 and d["punctuated_lines"] == 1.0 and d["common_share"] > 0.4
    assert describe(PROSE.upper().replace(".", ""))[-1] == 1.0
    assert describe("Lag S V O\nGranvrå HK 1 2 3\nGlimmvrå IK 4 5 6")[-1] == 0.0
    assert abs(describe(PROSE + "\n" + "- Bo Ek\n" * 10)[-1] - len(PROSE) / (len(PROSE) + 70)) < 1e-9


def test_quality(spark):
    rows = [(k, PROSE, "sv") for k in range(200)] + [(300, "a | b\n1 | 2", "SV"), (301, None, None), (302, "", "sv-SE"), (303, PROSE * 3000, " sv "), (304, "the cat sat on the mat and it was of no use to me", "en-GB")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, tails string")
    got = {r.doc_id: r for r in text_quality(df).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if "running_share" in r.tails} == {300, 301, 302}
    assert "n_words" in got[303].tails and got[303].lang == "sv" and got[304].lang == "en" and got[301].lang == "und"
    assert got[0].z_mean_word_length == 0.0
    assert text_quality(df.limit(0)).count() == 0


LABELS = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not LABELS.exists(), reason="no test data")
def test_labels(spark):
    docs, labels = (spark.read.parquet(str(LABELS / f"{n}.parquet")) for n in ("documents", "doc_labels"))
    got = {r.doc_id: "running_share" in r.tails for r in text_quality(docs).collect()}
    pairs = [(got[r.doc_id], r.label != "prose") for r in labels.collect() if r.doc_id in got]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_humps():
    from rinkline.llm.textstats import parting

    assert parting([]) is None and parting([1.0] * 50) is None
    assert parting([k / 200 for k in range(200)]) is None  # flat: one hump
    assert abs(parting([0.1] * 60 + [0.9] * 140) - 0.5) < 1e-9


def test_words_are_learned_where_there_is_no_list(spark):
    from pyspark.sql import functions as F

    from rinkline.llm.textstats import language, learned_words

    df = spark.createDataFrame([(f"der kat{k} og hun{k}", "nb") for k in range(5)] + [("the cat", "en"), (None, "nb")], "t string, l string")
    words = learned_words(df, F.col("t"), language(F.col("l")))
    assert {"der", "og"} <= words and "the" not in words


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test data")
def test_the_half_of_the_labels_never_looked_at(spark):
    from pyspark.sql import functions as F

    base = Path("/root/testdata/sf0.1")
    docs, labels = (spark.read.parquet(str(base / f"{n}.parquet")) for n in ("documents", "doc_labels"))
    found = text_quality(docs).where(F.array_contains("tails", "running_share")).select("doc_id", F.lit(True).alias("found"))
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).join(found, "doc_id", "left").select((F.col("label") != "prose").alias("want"), F.coalesce("found", F.lit(False)).alias("found")).collect()
    hits = sum(r.want and r.found for r in held)
    assert hits >= 0.9 * sum(r.want for r in held) and hits >= 0.9 * sum(r.found for r in held)
