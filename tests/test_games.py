"""Game analyses on small fixtures."""

from rinkline.plans.games import _rated


def test_an_unusable_game_does_not_drop_its_season(spark):
    schema = "sg long, game_date string, game_id long, home string, away string, hg int, ag int, is_ot boolean"
    good = [(1, "2024-01-01", 1, "a", "b", 3, 1, False), (1, "2024-01-08", 4, "b", "a", 2, 1, True)]
    bad = [(1, "2024-01-02", 2, "a", "a", 1, 0, False), (1, "2024-01-03", 3, None, "b", 1, 0, False)]
    rated = lambda rows: [(r.sg, r.ratings) for r in _rated(spark.createDataFrame(rows, schema)).collect()]
    assert rated(good + bad) == rated(good) and len(rated(good)[0][1]) == 2


def test_history_ends_in_the_final_rating(spark):
    from pathlib import Path

    import pytest

    from rinkline.plans.games import rating_fold_per_season, rating_history

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    h = rating_history(spark, "/root/testdata/sf0.001")
    last = {r.sg: r.rating for r in h.where("game_id is null").collect()}
    final = {}
    for r in rating_fold_per_season(spark, "/root/testdata/sf0.001").where("team like '%norrvik%'").collect():
        final.setdefault(r.sg, set()).add(r.rating)
    assert last and all(v in final[sg] for sg, v in last.items())
    assert h.where("game_id is not null").groupBy("sg").count().count() == len(last)


def test_a_malformed_period_keeps_its_number(spark):
    from pyspark.sql import functions as F

    from rinkline.functions.parse import period_scores

    df = spark.createDataFrame([("(2-1, x, 1-2)",), (None,), ("",)], "p string")
    assert [[tuple(x) for x in r.p] if r.p is not None else None for r in df.select(period_scores(F.col("p")).alias("p")).collect()] == [[(1, 2, 1), (3, 1, 2)], None, []]
