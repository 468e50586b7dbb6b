"""Article bodies by query."""

from rinkline.plans import catalogue


def test_article_bodies_are_registered_and_read(spark, tmp_path):
    spark.createDataFrame([(1, "A &amp; B <c>\nnästa  rad"), (2, None), (3, "x" * 2000)], "item_id long, body string").write.parquet(str(tmp_path / "tmp_latest_silly.parquet"))
    got = {r.item_id: r.body for r in catalogue.QUERIES["article_body_extract"](spark, str(tmp_path)).collect()}
    assert got == {1: "A &amp; B <c> nästa rad", 2: "", 3: "x" * 1500}
