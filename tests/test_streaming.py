"""The keyed table of a stream outlives the query."""

from rinkline.streaming.daily import UpsertSink


def test_table_survives_a_restart_and_batches_that_come_again(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k long, n long")
    path = f"file://{tmp_path}/t"
    first = UpsertSink(spark, path, ["k"])
    assert first.table() is None
    first(rows((1, 1), (2, 2)), 0)
    first(rows((2, 5)), 1)
    again = UpsertSink(spark, path, ["k"])  # a new process
    again(rows((2, 5)), 1)
    again(rows((3, 3)), 2)
    assert sorted((r.k, r.n) for r in again.table().collect()) == [(1, 1), (2, 5), (3, 3)]
    assert again.versions() == [1, 2]
