"""The margin of unseen entities at its very threshold."""

from kinweave.plans.registry import QUERIES


def test_a_score_at_the_raised_threshold_is_accepted(spark, tmp_path):
    """User 9 is no supplier: its threshold is 0.4 + 0.55, which a value of 95 reaches. A null user is not known to be unseen."""
    rows = [(1, 9, "view", 95.0), (2, 9, "view", 94.0), (3, 1, "view", 50.0), (4, None, "view", 60.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r["r"] for r in QUERIES["dec_unseen_margin"](spark, str(tmp_path)).collect()} == {1, 3, 4}
