from sparkaudit.plans.derived import manuscripts
from sparkaudit.plans.registry import Tables
from sparkaudit.session import deal_rows


def test_tasks_are_bounded_by_rows(spark):
    """A table of two keys is one split, however many costly rows it has."""
    dealt = deal_rows(spark.range(0, 50_000, 1, 1), 1_000)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 50_000 and max(sizes) <= 1_100
    assert deal_rows(spark.range(0, 5, 1, 1)).count() == 5 and deal_rows(spark.range(0)).count() == 0


def test_manuscripts_are_dealt_out_by_rows(spark, tmp_path):
    """More orders than 20,000 for each core: more tasks, not longer ones."""
    spark.range(0, 400_000, 1, 1).selectExpr("id AS o_orderkey", "id % 1000 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert manuscripts(Tables(spark, str(tmp_path))).rdd.getNumPartitions() >= 20
