import pytest
from pyspark.sql import functions as F

from sparkaudit.functions.stats import safe_corr


@pytest.mark.parametrize("constant", [50.0, 0.1, 7.3])
def test_constant_side_over_many_tasks(spark, constant):
    """Groups of all sizes, with their rows in many tasks, so that partial means are put together."""
    rows = spark.range(0, 20_000, 1, 37).select((F.col("id") % 97).alias("g"), (F.col("id") * 7919 % 101 / 10).alias("y"))
    r = safe_corr(F.lit(constant), F.col("y"))
    assert rows.groupBy("g").agg(r.alias("r")).where("r IS NOT NULL").count() == 0
    turned = safe_corr(F.col("y"), F.lit(constant))
    assert rows.where("g % 5 < 3").groupBy("g").agg(turned.alias("r")).where("r IS NOT NULL").count() == 0
    assert rows.groupBy("g").agg(safe_corr(F.col("y"), F.col("y") * 2 + 1).alias("r")).where("abs(r - 1) < 1e-9").count() == 97
