import random

from pyspark.sql import functions as F

from sparkaudit.operators.selection import exact_quantiles


def test_against_sorted_values(spark):
    """All-distinct, one hot value, both signs, very large and very small numbers, NULL keys and values."""
    rng = random.Random(4)
    groups = {
        "distinct": [rng.gauss(0, 1) for _ in range(3000)],
        "hot": [7.25] * 2000 + [rng.random() for _ in range(50)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(501)],
        "zeros": [0.0, -0.0, 5e-324, -5e-324],
        "one": [3.0],
        None: [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r.k, r.share): r.quantile for r in exact_quantiles(df, ["k"], F.col("v"), shares).collect()}
    assert {k for k, _ in got} == set(groups)
    for k, vs in groups.items():
        ordered = sorted(vs)
        for s in shares:
            at = (len(vs) - 1) * s
            low, high = ordered[int(at)], ordered[min(len(vs) - 1, -int(-at // 1))]
            far = at - int(at)
            assert got[k, s] == (low if low == high else (1 - far) * low + far * high), (k, s)


def test_without_keys_and_without_rows(spark):
    df = spark.range(1001).select(F.col("id").alias("v"))
    assert [r.quantile for r in exact_quantiles(df, [], F.col("v"), [0.25]).collect()] == [250.0]
    assert exact_quantiles(df.where("v < 0"), [], F.col("v"), [0.5]).count() == 0
