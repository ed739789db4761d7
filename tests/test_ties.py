import random
from collections import defaultdict
from fractions import Fraction

import duckdb

import __spark_entry__ as entry


def test_means_on_their_bounds(spark, tmp_path):
    """Suppliers whose mean discounts are exactly 0.05 or exactly 0.002 apart, against whole fractions and SQL."""
    rng = random.Random(3)
    lines = [(s, rng.randrange(11), rng.choice("RNA")) for s in range(4000) for _ in range(rng.choice([5, 10, 20, 50]))]
    lines += [(4000, 5, "N"), (4001, 0, "R"), (4001, 10, "N"), (4002, 0, "R")]
    spark.createDataFrame([(s, d / 100, f) for s, d, f in lines], "l_suppkey bigint, l_discount double, l_returnflag string").repartition(9).write.parquet(str(tmp_path / "lineitem.parquet"))
    by = defaultdict(lambda: ([], []))
    for s, d, f in lines:
        by[s][0].append(d)
        by[s][1].extend([d] * (f == "R"))
    want, ties = {}, 0
    for s, (x, r) in by.items():
        est = Fraction(sum(x), 100 * len(x)) - Fraction(5, 100)
        if not r:
            want[s] = ""
            continue
        c, give = Fraction(sum(r), 100 * len(r)) - Fraction(5, 100), Fraction(2, 1000)
        ties += abs(est - c) == give or (est == 0 and abs(c) > give)
        sign = (c - give > 0 and est < 0) or (c + give < 0 and est > 0)
        want[s] = "|".join(k for k, bad in (("outside", abs(est - c) > give), ("sign", sign)) if bad)
    assert ties > 20
    got = {r.l_suppkey: r.problems for r in entry.queries()["fn_ci_sign_check"](spark, str(tmp_path)).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert dict(con.execute(entry.oracle_sql()["fn_ci_sign_check"]).fetchall()) == want
