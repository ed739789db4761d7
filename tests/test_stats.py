"""Known answers, identities and brute force for the statistics."""

import bisect
import math
import random

import numpy as np
import pytest
from harness import mc_variance
from pyspark.sql import functions as F

from sparkaudit.functions import stats as S
from sparkaudit.functions import tails as T
from sparkaudit.functions.draws import uniform
from sparkaudit.operators import effects as E
from sparkaudit.operators import ordered as O
from sparkaudit.operators import ranktests as R
from sparkaudit.operators import resample as B
from sparkaudit.operators import survey as V
from sparkaudit.operators import validate as P


def cols(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def test_wilson(spark):
    for x, n, lo, hi in ((91, 100, 0.838, 0.952), (112, 165, 0.604, 0.745), (0, 0, 0.0, 0.0)):
        a, b = S.wilson(F.col("x"), F.col("n"))
        row = cols(spark, x=x, n=n).select(a.alias("a"), b.alias("b")).first()
        assert round(row["a"], 3) == lo and round(row["b"], 3) == hi


def test_e_value_and_increment(spark):
    e, ci = S.e_value(F.col("r"), F.col("l"), F.col("h"))
    row = cols(spark, r=0.855, l=0.776, h=0.943).select(e.alias("e"), ci.alias("c")).first()
    assert round(row["e"], 2) == 1.61 and round(row["c"], 2) == 1.31
    v = cols(spark, r=1.211).select(S.common_increment(F.col("r"), F.lit(0.5404), F.lit(0.6623)).alias("v")).first()["v"]
    assert round(v, 3) == 1.264
    assert cols(spark, x=2.5).select(S.round_half_up(F.col("x")).alias("v")).first()["v"] == 3.0


def test_triangle_and_ci(spark):
    t = S.estimate_triangle(F.col("r"), F.col("l"), F.col("h"), F.col("p"))
    get = lambda **k: cols(spark, **k).select(t.alias("v")).first()["v"]
    assert get(r=2.0, l=1.0 / 1.0 * 1.2, h=2.0 * 2.0 / 1.2, p=0.01) == []
    assert get(r=2.0, l=0.9, h=4.44, p=0.01) == ["p_vs_ci"]
    assert get(r=5.0, l=1.2, h=4.0, p=0.01)[0] == "order"
    c = S.ci_consistency(F.col("e"), F.col("l"), F.col("h"))
    assert cols(spark, e=0.0002, l=-0.0004, h=0.0).select(c.alias("v")).first()["v"] == ["outside"]


def test_tails(spark):
    # Textbook values.
    assert T.t_two_sided(np.array([2.228]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-4)
    assert T.t_quantile(0.975, np.array([10.0]))[0] == pytest.approx(2.228139, abs=1e-5)
    assert T.gamma_tail(np.array([0.5]), np.array([3.841459 / 2]))[0] == pytest.approx(0.05, abs=1e-6)
    df = cols(spark, z=1.959964, f=4.965, a=1.0, b=10.0, k=8, n=10)
    row = df.select(T.p_from_z("z").alias("z"), T.p_from_f("f", "a", "b").alias("f"), T.sign_test_p("k", "n").alias("s"),
                    T.p_from_chi2(F.lit(9.42), F.lit(2.0)).alias("c")).first()
    assert row["z"] == pytest.approx(0.05, abs=1e-6) and row["f"] == pytest.approx(0.05, abs=1e-4)
    assert row["s"] == pytest.approx(2 * (45 + 10 + 1) / 1024) and round(row["c"], 3) == 0.009


def _random_rows(n, seed=3):
    r = random.Random(seed)
    return [(r.choice("ab"), float(r.randint(0, 40)) / 4, r.random() < 0.4, r.random() + 0.1) for _ in range(n)]


def test_prefix_sums_and_ranks_match_brute_force(spark):
    rows = _random_rows(600)
    df = spark.createDataFrame(rows, "k string, v double, c boolean, w double").repartition(5)
    got = {(r["k"], r["v"]): r for r in O.prefix_sums(df, ["k"], "v", {"n": F.lit(1).cast("bigint")}, buckets=7).collect()}
    for (k, v), r in got.items():
        same = [x for x in rows if x[0] == k]
        assert r["n_before"] == sum(x[1] < v for x in same) and r["n_total"] == len(same)
    for r in R.auc(df, ["k"], "v", F.col("c")).collect():
        a = [x[1] for x in rows if x[0] == r["k"] and x[2]]
        b = [x[1] for x in rows if x[0] == r["k"] and not x[2]]
        assert r["auc"] == pytest.approx(sum((i > j) + 0.5 * (i == j) for i in a for j in b) / len(a) / len(b))
    for r in R.leave_one_out_auc(df, ["k"], "v", F.col("c")).collect():
        a = [x[1] for x in rows if x[0] == r["k"] and x[2]]
        b = [x[1] for x in rows if x[0] == r["k"] and not x[2]]
        part = [sum((i > j) + 0.5 * (i == j) for q, i in enumerate(a) if q != z for j in b) / (len(a) - 1) / len(b) for z in range(len(a))]
        assert r["min_auc"] == pytest.approx(min(part)) and r["max_auc"] == pytest.approx(max(part))


@pytest.mark.parametrize("kind, make", [
    ("bigint", lambda r: r.choice([-1, 1]) * r.randrange(2**62) + (1 << 61)), ("bigint", lambda r: 2**53 + r.randrange(40)),
    ("double", lambda r: r.choice([7.25, r.gauss(0, 1e-300), r.gauss(0, 1e300), 0.0, -0.0])),
    ("string", lambda r: "a common beginning " + str(r.randrange(500))), ("string", lambda r: r.choice(["", "\u00e9", "\U0001f600", "z"])),
    ("int", lambda r: 5),
])
def test_prefix_sums_of_any_values(spark, kind, make):
    """Sparse 64-bit numbers, numbers beyond the doubles' whole ones, hot values, text with one beginning, NULL keys and values."""
    r = random.Random(11)
    rows = [(r.choice(["a", "a", "a", "b", None]), make(r)) for _ in range(2500)] + [("a", None), ("only", None)]
    df = spark.createDataFrame(rows, f"k string, v {kind}").repartition(7)
    got = {(x["k"], x["v"]): (x["n"], x["n_before"], x["n_total"]) for x in O.prefix_sums(df, ["k"], "v", {"n": F.lit(1).cast("bigint")}, buckets=9).collect()}
    place = (lambda v: v.encode()) if kind == "string" else (lambda v: v)
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted(place(v) for q, v in rows if q == k and v is not None)
        for v in {v for q, v in rows if q == k and v is not None}:
            first = bisect.bisect_left(values, place(v))
            want[k, v] = (bisect.bisect_right(values, place(v)) - first, first, len(values))
    assert got == want


def test_order_of_a_hot_group_is_cut_by_rows(spark):
    """One group and one value with nearly all rows: no bucket of the previous row's window holds more than its share."""
    rows = [("hot", 3, i) for i in range(8000)] + [("cold", i, i) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, pos int, v int").repartition(4)
    sizes = [x["count"] for x in O.ranged(df, ["k"], ["pos", "v"], 8).groupBy("k", "_bucket").count().collect()]
    assert sum(sizes) == 8080 and max(sizes) < 3000
    got = {(x["k"], x["v"]): x["prev_v"] for x in O.previous_row(df, ["k"], "pos", ["v"], ties=["v"]).collect()}
    assert all(got[k, v] == (v - 1 if v else None) for k, _, v in rows)


def test_medians_of_conventions_and_attenuation(spark):
    """One hot value, a group without any ratio, NULL keys, an even and an odd number, no rows."""
    rows = [("hot", 0.5)] * 900 + [("hot", float(i)) for i in range(9)] + [("none", None), ("even", 1.0), ("even", 4.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, ratio double").repartition(4)
    got = {x["k"]: (x["n"], x["median_ratio"]) for x in E.median_attenuation(df, ["k"]).collect()}
    assert got == {"hot": (909, 0.5), "none": (0, None), "even": (2, 2.5), None: (1, 2.0)}
    a = spark.createDataFrame([(i, float(i)) for i in range(5)] + [(9, None)], "i int, yi double")
    b = a.withColumn("yi", F.col("yi") - F.col("i") * F.col("i"))
    row = E.convention_agreement(a, b, ["i"]).first()
    assert (row["n"], row["same_sign"], row["median_abs_diff"], row["max_abs_diff"]) == (5, 1, 4.0, 16.0)
    row = E.convention_agreement(a.where("i > 99"), b, ["i"]).first()
    assert row["n"] == 0 and row["median_abs_diff"] is None


def test_permutation_cut_in_one_cell(spark, monkeypatch):
    """The same chosen units whether a replicate's draws lie in one cell, a few or many; no case at all has no replicate."""
    r = random.Random(2)
    df = spark.createDataFrame([(i, r.gauss(0, 1), i % 3 == 0) for i in range(400)], "u int, v double, c boolean").repartition(3)
    draws = df.select("u", "v", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("rep")).select("v", "rep", uniform(1, F.col("rep"), F.col("u")).alias("d")).collect()
    n1, all_, case = 134, sum(x[1] for x in df.collect()), sum(x[1] for x in df.collect() if x[2])
    diff = lambda s: s / n1 - (all_ - s) / (400 - n1)
    reps = [sum(v for _, v in sorted((x["d"], x["v"]) for x in draws if x["rep"] == i)[:n1]) for i in range(1, 26)]
    want = (25, sum(diff(s) >= diff(case) for s in reps), sum(diff(s) <= diff(case) for s in reps))
    for cells in (1, 3, 1024):
        monkeypatch.setattr(R, "CELLS", cells)
        got = R.permutation_test(df, "u", "v", "c", 25).first()
        assert (got["reps"], got["ge"], got["le"]) == want and got["observed"] == pytest.approx(diff(case))
    assert R.permutation_test(df.withColumn("c", F.lit(False)), "u", "v", "c", 5).first()["reps"] == 0


def test_suffix_min_and_bh(spark):
    r = random.Random(5)
    ps = [round(r.random() ** 2, 3) for _ in range(300)] + [None]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "fam string, i int, p double")
    got = {x["i"]: x["q"] for x in E.bh_fdr(df, ["fam"], "p").collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    m, best, want = len(known), 1.0, {}
    for rank in range(m, 0, -1):
        p, i = known[rank - 1]
        best = min(best, p * m / rank)
        want[i] = best
    assert got[300] is None
    for i, q in want.items():
        assert got[i] == pytest.approx(q)


def test_previous_row_across_buckets(spark):
    rows = [("a", i * 40000, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v int").repartition(6)
    got = {r["v"]: r["prev_v"] for r in O.previous_row(df, ["k"], "pos", ["v"]).collect()}
    assert got[0] is None and all(got[i] == i - 1 for i in range(1, 50))


def _meta(y, v):
    t = 0.0
    for _ in range(5000):
        w = [1 / (x + t) for x in v]
        mu = sum(a * b for a, b in zip(w, y)) / sum(w)
        n = max(0.0, sum(a * a * ((b - mu) ** 2 - c) for a, b, c in zip(w, y, v)) / sum(a * a for a in w) + 1 / sum(w))
        if abs(n - t) < 1e-13:
            break
        t = n
    return t, mu


def test_reml_both_ways(spark):
    y, v = [0.1, 0.9, 0.3, 1.4, -0.2], [0.05, 0.04, 0.1, 0.08, 0.02]
    df = spark.createDataFrame([("g", a, b) for a, b in zip(y, v)] + [("single", 0.3, 0.1)], "g string, yi double, vi double")
    tau, mu = _meta(y, v)
    rows = {r["g"]: r for r in E.meta_reml(df, ["g"]).collect()}
    assert rows["g"]["tau2"] == pytest.approx(tau, abs=1e-6) and rows["g"]["est"] == pytest.approx(mu, abs=1e-5)
    assert rows["g"]["lo"] < mu < rows["g"]["hi"] and rows["g"]["pi_lo"] < rows["g"]["lo"]
    assert rows["single"]["status"] == "not_applicable" and rows["single"]["est"] is None


def test_reml_groups_of_any_size(spark):
    """Small, hot, homogeneous and far-off groups and a NULL key, each like the plain iteration."""
    rng = random.Random(3)
    groups = {"small": [(0.1, 0.05), (0.9, 0.04), (0.3, 0.1)], None: [(1.0, 0.2), (3.0, 0.1), (2.5, 0.4)], "alike": [(0.5, 0.3)] * 6,
              "far": [(1e8 + rng.gauss(0, 2), rng.uniform(0.1, 1)) for _ in range(40)], "hot": [(rng.gauss(1, 0.7), rng.uniform(0.05, 0.5)) for _ in range(20_000)]}
    df = spark.createDataFrame([(g, *e) for g, es in groups.items() for e in es], "g string, yi double, vi double").repartition(7)
    got = {r["g"]: r for r in E.meta_reml(df, ["g"], tails=False).collect()}
    for g, es in groups.items():
        shift = 1e8 if g == "far" else 0.0
        tau, mu = _meta([y - shift for y, _ in es][:2000] if g != "hot" else [y for y, _ in es], [v for _, v in es])
        assert got[g]["tau2"] == pytest.approx(tau, abs=1e-6) and got[g]["est"] - shift == pytest.approx(mu, abs=1e-6) and got[g]["k"] == len(es)


def test_subset_bug_fixture(spark):
    rows = [(f"p{i}", arm, float(i * (2 if arm == "Case" else 1) + (i % 3))) for i in range(8) for arm in ("Control", "Case")]
    random.Random(1).shuffle(rows)
    from sparkaudit.operators.joins import paired_rows

    df = spark.createDataFrame(rows, "id string, grp string, y double")
    one = E.smd_paired(paired_rows(df, ["id"], "grp", "Case", "Control", F.col("y")).withColumn("m", F.lit(1)), ["m"]).first()
    two = E.smd_paired(paired_rows(df.orderBy(F.desc("y")), ["id"], "grp", "Case", "Control", F.col("y")).withColumn("m", F.lit(1)), ["m"]).first()
    assert one["yi"] == pytest.approx(two["yi"]) and one["vi"] == pytest.approx(two["vi"]) and one["n"] == 8
    flat = spark.createDataFrame([("a", 1.0, 1.0)] * 4, "m string, y_case double, y_control double")
    bad = E.smd_paired(flat, ["m"])
    assert bad.first()["status"] == "not_estimable" and bad.first()["r"] == 0.2


def test_monte_carlo_variance(spark):
    out = mc_variance(spark.range(3000).withColumnRenamed("id", "r"), "r", [(12, 12, 0.3), (30, 15, 0.0)]).collect()
    for r in out:
        assert 0.85 < r["ratio"] < 1.1 and 0.92 < r["coverage"] < 0.97 and r["mean_estimate"] == pytest.approx(r["delta"], abs=0.05)


def test_bootstrap_methods_agree(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("c"), (F.col("id") % 17).cast("double").alias("y"))
    stat = {"m": F.try_divide(F.col("s"), F.col("n"))}
    ci = {}
    for method in ("poisson", "multinomial"):
        reps = B.bootstrap(df, "c", {"s": F.col("y"), "n": F.lit(1)}, stat, 200, method=method)
        assert reps.count() == 200
        ci[method] = B.percentile_ci(reps, ["m"]).first()
    assert ci["poisson"]["se"] == pytest.approx(ci["multinomial"]["se"], rel=0.3)
    w = B.replicate_weights(df.select("c").distinct(), "c", 5, method="multinomial").groupBy("rep").agg(F.sum("times").alias("t"))
    assert {r["t"] for r in w.collect()} == {200}


def _survey(spark):
    r = random.Random(11)
    rows = [(s, p, 0.5 + r.random(), int(r.random() < 0.3 + 0.05 * p), r.randint(0, 1)) for s in range(12) for p in range(2) for _ in range(60)]
    return spark.createDataFrame(rows, "s int, p int, w double, y int, x int")


def test_rao_wu_matches_taylor(spark):
    df = _survey(spark)
    d = V.design_summary(df, "s", "p").first()
    assert (d["n_strata"], d["n_psu"], d["degf"]) == (12, 24, 12)
    taylor = V.svy_mean(df, F.col("y"), "s", "p", "w").first()
    reps = V.replicate_mean(df, F.col("y"), "s", "p", "w", V.rao_wu_weights(df, "s", "p", 400))
    se = reps.agg(F.stddev_samp("mean")).first()[0]
    assert 0.85 < se / taylor["se"] < 1.19


def test_ipw_identity(spark):
    df = _survey(spark).withColumn("z", F.col("w") * 2)
    r = V.ipw_report(V.ipw(df, "y", ["x", "z"], "w"), "y").first()
    assert r["mean_p"] == pytest.approx(r["rate"], abs=1e-6) and r["n_analysis"] <= r["n_model"] and r["ess"] <= r["n_analysis"]


def test_km_brute_force(spark):
    rows = [(1, 1), (2, 0), (2, 1), (3, 1), (5, 0), (6, 1), (6, 1)]
    df = spark.createDataFrame(rows, "t int, e int")
    got = {r["t"]: r for r in P.kaplan_meier(df, [], "t", F.col("e") == 1).collect()}
    s = 1.0
    for t in sorted(got):
        n, d = sum(a >= t for a, _ in rows), sum(a == t and b for a, b in rows)
        s *= 1 - d / n
        assert got[t]["at_risk"] == n and got[t]["survival"] == pytest.approx(s, abs=1e-12)
    assert P.survival_at(P.kaplan_meier(df, [], "t", F.col("e") == 1), [], "t", 4).first()["survival"] == pytest.approx(got[3]["survival"])


def test_flow_and_rounding(spark):
    from sparkaudit.operators.sequence import round_to_total

    df = spark.createDataFrame([("g", 1, 93.35), ("g", 2, 1.16), ("g", 3, 0.63), ("g", 4, 4.86)], "k string, i int, v double")
    out = {r["i"]: r["rounded"] for r in round_to_total(df, ["k"], "v", "i", 100.0, 1).collect()}
    assert sum(out.values()) == pytest.approx(100.0) and out[1] == 93.3
    assert math.isclose(31, 26 + 1 + 1 + 3)


def test_shapes_of_reports():
    assert V.rcs_report([0.1, 0.5, 0.9]) == {"knots": 3, "basis": 2, "nonlinear_df": 1}
