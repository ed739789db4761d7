"""Queries for evidence statistics. SQL compares estimates, variances and z; tails are tested apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import stats as S
from sparkaudit.operators import cohort as H
from sparkaudit.operators import effects as E
from sparkaudit.operators import joins as J
from sparkaudit.operators import ranktests as R
from sparkaudit.operators import resample as B
from sparkaudit.operators import survey as V
from sparkaudit.operators import validate as P
from sparkaudit.plans.registry import Tables, query
from sparkaudit.session import shared_dir
from sparkaudit.streaming.audit import audit_stream, start_audit


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


KEYS = ["module", "cohort"]


def samples(t: Tables) -> DataFrame:
    """Module = part group, cohort = supplier nation, arm = line status."""
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("cohort"))
    li = t.lineitem.select("l_suppkey", (F.col("l_partkey") % 20).alias("module"), "l_linestatus", "l_extendedprice",
                           "l_quantity", "l_returnflag")
    return li.join(s, F.col("s_suppkey") == F.col("l_suppkey"))


def moments(t: Tables) -> DataFrame:
    return E.arm_moments(samples(t), KEYS, "l_linestatus", "F", "O", F.col("l_extendedprice"))


def effects(t: Tables) -> DataFrame:
    return E.smd_unpaired(moments(t))


EFFECTS_SQL = """
mo AS (SELECT l_partkey % 20 AS module, s_nationkey::BIGINT AS cohort,
    count(*) FILTER (l_linestatus = 'F') AS n1, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS m1, stddev_samp(l_extendedprice) FILTER (l_linestatus = 'F') AS s1,
    count(*) FILTER (l_linestatus = 'O') AS n0, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS m0, stddev_samp(l_extendedprice) FILTER (l_linestatus = 'O') AS s0
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
e0 AS (SELECT *, (1 - 3 / (4 * (n1 + n0) - 2)) * (m1 - m0) / nullif(sqrt((s1 * s1 + s0 * s0) / 2), 0) AS y FROM mo),
ef AS (SELECT module, cohort, n1, n0, CASE WHEN n1 > 1 AND n0 > 1 THEN y END AS yi,
    CASE WHEN n1 > 1 AND n0 > 1 AND y IS NOT NULL THEN (n1 + n0) / (n1 * n0) + y * y / (2 * (n1 + n0)) END AS vi,
    CASE WHEN n1 > 1 AND n0 > 1 AND y IS NOT NULL THEN 'estimated' ELSE 'not_estimable' END AS status FROM e0),
us AS (SELECT module, cohort, n1 + n0 AS n, yi, vi, 1 / vi AS w FROM ef WHERE yi IS NOT NULL AND vi > 0),
su AS (SELECT module, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * yi) AS swy, sum(w * yi * yi) AS swyy FROM us GROUP BY 1),
fx AS (SELECT *, greatest(0, swyy - swy * swy / sw) AS q FROM su),
dl AS (SELECT *, coalesce(greatest(0, (q - (k - 1)) / nullif(sw - sw2 / sw, 0)), 0) AS tau2 FROM fx)
"""


def _ef(name: str, sql: str):
    return query(name, f"WITH {EFFECTS_SQL} {sql}")


# --- 2.7 closed forms -----------------------------------------------------------------------


@query(
    "fn_wilson",
    """WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS x FROM documents JOIN labels USING (doc_id) GROUP BY 1
         UNION ALL SELECT 'none', 0, 0),
        p AS (SELECT *, 1.959963984540054::DOUBLE AS z, CASE WHEN n > 0 THEN x / n ELSE 0 END AS p FROM c)
       SELECT source, n, x, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 6) AS lo,
         round(CASE WHEN n = 0 THEN 0 ELSE least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 6) AS hi FROM p""",
)
def fn_wilson(t: Tables) -> DataFrame:
    c = t.documents.join(t.labels, "doc_id").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("x"))
    none = c.agg(F.lit("none").alias("source"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("x"))
    lo, hi = S.wilson(F.col("x"), F.col("n"))
    return c.unionByName(none).select("source", "n", "x", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(
    "fn_round_half_up",
    """SELECT p_partkey, round((p_partkey * 10 + 5) / 100 + 0.0001, 1) AS one, (p_partkey + 1)::DOUBLE AS half FROM part""",
)
def fn_round_half_up(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", S.round_half_up((k * 10 + 5) / 100 + 0.0001, 1).alias("one"), S.round_half_up(k + F.lit(0.5), 0).alias("half"))


@query(
    "fn_common_increment",
    """SELECT l_suppkey, round(pow(1 + avg(l_discount), (stddev_samp(l_quantity) / 2) / stddev_samp(l_quantity)), 6) AS per_half,
         round(pow(1 + avg(l_discount), 1.0 / stddev_samp(l_quantity)), 6) AS per_unit FROM lineitem GROUP BY 1""",
)
def fn_common_increment(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg((1 + F.avg("l_discount")).alias("r"), F.stddev_samp("l_quantity").alias("sd"))
    return rounded(g.select("l_suppkey", S.common_increment(F.col("r"), F.col("sd"), F.col("sd") / 2).alias("per_half"),
                            S.common_increment(F.col("r"), F.col("sd"), F.lit(1.0)).alias("per_unit")))


RATIO_SQL = """
r AS (SELECT l_suppkey, 0.5 + avg(l_discount) * 10 AS rr, 0.05 + stddev_samp(l_tax) * 3 AS h FROM lineitem GROUP BY 1),
i AS (SELECT l_suppkey, rr, rr * exp(-h) AS lo, rr * exp(h * CASE WHEN l_suppkey % 4 = 0 THEN 1.2 ELSE 1 END) AS hi,
        CASE WHEN l_suppkey % 3 = 0 THEN 0.01 ELSE 0.2 END::DOUBLE AS p FROM r)"""


def ratios(t: Tables) -> DataFrame:
    r = t.lineitem.groupBy("l_suppkey").agg((0.5 + F.avg("l_discount") * 10).alias("rr"), (0.05 + F.stddev_samp("l_tax") * 3).alias("h"))
    stretch = F.when(F.col("l_suppkey") % 4 == 0, F.lit(1.2)).otherwise(F.lit(1.0))
    return r.select("l_suppkey", "rr", (F.col("rr") * F.exp(-F.col("h"))).alias("lo"), (F.col("rr") * F.exp(F.col("h") * stretch)).alias("hi"),
                    F.when(F.col("l_suppkey") % 3 == 0, 0.01).otherwise(0.2).alias("p"))


@query(
    "fn_evalue",
    f"""WITH {RATIO_SQL}, u AS (SELECT *, CASE WHEN rr < 1 THEN 1 / rr ELSE rr END AS v, CASE WHEN rr < 1 THEN hi ELSE lo END AS near FROM i),
        z AS (SELECT *, CASE WHEN near < 1 THEN 1 / near ELSE near END AS b FROM u)
        SELECT l_suppkey, round(v + sqrt(v * (v - 1)), 6) AS e, round(CASE WHEN lo <= 1 AND hi >= 1 THEN 1 ELSE b + sqrt(b * (b - 1)) END, 6) AS e_ci FROM z""",
)
def fn_evalue(t: Tables) -> DataFrame:
    e, ci = S.e_value(F.col("rr"), F.col("lo"), F.col("hi"))
    return rounded(ratios(t).select("l_suppkey", e.alias("e"), ci.alias("e_ci")))


@query(
    "fn_estimate_triangle",
    f"""WITH {RATIO_SQL} SELECT l_suppkey, array_to_string(list_filter([
          CASE WHEN NOT (lo <= rr AND rr <= hi) THEN 'order' END, CASE WHEN (lo <= 1 AND hi >= 1) <> (p > 0.05) THEN 'p_vs_ci' END,
          CASE WHEN abs(ln(rr / lo) - ln(hi / rr)) > 0.05 * greatest(abs(ln(rr / lo)), abs(ln(hi / rr))) THEN 'sides' END], lambda x: x IS NOT NULL), '|') AS problems FROM i""",
)
def fn_estimate_triangle(t: Tables) -> DataFrame:
    p = S.estimate_triangle(F.col("rr"), F.col("lo"), F.col("hi"), F.col("p"))
    return ratios(t).select("l_suppkey", F.array_join(p, "|").alias("problems"))


@query(
    "fn_ci_sign_check",
    """WITH d AS (SELECT l_suppkey, l_returnflag, round(l_discount * 1000000)::BIGINT AS x FROM lineitem),
        s AS (SELECT l_suppkey, sum(x)::HUGEINT - 50000 * count(x)::HUGEINT AS est, count(x)::HUGEINT AS n,
                sum(x) FILTER (l_returnflag = 'R')::HUGEINT - 50000 * (count(x) FILTER (l_returnflag = 'R'))::HUGEINT AS c, (count(x) FILTER (l_returnflag = 'R'))::HUGEINT AS m FROM d GROUP BY 1),
        m AS (SELECT l_suppkey, est * m AS est, c * n - 2000 * n * m AS lo, c * n + 2000 * n * m AS hi FROM s)
       SELECT l_suppkey, array_to_string(list_filter([CASE WHEN NOT (lo <= est AND est <= hi) THEN 'outside' END,
         CASE WHEN (lo > 0 AND est < 0) OR (hi < 0 AND est > 0) THEN 'sign' END], lambda x: x IS NOT NULL), '|') AS problems FROM m""",
)
def fn_ci_sign_check(t: Tables) -> DataFrame:
    """The mean discount less 0.05 against that of returned lines, give or take 0.002.

    Means often lie on these bounds, so they are compared as whole numbers: millionths, times both counts.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    x, returned = F.round(F.col("l_discount") * 1_000_000).cast("bigint"), F.col("l_returnflag") == "R"
    total = lambda v: wide(F.sum(v) - 50_000 * F.count(v))
    s = t.lineitem.select("l_suppkey", x.alias("x"), F.when(returned, x).alias("r")).groupBy("l_suppkey").agg(
        total(F.col("x")).alias("est"), wide(F.count("x")).alias("n"), total(F.col("r")).alias("c"), wide(F.count("r")).alias("m"))
    give = F.lit(2000) * F.col("m")
    est, lo, hi = F.col("est") * F.col("m"), (F.col("c") - wide(give)) * F.col("n"), (F.col("c") + wide(give)) * F.col("n")
    return s.select("l_suppkey", F.array_join(S.ci_consistency(est, lo, hi), "|").alias("problems"))


# --- 2.8 effects and meta-analysis ----------------------------------------------------------


@_ef("st_moments", "SELECT module, cohort, n1, round(m1, 4) AS m1, round(s1, 4) AS s1, n0, round(m0, 4) AS m0, round(s0, 4) AS s0 FROM mo")
def st_moments(t: Tables) -> DataFrame:
    return rounded(moments(t), 4)


@_ef("st_smdh", "SELECT module, cohort, n1, n0, round(yi, 6) AS yi, round(vi, 6) AS vi, status FROM ef")
def st_smdh(t: Tables) -> DataFrame:
    return rounded(effects(t).select(*KEYS, "n1", "n0", "yi", "vi", "status"))


PAIRS_SQL = """
pr AS (SELECT l_suppkey, l_returnflag AS module, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS a, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS b
  FROM lineitem GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
pm AS (SELECT module, count(*) AS n, avg(a) AS m1, stddev_samp(a) AS s1, avg(b) AS m0, stddev_samp(b) AS s0, stddev_samp(a - b) AS sd, corr(a, b) AS raw_r FROM pr GROUP BY 1),
pe AS (SELECT *, coalesce(greatest(-0.99, least(0.99, raw_r)), 0.2) AS r, (m1 - m0) / sd AS dz, (s1 * s1 + s0 * s0) / 2 AS mv, 1 - 3 / (4 * (n - 1) - 1) AS j FROM pm),
py AS (SELECT *, j * (m1 - m0) / sqrt(mv) AS yi FROM pe)
"""


def unit_pairs(t: Tables) -> DataFrame:
    return J.paired_rows(t.lineitem, ["l_suppkey", "l_returnflag"], "l_linestatus", "F", "O", F.col("l_extendedprice")).withColumnRenamed(
        "l_returnflag", "module")


@query(
    "st_smcrph",
    f"""WITH {PAIRS_SQL} SELECT module, n, round(r, 6) AS r, round(raw_r, 6) AS raw_r, round(dz, 6) AS dz, round(dz * sqrt(2 * (1 - r)), 6) AS g_equivalent, round(yi, 6) AS yi,
          round((s1 * s1 + s0 * s0 - 2 * r * s1 * s0) / (mv * (n - 1)) + yi * yi * (pow(s1, 4) + pow(s0, 4) + 2 * r * r * s1 * s1 * s0 * s0) / (8 * mv * mv * (n - 1)), 6) AS vi,
          'estimated' AS status FROM py""",
)
def st_smcrph(t: Tables) -> DataFrame:
    return rounded(E.smd_paired(unit_pairs(t), ["module"]))


@_ef(
    "st_hedges_classic",
    """, cl AS (SELECT module, cohort, (1 - 3 / (4 * (n1 + n0) - 9)) * (m1 - m0) / nullif(sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / (n1 + n0 - 2)), 0) AS g FROM mo WHERE n1 > 1 AND n0 > 1)
       SELECT count(*) AS n, count(*) FILTER (sign(yi) = sign(g)) AS same_sign, round(median(abs(yi - g)), 6) AS median_abs_diff, round(max(abs(yi - g)), 6) AS max_abs_diff
       FROM ef JOIN cl USING (module, cohort) WHERE yi IS NOT NULL AND g IS NOT NULL""",
)
def st_hedges_classic(t: Tables) -> DataFrame:
    m = moments(t)
    return rounded(E.convention_agreement(E.smd_unpaired(m), E.smd_unpaired(m, classic=True), KEYS))


@query(
    "st_paired_guards",
    f"""WITH {PAIRS_SQL} SELECT count(*) AS attempted, count(yi) AS finite, count(*) FILTER (abs(raw_r) >= 0.95) AS r_near_1, 0::BIGINT AS zero_variance,
          count(*) FILTER (yi = 0) AS exact_zero FROM py""",
)
def st_paired_guards(t: Tables) -> DataFrame:
    return E.pair_signatures(E.smd_paired(unit_pairs(t), ["module"]))


@_ef(
    "st_meta_fixed",
    """SELECT module, k, round(swy / sw, 6) AS est, round(sqrt(1 / sw), 6) AS se, round(q, 6) AS q,
         round(CASE WHEN q = 0 THEN 0 ELSE greatest(0, (q - (k - 1)) / q) END, 6) AS i2 FROM fx""",
)
def st_meta_fixed(t: Tables) -> DataFrame:
    return rounded(E.meta_fixed(effects(t), ["module"]).select("module", "k", "est", "se", "q", "i2"))


@_ef(
    "st_meta_dl",
    """, p AS (SELECT module, count(*) AS k, max(tau2) AS tau2, sum(1 / (vi + tau2)) AS w, sum(yi / (vi + tau2)) AS wy FROM us JOIN dl USING (module) GROUP BY 1)
       SELECT module, k, round(tau2, 6) AS tau2, round(wy / w, 6) AS est, round(sqrt(1 / w), 6) AS se, round(wy / w / sqrt(1 / w), 6) AS z,
         round(wy / w - 1.959963984540054 * sqrt(1 / w), 6) AS lo, round(wy / w + 1.959963984540054 * sqrt(1 / w), 6) AS hi FROM p""",
)
def st_meta_dl(t: Tables) -> DataFrame:
    return rounded(E.meta_dl(effects(t), ["module"]).select("module", "k", "tau2", "est", "se", "z", "lo", "hi"))


@_ef(
    "st_meta_reml_hk",
    """, l AS (SELECT module, list({'y': yi, 'v': vi}) AS es FROM us GROUP BY 1),
       tt AS (SELECT module, es, list_reduce(list_transform(range(300), lambda x: 0::DOUBLE), lambda t, x:
           greatest(0, list_sum(list_transform(es, lambda e: (pow(e.y - list_sum(list_transform(es, lambda g: g.y / (g.v + t))) / list_sum(list_transform(es, lambda g: 1 / (g.v + t))), 2) - e.v) / pow(e.v + t, 2)))
             / list_sum(list_transform(es, lambda e: 1 / pow(e.v + t, 2))) + 1 / list_sum(list_transform(es, lambda e: 1 / (e.v + t)))), 0::DOUBLE) AS tau2 FROM l),
       ft AS (SELECT module, count(*) AS k, max(tau2) AS tau2, sum(1 / (vi + tau2)) AS w, sum(yi / (vi + tau2)) AS wy, sum(yi * yi / (vi + tau2)) AS wyy FROM us JOIN tt USING (module) GROUP BY 1),
       hk AS (SELECT *, wy / w AS est, sqrt(greatest(greatest(0, wyy - wy * wy / w) / nullif((k - 1) * w, 0), 1 / w)) AS se FROM ft)
       SELECT module, k, CASE WHEN k > 1 THEN round(tau2, 5) END AS tau2, CASE WHEN k > 1 THEN round(est, 5) END AS est, CASE WHEN k > 1 THEN round(se, 5) END AS se,
         CASE WHEN k > 1 THEN 'pooled' ELSE 'not_applicable' END AS status FROM hk""",
)
def st_meta_reml_hk(t: Tables) -> DataFrame:
    return rounded(E.meta_reml(effects(t), ["module"], tails=False).drop("t"), 5)


@query("st_meta_reml_tails")
def st_meta_reml_tails(t: Tables) -> DataFrame:
    """The same with t(k-1) P, interval and prediction interval; t tails have no SQL."""
    return rounded(E.meta_reml(effects(t), ["module"]))


@_ef(
    "st_meta_strata",
    """, z AS (SELECT *, CASE WHEN cohort % 3 = 0 THEN 'paired' ELSE 'unpaired' END AS layer FROM us),
       b AS (SELECT module, layer, yi, w FROM z UNION ALL SELECT module, 'joint', yi, w FROM z)
       SELECT module, layer, count(*) AS k, round(sum(w * yi) / sum(w), 6) AS est, round(sqrt(1 / sum(w)), 6) AS se FROM b GROUP BY ALL""",
)
def st_meta_strata(t: Tables) -> DataFrame:
    e = effects(t).withColumn("design", F.when(F.col("cohort") % 3 == 0, "paired").otherwise("unpaired"))
    return rounded(E.meta_by_design(e, ["module"], "design").select("module", "layer", "k", "est", "se"))


@_ef(
    "st_leave_one_out",
    """SELECT a.module, a.cohort AS omitted, count(b.yi) AS k, round(CASE WHEN count(b.yi) >= 2 THEN sum(b.w * b.yi) / sum(b.w) END, 6) AS est,
         round(CASE WHEN count(b.yi) >= 2 THEN sqrt(1 / sum(b.w)) END, 6) AS se, CASE WHEN count(b.yi) >= 2 THEN 'estimated' ELSE 'not_estimable' END AS status
       FROM us a LEFT JOIN us b ON a.module = b.module AND a.cohort <> b.cohort GROUP BY a.module, a.cohort""",
)
def st_leave_one_out(t: Tables) -> DataFrame:
    return rounded(E.meta_leave_one_out(effects(t), ["module"], "cohort").drop("tau2"))


@_ef(
    "st_sign_consistency",
    """, g AS (SELECT module, count(*) AS k, count(*) FILTER (yi > 0) AS n_pos, count(*) FILTER (yi < 0) AS n_neg, min(cohort) FILTER (yi > 0) AS p, min(cohort) FILTER (yi < 0) AS q
              FROM ef WHERE yi IS NOT NULL GROUP BY 1)
       SELECT module, k, n_pos, n_neg, n_pos = k OR n_neg = k AS consistent, CASE WHEN n_pos = 1 AND n_neg > 1 THEN p WHEN n_neg = 1 AND n_pos > 1 THEN q END AS flips FROM g""",
)
def st_sign_consistency(t: Tables) -> DataFrame:
    return E.sign_consistency(effects(t), ["module"], "cohort")


def pseudo_tests(t: Tables) -> DataFrame:
    """One test per part and flag; P stands for 1/(1+z^2), a monotone function that SQL can follow."""
    g = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"))
    z = (F.col("m") - 0.05) * F.sqrt("n") / 0.0316
    p = F.when(F.col("n") > 1, F.round(1 / (1 + F.pow(z, F.lit(4.0))), 6))
    return g.select("l_returnflag", "l_partkey", "n", p.alias("p"))


TESTS_SQL = """
g AS (SELECT l_returnflag, l_partkey, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY ALL),
ts AS (SELECT l_returnflag, l_partkey, n, CASE WHEN n > 1 THEN round(1 / (1 + pow((m - 0.05) * sqrt(n) / 0.0316, 4)), 6) END AS p FROM g)"""


@query(
    "st_bh",
    f"""WITH {TESTS_SQL}, r AS (SELECT *, p * count(*) OVER (PARTITION BY l_returnflag) / rank_max AS raw FROM (
          SELECT *, count(*) OVER (PARTITION BY l_returnflag ORDER BY p) AS rank_max FROM ts WHERE p IS NOT NULL)),
        a AS (SELECT l_returnflag, l_partkey, p, least(1, min(raw) OVER (PARTITION BY l_returnflag ORDER BY p DESC)) AS q FROM r)
        SELECT ts.l_returnflag, ts.l_partkey, ts.p, round(q, 6) AS q FROM ts LEFT JOIN a USING (l_returnflag, l_partkey)""",
)
def st_bh(t: Tables) -> DataFrame:
    return E.bh_fdr(pseudo_tests(t), ["l_returnflag"], "p").select("l_returnflag", "l_partkey", "p", F.round("q", 6).alias("q"))


@query(
    "st_threshold_ladder",
    f"""WITH {TESTS_SQL} SELECT l_returnflag, threshold::DOUBLE AS threshold, count(*) FILTER (n >= threshold) AS tests,
          count(*) FILTER (n >= threshold AND p <= 0.05) AS discoveries FROM ts, (VALUES (1), (5), (10), (15)) v(threshold) GROUP BY ALL""",
)
def st_threshold_ladder(t: Tables) -> DataFrame:
    return E.threshold_ladder(pseudo_tests(t), [1, 5, 10, 15], "n", "p", keys=["l_returnflag"])


@_ef(
    "st_attenuation",
    """, q AS (SELECT l_partkey % 20 AS module, s_nationkey::BIGINT AS cohort, count(*) FILTER (l_linestatus = 'F') AS n1, avg(l_quantity) FILTER (l_linestatus = 'F') AS m1, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v1,
              count(*) FILTER (l_linestatus = 'O') AS n0, avg(l_quantity) FILTER (l_linestatus = 'O') AS m0, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v0 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
       r AS (SELECT module, cohort, abs((1 - 3 / (4 * (n1 + n0) - 2)) * (m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0)) / nullif(abs(yi), 0) AS ratio FROM ef JOIN (SELECT * FROM q WHERE n1 > 1 AND n0 > 1) q USING (module, cohort, n1, n0))
       SELECT module, count(ratio) AS n, round(median(ratio), 5) AS median_ratio FROM r GROUP BY 1""",
)
def st_attenuation(t: Tables) -> DataFrame:
    """The quantity effect stands in for the adjusted one."""
    other = E.smd_unpaired(E.arm_moments(samples(t), KEYS, "l_linestatus", "F", "O", F.col("l_quantity")))
    a = E.attenuation(effects(t), other.where("yi is not null"), KEYS)
    return E.median_attenuation(a, ["module"]).withColumn("median_ratio", F.round("median_ratio", 5))


# --- 2.9 rank tests and resampling ----------------------------------------------------------

RANK_SQL = """
ev AS (SELECT user_id % 50 AS test, event_id, round(value, 0) AS v, event_type IN ('purchase', 'signup') AS c FROM events),
rk AS (SELECT *, rank() OVER (PARTITION BY test ORDER BY v) + (count(*) OVER (PARTITION BY test, v) - 1) / 2 AS ar FROM ev),
ti AS (SELECT test, sum(n * n * n - n)::DOUBLE AS tie FROM (SELECT test, v, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1),
rs AS (SELECT test, count(*) FILTER (c) AS n1, count(*) FILTER (NOT c) AS n0, sum(ar) FILTER (c) AS w, any_value(tie) AS tie FROM rk JOIN ti USING (test) GROUP BY 1)"""


def graded(t: Tables) -> DataFrame:
    return t.events.select((F.col("user_id") % 50).alias("test"), F.round("value", 0).alias("v"), F.col("event_type").isin("purchase", "signup").alias("c"),
                           F.col("value").alias("raw"))


@query(
    "st_rank_sum",
    f"""WITH {RANK_SQL} SELECT test, n1, n0, round(w, 4) AS w,
          round((w - n1 * (n1 + n0 + 1) / 2) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z,
          round((w - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM rs""",
)
def st_rank_sum(t: Tables) -> DataFrame:
    return rounded(R.rank_sum(graded(t), ["test"], "v", F.col("c")))


@query(
    "st_signed_rank",
    """WITH p AS (SELECT user_id % 50 AS g, user_id, avg(value) FILTER (event_type = 'view') - avg(value) FILTER (event_type = 'click') AS d FROM events GROUP BY ALL HAVING d <> 0),
        r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS ar FROM p),
        s AS (SELECT g, count(*) AS n, coalesce(sum(ar) FILTER (d > 0), 0) AS w FROM r GROUP BY 1)
       SELECT g, n, round(w, 4) AS w_plus, CASE WHEN n >= 5 THEN round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) END AS z,
         CASE WHEN n >= 5 THEN 'paired' ELSE 'not_testable' END AS status FROM s""",
)
def st_signed_rank(t: Tables) -> DataFrame:
    p = J.paired_rows(t.events.withColumn("g", F.col("user_id") % 50), ["g", "user_id"], "event_type", "view", "click", F.col("value"))
    return rounded(R.signed_rank(p, ["g"]))


@query(
    "st_auc",
    f"""WITH {RANK_SQL}, le AS (SELECT test, sum(n1 * (cum0)) AS wins FROM (SELECT test, v, count(*) FILTER (c) AS n1,
            sum(count(*) FILTER (NOT c)) OVER (PARTITION BY test ORDER BY v) AS cum0 FROM ev GROUP BY test, v) GROUP BY 1)
        SELECT test, n1 AS n_case, n0 AS n_control, round((w - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, round(wins::DOUBLE / (n1 * n0), 6) AS auc_le FROM rs JOIN le USING (test)""",
)
def st_auc(t: Tables) -> DataFrame:
    g = graded(t)
    half = R.auc(g, ["test"], "v", F.col("c"))
    le = R.auc(g, ["test"], "v", F.col("c"), ties="le").select("test", F.col("auc").alias("auc_le"))
    return rounded(half.join(le, "test"))


@query(
    "st_weighted_auc",
    """WITH d AS (SELECT d.doc_id, quality AS y, length(text) % 97 AS s, 1 + d.doc_id % 5 AS w FROM documents d JOIN labels USING (doc_id)),
        a AS (SELECT s, sum(w) FILTER (y = 1) AS w1, sum(w) FILTER (y = 0) AS w0 FROM d GROUP BY s),
        c AS (SELECT coalesce(w1, 0) AS w1, coalesce(w0, 0) AS w0, coalesce(sum(coalesce(w0, 0)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM a)
       SELECT round(sum(w1 * (b + w0 / 2)) / (sum(w1) * sum(w0)), 6) AS auc FROM c""",
)
def st_weighted_auc(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id").select(F.col("quality").alias("y"), (F.length("text") % 97).alias("s"), (1 + F.col("doc_id") % 5).cast("double").alias("w"))
    return rounded(R.weighted_auc(d, [], "s", F.col("y") == 1, "w"))


@query(
    "st_effect_trio",
    f"""WITH {RANK_SQL}, m AS (SELECT user_id % 50 AS test, avg(round(value, 0)) FILTER (event_type IN ('purchase', 'signup')) AS m1, avg(round(value, 0)) FILTER (event_type NOT IN ('purchase', 'signup')) AS m0,
            var_samp(round(value, 0)) FILTER (event_type IN ('purchase', 'signup')) AS v1, var_samp(round(value, 0)) FILTER (event_type NOT IN ('purchase', 'signup')) AS v0 FROM events GROUP BY 1)
        SELECT test, n1, n0, round(log2(m1 / m0), 6) AS log2_fc, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d,
          round((w - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM rs JOIN m USING (test)""",
)
def st_effect_trio(t: Tables) -> DataFrame:
    return rounded(R.effect_trio(graded(t), ["test"], "v", F.col("c")))


@query(
    "st_empirical_calibration",
    f"""WITH {TESTS_SQL} SELECT count(p) AS n, alpha::DOUBLE AS alpha, count(*) FILTER (p <= alpha) AS observed, round(count(p) * alpha::DOUBLE, 6) AS expected,
          round(least(1, count(p) * alpha::DOUBLE / nullif(count(*) FILTER (p <= alpha), 0)), 6) AS fdr FROM ts, (VALUES (0.01), (0.05), (0.1), (0.5)) v(alpha) GROUP BY alpha""",
)
def st_empirical_calibration(t: Tables) -> DataFrame:
    return rounded(R.empirical_fdr(pseudo_tests(t), "p", [0.01, 0.05, 0.1, 0.5]))


def supplier_units(t: Tables) -> DataFrame:
    u = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("v"))
    return u.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("l_suppkey", F.round("v", 8).alias("v"), (F.col("s_nationkey") < 8).alias("c"))


UNIFORM_SQL = "((('0x' || substring(md5({}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


@query(
    "st_permutation",
    f"""WITH u AS (SELECT l_suppkey AS u, round(avg(l_discount), 8) AS v FROM lineitem GROUP BY 1),
        b AS (SELECT u, v, s_nationkey < 8 AS c FROM u JOIN supplier ON s_suppkey = u),
        o AS (SELECT count(*) FILTER (c) AS n1, count(*) AS n, sum(v) AS s, sum(v) FILTER (c) AS s1 FROM b),
        d AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {UNIFORM_SQL.format("'1|' || rep || '|' || u")}) AS place FROM b, range(1, 201) r(rep)),
        x AS (SELECT rep, sum(v) AS s1 FROM d, o WHERE place <= n1 GROUP BY rep),
        y AS (SELECT x.s1 / n1 - (s - x.s1) / (n - n1) AS d, o.s1 / n1 - (s - o.s1) / (n - n1) AS obs FROM x, o),
        z AS (SELECT count(*) AS reps, any_value(obs) AS observed, count(*) FILTER (d >= obs) AS ge, count(*) FILTER (d <= obs) AS le FROM y)
        SELECT reps, round(observed, 6) AS observed, ge, le, round((ge + 1) / (reps + 1), 6) AS p_upper,
          round(least(1, 2 * least((ge + 1) / (reps + 1), (le + 1) / (reps + 1))), 6) AS p FROM z""",
)
def st_permutation(t: Tables) -> DataFrame:
    return rounded(R.permutation_test(supplier_units(t), "l_suppkey", "v", "c", 200))


@query(
    "st_jackknife",
    f"""WITH {RANK_SQL}, pl AS (SELECT a.test, a.event_id, (SELECT sum(CASE WHEN b.v < a.v THEN 1 WHEN b.v = a.v THEN 0.5 ELSE 0 END) FROM ev b WHERE b.test = a.test AND NOT b.c) AS p FROM ev a WHERE a.c)
        SELECT test, any_value(n1) AS n_case, any_value(n0) AS n_control, round(sum(p)::DOUBLE / (any_value(n1) * any_value(n0)), 6) AS auc,
          round((sum(p) - max(p))::DOUBLE / nullif((any_value(n1) - 1) * any_value(n0), 0), 6) AS min_auc, round((sum(p) - min(p))::DOUBLE / nullif((any_value(n1) - 1) * any_value(n0), 0), 6) AS max_auc FROM pl JOIN rs USING (test) GROUP BY test""",
)
def st_jackknife(t: Tables) -> DataFrame:
    return rounded(R.leave_one_out_auc(graded(t), ["test"], "v", F.col("c")))


@query(
    "st_competitive",
    f"""WITH {RANK_SQL}, m AS (SELECT test, avg(v) FILTER (c) AS mi, avg(v) FILTER (NOT c) AS mo FROM ev GROUP BY 1)
        SELECT test, round(mi, 6) AS mean_in, round(mo, 6) AS mean_out, round((w - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM rs JOIN m USING (test)""",
)
def st_competitive(t: Tables) -> DataFrame:
    return rounded(R.set_test(graded(t), ["test"], "v", F.col("c")).select("test", "mean_in", "mean_out", "auc"))


@query(
    "st_sign_test",
    """WITH k AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS k FROM lineitem WHERE l_discount <> 0.05 AND l_returnflag = 'R' GROUP BY 1)
       SELECT l_suppkey, n, k, round(least(1, 2 * list_sum(list_transform(range(greatest(k, n - k), n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p FROM k""",
)
def st_sign_test(t: Tables) -> DataFrame:
    k = t.lineitem.where("l_discount <> 0.05 and l_returnflag = 'R'").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    return rounded(R.sign_test(k, "k", "n"))


MEMBER_SQL = """
mv AS (SELECT l_returnflag AS cohort, l_suppkey % 10 AS member, l_orderkey % 40 AS sample, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
mz AS (SELECT *, (v - avg(v) OVER (PARTITION BY cohort, member)) / nullif(stddev_samp(v) OVER (PARTITION BY cohort, member), 0) AS z FROM mv)"""


def member_values(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("cohort"), (F.col("l_suppkey") % 10).alias("member"), (F.col("l_orderkey") % 40).alias("sample")).agg(
        F.avg("l_extendedprice").alias("v"))


@query(
    "st_member_z_score",
    f"""WITH {MEMBER_SQL}, a AS (SELECT cohort, sample, avg(z) AS z_first FROM mz GROUP BY ALL),
        b AS (SELECT cohort, sample, avg(v) AS v FROM mv GROUP BY ALL), c AS (SELECT cohort, sample, (v - avg(v) OVER (PARTITION BY cohort)) / stddev_samp(v) OVER (PARTITION BY cohort) AS mean_first FROM b)
        SELECT cohort, sample, round(z_first, 5) AS z_first, round(mean_first, 5) AS mean_first FROM a JOIN c USING (cohort, sample)""",
)
def st_member_z_score(t: Tables) -> DataFrame:
    v = member_values(t)
    a = R.member_mean_z(v, "cohort", "member", "sample", "v").withColumnRenamed("score", "z_first")
    b = R.member_mean_z(v, "cohort", "member", "sample", "v", order="mean_first").withColumnRenamed("score", "mean_first")
    return rounded(a.join(b, ["cohort", "sample"]), 5)


@query(
    "st_leave_member_out",
    f"""WITH {MEMBER_SQL}, e AS (SELECT cohort, member, avg(z) FILTER (sample < 15) - avg(z) FILTER (sample >= 15) AS f FROM mz GROUP BY ALL),
        s AS (SELECT *, sum(f) OVER (PARTITION BY cohort) AS s, count(f) OVER (PARTITION BY cohort) AS k FROM e)
        SELECT cohort, member, round(s / k, 5) AS effect, round((s - f) / nullif(k - 1, 0), 5) AS without, sign(s / k) <> sign((s - f) / nullif(k - 1, 0)) AS flips FROM s""",
)
def st_leave_member_out(t: Tables) -> DataFrame:
    return rounded(R.leave_member_out(member_values(t), "cohort", "member", "v", F.col("sample") < 15), 5)


@query(
    "st_stratified",
    """SELECT l_returnflag, l_linenumber::BIGINT AS l_linenumber, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL""",
)
def st_stratified(t: Tables) -> DataFrame:
    return rounded(R.stratified_means(t.lineitem, ["l_returnflag", "l_linenumber"], "l_linestatus", F.col("l_discount")))


def _poisson_sql(u: str) -> str:
    import math

    cases, c = [], 0.0
    for k in range(12):
        c += math.exp(-1) / math.factorial(k)
        cases.append(f"WHEN {u} < {c!r}::DOUBLE THEN {k}")
    return f"(CASE {' '.join(cases)} ELSE 12 END)"


@query(
    "st_bootstrap",
    f"""WITH p AS (SELECT o_custkey AS c, sum(o_totalprice) AS y, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS yf, count(*) FILTER (o_orderstatus = 'F') AS nf FROM orders GROUP BY 1),
        d AS (SELECT p.*, rep, {UNIFORM_SQL.format("'1|' || rep || '|' || c")} AS u FROM p, range(1, 101) r(rep)),
        w AS (SELECT *, {_poisson_sql("u")} AS t FROM d),
        s AS (SELECT rep, sum(y * t) / sum(n * t) AS mean, sum(yf * t) / sum(nf * t) - sum(y * t) / sum(n * t) AS diff FROM w GROUP BY rep),
        l AS (SELECT 'mean' AS stat, mean AS x FROM s UNION ALL SELECT 'diff', diff FROM s)
        SELECT stat, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS se, round(quantile_cont(x, 0.025), 3) AS lo, round(quantile_cont(x, 0.975), 3) AS hi FROM l GROUP BY 1""",
)
def st_bootstrap(t: Tables) -> DataFrame:
    final = F.col("o_orderstatus") == "F"
    totals = {
        "y": F.col("o_totalprice"), "n": F.lit(1), "yf": F.when(final, F.col("o_totalprice")).otherwise(F.lit(0.0)),
        "nf": F.when(final, 1).otherwise(0),
    }
    mean = F.try_divide(F.col("y"), F.col("n"))
    reps = B.bootstrap(t.orders, "o_custkey", totals, {"mean": mean, "diff": F.try_divide(F.col("yf"), F.col("nf")) - mean}, 100)
    return rounded(B.percentile_ci(reps, ["mean", "diff"]), 3)


# --- 2.10 survey designs and models ---------------------------------------------------------

SURVEY_SQL = """
sv AS (SELECT c_nationkey::BIGINT AS strata, o_custkey % 5 AS psu, o_totalprice / 1000 AS w, (o_orderstatus = 'F')::INT AS y, (o_orderpriority < '3')::INT AS x, year(o_orderdate) AS period, o_totalprice AS price
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def survey(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select(
        F.col("c_nationkey").cast("bigint").alias("strata"), (F.col("o_custkey") % 5).alias("psu"), (F.col("o_totalprice") / 1000).alias("w"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderpriority") < "3").cast("int").alias("x"),
        F.year("o_orderdate").alias("period"), "o_orderkey", "o_totalprice",
    )


@query(
    "sv_design",
    f"""WITH {SURVEY_SQL}, p AS (SELECT DISTINCT period || '_' || strata AS s, period || '_' || strata || '_' || psu AS u, period % 2 AS half FROM sv),
        m AS (SELECT half, s, count(*) AS m FROM p GROUP BY ALL)
        SELECT half, count(*) AS n_strata, sum(m)::BIGINT AS n_psu, sum(m - 1)::BIGINT AS degf, count(*) FILTER (m = 1) AS lonely FROM m GROUP BY half""",
)
def sv_design(t: Tables) -> DataFrame:
    d = survey(t).withColumn("half", F.col("period") % 2)
    d = d.withColumn("s", V.design_key("period", "strata")).withColumn("u", V.design_key("period", "strata", "psu"))
    return V.design_summary(d, "s", "u", ["half"])


@query(
    "sv_weighted_mean",
    f"""WITH {SURVEY_SQL}, t AS (SELECT x, strata, psu, sum(w) AS sw, sum(w * y) AS swy FROM sv GROUP BY ALL),
        m AS (SELECT x, sum(swy) / sum(sw) AS mean, sum(sw) AS ww FROM t GROUP BY 1),
        z AS (SELECT t.x, strata, (swy - mean * sw) / ww AS z FROM t JOIN m ON m.x = t.x),
        v AS (SELECT x, strata, count(*) AS m, var_samp(z) AS v FROM z GROUP BY ALL)
        SELECT m.x::BIGINT AS x, round(any_value(mean), 6) AS mean, round(sqrt(sum(m * v)), 6) AS se, sum(m - 1)::BIGINT AS degf, count(*) FILTER (m = 1) AS lonely FROM v JOIN m ON m.x = v.x GROUP BY m.x""",
)
def sv_weighted_mean(t: Tables) -> DataFrame:
    return rounded(V.svy_mean(survey(t), F.col("y"), "strata", "psu", "w", ["x"]))


@query(
    "sv_rao_wu",
    f"""WITH {SURVEY_SQL}, t AS (SELECT strata, psu, sum(w) AS sw, sum(w * y) AS swy, row_number() OVER (PARTITION BY strata ORDER BY psu) AS i, count(*) OVER (PARTITION BY strata) AS m FROM sv GROUP BY strata, psu),
        d AS (SELECT strata, rep, m, least(floor({UNIFORM_SQL.format("'1|' || rep || '|' || strata || '|' || i")} * m)::BIGINT + 1, m) AS k FROM t, range(1, 201) r(rep) WHERE i < m),
        h AS (SELECT strata, rep, k, count(*) * any_value(m) / (any_value(m) - 1) AS f FROM d GROUP BY ALL),
        a AS (SELECT strata, psu, rep, f, sw, swy FROM h JOIN t USING (strata) WHERE t.i = h.k UNION ALL SELECT strata, psu, rep, 1, sw, swy FROM t, range(1, 201) r(rep) WHERE m = 1),
        s AS (SELECT rep, sum(f * swy) / sum(f * sw) AS mean FROM a GROUP BY rep)
        SELECT count(*) AS reps, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS se FROM s""",
)
def sv_rao_wu(t: Tables) -> DataFrame:
    d = survey(t)
    factors = V.rao_wu_weights(d, "strata", "psu", 200)
    reps = V.replicate_mean(d, F.col("y"), "strata", "psu", "w", factors)
    return rounded(reps.agg(F.count("*").alias("reps"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("se")))


@query(
    "sv_weight_schemes",
    f"""WITH {SURVEY_SQL} SELECT period, count(*) AS n, round(sum(w), 2) AS raw, round(sum(w * n_ / s_), 4) AS each_mean_1, round(sum(w / s_), 6) AS equal_layer FROM (
          SELECT period, w, count(*) OVER (PARTITION BY period) AS n_, sum(w) OVER (PARTITION BY period) AS s_ FROM sv) GROUP BY period""",
)
def sv_weight_schemes(t: Tables) -> DataFrame:
    d = survey(t).select("period", F.col("w").alias("w0"))
    total = lambda scheme: H.weight_scale(d, "w0", scheme, "period").groupBy("period").agg(F.sum("w").alias(scheme))
    raw = H.weight_scale(d, "w0", "raw").groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("raw"))
    out = raw.join(total("each_mean_1"), "period").join(total("equal_layer"), "period")
    return out.select("period", "n", "raw", F.round("each_mean_1", 4).alias("each_mean_1"), F.round("equal_layer", 6).alias("equal_layer"))


@query(
    "sv_ipw",
    f"""WITH {SURVEY_SQL}, i AS (SELECT x, y AS inc, w, avg(y) OVER (PARTITION BY x) AS p FROM sv),
        r AS (SELECT *, CASE WHEN inc = 1 THEN w / p END AS raw FROM i), s AS (SELECT *, raw / (SELECT avg(raw) FROM r) AS wt FROM r)
        SELECT count(*) AS n_model, sum(inc)::BIGINT AS n_analysis, count(wt) AS n_weighted, round(min(p), 5) AS p_min, round(max(p), 5) AS p_max,
          round(pow(sum(wt), 2) / sum(wt * wt), 2) AS ess, round(avg(p), 5) AS mean_p, round(avg(inc), 5) AS rate FROM s""",
)
def sv_ipw(t: Tables) -> DataFrame:
    """Inclusion = final order. With one binary covariate the fitted p is the group's rate, so SQL can follow."""
    d = survey(t).select("x", F.col("y").alias("inc"), F.col("w").alias("w0"))
    r = V.ipw_report(V.ipw(d, "inc", ["x"], "w0"), "inc")
    return rounded(r.withColumn("ess", F.round("ess", 2)), 5)


@query(
    "sv_logit",
    f"""WITH {SURVEY_SQL}, g AS (SELECT x, sum(w * y) / sum(w) AS p, sum(w) AS ww FROM sv GROUP BY x),
        z AS (SELECT strata, psu, sum(CASE WHEN x = 1 THEN 1 ELSE -1 END * w * (y - p) / (ww * p * (1 - p))) AS z, sum(CASE WHEN x = 0 THEN w * (y - p) / (ww * p * (1 - p)) ELSE 0 END) AS z0 FROM sv JOIN g USING (x) GROUP BY ALL),
        v AS (SELECT strata, count(*) AS m, var_samp(z) AS v, var_samp(z0) AS v0 FROM z GROUP BY 1),
        s AS (SELECT sqrt(sum(m * v)) AS se, sqrt(sum(m * v0)) AS se0, sum(m - 1)::BIGINT AS degf FROM v),
        b AS (SELECT ln(max(p) FILTER (x = 1) / (1 - max(p) FILTER (x = 1))) AS l1, ln(max(p) FILTER (x = 0) / (1 - max(p) FILTER (x = 0))) AS l0 FROM g)
        SELECT 'x' AS term, round(l1 - l0, 5) AS b, round(se, 5) AS se, round(exp(l1 - l0), 5) AS odds_ratio, degf FROM b, s
        UNION ALL SELECT 'intercept', round(l0, 5), round(se0, 5), round(exp(l0), 5), degf FROM b, s""",
)
def sv_logit(t: Tables) -> DataFrame:
    fit = V.svy_logit(survey(t), "y", ["x"], "strata", "psu", "w")
    return rounded(V.coefficient_table(t.spark, fit).select("term", "b", "se", "odds_ratio", "degf"), 5)


@query(
    "sv_period_contrast",
    f"""WITH {SURVEY_SQL}, d AS (SELECT *, (period >= 1996)::INT AS late FROM sv), g AS (SELECT late, x, sum(w * y) / sum(w) AS p, sum(w) AS ww FROM d GROUP BY ALL),
        z AS (SELECT strata, psu, sum(CASE WHEN late = 0 THEN CASE WHEN x = 1 THEN 1 ELSE -1 END * w * (y - p) / (ww * p * (1 - p)) ELSE 0 END) AS z0,
               sum(CASE WHEN late = 1 THEN CASE WHEN x = 1 THEN 1 ELSE -1 END * w * (y - p) / (ww * p * (1 - p)) ELSE 0 END) AS z1 FROM d JOIN g USING (late, x) GROUP BY ALL),
        v AS (SELECT strata, count(*) AS m, var_samp(z0) AS v0, var_samp(z1) AS v1 FROM z GROUP BY 1), s AS (SELECT sqrt(sum(m * v0)) AS se0, sqrt(sum(m * v1)) AS se1 FROM v),
        b AS (SELECT late, ln(max(p) FILTER (x = 1) / (1 - max(p) FILTER (x = 1))) - ln(max(p) FILTER (x = 0) / (1 - max(p) FILTER (x = 0))) AS b FROM g GROUP BY 1)
        SELECT CASE WHEN late = 0 THEN 'early' ELSE 'late' END AS period, round(b, 5) AS b, round(CASE WHEN late = 0 THEN se0 ELSE se1 END, 5) AS se FROM b, s""",
)
def sv_period_contrast(t: Tables) -> DataFrame:
    d = survey(t).withColumn("late", (F.col("period") >= 1996).cast("int")).withColumn("xl", F.col("x") * F.col("late"))
    fit = V.svy_logit(d, "y", ["x", "late", "xl"], "strata", "psu", "w")
    (b0, s0), (b1, s1) = V.period_contrast(fit, "x", "xl")
    rows = [("early", float(b0), s0), ("late", float(b1), s1)]
    return rounded(t.spark.createDataFrame(rows, "period string, b double, se double"), 5)


@query(
    "sv_spline_basis",
    """WITH k AS (SELECT quantile_cont(o_totalprice / 1000, [0.1, 0.5, 0.9]) AS k FROM orders),
        d AS (SELECT o_orderkey, o_totalprice / 1000 AS x, k[1] AS a, k[2] AS b, k[3] AS c FROM orders, k)
       SELECT o_orderkey, round((pow(greatest(x - a, 0), 3) - pow(greatest(x - b, 0), 3) * (c - a) / (c - b) + pow(greatest(x - c, 0), 3) * (b - a) / (c - b)) / pow(c - a, 2), 4) AS x_s1 FROM d""",
)
def sv_spline_basis(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))
    return V.rcs_basis(d, "x", [0.1, 0.5, 0.9]).select("o_orderkey", F.round("x_s1", 4).alias("x_s1"))


@query(
    "sv_lr_nested",
    """WITH d AS (SELECT (o_orderstatus = 'F')::INT AS y, (o_orderpriority < '3')::INT AS x FROM orders),
        g AS (SELECT x, sum(y) AS e, count(*) AS n FROM d GROUP BY 1),
        l AS (SELECT sum(e * ln(e / n) + (n - e) * ln((n - e) / n)) AS l1, sum(e) AS e, sum(n) AS n FROM g)
       SELECT round(2 * (l1 - (e * ln(e / n) + (n - e) * ln((n - e) / n))), 4) AS chi2, 1::BIGINT AS df, true AS design_based FROM l""",
)
def sv_lr_nested(t: Tables) -> DataFrame:
    r = V.nested_lr(survey(t), "y", [], ["x"])
    row = [(round(float(r["chi2"]), 4), int(r["df"]), bool(r["design_based"]))]
    return t.spark.createDataFrame(row, "chi2 double, df bigint, design_based boolean")


@query(
    "sv_collinearity",
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem),
        r AS (SELECT 'l_quantity' AS "column", (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc) AS r2 FROM c
          UNION ALL SELECT 'l_extendedprice', (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac) FROM c UNION ALL SELECT 'l_discount', (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab) FROM c)
       SELECT "column", round(r2, 6) AS r2, round(1 / (1 - r2), 6) AS vif FROM r""",
)
def sv_collinearity(t: Tables) -> DataFrame:
    return rounded(V.r2_vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


# --- validation -----------------------------------------------------------------------------

RISK_SQL = """
rk AS (SELECT doc_id, lang, source, quality AS y, n_chars, round((n_chars % 101) / 101, 6) AS pa, round(0.5 * (n_chars % 101) / 101 + 0.5 * (n_chars % 37) / 37, 6) AS pb FROM documents LEFT JOIN labels USING (doc_id))"""


def risks(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id", "left").select(
        "doc_id", "lang", "source", "y", "n_chars", F.round(n % 101 / 101, 6).alias("pa"), F.round(0.5 * (n % 101) / 101 + 0.5 * (n % 37) / 37, 6).alias("pb"))


@query(
    "vl_brier",
    f"""WITH {RISK_SQL} SELECT lang, count(*) AS n, round(avg(pow(pa - y, 2)), 6) AS brier, round(avg(pow(pb - y, 2)), 6) AS brier_updated, round(avg(pow(pb - y, 2) - pow(pa - y, 2)), 6) AS delta
        FROM rk WHERE y IS NOT NULL GROUP BY lang""",
)
def vl_brier(t: Tables) -> DataFrame:
    return rounded(P.brier(risks(t), ["lang"], "y", F.col("pa"), F.col("pb")))


FOLLOW_SQL = """
fu AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1, min(ts) FILTER (event_type = 'purchase' AND value > 60) AS tp, count(*) AS n FROM events GROUP BY 1),
fo AS (SELECT user_id, date_diff('day', t0::DATE, coalesce(tp, t1)::DATE) AS time, (tp IS NOT NULL)::INT AS event, n % 23 AS risk FROM fu)"""


def follow_up(t: Tables) -> DataFrame:
    """Days from a user's first event to the first large purchase, censored at the last event."""
    buy = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("ts"))
    u = t.events.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min(buy).alias("tp"), F.count("*").alias("n"))
    days = F.date_diff(F.to_date(F.coalesce("tp", "t1")), F.to_date("t0"))
    return u.select("user_id", days.alias("time"), F.col("tp").isNotNull().cast("int").alias("event"), (F.col("n") % 23).alias("risk"))


@query(
    "vl_horizon_auc",
    f"""WITH {FOLLOW_SQL}, s AS (SELECT *, CASE WHEN event = 1 AND time <= 10 THEN 1 WHEN time >= 10 THEN 0 END AS y FROM fo),
        w AS (SELECT sum(CASE WHEN b.risk < a.risk THEN 1 WHEN b.risk = a.risk THEN 0.5 ELSE 0 END)::DOUBLE AS w FROM s a, s b WHERE a.y = 1 AND b.y = 0)
        SELECT count(*) FILTER (y = 1) AS n_case, count(*) FILTER (y = 0) AS n_control, round(any_value(w) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc,
          count(*) AS n, count(*) FILTER (y IS NULL) AS n_excluded FROM s, w""",
)
def vl_horizon_auc(t: Tables) -> DataFrame:
    return rounded(P.horizon_auc(follow_up(t), [], "time", "event", "risk", 10))


@query(
    "vl_km",
    f"""WITH {FOLLOW_SQL}, c AS (SELECT time, count(*) AS n, sum(event)::BIGINT AS d FROM fo GROUP BY 1),
        r AS (SELECT time, d, sum(n) OVER (ORDER BY time DESC)::BIGINT AS at_risk FROM c)
        SELECT time, at_risk, d AS events, round(CASE WHEN sum((d = at_risk)::INT) OVER (ORDER BY time) > 0 THEN 0
          ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER (ORDER BY time)) END, 6) AS survival FROM r""",
)
def vl_km(t: Tables) -> DataFrame:
    return rounded(P.kaplan_meier(follow_up(t), [], "time", F.col("event") == 1))


@query(
    "vl_calibration",
    f"""WITH {RISK_SQL}, k AS (SELECT * FROM rk WHERE y IS NOT NULL), g AS (SELECT *, (rank() OVER (ORDER BY pa) - 1) * 10 // count(*) OVER () + 1 AS grp FROM k)
        SELECT grp AS "group", count(*) AS n, round(avg(pa), 6) AS predicted, round(avg(y), 6) AS observed, round(avg(y) / nullif(avg(pa), 0), 6) AS oe, round(avg(y) - avg(pa), 6) AS diff FROM g GROUP BY grp""",
)
def vl_calibration(t: Tables) -> DataFrame:
    return rounded(P.calibration_table(risks(t).where("y is not null"), [], "pa", "y"))


@query("vl_calibration_slope")
def vl_calibration_slope(t: Tables) -> DataFrame:
    """Logistic recalibration; an iterative fit without SQL."""
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("pa")))
    d = risks(t).where("y is not null").withColumn("lp", F.ln(p / (1 - p)))
    r = P.calibration_slope(d, "lp", "y")
    return rounded(t.spark.createDataFrame([(r["slope"], r["intercept"])], "slope double, intercept double"))


@query(
    "vl_decision_curve",
    f"""WITH {RISK_SQL}, k AS (SELECT * FROM rk WHERE y IS NOT NULL), v AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) AS threshold),
        c AS (SELECT lang, threshold, count(*) AS n, avg(y) AS prevalence, count(*) FILTER (pa >= threshold AND y = 1) AS tp, count(*) FILTER (pa >= threshold AND y = 0) AS fp FROM k, v GROUP BY ALL)
        SELECT lang, n, round(prevalence, 6) AS prevalence, threshold, round(tp / n - fp / n * threshold / (1 - threshold), 6) AS net_benefit,
          round(prevalence - (1 - prevalence) * threshold / (1 - threshold), 6) AS treat_all, 0::DOUBLE AS treat_none, true AS possible FROM c""",
)
def vl_decision_curve(t: Tables) -> DataFrame:
    return rounded(P.net_benefit(risks(t), ["lang"], "pa", "y", [0.05, 0.1, 0.2, 0.3]))


@query(
    "vl_idi_nri",
    f"""WITH {RISK_SQL} SELECT lang, count(*) AS n, round(avg(pb - pa) FILTER (y = 1) - avg(pb - pa) FILTER (y = 0), 6) AS idi,
          round(avg((pb > pa)::INT) FILTER (y = 1) - avg((pb < pa)::INT) FILTER (y = 1) + avg((pb < pa)::INT) FILTER (y = 0) - avg((pb > pa)::INT) FILTER (y = 0), 6) AS nri
        FROM rk WHERE y IS NOT NULL GROUP BY lang""",
)
def vl_idi_nri(t: Tables) -> DataFrame:
    return rounded(P.reclassification(risks(t), ["lang"], "y", F.col("pa"), F.col("pb")))


@query(
    "vl_grouped_folds",
    f"""WITH {SURVEY_SQL}, f AS (SELECT y, least(floor({UNIFORM_SQL.format("'1|' || period || '_' || strata || '_' || psu")} * 10)::BIGINT, 9) AS fold FROM sv)
        SELECT fold, count(*) AS n, sum(y)::BIGINT AS events, sum(y) = 0 OR sum(y) = count(*) AS degenerate FROM f GROUP BY fold""",
)
def vl_grouped_folds(t: Tables) -> DataFrame:
    return P.fold_report(P.grouped_folds(survey(t), V.design_key("period", "strata", "psu"), 10), "y")


@query(
    "vl_paired_folds",
    f"""WITH {RISK_SQL}, f AS (SELECT *, least(floor({UNIFORM_SQL.format("'1|' || source")} * 5)::BIGINT, 4) AS fold FROM rk WHERE y IS NOT NULL),
        b AS (SELECT fold, avg(pow(pa - y, 2)) AS a, avg(pow(pb - y, 2)) AS b FROM f GROUP BY 1)
        SELECT count(*) AS k, round(avg(a - b), 6) AS mean_diff, round(stddev_samp(a - b), 6) AS sd_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) AS t FROM b""",
)
def vl_paired_folds(t: Tables) -> DataFrame:
    f = P.grouped_folds(risks(t).where("y is not null"), F.col("source"), 5)
    per = f.groupBy("fold").agg(F.avg(F.pow(F.col("pa") - F.col("y"), F.lit(2.0))).alias("a"), F.avg(F.pow(F.col("pb") - F.col("y"), F.lit(2.0))).alias("b"))
    out = P.paired_fold_test(per, "a", "b", tails=False)
    return rounded(out.withColumn("t", F.round("t", 4)))


@query(
    "vl_optimism",
    f"""WITH {RISK_SQL}, c AS (SELECT source, lang, count(*) AS n, sum(y) AS e FROM rk WHERE y IS NOT NULL GROUP BY ALL), o AS (SELECT lang, sum(n) AS n0, sum(e) AS e0 FROM c GROUP BY 1),
        d AS (SELECT c.*, rep, {UNIFORM_SQL.format("'1|' || rep || '|' || source")} AS u FROM c, range(1, 101) r(rep)),
        b AS (SELECT rep, lang, sum(n * t) AS n, sum(e * t) AS e FROM (SELECT *, {_poisson_sql("u")} AS t FROM d) GROUP BY ALL),
        m AS (SELECT rep, n, e, n0, e0, coalesce(e / nullif(n, 0), sum(e) OVER (PARTITION BY rep) / sum(n) OVER (PARTITION BY rep)) AS p FROM b JOIN o USING (lang)),
        s AS (SELECT rep, sum(e * (1 - p) * (1 - p) + (n - e) * p * p) / sum(n) AS ba, sum(e0 * (1 - p) * (1 - p) + (n0 - e0) * p * p) / sum(n0) AS bo FROM m GROUP BY rep),
        a AS (SELECT sum(e0 * (1 - e0 / n0) * (1 - e0 / n0) + (n0 - e0) * (e0 / n0) * (e0 / n0)) / sum(n0) AS apparent FROM o)
        SELECT count(*) AS reps, round(avg(ba - bo), 6) AS optimism, round(any_value(apparent), 6) AS apparent, round(any_value(apparent) - avg(ba - bo), 6) AS corrected FROM s, a""",
)
def vl_optimism(t: Tables) -> DataFrame:
    """A rate-by-language model, resampled by source."""
    d = risks(t).where("y is not null").select("source", "lang", "y")
    reps = B.rate_model_replicates(d, "source", "lang", "y", 100)
    g = d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("y").alias("e"))
    p = F.col("e") / F.col("n")
    sq = F.col("e") * (1 - p) * (1 - p) + (F.col("n") - F.col("e")) * p * p
    return rounded(B.optimism(g.agg((F.sum(sq) / F.sum("n")).alias("apparent")), reps))


@query(
    "vl_overprediction_split",
    f"""WITH {RISK_SQL}, m AS (SELECT lang, avg(pa) AS a, avg(pb) AS d, avg(y) AS o FROM rk WHERE y IS NOT NULL GROUP BY lang)
        SELECT lang, round(a - o, 6) AS gap, round((a - d) / nullif(a - o, 0), 5) AS baseline_share, round((d - o) / nullif(a - o, 0), 5) AS case_mix_share FROM m""",
)
def vl_overprediction_split(t: Tables) -> DataFrame:
    m = risks(t).where("y is not null").groupBy("lang").agg(F.avg("pa").alias("a"), F.avg("pb").alias("d"), F.avg("y").alias("o"))
    s = P.overprediction_split(F.col("a"), F.col("d"), F.col("o"))
    return m.select("lang", F.round(s["gap"], 6).alias("gap"), *[F.round(s[k], 5).alias(k) for k in ("baseline_share", "case_mix_share")])


# --- 2.11 stream ----------------------------------------------------------------------------


@query(
    "stm_audit",
    r"""SELECT doc_id, 1 + doc_id % 3 AS version, len(regexp_extract_all(text, '[A-Za-z] {2,}[A-Za-z]')) AS double_spaces,
          len(regexp_extract_all(text, '[0-9],[0-9]{3}')) AS thousands_commas, len(regexp_extract_all(text, '\bv1[0-9]\b')) AS version_tags, 11::BIGINT AS n_checks FROM documents""",
)
def stm_audit(t: Tables) -> DataFrame:
    """Every document arrives three times as one revision; the replays must leave no second finding."""
    source = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.folder}/documents*.parquet")
    revisions = source.select(
        "doc_id", (1 + F.col("doc_id") % 3).alias("version"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 1000).alias("ts"),
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("replay"),
    )
    out, checkpoint = shared_dir(t.spark), shared_dir(t.spark)
    run = start_audit(audit_stream(revisions.drop("replay")), out, checkpoint)
    run.awaitTermination()
    found = t.spark.read.parquet(out)
    return found.groupBy("doc_id", "version").agg(
        *[F.sum(F.when(F.col("check") == c, F.col("n"))).alias(c) for c in ("double_spaces", "thousands_commas", "version_tags")],
        F.count("*").alias("n_checks"))
