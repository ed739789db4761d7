"""Rank statistics. All of them read one table of distinct values with counts (see ``ordered``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.functions.draws import uniform
from sparkaudit.functions.tails import sign_test_p
from sparkaudit.operators.ordered import average_ranks, null_safe_join, prefix_sums
from sparkaudit.session import cut_lineage

#: Cells over the range of the draws in which a replicate is counted before its cut is looked for.
CELLS = 1024


def _case_counts(df: DataFrame, keys: Sequence[str], value: str, case: Column) -> DataFrame:
    one = F.when(case, 1).otherwise(0).cast("bigint")
    rows = df.where(case.isNotNull())
    return prefix_sums(rows, keys, value, {"n1": one, "n0": (1 - one).cast("bigint")})


def auc_from_counts(counts: DataFrame, keys: Sequence[str], ties: str = "half") -> DataFrame:
    """AUC = P(case > control); ties count one half, or as wins with ``ties='le'``."""
    tie = F.col("n0") / 2.0 if ties == "half" else F.col("n0").cast("double")
    wins = F.sum(F.col("n1") * (F.col("n0_before") + tie))
    out = counts.groupBy(*keys).agg(F.max("n1_total").alias("n_case"), F.max("n0_total").alias("n_control"), wins.alias("_w"))
    pairs = F.col("n_case").cast("double") * F.col("n_control")
    return out.select(*keys, "n_case", "n_control", F.try_divide(F.col("_w"), pairs).alias("auc"))


def auc(df: DataFrame, keys: Sequence[str], value: str, case: Column, ties: str = "half") -> DataFrame:
    return auc_from_counts(_case_counts(df, keys, value, case), keys, ties)


def weighted_auc(df: DataFrame, keys: Sequence[str], value: str, case: Column, weight: str) -> DataFrame:
    """Pair-weight concordance: each case-control pair counts with the product of its weights."""
    zero = F.lit(0.0)
    sums = prefix_sums(df, keys, value, {"w1": F.when(case, F.col(weight)).otherwise(zero), "w0": F.when(case, zero).otherwise(F.col(weight))})
    wins = F.sum(F.col("w1") * (F.col("w0_before") + F.col("w0") / 2))
    out = sums.groupBy(*keys).agg(wins.alias("_w"), F.max("w1_total").alias("_a"), F.max("w0_total").alias("_b"))
    return out.select(*keys, F.try_divide(F.col("_w"), F.col("_a") * F.col("_b")).alias("auc"))


def rank_sum(df: DataFrame, keys: Sequence[str], value: str, case: Column) -> DataFrame:
    """Wilcoxon rank sum with tie correction for all tests at once: W, expected, z, AUC."""
    c = _case_counts(df, keys, value, case)
    t = (F.col("n1") + F.col("n0")).cast("double")
    rank = F.col("n1_before") + F.col("n0_before") + (t + 1) / 2
    s = c.groupBy(*keys).agg(
        F.max("n1_total").alias("n1"), F.max("n0_total").alias("n0"), F.sum(F.col("n1") * rank).alias("w"),
        F.sum(t * t * t - t).alias("_tie"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")  # products of large groups pass 64 bits
    n = n1 + n0
    mean = n1 * (n + 1) / 2.0
    var = n1 * n0 / 12.0 * ((n + 1) - F.coalesce(F.try_divide(F.col("_tie"), n * (n - 1)), F.lit(0.0)))
    u = F.col("w") - n1 * (n1 + 1) / 2.0
    return s.select(
        *keys, "n1", "n0", "w", F.try_divide(F.col("w") - mean, F.sqrt(var)).alias("z"),
        F.try_divide(u, n1 * n0).alias("auc"),
    )


def signed_rank(pairs: DataFrame, keys: Sequence[str], min_pairs: int = 5) -> DataFrame:
    """Signed rank test on (y_case, y_control); zero differences leave, fewer than five pairs is not testable."""
    d = pairs.select(*keys, (F.col("y_case") - F.col("y_control")).alias("_d")).where(F.col("_d").isNotNull() & (F.col("_d") != 0))
    d = d.withColumn("_abs", F.abs("_d"))
    ranks = average_ranks(d, keys, "_abs", {"pos": F.when(F.col("_d") > 0, 1).otherwise(0).cast("bigint")})
    t = F.col("n").cast("double")
    s = ranks.groupBy(*keys).agg(
        F.max("n_total").alias("n"), F.sum(F.col("pos") * F.col("avg_rank")).alias("w_plus"), F.sum(t * t * t - t).alias("_tie")
    )
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48
    ok = F.col("n") >= min_pairs
    return s.select(
        *keys, "n", "w_plus", F.when(ok, F.try_divide(F.col("w_plus") - mean, F.sqrt(var))).alias("z"),
        F.when(ok, "paired").otherwise("not_testable").alias("status"),
    )


def effect_trio(df: DataFrame, keys: Sequence[str], value: str, case: Column) -> DataFrame:
    """log2 fold change, Cohen's d and AUC."""
    v = F.col(value)
    a, b = F.when(case, v), F.when(~case, v)
    m = df.groupBy(*keys).agg(
        F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("_m1"), F.avg(b).alias("_m0"),
        F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v0"),
    )
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("_v1") + (F.col("n0") - 1) * F.col("_v0"), F.col("n1") + F.col("n0") - 2))
    m = m.select(
        *keys, "n1", "n0", F.log2(F.try_divide(F.col("_m1"), F.col("_m0"))).alias("log2_fc"),
        F.try_divide(F.col("_m1") - F.col("_m0"), pooled).alias("cohen_d"),
    )
    return null_safe_join(m, auc(df, keys, value, case).select(*keys, "auc"), keys)


def empirical_fdr(tests: DataFrame, p: str, alphas: Sequence[float]) -> DataFrame:
    """Observed and expected tests at each alpha; their ratio is the empirical FDR."""
    wide = tests.where(F.col(p).isNotNull()).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(p) <= a).alias(f"_a{i}") for i, a in enumerate(alphas)]
    )
    rows = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_a{i}").alias("observed"), (F.col("n") * a).alias("expected"))
                     for i, a in enumerate(alphas)])
    return wide.select("n", F.inline(rows)).withColumn("fdr", F.least(F.lit(1.0), F.try_divide(F.col("expected"), F.col("observed"))))


def permutation_test(units: DataFrame, unit: str, value: str, case: str, reps: int, seed: int = 1) -> DataFrame:
    """Difference of means under shuffled labels that keep the split; add-one P, two-sided by doubling.

    ``units`` has one row per unit (pre-aggregated), the replicates multiply that table only. A replicate's cases are its n1
    smallest draws. Its draws are counted in ``CELLS`` cells, and only those of the one cell that holds the n1-th are put in
    order, so what is shuffled is bounded by replicates x cells and units x replicates / cells. Labels must not be NULL.
    """
    base = cut_lineage(units.select(F.col(unit).alias("u"), F.col(value).cast("double").alias("v"), F.col(case).cast("boolean").alias("c")))
    obs = base.agg(
        F.count_if("c").alias("n1"), F.count("*").alias("n"), F.sum("v").alias("s"),
        F.sum(F.when(F.col("c"), F.col("v")).otherwise(F.lit(0.0))).alias("s1"),
    )
    head = obs.select(F.struct("n1", "n", "s", "s1")).scalar()
    drawn = base.select("u", "v", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn(
        "d", uniform(seed, F.col("rep"), F.col("u"))).withColumn("cell", F.floor(F.col("d") * CELLS))
    upto = Window.partitionBy("rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = drawn.groupBy("rep", "cell").agg(F.count("*").alias("m"), F.sum("v").alias("sv")).select(
        "rep", "cell", "m", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("taken"),
        F.coalesce(F.sum("sv").over(upto), F.lit(0.0)).alias("before"), head.alias("_o"))
    last = cut_lineage(cells.where("taken < _o.n1 AND taken + m >= _o.n1").drop("m"))
    inside = drawn.join(last.select("rep", "cell"), ["rep", "cell"])
    counts = prefix_sums(inside, ["rep"], "d", {"m": F.lit(1).cast("bigint"), "sv": F.col("v")}).join(last, "rep")
    chosen = counts.where(F.col("taken") + F.col("m_before") < F.col("_o.n1")).groupBy("rep").agg(
        (F.first("before") + F.coalesce(F.sum("sv"), F.lit(0.0))).alias("s1"), F.first("_o").alias("_o"))
    diff = lambda s1, o: s1 / o["n1"] - (o["s"] - s1) / (o["n"] - o["n1"])
    r = chosen.select(diff(F.col("s1"), F.col("_o")).alias("d"), diff(F.col("_o.s1"), F.col("_o")).alias("obs"))
    out = r.agg(
        F.count("*").alias("reps"), F.first("obs").alias("observed"), F.count_if(F.col("d") >= F.col("obs")).alias("ge"),
        F.count_if(F.col("d") <= F.col("obs")).alias("le"),
    )
    upper, lower = (F.col("ge") + 1) / (F.col("reps") + 1), (F.col("le") + 1) / (F.col("reps") + 1)
    return out.withColumn("p_upper", upper).withColumn("p", F.least(F.lit(1.0), 2 * F.least(upper, lower)))


def leave_one_out_auc(df: DataFrame, keys: Sequence[str], value: str, case: Column) -> DataFrame:
    """Smallest and largest AUC when one case is left out.

    A case adds its placement among the controls, so dropping it is a subtraction; cases of equal
    value share one row.
    """
    c = _case_counts(df, keys, value, case)
    wins = F.col("n0_before") + F.col("n0") / 2.0
    s = c.groupBy(*keys).agg(
        F.max("n1_total").alias("n_case"), F.max("n0_total").alias("n_control"), F.sum(F.col("n1") * wins).alias("_w"),
        F.max(F.when(F.col("n1") > 0, wins)).alias("_hi"), F.min(F.when(F.col("n1") > 0, wins)).alias("_lo"),
    )
    pairs = (F.col("n_case") - 1).cast("double") * F.col("n_control")
    return s.select(
        *keys, "n_case", "n_control", F.try_divide(F.col("_w"), F.col("n_case").cast("double") * F.col("n_control")).alias("auc"),
        F.try_divide(F.col("_w") - F.col("_hi"), pairs).alias("min_auc"), F.try_divide(F.col("_w") - F.col("_lo"), pairs).alias("max_auc"),
    )


def set_test(df: DataFrame, keys: Sequence[str], value: str, member: Column) -> DataFrame:
    """In-set against rest: means and the rank test."""
    m = df.groupBy(*keys).agg(F.avg(F.when(member, F.col(value))).alias("mean_in"), F.avg(F.when(~member, F.col(value))).alias("mean_out"))
    return null_safe_join(m, rank_sum(df, keys, value, member), keys)


def sign_test(df: DataFrame, k: str, n: str) -> DataFrame:
    return df.withColumn("p", sign_test_p(k, n))


def member_z(values: DataFrame, cohort: str, member: str, value: str) -> DataFrame:
    """z of each value within (cohort, member); a constant member has no z."""
    m = values.groupBy(cohort, member).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return values.join(m, [cohort, member]).withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def member_mean_z(values: DataFrame, cohort: str, member: str, sample: str, value: str, order: str = "z_first") -> DataFrame:
    """Set score per sample. ``z_first``: z per member, then mean; ``mean_first``: mean, then z."""
    if order == "z_first":
        return member_z(values, cohort, member, value).groupBy(cohort, sample).agg(F.avg("z").alias("score"))
    means = values.groupBy(cohort, sample).agg(F.avg(value).alias("_v"))
    m = means.groupBy(cohort).agg(F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"))
    return means.join(m, cohort).select(cohort, sample, F.try_divide(F.col("_v") - F.col("_m"), F.col("_s")).alias("score"))


def leave_member_out(values: DataFrame, cohort: str, member: str, value: str, case: Column) -> DataFrame:
    """Set effect (case minus control mean z) without each member, and sign flips.

    The effect of a set is the mean of its members' effects, so one member is left out by
    subtraction.
    """
    z = member_z(values, cohort, member, value).withColumn("_c", case)
    per = z.groupBy(cohort, member).agg(
        (F.avg(F.when(F.col("_c"), F.col("z"))) - F.avg(F.when(~F.col("_c"), F.col("z")))).alias("effect"))
    tot = per.groupBy(cohort).agg(F.sum("effect").alias("_s"), F.count("effect").alias("_k"))
    out = per.join(tot, cohort)
    full, rest = F.col("_s") / F.col("_k"), F.try_divide(F.col("_s") - F.col("effect"), F.col("_k") - 1)
    return out.select(cohort, member, full.alias("effect"), rest.alias("without"), (F.signum(full) != F.signum(rest)).alias("flips"))


def stratified_means(df: DataFrame, strata: Sequence[str], exposure: str, outcome: Column) -> DataFrame:
    """Outcome by exposure inside each stratum."""
    return df.groupBy(*strata, exposure).agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"))
