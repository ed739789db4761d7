"""Effect sizes and meta-analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import stats as S
from sparkaudit.functions.tails import p_from_t, p_from_z, t975
from sparkaudit.operators.ordered import null_safe_join, prefix_sums, suffix_min
from sparkaudit.operators.selection import exact_quantiles
from sparkaudit.session import cut_lineage

#: Points of a bracket and passes of the search for tau2: 2^40 parts of the first bracket. Passes cost more than points.
SECTIONS = 256
SEARCH_STEPS = 5


def arm_moments(df: DataFrame, keys: Sequence[str], arm: str, case: object, control: object, value: Column) -> DataFrame:
    """n, mean and SD of both arms, one row per key, from one aggregation."""
    c = F.when(F.col(arm) == case, value)
    k = F.when(F.col(arm) == control, value)
    return df.groupBy(*keys).agg(
        F.count(c).alias("n1"), F.avg(c).alias("m1"), F.stddev_samp(c).alias("s1"),
        F.count(k).alias("n0"), F.avg(k).alias("m0"), F.stddev_samp(k).alias("s0"),
    )


def smd_unpaired(moments: DataFrame, classic: bool = False) -> DataFrame:
    """Add yi, vi and a status; zero variance or a single row per arm is not estimable."""
    f = S.smd_pooled if classic else S.smd_rms
    y, v = f(*[F.col(c) for c in ("m1", "s1", "n1", "m0", "s0", "n0")])
    ok = y.isNotNull() & (F.col("n1") > 1) & (F.col("n0") > 1)
    return moments.withColumn("yi", F.when(ok, y)).withColumn("vi", F.when(ok, v)).withColumn(
        "status", F.when(ok, "estimated").otherwise("not_estimable")
    )


def smd_paired(pairs: DataFrame, keys: Sequence[str], default_r: float = 0.2, fixed_r: float | None = None) -> DataFrame:
    """Paired effects from (y_case, y_control) rows.

    r comes from the pairs, clipped to +-0.99, and is ``default_r`` when it is not finite;
    ``fixed_r`` gives the sensitivity variants.
    """
    a, b = F.col("y_case"), F.col("y_control")
    m = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("m1"), F.stddev_samp(a).alias("s1"), F.avg(b).alias("m0"),
        F.stddev_samp(b).alias("s0"), F.stddev_samp(a - b).alias("sd_diff"), S.safe_corr(a, b).alias("raw_r"),
    )
    clipped = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("raw_r")))
    r = F.lit(fixed_r) if fixed_r is not None else F.when(F.col("raw_r").isNotNull(), clipped).otherwise(F.lit(default_r))
    m = m.withColumn("r", r)
    y, v = S.smd_paired(F.col("m1"), F.col("s1"), F.col("m0"), F.col("s0"), F.col("n"), F.col("r"))
    dz = F.try_divide(F.col("m1") - F.col("m0"), F.col("sd_diff"))
    ok = y.isNotNull() & (F.col("n") > 2)
    return m.select(
        *keys, "n", "r", "raw_r", dz.alias("dz"), (dz * F.sqrt(2 * (1 - F.col("r")))).alias("g_equivalent"),
        F.when(ok, y).alias("yi"), F.when(ok, v).alias("vi"),
        F.when(ok, "estimated").otherwise("not_estimable").alias("status"),
    )


def convention_agreement(main: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Same-sign count, median and largest absolute difference between two effect conventions."""
    a = main.select(*keys, F.col("yi").alias("_a"))
    b = other.select(*keys, F.col("yi").alias("_b"))
    both = a.join(b, list(keys)).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    d = cut_lineage(both.select((F.signum("_a") == F.signum("_b")).alias("_same"), F.abs(F.col("_a") - F.col("_b")).alias("_d")))
    median = exact_quantiles(d, [], F.col("_d"), [0.5]).select(F.max("quantile")).scalar()
    counted = d.agg(F.count("*").alias("n"), F.count_if("_same").alias("same_sign"), F.max("_d").alias("max_abs_diff"))
    return counted.select("n", "same_sign", median.alias("median_abs_diff"), "max_abs_diff")


def pair_signatures(effects: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Signs of a broken pairing: |r| near 1, zero variance, an effect of exactly 0, attempted vs finite."""
    return effects.groupBy(*keys).agg(
        F.count("*").alias("attempted"), F.count("yi").alias("finite"),
        F.count_if(F.abs("raw_r") >= 0.95).alias("r_near_1"), F.count_if(F.col("vi") <= 0).alias("zero_variance"),
        F.count_if(F.col("yi") == 0).alias("exact_zero"),
    )


def _usable(effects: DataFrame) -> DataFrame:
    return effects.where(F.col("yi").isNotNull() & (F.col("vi") > 0))


def _sums(effects: DataFrame, keys: Sequence[str], w: Column) -> DataFrame:
    y = F.col("yi")
    return effects.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * y).alias("swy"),
        F.sum(w * y * y).alias("swyy"),
    )


def meta_fixed(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inverse-variance pooling with Q and I2, one map-side combined pass."""
    s = _sums(_usable(effects), keys, 1 / F.col("vi"))
    q = F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"))
    return (
        s.withColumn("est", F.col("swy") / F.col("sw")).withColumn("se", F.sqrt(1 / F.col("sw"))).withColumn("q", q)
        .withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("q")), F.lit(0.0))))
    )


def dl_tau2(k: Column, sw: Column, sw2: Column, q: Column) -> Column:
    """DerSimonian-Laird between-study variance."""
    return F.coalesce(F.greatest(F.lit(0.0), F.try_divide(q - (k - 1), sw - sw2 / sw)), F.lit(0.0))


def meta_dl(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Random effects with the DerSimonian-Laird tau2 and a z interval."""
    fixed = meta_fixed(effects, keys)
    tau = fixed.select(*keys, "q", "i2", dl_tau2(*[F.col(c) for c in ("k", "sw", "sw2", "q")]).alias("tau2"))
    weighted = _usable(effects).join(tau, list(keys))
    w = 1 / (F.col("vi") + F.col("tau2"))
    out = weighted.groupBy(*keys).agg(
        F.count("*").alias("k"), F.max("tau2").alias("tau2"), F.max("q").alias("q"), F.max("i2").alias("i2"),
        F.sum(w).alias("_sw"), F.sum(w * F.col("yi")).alias("_swy"),
    )
    est, se = F.col("_swy") / F.col("_sw"), F.sqrt(1 / F.col("_sw"))
    return out.select(
        *keys, "k", "tau2", "q", "i2", est.alias("est"), se.alias("se"), (est / se).alias("z"),
        (est - S.Z95 * se).alias("lo"), (est + S.Z95 * se).alias("hi"),
    )


def _reml_tau2(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, center, tau2): the REML estimate of each group by multi-section, in a fixed number of aggregations for all groups at once.

    The equation f(t) = sum(w^2 ((y - mu)^2 - v)) / sum(w^2) + 1 / sum(w) - t with w = 1 / (v + t) is evaluated at ``SECTIONS``
    points of each group's bracket, and the part with the first change from above zero is the next bracket. No root lies
    above 2 range(y)^2 + max(v). f(0) <= 0 means 0. A group's rows are only summed, whatever their number, after its mean has
    been taken off the values.
    """
    width = F.col("hi") - F.col("lo")
    spread = F.max("yi") - F.min("yi")
    ends = rows.groupBy(*keys).agg(F.avg("yi").alias("center"), F.when(F.count("*") > 1, 2 * spread * spread + F.max("vi")).otherwise(F.lit(0.0)).alias("hi"))
    bracket = ends.withColumn("lo", F.lit(0.0))
    y, w = F.col("yi") - F.col("center"), 1 / (F.col("vi") + F.col("t"))
    for _ in range(SEARCH_STEPS):
        points = null_safe_join(rows, bracket, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS - 1))))
        points = points.withColumn("t", F.col("lo") + width * F.col("i") / SECTIONS)
        sums = points.groupBy(*keys, "i").agg(
            F.first("center").alias("center"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("t").alias("t"),
            F.sum(w).alias("a"), F.sum(w * y).alias("b"), F.sum(w * w).alias("c"), F.sum(w * w * y).alias("d"), F.sum(w * w * (y * y - F.col("vi"))).alias("e"),
        )
        mu = F.col("b") / F.col("a")
        f = (F.col("e") - 2 * mu * F.col("d") + mu * mu * F.col("c")) / F.col("c") + 1 / F.col("a") - F.col("t")
        first = sums.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("center", "lo", "hi")], F.min(F.when(f <= 0, F.col("i"))).alias("j"))
        at = lambda j: F.col("lo") + width * j / SECTIONS
        low = F.when(F.col("j").isNull(), at(F.lit(SECTIONS - 1))).when(F.col("j") == 0, F.col("lo")).otherwise(at(F.col("j") - 1))
        high = F.when(F.col("j").isNull(), F.col("hi")).when(F.col("j") == 0, F.col("lo")).otherwise(at(F.col("j")))
        bracket = cut_lineage(first.select(*keys, "center", low.alias("lo"), high.alias("hi")))
    return bracket.select(*keys, "center", ((F.col("lo") + F.col("hi")) / 2).alias("tau2"))


def meta_reml(effects: DataFrame, keys: Sequence[str], tails: bool = True) -> DataFrame:
    """REML tau2 with the Hartung-Knapp interval, never narrower than the unadjusted one. k = 1 is not pooled."""
    usable = cut_lineage(_usable(effects).select(*keys, "yi", "vi"))
    tau = _reml_tau2(usable, keys)
    w = 1 / (F.col("vi") + F.col("tau2"))
    y = F.col("yi") - F.col("center")
    s = null_safe_join(usable, tau, keys).groupBy(*keys).agg(
        F.count("*").alias("k"), F.max("tau2").alias("tau2"), F.max("center").alias("_c"), F.sum(w).alias("_sw"), F.sum(w * y).alias("_swy"),
        F.sum(w * y * y).alias("_swyy"),
    )
    off = F.col("_swy") / F.col("_sw")
    est = F.col("_c") + off
    qw = F.greatest(F.lit(0.0), F.col("_swyy") - F.col("_swy") * off)
    hk = F.try_divide(qw, (F.col("k") - 1) * F.col("_sw"))
    se = F.sqrt(F.greatest(hk, 1 / F.col("_sw")))
    pooled = F.col("k") > 1
    out = s.select(
        *keys, "k", F.when(pooled, F.col("tau2")).alias("tau2"), F.when(pooled, est).alias("est"),
        F.when(pooled, se).alias("se"), F.when(pooled, est / se).alias("t"),
        F.when(pooled, "pooled").otherwise("not_applicable").alias("status"),
    )
    if not tails:
        return out
    df = F.when(pooled, F.col("k") - 1).cast("double")
    crit, wide = t975(df), t975(F.when(F.col("k") > 2, F.col("k") - 2).cast("double"))
    spread = F.sqrt(F.col("tau2") + F.col("se") * F.col("se"))
    return (
        out.withColumn("p", p_from_t(F.col("t"), df)).withColumn("_c", crit).withColumn("_w", wide)
        .withColumn("lo", F.col("est") - F.col("_c") * F.col("se")).withColumn("hi", F.col("est") + F.col("_c") * F.col("se"))
        .withColumn("pi_lo", F.col("est") - F.col("_w") * spread).withColumn("pi_hi", F.col("est") + F.col("_w") * spread)
        .drop("_c", "_w")
    )


def with_z_p(df: DataFrame, z: str = "z") -> DataFrame:
    return df.withColumn("p", p_from_z(z))


def meta_by_design(effects: DataFrame, keys: Sequence[str], design: str) -> DataFrame:
    """Joint and per-design pooling side by side: every estimate enters once as itself and once as joint."""
    both = effects.withColumn("layer", F.explode(F.array(F.lit("joint"), F.col(design))))
    return meta_fixed(both, [*keys, "layer"])


def meta_leave_one_out(effects: DataFrame, keys: Sequence[str], cohort: str) -> DataFrame:
    """Pooled value without each cohort: the group's sums minus the cohort's own.

    No pair of cohorts is formed. Fewer than two left is not estimable.
    """
    usable = _usable(effects)
    totals = _sums(usable, keys, 1 / F.col("vi"))
    w = 1 / F.col("vi")
    j = usable.join(totals, list(keys))
    k, sw = F.col("k") - 1, F.col("sw") - w
    swy, swyy, sw2 = F.col("swy") - w * F.col("yi"), F.col("swyy") - w * F.col("yi") * F.col("yi"), F.col("sw2") - w * w
    q = F.greatest(F.lit(0.0), swyy - F.try_divide(swy * swy, sw))
    ok = k >= 2
    return j.select(
        *keys, F.col(cohort).alias("omitted"), k.alias("k"), F.when(ok, swy / sw).alias("est"),
        F.when(ok, F.sqrt(1 / sw)).alias("se"), F.when(ok, dl_tau2(k, sw, sw2, q)).alias("tau2"),
        F.when(ok, "estimated").otherwise("not_estimable").alias("status"),
    )


def sign_consistency(effects: DataFrame, keys: Sequence[str], cohort: str) -> DataFrame:
    """Per group: k, positive and negative effects, all of one sign, and the one cohort that differs."""
    y = F.col("yi")
    g = effects.where(y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("k"), F.count_if(y > 0).alias("n_pos"), F.count_if(y < 0).alias("n_neg"),
        F.min(F.when(y > 0, F.col(cohort))).alias("_p"), F.min(F.when(y < 0, F.col(cohort))).alias("_n"),
    )
    flips = F.when((F.col("n_pos") == 1) & (F.col("n_neg") > 1), F.col("_p")).when(
        (F.col("n_neg") == 1) & (F.col("n_pos") > 1), F.col("_n"))
    return g.withColumn("consistent", (F.col("n_pos") == F.col("k")) | (F.col("n_neg") == F.col("k"))).withColumn(
        "flips", flips).drop("_p", "_n")


def consistency_summary(signs: DataFrame, min_k: int = 3) -> DataFrame:
    """Share of groups of at least ``min_k`` effects with one sign, with its Wilson interval."""
    s = signs.where(F.col("k") >= min_k).agg(F.count("*").alias("n"), F.count_if("consistent").alias("x"))
    lo, hi = S.wilson(F.col("x"), F.col("n"))
    return s.select("n", "x", lo.alias("lo"), hi.alias("hi"))


def bh_fdr(df: DataFrame, family: Sequence[str], p: str) -> DataFrame:
    """Benjamini-Hochberg within a declared family; tests without P stay outside the family.

    Ranks and the running minimum work on distinct P values in buckets, so one family may hold
    all tests.
    """
    sums = prefix_sums(df, family, p, {"n": F.lit(1).cast("bigint")})
    raw = sums.withColumn("q", F.least(F.lit(1.0), F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n"))))
    adjusted = suffix_min(raw.select(*family, p, "q"), family, p, "q").select(*family, p, F.col("q_suffix").alias("q"))
    return null_safe_join(df, adjusted, [*family, p], "left")


def threshold_ladder(df: DataFrame, thresholds: Sequence[float], measure: str, p: str, alpha: float = 0.05,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Tests and discoveries at each threshold, from one pass."""
    aggs = []
    for i, x in enumerate(thresholds):
        on = F.col(measure) >= x
        aggs += [F.count_if(on).alias(f"_t{i}"), F.count_if(on & (F.col(p) <= alpha)).alias(f"_d{i}")]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"_t{i}").alias("tests"), F.col(f"_d{i}").alias("discoveries"))
                     for i, x in enumerate(thresholds)])
    return wide.select(*keys, F.inline(rows))


def attenuation(base: DataFrame, adjusted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """|adjusted| / |base| per state on the same sample."""
    a = base.select(*keys, F.col("yi").alias("base"))
    b = adjusted.select(*keys, F.col("yi").alias("adjusted"))
    return a.join(b, list(keys)).withColumn("ratio", F.try_divide(F.abs("adjusted"), F.abs("base")))


def median_attenuation(ratios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States with a ratio and the exact median of their ratios; a group without any has the count 0 and no median."""
    ratios = cut_lineage(ratios.select(*keys, "ratio"))
    median = exact_quantiles(ratios, keys, F.col("ratio"), [0.5]).select(*keys, F.col("quantile").alias("median_ratio"))
    return null_safe_join(ratios.groupBy(*keys).agg(F.count("ratio").alias("n")), median, keys, "left")
