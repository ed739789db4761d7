"""Validation of predictions: survival, discrimination, calibration, net benefit, reclassification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions.draws import uniform
from sparkaudit.functions.tails import p_from_t
from sparkaudit.operators.ordered import prefix_sums
from sparkaudit.operators.ranktests import auc
from sparkaudit.operators.sequence import quantile_groups


def brier(df: DataFrame, keys: Sequence[str], outcome: str, direct: Column, updated: Column | None = None) -> DataFrame:
    """Mean squared error among rows of known status; with two predictions the paired difference updated - direct."""
    y = F.col(outcome)
    known = df.where(y.isNotNull())
    sq = lambda p: (p - y) * (p - y)
    aggs = [F.count("*").alias("n"), F.avg(sq(direct)).alias("brier")]
    if updated is not None:
        aggs += [F.avg(sq(updated)).alias("brier_updated"), F.avg(sq(updated) - sq(direct)).alias("delta")]
    return known.groupBy(*keys).agg(*aggs)


def horizon_status(time: Column, event: Column, horizon: float) -> Column:
    """1 = event by the horizon, 0 = followed to the horizon without one, NULL = unknown."""
    return F.when((event == 1) & (time <= horizon), 1).when(time >= horizon, 0)


def horizon_auc(df: DataFrame, keys: Sequence[str], time: str, event: str, risk: str, horizon: float) -> DataFrame:
    """Cumulative/dynamic AUC among known status; the excluded rows are counted."""
    d = df.withColumn("_y", horizon_status(F.col(time), F.col(event), horizon))
    n = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_y").isNull()).alias("n_excluded"))
    a = auc(d, keys, risk, F.col("_y") == 1)
    if keys:
        return a.join(n, list(keys))
    return a.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one").drop("_one")


def kaplan_meier(df: DataFrame, keys: Sequence[str], time: str, event: Column) -> DataFrame:
    """(keys, time, at_risk, events, survival) at every distinct time.

    The risk set is a suffix count and the product a prefix sum of logs, both bucketed. A step where
    everyone at risk has the event makes the rest zero. With ``event`` negated this is the
    censoring curve.
    """
    one = F.lit(1).cast("bigint")
    c = prefix_sums(df, keys, time, {"n": one, "d": F.when(event, 1).otherwise(0).cast("bigint")})
    c = c.select(*keys, time, (F.col("n_total") - F.col("n_before")).alias("at_risk"), F.col("d").alias("events"))
    dead = F.when(F.col("events") == F.col("at_risk"), 1).otherwise(0).cast("bigint")
    log = F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(0.0))
    p = prefix_sums(c, keys, time, {"lg": log, "z": dead, "at_risk": F.col("at_risk"), "events": F.col("events")})
    survival = F.when(F.col("z_before") + F.col("z") > 0, F.lit(0.0)).otherwise(F.exp(F.col("lg_before") + F.col("lg")))
    return p.select(*keys, time, "at_risk", "events", survival.alias("survival"))


def survival_at(curve: DataFrame, keys: Sequence[str], time: str, at: float) -> DataFrame:
    """Step lookup: the survival of the last time at or before ``at``."""
    return curve.where(F.col(time) <= at).groupBy(*keys).agg(F.max_by("survival", time).alias("survival"))


def calibration_table(df: DataFrame, keys: Sequence[str], pred: str, outcome: str, groups: int = 10) -> DataFrame:
    """Mean prediction against observed rate by rank group, with O:E and the difference."""
    g = quantile_groups(df, keys, pred, groups)
    out = g.groupBy(*keys, "group").agg(
        F.count("*").alias("n"), F.avg(pred).alias("predicted"), F.avg(F.col(outcome).cast("double")).alias("observed"))
    return out.withColumn("oe", F.try_divide(F.col("observed"), F.col("predicted"))).withColumn("diff", F.col("observed") - F.col("predicted"))


def calibration_slope(df: DataFrame, lp: str, outcome: str) -> dict[str, float]:
    """Logistic recalibration on the linear predictor; the ideal is slope 1 and intercept 0."""
    from sparkaudit.operators.survey import fit_logit

    model, _ = fit_logit(df, outcome, [lp])
    return {"slope": float(model.coefficients[0]), "intercept": float(model.intercept)}


def net_benefit(df: DataFrame, keys: Sequence[str], pred: str, outcome: str, thresholds: Sequence[float]) -> DataFrame:
    """Net benefit of the model, of treating all and none, at each threshold. One pass."""
    y = F.col(outcome) == 1
    aggs = [F.count("*").alias("n"), F.avg(y.cast("double")).alias("prevalence")]
    for i, x in enumerate(thresholds):
        pos = F.col(pred) >= x
        aggs += [F.count_if(pos & y).alias(f"_tp{i}"), F.count_if(pos & ~y).alias(f"_fp{i}")]
    wide = df.where(F.col(outcome).isNotNull()).groupBy(*keys).agg(*aggs)
    rows = []
    for i, x in enumerate(thresholds):
        odds = x / (1 - x)
        nb = F.col(f"_tp{i}") / F.col("n") - F.col(f"_fp{i}") / F.col("n") * odds
        al = F.col("prevalence") - (1 - F.col("prevalence")) * odds
        rows.append(F.struct(F.lit(float(x)).alias("threshold"), nb.alias("net_benefit"), al.alias("treat_all"),
                             F.lit(0.0).alias("treat_none"), (nb <= F.col("prevalence") + 1e-12).alias("possible")))
    return wide.select(*keys, "n", "prevalence", F.inline(F.array(*rows)))


def reclassification(df: DataFrame, keys: Sequence[str], outcome: str, old: Column, new: Column) -> DataFrame:
    """IDI and continuous NRI in one known-status sample."""
    case = F.col(outcome) == 1
    up, down = (new > old).cast("double"), (new < old).cast("double")
    on = lambda c: F.avg(F.when(case, c))
    off = lambda c: F.avg(F.when(~case, c))
    d = new - old
    return df.where(F.col(outcome).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), (on(d) - off(d)).alias("idi"),
        ((on(up) - on(down)) + (off(down) - off(up))).alias("nri"))


def grouped_folds(df: DataFrame, unit: Column, k: int, seed: int = 1) -> DataFrame:
    """Add ``fold`` 0..k-1; all rows of a unit share it, whatever the partitioning."""
    return df.withColumn("fold", F.least(F.floor(uniform(seed, unit) * k), F.lit(k - 1)).cast("bigint"))


def fold_report(df: DataFrame, outcome: str) -> DataFrame:
    """n and events per fold; a fold without both outcomes is degenerate."""
    e = F.sum(F.col(outcome))
    return df.groupBy("fold").agg(F.count("*").alias("n"), e.cast("bigint").alias("events")).withColumn(
        "degenerate", (F.col("events") == 0) | (F.col("events") == F.col("n")))


def paired_fold_test(folds: DataFrame, a: str, b: str, keys: Sequence[str] = (), tails: bool = True) -> DataFrame:
    """Paired t over folds: one row per fold with both models' scores."""
    d = F.col(a) - F.col(b)
    s = folds.groupBy(*keys).agg(F.count(d).alias("k"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    s = s.withColumn("t", F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("k")))
    return s.withColumn("p", p_from_t("t", (F.col("k") - 1).cast("double"))) if tails else s


def overprediction_split(source: Column, source_lp_target_baseline: Column, observed: Column) -> Mapping[str, Column]:
    """Shares of the gap between predicted and observed risk: baseline risk and case mix."""
    gap = source - observed
    return {
        "gap": gap,
        "baseline_share": F.try_divide(source - source_lp_target_baseline, gap),
        "case_mix_share": F.try_divide(source_lp_target_baseline - observed, gap),
    }
