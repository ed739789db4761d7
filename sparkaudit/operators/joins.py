"""Reference checks between relations.

Anti joins run on distinct keys, so a key that holds a third of all rows costs one row on each side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import text as X


def dangling_refs(
    cites: DataFrame, refs: DataFrame, cite_keys: Sequence[str], ref_keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Cited keys that are not listed, with the number of citations, by document or other columns."""
    cited = cites.groupBy(*by, *cite_keys).agg(F.count("*").alias("n_cites"))
    listed = refs.select(*[F.col(r).alias(c) for c, r in zip(cite_keys, ref_keys)]).distinct()
    return cited.join(listed, list(cite_keys), "left_anti")


def uncited_refs(refs: DataFrame, cites: DataFrame, ref_keys: Sequence[str], cite_keys: Sequence[str]) -> DataFrame:
    """Listed keys that are never cited."""
    cited = cites.select(*[F.col(c).alias(r) for c, r in zip(cite_keys, ref_keys)]).distinct()
    return refs.join(cited, list(ref_keys), "left_anti")


def declared_vs_measured(declared: DataFrame, measured: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose declared number is not the recomputed one (a missing side counts as different)."""
    d = declared.select(*keys, F.col(value).alias("declared"))
    m = measured.select(*keys, F.col(value).alias("measured"))
    return d.join(m, list(keys), "full_outer").where(~F.col("declared").eqNullSafe(F.col("measured")))


def unchanged_artifacts(previous: DataFrame, current: DataFrame, changed: DataFrame) -> DataFrame:
    """Artifacts with the same hash in both versions although a value they show has changed."""
    p = previous.select("name", F.col("sha256").alias("_old"))
    same = current.join(p, "name").where(F.col("sha256") == F.col("_old")).drop("_old")
    return same.join(changed.select("name").distinct(), "name", "left_semi")


def join_by_url(left: DataFrame, left_url: str, right: DataFrame, right_url: str) -> DataFrame:
    """Equi join on the normalised address."""
    a = left.withColumn("_url", X.normalize_url(F.col(left_url)))
    b = right.withColumn("_url", X.normalize_url(F.col(right_url)))
    return a.join(b, "_url")


def id_join_report(left: DataFrame, right: DataFrame, key: str, min_keep: float = 0.9) -> DataFrame:
    """Rows, matched rows and retained share of an id join; FAIL below the threshold.

    The check counts keys on both sides first, so it never builds the joined rows.
    """
    a = left.groupBy(key).agg(F.count("*").alias("_n"))
    b = right.select(key).distinct().withColumn("_hit", F.lit(1))
    share = F.col("n_matched") / F.col("n_left")
    return (
        a.join(b, key, "left")
        .agg(
            F.sum("_n").alias("n_left"),
            F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("n_matched"),
            F.count_if(F.col("_hit").isNull()).alias("n_lost_ids"),
        )
        .withColumn("kept", share)
        .withColumn("status", F.when(share >= min_keep, "PASS").otherwise("FAIL"))
    )


def id_join(left: DataFrame, right: DataFrame, key: str, min_keep: float = 0.9) -> DataFrame:
    """Join by id; raises when the retained share is below the threshold."""
    report = id_join_report(left, right, key, min_keep).first()
    if report["status"] == "FAIL":
        raise ValueError(f"id join kept {report['kept']:.3f} of {report['n_left']} rows, below {min_keep}")
    return left.join(right, key)


def paired_rows(
    df: DataFrame, unit: Sequence[str], arm: str, case: object, control: object, value: Column
) -> DataFrame:
    """One row per unit present in both arms: (y_case, y_control).

    Two conditional averages replace the self join; row order plays no part.
    """
    return (
        df.where(F.col(arm).isin(case, control))
        .groupBy(*unit)
        .agg(
            F.avg(F.when(F.col(arm) == case, value)).alias("y_case"),
            F.avg(F.when(F.col(arm) == control, value)).alias("y_control"),
        )
        .where(F.col("y_case").isNotNull() & F.col("y_control").isNotNull())
    )


def profiled_status(samples: DataFrame, profiled: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """positive / negative / not_assayed. Negative only inside the profiled list."""
    p = profiled.select(key).distinct().withColumn("_p", F.lit(True))
    e = events.select(key).distinct().withColumn("_e", F.lit(True))
    status = (
        F.when(F.col("_p").isNull(), "not_assayed").when(F.col("_e").isNotNull(), "positive").otherwise("negative")
    )
    return samples.join(p, key, "left").join(e, key, "left").withColumn("status", status).drop("_p", "_e")


def exactly_one(queries: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that do not hit exactly one row of the table, with the number of hits."""
    hits = table.groupBy(*keys).agg(F.count("*").alias("hits"))
    wanted = queries.select(*keys).distinct()
    return (
        wanted.join(hits, list(keys), "left")
        .withColumn("hits", F.coalesce("hits", F.lit(0)))
        .where(F.col("hits") != 1)
    )


def orphan_numbers(
    docs: DataFrame, outputs: DataFrame, value: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Decimals of the text that no result value equals, as text or as a number."""
    stated = docs.select(
        F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(X.all_matches(F.col(text), X.DECIMAL))).alias("num")
    ).withColumn("_v", F.col("num").cast("double"))
    known = outputs.select(F.col(value).cast("double").alias("_v")).distinct()
    distinct_numbers = stated.select("_v").distinct().join(known, "_v", "left_anti")
    return stated.join(distinct_numbers, "_v", "left_semi").select("doc_id", "num")


def overlapping_boxes(
    boxes: DataFrame, page_keys: Sequence[str], ratio: float = 0.45, min_side: float = 2.0, cell: float = 100.0
) -> DataFrame:
    """Pairs of boxes of a page whose common area exceeds ``ratio`` of the smaller one.

    Every box is listed in the grid cells it touches and pairs meet inside one cell only. A pair
    that shares several cells is reported from the cell of its common lower corner, so no distinct
    is needed. The cell should be near the largest box side.
    """
    cells = boxes.select(
        *page_keys, "box_no", "x0", "y0", "x1", "y1",
        F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))).alias("_cx"),
    ).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    a = cells.alias("a")
    b = cells.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*page_keys, "_cx", "_cy"]]
    condition = F.col("a.box_no") < F.col("b.box_no")
    for term in same:
        condition = condition & term
    left, top = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    width = F.least("a.x1", "b.x1") - left
    height = F.least("a.y1", "b.y1") - top
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    common = width * height
    return (
        a.join(b, condition)
        .where((width > min_side) & (height > min_side) & (common > ratio * F.least(area("a"), area("b"))))
        .where((F.floor(left / cell) == F.col("a._cx")) & (F.floor(top / cell) == F.col("a._cy")))
        .select(*[F.col(f"a.{k}").alias(k) for k in page_keys], F.col("a.box_no").alias("box_a"),
                F.col("b.box_no").alias("box_b"), common.alias("common_area"))
    )


def boxes_out_of_bounds(boxes: DataFrame, pages: DataFrame, page_keys: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Boxes beyond, or within ``tol`` of, the page edge. ``pages`` has width and height."""
    edge = (
        (F.col("x0") < tol) | (F.col("y0") < tol) | (F.col("x1") > F.col("width") - tol) | (F.col("y1") > F.col("height") - tol)
    )
    return boxes.join(pages, list(page_keys)).where(edge).select(*page_keys, "box_no")


def neighbours(df: DataFrame, keys: Sequence[str], order: str, reach: int) -> DataFrame:
    """Pairs of rows at most ``reach`` positions apart, by equi join on position blocks (no all-pairs)."""
    block = F.floor(F.col(order) / reach)
    a = df.withColumn("_k", block)
    b = df.withColumn("_k", F.explode(F.array(block, block - 1)))
    cond = (F.col("a._k") == F.col("b._k")) & (F.col(f"b.{order}") > F.col(f"a.{order}")) & (
        F.col(f"b.{order}") - F.col(f"a.{order}") <= reach
    )
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), cond)


