"""Comparisons of texts and tables across versions and renderings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import text as X
from sparkaudit.functions.stats import safe_corr
from sparkaudit.operators.ordered import average_ranks, null_safe_join


def _normal_sentences(docs: DataFrame, doc_id: str, text: str, min_len: int) -> DataFrame:
    parts = F.transform(X.sentences(X.flatten_ws(F.translate(text, "|#*", "   ")), ".;:"), lambda s: F.trim(s))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.explode(F.filter(parts, lambda s: F.length(s) > min_len)).alias("sentence")
    ).withColumn("_n", F.lower("sentence"))


def _minimisers(text: str, window: int, gram: int):
    """For ``mapInArrow``: rows of ``text`` with ``fp``, the least gram hash of each of its windows, each once.

    A window that occurs in two texts has the same grams in both, so it has the same least hash. Only about two of
    window - gram grams are least somewhere. The hash need not be good: what meets by it is compared as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            column = batch.column(text)
            chars = ["" if v is None else v for v in column.to_pylist()]
            codes = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            sizes = np.array([len(c) for c in chars], np.int64)
            if len(codes) < window:
                continue
            hashes = np.zeros(len(codes) - gram + 1, np.uint64)
            with np.errstate(over="ignore"):
                for i in range(gram):
                    hashes = (hashes ^ (hashes >> np.uint64(29))) * factor + codes[i : i + len(hashes)]
                hashes = (hashes ^ (hashes >> np.uint64(32))) * factor
            width, least, span = window - gram + 1, hashes, 1
            while span < width:  # minimum over runs, doubled as far as it goes
                step = min(span, width - span)
                least = np.minimum(least[: len(least) - step], least[step:])
                span += step
            windows = np.maximum(sizes - window + 1, 0)
            row = np.repeat(np.arange(len(sizes)), windows)
            start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            found = least[start + (np.cumsum(sizes) - sizes)[row]]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            yield pa.RecordBatch.from_arrays([column.take(pa.array(row[new])), pa.array(found[new].view(np.int64))], [text, "fp"])

    return run


def sentence_diff(a: DataFrame, b: DataFrame, min_len: int = 60, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of A whose first ``min_len`` characters occur inside no sentence of B.

    Containment without pairing sentences and without a row for each character window: both sides are winnowed, so a prefix has
    one fingerprint and a sentence of B about one for each quarter of ``min_len``. They meet in one equi join and are confirmed on the text.
    """
    left = _normal_sentences(a, doc_id, text, min_len).withColumn("_p", F.substring("_n", 1, min_len))
    right = _normal_sentences(b, doc_id, text, min_len - 1).select("_n").distinct()
    gram = max(1, min_len // 2)
    prefixes = left.select("_p").distinct().mapInArrow(_minimisers("_p", min_len, gram), "_p string, fp bigint")
    inside = right.mapInArrow(_minimisers("_n", min_len, gram), "_n string, fp bigint")
    found = inside.join(prefixes, "fp").where(F.contains("_n", "_p")).select("_p").distinct()
    return left.join(found, "_p", "left_anti").select("doc_id", "sentence")


def paragraph_changes(prev: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (document, paragraph content): equal, moved, insert or delete, with counts.

    Both inputs are (keys, para_no, text). Repeats of one paragraph are counted, not numbered, so a
    paragraph that fills a third of the corpus is a single row after the map-side combine.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys, F.sha2("text", 256).alias("hash")).agg(
            F.count("*").alias(f"n_{tag}"), F.min("para_no").alias(f"pos_{tag}")
        )

    both = side(prev, "prev").join(side(cur, "cur"), [*keys, "hash"], "full_outer")
    p, c = F.coalesce("n_prev", F.lit(0)), F.coalesce("n_cur", F.lit(0))
    status = (
        F.when(p == 0, "insert").when(c == 0, "delete").when(p != c, "count_changed")
        .when(F.col("pos_prev") != F.col("pos_cur"), "moved").otherwise("equal")
    )
    return both.select(*keys, "hash", p.alias("n_prev"), c.alias("n_cur"), status.alias("status"))


def texts_identical(a: DataFrame, b: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Per key: are the paragraph lists the same in content and order? One hash per text."""
    x = a.select(*keys, F.sha2(text, 256).alias("_a"))
    y = b.select(*keys, F.sha2(text, 256).alias("_b"))
    return x.join(y, list(keys), "full_outer").select(*keys, F.col("_a").eqNullSafe(F.col("_b")).alias("identical"))


def phrase_parity(a: DataFrame, b: DataFrame, key: str, phrases: Sequence[str], text: str = "text") -> DataFrame:
    """Phrase counts that differ between two renderings of a document."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(key, *[X.count_literal(F.col(text), p).alias(f"_{tag}{i}") for i, p in enumerate(phrases)])

    rows = F.array(
        *[F.struct(F.lit(p).alias("phrase"), F.col(f"_a{i}").alias("n_a"), F.col(f"_b{i}").alias("n_b"))
          for i, p in enumerate(phrases)]
    )
    return side(a, "a").join(side(b, "b"), key).select(key, F.inline(rows)).where(F.col("n_a") != F.col("n_b"))


def anchor_presence(docs: DataFrame, anchors: Mapping[str, int | None], key: str, text: str = "text") -> DataFrame:
    """Anchors that a document lacks (expected None) or holds another number of times than expected."""
    rows = F.array(
        *[F.struct(F.lit(a).alias("anchor"), X.count_literal(F.col(text), a).alias("n"),
                   F.lit(n).cast("bigint").alias("expected")) for a, n in anchors.items()]
    )
    wrong = F.when(F.col("expected").isNull(), F.col("n") == 0).otherwise(F.col("n") != F.col("expected"))
    return docs.select(key, F.inline(rows)).where(wrong)


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Matched cells, unmatched cells, largest difference, cells within tolerance."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    y = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    d = F.abs(F.col("_a") - F.col("_b"))
    both = F.col("_ina") & F.col("_inb")
    return x.join(y, list(keys), "full_outer").agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(F.col("_inb").isNull()).alias("only_a"),
        F.count_if(F.col("_ina").isNull()).alias("only_b"),
        F.max(d).alias("max_abs_diff"),
        F.count_if(d <= tol).alias("within_tol"),
    )


def rank_agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation with average ranks; rank and absolute agreement are separate results."""
    ra = average_ranks(df, keys, a).select(*keys, a, F.col("avg_rank").alias("_ra"))
    rb = average_ranks(df, keys, b).select(*keys, b, F.col("avg_rank").alias("_rb"))
    ranked = null_safe_join(null_safe_join(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), ra, [*keys, a]), rb, [*keys, b])
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(F.col("_ra"), F.col("_rb")).alias("spearman"))


def affine_equivalent(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), tol: float = 1e-9) -> DataFrame:
    """Is b = k*a + c exact? Slope, intercept and largest residual.

    The line comes from two extreme points, so an exact relation leaves no residual but rounding.
    """
    ends = df.groupBy(*keys).agg(
        F.min(F.struct(F.col(a), F.col(b))).alias("_lo"), F.max(F.struct(F.col(a), F.col(b))).alias("_hi")
    )
    run = F.col(f"_hi.{a}") - F.col(f"_lo.{a}")
    slope = F.try_divide(F.col(f"_hi.{b}") - F.col(f"_lo.{b}"), run)
    line = ends.select(*keys, slope.alias("slope"), (F.col(f"_lo.{b}") - slope * F.col(f"_lo.{a}")).alias("intercept"))
    if keys:
        joined = null_safe_join(df, line, keys)
    else:
        # One row for the whole table: a scalar subquery, so the data rows are not shuffled.
        one = line.select(F.struct("slope", "intercept")).scalar()
        joined = df.withColumn("_line", one).select(*df.columns, "_line.slope", "_line.intercept")
    resid = F.abs(F.col(b) - (F.col("slope") * F.col(a) + F.col("intercept")))
    out = joined.groupBy(*keys).agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.max(resid).alias("max_residual")
    )
    return out.withColumn("equivalent", F.col("max_residual") <= tol)
