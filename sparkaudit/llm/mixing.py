"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight and gets that share of all words, at most ``MOST_COPIES`` times its own words; what a source
cannot take is shared anew by weight. A source's rate is its target over its words: each of its documents is taken
floor(rate) times for certain, and the rest of the target is a fixed-size sample. For it documents are ranked by the Pareto
statistic u / (1 - u) over p / (1 - p), u being a reproducible draw and p / (1 - p) the inclusion odds (the fractional part
of the rate; ``odds`` multiplies them by document), and taken in that order while their words fit. One last document, of
those that were not taken the one whose size is nearest to the gap, closes it if that leaves less than the smallest of them.
Where a document too large for the rest ended the order early, so that the gap still holds others, the order is gone on with
instead, skipping what does not fit, until no document that is left fits. ``mix`` and ``mixed`` draw alike.

Nothing orders a whole source: ranks fall into 65,536 steps, words are summed by (source, step), and only the documents
of the one step in which the target is reached are ordered among each other. Tables with a row for each source are
the only ones sent to all tasks, by the planner's own choice of size. Sizes are counted once and written.

Defined results: a NULL text has size 0; a NULL source is a source, the last; a NULL doc_id draws like an id of its own,
its ties are ordered by size; rows alike in id and size share their draw and so their fate; no words at all: every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.functions.draws import uniform
from sparkaudit.llm.common import same_keys
from sparkaudit.session import cut_lineage

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
STEPS = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target). Sharing anew until no target is above its limit is filling all sources to one level
    per weight: sources in order of limit per weight, the first whose own level stays under its limit fixes it (later levels are lower)."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.asc_nulls_last("source"))  # one row for each source
    ranked = by_source.withColumn("nth", F.row_number().over(everything)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    limit = F.col("source_size") * MOST_COPIES
    order = Window.orderBy(limit / F.col("weight"), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("level", level).withColumn("fixes", F.when(F.col("level") <= limit / F.col("weight"), F.col("level")))
    filled_to = F.max("fixes").over(whole)
    return filled.select("source", "source_size", F.least(limit.cast("double"), F.coalesce(filled_to, F.lit(0.0)) * F.col("weight")).alias("target"))


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, odds: Column | None = None) -> DataFrame:
    """``sized`` (doc_id, source, size) with source_size, target and ``copies``, how often the mix takes the document.

    What a source's words lack of its target is less than any of its documents that is not taken once more.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = cut_lineage(
        targets(sized, weights)
        .withColumn("certain", F.floor(rate))
        .withColumn("p", rate - F.col("certain"))
        .withColumn("left", F.col("target") - F.col("certain") * F.col("source_size"))
    )
    u = uniform("mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    given = F.col("p") / (1 - F.col("p")) * (odds if odds is not None else F.lit(1.0))
    q = u / (1 - u) / given
    drawn = same_keys(sized, shares, ["source"]).withColumn("k", F.when(F.col("p") > 0, q / (1 + q)))
    drawn = drawn.withColumn("step", F.floor(F.col("k") * STEPS)).withColumn("at", F.struct("k", "doc_id", "size"))
    candidates = drawn.where("p > 0 AND size > 0")

    by_step = candidates.groupBy("source", "step").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    reached = by_step.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).where("before <= left AND left < before + words")
    border = cut_lineage(reached.select("source", "step", "before"))
    inside = same_keys(candidates, border, ["source", "step"])
    running = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("sum", F.col("before") + F.sum("size").over(running)).where("sum <= left")
    last = fits.groupBy("source").agg(F.max("at").alias("last"), F.max("sum").alias("taken"))
    cut = cut_lineage(
        same_keys(border, last, ["source"], "left").select("source", F.col("step").alias("border"), "last", F.coalesce("taken", "before").alias("taken"))
    )

    # a source without a border has p = 0 or takes every candidate
    known = same_keys(drawn, cut, ["source"], "left")
    chosen = F.coalesce(
        F.when(F.col("p") <= 0, F.lit(False)).when(F.col("border").isNull(), F.lit(True)).otherwise((F.col("step") < F.col("border")) | (F.col("step") == F.col("border")) & (F.col("at") <= F.col("last"))),
        F.lit(False),
    )
    marked = known.withColumn("chosen", chosen)
    gap = F.col("left") - F.col("taken")
    closing = (
        marked.where("NOT chosen AND p > 0 AND size > 0")
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "at")).alias("best"), F.first(gap).alias("gap"), F.min("size").alias("least"))
        .where("best.off < gap AND best.off < least")
    )
    closing = cut_lineage(closing.select("source", F.col("best.at").alias("closes")))
    closed = same_keys(marked, closing, ["source"], "left")
    once = closed.withColumn("chosen", F.col("chosen") | F.coalesce(F.col("at") == F.col("closes"), F.lit(False)))
    once = once.drop("border", "last", "taken", "closes")
    later = _further(once.where("p > 0 AND size > 0"))
    if later is not None:
        once = same_keys(once, later, ["source"], "left")
        once = once.withColumn("chosen", F.col("chosen") | ((F.col("p") > 0) & (F.col("size") > 0) & F.coalesce(_taken_in(F.col("turns")), F.lit(False))))
    return once.select("doc_id", "source", "size", "source_size", "target", (F.col("certain") + F.col("chosen").cast("bigint")).cast("bigint").alias("copies"))


def _taken_in(turns: Column) -> Column:
    """Whether one of the turns (gap, after, last) takes the row: it lies in that part of the order and fits."""
    inside = lambda t: (F.col("size") <= t["gap"]) & (t["after"].isNull() | (F.col("at") > t["after"])) & (F.col("at") <= t["last"])
    return F.exists(turns, inside)


def _further(rows: DataFrame) -> DataFrame | None:
    """(source, turns) of the sources whose gap still holds a document; None if there is none.

    A turn goes down the order over the documents that are not larger than the gap, to the first whose words do not fit any more;
    the next turn goes on after that one with what the gap then is. Rows alike in ``at`` are taken together or not at all.
    """
    gaps = rows.groupBy("source").agg((F.first("left") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0))).alias("gap"), F.min(F.when(~F.col("chosen"), F.col("size"))).alias("least"))
    state = cut_lineage(gaps.where("least <= gap").select("source", "gap"))
    if state.isEmpty():
        return None
    rows = cut_lineage(same_keys(rows.where("NOT chosen"), state, ["source"]).where("size <= gap").select("source", "step", "at", "size"))
    at, gap = rows.schema["at"].dataType.simpleString(), state.schema["gap"].dataType.simpleString()
    none = F.lit(None).cast(at)
    state = state.withColumn("after", none).withColumn("turns", F.array().cast(f"array<struct<gap:{gap},after:{at},last:{at}>>"))
    finished = None
    while True:
        rest = same_keys(rows, state.select("source", "gap", "after"), ["source"]).where("size <= gap AND (after IS NULL OR at > after)")
        by_step = rest.groupBy("source", "step").agg(F.sum("size").alias("words"), F.max("at").alias("end"), F.first("gap").alias("gap"))
        upto = Window.partitionBy("source").orderBy("step")
        sums = by_step.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
        sums = cut_lineage(sums.where("before <= gap"))
        border = sums.where("upto > gap").select("source", "step", "before")
        units = same_keys(rest, border, ["source", "step"]).groupBy("source", "at").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("gap").alias("gap"))
        running = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        units = units.withColumn("upto", F.col("before") + F.sum("words").over(running)).select("source", "at", "upto", "gap")
        whole = sums.where("upto <= gap").select("source", F.col("end").alias("at"), "upto", "gap")
        fits = F.col("upto") <= F.col("gap")
        turn = units.unionByName(whole).groupBy("source").agg(
            F.max(F.when(fits, F.col("at"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("used"), F.min(F.when(~fits, F.col("at"))).alias("stop")
        )
        known = same_keys(state, turn, ["source"], "left")
        taken = F.when(F.col("last").isNotNull(), F.array(F.struct("gap", "after", "last"))).otherwise(F.array().cast(f"array<struct<gap:{gap},after:{at},last:{at}>>"))
        state = cut_lineage(
            known.select("source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"), F.col("stop").alias("after"), F.concat("turns", taken).alias("turns"))
        )
        ended = state.where("after IS NULL").select("source", "turns")
        finished = ended if finished is None else finished.unionByName(ended)
        state = state.where("after IS NOT NULL")
        if state.isEmpty():
            return cut_lineage(finished)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs`` (doc_id, text, source)."""
    return copies(cut_lineage(sizes(docs))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken. All columns stay."""
    often = copies(cut_lineage(sizes(docs)))
    key = [F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")]
    often = often.where("copies > 0").select(*key).distinct()
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    same = docs["doc_id"].eqNullSafe(often["__id"]) & docs["source"].eqNullSafe(often["__source"]) & (size == often["__size"])
    met = docs.join(often, same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
    return met.drop("__id", "__source", "__size", "__copies", "__copy")
