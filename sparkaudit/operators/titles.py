"""Titles looked up among candidates by their Ratcliff-Obershelp ratio, with products that lose no match.

The ratio of titles of a and b characters is 2 M / (a + b), where M characters match in blocks. Two blocks are parted by an
unmatched character in one title at least, so there are at most a + b - 2 M + 1 blocks, and every block of m characters has
m - 1 bigrams and m - 2 trigrams in both titles. A ratio of r or more therefore leaves M common letters, 3 M - (a + b) - 1
common bigrams (``common_bigrams``) and 5 M - 2 (a + b) - 2 common trigrams or more, with M = ceil(r (a + b) / 2).

Bigrams of a language are too few for an index: most titles share their rarest ones with a good part of all others. So blocks
of candidates are multiplied by blocks of targets, as matrices of hashed runs, and a ratio is computed for what the three counts
leave and a common subsequence allows. All pairs are counted, a million in one product; only titles move between tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.session import cut_lineage

#: A correction notice is never the record that is looked for.
NOTICES = "correction|erratum"
COLUMNS = 1024  # hash columns of a title's runs
BLOCK = 1000  # titles of a block, so that a product of two blocks has a million cells
NEAR = (0.98, 0.95)  # ratios whose pairs meet on segments, before the products
HOT = 200  # candidates of a segment, beyond which the targets that ask for it are left to the products


def common_bigrams(total: int, ratio: float) -> int:
    """Bigrams that two titles of ``total`` characters together share at least, at this ratio or above."""
    return 3 * math.ceil(ratio * total / 2 - 1e-9) - total - 1


def shortest_by_bigrams(ratio: float) -> int:
    """The least length from which on two titles of this length or more share two bigrams or more."""
    if ratio <= 0.7:
        raise ValueError("bigrams bound no ratio of 0.7 or less")
    length = 2
    while any(common_bigrams(total, ratio) < 2 for total in range(2 * length, 2 * length + 200)):
        length += 1
    return length


def _run_counts(titles: Sequence[str], size: int):
    """A row for each title: how many of its numbered runs of ``size`` characters fall into each of ``COLUMNS`` hash columns."""
    import numpy as np

    held = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) for t in titles]
    code = [sum((h[k : len(h) - size + 1 + k] << np.uint64(21 * k) for k in range(size)), np.zeros(max(len(h) - size + 1, 0), np.uint64)) for h in held]
    row = np.repeat(np.arange(len(held)), [len(c) for c in code])
    flat = np.concatenate(code)
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(flat))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    mixed = (flat + nth * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    column = (mixed >> np.uint64(40)).astype(np.int64) % COLUMNS
    return np.bincount(row * COLUMNS + column, minlength=len(held) * COLUMNS).reshape(len(held), COLUMNS).astype(np.float32)


def _places(title: str) -> dict[str, int]:
    """For each character, the places of a title that hold it, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(title):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _in_order(places: dict[str, int], length: int, other: str) -> int:
    """Characters of the longest common subsequence; matching blocks are one, so they hold no more."""
    left = whole = (1 << length) - 1
    for c in other:
        hit = left & places.get(c, 0)
        left = (left + hit) | (left - hit)
    return length - (left & whole).bit_count()


def _close(cand: Sequence[str], goal: Sequence[str], ratio: float) -> list[tuple[str, str, float]]:
    """The pairs of two blocks of titles at ``ratio`` or above. Columns only add to what two titles share, so none is lost."""
    from difflib import SequenceMatcher

    import numpy as np

    la, lb = np.array([len(t) for t in cand])[:, None], np.array([len(t) for t in goal])[None, :]
    total = la + lb
    matched = np.ceil(ratio * total / 2 - 1e-9)
    maybe = (2 * np.minimum(la, lb) >= ratio * total - 1e-9) & (total > 0)
    for size in (1, 2, 3):
        # blocks are total - 2 matched + 1 at most, and each lacks size - 1 runs
        needed = matched - (size - 1) * (total - 2 * matched + 1)
        if maybe.any() and (needed > 0).any():
            maybe &= _run_counts(cand, size) @ _run_counts(goal, size).T >= needed - 0.5
    out = []
    for i in np.nonzero(maybe.any(axis=1))[0]:
        a, places = cand[i], _places(cand[i])
        for j in np.nonzero(maybe[i])[0]:
            if _in_order(places, len(a), goal[j]) >= matched[i, j] and (r := SequenceMatcher(None, a, goal[j]).ratio()) >= ratio:
                out.append((a, goal[j], r))
    return out


def _least(total: int, ratio: float) -> int:
    """Characters that two titles of ``total`` characters together match at least, at this ratio or above."""
    return math.ceil(ratio * total / 2 - 1e-9)


def _partners(length: int, ratio: float) -> list[int]:
    """Lengths of titles that a title of this length can be matched with."""
    return [n for n in range(1, int(length * (2 - ratio) / ratio) + 2) if _least(length + n, ratio) <= min(length, n)]


@cache
def _cuts(length: int, ratio: float) -> tuple[tuple[int, int], ...]:
    """(start, end) of the segments of a title, one more than the unmatched characters of a pair that it may be in."""
    unmatched = max((length + n - 2 * _least(length + n, ratio) for n in _partners(length, ratio)), default=0)
    edges = [length * i // (unmatched + 1) for i in range(unmatched + 2)]
    return tuple(zip(edges, edges[1:], strict=False))


@cache
def _places_asked(length: int, ratio: float) -> tuple[tuple[int, int, int, int], ...]:
    """(length of a candidate, number of its segment, start, end) for all places where a title of ``length`` may hold that segment."""
    out = []
    for n in _partners(length, ratio):
        least = _least(length + n, ratio)
        for i, (start, end) in enumerate(_cuts(n, ratio)):
            # the matched characters ahead of a segment are equally many in both titles
            for at in range(max(0, start - (n - least)), min(length - (end - start), start + length - least) + 1):
                out.append((n, i, at, at + end - start))
    return tuple(out)


def _segments(title: str, ratio: float) -> list[str]:
    """The segments of a candidate, each with the title's length and its number."""
    return [f"{len(title)} {i} {title[x:y]}" for i, (x, y) in enumerate(_cuts(len(title), ratio))]


def _probes(title: str, ratio: float) -> list[str]:
    """The segments that a target can share with a candidate at ``ratio`` or above; it shares at least one with each such candidate."""
    return sorted({f"{n} {i} {title[x:y]}" for n, i, x, y in _places_asked(len(title), ratio)})


def _pair_ratio(a: str, b: str, ratio: float) -> float | None:
    from difflib import SequenceMatcher

    if _in_order(_places(a), len(a), b) < _least(len(a) + len(b), ratio):
        return None
    r = SequenceMatcher(None, a, b).ratio()
    return r if r >= ratio else None


def near_titles(cand: DataFrame, goal: DataFrame, ratio: float) -> DataFrame:
    """(cand_title, target_title, ratio) of the pairs of ``cand`` (title) and ``goal`` (title), each distinct, at ``ratio`` or above.

    A target that asks for a segment of more than ``HOT`` candidates is left out, with all its pairs.
    """
    def keyed(titles, cut, name):
        cuts = F.udf(lambda t: cut(t, ratio), "array<string>", useArrow=False)
        return titles.select(F.col("title").alias(name), F.explode(F.transform(cuts("title"), lambda c: F.xxhash64(c))).alias("_h"))

    posted, asked = keyed(cand, _segments, "cand_title"), keyed(goal, _probes, "target_title")
    hot = cut_lineage(posted.groupBy("_h").count().where(F.col("count") > HOT).select("_h"))
    if not hot.isEmpty():
        left = asked.join(hot, "_h", "left_semi").select("target_title").distinct()
        posted, asked = posted.join(hot, "_h", "left_anti"), asked.join(left, "target_title", "left_anti")
    score = F.udf(lambda a, b: _pair_ratio(a, b, ratio), "double", useArrow=False)
    # The planner takes exploded rows for as few as the titles they come from, and would broadcast them.
    pairs = posted.join(asked.hint("merge"), "_h").select("cand_title", "target_title").distinct()
    return pairs.withColumn("ratio", score("cand_title", "target_title")).where("ratio IS NOT NULL")


def _blocks(titles: DataFrame, name: str) -> DataFrame:
    """Arrays of some ``BLOCK`` titles, dealt by hash."""
    n = -(-titles.count() // BLOCK)
    return cut_lineage(titles.groupBy(F.pmod(F.xxhash64("title"), F.lit(max(n, 1))).alias("_n")).agg(F.collect_list("title").alias(name)).select(name))


def similar_titles(cand: DataFrame, goal: DataFrame, ratio: float) -> DataFrame:
    """(cand_title, target_title, ratio) of all pairs of ``cand`` (title) and ``goal`` (title), each distinct, at ``ratio`` or above."""
    shortest_by_bigrams(ratio)
    close = F.udf(lambda a, b: _close(a, b, ratio), "array<struct<cand_title:string,target_title:string,ratio:double>>", useArrow=False)
    posted, asked = _blocks(cand, "_a"), _blocks(goal, "_b")
    blocks = posted.count()
    tasks = max(cand.sparkSession.sparkContext.defaultParallelism, min(blocks, blocks * asked.count() // 4))
    return posted.repartition(tasks).crossJoin(asked).select(F.inline(close("_a", "_b")))


def match_titles(
    candidates: DataFrame,
    targets: DataFrame,
    min_ratio: float = 0.85,
    title: str = "title",
    key: str = "key",
    journals: Sequence[str] | None = None,
    years: tuple[int, int] | None = None,
    journal: str = "journal",
    year: str = "year",
) -> DataFrame:
    """(key, target_title, cand_key, cand_title, ratio, status, reason): the best candidate of each target, or ``unresolved``.

    Correction notices are no candidates. The best ratio wins, the smallest key among equals; then the gates: the winner's
    journal must contain one of ``journals`` (lower case), its year must be a plain number within ``years``. A winner that
    fails one leaves the target unresolved, with the gate as ``reason``; nothing else is put in its place. A target with an
    equal title, or with one at a ratio of ``NEAR``, has its winner without the products, so copies and hot titles cost one equi
    join. Equal titles are scored once.
    A NULL title is unresolved.
    """
    extra = [F.col(c).alias(f"_{n}") for n, c, used in (("journal", journal, journals), ("year", year, years)) if used is not None]
    cand = candidates.where(F.col(title).isNotNull() & ~F.lower(title).rlike(NOTICES)).select(F.col(key).alias("cand_key"), F.lower(title).alias("cand_title"), *extra)
    fields = [c for c in cand.columns if c != "cand_title"]
    first = cut_lineage(cand.groupBy("cand_title").agg(F.min(F.struct(*fields)).alias("_c")))
    goal = targets.select(F.col(key).alias("key"), F.lower(title).alias("target_title"))
    wanted = goal.where("target_title IS NOT NULL").select(F.col("target_title").alias("title")).distinct()
    titles = first.select(F.col("cand_title").alias("title"))
    equal = wanted.join(titles, "title", "left_semi").select(F.col("title").alias("target_title"), F.col("title").alias("cand_title"), F.lit(1.0).alias("ratio"))
    rest, scored = cut_lineage(wanted.join(titles, "title", "left_anti")), equal
    for ratio in (r for r in NEAR if r > min_ratio):
        if not rest.isEmpty():
            near = cut_lineage(near_titles(titles, rest, ratio))
            rest = cut_lineage(rest.join(near.select(F.col("target_title").alias("title")), "title", "left_anti"))
            scored = scored.unionByName(near)
    if not rest.isEmpty():
        shares = F.explode(F.sequence(F.floor(F.length("title") * min_ratio / (2 - min_ratio)), F.ceil(F.length("title") * (2 - min_ratio) / min_ratio)))
        lengths = rest.select(shares.alias("_n")).distinct()
        able = titles.withColumn("_n", F.length("title").cast("bigint")).join(lengths, "_n", "left_semi").select("title")
        scored = scored.unionByName(similar_titles(cut_lineage(able), rest, min_ratio))
    # Written, so that copies of one title do not all meet its winner in the task that found it.
    best = cut_lineage(scored.join(first, "cand_title").groupBy("target_title").agg(F.min(F.struct((-F.col("ratio")).alias("neg"), "_c.cand_key", "cand_title", "_c")).alias("_b")))
    no, reasons = F.lit(None).cast("string"), []
    if journals is not None:
        held = F.lower(F.coalesce(F.col("_b._c._journal").cast("string"), F.lit("")))
        allowed = F.lit(False)
        for j in journals:
            allowed = allowed | F.contains(held, F.lit(j.lower()))
        reasons.append(F.when(~allowed, "journal"))
    if years is not None:
        y = F.coalesce(F.col("_b._c._year").cast("string"), F.lit(""))
        reasons.append(F.when(~(y.rlike(r"^\d{1,9}$") & F.coalesce(y.try_cast("int").between(*years), F.lit(False))), "year"))
    reason = F.coalesce(F.when(F.col("_b").isNull(), "title"), *reasons, no)
    out = goal.join(best, "target_title", "left").withColumn("reason", reason)
    kept = lambda c: F.when(F.col("reason").isNull(), c)
    return out.select(
        "key", "target_title", kept(F.col("_b.cand_key")).alias("cand_key"), kept(F.col("_b.cand_title")).alias("cand_title"),
        kept(-F.col("_b.neg")).alias("ratio"), F.when(F.col("reason").isNull(), "matched").otherwise("unresolved").alias("status"), "reason",
    )
