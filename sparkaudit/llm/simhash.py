"""SimHash near-duplicates by vantage-point trees over the fingerprints.

A fingerprint has 64 bits, of the 4-word shingles of a text (see ``fingerprints``). Two fingerprints that differ in at
most 4 bits are linked; a document's component is the smallest doc_id that its links reach.

Exact pairs from trees: the 64 bits are cut into three blocks. Two fingerprints within 4 bits are within 1 bit in one
block at least, so there is one tree for each block, over the Hamming distance inside the block. A tree divides
fingerprints at the median distance to a vantage point. By the triangle inequality a query at distance d needs the near
side only if d - 1 <= median and the far side only if d + 1 > median; inside a block this cuts far better than 4 of 64
bits would (branching about 1.3 a level, not 1.7). The upper levels of the trees make shards, so that a shard has about
``SHARD`` fingerprints whatever the input; a fingerprint is at home in one shard of each tree and visits those across a
boundary that it is within 1 bit of. The lower levels are built inside the shard's task. At the leaves whole fingerprints
are compared.

Only connectivity leaves a shard: for each of its fingerprints that has a link, one edge to the smallest fingerprint
linked to it there. A group of near copies therefore gives as many rows as it has fingerprints, not their pairs.
Equal fingerprints are one row from the start.

Defined results: NULL and wordless texts have fingerprint zero, which links like any other; a NULL doc_id is never a
component's name unless no member has another; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded, connected, first_by_hash, salt, same_keys, texts_of, with_group_value
from sparkaudit.session import cut_lineage

BITS = 4
WORDS = 4
SEED = 42
#: Bit masks of the blocks; each holds the links that differ in at most 1 of its bits.
BLOCKS = (np.uint64(0x1FFFFF), np.uint64(0x3FFFFE00000), np.uint64(0xFFFFFC0000000000))
REACH = BITS // len(BLOCKS)
#: Fingerprints at home in a shard, about. Their number sets how many levels of the trees are shared.
SHARD = 100_000
#: The shared levels are drawn from at most this many fingerprints (64 for each of 1,024 shards).
SAMPLE = 65_536
LEAF = 48


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the contract's white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(WORDS, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number. A bit is 1 if it is set in over half the shingles' XXH64."""
    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id bigint, fp bigint"
    )


def _away(values: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((values ^ point) & mask).astype(np.int16)


def shared_levels(sample: np.ndarray, mask: np.uint64, levels: int) -> list:
    """The upper levels of a tree, as nested [vantage point, median, near, far]; a number is a shard."""
    shards = 0

    def grow(points: np.ndarray, left: int):
        nonlocal shards
        if left and len(points) > 1:
            point = points[len(points) // 2]
            away = _away(points, point, mask)
            median = int(np.median(away))
            near = away <= median
            if near.all() and median:
                median -= 1
                near = away <= median
            if not near.all():
                return [point, median, grow(points[near], left - 1), grow(points[~near], left - 1)]
        shards += 1
        return shards - 1

    return grow(np.sort(sample), levels)


def _routes(tree, values: np.ndarray, mask: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, numbers of the values that are at home there or visit it, which are at home)."""

    def walk(node, at: np.ndarray, home: np.ndarray):
        if not isinstance(node, list):
            if len(at):
                yield node, at, home
            return
        point, median, near, far = node
        away = _away(values[at], point, mask)
        go = away - REACH <= median
        yield from walk(near, at[go], home[go] & (away[go] <= median))
        go = away + REACH > median
        yield from walk(far, at[go], home[go] & (away[go] > median))

    yield from walk(tree, np.arange(len(values)), np.ones(len(values), bool))


def links_within(points: np.ndarray, queries: np.ndarray, mask: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (fingerprint, fingerprint) that connect whatever is within BITS of a common query, through a tree over ``points``.

    Each query is linked to its first match at a leaf, and the matches of a leaf among themselves.
    """
    todo = [(points, queries, mask, REACH)]
    while todo:
        here, asking, bits, reach = todo.pop()
        if not len(here) or not len(asking):
            continue
        if len(here) > LEAF:
            point = here[len(here) // 2]
            away = _away(here, point, bits)
            median = int(np.median(away))
            near = away <= median
            if near.all() and median:
                median -= 1
                near = away <= median
            if not near.all():
                asked = _away(asking, point, bits)
                todo.append((here[near], asking[asked - reach <= median], bits, reach))
                todo.append((here[~near], asking[asked + reach > median], bits, reach))
                continue
            if reach < BITS:  # alike in the block: go on by all bits
                todo.append((here, asking, np.uint64(0xFFFFFFFFFFFFFFFF), BITS))
                continue
        for i in range(0, len(asking), 65_536):
            some = asking[i : i + 65_536]
            close = np.bitwise_count(some[:, None] ^ here[None, :]) <= BITS
            met = np.flatnonzero(close.any(1))
            first = close[met].argmax(1)
            yield some[met], here[first]
            order = np.argsort(first, kind="stable")
            groups, begin = np.unique(first[order], return_index=True)
            if len(groups):
                together = np.logical_or.reduceat(close[met][order], begin, axis=0)
                a, b = np.nonzero(together)
                yield here[groups[a]], here[b]


def stars(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value that each of the sorted ``values`` is linked to, over pairs (a, b)."""
    a, b = np.searchsorted(values, a), np.searchsorted(values, b)
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return values[root]
        root = new


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, shard, fp, home) of whole shards, sorted by shard, to edges (a, b)."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    current = None

    def solve():
        values = np.concatenate([v for v, _ in kept])
        home = np.concatenate([h for _, h in kept])
        pairs = list(links_within(np.sort(values[home]), values, BLOCKS[current[0]]))
        names = np.unique(values)
        root = stars(names, np.concatenate([p for p, _ in pairs] or [names[:0]]), np.concatenate([q for _, q in pairs] or [names[:0]]))
        apart = root != names
        return pa.RecordBatch.from_arrays([pa.array(names[apart].view(np.int64)), pa.array(root[apart].view(np.int64))], ["a", "b"])

    for batch in batches:
        tree, shard = batch.column("tree").to_numpy(), batch.column("shard").to_numpy()
        values = batch.column("fp").to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(shard) != 0)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(tree)], strict=True):
            if i == j:
                continue
            if kept and current != (tree[i], shard[i]):
                yield solve()
                kept.clear()
            current = (tree[i], shard[i])
            kept.append((values[i:j].copy(), home[i:j].copy()))
    if kept:
        yield solve()


def link_edges(distinct: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """Edges (a, b) between the different fingerprints of ``distinct`` (fp) whose components are those of all links."""
    total = distinct.count()
    levels = max(0, math.ceil(math.log2(max(1, total) / shard_size)))
    want = min(SAMPLE, 64 * 2**levels)
    # bounded by SAMPLE rows
    rows = first_by_hash(distinct.select("fp"), F.xxhash64("fp"), total, want).collect() if levels else []
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    trees = [shared_levels(sample, mask, levels) for mask in BLOCKS]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for t, mask in enumerate(BLOCKS):
                for shard, at, home in _routes(trees[t], values, mask):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), shard, np.int32)), pa.array(values[at].view(np.int64)), pa.array(home)],
                        ["tree", "shard", "fp", "home"],
                    )

    routed = distinct.select("fp").mapInArrow(route, "tree int, shard int, fp bigint, home boolean")
    return routed.repartition("tree", "shard").sortWithinPartitions("tree", "shard").mapInArrow(_shard_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (doc_id, text)."""
    rows = cut_lineage(fingerprints(docs)).withColumn("s", salt("doc_id"))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    groups = connected(link_edges(distinct, shard_size)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")).withColumn("t", salt("fp"))
    named = with_group_value(named, ["root"], "t", component_id=(F.min("low"), F.min("component_id")))
    part = rows.select("fp", "s").distinct().join(named.select("fp", "component_id"), "fp")
    return same_keys(rows, part, ["fp", "s"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates, the one with the smallest doc_id. All columns stay.

    Rows without a doc_id in a component where none has one stay, but for repeated rows.
    """
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id")).distinct()
    met = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]))
    nameless = F.when(F.col("__kept_id").isNull(), F.xxhash64(docs["text"]))
    return met.withColumn("__kept_text", nameless).dropDuplicates(["__kept_id", "__kept_text"]).drop("__kept_id", "__kept_text")
