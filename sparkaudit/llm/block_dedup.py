"""Removal of passages that were there before, by fixed blocks as anchors.

A window is ``WINDOW`` consecutive words. A window is repeated if its words also start earlier (in a smaller doc_id, or
earlier in the same document); words in repeated windows go.

1. Anchors: each document is cut into blocks of ``BLOCK`` words, end to end, which are the index. Every rolling window of
   ``BLOCK`` words probes it. Any window of 20 words holds at least one whole block of its own document, so of two equal
   windows either one has an indexed block that the other one's probes hit.
2. Extension: a hit is followed through the windows that hold it, up to ``WINDOW`` words; windows with no hit are no
   repeats. The windows left are compared as 80-bit hashes over XXH64 hashes of their words, and all but the earliest of equal ones are repeats.
   Overlapping repeats join to maximal ones.

Probes are many (one for each word), so they travel packed: a task sorts the probes of a run of documents by shard and
sends each shard one row of hashes, of which only the indexed blocks have places. Within a run a hash is sent once; where
it comes again the run already knows that it is hit. A phrase in a third of all documents so reaches its shard once
from each run.

Defined results: NULL text has no words; a text of fewer than 20 words loses none; rows that repeat a doc_id and text are
one document and get the same result; rows of one doc_id with different texts are ordered by a hash of the text; a NULL
doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import BASE_2, Rolling, bounded, joined, mix, runs, same_keys, settle, texts_of, word_hashes, word_spans
from sparkaudit.llm.suffix_dedup import covered

WINDOW = 20
#: Two blocks less one word fit into a window, so a window holds a whole block wherever it starts.
BLOCK = 10
#: Bytes of text in a run, about, and words of one text that a run takes at most.
RUN = 2 << 20
PART = 1 << 20
NO_ID = np.iinfo(np.int64).max

ROW = "shard int, ids binary, marks binary, sizes binary, bases binary, keys binary, more binary, places binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]


class Run:
    """Documents of one run laid end to end as word hashes, long ones in parts that overlap by a window less one word."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], ids: np.ndarray, marks: np.ndarray):
        self.of = np.array([p[0] for p in parts])
        self.bases = np.array([p[1] for p in parts], np.int64)
        self.sizes = np.array([len(p[2]) for p in parts], np.int64)
        self.lows = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([p[2] for p in parts])
        self.ids, self.marks = ids[self.of], marks[self.of]

    def starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``width`` words start, each once, and in which part."""
        n = np.clip(self.sizes - width + 1, 0, PART)
        part = np.repeat(np.arange(len(n)), n)
        return np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + self.lows[part], part

    def row(self, shard: int, keys: bytes, more: bytes, places: np.ndarray) -> tuple:
        """One packed row: the parts that its places lie in, and the places counted in these parts laid end to end."""
        part = np.searchsorted(self.lows, places, side="right") - 1
        here, nth = np.unique(part, return_inverse=True)
        sizes = self.sizes[here]
        packed = (places - self.lows[part] + (np.cumsum(sizes) - sizes)[nth]).astype("<u4")  # below 2^24, see PART
        three = packed.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        ids = np.diff(self.ids[here], prepend=0).astype("<i8").tobytes()  # neighbours are alike and compress
        bases = self.bases[here]
        return shard, ids, self.marks[here].astype("<i4").tobytes(), sizes.astype("<u4").tobytes(), bases.astype("<i8").tobytes() if bases.any() else b"", keys, more, three


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, mark and position of each place in a packed row."""
    ids = np.cumsum(np.frombuffer(row["ids"], "<i8"))
    marks, sizes = np.frombuffer(row["marks"], "<i4"), np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    bases = np.frombuffer(row["bases"], "<i8") if row["bases"] else np.zeros(len(ids), np.int64)
    three = np.frombuffer(row["places"], np.uint8).reshape(-1, 3).astype(np.uint32)
    place = (three[:, 0] | three[:, 1] << np.uint32(8) | three[:, 2] << np.uint32(16)).astype(np.int64)
    lows = np.cumsum(sizes) - sizes
    part = np.searchsorted(lows, place, side="right") - 1
    return ids[part], marks[part], place - lows[part] + bases[part]


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[Run, list[bytes], range]]:
    texts = texts_of(batch)
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
    marks = batch.column("mark").to_numpy()
    for i, j in runs([len(t) for t in texts], RUN):
        data, ends = joined(texts[i:j])
        _, _, doc = word_spans(data, ends)
        words = word_hashes(b" ".join(texts[i:j]))  # a rolling hash of the bytes would make some different words alike
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        group: list[tuple[int, int, np.ndarray]] = []
        total = 0
        for d in range(j - i):
            mine = words[bounds[d] : bounds[d + 1]]
            for base in range(0, len(mine), PART):
                piece = mine[base : base + PART + WINDOW - 1]
                if group and total + len(piece) > 2 * PART:
                    yield Run(group, ids, marks)
                    group, total = [], 0
                group.append((i + d, base, piece))
                total += len(piece)
        if group:
            yield Run(group, ids, marks)


def by_shard(shards: int, *sorted_hashes: np.ndarray) -> Iterator[tuple[int, list[slice]]]:
    """A shard is a range of hashes: its slice of each array, where there is anything in one."""
    bits = shards.bit_length() - 1
    cuts = [
        np.searchsorted(h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64), np.arange(shards + 1, dtype=np.uint64)).tolist()
        for h in sorted_hashes
    ]
    for shard in range(shards):
        slices = [slice(c[shard], c[shard + 1]) for c in cuts]
        if any(x.start < x.stop for x in slices):
            yield shard, slices


def _short(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """40 bits of each hash besides the shard's. As shards have about the same size for any input, this suffices for any."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (hashes >> np.uint64(32)).astype("u1").tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def _send_back(run: Run, shards: int, places: np.ndarray) -> Iterator[tuple]:
    """Places that the run knows to be repeated: a row without keys passes through any shard."""
    if len(places):
        yield run.row(int(run.marks[0]) % shards, b"", b"", np.sort(places))


def probes(shards: int):
    """The indexed blocks with their places, and the hashes of all other rolling windows of a block's length.

    A block whose words come again in its own run is known to be hit. The others are sent with their place, to be
    answered; a probe needs no place, because only blocks are asked for.
    """

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs_of(batch):
                starts, part = run.starts(BLOCK)
                if not len(starts):
                    continue
                keys = Rolling(run.words).each(BLOCK)[starts]
                indexed = (starts - run.lows[part] + run.bases[part]) % BLOCK == 0
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                times = np.diff(np.append(begin, len(keys)))
                alone = np.zeros(len(begin), bool)
                alone[times == 1] = indexed[order[begin[times == 1]]]
                blocks, others = begin[alone], begin[~alone]
                rows = []
                for shard, (x, y) in by_shard(shards, keys[blocks], keys[others]):
                    low, high = _short(np.concatenate([keys[blocks[x]], keys[others[y]]]))
                    rows.append(run.row(shard, low, high, starts[order[blocks[x]]]))
                again = np.repeat(times > 1, times)
                rows += _send_back(run, shards, starts[order[again & indexed[order]]])
                yield _batch(rows)

    return run_all


def windows(shards: int):
    """Whole windows whose own indexed block was hit: the earliest of equal ones in a run is sent, the others are repeats."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.frombuffer(h, "<u4") for h in batch.column("positions").to_pylist()]
            for run in runs_of(batch):
                starts, part = run.starts(WINDOW)
                if not len(starts):
                    continue
                hit = np.zeros(len(run.words) + BLOCK, bool)
                for p, of in enumerate(run.of):
                    at = hits[of].astype(np.int64) - run.bases[p]
                    hit[run.lows[p] + at[(at >= 0) & (at < run.sizes[p])]] = True
                here = starts - run.lows[part] + run.bases[part]
                keep = hit[starts + -here % BLOCK]
                starts, part, here = starts[keep], part[keep], here[keep]
                if not len(starts):
                    continue
                h1, h2 = (Rolling(run.words, *base).each(WINDOW)[starts] for base in ((), (BASE_2,)))
                h2 = (h2 & np.uint64(0xFFFF)).astype(np.uint16)
                order = np.lexsort((here, run.marks[part], run.ids[part], h2, h1))
                a, b = h1[order], h2[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                first, a, b = starts[order[new]], a[new], b[new]
                rows = [run.row(shard, a[x].astype("<u8").tobytes(), b[x].tobytes(), first[x]) for shard, (x,) in by_shard(shards, a)]
                # a repeat of the same place of the same document is no repeat
                later = ~new
                same = np.flatnonzero(later)
                first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[same]
                p, q = order[same], order[first]
                later[same] = (run.ids[part[p]] != run.ids[part[q]]) | (run.marks[part[p]] != run.marks[part[q]]) | (here[p] != here[q])
                rows += _send_back(run, shards, starts[order[later]])
                yield _batch(rows)

    return run_all


def _answers(ids: np.ndarray, marks: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """One row for each document with its positions packed."""
    order = np.lexsort((positions, marks, ids))
    ids, marks, positions = ids[order], marks[order], positions[order].astype("<u4")
    begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])) if len(ids) else np.empty(0, np.int64)
    ends = np.append(begin[1:], len(ids)).astype(np.int64) if len(ids) else begin
    packed = [positions[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[begin], mask=ids[begin] == NO_ID), pa.array(marks[begin].astype(np.int32)), pa.array(packed, pa.binary())], ["doc_id", "mark", "positions"]
    )


DEALT = "bucket int, ids binary, marks binary, counts binary, positions binary"


def _deal(ids: np.ndarray, marks: np.ndarray, positions: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places packed by bucket of documents, each document named once, so that a shard answers each bucket in one row."""
    bucket = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((positions, marks, ids, bucket))
    bucket, ids, marks, positions = bucket[order], ids[order], marks[order], positions[order].astype("<u4")
    docs = np.flatnonzero(np.concatenate([[len(ids) > 0], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])) if len(ids) else np.empty(0, np.int64)
    counts = np.diff(np.append(docs, len(ids)))
    names, begin = np.unique(bucket, return_index=True)
    cut = np.append(begin, len(ids))
    at = np.searchsorted(docs, cut)
    columns = [(ids[docs], "<i8", at), (marks[docs], "<i4", at), (counts, "<u4", at), (positions, "<u4", cut)]
    packed = [pa.array([c[x:y].astype(t).tobytes() for x, y in zip(e[:-1], e[1:], strict=True)], pa.binary()) for c, t, e in columns]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *packed], [c.split()[0] for c in DEALT.split(", ")])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, one after the other, to one row for each document."""
    current, kept = None, []

    def close():
        ids, marks, counts, positions = (
            np.concatenate([np.frombuffer(r[c], t) for r in kept]) for c, t in (("ids", "<i8"), ("marks", "<i4"), ("counts", "<u4"), ("positions", "<u4"))
        )
        return _answers(np.repeat(ids, counts), np.repeat(marks, counts), positions)

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != current and kept:
                yield close()
                kept.clear()
            current = row["bucket"]
            kept.append(row)
    if kept:
        yield close()


def solve(judge, kinds: tuple[str, str], buckets: int):
    """Whole shards, one after the other, to the places that ``judge`` picks from all entries of a shard."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, []

        def close():
            parts = [unpack(r) for r in kept]
            columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
            keys, more = ([np.frombuffer(r[c], kind).astype(np.uint64) for r in kept] for c, kind in zip(("keys", "more"), kinds, strict=True))
            # a row's keys beyond its places are probes
            placed = np.concatenate([np.arange(len(k)) < len(p[0]) for k, p in zip(keys, parts, strict=True)])
            picked = judge(np.concatenate(keys), np.concatenate(more), placed, *columns)
            return _deal(*(c[picked] for c in columns), buckets)

        for batch in batches:
            for row in batch.to_pylist():
                if not row["keys"]:
                    yield _deal(*unpack(row), buckets)
                    continue
                if row["shard"] != current and kept:
                    yield close()
                    kept.clear()
                current = row["shard"]
                kept.append(row)
        if kept:
            yield close()

    return run_all


def hit_blocks(keys, more, placed, ids, marks, positions):
    """Blocks that a probe or another block of any run hits."""
    key = keys | more << np.uint64(32)
    order = np.argsort(key, kind="stable")
    key, block = key[order], placed[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    hit = (same[:-1] | same[1:]) & block
    nth = np.cumsum(placed) - 1
    return np.sort(nth[order[hit]])


def not_first(keys, more, placed, ids, marks, positions):
    """All but the earliest place of equal windows."""
    order = np.lexsort((positions, marks, ids, more, keys))
    k, m = keys[order], more[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    same = (ids[order] == ids[first]) & (marks[order] == marks[first]) & (positions[order] == positions[first])
    return order[~same]


def _exchange(packed: DataFrame, judge, kinds: tuple[str, str], shards: int) -> DataFrame:
    """(doc_id, mark, positions), one row for each document that has any."""
    answered = packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(solve(judge, kinds, shards), DEALT)
    return settle(answered.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "doc_id bigint, mark int, positions binary"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("mark", F.hash("text"))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, positions): where windows start that were there before, as packed 32-bit numbers."""
    rows = _keyed(docs)
    # as many shards as the session's shuffles have partitions, which are to be set by the size of the data
    shards = 1 << (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    hits = _exchange(rows.mapInArrow(probes(shards), ROW), hit_blocks, ("<u4", "u1"), shards)
    asked = same_keys(rows, hits, ["doc_id", "mark"])
    return _exchange(asked.mapInArrow(windows(shards), ROW), not_first, ("<u8", "<u2"), shards)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, kept = [], [], []
        for text, found in zip(texts_of(batch), batch.column("positions").to_pylist(), strict=True):
            words = text.split()
            at = np.frombuffer(found or b"", "<u4").astype(np.int64)
            inside, _ = covered(len(words), np.stack([at, at], 1), WINDOW)
            total.append(len(words))
            removed.append(int(inside.sum()))
            kept.append(b" ".join(w for w, gone in zip(words, inside.tolist(), strict=True) if not gone))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per row of ``docs``; ``kept`` holds the words that stay, joined by one space."""
    return same_keys(_keyed(docs), repeated(docs), ["doc_id", "mark"], "left").select("doc_id", "text", "positions").mapInArrow(
        _cut, "doc_id bigint, n_words bigint, n_removed bigint, kept binary"
    )


def summary(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
