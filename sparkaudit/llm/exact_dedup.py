"""Exact deduplication over a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z only. Of equal texts the row with the largest doc_id stays.

Each task holds one shard of the index, dealt by digest. A row whose fingerprint is in neither of its two buckets is new
and goes in; a hit is verified against the digests stored with the bucket. A holder that meets a larger doc_id is deleted
and the new one inserted. A full table doubles and is rebuilt from the stored digests. A group of copies is first
combined by (digest, salt), so the index sees one row for each salt at most, however large the group.

Defined results: NULL text counts as empty; a NULL doc_id is smaller than any other; of rows with the same text and the
same doc_id one stays; an empty table gives an empty result. Columns besides the id and the text are kept by
``deduplicate`` whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded, salt, same_keys, texts_of

SLOTS = 4
MOST_KICKS = 200


class CuckooIndex:
    """Cuckoo filter with 16-bit fingerprints whose slots point to the stored digests."""

    def __init__(self, buckets: int = 1024):
        self.keys: list[bytes | None] = []  # stored digests by number, None after deletion
        self.free: list[int] = []
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.numbers = array("i", bytes(4 * SLOTS * buckets))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[self.numbers[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """The number of a live digest, -1 if there is none. A fingerprint alone never counts."""
        slot = self._slot(key)
        return self.numbers[slot] if slot >= 0 else -1

    def insert(self, key: bytes) -> int:
        number = self.free.pop() if self.free else len(self.keys)
        if number == len(self.keys):
            self.keys.append(key)
        else:
            self.keys[number] = key
        if not self._place(key, number):
            self._grow()
        return number

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        number = self.numbers[slot]
        self.prints[slot] = 0
        self.keys[number] = None
        self.free.append(number)
        return True

    def _place(self, key: bytes, number: int) -> bool:
        mark, first, second = self._places(key)
        bucket = first
        for kick in range(MOST_KICKS):
            for b in (first, second) if kick == 0 else (bucket,):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.numbers[slot] = mark, number
                        return True
            slot = bucket * SLOTS + (mark + kick) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.numbers[slot], number = number, self.numbers[slot]
            bucket = self._other(bucket, mark)
        return False

    def _grow(self) -> None:
        """Double until every stored digest has a place again."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._empty(buckets)
            if all(k is None or self._place(k, n) for n, k in enumerate(self.keys)):
                return


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # bytes.lower() changes A-Z only
        digest = [hashlib.sha256(t.lower()).digest() for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.binary())], ["doc_id", "digest"])


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: (digest, part, top, n) in any order to (digest, part, keep_id, group_size)."""
    index = CuckooIndex()
    holder: list[int | None] = []
    count: list[int] = []
    parts: list[list[int]] = []
    for batch in batches:
        for key, part, top, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "part", "top", "n")), strict=True):
            at = index.find(key)
            if at >= 0:
                seen, members = count[at], parts[at]
                if holder[at] is None or top is not None and top > holder[at]:
                    index.delete(key)  # its holder is live no more
                    at, kept = index.insert(key), top
                else:
                    kept = holder[at]
            else:
                at, kept, seen, members = index.insert(key), top, 0, []
            for store, value in ((holder, kept), (count, seen + n), (parts, members)):
                if at == len(store):
                    store.append(value)
                else:
                    store[at] = value
            members.append(part)
    rows = [(k, p, holder[i], count[i]) for i, k in enumerate(index.keys) if k is not None for p in parts[i]]
    for start in range(0, len(rows), 10_000):
        cut = list(zip(*rows[start : start + 10_000], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(cut, (pa.binary(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            ["digest", "part", "keep_id", "group_size"],
        )


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs`` (doc_id, text)."""
    rows = (
        bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_digests, "doc_id bigint, digest binary")
        .withColumn("part", salt("doc_id"))
    )
    parts = rows.groupBy("digest", "part").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    live = parts.repartition("digest").mapInArrow(_live, "digest binary, part int, keep_id bigint, group_size bigint")
    order = Window.partitionBy("digest", "part").orderBy(F.desc_nulls_last("doc_id"))
    return (
        same_keys(rows, live, ["digest", "part"])
        .withColumn("nth", F.row_number().over(order))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that have an equal text with a larger doc_id. All columns stay."""
    kept = exact_copies(docs).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_text"))
    plain = F.translate(F.coalesce(docs["text"], F.lit("")), *UPPER_TO_LOWER)
    digest = F.sha2(F.encode(plain, "UTF-8"), 256)
    met = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]) & (digest == kept["__kept_text"]))
    return met.dropDuplicates(["__kept_id", "__kept_text"]).drop("__kept_id", "__kept_text")


UPPER_TO_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
