"""Helpers that several training-data operators share: word hashing over bytes, salted group values, linked groups."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sparkaudit.session import cut_lineage

#: The bytes that end a word: \x20 and \x09-\x0D. ``bytes.split()`` without an argument splits at exactly these.
WORD_SPACE = b" \t\n\x0b\x0c\r"

#: Multiplier of the rolling hash: any odd 64-bit number.
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xC2B2AE3D27D4EB4F

#: Rows of text are hashed in runs of about this many bytes, which bounds the arrays of a task.
RUN_BYTES = 1 << 18


#: Bytes of a batch that goes to Python, unless the session sets its own bound. The default has none, and long texts add up.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same rows, in a session whose batches to Python are bounded by bytes."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(setting, None) is None:
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))
    return df


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, NULL as empty."""
    column = batch.column(name)
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def runs(sizes: Sequence[int], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs (first, past the last) of about ``limit`` bytes; a longer row is a run by itself."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


@lru_cache(maxsize=8)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to ``size``."""
    with np.errstate(over="ignore"):
        up, down = np.empty(size + 1, np.uint64), np.empty(size + 1, np.uint64)
        for out, factor in ((up, base), (down, pow(base, -1, 1 << 64))):
            out[0] = 1
            out[1:] = np.uint64(factor)
            np.multiply.accumulate(out, out=out)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, so that any of them can serve as a bucket number."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def settle(df: DataFrame) -> DataFrame:
    """Write a finished step to the shared folder and let go of the shuffle files that it came from."""
    out = cut_lineage(df)
    gc.collect()
    df.sparkSession.range(1).count()  # the session holds the plan of its last execution
    time.sleep(0.5)
    df.sparkSession.sparkContext._jvm.System.gc()  # Spark drops shuffle files when nothing refers to them any more
    return out


class Rolling:
    """Hash of any slice of a sequence of whole numbers in constant time, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        size = max(RUN_BYTES * 2, 1 << int(len(values)).bit_length())
        self.up, self.down = powers(base, size)
        self.prefix = np.empty(len(values) + 1, np.uint64)
        self.prefix[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=self.prefix[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each [start, end); equal slices have equal hashes wherever they start."""
        with np.errstate(over="ignore"):
            length = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + length)

    def each(self, width: int) -> np.ndarray:
        """The hash of every slice of ``width`` values, in order; the same hashes as ``slices`` gives."""
        with np.errstate(over="ignore"):
            n = len(self.prefix) - width
            return mix((self.prefix[width:] - self.prefix[:n]) * self.down[:n] + np.uint64(width) * np.uint64(0xD6E8FEB86659FD93))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WORD_SPACE)] = True


def word_spans(data: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in texts laid end to end, and the text that each word is in. No word crosses a text."""
    space = _IS_SPACE[data]
    first = np.zeros(len(data), bool)
    begins = np.concatenate([[0], doc_ends[:-1]]).astype(np.int64)
    first[begins[begins < len(data)]] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | first))
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, space[1:] | first[1:]
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(doc_ends, starts, side="right")


_ONE_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit XXH64 for each word of ``text``, in order. Each different word is hashed once."""
    words = pc.split_pattern(pa.array([text.translate(_ONE_SPACE)], pa.large_binary()), b" ").values.dictionary_encode()
    named = words.dictionary.to_pylist()
    ids = words.indices.to_numpy()
    hashes = np.array([xxh64_intdigest(w) for w in named], np.uint64)
    return hashes[ids[ids != named.index(b"")]] if b"" in named else hashes[ids]


def first_by_hash(df: DataFrame, order: Column, total: int, most: int) -> DataFrame:
    """The first ``most`` of ``total`` rows in the order of a 64-bit hash.

    Rows far behind are left out before the sort, so that all tasks together keep little more than ``most``.
    """
    share = (most + 6 * most**0.5 + 10) / max(1, total)
    near = df if share >= 1 else df.where(order < int(-(2**63) + share * 2**64))
    return near.orderBy(order, *df.columns).limit(most)


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end as one array of bytes, and where each ends."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.cumsum([len(t) for t in texts], dtype=np.int64)


def salt(column: str, parts: int = 64) -> Column:
    """A number below ``parts`` that deals the rows of one key over as many tasks."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def with_group_value(df: DataFrame, keys: Sequence[str], spread: str, **values: tuple[Column, Column]) -> DataFrame:
    """Add aggregates of the rows' key groups without bringing a group into one task.

    values: the name and (first aggregate over rows, second over the column of that name). The rows of a key are dealt
    out by the salt column ``spread``: each (key, salt) is aggregated, then each key over its few salts, and the
    result goes back by (key, salt).
    """
    keys = list(keys)
    part = df.groupBy(*keys, spread).agg(*[first.alias(name) for name, (first, _) in values.items()])
    whole = part.groupBy(*keys).agg(*[second.alias(name) for name, (_, second) in values.items()])
    back = same_keys(part.select(*keys, spread), whole, keys)
    return same_keys(df, back, [*keys, spread])


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same names where NULL meets NULL; the keys come from the left."""
    right = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(right[f"__{k}"])
        condition = term if condition is None else condition & term
    return left.join(right, condition, how).drop(*[f"__{k}" for k in keys])


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root being the smallest node that it is linked to.

    Alternates the large-star and small-star steps; each round is written to the shared folder. A hot centre is dealt
    out by salts. Nothing but two numbers a round comes to the driver.
    """
    links = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _digest(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("s", salt("b"))
        low = with_group_value(both, ["a"], "s", m=(F.min("b"), F.min("m")))
        large = low.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        low = with_group_value(large.withColumn("s", salt("b")), ["a"], "s", m=(F.min("b"), F.min("m")))
        small = low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        links = cut_lineage(small.select("e.*").where("a <> b").distinct())
        now = _digest(links)
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"groups still change after {rounds} rounds")


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
