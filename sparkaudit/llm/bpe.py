"""Byte-level BPE as a monoid: encoding is a tree reduction, decoding a concatenation up the tree.

``encode`` of a piece of text halves its bytes, encodes both halves and joins the two token lists. A join is right as
soon as every two neighbouring tokens are *stable*: the bytes of the two together encode to just these two. (Proof: take
the first merge across a token border in the run over all bytes. Until then the bytes of the two tokens beside that border
have been merged as in a run over these two alone, because the lowest rank among all is the lowest among theirs as well,
so the run over the two would make the same merge, and they would not be stable. If all borders are stable there is no
such merge, and each token forms by itself.) The halves are stable inside, so only the border in the middle is in doubt: a
window of one token on each side is encoded anew and grows, by twice as many tokens each time, on any side whose border with
the rest is not stable.

The pattern splits the text first; no token crosses a match. A match that is a token itself is that token, as in the
reference library. Matches repeat, so each worker keeps a table of those it has met, of bounded size, and gathers ids from it.

Defined results: NULL text counts as empty and has no tokens; very long texts and matches are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkaudit.llm.common import bounded, runs

#: Pieces, neighbour pairs and short strings that a task remembers, at most, of each.
REMEMBERED = 300_000
#: Characters of texts whose matches are looked up together.
RUN = 1 << 20
#: Bytes of a piece that are merged directly, below the tree.
LEAF = 6
#: Bytes from which on merging uses a heap.
LONG = 40


class Tokenizer:
    """Encoder and decoder over the ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(pattern)
        tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        size = np.array([len(b) for b in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size, self.uses = array("I"), array("q"), array("q"), np.zeros(0, np.int64)
        self.stable: dict[tuple[int, int], bool] = {}
        self.short: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a short string, remembered."""
        met = self.short.get(data)
        if met is None:
            met = self.merge_anew(data)
            if len(data) <= 4 * LEAF:
                if len(self.short) >= REMEMBERED:
                    self.short.clear()
                self.short[data] = met
        return met

    def merge_anew(self, data: bytes) -> list[int]:
        """Again and again the pair of lowest rank becomes one, the leftmost of equals."""
        if len(data) > LONG:
            return self.merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        best = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            low, at = None, -1
            for i, rank in enumerate(best):
                if rank is not None and (low is None or rank < low):
                    low, at = rank, i
            if low is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del best[at]
            if at:
                best[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(best):
                best[at] = ranks.get(parts[at] + parts[at + 1])

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i, stop = heappop(heap)
            middle = end[i]
            if middle >= n or middle < 0 or end[middle] != stop:
                continue  # one of the two has been merged since
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            left = before[i]
            if left >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def is_stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their bytes meet."""
        met = self.stable.get((left, right))
        if met is None:
            if len(self.stable) >= REMEMBERED:
                self.stable.clear()
            met = self.stable[left, right] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return met

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two strings laid together, from the tokens of each."""
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        i, j, more = len(left) - 1, 1, 1
        while True:
            window = self.merge(b"".join(map(self.token.__getitem__, left[i:] + right[:j])))
            left_holds = i == 0 or self.is_stable(left[i - 1], window[0])
            right_holds = j == len(right) or self.is_stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:i] + window + right[j:]
            # a window that has to grow often grows faster, so that all its encodings together cost about the last one
            i, j = max(0, i - more * (not left_holds)), min(len(right), j + more * (not right_holds))
            more *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data) if data else []
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def learn(self, text: str) -> None:
        """Give a match a number, and keep its ids behind those of the others."""
        data = text.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.tree(data)
        self.known[text] = len(self.begin)
        self.begin.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)

    def forget(self) -> None:
        """Keep the half of the table that is used most, if it is used again at all."""
        old, uses = list(self.known), np.array(self.uses, np.int64)
        stay = np.sort(np.argsort(-uses, kind="stable")[: REMEMBERED // 2])
        stay = stay[uses[stay] > 1]
        flat, begin, size = self.flat, self.begin, self.size
        self.known, self.flat, self.begin, self.size, self.uses = {}, array("I"), array("q"), array("q"), np.zeros(0, np.int64)
        for i in stay.tolist():
            self.known[old[i]] = len(self.begin)
            self.begin.append(len(self.flat))
            self.size.append(size[i])
            self.flat.extend(flat[begin[i] : begin[i] + size[i]])
        if len(self.flat) > 8 * REMEMBERED:  # very long matches
            self.known, self.flat, self.begin, self.size = {}, array("I"), array("q"), array("q")

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text. Matches meet at borders that nothing crosses, so each different one of a run is encoded once and
        the ids of all are gathered from the table."""
        out = []
        for i, j in runs([len(t) for t in texts], RUN):
            if len(self.known) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
                self.forget()
            found = [self.pieces.findall(t) for t in texts[i:j]]
            matches = list(chain.from_iterable(found))
            numbers = list(map(self.known.get, matches))
            if None in numbers:
                for new in dict.fromkeys(m for m, n in zip(matches, numbers, strict=True) if n is None):
                    self.learn(new)
                numbers = list(map(self.known.get, matches))
            which = np.array(numbers, np.int64)
            uses = np.bincount(which, minlength=len(self.begin))
            uses[: len(self.uses)] += self.uses
            self.uses = uses
            ids, ends = gathered(np.array(self.flat, "<u4"), np.array(self.begin, np.int64), np.array(self.size, np.int64), which)
            cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, found)])].tolist()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit numbers."""
        return self.encode_all([text])[0].tobytes()

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """Bytes of the ids, concatenated."""
        ids = np.frombuffer(ids, "<u4")
        return b"".join(gathered(*self.bytes, ids[i : i + RUN].astype(np.int64))[0].tobytes() for i in range(0, len(ids), RUN))


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one behind the other, and where each ends."""
    n = size[which]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[which] - ends + n, n)], ends


_MADE: list[tuple] = []


def tokenizer_of(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """One tokenizer for all tasks of a worker process, as long as they use the same ranks and pattern."""
    if not _MADE or _MADE[0][0] is not ranks or _MADE[0][1] != pattern:
        _MADE[:] = [(ranks, pattern, Tokenizer(ranks, pattern))]
    return _MADE[0][2]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and numbers. The vocabulary has a fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``docs`` with ``__ids`` added: the token ids of ``text`` as little-endian unsigned 32-bit numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(sent.value, pattern)
        for batch in batches:
            ids = [found.tobytes() for found in tokenizer.encode_all([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*columns, "__ids"])

    return bounded(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__ids", T.BinaryType())]))


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "__ids") -> DataFrame:
    """``encoded`` with ``__bytes`` added: the bytes of the ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(sent.value, pattern)
        for batch in batches:
            out = [tokenizer.decode(b or b"") for b in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*columns, "__bytes"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("__bytes", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs`` (doc_id, text).

    Both ways in one Python worker: chained stages would keep a worker each beside every task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(sent.value, pattern)
        for batch in batches:
            ids = tokenizer.encode_all([t or "" for t in batch.column("text").to_pylist()])
            back = [hashlib.sha256(tokenizer.decode(b)).hexdigest() for b in ids]
            columns = [pa.array([len(b) for b in ids], pa.int64()), pa.array([hashlib.sha256(b.tobytes()).hexdigest() for b in ids], pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(rows).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``docs`` with its text replaced by n_tokens, token_ids and decoded_sha256, the digest of what the ids decode to."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    made = {"n_tokens": T.LongType(), "decoded_sha256": T.StringType(), "token_ids": T.ArrayType(T.IntegerType())}
    kept = [c for c in docs.columns if c != "text" and c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(sent.value, pattern)
        for batch in batches:
            ids = tokenizer.encode_all([t or "" for t in batch.column("text").to_pylist()])
            size = [len(b) for b in ids]
            back = pa.array([hashlib.sha256(tokenizer.decode(b)).hexdigest() for b in ids], pa.string())
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(size, pa.int64()), back, lists], [*kept, *made])

    fields = [docs.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind in made.items()]
    return bounded(docs).mapInArrow(run, T.StructType(fields))
