"""Removal of repeated 200-byte strings by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``LENGTH`` bytes. As in a most-significant-digit sort, suffixes are divided by one
digit after the other, a suffix alone in its group is dropped for good, and equal groups at full depth are exactly the
repeated strings. What makes the first pass affordable is its digit: not the first bytes, which every suffix would have
to send, but the ``DIGIT`` bytes of smallest hash within its 200, which neighbouring suffixes share. Equal strings have
this digit at the same place, so the sort stays exact, and a stretch of suffixes with one digit is one row.

1. First digit: one row for each stretch (about one in 70 suffixes) with the digit and the stretch's whole content as
   hashes. Digits that occur once drop out. Stretches of equal content are equal groups at full depth, for all their
   suffixes at once; a digit whose stretches differ in content goes on, with one stretch of each content.
2. Second digit: stretches are cut into blocks of 16 suffixes, the digit being all bytes that the suffixes of a block have
   in common. Again single ones drop out, equal blocks are done, and different ones go on.
3. Last digit: single suffixes with all their bytes.

Contents count as equal when two independent 64-bit hashes of them are.

Groups are counted before anything is sent back, with partial counts where the rows are, and the way back to the rows is
a join that adaptive execution can split or that is dealt by salts, so a passage in a third of all documents stays even.

Offsets are bytes of the UTF-8 text. Overlapping repeats count, and strings are judged on the input. Defined results: NULL
text is empty; texts under 200 bytes lose nothing; rows that repeat a doc_id and text are copies of each other, and are told
from rows of the same doc_id with another text by the text's hash; a NULL doc_id is a row like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import BASE_2, Rolling, bounded, joined, mix, runs, salt, same_keys, settle, texts_of, with_group_value

LENGTH = 200
DIGIT = 64
#: Suffixes of one text that are handled at once; longer texts are cut with an overlap.
PIECE = 1 << 19
#: Bytes that are hashed at once, about.
RUN = 1 << 18
#: Suffixes in a block of the second and the last pass.
WIDTHS = (16, 1)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(text, offset, bytes) so that every string of LENGTH bytes starts in exactly one piece."""
    for i, text in enumerate(texts):
        for offset in range(0, len(text) - LENGTH + 1, PIECE):
            yield i, offset, text[offset : offset + PIECE + LENGTH - 1]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    rest = -len(values) % width
    blocks = np.concatenate([values, np.full(rest, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def _spread(content: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Hashes that also tell where in its digit's neighbourhood a range lies."""
    with np.errstate(over="ignore"):
        return mix(content + shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def stretches(texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
    """Stretches of suffixes that share their digit: the text, the place of the digit, first and last suffix, both hashes."""
    cut = list(pieces(texts))
    for i, j in runs([len(p[2]) for p in cut], RUN):
        data, ends = joined([p[2] for p in cut[i:j]])
        roll, second = Rolling(data), Rolling(data, BASE_2)
        digits = roll.each(DIGIT)
        # the upper bits of the hash, then the place: of equal digits the first counts
        least = sliding_least((digits >> np.uint64(22) << np.uint64(22)) | np.arange(len(digits), dtype=np.uint64), LENGTH - DIGIT + 1)
        place = (least & np.uint64((1 << 22) - 1)).astype(np.int32)
        lows = np.concatenate([[0], ends[:-1]])
        new = np.empty(len(place), bool)
        new[0], new[1:] = True, place[1:] != place[:-1]
        new[lows] = True
        past = ends - LENGTH + 1  # the suffixes from here to the next text are too short
        new[past[past < len(new)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        of = np.searchsorted(ends, first, side="right")
        whole = first < past[of]
        first, last, of = first[whole], last[whole], of[whole]
        at = place[first].astype(np.int64)
        text, offset = (np.array([p[k] for p in cut[i:j]])[of] for k in (0, 1))
        shift = offset - lows[of]
        content = _spread(second.slices(first, last + LENGTH), at - first)
        yield {"text": text, "place": at + shift, "first": first + shift, "last": last + shift, "digit": digits[at].view(np.int64), "content": content}


def blocks(texts: list[bytes], spans: list[list[dict]], width: int) -> Iterator[dict[str, np.ndarray]]:
    """Listed stretches cut into blocks of ``width`` suffixes on a grid that starts at the digit's place."""
    listed = [(i, s["place"], s["first"], s["last"], s["open"]) for i, of in enumerate(spans) for s in of]
    for i, j in runs([last - first + LENGTH for _, _, first, last, _ in listed], RUN):
        text, place, first, last, open_ = (np.array(v) for v in zip(*listed[i:j], strict=True))
        data, ends = joined([texts[t][a : b + LENGTH] for t, _, a, b, _ in listed[i:j]])
        shift = ends - (last - first + LENGTH) - first  # from offsets of the text to offsets here
        low, high = (place - last) // width, (place - first) // width
        of = np.repeat(np.arange(len(text)), high - low + 1)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[of]
        begin = place[of] - np.minimum(nth * width + width - 1, (place - first)[of])
        end = place[of] - np.maximum(nth * width, (place - last)[of])
        common, stop = place[of] - nth * width, place[of] - nth * width - width + 1 + LENGTH
        digit = _spread(Rolling(data).slices(common + shift[of], stop + shift[of]), nth)
        content = _spread(Rolling(data, BASE_2).slices(begin + shift[of], end + LENGTH + shift[of]), place[of] - begin)
        yield {"text": text[of], "place": place[of], "first": begin, "last": end, "open": open_[of].astype(bool), "digit": digit, "content": content}


KEY = "doc_id bigint, mark bigint, place bigint, first bigint, last bigint, digit bigint, content bigint, open boolean"


def _rows(batch: pa.RecordBatch, found: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for part in found:
        where = pa.array(part["text"])
        columns = [batch.column(c).take(where) for c in ("doc_id", "mark")]
        columns += [pa.array(part[c]) for c in ("place", "first", "last", "digit", "content")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(part.get("open", np.ones(len(where), bool)))], [c.split()[0] for c in KEY.split(", ")])


def _first_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _rows(batch, stretches(texts_of(batch)))


def _next_digit(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch, blocks(texts_of(batch), batch.column("spans").to_pylist(), width))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))


def divide(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: the ranges whose suffixes are all repeated, and the ranges that need the next digit.

    A range that is only there to be compared with (``open`` is false) is never among the first.
    """
    rows = settle(rows)
    digits = rows.groupBy("digit").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("mixed"))
    several = settle(digits.where("n > 1").select("digit", "mixed"))
    # written at once, so that nothing after it keeps adaptive execution from splitting a digit that many share
    alike = settle(rows.join(several, "digit"))
    alike = settle(with_group_value(alike.withColumn("s", salt("doc_id")), ["digit", "content"], "s", n=(F.count("*"), F.sum("n"))))
    whole = alike.where("open AND n > 1").select("doc_id", "mark", "first", "last")
    one = F.struct("doc_id", "mark", "place", "first", "last", (F.col("open") & (F.col("n") == 1)).alias("open"))
    others = alike.where("mixed").groupBy("digit", "content").agg(F.max_by(one, F.struct("open", "doc_id", "mark", "first")).alias("one"))
    others = others.withColumn("s", salt("content")).withColumn("still", F.col("one.open"))
    asked = with_group_value(others, ["digit"], "s", any_open=(F.max("still"), F.max("any_open")))
    return whole, settle(asked.where("any_open").select("one.*"))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last): every repeated string starts in one of these ranges of a document, and no other does."""
    rows = _keyed(docs)
    found, rest = divide(rows.mapInArrow(_first_digit, KEY))
    for width in WIDTHS:
        spans = rest.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "first", "last", "open")).alias("spans"))
        some, rest = divide(same_keys(rows, spans, ["doc_id", "mark"]).mapInArrow(_next_digit(width), KEY))
        found = found.unionByName(some)
    return found


def covered(size: int, spans: list[tuple[int, int]] | np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Which of ``size`` units are in a repeat that starts in a span, and the number of maximal runs."""
    edge = np.zeros(size + 1, np.int64)
    at = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, at[:, 0], 1)
    np.add.at(edge, np.minimum(at[:, 1] + length, size), -1)
    inside = np.cumsum(edge[:-1]) > 0
    return inside, int((inside[1:] & ~inside[:-1]).sum() + inside[:1].sum())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans_out = [], [], []
        for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist(), strict=True):
            inside, n = covered(len(text), [(s["first"], s["last"]) for s in spans or ()], LENGTH)
            kept.append(np.frombuffer(text, np.uint8)[~inside].tobytes() if n else text)
            removed.append(int(inside.sum()))
            spans_out.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, texts_of(batch)), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_out, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per row of ``docs``; ``kept`` holds the bytes that stay."""
    found = repeated(docs).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return same_keys(_keyed(docs), found, ["doc_id", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def summary(docs: DataFrame) -> DataFrame:
    """As ``without_repeats``, with the digest of the bytes that stay in their place."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
