"""Collocated phrases by Toivonen's sampling: propose on a sample, count the proposals and their negative border exactly.

1. A sample of the documents (a fixed share, so it grows with the input) proposes the phrases that occur in it at least
   ``SAMPLED`` times. With a phrase its parts are proposed, too.
2. A full pass counts every word, and every phrase whose two parts (without its last and without its first word) are
   proposed: these are the proposals themselves and those phrases of their negative border that occur at all.
3. Border phrases that turn out frequent are failures of the sample. Where there are any, one further pass counts all
   that they can lead to: each phrase that the first pass left out and that has no part which this pass counted and found
   infrequent. All parts of a frequent phrase are frequent, so one of the two passes has counted it, whatever the sample
   said. Without failures every frequent phrase was in the border: by induction over its length its two parts are proposed.

Tasks know proposals and frequent phrases as tables of bits of fixed size (``TABLE_BITS``, so a broadcast has a bound
whatever the input). A false hit only counts a phrase more, so the sample is counted by hashes. The two passes count the
phrases' own text, never hashes: tasks number the words of a run, count runs of numbers, and send each different phrase of
a run once, so a hot phrase costs one row a run.

Defined results: NULL text is empty, a NULL lang counts as ``und``, together with a real ``und``; doc_ids play no part, so
rows that repeat count as often as they come; very long texts are cut between words with the last words carried over, so
nothing is lost at a cut; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded, mix
from sparkaudit.session import cut_lineage

#: One document in so many is in the sample, and what occurs so often there is proposed.
SHARE = 8
SAMPLED = 2
#: Bits of the table of proposals: 2^25, which are 4 MB.
TABLE_BITS = 25
#: Bytes of text that are numbered together.
RUN = 8 << 20

_FROM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t"
_TO = b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n "
NORMAL = bytes.maketrans(_FROM, _TO)


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    named = words.to_numpy(zero_copy_only=False)  # bytes; faster than to_pylist
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in named), np.uint64, len(named))


def longer_hash(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all its words but the last, and of the last."""
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(word + np.uint64(0x632BE59BD9B4E019)))


class Bits:
    """A table of bits for hashes."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def within(self, other: Bits) -> bool:
        return not (self.words & ~other.words).any()


def runs_of(texts: list[bytes], most: int = RUN) -> Iterator[tuple[bytes, int]]:
    """Texts in runs of about ``most`` bytes, normalised, pieces parted by line ends; with the number of words that a run
    repeats from the one before, as a text that does not fit is cut between two words."""
    group: list[bytes] = []
    total = 0
    for text in texts:
        if len(text) <= most:
            if group and total + len(text) > most:
                yield b"\n".join(group).translate(NORMAL), 0
                group, total = [], 0
            group.append(text)
            total += len(text)
            continue
        carried, low = b"", 0
        while low < len(text):
            high = min(len(text), low + most)
            while high < len(text) and text[high : high + 1] not in b" \t\n":
                high += 1
            run = text[low:high].translate(NORMAL)
            whole = carried + b" " + run
            yield whole, len(carried.split(b" ")) if carried else 0
            carried = b" ".join([w for w in whole.rsplit(b"\n", 1)[-1].split(b" ") if w][-3:])
            low = high
    if group:
        yield b"\n".join(group).translate(NORMAL), 0


def place_and_number(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys numbered in their order: (a place of each number, the number of each key)."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=begins[1:])
    del ordered
    numbers = np.empty(len(keys), np.int32)
    numbers[order] = np.cumsum(begins, dtype=np.int32) - np.int32(1)
    return order[begins], numbers


class Numbered:
    """The words of a run as numbers. Position by position: ``ids``, and whether a piece ends there."""

    def __init__(self, run: bytes):
        tokens = pc.split_pattern(pa.array([run.replace(b"\n", b" \n ")], pa.large_binary()), b" ").values.dictionary_encode()
        self.words = tokens.dictionary
        ids = tokens.indices.to_numpy()
        empty, end = (pc.index(self.words, pa.scalar(w, self.words.type)).as_py() for w in (b"", b"\n"))  # -1: none
        self.ids = ids[ids != empty]
        self.is_word = self.ids != end

    def hashes(self, lang: str) -> np.ndarray:
        return word_hashes(self.words, lang)

    def phrases(self, starts: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """(phrases, counts) of the phrases of ``size`` words at ``starts``."""
        numbers = self.ids[starts]
        for k in range(1, size):
            place, numbers = place_and_number(numbers.astype(np.int64) << 32 | self.ids[starts + k])
        parts = [self.words.take(pa.array(self.ids[starts[place] + k])) for k in range(size)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", self.words.type)), np.bincount(numbers)


def count_run(run: bytes, carried: int, lang: str, longest: int, proposed: Bits | None, frequent: Bits | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of a run: without ``frequent`` the first pass, with it what that pass left out.

    The first pass counts the words, all their occurrences under the empty phrase, and what ``proposed`` lets be counted;
    everything where there is none.
    """
    text = Numbered(run)
    if not text.is_word.any():
        return
    if frequent is None:
        yield from _count_border(text, carried, lang, longest, proposed)
    else:
        yield from _count_missed(text, carried, lang, longest, proposed, frequent)


def _count_border(text: Numbered, carried: int, lang: str, longest: int, proposed: Bits | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    ids, words = text.ids, text.words
    hashes = text.hashes(lang) if proposed is not None else np.zeros(len(words), np.uint64)
    fresh = np.arange(len(ids)) >= carried  # a phrase that ends in carried words has been counted
    counts = np.bincount(ids[text.is_word & fresh], minlength=len(words))
    seen = np.flatnonzero(counts)
    yield pa.concat_arrays([words.take(pa.array(seen)), pa.array([b""], words.type)]), np.concatenate([counts[seen], [counts.sum()]])
    # level by level: the phrase number at each start, whether there is a member, and the names and hashes of the numbers
    number, member = ids, text.is_word if proposed is None else proposed.holds(hashes)[ids] & text.is_word
    phrase, level_hash = words, hashes
    for k in range(2, longest + 1):
        start = np.flatnonzero(member[:-1] & member[1:])
        if not len(start):
            return
        place, different = place_and_number(number[start].astype(np.int64) << 32 | ids[start + k - 1])
        counts = np.bincount(different[fresh[start + k - 1]], minlength=len(place))
        before, last = number[start[place]], ids[start[place] + k - 1]
        names = pc.binary_join_element_wise(phrase.take(pa.array(before)), words.take(pa.array(last)), pa.scalar(b" ", phrase.type))
        if counts.all():
            yield names, counts
        else:
            chosen = np.flatnonzero(counts)
            yield names.take(pa.array(chosen)), counts[chosen]
        if k == longest:
            return
        number, member = np.zeros(len(ids), np.int32), np.zeros(len(ids), bool)
        number[start], member[start] = different, True
        phrase = names
        if proposed is not None:
            level_hash = longer_hash(level_hash[before], hashes[last])
            member[start] = proposed.holds(level_hash)[different]


def _count_missed(text: Numbered, carried: int, lang: str, longest: int, proposed: Bits, frequent: Bits) -> Iterator[tuple[pa.Array, np.ndarray]]:
    ids, hashes = text.ids, text.hashes(lang)
    word_hash_at = hashes[ids]
    # at each start: the phrase's hash, whether it is proposed, and whether it may be frequent (found so, or not counted yet)
    level = word_hash_at.copy()
    member = proposed.holds(hashes)[ids] & text.is_word
    may = frequent.holds(hashes)[ids] & text.is_word
    for k in range(2, longest + 1):
        start = np.flatnonzero(may[:-1] & may[1:])
        counted_before = member[start] & member[start + 1]
        missed = start[~counted_before & (start + k - 1 >= carried)]
        if len(missed):
            yield text.phrases(missed, k)
        if k == longest or not len(start):
            return
        level[start] = longer_hash(level[start], word_hash_at[start + k - 1])
        here = level[start]
        member, may = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        member[start] = counted_before & proposed.holds(here)
        may[start] = ~counted_before | frequent.holds(here)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """(lang, run, carried) of batches with ``lang`` and ``text``; see ``runs_of``."""
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, mine in texts.items():
            for part, carried in runs_of(mine):
                yield lang, part, carried


def _texts(docs: DataFrame) -> DataFrame:
    return bounded(docs.where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))


def counted(docs: DataFrame, longest: int, proposed: Bits | None = None, frequent: Bits | None = None) -> DataFrame:
    """(lang, phrase, f) summed over all of ``docs`` (lang, text); see ``count_run``. The empty phrase has a lang's words."""
    tables = docs.sparkSession.sparkContext.broadcast((proposed, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part, carried in _runs(batches):
            for phrases, counts in count_run(part, carried, lang, longest, *tables.value):
                for low in range(0, len(counts), 1 << 16):
                    some = phrases[low : low + (1 << 16)].cast(pa.large_string()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(counts[low : low + len(some)], pa.int64())], ["lang", "phrase", "f"])

    return _texts(docs).mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def run_hashes(run: bytes, carried: int, lang: str, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of all phrases of 1 to ``longest`` words of a run."""
    text = Numbered(run)
    words = text.hashes(lang)[text.ids]
    level, inside = words, text.is_word
    for k in range(1, longest + 1):
        yield np.unique(level[inside & (np.arange(k - 1, len(inside) + k - 1) >= carried)], return_counts=True)
        level, inside = longer_hash(level[:-1], words[k:]), inside[:-1] & inside[1:]


def proposals(docs: DataFrame, longest: int, sampled: int) -> DataFrame:
    """(hash) of the phrases of 1 to ``longest`` words that occur ``sampled`` times or more in ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part, carried in _runs(batches):
            for hashes, counts in run_hashes(part, carried, lang, longest):
                for low in range(0, len(counts), 1 << 16):
                    some = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), pa.array(counts[some], pa.int64())], ["hash", "f"])

    found = _texts(docs).mapInArrow(run, "hash bigint, f bigint").groupBy("hash").agg(F.sum("f").alias("f"))
    return found.where(F.col("f") >= sampled).select("hash")


def hashed(phrases: DataFrame) -> DataFrame:
    """(hash) of ``phrases`` (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique():
                mine = batch.column("phrase").filter(pc.equal(batch.column("lang"), lang)).cast(pa.large_binary())
                split = pc.split_pattern(mine, b" ")
                first = split.offsets.to_numpy()[:-1].astype(np.int64)
                size = split.value_lengths().to_numpy()
                named = split.values.dictionary_encode()
                words = word_hashes(named.dictionary, lang.as_py())[named.indices.to_numpy()]
                level = words[first]
                for k in range(1, size.max(initial=0)):
                    more = size > k
                    level[more] = longer_hash(level[more], words[first[more] + k])
                yield pa.RecordBatch.from_arrays([pa.array(level.view(np.int64))], ["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash bigint")


def as_bits(hashes: DataFrame, bits: int = TABLE_BITS) -> Bits:
    """The table of bits with ``hashes`` (hash). At most 2^(bits - 6) rows come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    set_bits = hashes.select(F.shiftrightunsigned(place, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")).alias("bit"))
    got = set_bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Bits(out, bits)


def _words_in(phrase: Column | str) -> Column:
    return F.size(F.split(phrase, " "))


def frequent(docs: DataFrame, least: int = 30, longest: int = 4, share: int = SHARE, sampled: int = SAMPLED, bits: int = TABLE_BITS) -> DataFrame:
    """(lang, phrase, f): every phrase of 1 to ``longest`` words that occurs ``least`` times or more in its language,
    and the number of all words of each language under the empty phrase."""
    texts = docs.select("lang", F.col("text").cast("string").alias("text"))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("lang", F.col("text").cast("string").alias("text"))
    proposed = as_bits(proposals(chosen, longest - 1, sampled), bits)
    found = cut_lineage(counted(texts, longest, proposed).where((F.col("f") >= least) | (F.col("phrase") == "")))
    known = as_bits(hashed(found.where((F.col("phrase") != "") & (_words_in("phrase") < longest))), bits)
    if known.within(proposed):
        return found
    return found.unionByName(cut_lineage(counted(texts, longest, proposed, known).where(F.col("f") >= least)))


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the phrases of two words or more of ``found``, without those inside longer ones.

    ``found`` is (lang, phrase, f), closed under parts, with each lang's words under the empty phrase.
    """
    f = found.where("phrase <> ''")
    candidates = f.where(_words_in("phrase") > 1).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    # words inside longer candidates
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: part(i, k))))
    inner = candidates.where(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), "a")
    holders = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hundred = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(7,0)")
    left = candidates.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (hundred("longer", 100) < hundred("a", 80)))
    # every cut, with the counts of both sides
    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("_left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("_right"))
    l = f.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    r = f.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    both = cuts.join(l, ["lang", "_left"]).join(r, ["lang", "_right"])
    score = F.expr("(cast(a AS decimal(20,0)) * cast(2000000 AS decimal(7,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("_m"))
    n = found.where("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    return lowest.join(n, "lang").select("lang", "phrase", "_m.a", "_m.l", "_m.r", "n", "_m.score")


def best(phrases: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` of each lang with their ``rank``. Shares of a lang are ranked first, so no task holds a whole one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for shares in (1024, 16):
        salt = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        phrases = phrases.withColumn("_share", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order)))
        phrases = phrases.where(F.col("rank") <= most)
    ranked = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, **sampling: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of ``docs`` (doc_id, lang, text)."""
    return best(scored(cut_lineage(frequent(docs, least, longest, **sampling))), most)


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, w FROM f WHERE k > 1 AND f >= 30),
inside AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, j, unnest(range(1, len(w) - j + 2)) AS i FROM c, (VALUES (2), (3)) v(j) WHERE j < k) GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM d)),
s AS (
  SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM s),
ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
