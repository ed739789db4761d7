"""Quality rules: fixed base checks and a learned decision list over text statistics.

``statistics`` reads every whole text in place. ``learn`` runs sequential covering on labelled statistics: a rule is grown as
a conjunction of thresholds, each the one with the largest information gain on the growing part, until it covers no
good text; then trailing conditions are pruned while that does not lower its value on the pruning part. A rule stays if its
precision on the pruning part is at least ``PRECISION``; the texts that it covers go, and the next rule is grown. ``verdict``
turns the list into one ordered conditional expression of Spark, in which the first rule that holds decides.

Learning takes at most ``SAMPLE`` labelled rows of statistics (numbers only, the labels that are first in an order by hash) to the driver;
labels with crc32(doc_id) mod 4 = 2 are left for tests.

Defined results: a NULL text has no words and fails the base check, as any text of fewer than 10 words does; without labels of
both classes the list is empty and keeps what the base checks keep; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded, first_by_hash, texts_of

SAMPLE = 20_000
PRECISION = 0.95
MOST_RULES, MOST_CONDITIONS = 12, 4
#: Candidate thresholds of a statistic, at its quantiles in the growing part.
THRESHOLDS = 40
WINDOW = 5

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_marks", "n_lines")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!\"'(),-./:;?@[\\]^_`{}~+="

#: What rules compare: counts over other counts.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words inside windows that occur twice or more, and the number of different words. Windows are numbered exactly."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(ids) < window or len(ids) - window + 1 < 2:
        return 0, len(number)
    names, have = ids, 1
    while have < window:
        step = min(have, window - have)
        left, right = names[: len(names) - step], names[step:] if step == have else None
        if right is None:  # the window's last part, overlapping
            right = names[window - have : window - have + len(left)]
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1]
        have += step
    count = np.bincount(names)
    twice = count[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(number)


def counts_of(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS. bytes.split() cuts at exactly the contract's white space."""
    words = text.split()
    repeat, distinct = repeated_words(words)
    lines: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        if line.strip(_SPACES):
            lines[line] = lines.get(line, 0) + 1
    without = lambda chars: len(text) - len(text.translate(None, chars))
    letters = text.translate(None, _SPACES)
    inner = sum(map(len, words)) - len(letters.translate(None, bytes(i for i in range(256) if not 0x80 <= i < 0xC0)))
    return (len(words), inner, without(SYMBOLS), sum(lines.values()) - len(lines), repeat, distinct, without(_UPPER), without(_DIGITS), without(_MARKS), sum(lines.values()))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([counts_of(t) for t in texts_of(batch)], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts), one row per row of ``docs`` (doc_id, text)."""
    rows = bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_statistics, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self) -> Column:
        part, whole = FEATURES[self.feature]
        share = F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
        return share >= self.threshold if self.above else share <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the largest gain until no good text is covered."""
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (covered & ~bad).any():
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        base, best = np.log2(p / (p + n)), (0.0, None, None)
        for feature, v in values.items():
            for t in np.unique(np.quantile(v[covered & bad], np.linspace(0, 1, THRESHOLDS))):
                for above in (True, False):
                    condition = Condition(feature, above, float(t))
                    now = covered & condition.holds(values)
                    p1, n1 = (now & bad).sum(), (now & ~bad).sum()
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - base) if p1 else 0.0
                    if gain > best[0]:
                        best = (gain, condition, now)
        if best[1] is None:
            break
        rule, covered = (*rule, best[1]), best[2]
    return rule


def worth(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = _covers(rule, values, len(bad))
    p, n = (covered & bad).sum(), (covered & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def cover(values: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """The decision list: rules whose texts are rejected, in order."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    while len(rules) < MOST_RULES and (left & part & bad).sum() >= 3:
        at = np.flatnonzero(left & part)
        rule = grow({k: v[at] for k, v in values.items()}, bad[at])
        check = np.flatnonzero(left & ~part)
        seen = {k: v[check] for k, v in values.items()}
        while len(rule) > 1 and worth(rule[:-1], seen, bad[check]) >= worth(rule, seen, bad[check]):
            rule = rule[:-1]
        if not rule or worth(rule, seen, bad[check]) < 2 * PRECISION - 1:
            break
        rules.append(rule)
        left &= ~_covers(rule, values, len(bad))
    return rules


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality): quality 0 is what they reject."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
        .groupBy("doc_id")
        .agg((F.avg("quality") < 0.5).alias("bad"))
    )
    order = F.xxhash64(F.lit("rules"), "doc_id")
    chosen = first_by_hash(usable, order, usable.count(), sample)
    found = stats.join(F.broadcast(chosen), "doc_id").where(~base_failed())
    one = found.groupBy("doc_id").agg(F.min(F.struct(*COUNTS, "bad")).alias("row"))  # of rows with one doc_id the least
    rows = one.select("doc_id", "row.*").orderBy(order, "doc_id").toPandas()
    bad = rows["bad"].to_numpy(bool)
    if not bad.any() or bad.all():
        return []
    values = {k: np.where(rows[b] > 0, rows[a] / np.maximum(rows[b], 1), 0.0) for k, (a, b) in FEATURES.items()}
    return cover(values, bad)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """True for texts to keep: the first rule that holds rejects, a text that none covers stays."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        held = rule[0].column()
        for condition in rule[1:]:
            held = held & condition.column()
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``stats`` with base_failed and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", verdict(learn(stats, labels, sample)))
