"""Secret scan: base patterns, and a character convolutional network that adds what looks like their findings.

Candidates are the matches of the base patterns and all other runs of 16 or more key characters with a letter and a digit.
The network sees each candidate with the characters around it: embedded characters, convolution, the maximum over
places, one logistic output. It is trained on labelled findings: matches of the base patterns are positive, also with
their surroundings blotted out, so that a bare key is known by its shape; ordinary strings (words, numbers, addresses)
with the words around them are negative. Part of them is held back: on it the outputs are calibrated (Platt), and the
threshold is at most the highest that still finds ``RECALL`` of its positives; where that is above 99.9 % of the negatives
it is half way down to these, but never under an even chance. Base findings stay whatever the network says; other candidates above the threshold are added as kind ``learned``.

The scan reads every whole text in place, without a shuffle. The training sample is bounded: of about ``SAMPLE_DOCS``
documents, chosen by hash, at most ``SAMPLE`` findings of either label, of fixed length, go to the driver. The model has a
fixed size.

Defined results: NULL text is empty and has no spans; without findings of both labels nothing is added; offsets are code
points, ends exclusive; a candidate longer than a view is judged by overlapping views over its whole length, and those
above the threshold, joined where they touch, are its findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so shorter matches need no dropping
KINDS = ("assign", "access", "hex", "learned")
KEYWORDS = ("passw", "secret", "token", "api")

OTHER = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[\w.@:/+-]{8,}")

SAMPLE_DOCS = 20_000
SAMPLE = 3_000
RECALL = 0.98
BEFORE, INSIDE, AFTER = 24, 40, 12
WIDTH = BEFORE + INSIDE + AFTER
FILTER, FILTERS, EMBED, SYMBOLS = 5, 24, 8, 98
EPOCHS, STEP, BATCH = 6, 0.01, 64

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """The findings of the base patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def other_candidates(text: str, base: list[Span]) -> list[Span]:
    """Long runs of key characters with letters and digits that no base finding overlaps."""
    out = []
    for m in OTHER.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and all(m.end() <= s or m.start() >= e for s, _, e in base):
            out.append((m.start(), 3, m.end()))
    return out


def view(text: str, start: int, end: int) -> np.ndarray:
    """The candidate and its surroundings as symbols: 0 nothing, 1 not ASCII, else the character."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    codes = np.array([ord(c) for c in before + inside + after])
    return np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 30, 1)).astype(np.uint8)


def pieces(span: Span) -> list[Span]:
    """Views over the whole of a candidate: itself, or parts of INSIDE characters that overlap by at least half."""
    start, kind, end = span
    if end - start <= INSIDE:
        return [span]
    return [(at, kind, at + INSIDE) for at in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]]


_PLACE = np.zeros((WIDTH, 1), np.float32)
_PLACE[BEFORE : BEFORE + INSIDE] = 1


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def patches(self, views: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.embed[views], np.broadcast_to(_PLACE, (len(views), WIDTH, 1))], 2)
        return np.concatenate([x[:, i : WIDTH - FILTER + 1 + i] for i in range(FILTER)], 2)

    def logits(self, views: np.ndarray) -> np.ndarray:
        out = [np.empty(0)]
        for i in range(0, len(views), 256):
            made = self.patches(views[i : i + 256]) @ self.filters + self.bias
            out.append(np.maximum(made.max(1), 0) @ self.out + self.out_bias)
        return np.concatenate(out)

    def probability(self, views: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(views) + self.shift, -35, 35)))


def train(views: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Stochastic gradient steps with running scales, then calibration and threshold on the part held back."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(views)) < 0.25
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    net = Network(
        rng.normal(0, 0.3, (SYMBOLS, EMBED)).astype(np.float32), rng.normal(0, 0.2, (FILTER * (EMBED + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0,
    )
    x, y = views[~held], labels[~held].astype(np.float32)
    scale = {name: 1e-8 for name in ("embed", "filters", "bias", "out", "out_bias")}
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            shown = x[at].copy()
            blot = rng.random(len(at)) < 0.4
            shown[np.ix_(blot, np.r_[0:BEFORE, BEFORE + INSIDE : WIDTH])] = 0
            upper = (rng.random(len(at)) < 0.3)[:, None] & (rng.random(shown.shape) < 0.6) & (shown >= 67) & (shown <= 92)
            shown[upper] -= 32  # of either label, so that a key's case is no sign
            patches = net.patches(shown)
            made = patches @ net.filters + net.bias
            best = made.argmax(1)
            top = np.take_along_axis(made, best[:, None, :], 1)[:, 0]
            pooled = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -35, 35))) - y[at]) / len(at)
            back = error[:, None] * net.out * (top > 0)
            chosen = patches[np.arange(len(at))[:, None], best]
            to_patch = (back[:, :, None] * net.filters.T[None]).reshape(len(at), FILTERS, FILTER, EMBED + 1)[..., :EMBED]
            embed = np.zeros_like(net.embed)
            np.add.at(embed, shown[np.arange(len(at))[:, None, None], best[:, :, None] + np.arange(FILTER)], to_patch)
            steps = {"embed": embed, "filters": np.einsum("nf,nfd->df", back, chosen), "bias": back.sum(0), "out": pooled.T @ error, "out_bias": error.sum()}
            for name, gradient in steps.items():
                scale[name] = 0.99 * scale[name] + 0.01 * np.mean(np.square(gradient)) + 1e-12
                setattr(net, name, getattr(net, name) - STEP * gradient / np.sqrt(scale[name]))
    at = held if held.any() else ~held
    score, truth = net.logits(views[at]), labels[at]
    # Platt: targets are drawn in by the counts of either label
    goal = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((truth == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(net.slope * score + net.shift, -35, 35)))
        w = p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * score * score) + 1e-3, np.sum(w * score)], [np.sum(w * score), np.sum(w) + 1e-3]])
        move = np.linalg.solve(h, [np.sum((p - goal) * score), np.sum(p - goal)])
        net.slope, net.shift = net.slope - float(np.clip(move[0], -1, 1)), net.shift - float(np.clip(move[1], -5, 5))
    p = net.probability(views[at])
    highest = float(np.quantile(p[truth == 1], 1 - RECALL, method="lower"))
    negative = float(np.quantile(p[truth == 0], 0.999, method="higher"))
    net.threshold = max(0.5, (highest + negative) / 2 if negative < highest else highest)
    return net


def learned_spans(texts: list[str], candidates: list[list[Span]], network: Network) -> list[list[Span]]:
    """Of each text, the pieces of its candidates above the threshold, joined where they touch."""
    asked = [(i, n, c) for i, of in enumerate(candidates) for n, span in enumerate(of) for c in pieces(span)]
    found: list[list[Span]] = [[] for _ in texts]
    latest = None
    for k in range(0, len(asked), 4096):
        some = asked[k : k + 4096]
        p = network.probability(np.stack([view(texts[i], s, e) for i, _, (s, _, e) in some]))
        for (i, n, c), good in zip(some, p >= network.threshold, strict=True):
            if good and latest == (i, n) and found[i][-1][2] >= c[0]:
                found[i][-1] = (*found[i][-1][:2], c[2])
            elif good:
                found[i].append(c)
            latest = (i, n) if good else latest
    return found


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled views: base findings and, from the same texts, ordinary strings."""
    for batch in batches:
        rows = []
        for text in _texts(batch):
            base = base_spans(text)
            rows += [(1, view(text, s, e).tobytes()) for s, _, e in base]
            unsure = [(s, e) for s, _, e in base + other_candidates(text, base)]
            ordinary = [m.span() for m in ORDINARY.finditer(text) if all(m.end() <= s or m.start() >= e for s, e in unsure)]
            # at most 12 of a text, spread over it, and all that have digits
            some = ordinary[:: max(1, len(ordinary) // 8)][:8] + [s for s in ordinary if any(c.isdigit() for c in text[s[0] : s[1]])][:4]
            rows += [(0, view(text, s, e).tobytes()) for s, e in some]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], ["label", "view"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample: int = SAMPLE) -> Network | None:
    total = docs.count()
    share = max(1, int(min(1.0, sample_docs / max(1, total)) * 1_000_000))
    some = docs.where(F.pmod(F.xxhash64(F.lit("secrets"), "doc_id"), F.lit(1_000_000)) < share).select("text")
    found = bounded(some).mapInArrow(_examples, "label int, view binary")
    parts = [found.where(F.col("label") == k).distinct().orderBy(F.xxhash64("view"), "view").limit(sample).collect() for k in (0, 1)]
    rows = [r for part in parts for r in part]
    if not all(parts):
        return None
    return train(np.stack([np.frombuffer(r["view"], np.uint8) for r in rows]), np.array([r["label"] for r in rows]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, text, base, spans): the findings of the base patterns and all findings, as kind:start:end by start."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            base = [base_spans(t) for t in texts]
            others = [other_candidates(t, b) for t, b in zip(texts, base, strict=True)]
            spans = [list(b) for b in base]
            if sent.value is not None:
                spans = [b + more for b, more in zip(base, learned_spans(texts, others, sent.value), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(map(listed, base), pa.string()), pa.array((listed(sorted(s)) for s in spans), pa.string())],
                ["doc_id", "text", "base", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(rows).mapInArrow(run, "doc_id bigint, text string, base string, spans string")


def summary(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans), one row per row of ``docs``."""
    count = lambda kind, of: F.regexp_count(F.col(of), F.lit(f"{kind}:")).cast("bigint").alias(f"n_{kind}")
    return scan(docs, network).select(
        "doc_id", *(count(k, "base") for k in KINDS[:3]), count("learned", "spans"), F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def masked(docs: DataFrame, network: Network | None, mask: str = "[secret]") -> DataFrame:
    """(doc_id, text) with every found span replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(_texts(batch), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
                    if end > at:
                        parts += [text[at:start], mask] if start >= at else []
                        at = end
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return scan(docs, network).select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, text string")
