import hashlib
import random
from collections import Counter

from sparkaudit.llm import block_dedup


def brute(rows, width=20):
    """In the order of doc_id (the test's rows have one each, or repeat the text)."""
    docs = {i: (t or "").encode().split() for i, t in rows}
    seen, out = set(), {}
    for i in sorted(docs, key=lambda i: (i is None, i)):
        words = docs[i]
        inside = [False] * len(words)
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            if window in seen:
                inside[s : s + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, gone in zip(words, inside, strict=True) if not gone)
        out[i] = (i, len(words), sum(inside), hashlib.sha256(kept).hexdigest())
    return Counter(out[i] for i, _ in rows)


def test_against_all_windows(documents, prose):
    rng = random.Random(4)
    passage = prose(77, 90).split()
    rows = [(None, prose(1, 60)), (1, None), (2, "\x0b\n "), (3, "a " * 19), (4, "a " * 20), (5, "b " * 400), (6, "b " * 50), (8, prose(1, 60)), (8, prose(1, 60))]
    for n in range(80):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((1000 - n, " ".join([prose(n, rng.randrange(25)), *passage[a:b], prose(n + 500, rng.randrange(40)), *passage[: rng.randrange(90)]])))
    rows += [(2000 - n, rows[30 + n][1]) for n in range(6)]
    got = Counter(tuple(r) for r in block_dedup.summary(documents(rows)).collect())
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 40


def test_long_text_in_parts(spark, prose, monkeypatch):
    """Runs and parts that are cut anywhere find the same places."""
    import pyarrow as pa

    texts = [prose(n % 3, 700) + " " + prose(n, 300) for n in range(5)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5), pa.int64()), "mark": pa.array([0] * 5, pa.int32()), "text": texts})

    def found(part):
        monkeypatch.setattr(block_dedup, "PART", part)
        sent = [r for b in block_dedup.probes(1)(iter([batch])) for r in b.to_pylist()]
        out = []
        packed = pa.RecordBatch.from_pylist(sent, block_dedup._batch([(0, *[b""] * 7)]).schema)
        dealt = sorted((r for b in block_dedup.solve(block_dedup.hit_blocks, ("<u4", "u1"), 3)(iter([packed])) for r in b.to_pylist()), key=lambda r: r["bucket"])
        for answer in block_dedup.merge(iter([pa.RecordBatch.from_pylist(dealt)])):
            for r in answer.to_pylist():
                out += [(r["doc_id"], p) for p in __import__("numpy").frombuffer(r["positions"], "<u4").tolist()]
        return set(out)

    whole = found(1 << 20)
    parts = found(90)
    words = [t.split() for t in texts]
    count = Counter(tuple(w[s : s + 10]) for w in words for s in range(len(w) - 9))
    must = {(d, s) for d, w in enumerate(words) for s in range(0, len(w) - 9, 10) if count[tuple(w[s : s + 10])] > 1}
    assert must and must == whole == parts


def test_no_rows(documents):
    assert block_dedup.summary(documents([])).count() == 0


def test_words_that_a_rolling_hash_takes_for_one(spark, documents):
    """Strings of two letters that cancel in any polynomial modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{common} {a}"), (2, f"{common} {b}"), (3, f"{common} {a}")]
    assert {r.doc_id: r.n_removed for r in block_dedup.summary(documents(rows)).collect()} == {1: 0, 2: 0, 3: 20}
