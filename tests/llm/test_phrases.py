import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkaudit.llm import phrases as P


def brute(rows, least, most):
    counts = {}
    for lang, text in rows:
        if text is None:
            continue
        mine = counts.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(x for x in re.split(r"[ \t]+", piece) if x)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    mine[w[i : i + k]] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    words = ["w%d" % min(int(rng.paretovariate(0.7)), 60) for _ in range(400)] + ["Été", "New", "York", "city", "a\x0bb", "x\x00y"]
    fixed = ["New York city hall", "new york", "in the  middle\tof", "étÉ été été"]
    rows = []
    for i in range(size):
        body = " ".join(rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(60)))
        rows.append((i, rng.choice(["en", "fr", None, "und"]), body))
    return [*rows, (None, "en", None), (7, "en", ""), (8, None, " ,;\n"), (9, "de", "few words"), *[(5, "en", "the same text comes again and again")] * 40]


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, lang, t in rows], "doc_id bigint, text string, lang string, f int, phrase string")
    return sorted(tuple(r) for r in P.collocations(docs, **how).collect())


@pytest.mark.parametrize("share,bits", [(8, 25), (2, 25), (1000000, 25), (4, 8)])
def test_like_counting_all(spark, share, bits):
    """Whatever the sample proposes (an empty one proposes nothing) and however full the table of bits is."""
    rows = corpus(1, 220)
    assert run(spark, rows, least=8, most=50, share=share, bits=bits) == brute([(lang, t) for _, lang, t in rows], 8, 50)


def test_cut_texts(spark, monkeypatch):
    """A long text is counted in runs, with nothing lost or counted twice at a cut."""
    rows = corpus(2, 80)
    long = " ".join(t for _, _, t in rows if t) + " no end here" * 50
    want = P.count_run(next(P.runs_of([long.encode()]))[0], 0, "en", 4, None, None)
    whole, parts = Counter(), Counter()
    for names, counts in want:
        whole.update(dict(zip(names.to_pylist(), counts.tolist())))
    for part, carried in P.runs_of([long.encode()], 60):
        for names, counts in P.count_run(part, carried, "en", 4, None, None):
            parts.update(dict(zip(names.to_pylist(), counts.tolist())))
    assert {k: v for k, v in parts.items() if v} == dict(whole)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "en", None), (2, None, "")]) == []


def test_products_past_64_bits(spark):
    big = 10**13
    f = [("en", "", 10 * big), ("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big + 7)]
    row = P.scored(spark.createDataFrame(f, "lang string, phrase string, f bigint")).first()
    assert (row.a, row.l, row.r, row.score) == (big + 7, 3 * big, 2 * big, 2000000 * (big + 7) // (5 * big))


def bits_of(phrases, lang="en", bits=20):
    table = np.zeros(1 << (bits - 6), np.uint64)
    for phrase in phrases:
        words = P.word_hashes(pa.array([w.encode() for w in phrase.split(" ")], pa.binary()), lang)
        level = words[:1]
        for k in range(1, len(words)):
            level = P.longer_hash(level, words[k : k + 1])
        place = int(level[0]) >> (64 - bits)
        table[place >> 6] |= np.uint64(1 << (place & 63))
    return P.Bits(table, bits)


def counts_of(text, most, proposed, frequent):
    out = Counter()
    for part, carried in P.runs_of([text.encode()], most):
        for names, counts in P.count_run(part, carried, "en", 4, proposed, frequent):
            out.update(dict(zip((n.decode() for n in names.to_pylist()), counts.tolist())))
    return out


@pytest.mark.parametrize("share", [0, 0.3, 0.7, 1])
@pytest.mark.parametrize("most", [60, P.RUN])
def test_second_pass_counts_the_rest(share, most):
    """Whatever is proposed, the two passes count each frequent phrase in one of them, and none in both."""
    text = "\n".join(t for _, _, t in corpus(3, 80) if t)
    whole = counts_of(text, most, None, None)
    rng = random.Random(4)
    proposed = bits_of([p for p in whole if p and p.count(" ") < 3 and rng.random() < share])
    first = counts_of(text, most, proposed, None)
    frequent = bits_of([p for p, n in first.items() if p and n >= 3 and p.count(" ") < 3])
    second = counts_of(text, most, proposed, frequent)
    assert not set(first) & set(second) and bool(second) == (share < 1)
    assert all(whole[p] == n for p, n in [*first.items(), *second.items()])
    assert {p for p, n in whole.items() if n >= 3} == {p for p, n in [*first.items(), *second.items()] if n >= 3}


def test_two_passes_at_most(spark, monkeypatch):
    """A sample that misses all lengths costs one more pass over the texts, not one for each length."""
    passes, counted = [], P.counted
    monkeypatch.setattr(P, "counted", lambda *a, **k: passes.append(a) or counted(*a, **k))
    rows = corpus(5, 120)
    assert run(spark, rows, least=5, most=50, share=1000000) == brute([(lang, t) for _, lang, t in rows], 5, 50)
    assert len(passes) == 2


def test_hashes_of_phrases(spark):
    """A found phrase has the hash that the sample gave it."""
    want = {int(h) for lang in ("en", "de") for some, _ in P.run_hashes(b"a b\n a  c", 0, lang, 3) for h in some.view(np.int64)}
    found = spark.createDataFrame([(lang, p) for lang in ("en", "de") for p in ("a", "b", "c", "a b", "a c")], "lang string, phrase string")
    assert {r.hash for r in P.hashed(found).collect()} == want and len(want) == 10
