import random

import numpy as np
import pytest

from sparkaudit.llm import jaccard as J


def plain_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc)
    smallest = {k: min([d for d in v if d is not None], default=None) for k, v in groups.items()}
    order = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((doc, len(s), smallest[top(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=order)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, passage = [], [f"p{i}" for i in range(30)]
    for i in range(40):  # families of edited copies around the limit
        base = [word() for _ in range(rng.choice([6, 12, 30, 90, 300]))]
        for _ in range(rng.randrange(1, 7)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40 + 1)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text) if rng.random() < 0.7 else "\t ".join(text).upper())
    template = [word() for _ in range(80)]
    for _ in range(120):  # one large family, most pairs of which are under the limit
        text = list(template)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(80)] = word()
        rows.append(" ".join(text))
    for _ in range(60):  # one passage in many documents
        at = rng.randrange(60)
        own = [word() for _ in range(60)]
        rows.append(" ".join(own[:at] + passage + own[at:]))
    rows += ["one two", "ONE two", "one", "", None, " \n", "é É", "É é", "a b c d e", "a b c d e f"]
    rows += [rows[0]] * 30
    rng.shuffle(rows)
    made = [(i * 3, t) for i, t in enumerate(rows)]
    return made + [made[1], (None, made[2][1]), (None, "none of its own kind at all here"), (0, "another text of the first id that stands alone")]


@pytest.mark.parametrize("hot,share,bits,block", [(200_000, 1000, 25, 256), (10, 2, 25, 16), (2, 1, 8, 2)])
def test_like_all_pairs(spark, documents, monkeypatch, hot, share, bits, block):
    """With common parameters, and with very long columns, a full table of bits, small blocks and slabs."""
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(hot)
    got = J.linked(documents(rows), hot=hot, share=share, bits=bits).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == brute(rows)


def test_empty(spark, documents):
    assert J.linked(documents([])).count() == 0
    assert [tuple(r) for r in J.linked(documents([(4, None)])).collect()] == [(4, 0, 4)]


def test_slabs(monkeypatch):
    """Products by slabs with pairs dropped on the way equal plain overlaps."""
    monkeypatch.setattr(J, "SLAB", 7)
    rng = random.Random(9)
    base = list(range(100))
    rows = [np.array(sorted(set(rng.sample(base, rng.randrange(50, 100)))), np.uint64) for _ in range(30)]
    every = np.arange(30)
    got = J.overlaps(rows, every, every, np.ones((30, 30), bool), 80)
    sets = [set(r.tolist()) for r in rows]
    assert got.any() and all(got[i, j] == (100 * len(a & b) >= 80 * len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(2000)).encode()
    want = J.shingles(text)
    monkeypatch.setattr(J, "PART", 50)
    assert (J.shingles(text) == want).all() and len(want) == 97
