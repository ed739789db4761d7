import hashlib
import random
import re

import numpy as np
import pytest

from sparkaudit.llm import secrets

RNG = random.Random(3)
HEX = "".join(RNG.choice("0123456789abcdef") for _ in range(40))


def brute(text):
    """The contract's patterns as they are written, dropping what fails."""
    found = []
    letters = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({letters})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found)


CASES = [
    "", "nothing here", "password: token = abcdef1 Secret='x1y2z3'", "API_KEY=" + HEX, "apikey:short", "ſecret=abcdefgh toKen=abcdefgh",
    "AKIAAKIAAKIA12 AKIA" + "B" * 16, "g" + HEX + "g " + HEX[:23], "É token : \"a.b/c==\"", "passwd" * 3 + "=1234567",
]


@pytest.mark.parametrize("text", CASES)
def test_base_patterns(text):
    assert secrets.base_spans(text) == brute(text)


def test_random_texts():
    rng = random.Random(9)
    pieces = ["password", "Token", "api_key", "=", ":", " ", '"', "'", "AKIA", "ABC12", "deadbeef", "0123", "x", "é", "\n", "secret"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert secrets.base_spans(text) == brute(text)


def test_scan(spark, documents, prose):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(36))
    rows = []
    for n in range(400):
        words = prose(n, 60).split()
        words[30] = f'token = "{key()}"' if n % 4 == 0 else f"mail{n}@host{n}.example.com" if n % 4 == 1 else words[30]
        rows.append((n, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "z" * 100_000), (None, f"password={key()}")]
    bare = "".join(rng.choice("0123456789ABCDEFabcdef") for _ in range(44))
    rows += [(2000, prose(1, 20) + f" the key {bare} is here")]
    docs = documents(rows)
    network = secrets.learn(docs)
    got = {r.doc_id: r for r in secrets.summary(docs, network).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = brute(text or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(secrets.listed(base).encode()).hexdigest()
        assert set(filter(None, secrets.listed(base).split(","))) <= set(r.spans.split(","))
    assert got[2000].n_learned == 1
    assert sum(r.n_learned for i, r in got.items() if i != 2000) == 0
    clean = {r.doc_id: r.text for r in secrets.masked(docs, network).collect()}
    assert bare not in clean[2000] and clean[1] == rows[1][1] and "[secret]" in clean[0]


def test_nothing_to_learn(documents):
    docs = documents([(1, "abc"), (2, None)])
    assert secrets.learn(docs) is None
    assert [r.spans for r in secrets.summary(docs, None).collect()] == ["", ""]
    assert secrets.summary(documents([]), None).count() == 0


def test_held_back_examples():
    """Keys against words: recall as constrained, few false ones."""
    rng = random.Random(2)
    make = lambda n: [(1, "key = " + "".join(rng.choice("0123456789abcdef") for _ in range(32))) if i % 2 else (0, "the key of " + "".join(rng.choice("thandering") for _ in range(20))) for i in range(n)]
    as_views = lambda rows: (np.stack([secrets.view(t, t.rindex(" ") + 1, len(t)) for _, t in rows]), np.array([y for y, _ in rows]))
    net = secrets.train(*as_views(make(800)))
    views, y = as_views(make(400))
    p = net.probability(views) >= net.threshold
    assert p[y == 1].mean() >= 0.95 and p[y == 0].mean() <= 0.02


def test_long_candidates():
    """A key is found wherever it stands in a long run, and the rest of the run is no finding; by a model that counts digits."""
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
    word = lambda n: "".join(rng.choice("thandering") for _ in range(n))

    class Digits:
        threshold = 0.2

        def probability(self, views):
            inside = views[:, secrets.BEFORE : secrets.BEFORE + secrets.INSIDE]
            return ((inside >= 18) & (inside <= 27)).mean(1)

    net = Digits()
    path = "/".join(word(7) for _ in range(20))
    for text, at in ((path + "/" + hexes(32), len(path) + 1), (hexes(32) + "/" + path, 0), (path + "/" + hexes(32) + "/" + path, len(path) + 1)):
        found = secrets.learned_spans([text], [secrets.other_candidates(text, [])], net)[0]
        assert len(found) == 1 and found[0][0] <= at and found[0][2] >= at + 32
        assert found[0][2] - found[0][0] <= 32 + 2 * secrets.INSIDE
    assert secrets.pieces((5, 3, 45)) == [(5, 3, 45)] and secrets.pieces((5, 3, 46)) == [(5, 3, 45), (6, 3, 46)]
