import hashlib
import random
from collections import Counter

from sparkaudit.llm import suffix_dedup


def brute(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    for i, b in data:
        inside = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                inside[s : s + length] = [True] * length
        runs = sum(1 for k in range(len(b)) if inside[k] and not (k and inside[k - 1]))
        yield i, len(b), sum(inside), runs, hashlib.sha256(bytes(x for x, y in zip(b, inside, strict=True) if not y)).hexdigest()


def test_pieces_of_long_texts(prose, monkeypatch):
    """Cut anywhere, each string of a text is in one stretch, with the same digit and place."""
    text = prose(3, 4000).encode()

    def by_string():
        out = {}
        for part in suffix_dedup.stretches([text, text[50:]]):
            for t, p, a, b, d in zip(*(part[c].tolist() for c in ("text", "place", "first", "last", "digit")), strict=True):
                for s in range(a, b + 1):
                    assert (t, s) not in out and a <= b
                    out[t, s] = (p, d)
        return out

    whole = by_string()
    assert len(whole) == 2 * (len(text) - 199) - 50
    assert all(whole[1, s] == (whole[0, s + 50][0] - 50, whole[0, s + 50][1]) for s in range(len(text) - 249))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert by_string() == whole


def test_against_all_strings(documents, prose):
    rng = random.Random(2)
    passage = prose(999, 120)
    rows = [(None, None), (1, ""), (2, "x" * 199), (3, "x" * 200), (4, "y" * 5000), (5, "é" * 150), (6, passage), (6, passage), (6, passage + "!"), (None, passage[:250])]
    for n in range(60):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((100 + n, prose(n, 30) + passage[a:b] + prose(n + 500, 20 + n % 9)))
    rows += [(300 + n, rows[20 + n][1]) for n in range(5)]
    got = Counter(tuple(r) for r in suffix_dedup.summary(documents(rows)).collect())
    assert got == Counter(brute(rows, 200))
    assert sum(r[2] > 0 for r in got) > 30


def test_no_rows(documents):
    assert suffix_dedup.summary(documents([])).count() == 0
