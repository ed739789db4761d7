import random
from difflib import SequenceMatcher

import pytest

from sparkaudit.operators import titles as L


def brute(cand, goal, ratio):
    """Best candidate by ratio, then smallest key, among titles that are no correction notices."""
    out = {}
    for key, title in goal:
        hits = [(-SequenceMatcher(None, c.lower(), title.lower()).ratio(), k) for k, c in cand if c is not None and title is not None and not any(n in c.lower() for n in ("correction", "erratum"))]
        best = min((h for h in hits if -h[0] >= ratio), default=None)
        out[key] = (best[1], round(-best[0], 9)) if best else None
    return out


def edited(rng, text, most):
    chars = list(text)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(chars) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            chars.insert(at, rng.choice("abc é"))
        elif chars and kind == 1:
            del chars[min(at, len(chars) - 1)]
        elif chars and kind == 2:
            chars[min(at, len(chars) - 1)] = rng.choice("abcx")
        else:
            chars = chars[at:] + chars[:at] if rng.random() < 0.1 else chars
    return "".join(chars)


@pytest.mark.parametrize("ratio,seed", [(0.85, 1), (0.85, 2), (0.75, 3), (0.95, 4)])
def test_no_match_is_lost(spark, ratio, seed):
    """Few letters and short titles, so that grams repeat and the bound is tight."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 10, 16, 30, 60]))) for _ in range(60)] + ["immunotherapys", "radiotherapy outcome", "", "aaaaaaaaaaaa"]
    cand = [(i, t) for i, t in enumerate(base)] + [(900, None), (901, "Erratum: " + base[3]), (902, base[5])]
    goal = [(i, edited(rng, t, 1 + len(t) // 8)) for i, t in enumerate(base)] + [(500, "immunotherapy"), (501, "radiotherapies outcomes"), (502, None), (503, ""), (504, base[9].upper())]
    got = L.match_titles(spark.createDataFrame(cand, "key int, title string"), spark.createDataFrame(goal, "key int, title string"), ratio)
    rows = {r.key: (r.cand_key, round(r.ratio, 9)) if r.status == "matched" else None for r in got.collect()}
    assert rows == brute(cand, goal, ratio)
    if ratio == 0.85:
        assert rows[500] and rows[501] is not None


def test_bound():
    """The ratio leaves as many common bigrams as the bound says, whatever the titles."""
    rng = random.Random(7)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        b = edited(rng, a, 3)
        r = SequenceMatcher(None, a, b).ratio()
        grams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)]
        common = sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))
        assert common >= L.common_bigrams(len(a) + len(b), r)


def test_gates(spark):
    cand = spark.createDataFrame(
        [(1, "Sleep and memory", "Journal of Sleep", "2019"), (2, "Diet and mood", "Other Letters", "2019"), (3, "Age and gait", "Sleep Medicine", "in press"),
         (4, "Age and gait again", "Sleep Medicine", "2020"), (5, "Noise", None, None), (6, "Correction: Sleep and memory.", "Journal of Sleep", "2020")],
        "key int, title string, journal string, year string")
    goal = spark.createDataFrame([(1, "Sleep and memory."), (2, "Diet and mood"), (3, "Age and gait"), (4, "Quite another thing"), (5, "noise")], "key int, title string")
    out = {r.key: (r.status, r.reason, r.cand_key) for r in L.match_titles(cand, goal, journals=["sleep"], years=(2018, 2020)).collect()}
    assert out == {1: ("matched", None, 1), 2: ("unresolved", "journal", None), 3: ("unresolved", "year", None), 4: ("unresolved", "title", None), 5: ("unresolved", "journal", None)}
    assert L.match_titles(cand.limit(0), goal).where("status = 'matched'").count() == 0


def test_ratio_without_bound():
    with pytest.raises(ValueError):
        L.shortest_by_bigrams(0.6)


def test_frequent_bigrams_write_no_pairs(spark, monkeypatch):
    """Titles of a few syllables: what is written on the way are titles, not pairs that share a frequent bigram."""
    rng = random.Random(11)
    cand = [(i, "".join(rng.choice(["the ", "on", "er", "ha", "st", "en ", "tion", "re"]) for _ in range(20))[:60]) for i in range(600)]
    goal = [(i, t[:6] + t[7:]) for i, t in cand]
    written, cut = [], L.cut_lineage

    def counted(df):
        table = cut(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(L, "cut_lineage", counted)
    out = L.match_titles(spark.createDataFrame(cand, "key int, title string"), spark.createDataFrame(goal, "key int, title string"))
    assert {r.key: r.cand_key for r in out.collect()} == {i: i for i in range(600)}
    assert sum(written) < 5 * 600


def test_every_page_is_looked_up(spark):
    from sparkaudit.plans import load_all
    from sparkaudit.plans.registry import QUERIES, Tables
    from sparkaudit.plans.relational_queries import page_titles

    load_all()
    folder = "/root/testdata/sf0.001"
    titles = [(r.key, r.title) for r in page_titles(Tables(spark, folder)).select("key", "title").collect()]
    rows = {r.key: (r.cand_key, r.ratio) if r.status == "matched" else None for r in QUERIES["join_title_gate"](spark, folder).collect()}
    want = brute(titles, [(k, t[:6] + t[7:]) for k, t in titles], 0.85)
    assert rows == {k: v and (v[0], round(v[1], 4)) for k, v in want.items()} and len(rows) == len(titles) > 20


@pytest.mark.parametrize("ratio,hot", [(0.95, 200), (0.98, 200), (0.9, 200), (0.95, 3)])
def test_no_near_pair_is_lost(spark, monkeypatch, ratio, hot):
    """Pairs of few letters, also repeated ones; with a low ``HOT``, whole targets are left out, and the products find their matches."""
    monkeypatch.setattr(L, "HOT", hot)
    rng = random.Random(5)
    base = sorted({"".join(rng.choice("ab ") for _ in range(rng.choice([1, 5, 20, 25, 26, 40, 60, 90]))) for _ in range(60)} | {"ab" * 30, "ab" * 31, "x" + "ab" * 30, "ein. " * 12})
    base += ["a common beginning of titles, " + "".join(rng.choice("ab ") for _ in range(30)) for _ in range(6)]
    goal = sorted({edited(rng, edited(rng, t, 2), 2) for t in base for _ in range(2)} - {""})
    frame = lambda titles: spark.createDataFrame([(t,) for t in titles], "title string")
    got = {(r.cand_title, r.target_title): r.ratio for r in L.near_titles(frame(base), frame(goal), ratio).collect()}
    want = {(a, b): r for a in base for b in goal if (r := SequenceMatcher(None, a, b).ratio()) >= ratio}
    if hot == 200:
        assert got == want and len(want) > 40
    else:
        left = {b for _, b in got}
        assert got == {(a, b): r for (a, b), r in want.items() if b in left} and len(left) < len({b for _, b in want})
    cand = list(enumerate(base))
    out = L.match_titles(spark.createDataFrame(cand, "key int, title string"), spark.createDataFrame(list(enumerate(goal)), "key int, title string"))
    assert {r.key: (r.cand_key, round(r.ratio, 9)) if r.status == "matched" else None for r in out.collect()} == brute(cand, list(enumerate(goal)), 0.85)
