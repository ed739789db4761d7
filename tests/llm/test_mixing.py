import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkaudit.llm import mixing


def brute_targets(sized):
    """Share by weight, stop at the limit, share the excess anew until none is above."""
    total = Counter()
    for _, source, n in sized:
        total[source] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, everything = {}, sum(total.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = everything - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            return total, fixed | share
        fixed |= {s: 3 * total[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "", None, "zz", "src10", "src9"][: 3 + seed * 2]
    rows = [(i, rng.choice(names[: 1 + i % len(names)]), "w " * int(rng.paretovariate(1.1) * 5 % 4000)) for i in range(1500)] + [(None, "a", "x y"), (7, "a", None)]
    docs = spark.createDataFrame([(i, t, s, True) for i, s, t in rows], "doc_id bigint, text string, source string, size boolean")
    got = mixing.mix(docs).collect()
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    total, target = brute_targets(sized)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n) for i, _, n in sized)
    taken = Counter()
    of = {i: s for i, s, _ in sized[:1500]}
    for r in got[:]:
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        if r.doc_id is None or r["size"] == 0:
            continue
        s = of[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
        rate = target[s] / total[s]
        assert int(rate + 1e-9) <= r.taken // r["size"] <= int(rate + 1e-9) + 1
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(5, 0.1 * target[s]), s  # few documents, sizes up to 4,000
        least = min((r["size"] for r in got if r.doc_id is not None and r["size"] and of[r.doc_id] == s and r.taken // r["size"] == int(target[s] / total[s] + 1e-9)), default=None)
        assert least is None or target[s] - taken[s] < least + 2, s  # no document that is left fits (2: the row without an id)
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_mixed_repeats_rows(documents, prose):
    docs = documents([(n, prose(n, 5 + n % 40)) for n in range(400)] + [(None, None), (1000, "")])
    out = mixing.mixed(docs)
    often = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    assert out.columns == docs.columns
    found = Counter(r.doc_id for r in out.collect())
    assert {k: v for k, v in found.items() if k in often} == {k: v for k, v in often.items() if v}


def test_empty(documents):
    assert mixing.mix(documents([])).count() == 0
    assert {r.target for r in mixing.mix(documents([(1, ""), (2, None)])).collect()} == {0.0}


def test_a_document_larger_than_the_gap(spark):
    """One document larger than all that is left, first in the order: the short ones still fill the target."""
    for long, others in ((40_000, 13_000), (30_000, 11_000)):  # over and under twice the gap
        rows = [(i, "a", "w " * 100) for i in range(300)] + [(1000, "a", "w " * long), (5000, "b", "w " * others), (5001, None, "w " * others)]
        rows += [(6000 + i, "a", "w " * (7 + i)) for i in range(5)]
        sized = spark.createDataFrame([(i, s, len(t.split())) for i, s, t in rows], "doc_id bigint, source string, size bigint")
        ahead = F.when(F.col("size") == long, 1e9).when(F.col("size") < 100, 1e-9).otherwise(1.0)
        got = [r for r in mixing.copies(sized, odds=ahead).collect() if r.source == "a"]
        certain = int(got[0].target / got[0].source_size)
        gap = got[0].target - sum(r.copies * r["size"] for r in got)
        assert sum(r["size"] for r in got) == got[0].source_size and len(got) == 306
        assert all(r.copies in (certain, certain + 1) for r in got)
        # no document that is left fits into the gap
        assert gap < min(r["size"] for r in got if r.copies == certain), (gap, got[0].target)
        assert abs(gap) <= 100 and got[0].target < long
