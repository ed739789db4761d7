import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkaudit.llm import exact_dedup, simhash
from sparkaudit.llm.common import connected


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


CASES = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "A b"), (7, "A b"), (None, "a b"), (None, None), (8, "x" * 300_000), (9, "K")]


def test_exact_copies(documents):
    rows = {}
    got = exact_dedup.exact_copies(documents(CASES)).collect()
    groups = {}
    for i, t in CASES:
        groups.setdefault(lower(t), []).append(i)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in CASES)
    for r in got:
        rows.setdefault(r.text_sha256, []).append(r)
    assert len(rows) == len(groups)
    for text, ids in groups.items():
        of = rows[hashlib.sha256(text.encode()).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert len(of) == len(ids) and {r.keep_id for r in of} == {top} and {r.group_size for r in of} == {len(ids)}
        assert [r.doc_id for r in of if r.kept] == [top]
    kept = exact_dedup.deduplicate(documents(CASES))
    assert kept.columns == documents(CASES).columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 9]


def test_empty(documents):
    assert exact_dedup.exact_copies(documents([])).count() == 0
    assert simhash.near_duplicates(documents([])).count() == 0


def test_cuckoo_index():
    """Overflow, deletion and reinsertion against a set."""
    rng, index, live = random.Random(1), exact_dedup.CuckooIndex(2), set()
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for _ in range(20_000):
        key = rng.choice(keys)
        if key in live and rng.random() < 0.5:
            assert index.delete(key)
            live.discard(key)
        elif key not in live:
            index.insert(key)
            live.add(key)
    assert all((index.find(k) >= 0) == (k in live) for k in keys)
    assert all(index.keys[index.find(k)] == k for k in live)
    near = bytearray(keys[0])
    near[20] ^= 1  # the same fingerprint and buckets, another digest
    assert index.find(bytes(near)) == -1


def brute_fingerprint(text):
    words = [w for w in lower(text).encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    values = np.array(prints, np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("shard", [simhash.SHARD, 40])
def test_near_duplicates(documents, prose, shard):
    rng = random.Random(5)
    rows = [(None, "one two"), (70, None), (71, " \x0b\n"), (72, "ONE two"), (73, "solo"), (74, "x" * 200_000)]
    for n in range(250):
        text = prose(n % 170, 40 + n % 60)
        if n >= 170:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((1000 - n, text))
    rows += rows[-3:]
    got = simhash.near_duplicates(documents(rows), shard).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    expected = Counter(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints), strict=True))
    assert Counter(tuple(r) for r in got) == expected
    assert len({c for _, _, c in expected}) < len(expected)


@pytest.mark.parametrize("spread", [0, 3])
def test_links_of_trees(spark, spread):
    """Chains and dense balls of fingerprints, all shards small, against all pairs."""
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(0, 2**63, 300)]
    for v in values[:40]:
        for _ in range(rng.integers(1, 12)):
            for _ in range(rng.integers(1, 4 + spread)):
                v ^= 1 << int(rng.integers(0, 64))
            values.append(v)
    values = sorted({v & (2**64 - 1) for v in values})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    root = {r.node: r.root for r in connected(simhash.link_edges(table, 20)).collect()}
    assert [root.get(v, v) for v in signed] == brute_components(signed, values)


def test_one_of_each(documents, prose):
    text = prose(1, 80)
    rows = [(3, text), (2, text.upper()), (9, prose(2, 80)), (2, text)]
    kept = simhash.one_of_each(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9] and kept.columns == documents(rows).columns
