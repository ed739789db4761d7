import random
import zlib

import numpy as np
import pytest

from sparkaudit.llm import quality, rules


def table(spark, prose, n=600):
    """Clean prose, and junk of four styles with label 0."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        text, bad = prose(i, 60 + i % 50), i % 4 == 0
        if bad:
            words = text.split()
            style = i // 4 % 4
            text = " | ".join(words) if style == 0 else " ".join(w + "%%%" for w in words) if style == 1 else " ".join(w.upper() + "!!" for w in words) if style == 2 else " ".join(w for w in words for _ in range(8))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    rows += [(5000, None), (5001, ""), (None, prose(1, 50)), (5002, "w" * 200_000), (0, rows[0][1])]
    labels += [(None, 1), (7, None), (9, 1), (9, 1), (77777, 0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*x, "a") for x in labels], "doc_id bigint, quality bigint, text string")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_classifier(spark, documents, prose):
    rows, labels = table(spark, prose)
    docs = documents(rows)
    got = quality.classify(docs, labels).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    tested = [(r.predicted, r.doc_id % 4 != 0) for r in got if r.held_out and r.doc_id < 600]
    assert len(tested) > 100 and np.mean([p == y for p, y in tested]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_scores_are_sparse_dot_products(prose):
    texts = [prose(i, 30).encode() for i in range(5)] + [b"", b"\n", b"One"]
    weights = np.random.default_rng(0).normal(size=1 << quality.DIMENSION_BITS)
    plain = [weights[a] @ v + 0.5 for a, v in quality.features(texts)]
    assert np.allclose(quality.dot(texts, weights, 0.5), plain)
    assert plain[5] == plain[6] == 0.5


def test_held_out_labels_do_not_matter(spark, documents, prose):
    rows, labels = table(spark, prose, 120)
    docs = documents(rows)
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality")
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.classify(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality bigint")
    assert [r.score for r in quality.classify(documents([(1, "a b")]), none).collect()] == [0.5]
    assert quality.classify(documents([]), none).count() == 0
    assert [r.kept for r in rules.judge(rules.statistics(documents([(1, "a b"), (2, "a b c d e f g h i j k")])), none).orderBy("doc_id").collect()] == [False, True]


def brute_counts(text):
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = [any(windows[tuple(words[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(words) - 5) + 1)) for i in range(len(words))]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(inside)


def test_counts():
    rng = random.Random(6)
    pieces = ["a ", "b ", "é\x0b", "c\n", "\n", "#x", "\x1c ", "\x85", " d ", "€ ", "\r"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(70)))
        assert rules.counts_of(text.encode())[:5] == brute_counts(text), text


def test_rules(spark, documents, prose):
    rows, labels = table(spark, prose)
    stats = rules.statistics(documents(rows))
    learned = rules.learn(stats, labels)
    assert learned and all(len(r) <= rules.MOST_CONDITIONS for r in learned)
    got = rules.judge(stats, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    clean = [r.kept for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 4]
    junk = [r.kept for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 4 == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.05


@pytest.mark.parametrize("seed", range(3))
def test_covering_finds_a_planted_rule(seed):
    rng = np.random.default_rng(seed + 100)
    values = {k: rng.random(3000) for k in ("symbols_per_word", "upper_share", "digit_share")}
    bad = (values["symbols_per_word"] > 0.7) & (values["upper_share"] < 0.4)
    found = rules.cover(values, bad, seed)
    rejected = np.zeros(3000, bool)
    for rule in found:
        rejected |= rules._covers(rule, values, 3000)
    assert (rejected & bad).sum() / bad.sum() > 0.9 and (rejected & ~bad).sum() / (~bad).sum() < 0.02
