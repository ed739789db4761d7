import hashlib
import random

import numpy as np
import pytest

from sparkaudit.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 6])
def test_like_the_library(ranks, library, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    tokenizer, rng = bpe.Tokenizer(ranks, public_tokenizers.PATTERN), random.Random(leaf)
    chars = "abcdeéßзд中文😀  \n0123!'s \x00"
    for _ in range(1500):
        some = chars[: rng.randrange(2, len(chars))]
        text = "".join(rng.choice(some) for _ in range(rng.randrange(200)))
        ids = tokenizer.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert tokenizer.decode(ids) == text.encode()
    for text in ("a" * 9_000, "".join(rng.choice("etaoinshr") for _ in range(9_000)), "<|endoftext|>", "é" * 4_999):
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    for text in ("a" * 20_001, "".join(rng.choice("etaoinshr") for _ in range(60_000)), "ab" * 20_000):
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.merge_long(text.encode())


def test_join_is_associative(ranks):
    tokenizer, rng = bpe.Tokenizer(ranks, public_tokenizers.PATTERN), random.Random(0)
    for _ in range(500):
        parts = [bytes(rng.choice(b"thingedraon") for _ in range(rng.randrange(1, 9))) for _ in range(3)]
        a, b, c = map(tokenizer.merge, parts)
        assert tokenizer.join(tokenizer.join(a, b), c) == tokenizer.join(a, tokenizer.join(b, c)) == tokenizer.merge_anew(b"".join(parts))


def test_round_trip(documents, ranks, library, prose):
    rows = [(1, None), (2, ""), (None, "x é\n"), (3, prose(1, 300)), (3, prose(1, 300)), (4, "ab" * 9_000)]
    got = bpe.round_trip(documents(rows), ranks, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(documents([]), ranks, public_tokenizers.PATTERN).count() == 0
