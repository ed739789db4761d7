import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud paper green seven house light under over table chair north ocean quick brown".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words): reproducible text."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", ","]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows of (doc_id, text)): a table with all columns of documents and clashing ones."""

    def make(rows):
        wide = [(i, t, "en", f"src{n % 3}" if n % 5 else None, None if t is None else len(t), 1, "x", True, 0.5) for n, (i, t) in enumerate(rows)]
        kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, digest string, kept boolean, s double"
        return spark.createDataFrame(wide, kinds)

    return make
