import itertools

import numpy as np
import pytest

from sparkaudit.llm import chat


def random_model(seed):
    rng = np.random.default_rng(seed)
    return chat.Model(rng.random(chat.STATES), rng.random((chat.STATES, chat.STATES)), [rng.random((chat.STATES, n)) for n in chat.SIZES])


def brute(model, looks):
    e = model.emission(looks)
    best = max(itertools.product(range(chat.STATES), repeat=len(looks)), key=lambda p: sum(e[i, s] + model.steps[p[i - 1] if i else chat.STATES, s] for i, s in enumerate(p)))
    return "".join(map(str, best))


TURNS = [(1, 0, "User: hi\nthere"), (1, 1, "### Assistant\nhello"), (1, 2, None), (2, 0, "a"), (2, 0, "b\nc"), (None, None, "Q: x"), (None, 5, "<|ai|> y"), (3, 7, "")]


@pytest.mark.parametrize("block", [64, 1])
def test_viterbi_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    model = random_model(block)
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id bigint, turn bigint, text string, block string")
    got = chat.recover(rows, model).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    for conv, members in by.items():
        members.sort(key=lambda r: (r.turn is not None, r.turn, r.text or ""))
        looks = np.concatenate([chat.seen(r.text) for r in members])
        assert "".join(r.states for r in members) == brute(model, looks), conv
    assert len(got) == len(TURNS)


def test_roles_and_rendering(spark, prose):
    turns = []
    for c in range(60):
        for t in range(4):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", prose(c * 9 + t, 6 if t % 2 == 0 else 120) + ("" if t % 2 == 0 else "\n" + prose(c, 100))))
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    transcripts = chat.as_transcripts(table)
    got = {(r.conv_id, r.turn): r for r in chat.recover(transcripts.drop("role"), chat.learn(transcripts)).collect()}
    right = sum(got[c, t].role == role for c, t, role, _ in turns)
    assert right / len(turns) > 0.98
    first = got[5, 0]
    assert first.rendered == f"<|end|>\n<|user|>\n{turns[20][3]}\n"


def test_markers():
    assert [chat.marker(x)[0] for x in ("User: a", "**Assistant:** b", "### Human", "[AI] c", "<|system|>", "a plain line", "Question and more")] == [2, 3, 2, 3, 1, 0, 0]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.recover(empty, chat.learn(empty)).count() == 0
