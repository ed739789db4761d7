"""Chat formatting: roles of transcript lines by a hidden Markov model, then one canonical form of turns.

A transcript is lines in order, here as rows (conv_id, turn, text) of one or more lines each. The states are role and place
in a turn (its first line or a later one). A line is seen by its speaker marker, its length, whether it is blank and
whether a blank line came before. Start, transition and feature probabilities are counts of labelled turns, smoothed
by one. Viterbi gives the most likely states; lines are then rendered as ``<|role|>``, the text without markers, ``<|end|>``.

Viterbi is a product of (max, +) matrices, which is associative, so a long conversation is no long task: every row becomes
a matrix, ``BLOCK`` rows of a conversation a block's matrix, and only the blocks' small matrices pass one after the other
to find the best state at each border. Each block then fills in its own rows between its two border states.

Defined results: NULL text is one blank line; NULL roles are not learned from; rows that share conv_id and turn are ordered
by their text; a NULL conv_id is a conversation and a NULL turn comes first in it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded, same_keys, settle

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2, + 1 inside a turn
BLOCK = 64

#: The words that name a speaker, by role.
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "gpt", "model"),
}
_ROLE_OF = {w: i for i, r in enumerate(ROLES) for w in SPEAKERS[r]}
_WORD = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"[ \t]*(?:<\|(?:im_start\|>)?({_WORD})(?:\|>)?[ \t]*|#+[ \t]*({_WORD})[ \t]*:?[ \t]*$|\**({_WORD})\**[ \t]*:\**[ \t]*|\[({_WORD})\][ \t]*:?[ \t]*)", re.I)
LENGTHS = (1, 40, 120, 240, 480, 960)
#: Values of the three features: marker (none or a role's), length step, blank line before.
SIZES = (len(ROLES) + 1, len(LENGTHS) + 1, 2)


def marker(line: str) -> tuple[int, int]:
    """The role (from 1, 0 for none) that a line's speaker marker names, and the marker's length."""
    m = MARKER.match(line)
    if not m:
        return 0, 0
    return 1 + _ROLE_OF[next(g for g in m.groups() if g).lower()], m.end()


def seen(text: str | None) -> np.ndarray:
    """The features of the lines of a row. The row before counts as not blank."""
    lines = (text or "").split("\n")
    size = [len(line.strip()) for line in lines]
    return np.array([(marker(line)[0], int(np.searchsorted(LENGTHS, n, side="right")), i > 0 and size[i - 1] == 0) for i, (line, n) in enumerate(zip(lines, size, strict=True))], np.int64)


class Model:
    """Log probabilities: start (S), transition (S, S), and each feature (S, values)."""

    def __init__(self, start: np.ndarray, steps: np.ndarray, features: list[np.ndarray]):
        # one more state, the last, before the first line
        self.steps = np.full((STATES + 1, STATES + 1), -np.inf)
        self.steps[:STATES, :STATES] = np.log(steps / steps.sum(1, keepdims=True))
        self.steps[STATES, :STATES] = np.log(start / start.sum())
        self.features = [np.log(f / f.sum(1, keepdims=True)) for f in features]

    def entry(self) -> np.ndarray:
        out = np.full(STATES + 1, -np.inf)
        out[STATES] = 0
        return out

    def emission(self, rows: np.ndarray) -> np.ndarray:
        out = np.full((len(rows), STATES + 1), -np.inf)
        out[:, :STATES] = sum(f[:, rows[:, i]].T for i, f in enumerate(self.features))
        return out

    def product(self, rows: np.ndarray) -> np.ndarray:
        """(max, +) product over lines: best weight from the state before the first line to that of the last."""
        out = None
        for e in self.emission(rows):
            step = self.steps + e
            out = step if out is None else (out[:, :, None] + step[None]).max(1)
        return out

    def path(self, rows: np.ndarray, before: int, last: int) -> list[int]:
        """The best states of lines, given the state before them and that of the last line."""
        emission = self.emission(rows)
        best = emission[0] + self.steps[before]
        back = []
        for e in emission[1:]:
            all_ = best[:, None] + self.steps
            back.append(all_.argmax(0))
            best = all_.max(0) + e
        states = [last]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def learn(labelled: DataFrame) -> Model:
    """Counts over (conv_id, turn, role, text). Only tables of states and features come to the driver."""
    role = F.when(F.col("role").isin(*ROLES), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1).cast("int")
    turns = labelled.select("conv_id", "turn", role.alias("r"), "text").where("r IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((STATES, sum(SIZES) + 1), np.int64)
            for r, text in zip(batch.column("r").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = seen(text)
                state = 2 * r + (np.arange(len(rows)) > 0)
                for i, low in enumerate(np.cumsum((0, *SIZES[:-1]))):
                    np.add.at(table, (state, low + rows[:, i]), 1)
                table[2 * r : 2 * r + 2, -1] += (len(rows) > 1, max(0, len(rows) - 2))  # to a later line, from the first and from later ones
            at = np.argwhere(table)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(table[at[:, 0], at[:, 1]])], ["state", "value", "n"])

    counted = bounded(turns.select("r", "text")).mapInArrow(count, "state int, value int, n bigint").groupBy("state", "value").agg(F.sum("n").alias("n"))
    table = np.zeros((STATES, sum(SIZES) + 1))
    for row in counted.collect():
        table[row.state, row.value] = row.n
    one = turns.groupBy("conv_id", "turn").agg(F.min("r").alias("r"))
    after = one.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    pairs = {(r.r, r.next): r.n for r in one.join(after, ["conv_id", "turn"]).groupBy("r", "next").agg(F.count("*").alias("n")).collect()}
    begins = {r.r: r.n for r in one.where("turn = 0").groupBy("r").agg(F.count("*").alias("n")).collect()}
    start = np.full(STATES, 1e-6)
    start[::2] = [1 + begins.get(r, 0) for r in range(len(ROLES))]
    steps = np.full((STATES, STATES), 1e-6)
    for r in range(len(ROLES)):
        turn_ends = np.array([1 + pairs.get((r, k), 0) for k in range(len(ROLES))], float)
        for place in (0, 1):
            inside = table[2 * r + place, -1] + 1
            # all of a turn's lines but its last are followed by a later one
            leave = turn_ends * max(1.0, table[2 * r + place, : SIZES[0]].sum() - inside) / turn_ends.sum()
            steps[2 * r + place, 2 * r + 1] = inside
            steps[2 * r + place, ::2] = leave
    low = np.cumsum((0, *SIZES))
    return Model(start, steps, [table[:, low[i] : low[i + 1]] + 1 for i in range(len(SIZES))])


KEYS = "conv_id bigint, block bigint, before int, last int"


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.asc_nulls_first("turn"), "text")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Sorted rows by key."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != current:
                yield current, rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield current, rows


def recover(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, text, role, states, rendered), one row per row of ``transcripts`` (conv_id, turn, text).

    states has a digit for each line; role is that of the row's first line; rendered rows laid together are the transcript.
    """
    rows = bounded(transcripts).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("text").cast("string").alias("text")
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), members in _groups(batches, ("conv_id", "block")):
            product = model.product(np.concatenate([seen(r["text"]) for r in members]))
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "block": pa.array([block], pa.int64()), "product": [product.tobytes()]})

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), members in _groups(batches, ("conv_id",)):
            products = [np.frombuffer(m["product"]).reshape(STATES + 1, STATES + 1) for m in members]
            best, back = model.entry(), []
            for product in products:
                all_ = best[:, None] + product
                back.append(all_.argmax(0))
                best = all_.max(0)
            last = [int(best.argmax())]
            for b in reversed(back):
                last.append(int(b[last[-1]]))
            last = last[::-1]
            yield pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([conv] * len(members), pa.int64()), "block": pa.array([m["block"] for m in members], pa.int64()),
                 "before": pa.array(last[:-1], pa.int32()), "last": pa.array(last[1:], pa.int32())}
            )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _groups(batches, ("conv_id", "block")):
            looks = [seen(r["text"]) for r in members]
            states = model.path(np.concatenate(looks), members[0]["before"], members[0]["last"])
            out, at = [], 0
            for row, look in zip(members, looks, strict=True):
                mine = states[at : at + len(look)]
                at += len(look)
                out.append({**{k: row[k] for k in ("conv_id", "turn", "text")}, "role": ROLES[mine[0] // 2], "states": "".join(map(str, mine)), "rendered": render(row["text"], mine)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("role", pa.string()), ("states", pa.string()), ("rendered", pa.string())]))

    products = _in_blocks(rows).mapInArrow(multiply, "conv_id bigint, block bigint, product binary")
    edges = settle(products.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(borders, KEYS))
    met = same_keys(rows, edges, ["conv_id", "block"])
    return _in_blocks(met).mapInArrow(fill, "conv_id bigint, turn bigint, text string, role string, states string, rendered string")


def render(text: str | None, states: list[int]) -> str:
    """Lines with their states in canonical form: a turn opens at its first line and closes where the next one opens."""
    out = []
    for line, state in zip((text or "").split("\n"), states, strict=True):
        if state % 2 == 0:
            line = line[marker(line)[1] :]
            out.append(f"<|end|>\n<|{ROLES[state // 2]}|>\n")
        if line.strip():
            out.append(line.rstrip() + "\n")
    return "".join(out)


def as_transcripts(turns: DataFrame) -> DataFrame:
    """``conversations`` as plain transcripts: markers in one of three styles by conversation, and left out of a quarter of the turns."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    name = F.initcap("role")
    open_ = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit("\n"))).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    text = F.concat(F.when(bare | F.col("role").isNull(), F.lit("")).otherwise(open_), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", text.alias("text"))
