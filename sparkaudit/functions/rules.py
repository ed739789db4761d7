"""Declarative row filters of the rule file as Column predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = re.compile(r"^([A-Za-z_][\w.]*)\s*(>=|<=|==|!=|>|<)\s*(.+)$")


def where_predicate(where: str | None, columns: Sequence[str]) -> Column:
    """``a>=1 and b==x and contains:s`` as one predicate.

    All terms must hold. A number on the right compares as numbers, anything else as text.
    NULL, blank or unparsable cells make a term false.
    """
    if not where or not where.strip():
        return F.lit(True)
    terms = [_term(raw.strip(), columns) for raw in where.split(" and ")]
    return reduce(lambda a, b: a & b, terms)


def _term(raw: str, columns: Sequence[str]) -> Column:
    if raw.startswith("contains:"):
        needle = raw.split(":", 1)[1].strip()
        cells = F.array(*[F.col(c).cast("string") for c in columns])
        return F.coalesce(F.exists(cells, lambda c: F.contains(c, F.lit(needle))), F.lit(False))
    match = TERM.match(raw)
    if not match:
        raise ValueError(f"cannot parse where-term: {raw!r}")
    name, op, literal = match.group(1), match.group(2), match.group(3).strip()
    if literal[:1] in "\"'":
        literal = literal.strip("\"'")
    cell = F.col(name)
    try:
        number: float | None = float(literal)
    except ValueError:
        number = None
    side = cell.try_cast("double") if number is not None else cell.cast("string")
    other = F.lit(number if number is not None else literal)
    test = {
        ">=": side >= other, "<=": side <= other, "==": side == other, "!=": side != other,
        ">": side > other, "<": side < other,
    }[op]
    filled = cell.isNotNull() & (F.trim(cell.cast("string")) != "")
    return F.coalesce(filled & test, F.lit(False))
