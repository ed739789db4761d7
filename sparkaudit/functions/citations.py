"""Citation tokens, table/figure mentions and their renumbering, inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkaudit.functions.text import all_matches, let

# Token formats.
CITATION = r"\[(\d+(?:\s*[,–-]\s*\d+)*)\]"
RANGE_OR_NUMBER = r"^\d+(?:\s*[–-]\s*\d+)?$"
ITEM = r"S?\d+(?:\s*[–-]\s*S?\d+)?(?![\dS])"
MENTION = rf"\b(?:Table|Figure)s\s+{ITEM}(?:(?:\s*,\s*(?:and\s+)?|\s+and\s+){ITEM})*|\b(?:Table|Figure)\s+{ITEM}"
CAPTION = r"^(Table|Figure)\s+(S?)(\d+)\."
REFERENCE_LINE = r"^\s*(\d+)\.\s+(.*)$"
REFERENCE_HEADING = "## References"
SYMBOLIC_KEY = r"\[\[([^\[\]]+)\]\]|⟪([^⟪⟫]+)⟫"
# A range of a million numbers or more is no range of references: it stays text and is reported by implausible_ranges.
IMPLAUSIBLE_WIDTH = 1_000_000


def _span(a: Column, b: Column) -> Column:
    """All whole numbers from a to b in either order; nothing for an implausible range."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    whole = F.sequence(lo, F.least(hi, F.try_add(lo, F.lit(IMPLAUSIBLE_WIDTH))))
    return F.when(hi - lo < IMPLAUSIBLE_WIDTH, whole).otherwise(F.array().cast("array<bigint>"))


def _is_implausible(token: Column) -> Column:
    """Whether a token holds a range of a million numbers or more, or a number that 64 bits cannot hold."""

    def wide(part: Column) -> Column:
        ends = F.transform(all_matches(part, r"\d+"), lambda d: d.try_cast("bigint"))
        return F.coalesce(let(ends, lambda e: F.abs(F.element_at(e, 1) - F.element_at(e, -1)) >= IMPLAUSIBLE_WIDTH), F.lit(True))

    return F.exists(F.split(token, ","), wide)


def implausible_ranges(text: Column) -> Column:
    """Citation tokens of the body that are left as they are, because no reference list is that long."""
    return F.filter(all_matches(body_of(text), CITATION), _is_implausible)


def expand_ranges(token: Column) -> Column:
    """``"9,10, 21–50"`` to an array of numbers; hyphen and en-dash; reversed ends are swapped."""

    def part(p: Column) -> Column:
        ends = F.transform(F.split(p, r"\s*[–-]\s*"), lambda d: d.try_cast("bigint"))
        return F.when(p.rlike(RANGE_OR_NUMBER), let(ends, lambda e: _span(F.get(e, 0), F.element_at(e, -1)))).otherwise(
            F.array().cast("array<bigint>")
        )

    # A number too long for 64 bits cannot be a reference number; it expands to nothing.
    whole = F.flatten(F.transform(F.split(token, ","), lambda p: part(F.trim(p))))
    return F.filter(whole, lambda n: n.isNotNull())


def collapse_ranges(numbers: Column, dash: str = "–") -> Column:
    """Sorted distinct numbers as text, runs of consecutive numbers as ``a–b``."""

    def runs(flat: Column) -> Column:
        """Pair the first and last members of the runs, found by their neighbours in the sorted list."""
        starts = F.filter(flat, lambda x, i: (i == 0) | (F.get(flat, i - 1) < x - 1))
        ends = F.filter(flat, lambda x, i: F.coalesce(F.get(flat, i + 1) > x + 1, F.lit(True)))
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.when(a == b, a.cast("string")).otherwise(
                F.concat(a.cast("string"), F.lit(dash), b.cast("string"))
            ),
        )

    return F.array_join(let(F.array_sort(F.array_distinct(numbers)), runs), ",")


def body_of(text: Column, heading: str = REFERENCE_HEADING) -> Column:
    return F.substring_index(text, heading, 1)


def reference_section(text: Column, heading: str = REFERENCE_HEADING) -> Column:
    """Text after the first heading; empty when the heading is absent."""
    at = F.instr(text, heading)
    return F.when(at > 0, F.substring(text, at + len(heading), F.length(text))).otherwise(F.lit(""))


def citation_numbers(text: Column) -> Column:
    """Every cited number in reading order, ranges expanded, repeats kept."""
    return F.flatten(F.transform(all_matches(body_of(text), CITATION, 1), lambda t: expand_ranges(t)))


def reference_entries(text: Column) -> Column:
    """``array<struct<ref_no, entry>>`` of the numbered lines below the reference heading."""
    lines = F.filter(F.split(reference_section(text), "\n"), lambda s: s.rlike(REFERENCE_LINE))
    return F.transform(
        lines,
        lambda s: F.struct(
            F.regexp_extract(s, REFERENCE_LINE, 1).try_cast("bigint").alias("ref_no"),
            F.regexp_extract(s, REFERENCE_LINE, 2).alias("entry"),
        ),
    )


def _item_class(token: Column, item: Column) -> Column:
    """Table or Figure from the token, S from the item itself: ``Tables 4 and S5`` has one of each."""
    kind = F.regexp_replace(token, r"s?\s.*$", "")
    return F.when(item.startswith("S"), F.concat(kind, F.lit(" S"))).otherwise(kind)


def _token_mentions(token: Column) -> Column:
    def items(whole: Column) -> Column:
        return F.flatten(
            F.transform(
                all_matches(token, ITEM),
                lambda i: let(
                    F.transform(all_matches(i, r"\d+"), lambda d: d.try_cast("bigint")),
                    lambda ends: F.transform(
                        _span(F.element_at(ends, 1), F.element_at(ends, -1)),
                        lambda n: F.struct(_item_class(whole, i).alias("class"), n.alias("num")),
                    ),
                ),
            )
        )

    return let(token, items)


def mentions(text: Column) -> Column:
    """``array<struct<class, num>>`` in reading order.

    Four classes: Table, Table S, Figure, Figure S. ``Table S13`` is never ``Table 13``; plural
    forms carry conjunctions and ranges, and each item has the class of its own ``S``.
    """
    return F.flatten(F.transform(all_matches(text, MENTION), _token_mentions))


def captions(text: Column) -> Column:
    """``array<struct<class, num>>`` of the paragraphs that open with ``Table 3.`` and the like."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.trim(p).rlike(CAPTION))
    return F.transform(
        lines,
        lambda p: F.struct(
            F.concat(
                F.regexp_extract(F.trim(p), CAPTION, 1),
                F.when(F.regexp_extract(F.trim(p), CAPTION, 2) == "S", F.lit(" S")).otherwise(F.lit("")),
            ).alias("class"),
            F.regexp_extract(F.trim(p), CAPTION, 3).try_cast("bigint").alias("num"),
        ),
    )


def of_class(pairs: Column, label: str) -> Column:
    return F.transform(F.filter(pairs, lambda m: m["class"] == label), lambda m: m["num"])


def descents(order: Column) -> Column:
    """Neighbours of a sequence where the number falls, as ``a>b``."""

    def fall(seq: Column) -> Column:
        return F.transform(
            seq,
            lambda x, i: F.when(
                (i > 0) & (F.get(seq, i - 1) > x),
                F.concat(F.get(seq, i - 1).cast("string"), F.lit(">"), x.cast("string")),
            ),
        )

    return F.filter(let(order, fall), lambda s: s.isNotNull())


def renumber_map(mentioned: Column, listed: Column | None = None) -> Column:
    """Old to new number by first mention; listed but unmentioned numbers follow in list order."""
    order = F.array_distinct(mentioned)
    if listed is not None:
        order = F.array_union(order, listed)
    pairs = F.transform(order, lambda n, i: F.struct(n.alias("old"), (i + 1).cast("bigint").alias("new")))
    return F.map_from_entries(pairs)


def replace_tokens(text: Column, pattern: str, render) -> Column:
    """Rewrite every match in one pass, so a renaming cycle cannot collide."""
    pieces = F.split(text, pattern)
    new = F.transform(all_matches(text, pattern, 0), render)
    return F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def renumber_citations(text: Column, mapping: Column) -> Column:
    """Body citations through the map; the reference section and implausible ranges are left as they are."""

    def render(token: Column) -> Column:
        old = expand_ranges(F.regexp_extract(token, CITATION, 1))
        new = F.transform(old, lambda n: F.coalesce(F.try_element_at(mapping, n), n).cast("string"))
        return F.when(_is_implausible(token), token).otherwise(F.concat(F.lit("["), F.array_join(new, ","), F.lit("]")))

    body = body_of(text)
    return F.concat(replace_tokens(body, CITATION, render), F.substring(text, F.length(body) + 1, F.length(text)))


def renumber_mentions(text: Column, mapping: Column, label: str, old_max: Column, new_max: Column) -> Column:
    """Mentions of one class through the map.

    A range over the whole old list becomes the whole new list; any other range maps its ends and
    sorts them; every number of a conjunction is mapped.
    """

    def number(d: Column) -> Column:
        n = d.try_cast("bigint")
        return F.coalesce(F.try_element_at(mapping, n), n)

    def item(i: Column) -> Column:
        mark = F.when(i.startswith("S"), F.lit("S")).otherwise(F.lit(""))
        ends = all_matches(i, r"\d+")
        a, b = F.element_at(ends, 1), F.element_at(ends, -1)
        whole = (a.try_cast("bigint") == 1) & (b.try_cast("bigint") == old_max)
        lo = F.when(whole, F.lit(1).cast("bigint")).otherwise(F.least(number(a), number(b)))
        hi = F.when(whole, new_max).otherwise(F.greatest(number(a), number(b)))
        return F.when(F.size(ends) == 1, F.concat(mark, number(a).cast("string"))).otherwise(
            F.concat(mark, lo.cast("string"), F.lit("–"), mark, hi.cast("string"))
        )

    def token(t: Column) -> Column:
        return replace_tokens(t, ITEM, lambda i: F.when(_item_class(t, i) == label, item(i)).otherwise(i))

    return replace_tokens(text, MENTION, token)


def symbolic_keys(text: Column) -> Column:
    """Keys of ``[[a]]`` / ``⟪a;b⟫`` tokens in order of first appearance."""
    tokens = all_matches(text, SYMBOLIC_KEY, 0)
    keys = F.flatten(F.transform(tokens, _token_keys))
    return F.array_distinct(keys)


def _token_keys(token: Column) -> Column:
    inner = F.regexp_replace(token, "[\\[\\]⟪⟫]", "")
    return F.filter(F.transform(F.split(inner, "[;,]"), lambda k: F.trim(k)), lambda k: k != "")


def number_keys(text: Column, known: Column | None = None) -> Column:
    """Symbolic tokens to numbers by first appearance; blocks become ranges; unknown keys vanish."""

    def rewrite(order: Column) -> Column:
        def render(token: Column) -> Column:
            nums = F.filter(
                F.transform(_token_keys(token), lambda k: F.array_position(order, k).cast("bigint")), lambda n: n > 0
            )
            return let(
                nums,
                lambda v: F.when(F.size(v) > 0, F.concat(F.lit("["), collapse_ranges(v), F.lit("]"))).otherwise(F.lit("")),
            )

        return replace_tokens(text, SYMBOLIC_KEY, render)

    order = symbolic_keys(text)
    return let(F.array_intersect(order, known) if known is not None else order, rewrite)
