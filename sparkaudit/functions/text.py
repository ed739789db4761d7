"""Text expressions. All of them are row-local: a document never leaves its row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space outside ASCII, and the patterns that define each check.
WIDE_SPACES = "\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"\S+"
HYPHEN_WORD = r"[A-Za-z][A-Za-z-]*"
DOUBLED_WORD = r"(?iu)(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)(?=\s+\1(?![\p{L}\p{N}_]))"
DOUBLE_SPACE = r"[A-Za-z] {2,}[A-Za-z]"
SPACE_BEFORE_PUNCTUATION = r"\s+[.,]"
NULL_WORDS = r"\b(?:NaN|None|undefined)\b"
VERSION_TAG = r"\bv1[0-9]\b"
PLACEHOLDER_BRACKET = r"(?i)\[(?:Author|Affiliation|Institution|email|Corresponding|funding)"
THOUSANDS_COMMA = r"[0-9],[0-9]{3}"
PLACEHOLDER = (
    r"(?i)\bTODO\b|\bTBD\b|\bFIXME\b|\bXXX\b|YOUR_[A-Z_]+|\u5f85\u5b9a|\u5f85\u56de\u586b|\[DOI[^\]]*\]|\(DOI to be inserted[^)]*\)|"
    r"to be supplied|to be inserted"
)
BARE_REFERENCE = r"(?<!Supplementary )(?<!supplementary )(?<!Supplemental )(?<!and )\b(?:Table|Figure)s? S\d+"
VARIANT_SPELLING = r"\bSupplemental\b"
ESCAPE_RESIDUE = r"\\u[0-9a-fA-F]{4}"
MARKUP_TAG = r"</?(?:i|b|sub|sup|em|strong)>"
GLUED_ACCESSION = r"GSE\d{7,}"
CJK = "[\\u4e00-\\u9fff]"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ROLE_EMAIL = (
    r"(?i)nlm|ncbi|elsevier|springer|wiley|oup\b|oxford|bentham|frontiers|thieme|karger|sagepub|tandf|informa|"
    r"biomedcentral|plos|nature\.com|science\.org|submission|editorial|permissions|reprints?@|journals?@|support@|help@"
)
IDENTIFIERS = (
    r"https?://[^\s]+",
    r"10\.\d{4,9}/[^\s]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"\bv?\d+\.\d+\.\d+(?:\.\d+)*\b",
)
NUMBER = r"\d[\d,.]*\d|\d"
DECIMAL = r"\d+\.\d+"
JUNK_CELLS = ("nan", "none", "na", "#n/a", "null")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside an expression.

    An outer expression that is read inside a lambda runs again for every element; a bound one runs once.
    """
    return F.get(F.transform(F.array(value), use), 0)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count_literal(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")


def word_count(text: Column, mode: str = "tokens") -> Column:
    """``tokens``: whitespace tokens; ``words``: letters with inner hyphens. The two differ by design."""
    if mode == "tokens":
        return count_matches(plain_spaces(text), TOKEN)
    if mode == "words":
        return count_matches(text, HYPHEN_WORD)
    raise ValueError(f"unknown mode {mode}")


def plain_spaces(text: Column) -> Column:
    """Unicode white space to blanks; ASCII text is left alone. Unicode classes in a pattern cost far more."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(F.translate(text, WIDE_SPACES, " " * len(WIDE_SPACES)))


def flatten_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(plain_spaces(text), r"\s+", " "))


def lower_words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(plain_spaces(text)), r"\s+"), lambda w: w != "")


def sentences(text: Column, stops: str = ".;") -> Column:
    return F.filter(F.split(text, rf"(?<=[{stops}])\s+"), lambda s: s != "")


def mask_identifiers(text: Column, mask: str = " ") -> Column:
    """Blank out URLs, DOIs, UUIDs and version strings, which would look like numeric ranges."""
    for pattern in IDENTIFIERS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def normalize_url(url: Column) -> Column:
    """Without scheme, ``www.``, query, fragment and closing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[#?].*$", ""), r"/+$", "")


def emails(text: Column) -> Column:
    """Distinct, sorted addresses without publisher and role addresses."""
    nothing = F.array().cast("array<string>")
    found = F.when(F.contains(text, F.lit("@")), all_matches(text, EMAIL)).otherwise(nothing)
    return F.array_sort(F.array_distinct(F.filter(found, lambda m: ~m.rlike(ROLE_EMAIL))))


def redact(text: Column, literals: Sequence[tuple[str, str]], regexes: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in order, then regular-expression replacements in order."""
    for old, new in literals:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, new in regexes:
        text = let(text, _replacement(pattern, new))
    return text


def _replacement(pattern: str, new: str) -> Callable[[Column], Column]:
    return lambda t: _guarded(t, pattern, F.regexp_replace(t, pattern, new), t)


def _guarded(text: Column, pattern: str, work: Column, otherwise: Column) -> Column:
    """Skip a costly pattern where a character that it needs is absent."""
    return F.when(F.contains(text, F.lit("@")), work).otherwise(otherwise) if pattern == EMAIL else work


def residue(text: Column, literals: Sequence[tuple[str, str]], regexes: Sequence[tuple[str, str]]) -> Column:
    """What a second scan still finds."""
    nothing = F.array().cast("array<string>")
    left = [F.when(F.contains(text, F.lit(old)), F.array(F.lit(old))).otherwise(nothing) for old, _ in literals if old]
    left += [_guarded(text, pattern, all_matches(text, pattern), nothing) for pattern, _ in regexes]
    return F.flatten(F.array(*left))


def keyword_in_context(text: Column, term: str, width: int = 20) -> Column:
    """Every occurrence of a literal, with up to ``width`` characters on both sides (they may overlap)."""
    none = F.array().cast("array<string>")

    def contexts(flat: Column) -> Column:
        occurrences = F.size(F.split(flat, rf"\Q{term}\E")) - 1
        starts = F.transform(
            F.sequence(F.lit(1), F.greatest(occurrences, F.lit(1))),
            lambda i: F.length(F.call_function("substring_index", flat, F.lit(term), i)),
        )
        return F.transform(
            starts,
            lambda s: F.substring(
                flat, F.greatest(s - width, F.lit(0)) + 1, F.least(s, F.lit(width)) + len(term) + width
            ),
        )

    def search(flat: Column) -> Column:
        return F.when(F.contains(flat, F.lit(term)), contexts(flat)).otherwise(none)

    return let(flatten_ws(text), search)


def numbers(text: Column) -> Column:
    """Numbers of at least two digits, or with a decimal point, commas removed."""
    found = F.transform(all_matches(text, NUMBER), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 2) | F.contains(x, F.lit("."))))


def shares_no_script(text: Column, block: str = CJK) -> Column:
    return ~text.rlike(block)
