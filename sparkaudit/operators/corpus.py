"""Documents as relations: paragraphs, sections, findings and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import citations as C
from sparkaudit.functions import text as X
from sparkaudit.session import evaluate_once

FINDING_COLUMNS = ("doc_id", "check", "status", "severity", "n", "detail", "evidence")


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, para_no, text); empty paragraphs keep their number."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("para_no", "text"))


def union_corpus(*parts: DataFrame) -> DataFrame:
    """Body, cells and supplement scanned as one relation."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


@dataclass(frozen=True)
class Check:
    """A named check: ``count`` findings per document, ``evidence`` for the reader."""

    name: str
    count: Callable[[Column], Column]
    evidence: Callable[[Column], Column] | None = None
    severity: str = "FAIL"


def _pattern(name: str, pattern: str, severity: str = "FAIL") -> Check:
    return Check(
        name,
        lambda t: X.count_matches(t, pattern),
        lambda t: F.array_distinct(X.all_matches(t, pattern)),
        severity,
    )


HYGIENE: tuple[Check, ...] = (
    Check("unclosed_bold", lambda t: X.count_literal(t, "**") % 2),
    Check("na_artifact", lambda t: X.count_literal(t, "NA (")),
    _pattern("doubled_words", X.DOUBLED_WORD, "WARN"),
    _pattern("double_spaces", X.DOUBLE_SPACE, "WARN"),
    _pattern("space_before_punctuation", X.SPACE_BEFORE_PUNCTUATION, "WARN"),
    Check("paren_balance", lambda t: F.abs(X.count_literal(t, "(") - X.count_literal(t, ")"))),
    Check("bracket_balance", lambda t: F.abs(X.count_literal(t, "[") - X.count_literal(t, "]"))),
    _pattern("null_words", X.NULL_WORDS),
    _pattern("version_tags", X.VERSION_TAG),
    _pattern("placeholder_brackets", X.PLACEHOLDER_BRACKET),
    _pattern("thousands_commas", X.THOUSANDS_COMMA, "INFO"),
)


def hygiene_counts(
    docs: DataFrame, checks: Sequence[Check] = HYGIENE, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per document and one count per check, in a single scan without a shuffle."""
    t = F.col(text)
    return docs.select(F.col(doc_id).alias("doc_id"), *keep, *[c.count(t).cast("bigint").alias(c.name) for c in checks])


def counts_to_findings(counts: DataFrame, checks: Sequence[Check] = HYGIENE) -> DataFrame:
    """Wide counts to the findings relation; a count of zero passes."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check"),
                F.when(F.col(c.name).isNull(), "NOT_RUN")
                .when(F.col(c.name) == 0, "PASS")
                .otherwise(c.severity)
                .alias("status"),
                F.lit(c.severity).alias("severity"),
                F.col(c.name).alias("n"),
                F.concat(F.col(c.name).cast("string"), F.lit(" " + c.name)).alias("detail"),
                F.array().cast("array<string>").alias("evidence"),
            )
            for c in checks
        ]
    )
    return evaluate_once(counts, **{c.name: F.col(c.name) for c in checks}).select("doc_id", F.inline(rows))


def run_checks(docs: DataFrame, checks: Sequence[Check], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings with evidence for any registered checks."""
    t = F.col(text)
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check"),
                F.lit(c.severity).alias("severity"),
                c.count(t).cast("bigint").alias("n"),
                (c.evidence(t) if c.evidence else F.array().cast("array<string>")).alias("evidence"),
            )
            for c in checks
        ]
    )
    flat = docs.select(F.col(doc_id).alias("doc_id"), F.inline(rows))
    status = F.when(F.col("n").isNull(), "NOT_RUN").when(F.col("n") == 0, "PASS").otherwise(F.col("severity"))
    return flat.select(
        "doc_id", "check", status.alias("status"), "severity", "n",
        F.concat_ws(" ", F.col("n").cast("string"), F.col("check")).alias("detail"), "evidence",
    )


def verdict(findings: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """Per document: failures, PASS/FAIL, the failing checks, and the expected checks that did not run.

    It never says "ready": only which checks ran and what they found.
    """
    ran = F.array_sort(F.collect_set(F.when(F.col("status") != "NOT_RUN", F.col("check"))))
    failing = F.array_sort(F.collect_set(F.when(F.col("status") == "FAIL", F.col("check"))))
    fails = F.count_if(F.col("status") == "FAIL")
    grouped = findings.groupBy("doc_id").agg(fails.alias("n_fail"), failing.alias("failing"), ran.alias("ran"))
    wanted = F.array(*[F.lit(e) for e in sorted(expected)]).cast("array<string>")
    return grouped.select(
        "doc_id",
        F.when(F.col("n_fail") > 0, "FAIL").otherwise("PASS").alias("verdict"),
        "n_fail",
        "failing",
        F.size("ran").alias("n_run"),
        F.array_except(wanted, F.col("ran")).alias("not_run"),
    )


def verdict_of_counts(counts: DataFrame, checks: Sequence[Check] = HYGIENE, expected: Sequence[str] = ()) -> DataFrame:
    """The verdict from the wide counts of a document, in its row: no explode and no shuffle."""
    names = F.array_sort(F.array(*[F.lit(c.name) for c in checks]))
    failing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c.name) > 0, F.lit(c.name)) for c in checks if c.severity == "FAIL"])))
    not_run = F.array_compact(F.array(*[F.when(F.col(c.name).isNull(), F.lit(c.name)) for c in checks]))
    wanted = F.array(*[F.lit(e) for e in sorted(expected)]).cast("array<string>")
    judged = evaluate_once(counts, _failing=failing, _ran=F.array_except(names, not_run))
    return judged.select(
        "doc_id",
        F.when(F.size("_failing") > 0, "FAIL").otherwise("PASS").alias("verdict"),
        F.size("_failing").cast("bigint").alias("n_fail"),
        F.col("_failing").alias("failing"),
        F.size("_ran").alias("n_run"),
        F.array_except(wanted, F.col("_ran")).alias("not_run"),
    )


def version_matrix_of_counts(counts: DataFrame, version: str, versions: Sequence[str], checks: Sequence[Check] = HYGIENE) -> DataFrame:
    """One row per check, one column per version: all sums in one aggregation over the wide counts."""
    sums = counts.agg(*[F.sum(F.when(F.col(version) == v, F.col(c.name))).alias(f"{c.name}|{v}") for c in checks for v in versions])
    rows = F.array(*[F.struct(F.lit(c.name).alias("check"), *[F.col(f"`{c.name}|{v}`").alias(v) for v in versions]) for c in checks])
    return sums.select(F.inline(rows))


def version_matrix(findings: DataFrame, version: str, versions: Sequence[str]) -> DataFrame:
    """One row per check, one column per version, cells are summed counts."""
    return findings.groupBy("check").pivot(version, list(versions)).agg(F.sum("n"))


def phrase_findings(
    docs: DataFrame,
    stale: Sequence[str] = (),
    required: Sequence[str] = (),
    forbidden: Sequence[str] = (),
    whole_word: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Stale or forbidden phrases that are present, required phrases that are absent.

    The rule lists are configuration, so they become literals in one projection; nothing is joined.
    """
    t = F.col(text)

    def present(p: str) -> Column:
        if whole_word:
            return t.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{p}\E(?![\p{{L}}\p{{N}}_])")
        return F.contains(t, F.lit(p))

    hits = []
    for kind, phrases in (("stale", stale), ("required", required), ("forbidden", forbidden)):
        for p in phrases:
            bad = ~present(p) if kind == "required" else present(p)
            hits.append(F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("phrase"))))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(found)).withColumn("status", F.lit("FAIL"))


def pattern_hits(
    docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Documents with at least one match: how many, and the distinct matches."""
    base = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text"))
    return (
        evaluate_once(base, _found=X.all_matches(F.col("_text"), pattern))
        .where(F.size("_found") > 0)
        .select(
            "doc_id", *keep, F.size("_found").cast("bigint").alias("n"),
            F.array_sort(F.array_distinct("_found")).alias("evidence"),
        )
    )


def check_limits(
    docs: DataFrame, section: Column, max_words: int | None = None, max_chars: int | None = None,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Words and characters of a section, FAIL when over a limit, NOT_RUN when the section is missing."""
    sized = evaluate_once(docs.withColumn("doc_id", F.col(doc_id)), _s=section).select(
        "doc_id", X.word_count(F.col("_s")).alias("words"), F.length("_s").cast("bigint").alias("chars")
    )
    over = F.lit(False)
    if max_words is not None:
        over = over | (F.col("words") > max_words)
    if max_chars is not None:
        over = over | (F.col("chars") > max_chars)
    status = F.when(F.col("words").isNull(), "NOT_RUN").when(over, "FAIL").otherwise("PASS")
    return sized.withColumn("status", status)


def section_between(text: Column, start: str, end: str) -> Column:
    """Text between two headings; NULL unless both occur in this order."""
    body = F.regexp_extract(text, rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1)
    return F.when(text.rlike(rf"(?s)\Q{start}\E.*?\Q{end}\E"), body)


def evidence_sentences(
    docs: DataFrame, patterns: Mapping[str, str], max_len: int = 400, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Short sentences that match a pattern. No row means "not reported", never "not performed"."""
    s = docs.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(X.sentences(X.flatten_ws(F.col(text)))).alias("sent_no", "sentence")
    ).where(F.length("sentence") < max_len)
    hit = F.array(*[F.when(F.col("sentence").rlike(p), F.lit(name)) for name, p in patterns.items()])
    return s.select("doc_id", "sent_no", F.explode(F.filter(hit, lambda h: h.isNotNull())).alias("pattern"), "sentence")


def assertive_terms(
    docs: DataFrame, term: str, negation: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Sentences that use a term without any negation."""
    bad = F.filter(X.sentences(X.flatten_ws(F.col(text))), lambda s: s.rlike(term) & ~s.rlike(negation))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(bad).alias("hit_no", "sentence"))


def cell_audit(df: DataFrame, columns: Sequence[str], keys: Sequence[str], max_chars: int = 400) -> DataFrame:
    """Junk cells, blank cells and over-long cells per row group, all columns read as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])
    flat = df.select(*keys, F.inline(cells))
    plain = F.lower(F.trim(F.coalesce("cell", F.lit(""))))
    return flat.groupBy(*keys, "column").agg(
        F.count_if(plain.isin(*X.JUNK_CELLS)).alias("n_junk"),
        F.count_if(plain == "").alias("n_blank"),
        F.count_if(F.length("cell") > max_chars).alias("n_long"),
        F.max(F.length("cell")).alias("longest"),
    )


# --- citations and mentions of one document -------------------------------------------------


def citation_audit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Listed, cited, dangling, uncited, duplicate numbers and order descents, all inside the row."""
    parsed = evaluate_once(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")),
        listed=F.transform(C.reference_entries(F.col("_text")), lambda r: r["ref_no"]),
        order=F.array_distinct(C.citation_numbers(F.col("_text"))),
    )
    return parsed.select(
        "doc_id",
        "listed",
        "order",
        F.array_sort(F.array_except("order", "listed")).alias("dangling"),
        F.array_sort(F.array_except("listed", "order")).alias("uncited"),
        (F.size("listed") - F.size(F.array_distinct("listed"))).alias("n_duplicates"),
        C.descents(F.col("order")).alias("descents"),
        (F.col("listed") == F.sequence(F.lit(1).cast("bigint"), F.greatest(F.size("listed"), F.lit(1)).cast("bigint"))).alias("sequential"),
    )


def mention_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, class, num), pos = reading order."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(C.mentions(F.col(text))).alias("pos", "m")
    ).select("doc_id", "pos", "m.class", "m.num")


def caption_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(C.captions(F.col(text))).alias("pos", "m")
    ).select("doc_id", "pos", "m.class", "m.num")


def orphan_mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentioned numbers without a caption of their class."""
    t = F.col(text)
    pair = docs.select(
        F.col(doc_id).alias("doc_id"), F.array_distinct(C.mentions(t)).alias("m"), F.array_distinct(C.captions(t)).alias("c")
    )
    return pair.select("doc_id", F.inline(F.array_except("m", "c")))


def out_of_range(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentions outside 1..highest caption number of their class (range ends included)."""
    t = F.col(text)
    pair = evaluate_once(
        docs.select(F.col(doc_id).alias("doc_id"), t.alias("_text")),
        m=F.array_distinct(C.mentions(F.col("_text"))), c=C.captions(F.col("_text")),
    )
    top = lambda label: F.coalesce(F.array_max(C.of_class(F.col("c"), label)), F.lit(0))
    bad = F.filter("m", lambda m: (m["num"] < 1) | (m["num"] > top(m["class"])))
    return pair.select("doc_id", F.inline(bad))


def caption_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each caption paragraph joined with the non-empty paragraphs up to the next Table/Figure paragraph.

    The text is cut before every line that opens with "Table " or "Figure ", so a block is one
    piece of its own row and no paragraph relation has to be windowed.
    """
    blocks = F.filter(F.split(text, r"(?m)(?=^(?:Table|Figure) )"), lambda b: b.rlike(C.CAPTION))
    flat = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(blocks).alias("block_no", "_b"))
    lines = F.filter(F.split("_b", "\n"), lambda s: F.trim(s) != "")
    return flat.select(
        "doc_id", "block_no",
        F.regexp_extract("_b", C.CAPTION, 0).alias("label"),
        F.array_join(F.transform(lines, lambda s: F.trim(s)), " ").alias("legend"),
    )


def section_order(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """First positions of two headings and whether the first comes before the second."""
    a, b = F.instr(text, first), F.instr(text, second)
    status = F.when((a == 0) | (b == 0), "NOT_RUN").when(a < b, "PASS").otherwise("FAIL")
    return docs.select(
        F.col(doc_id).alias("doc_id"), a.alias("first_pos"), b.alias("second_pos"), status.alias("status")
    )


# --- abbreviations --------------------------------------------------------------------------

# What counts as an abbreviation.
# (the lookahead only skips tokens that cannot have one of the shapes)
ABBREVIATION_TOKEN = r"(?<![A-Za-z0-9\-])(?=[A-Za-z0-9\-]*(?:[A-Z]{2}|-))[A-Za-z][A-Za-z0-9\-]{1,14}(?![A-Za-z0-9])"
ABBREVIATION_SHAPE = r"[A-Z]{2,}|^[A-Za-z]+-\d|^[A-Z][a-z]+-[A-Z]"
NOT_ABBREVIATION = r"^(?:[IVX]+|[A-Z]{2,}\d+)$"
LATIN_WORDS = ("al", "eg", "et", "etc", "ie", "vs")
REFERENCES_LINE = r"(?im)^[ \t]*(?:references|reference list)[ \t]*$"
LEADING_WORD = r"(?i)^(?:and|the|of|with|to|in|for|a|an|using|including|such as)\s+"


def abbreviation_counts(
    docs: DataFrame, min_total: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Abbreviation-like tokens with counts in the body, in the part after the references line, and in total."""
    t = F.col(text)
    zones = F.split(t, REFERENCES_LINE, 2)
    tokens = F.array(
        F.struct(F.lit("body").alias("zone"), X.all_matches(F.get(zones, 0), ABBREVIATION_TOKEN).alias("tokens")),
        F.struct(
            F.lit("legends").alias("zone"),
            X.all_matches(F.coalesce(F.get(zones, 1), F.lit("")), ABBREVIATION_TOKEN).alias("tokens"),
        ),
    )
    flat = docs.select(F.col(doc_id).alias("doc_id"), F.inline(tokens)).select(
        "doc_id", "zone", F.explode("tokens").alias("abbr")
    )
    flat = flat.where(
        F.col("abbr").rlike(ABBREVIATION_SHAPE)
        & ~F.col("abbr").rlike(NOT_ABBREVIATION)
        & ~F.lower("abbr").isin(*LATIN_WORDS)
    )
    return (
        flat.groupBy("doc_id", "abbr")
        .agg(
            F.count_if(F.col("zone") == "body").alias("n_body"),
            F.count_if(F.col("zone") == "legends").alias("n_legends"),
            F.count("*").alias("n_total"),
        )
        .where(F.col("n_total") >= min_total)
    )


def definitions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Longest ``phrase (ABBR)`` or ``(ABBR, phrase)`` of every abbreviation of a document.

    The phrase loses everything up to its last clause mark and one leading small word.
    """
    flat = X.flatten_ws(F.col(text))
    abbr = r"[A-Za-z][A-Za-z0-9\-]{1,14}"
    before = X.all_matches(flat, rf"[A-Za-z][A-Za-z0-9 ,\-/&+']{{3,90}}?\s*\({abbr}\)")
    inside = X.all_matches(flat, rf"\({abbr},\s*[^)]{{3,70}}\)")
    pairs = F.concat(
        F.transform(
            before,
            lambda m: F.struct(
                F.regexp_extract(m, rf"\(({abbr})\)$", 1).alias("abbr"),
                F.regexp_replace(F.trim(F.regexp_replace(m, rf"\s*\({abbr}\)$", "")), LEADING_WORD, "").alias("phrase"),
            ),
        ),
        F.transform(
            inside,
            lambda m: F.struct(
                F.regexp_extract(m, rf"^\(({abbr}),", 1).alias("abbr"),
                F.trim(F.regexp_extract(m, r",\s*([^)]+)\)$", 1)).alias("phrase"),
            ),
        ),
    )

    def looked_up(lowered: Column) -> Column:
        """Whether the first two words of each phrase are in the text, in any case."""
        return F.transform(
            pairs, lambda p: F.struct(p["abbr"].alias("abbr"), p["phrase"].alias("phrase"),
                                      F.contains(lowered, F.lower(F.substring_index(p["phrase"], " ", 2))).alias("there")),
        )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.inline(X.let(F.lower(flat), looked_up))).where(F.col("abbr").rlike(ABBREVIATION_SHAPE))
    best = rows.groupBy("doc_id", "abbr").agg(F.max(F.struct(F.length("phrase").alias("n"), F.col("phrase"), F.col("there"))).alias("best"))
    spelled = F.when(F.col("best.phrase") == "", "?").when(F.col("best.there"), "yes").otherwise("NOT SPELLED OUT")
    return best.select("doc_id", "abbr", F.col("best.phrase").alias("definition"), spelled.alias("spelled_out"))
