"""Queries over documents, manuscripts, pages and the files Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import citations as C
from sparkaudit.functions import text as X
from sparkaudit.operators import corpus as O
from sparkaudit.plans.derived import MANUSCRIPTS_SQL, manuscripts
from sparkaudit.plans.registry import Tables, query
from sparkaudit.session import evaluate_once, shared_dir
from sparkaudit.sources import corpus as S
from sparkaudit.sources import sinks

joined = lambda c, sep="|": F.array_join(c, sep)

# --- 2.1 sources and sinks ------------------------------------------------------------------


@query(
    "src_documents",
    """SELECT doc_id, generate_subscripts(l, 1) - 1 AS para_no, unnest(l) AS text
       FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def src_documents(t: Tables) -> DataFrame:
    return O.paragraphs(t.documents)


@query(
    "src_result_csv",
    """SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_positive,
         round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1""",
)
def src_result_csv(t: Tables) -> DataFrame:
    path = shared_dir(t.spark)
    bom = t.customer.select(F.col("c_custkey").alias("﻿c_custkey"), "c_mktsegment", "c_acctbal")
    bom.write.csv(path, header=True)
    rows = S.read_results(t.spark, path).withColumn("bal", F.col("c_acctbal").try_cast("double"))
    return (
        rows.where(F.col("c_custkey").isNotNull())
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n"), F.count_if(F.col("bal") > 0).alias("n_positive"), F.round(F.sum("bal"), 2).alias("total"))
    )


@query(
    "src_rules",
    """SELECT 'cust_' || c_custkey AS name, 'c_acctbal>=' || c_nationkey AS "where",
         CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_expect,
         CASE WHEN c_custkey % 3 = 0 THEN 300 END::BIGINT AS abstract_max_words, false AS must_not_cite, 1::BIGINT AS n_stale
       FROM customer""",
)
def src_rules(t: Tables) -> DataFrame:
    path = shared_dir(t.spark)
    c = t.customer
    rule = F.struct(
        F.concat(F.lit("cust_"), c.c_custkey.cast("string")).alias("name"),
        F.concat(F.lit("c_acctbal>="), c.c_nationkey.cast("string")).alias("where"),
        F.when(c.c_custkey % 2 == 0, F.array(F.lit("{n} kept"), F.lit("{n_X} kept"))).alias("expect"),
    )
    file = F.to_json(
        F.struct(
            F.when(c.c_custkey % 3 == 0, F.lit(300)).alias("abstract_max_words"),
            F.array(F.lit("old")).alias("stale"),
            F.array(rule).alias("csv_counts"),
        )
    )
    c.select(file).write.text(path)
    # One rule file per line here; a single pretty-printed file is read with multiLine.
    rules = S.load_rules(t.spark, path, one_file=False).select(
        "abstract_max_words", F.col("abstract_must_not_cite").alias("must_not_cite"), F.size("stale").alias("n_stale"), F.inline("csv_counts")
    )
    return rules.select(
        "name", "where", F.size(F.coalesce("expect", F.array().cast("array<string>"))).alias("n_expect"),
        "abstract_max_words", "must_not_cite", "n_stale",
    )


FIXED = {"KEY": (1, 12), "NAT": (13, 15), "SEG": (16, 25), "BAL": (26, 37)}


@query(
    "src_fixed_width",
    """SELECT c_custkey::DOUBLE AS KEY, c_nationkey::DOUBLE AS NAT, NULL::DOUBLE AS SEG, c_acctbal AS BAL,
         NULL::DOUBLE AS ABSENT FROM customer""",
)
def src_fixed_width(t: Tables) -> DataFrame:
    path = shared_dir(t.spark)
    c = t.customer
    line = F.concat(
        F.lpad(c.c_custkey.cast("string"), 12, " "), F.lpad(c.c_nationkey.cast("string"), 3, " "),
        F.rpad(c.c_mktsegment, 10, " "), F.lpad(F.format_string("%.2f", c.c_acctbal), 12, " "),
    )
    c.select(line.alias("value")).write.text(path)
    return S.read_fixed_width(t.spark, path, FIXED, ["KEY", "NAT", "SEG", "BAL", "ABSENT"])


@query(
    "src_parse_dictionary",
    """SELECT doc_id, name, "start", "end" FROM (
         SELECT c_custkey AS doc_id, 'SEQN' AS name, 1::BIGINT AS "start", 5::BIGINT AS "end" FROM customer
         UNION ALL SELECT c_custkey, 'V_' || c_nationkey, 6 + c_custkey % 10, 6 + c_custkey % 10 FROM customer
         UNION ALL SELECT c_custkey, 'W' || c_custkey, 20, 24 + c_custkey % 7 FROM customer)""",
)
def src_parse_dictionary(t: Tables) -> DataFrame:
    c = t.customer
    key, nat = c.c_custkey.cast("string"), c.c_nationkey.cast("string")
    at = (6 + c.c_custkey % 10).cast("string")
    text = F.concat(
        F.lit("DATA X;\nNOISE 1-9\n INPUT\n  SEQN 1-5\n  V_"), nat, F.lit(" "), at, F.lit("\n  W"), key,
        F.lit(" 20-"), (24 + c.c_custkey % 7).cast("string"), F.lit("\n;\nAFTER 30-31\n"),
    )
    return S.parse_column_dictionary(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query(
    "src_files",
    """SELECT lang, sum(strlen(text) + 1)::BIGINT AS bytes FROM (
         SELECT lang, replace(text, chr(10), ' ') AS text FROM documents) GROUP BY lang""",
)
def src_files(t: Tables) -> DataFrame:
    path = shared_dir(t.spark)
    one_line = F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")
    t.documents.select("lang", one_line).write.partitionBy("lang").text(path)
    files = S.scan_files(t.spark, path, "*.txt", with_hash=False)
    lang = F.regexp_extract("file", r"lang=([^/]+)/", 1)
    return files.groupBy(lang.alias("lang")).agg(F.sum("bytes").alias("bytes"))


@query(
    "src_nested_json",
    """SELECT c_custkey AS incident_id, 'http://x/' || c_nationkey AS url, unnest(
         CASE WHEN c_custkey % 4 = 0 THEN [NULL] ELSE range(c_custkey, c_custkey + c_custkey % 4) END)::BIGINT AS report_id
       FROM customer""",
)
def src_nested_json(t: Tables) -> DataFrame:
    path = shared_dir(t.spark)
    c = t.customer
    k = c.c_custkey % 4
    reports = F.when(k > 0, F.sequence(c.c_custkey, c.c_custkey + F.greatest(k, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    c.select(
        c.c_custkey.alias("incident_id"), F.concat(F.lit("http://x/"), c.c_nationkey.cast("string")).alias("url"),
        reports.alias("reports"),
    ).write.json(path)
    return S.read_nested(t.spark, path, "incident_id bigint, url string, reports array<bigint>", "reports", "report_id")


HYGIENE_SQL = r"""
w AS (SELECT doc_id, text, string_split_regex(text, '\s+') AS tok FROM documents),
h AS (SELECT doc_id,
  ((length(text) - length(replace(text, '**', ''))) // 2) % 2 AS unclosed_bold,
  (length(text) - length(replace(text, 'NA (', ''))) // 4 AS na_artifact,
  len(list_filter(range(2, len(tok) + 1), lambda i:
      regexp_extract(lower(tok[i - 1]), '([\p{L}\p{N}_]+)$', 1) <> ''
      AND regexp_extract(lower(tok[i - 1]), '([\p{L}\p{N}_]+)$', 1) = regexp_extract(lower(tok[i]), '^([\p{L}\p{N}_]+)', 1)
      )) AS doubled_words,
  len(regexp_extract_all(text, '[A-Za-z] {2,}[A-Za-z]')) AS double_spaces,
  len(regexp_extract_all(text, '\s+[.,]')) AS space_before_punctuation,
  abs((length(text) - length(replace(text, '(', ''))) - (length(text) - length(replace(text, ')', '')))) AS paren_balance,
  abs((length(text) - length(replace(text, '[', ''))) - (length(text) - length(replace(text, ']', '')))) AS bracket_balance,
  len(regexp_extract_all(text, '\b(?:NaN|None|undefined)\b')) AS null_words,
  len(regexp_extract_all(text, '\bv1[0-9]\b')) AS version_tags,
  len(regexp_extract_all(text, '(?i)\[(?:Author|Affiliation|Institution|email|Corresponding|funding)')) AS placeholder_brackets,
  len(regexp_extract_all(text, '[0-9],[0-9]{3}')) AS thousands_commas
 FROM w),
f AS (
  UNPIVOT (SELECT doc_id, unclosed_bold::BIGINT AS unclosed_bold, na_artifact::BIGINT AS na_artifact,
      doubled_words::BIGINT AS doubled_words, double_spaces::BIGINT AS double_spaces,
      space_before_punctuation::BIGINT AS space_before_punctuation, paren_balance::BIGINT AS paren_balance,
      bracket_balance::BIGINT AS bracket_balance, null_words::BIGINT AS null_words, version_tags::BIGINT AS version_tags,
      placeholder_brackets::BIGINT AS placeholder_brackets, thousands_commas::BIGINT AS thousands_commas FROM h)
  ON COLUMNS(* EXCLUDE doc_id) INTO NAME "check" VALUE n),
fs AS (
  SELECT doc_id, "check", n, CASE WHEN n = 0 THEN 'PASS'
    WHEN "check" IN ('doubled_words', 'double_spaces', 'space_before_punctuation') THEN 'WARN'
    WHEN "check" = 'thousands_commas' THEN 'INFO' ELSE 'FAIL' END AS status FROM f)
"""


EVIDENCE_SQL = "e AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, '{name}' AS "check", array_to_string(list_sort(list_distinct({found})), '|') AS evidence FROM w"""
    for name, found in {
        "doubled_words": r"""list_transform(list_filter(range(2, len(tok) + 1), lambda i:
            regexp_extract(lower(tok[i - 1]), '([\p{L}\p{N}_]+)$', 1) <> ''
            AND regexp_extract(lower(tok[i - 1]), '([\p{L}\p{N}_]+)$', 1) = regexp_extract(lower(tok[i]), '^([\p{L}\p{N}_]+)', 1)),
            lambda i: regexp_extract(tok[i - 1], '([\p{L}\p{N}_]+)$', 1))""",
        "double_spaces": "regexp_extract_all(text, '[A-Za-z] {2,}[A-Za-z]')",
        "space_before_punctuation": r"regexp_extract_all(text, '\s+[.,]')",
        "null_words": r"regexp_extract_all(text, '\b(?:NaN|None|undefined)\b')",
        "version_tags": r"regexp_extract_all(text, '\bv1[0-9]\b')",
        "placeholder_brackets": r"regexp_extract_all(text, '(?i)\[(?:Author|Affiliation|Institution|email|Corresponding|funding)')",
        "thousands_commas": "regexp_extract_all(text, '[0-9],[0-9]{3}')",
    }.items()
) + ")"


@query(
    "sink_findings",
    f"""WITH {HYGIENE_SQL}, {EVIDENCE_SQL} SELECT "check", status, count(*) AS n_docs, sum(n)::BIGINT AS n,
         sum(CASE WHEN coalesce(evidence, '') = '' THEN 0 ELSE len(string_split(evidence, '|')) END)::BIGINT AS n_evidence
       FROM fs LEFT JOIN e USING (doc_id, "check") GROUP BY "check", status""",
)
def sink_findings(t: Tables) -> DataFrame:
    path = shared_dir(t.spark)
    sinks.write_findings(O.run_checks(t.documents, O.HYGIENE), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("check", "status").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.sum(F.size("evidence")).cast("bigint").alias("n_evidence")
    )


@query(
    "sink_manifest",
    """SELECT 'docs/' || doc_id || '.txt' AS file, strlen(text)::BIGINT AS bytes,
         sha256(text) || '  docs/' || doc_id || '.txt' AS line FROM documents""",
)
def sink_manifest(t: Tables) -> DataFrame:
    inventory = t.documents.select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"),
    )
    return sinks.manifest_lines(inventory).orderBy("file")


# --- 2.2 predicates over text ---------------------------------------------------------------


@query(
    "prj_word_count",
    r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS tokens,
          len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]*')) AS words FROM documents""",
)
def prj_word_count(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", X.word_count(F.col("text"), "tokens").alias("tokens"), X.word_count(F.col("text"), "words").alias("words")
    )


@query(
    "flt_length_limits",
    r"""SELECT doc_id, len(regexp_extract_all(s, '\S+')) AS words, length(s) AS chars,
          CASE WHEN len(regexp_extract_all(s, '\S+')) > 40 OR length(s) > 200 THEN 'FAIL' ELSE 'PASS' END AS status
        FROM (SELECT doc_id, string_split(text, chr(10))[1] AS s FROM documents)""",
)
def flt_length_limits(t: Tables) -> DataFrame:
    return O.check_limits(t.documents, F.substring_index("text", "\n", 1), max_words=40, max_chars=200)


@query(
    "flt_stale_phrases",
    """SELECT doc_id, kind, phrase, 'FAIL' AS status FROM documents,
         (VALUES ('stale', 'MIT License'), ('stale', 'token = '), ('required', 'the'), ('required', '.'),
                 ('forbidden', '@mail')) r(kind, phrase)
       WHERE contains(text, phrase) <> (kind = 'required')""",
)
def flt_stale_phrases(t: Tables) -> DataFrame:
    return O.phrase_findings(
        t.documents, stale=["MIT License", "token = "], required=["the", "."], forbidden=["@mail"]
    )


@query(
    "flt_hygiene_battery",
    f"""WITH {HYGIENE_SQL}, {EVIDENCE_SQL}
      SELECT doc_id, "check", status, n, coalesce(evidence, '') AS evidence FROM fs LEFT JOIN e USING (doc_id, "check")""",
)
def flt_hygiene_battery(t: Tables) -> DataFrame:
    found = O.run_checks(t.documents, O.HYGIENE)
    return found.select("doc_id", "check", "status", "n", F.array_join(F.array_sort("evidence"), "|").alias("evidence"))


def _ms(name: str, sql: str):
    return query(name, f"WITH {MANUSCRIPTS_SQL} {sql}")


@_ms("flt_placeholders", "SELECT doc_id, 1::BIGINT AS n, '[DOI pending]' AS evidence FROM k WHERE a = 7")
def flt_placeholders(t: Tables) -> DataFrame:
    return O.pattern_hits(manuscripts(t), X.PLACEHOLDER).withColumn("evidence", joined("evidence"))


@_ms("flt_escape_residue", r"SELECT doc_id, 1::BIGINT AS n, '\u2013' AS evidence FROM k WHERE b = 9")
def flt_escape_residue(t: Tables) -> DataFrame:
    return O.pattern_hits(manuscripts(t), f"{X.ESCAPE_RESIDUE}|{X.MARKUP_TAG}").withColumn("evidence", joined("evidence"))


@_ms("flt_glued_accession", "SELECT doc_id, 1::BIGINT AS n, 'GSE' || (doc_id + 1000000) AS evidence FROM k WHERE c = 5")
def flt_glued_accession(t: Tables) -> DataFrame:
    return O.pattern_hits(manuscripts(t), X.GLUED_ACCESSION).withColumn("evidence", joined("evidence"))


@_ms("flt_foreign_script", "SELECT doc_id, 2::BIGINT AS n FROM k WHERE c = 3")
def flt_foreign_script(t: Tables) -> DataFrame:
    return O.pattern_hits(manuscripts(t), X.CJK).select("doc_id", "n")


@_ms(
    "flt_bare_reference",
    "SELECT doc_id, 1::BIGINT AS n, 'Tables S1' AS evidence FROM k",
)
def flt_bare_reference(t: Tables) -> DataFrame:
    return O.pattern_hits(manuscripts(t), f"{X.BARE_REFERENCE}|{X.VARIANT_SPELLING}").withColumn("evidence", joined("evidence"))


@query(
    "flt_junk_cells",
    """SELECT "column", l_returnflag, count(*) FILTER (lower(trim(cell)) IN ('nan', 'none', 'na', '#n/a', 'null')) AS n_junk,
         count(*) FILTER (trim(cell) = '') AS n_blank, count(*) FILTER (length(cell) > 4) AS n_long,
         max(length(cell))::BIGINT AS longest
       FROM (SELECT l_returnflag, 'flag' AS "column", CASE WHEN l_linenumber = 1 THEN ' NA ' WHEN l_linenumber = 2 THEN ''
                 ELSE l_linestatus END AS cell FROM lineitem
             UNION ALL SELECT l_returnflag, 'key', l_partkey::VARCHAR FROM lineitem) GROUP BY ALL""",
)
def flt_junk_cells(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    li = t.lineitem.select(
        "l_returnflag", F.when(n == 1, " NA ").when(n == 2, "").otherwise(F.col("l_linestatus")).alias("flag"),
        F.col("l_partkey").alias("key"),
    )
    return O.cell_audit(li, ["flag", "key"], ["l_returnflag"], max_chars=4)


@query(
    "flt_mask_identifiers",
    r"""SELECT page_id, regexp_replace(regexp_replace(s, 'https?://[^\s]+', ' ', 'g'), '\bv?\d+\.\d+\.\d+(?:\.\d+)*\b', ' ', 'g')
          AS masked FROM (SELECT page_id, 'see ' || url || ' v1.' || (page_id % 7) || '.2 range ' || page_id || '-' || (page_id + 3)
          AS s FROM pages)""",
)
def flt_mask_identifiers(t: Tables) -> DataFrame:
    p = F.col("page_id")
    s = F.concat(
        F.lit("see "), F.col("url"), F.lit(" v1."), (p % 7).cast("string"), F.lit(".2 range "), p.cast("string"),
        F.lit("-"), (p + 3).cast("string"),
    )
    return t.pages.select("page_id", X.mask_identifiers(s).alias("masked"))


@query(
    "flt_kwic",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents),
        p AS (SELECT doc_id, s, string_split(s, 'License') AS l FROM d WHERE contains(s, 'License')),
        o AS (SELECT doc_id, s, unnest(range(1, len(l))) AS i, l FROM p),
        q AS (SELECT doc_id, s, i - 1 AS occ, (length(array_to_string(l[1:i], 'License')))::BIGINT AS st FROM o)
        SELECT doc_id, occ, substring(s, greatest(st - 20, 0) + 1, least(st, 20) + 27) AS context FROM q""",
)
def flt_kwic(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.keyword_in_context(F.col("text"), "License", 20)).alias("occ", "context"))


@query(
    "flt_evidence_sentences",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents),
        m AS (SELECT doc_id, string_split(regexp_replace(s, '([.;]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM d),
        x AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS sent_no, unnest(l) AS sentence FROM (
                SELECT doc_id, list_filter(l, lambda z: z <> '') AS l FROM m))
        SELECT doc_id, sent_no, pattern, sentence FROM x, (VALUES ('licence', 'Licen[sc]e'), ('address', '@[a-z]')) r(pattern, p)
        WHERE length(sentence) < 400 AND regexp_matches(sentence, p)""",
)
def flt_evidence_sentences(t: Tables) -> DataFrame:
    return O.evidence_sentences(t.documents, {"licence": "Licen[sc]e", "address": "@[a-z]"})


@query(
    "flt_negated_context",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents),
        m AS (SELECT doc_id, string_split(regexp_replace(s, '([.;]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM d),
        g AS (SELECT doc_id, list_filter(l, lambda z: regexp_matches(z, '\bthe\b') AND NOT regexp_matches(z, '\b(?:and|for)\b')) AS l FROM m)
        SELECT doc_id, generate_subscripts(l, 1) - 1 AS hit_no, unnest(l) AS sentence FROM g""",
)
def flt_negated_context(t: Tables) -> DataFrame:
    word = r"(?<![A-Za-z0-9_])(?:{})(?![A-Za-z0-9_])"
    return O.assertive_terms(t.documents, word.format("the"), word.format("and|for"))


# --- mentions, citations, order -------------------------------------------------------------


@_ms("fn_mentions", "SELECT doc_id, pos - 1 AS pos, class, num FROM mn")
def fn_mentions(t: Tables) -> DataFrame:
    return O.mention_rows(manuscripts(t))


@_ms("fn_expand_ranges", "SELECT doc_id, pos - 1 AS occ, num AS ref_no FROM ci")
def fn_expand_ranges(t: Tables) -> DataFrame:
    return manuscripts(t).select("doc_id", F.posexplode(C.citation_numbers(F.col("text"))).alias("occ", "ref_no"))


@_ms(
    "fn_collapse_ranges",
    """, u AS (SELECT DISTINCT doc_id, num FROM ci),
       g AS (SELECT doc_id, num, num - row_number() OVER (PARTITION BY doc_id ORDER BY num) AS island FROM u),
       r AS (SELECT doc_id, min(num) AS lo, max(num) AS hi FROM g GROUP BY doc_id, island)
       SELECT doc_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '–' || hi END, ',' ORDER BY lo) AS ranges
       FROM r GROUP BY doc_id""",
)
def fn_collapse_ranges(t: Tables) -> DataFrame:
    return manuscripts(t).select("doc_id", C.collapse_ranges(C.citation_numbers(F.col("text"))).alias("ranges"))


@_ms(
    "join_orphan_mentions",
    "SELECT DISTINCT doc_id, class, num FROM mn WHERE (doc_id, class, num) NOT IN (SELECT (doc_id, class, num) FROM cap)",
)
def join_orphan_mentions(t: Tables) -> DataFrame:
    return O.orphan_mentions(manuscripts(t))


@_ms(
    "join_out_of_range",
    """SELECT DISTINCT doc_id, class, num FROM mn
       WHERE num < 1 OR num > CASE class WHEN 'Table' THEN c WHEN 'Figure' THEN 1 ELSE 0 END""",
)
def join_out_of_range(t: Tables) -> DataFrame:
    return O.out_of_range(manuscripts(t))


@_ms(
    "win_first_mention",
    """, f AS (SELECT doc_id, class, num, min(pos) AS p FROM mn GROUP BY ALL)
       SELECT doc_id, class, num, row_number() OVER (PARTITION BY doc_id, class ORDER BY p) AS rank FROM f""",
)
def win_first_mention(t: Tables) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in ("Table", "Table S", "Figure", "Figure S")])
    m = evaluate_once(manuscripts(t), m=C.mentions(F.col("text"))).select("doc_id", "m")
    per_class = m.select("doc_id", "m", F.explode(labels).alias("class"))
    order = F.array_distinct(F.transform(F.filter("m", lambda x: x["class"] == F.col("class")), lambda x: x["num"]))
    return per_class.select("doc_id", "class", F.posexplode(order).alias("p", "num")).select(
        "doc_id", "class", "num", (F.col("p") + 1).alias("rank")
    )


@_ms(
    "win_order_violations",
    """, f AS (SELECT doc_id, num, min(pos) AS p FROM ci GROUP BY ALL),
       l AS (SELECT doc_id, num, p, lag(num) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f)
       SELECT doc_id, count(*) AS n, string_agg(before || '>' || num, '|' ORDER BY p) AS first_bad FROM l
       WHERE before > num GROUP BY doc_id""",
)
def win_order_violations(t: Tables) -> DataFrame:
    audit = evaluate_once(O.citation_audit(manuscripts(t)), descents=F.col("descents")).where(F.size("descents") > 0)
    return audit.select("doc_id", F.size("descents").alias("n"), joined(F.slice("descents", 1, 10)).alias("first_bad"))


@_ms(
    "win_renumber_map",
    """, f AS (SELECT doc_id, num, min(pos) AS p FROM ci GROUP BY ALL),
       allr AS (SELECT doc_id, num, p FROM f UNION ALL
                SELECT doc_id, num, 1000 + num FROM rf WHERE (doc_id, num) NOT IN (SELECT (doc_id, num) FROM f))
       SELECT doc_id, num AS old, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS "new" FROM allr""",
)
def win_renumber_map(t: Tables) -> DataFrame:
    txt = F.col("text")
    listed = F.transform(C.reference_entries(txt), lambda r: r["ref_no"])
    return manuscripts(t).select("doc_id", F.explode(C.renumber_map(C.citation_numbers(txt), listed)).alias("old", "new"))


@_ms(
    "fn_apply_renumber",
    """, f AS (SELECT doc_id, num, min(pos) AS p FROM ci GROUP BY ALL),
       r AS (SELECT doc_id, num, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS nw FROM f),
       x AS (SELECT ci.doc_id, string_agg(nw::VARCHAR, ',' ORDER BY pos) FILTER (pos <= 4) AS t1,
                    string_agg(nw::VARCHAR, ',' ORDER BY pos) FILTER (pos = 5) AS t2
             FROM ci JOIN r USING (doc_id, num) GROUP BY ci.doc_id)
       SELECT doc_id, replace(replace(text, '[' || b || ',' || a || '-' || (a + 2) || ']', '[' || t1 || ']'),
                              'and [' || c || ']. Keys', 'and [' || t2 || ']. Keys') AS text
       FROM ms JOIN x USING (doc_id)""",
)
def fn_apply_renumber(t: Tables) -> DataFrame:
    m = evaluate_once(manuscripts(t), _map=C.renumber_map(C.citation_numbers(F.col("text"))))
    return m.select("doc_id", C.renumber_citations(F.col("text"), F.col("_map")).alias("text"))


@_ms(
    "fn_symbolic_keys",
    """SELECT doc_id, replace(replace(text, '[[k' || b || ',k' || a || ']]', CASE WHEN a = b THEN '[1]' ELSE '[1–2]' END),
                              '[[k' || a || ']]', '[1]') AS text FROM ms""",
)
def fn_symbolic_keys(t: Tables) -> DataFrame:
    return manuscripts(t).select("doc_id", C.number_keys(F.col("text")).alias("text"))


@_ms(
    "win_caption_block",
    """SELECT doc_id, 'Table ' || num || '.' AS label, 'Table ' || num || '. Caption number ' || num || '.' AS legend
       FROM cap WHERE class = 'Table'
       UNION ALL SELECT doc_id, 'Figure 1.', 'Figure 1. A legend with ' || (b * 100) || ' units. Its second line says '
         || c || '.25. ## References ' || array_to_string(list_transform(range(1, b + 1), lambda i: i || '. Author ' || i || '. A title.'), ' ')
       FROM k""",
)
def win_caption_block(t: Tables) -> DataFrame:
    return O.caption_blocks(manuscripts(t)).select("doc_id", "label", "legend")


@_ms(
    "win_section_order",
    """SELECT doc_id, instr(text, '## Abstract') AS first_pos, instr(text, '## References') AS second_pos, 'PASS' AS status FROM ms""",
)
def win_section_order(t: Tables) -> DataFrame:
    return O.section_order(manuscripts(t), "## Abstract", "## References")


@_ms(
    "join_legend_numbers",
    """, l AS (SELECT doc_id, unnest([(b * 100)::VARCHAR, c || '.25']) AS num FROM k)
       SELECT doc_id, num FROM l JOIN ms USING (doc_id)
       WHERE NOT contains(replace(split_part(text, chr(10), 3), ',', ''), num) AND num <> '300'""",
)
def join_legend_numbers(t: Tables) -> DataFrame:
    """Legend numbers that the abstract line does not state; 300 is on the allow list."""
    m = manuscripts(t)
    legend = F.regexp_extract("text", r"(?s)\nFigure 1\. (.*?)\n## References", 1)
    stated = F.replace(F.get(F.split("text", "\n"), 2), F.lit(","), F.lit(""))
    m = evaluate_once(m, legend=legend, stated=stated)
    missing = F.filter(X.numbers(F.col("legend")), lambda x: ~F.contains(F.col("stated"), x) & ~x.isin("300"))
    return m.select("doc_id", F.explode(missing).alias("num"))


# --- abbreviations, addresses, records ------------------------------------------------------

ABBR_SQL = r"""
tk AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9\-]+')) AS w FROM documents),
ab AS (SELECT doc_id, w AS abbr FROM tk
  WHERE regexp_full_match(w, '[A-Za-z][A-Za-z0-9\-]{1,14}')
    AND (regexp_matches(w, '[A-Z]{2,}') OR regexp_matches(w, '^[A-Za-z]+-\d') OR regexp_matches(w, '^[A-Z][a-z]+-[A-Z]'))
    AND NOT regexp_matches(w, '^(?:[IVX]+|[A-Z]{2,}\d+)$') AND lower(w) NOT IN ('al', 'eg', 'et', 'etc', 'ie', 'vs'))
"""


@query(
    "agg_token_counts",
    f"""WITH {ABBR_SQL} SELECT doc_id, abbr, count(*) AS n_body, 0::BIGINT AS n_legends, count(*) AS n_total FROM ab
        GROUP BY ALL""",
)
def agg_token_counts(t: Tables) -> DataFrame:
    return O.abbreviation_counts(t.documents, min_total=1)


@query(
    "agg_abbrev_candidates",
    f"""WITH {ABBR_SQL}, c AS (SELECT doc_id, abbr, count(*) AS n FROM ab GROUP BY ALL HAVING n >= 3)
        SELECT abbr, count(*) AS n_docs, sum(n)::BIGINT AS n_total FROM c GROUP BY abbr""",
)
def agg_abbrev_candidates(t: Tables) -> DataFrame:
    c = O.abbreviation_counts(t.documents, min_total=3)
    return c.groupBy("abbr").agg(F.count("*").alias("n_docs"), F.sum("n_total").alias("n_total"))


@query(
    "agg_abbrev_definition",
    """SELECT c_custkey AS doc_id, 'C' || c_mktsegment[1:3] AS abbr, CASE WHEN c_custkey % 2 = 0
         THEN 'long customer segment of ' || lower(c_mktsegment) ELSE lower(c_mktsegment) || ' customer' END AS definition,
         'yes' AS spelled_out FROM customer""",
)
def agg_abbrev_definition(t: Tables) -> DataFrame:
    c = t.customer
    seg = F.lower("c_mktsegment")
    abbr = F.concat(F.lit("C"), F.substring("c_mktsegment", 1, 3))
    text = F.concat(
        F.lit("It was so; the "), seg, F.lit(" customer ("), abbr, F.lit(") counts. Later ("), abbr, F.lit(", x y "),
        F.lit(") came."),
        F.when(
            c.c_custkey % 2 == 0, F.concat(F.lit(" And ("), abbr, F.lit(", long customer segment of "), seg, F.lit(")."))
        ).otherwise(F.lit("")),
    )
    return O.definitions(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query(
    "fn_emails",
    r"""SELECT doc_id, unnest(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'),
          lambda m: NOT regexp_matches(m, '(?i)nlm|ncbi|elsevier|springer|wiley|oup\b|oxford|bentham|frontiers|thieme|karger|sagepub|tandf|informa|biomedcentral|plos|nature\.com|science\.org|submission|editorial|permissions|reprints?@|journals?@|support@|help@'))))) AS email
        FROM documents""",
)
def fn_emails(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))


REDACTION = ([("MIT License", "[LICENCE]"), ("token", "[KEY]")], [(X.EMAIL, "[MAIL]"), (r"\d{3}-\d{4}", "[PHONE]")])


@query(
    "fn_redact",
    r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(replace(replace(text, 'MIT License', '[LICENCE]'), 'token', '[KEY]'),
          '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[MAIL]', 'g'), '\d{3}-\d{4}', '[PHONE]', 'g') AS clean FROM documents)
        SELECT doc_id, clean, text <> clean AS changed, 0::BIGINT AS residue FROM r""",
)
def fn_redact(t: Tables) -> DataFrame:
    r = evaluate_once(t.documents.select("doc_id", "text"), clean=X.redact(F.col("text"), *REDACTION))
    return r.select(
        "doc_id", "clean", (F.col("text") != F.col("clean")).alias("changed"),
        F.size(X.residue(F.col("clean"), *REDACTION)).alias("residue"),
    )


@query(
    "fn_normalize_space",
    r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents",
)
def fn_normalize_space(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.flatten_ws(F.col("text")).alias("flat"))


@query(
    "fn_record_fields",
    r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'),
            '\s+', ' ', 'g')) AS title, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS links FROM pages)
        SELECT page_id, title, array_to_string(list_transform(links[1:6], lambda x: x[1:200]), '|') AS first_links,
          len(links) AS n_links FROM p""",
)
def fn_record_fields(t: Tables) -> DataFrame:
    h = F.col("html")
    title = X.flatten_ws(F.regexp_replace(F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1), r"<[^>]+>", ""))
    links = X.all_matches(h, r'<a href="([^"]+)"', 1)
    return t.pages.select(
        "page_id", title.alias("title"),
        joined(F.transform(F.slice(links, 1, 6), lambda x: F.substring(x, 1, 200))).alias("first_links"),
        F.size(links).alias("n_links"),
    )


@query(
    "fn_validate_entry",
    r"""SELECT p_partkey, array_to_string(list_filter([
          CASE WHEN p_partkey % 5 = 0 THEN 'empty_author' END, CASE WHEN p_partkey % 7 = 0 THEN 'unknown_author' END,
          CASE WHEN p_partkey % 11 = 0 THEN 'correction' END, CASE WHEN p_partkey % 13 = 0 THEN 'markup' END,
          CASE WHEN p_partkey % 3 <> 0 THEN 'doi_format' END,
          CASE WHEN (p_partkey % 9 + 1 > 6) AND p_partkey % 2 = 0 THEN 'author_rule' END], lambda x: x IS NOT NULL), '|') AS problems
        FROM part""",
)
def fn_validate_entry(t: Tables) -> DataFrame:
    from sparkaudit.functions.records import entry_problems

    k = F.col("p_partkey")
    n_authors = k % 9 + 1
    shown = F.when((n_authors > 6) & (k % 2 != 0), F.lit(6)).otherwise(n_authors)
    rows = t.part.select(
        "p_partkey",
        F.when(k % 5 == 0, "").otherwise("Smith J").alias("first_author"),
        F.concat(
            F.when(k % 7 == 0, "Unknown author. ").otherwise(""), F.when(k % 11 == 0, "Correction to: ").otherwise(""),
            F.when(k % 13 == 0, "<i>").otherwise(""), F.col("p_name"),
        ).alias("entry"),
        F.when(k % 3 == 0, F.concat(F.lit("10.1234/p"), k.cast("string"))).otherwise(F.concat(F.lit("11.1/"), k.cast("string"))).alias("doi"),
        n_authors.alias("n_authors"), shown.alias("n_shown"), ((n_authors > 6) & (k % 2 != 0)).alias("et_al"),
    )
    return rows.select("p_partkey", joined(entry_problems(rows)).alias("problems"))


@query(
    "join_normalized_url",
    r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://', ''), '^www\.', ''), '[#?].*$', ''), '/+$', '') AS u FROM pages)
        SELECT u AS url, count(*) AS n_pages, min(page_id) AS first_page, max(page_id) AS last_page FROM n GROUP BY u""",
)
def join_normalized_url(t: Tables) -> DataFrame:
    from sparkaudit.operators.joins import join_by_url

    pages = t.pages.select("page_id", "url")
    wanted = t.pages.select(F.concat(F.regexp_replace("url", r"^https?://(?:www\.)?", "http://www."), F.lit("#x")).alias("target")).distinct()
    hits = join_by_url(pages, "url", wanted, "target")
    return hits.groupBy(F.col("_url").alias("url")).agg(
        F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")
    )


@query("agg_verdict", f"""WITH {HYGIENE_SQL}
  SELECT doc_id, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict,
    count(*) FILTER (status = 'FAIL') AS n_fail,
    coalesce(string_agg("check", '|' ORDER BY "check") FILTER (status = 'FAIL'), '') AS failing,
    count(*) AS n_run, 'spelling' AS not_run FROM fs GROUP BY doc_id""")
def agg_verdict(t: Tables) -> DataFrame:
    expected = [c.name for c in O.HYGIENE] + ["spelling"]
    v = O.verdict_of_counts(O.hygiene_counts(t.documents), expected=expected)
    return v.select("doc_id", "verdict", "n_fail", joined("failing").alias("failing"), "n_run", joined("not_run").alias("not_run"))


@query("agg_version_matrix", f"""WITH {HYGIENE_SQL}
  SELECT "check", sum(n) FILTER (lang = 'en')::BIGINT AS en, sum(n) FILTER (lang = 'fr')::BIGINT AS fr,
    sum(n) FILTER (lang = 'de')::BIGINT AS de, sum(n) FILTER (lang = 'es')::BIGINT AS es
  FROM fs JOIN documents USING (doc_id) GROUP BY "check" """)
def agg_version_matrix(t: Tables) -> DataFrame:
    """The language column stands in for the version label."""
    return O.version_matrix_of_counts(O.hygiene_counts(t.documents, keep=["lang"]), "lang", ["en", "fr", "de", "es"])


@query("agg_keyword_matrix", """
  SELECT doc_id, regexp_matches(text, 'License|licensed') AS licence, regexp_matches(text, '@|\\+1 \\(') AS contact,
    regexp_matches(text, 'token|key') AS secret FROM documents""".replace("\\\\", "\\"))
def agg_keyword_matrix(t: Tables) -> DataFrame:
    topics = {"licence": r"License|licensed", "contact": r"@|\+1 \(", "secret": "token|key"}
    return t.documents.select("doc_id", *[F.col("text").rlike(p).alias(name) for name, p in topics.items()])


@query("win_top_k", f"""WITH {HYGIENE_SQL}, r AS (
  SELECT "check", doc_id, n, row_number() OVER (PARTITION BY "check" ORDER BY n DESC, doc_id) AS rank FROM fs WHERE n > 0)
  SELECT "check", doc_id, n, rank FROM r WHERE rank <= 5""")
def win_top_k(t: Tables) -> DataFrame:
    from sparkaudit.operators.sequence import top_k

    found = O.counts_to_findings(O.hygiene_counts(t.documents)).where(F.col("n") > 0)
    return top_k(found, ["check"], [F.desc("n"), F.asc("doc_id")], 5).select("check", "doc_id", "n", "rank")


@query("set_union_corpus", """SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (
  SELECT 'body' AS kind, text FROM documents UNION ALL SELECT 'turn', text FROM conversations
  UNION ALL SELECT 'item', text FROM benchmark) GROUP BY kind""")
def set_union_corpus(t: Tables) -> DataFrame:
    whole = O.union_corpus(
        t.documents.select(F.lit("body").alias("kind"), "doc_id", "text"),
        t.conversations.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("doc_id"), "turn", "text"),
        t.benchmark.select(F.lit("item").alias("kind"), F.col("item_id").alias("doc_id"), "text"),
    )
    return whole.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("set_near_duplicates", r"""
  WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS sh FROM d),
  r AS (SELECT min(doc_id) AS rep_id, sh, len(sh) AS n FROM s GROUP BY sh),
  u AS (SELECT rep_id, n, unnest(sh) AS x FROM r),
  p AS (
    SELECT a.rep_id AS rep_id, b.rep_id AS lead, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS ratio
    FROM u a JOIN u b ON a.x = b.x AND b.rep_id < a.rep_id GROUP BY ALL),
  b AS (SELECT rep_id, min(lead) AS similar_to, arg_min(ratio, lead) AS ratio FROM p WHERE ratio >= 0.8 GROUP BY rep_id)
  SELECT s.doc_id, r.rep_id, similar_to, round(ratio, 6) AS ratio FROM s JOIN r ON s.sh = r.sh LEFT JOIN b ON b.rep_id = r.rep_id""")
def set_near_duplicates(t: Tables) -> DataFrame:
    from sparkaudit.operators.similar import near_duplicates

    return near_duplicates(t.documents).withColumn("ratio", F.round("ratio", 6))
