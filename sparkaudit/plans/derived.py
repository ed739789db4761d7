"""Relations that Spark derives row by row from the given tables, with the same definition in SQL.

The given prose has no citations, captions or placeholders. One manuscript per order puts them
there, with numbers that follow from the order's keys; the SQL oracles know those numbers directly
and do not parse the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.plans.registry import Tables
from sparkaudit.session import deal_rows, evaluate_once


def manuscripts(t: Tables) -> DataFrame:
    """(doc_id, a, b, c, text), one per order."""
    keys = deal_rows(t.orders.select("o_orderkey", "o_custkey")).select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("cust"),
        (F.col("o_orderkey") % 7 + 1).alias("a"),
        (F.col("o_custkey") % 9 + 1).alias("b"),
        ((F.col("o_orderkey") * 3 + F.col("o_custkey")) % 5 + 1).alias("c"),
    )
    s = lambda name: F.col(name).cast("string")
    accession = F.when(F.col("c") == 5, F.concat(F.lit("GSE"), (F.col("doc_id") + 1000000).cast("string"))).otherwise(
        F.lit("GSE12345")
    )
    one = F.lit(1).cast("bigint")
    table_captions = F.transform(
        F.sequence(one, F.col("c")),
        lambda i: F.concat(F.lit("Table "), i.cast("string"), F.lit(". Caption number "), i.cast("string"), F.lit(".")),
    )
    references = F.transform(
        F.sequence(one, F.col("b")),
        lambda i: F.concat(i.cast("string"), F.lit(". Author "), i.cast("string"), F.lit(". A title.")),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Report "), s("doc_id"), F.lit(" on unit "), s("cust")),
        F.lit("## Abstract"),
        F.concat(
            F.lit("We retained "), s("a"), F.lit(" of "), (F.col("b") + 10).cast("string"),
            F.lit(" units of "), accession, F.lit("; the rate was "), s("c"), F.lit(".5"),
            F.when(F.col("a") == 7, F.lit(" [DOI pending]")).otherwise(F.lit("")),
            F.when(F.col("b") == 9, F.lit(" in 3\\u20135 days")).otherwise(F.lit("")),
            F.when(F.col("c") == 3, F.lit(" 中文")).otherwise(F.lit("")), F.lit("."),
        ),
        F.lit("## 1. Introduction"),
        F.concat(
            F.lit("Earlier work ["), s("b"), F.lit(","), s("a"), F.lit("-"), (F.col("a") + 2).cast("string"),
            F.lit("] and Table "), s("c"), F.lit(" agree with Table "), s("a"), F.lit(" and Figure S"), s("b"),
            F.lit("."),
        ),
        F.concat(
            F.lit("Tables "), s("a"), F.lit(" and "), s("b"), F.lit(" extend Tables S1–S"), s("c"),
            F.lit("; see Figure "), s("b"), F.lit(" and ["), s("c"), F.lit("]. Keys [[k"), s("a"), F.lit("]] and [[k"),
            s("b"), F.lit(",k"), s("a"), F.lit("]]."),
        ),
        F.array_join(table_captions, "\n"),
        F.concat(F.lit("Figure 1. A legend with "), (F.col("b") * 100).cast("string"), F.lit(" units.")),
        F.concat(F.lit("Its second line says "), s("c"), F.lit(".25.")),
        F.lit("## References"),
        F.array_join(references, "\n"),
    )
    return evaluate_once(keys, text=text).select("doc_id", "a", "b", "c", "text")


MANUSCRIPTS_SQL = r"""
k AS (
  SELECT o_orderkey AS doc_id, o_custkey AS cust, o_orderkey % 7 + 1 AS a, o_custkey % 9 + 1 AS b,
         (o_orderkey * 3 + o_custkey) % 5 + 1 AS c
  FROM orders),
ms AS (
  SELECT doc_id, a, b, c, concat_ws(chr(10),
    'Report ' || doc_id || ' on unit ' || cust,
    '## Abstract',
    'We retained ' || a || ' of ' || (b + 10) || ' units of '
      || CASE WHEN c = 5 THEN 'GSE' || (doc_id + 1000000) ELSE 'GSE12345' END || '; the rate was ' || c || '.5'
      || CASE WHEN a = 7 THEN ' [DOI pending]' ELSE '' END
      || CASE WHEN b = 9 THEN ' in 3\u20135 days' ELSE '' END
      || CASE WHEN c = 3 THEN ' 中文' ELSE '' END || '.',
    '## 1. Introduction',
    'Earlier work [' || b || ',' || a || '-' || (a + 2) || '] and Table ' || c || ' agree with Table ' || a
      || ' and Figure S' || b || '.',
    'Tables ' || a || ' and ' || b || ' extend Tables S1–S' || c || '; see Figure ' || b || ' and [' || c
      || ']. Keys [[k' || a || ']] and [[k' || b || ',k' || a || ']].',
    array_to_string(list_transform(range(1, c + 1), lambda i: 'Table ' || i || '. Caption number ' || i || '.'), chr(10)),
    'Figure 1. A legend with ' || (b * 100) || ' units.',
    'Its second line says ' || c || '.25.',
    '## References',
    array_to_string(list_transform(range(1, b + 1), lambda i: i || '. Author ' || i || '. A title.'), chr(10))) AS text
  FROM k),
mn AS (
  SELECT doc_id, a, b, c, u.class AS class, u.num AS num, pos FROM (
    SELECT doc_id, a, b, c, unnest(l) AS u, generate_subscripts(l, 1) AS pos FROM (
      SELECT doc_id, a, b, c, list_concat(
        [{'class': 'Table', 'num': c}, {'class': 'Table', 'num': a}, {'class': 'Figure S', 'num': b},
         {'class': 'Table', 'num': a}, {'class': 'Table', 'num': b}],
        list_concat(list_transform(range(1, c + 1), lambda i: {'class': 'Table S', 'num': i}),
        list_concat([{'class': 'Figure', 'num': b}],
        list_concat(list_transform(range(1, c + 1), lambda i: {'class': 'Table', 'num': i}),
          [{'class': 'Figure', 'num': 1::BIGINT}])))) AS l FROM k))),
cap AS (
  SELECT doc_id, 'Table' AS class, unnest(range(1, c + 1)) AS num FROM k
  UNION ALL SELECT doc_id, 'Figure', 1 FROM k),
ci AS (
  SELECT doc_id, unnest(l) AS num, generate_subscripts(l, 1) AS pos FROM (
    SELECT doc_id, [b, a, a + 1, a + 2, c] AS l FROM k)),
rf AS (SELECT doc_id, unnest(range(1, b + 1)) AS num FROM k)
"""
