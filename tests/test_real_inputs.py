"""Inputs beyond the templates: wide and mixed ranges, very large groups, missing keys, findings with evidence."""

import pytest
from harness import order_invariant
from pyspark.sql import functions as F

from sparkaudit.functions import citations as C
from sparkaudit.functions import stats as S
from sparkaudit.operators import corpus as O
from sparkaudit.operators import effects as E
from sparkaudit.operators import sequence as Q


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_wide_range_is_whole(spark):
    assert value(spark, "1-20000", C.expand_ranges) == list(range(1, 20001))
    same = F.create_map(F.lit(7).cast("bigint"), F.lit(7).cast("bigint"))
    out = value(spark, "see [7] and [1-20000]", lambda t: C.renumber_citations(t, same))
    assert out == "see [7] and [" + ",".join(map(str, range(1, 20001))) + "]"


@pytest.mark.parametrize("token", ["[1-9000000000]", "[5,99999999999999999999]", "[2000000-3]"])
def test_implausible_ranges_stay_and_are_reported(spark, token):
    mapping = F.create_map(F.lit(5).cast("bigint"), F.lit(1).cast("bigint"))
    text = f"see [5] and {token}."
    assert value(spark, text, lambda t: C.renumber_citations(t, mapping)) == f"see [1] and {token}."
    assert value(spark, text, C.implausible_ranges) == [token]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Tables 4 and S5.", [("Table", 4), ("Table S", 5)]),
        ("Tables S1 and 3.", [("Table S", 1), ("Table", 3)]),
        ("Figures S2–S4, 7 and S9.", [("Figure S", 2), ("Figure S", 3), ("Figure S", 4), ("Figure", 7), ("Figure S", 9)]),
    ],
)
def test_class_of_each_item(spark, text, want):
    assert [tuple(m) for m in value(spark, text, C.mentions)] == want


def test_renumber_mixed_mentions(spark):
    swap = F.create_map(*[F.lit(x).cast("bigint") for x in (4, 5, 5, 4)])
    out = value(spark, "Tables 4 and S5; Table 5; Tables S4 and 4", lambda t: C.renumber_mentions(t, swap, "Table", F.lit(9), F.lit(9)))
    assert out == "Tables 5 and S5; Table 4; Tables S4 and 5"


def test_large_groups_do_not_overflow(spark):
    n = F.lit(4_000_000_000).cast("bigint")
    row = spark.range(1).select(*S.wilson(F.lit(2_000_000_000).cast("bigint"), n), S.smd_rms(F.lit(1.0), F.lit(1.0), n, F.lit(0.0), F.lit(1.0), n)[1]).first()
    assert row[0] == pytest.approx(0.5, abs=1e-4) and row[2] == pytest.approx(5.625e-10, rel=0.01)


def test_missing_families_and_keys(spark):
    df = spark.createDataFrame([(None, 0.01), (None, 0.04), ("a", 0.5), ("a", None)], "f string, p double")
    got = {(r.f, r.p): r.q for r in E.bh_fdr(df, ["f"], "p").collect()}
    assert got[None, 0.01] == pytest.approx(0.02) and got[None, 0.04] == pytest.approx(0.04) and got["a", None] is None
    pos = spark.createDataFrame([(None, 9, 1), (None, 3, 2), ("d", 2, 1)], "k string, num bigint, pos bigint")
    assert {(r.k, r.old, r.new) for r in Q.renumber_map(pos, ["k"], "num", "pos").collect()} == {(None, 9, 1), (None, 3, 2), ("d", 2, 1)}


def test_findings_carry_evidence(spark):
    docs = spark.createDataFrame([(1, "a  b and 1,234 v12"), (2, None), (3, "clean text")], "doc_id bigint, text string")
    found = {(r.doc_id, r["check"]): r for r in O.run_checks(docs, O.HYGIENE).collect()}
    assert found[1, "double_spaces"].evidence == ["a  b"] and found[1, "version_tags"].evidence == ["v12"]
    assert found[2, "double_spaces"].status == "NOT_RUN" and found[3, "double_spaces"].status == "PASS"


def test_row_verdict_is_the_grouped_one(spark):
    docs = spark.createDataFrame([(1, "a ** b v12 None"), (2, None), (3, "clean"), (4, "x  y")], "doc_id bigint, text string")
    counts = O.hygiene_counts(docs)
    wide = O.verdict_of_counts(counts, expected=["spelling", "version_tags"])
    long = O.verdict(O.counts_to_findings(counts), ["spelling", "version_tags"])
    assert sorted(map(str, wide.collect())) == sorted(map(str, long.select(*wide.columns).collect()))
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()


def test_placeholders_and_prefixes(spark):
    docs = spark.createDataFrame([(1, "todo; 待定; (DOI to be inserted later) Tbd")], "doc_id bigint, text string")
    from sparkaudit.functions import text as X

    assert O.pattern_hits(docs, X.PLACEHOLDER).first().n == 4
    bare = "Supplementary Table S1; Supplementary Tables S1 and Table S2; Table S3; Supplemental Table S4"
    assert value(spark, bare, lambda t: X.all_matches(t, X.BARE_REFERENCE)) == ["Table S3"]
    assert value(spark, bare, lambda t: X.count_matches(t, X.VARIANT_SPELLING)) == 1


def test_effects_do_not_depend_on_order(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("arm"), (F.col("id") * 37 % 101).cast("double").alias("y"))
    assert order_invariant(lambda d: E.smd_unpaired(E.arm_moments(d, ["k"], "arm", 1, 0, F.col("y"))), df)
