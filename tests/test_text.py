from pyspark.sql import functions as F

from sparkaudit.functions import citations as C
from sparkaudit.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_expand_ranges(spark):
    def ex(s):
        return one(spark, s, C.expand_ranges)

    assert ex("21-50") == list(range(21, 51))
    assert ex("21–50") == list(range(21, 51))
    assert ex("9,10") == [9, 10]
    assert ex("123") == [123]
    assert ex("7-5, 9") == [5, 6, 7, 9]
    assert ex("x,2") == [2]


def test_collapse_ranges(spark):
    assert one(spark, "1,2,3,5,8-9", lambda t: C.collapse_ranges(C.expand_ranges(t))) == "1–3,5,8–9"


def test_mentions(spark):
    def m(s):
        return [tuple(x) for x in one(spark, s, C.mentions)]

    assert m("Table S13. and Table 3") == [("Table S", 13), ("Table", 3)]
    assert m("Tables 4 and 5, Figures S1–S3") == [
        ("Table", 4), ("Table", 5), ("Figure S", 1), ("Figure S", 2), ("Figure S", 3)]
    assert m("Table 1, 5 patients") == [("Table", 1)]
    assert m("no tables") == []


def test_scrambled_order(spark):
    text = "\n".join(f"see Table {n} here" for n in (1, 7, 6, 2, 3, 4, 5))
    seq = one(spark, text, lambda t: C.of_class(C.mentions(t), "Table"))
    assert seq == [1, 7, 6, 2, 3, 4, 5]
    got = one(spark, text, lambda t: C.renumber_map(C.of_class(C.mentions(t), "Table")))
    assert got == {1: 1, 7: 2, 6: 3, 2: 4, 3: 5, 4: 6, 5: 7}
    assert one(spark, text, lambda t: C.descents(C.of_class(C.mentions(t), "Table"))) == ["7>6", "6>2"]


def test_renumber_cycle_and_ranges(spark):
    mapping = F.create_map(*[F.lit(x).cast("bigint") for x in (1, 2, 2, 3, 3, 1)])

    def r(s, label, old, new):
        return one(spark, s, lambda t: C.renumber_mentions(t, mapping, label, F.lit(old).cast("bigint"), F.lit(new).cast("bigint")))

    assert r("Table 1, Table 2, Table 3; Table S1", "Table", 3, 3) == "Table 2, Table 3, Table 1; Table S1"
    assert r("Tables 2 and 3", "Table", 9, 9) == "Tables 3 and 1"
    assert r("Tables S1–S13", "Table S", 13, 16) == "Tables S1–S16"
    assert r("Tables S2-S3", "Table S", 13, 16) == "Tables S1–S3"
    got = one(spark, "a [3,1] b [2-3] c\n## References\n1. x [9]", lambda t: C.renumber_citations(t, mapping))
    assert got == "a [1,2] b [3,1] c\n## References\n1. x [9]"


def test_symbolic_keys(spark):
    s = "x [[b]] y [[a,b]] z ⟪c;a⟫ w [[zz]]"
    known = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, s, lambda t: C.number_keys(t, known)) == "x [1] y [1–2] z [2–3] w "


def test_hygiene_patterns(spark):
    def n(s, p):
        return one(spark, s, lambda t: X.count_matches(t, p))

    assert n("la la la x", X.DOUBLED_WORD) == 2
    assert n("The the cat", X.DOUBLED_WORD) == 1
    assert n("thethe the1 the", X.DOUBLED_WORD) == 0
    # The no-break space splits words; word_count handles it ahead of the pattern.
    assert one(spark, "a\u00a0b c\u2003d", X.word_count) == 4
    assert one(spark, "a\u00a0b  c", X.flatten_ws) == "a b c"
    assert n("GSE1391134 GSE13911", X.GLUED_ACCESSION) == 1
    assert n("x \\u2013 y", X.ESCAPE_RESIDUE) == 1
    assert n("中", X.CJK) == 1


def test_emails_redaction_urls(spark):
    s = "a.b@uni.edu, x@elsevier.com journals@uni.edu a.b@uni.edu"
    assert one(spark, s, X.emails) == ["a.b@uni.edu"]
    rules = ([("Real Name", "[A]")], [(r"J[A-Z]{3}-\d+", "JX")])
    assert one(spark, "Real Name JABC-12", lambda t: X.redact(t, *rules)) == "[A] JX"
    assert one(spark, "Real Name JABC-12", lambda t: X.residue(t, *rules)) == ["Real Name", "JABC-12"]
    assert one(spark, "https://www.x.org/a/?q=1#t", X.normalize_url) == "x.org/a"


def test_kwic(spark):
    got = one(spark, "aaa 17 bbb 17 ccc", lambda t: X.keyword_in_context(t, "17", 5))
    assert got == ["aaa 17 bbb ", " bbb 17 ccc"]
    assert one(spark, "nothing", lambda t: X.keyword_in_context(t, "17", 5)) == []


def test_mask(spark):
    got = one(spark, "see 10.1234/ab-5.6 and https://x.y/3-4 v1.2.3 range 5-6", X.mask_identifiers)
    assert "5-6" in got and "3-4" not in got and "1.2.3" not in got and "ab-5.6" not in got
