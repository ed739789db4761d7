"""Planted defects: each check finds its own and a clean document gives none."""

import pytest
from pyspark.sql import functions as F

from sparkaudit.functions.rules import where_predicate
from sparkaudit.operators import cohort as H
from sparkaudit.operators import compare as D
from sparkaudit.operators import corpus as O
from sparkaudit.operators import counts as N
from sparkaudit.operators import joins as J
from sparkaudit.operators import sequence as Q
from sparkaudit.session import shared_dir
from sparkaudit.sources import corpus as S
from sparkaudit.sources import sinks

CLEAN = "A title\n## Abstract\nWords [1,2] and Table 1.\n## 1. Introduction\nSee Figure 1 [3].\nTable 1. Cap.\nFigure 1. Cap.\n## References\n1. A. B.\n2. C. D.\n3. E. F."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_clean_document_has_no_findings(spark):
    d = docs(spark, CLEAN)
    v = O.verdict(O.counts_to_findings(O.hygiene_counts(d)), [c.name for c in O.HYGIENE] + ["x"]).first()
    assert v["verdict"] == "PASS" and v["failing"] == [] and v["not_run"] == ["x"]
    a = O.citation_audit(d).first()
    assert a["dangling"] == [] and a["uncited"] == [] and a["descents"] == [] and a["n_duplicates"] == 0 and a["sequential"]
    assert O.orphan_mentions(d).count() == 0 and O.out_of_range(d).count() == 0
    assert O.section_order(d, "## Abstract", "## References").first()["status"] == "PASS"


def test_planted_citation_defects(spark):
    bad = CLEAN.replace("[3]", "[9–7]").replace("3. E. F.", "2. E. F.")
    a = O.citation_audit(docs(spark, bad)).first()
    assert a["dangling"] == [7, 8, 9] and a["n_duplicates"] == 1 and not a["sequential"] and a["uncited"] == []
    a = O.citation_audit(docs(spark, CLEAN.replace("[1,2]", "[3]").replace("See Figure 1 [3]", "See Figure 1 [1]"))).first()
    assert a["descents"] == ["3>1"] and a["uncited"] == [2]


def test_planted_hygiene(spark):
    texts = ["**open", "x NA (1)", "the the", "a  b", "a ,", "(a", "[a", "NaN", "v12", "[Author x]", "1,000"]
    rows = {r["doc_id"]: [r["check"] for r in [r] if r["n"] > 0] for r in []}
    found = O.counts_to_findings(O.hygiene_counts(docs(spark, *texts))).where("n > 0").collect()
    for r in found:
        rows.setdefault(r["doc_id"], []).append(r["check"])
    for i, c in enumerate(O.HYGIENE):
        assert c.name in rows[i], (texts[i], rows.get(i))


def test_phrases_and_limits(spark):
    d = docs(spark, "we retained 7 in this manuscript", "ok must")
    out = {(r["doc_id"], r["kind"]) for r in O.phrase_findings(d, ["retained 7"], ["must"], ["script"], whole_word=True).collect()}
    assert out == {(0, "stale"), (0, "required")}
    lim = O.check_limits(docs(spark, CLEAN, "none"), O.section_between(F.col("text"), "## Abstract", "## 1."), max_words=3).collect()
    assert [r["status"] for r in lim] == ["FAIL", "NOT_RUN"]


def test_abbreviations(spark):
    d = docs(spark, "BMI and BMI, non-BMI. Phase II of GSE84044; BMI\nReferences\nBMI (body mass index) x BMI")
    r = {x["abbr"]: x for x in O.abbreviation_counts(d, 1).collect()}
    assert set(r) == {"BMI", "non-BMI"} and (r["BMI"]["n_body"], r["BMI"]["n_legends"]) == (3, 2)
    d = docs(spark, "So. The glycated long index (GLI) and (GLI, a much longer glycated index name).")
    assert O.definitions(d).first()["definition"] == "a much longer glycated index name"


def test_where_rule_intent(spark):
    df = spark.createDataFrame([("2", "0.01", "a"), ("10", "0.2", "same-type"), ("", None, "b"), ("x", "0.01", "c")], "k string, fdr string, t string")
    n = lambda w: df.where(where_predicate(w, df.columns)).count()
    assert n("k>=2") == 2 and n("k>=2 and fdr<0.05") == 1 and n("t==same-type") == 1 and n("contains:same") == 1
    assert n("t!='a'") == 3 and n("k!=2") == 1 and n(None) == 4
    with pytest.raises(ValueError):
        where_predicate("nonsense", df.columns)


def test_rules_and_provenance(spark):
    df = spark.createDataFrame([("x y",), ("x y",), ("z",)], "g string")
    rules = [{"name": "r", "where": "g!=q", "group_by": "g", "expect": ["kept {n}, {n_x_y} / {n_z}"]}, {"name": "none", "where": "g==q", "expect": ["{n} left"]}]
    counts = N.count_by_rules(df, rules)
    e = N.expected_strings(counts, rules)
    assert {r["expect"] for r in e.collect()} == {"kept 3, 2 / 1", "0 left"}
    out = {r["name"]: r["status"] for r in N.provenance(docs(spark, "we kept 3, 2 / 1 rows"), e).collect()}
    assert out == {"r": "PASS", "none": "FAIL"}


def test_missing_table_is_a_finding(spark):
    table, finding = S.results_or_finding(spark, "r", "/nonexistent/table.csv")
    assert table is None and finding.first()["status"] == "FAIL"


def test_rules_file_defaults(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"stale": ["old"],\n "csv_counts": [{"name": "a", "path": "p.csv"}]}')
    r = S.load_rules(spark, str(tmp_path / "rules.json")).first()
    assert r["required"] == [] and r["abstract_must_not_cite"] is False and r["csv_counts"][0]["where"] is None


def test_grid_gaps(spark):
    a, b = spark.range(26).withColumnRenamed("id", "a"), spark.range(17).withColumnRenamed("id", "b")
    drop = {(0, 0), (0, 1), (3, 16), (5, 4), (25, 16), (25, 15), (9, 9), (10, 0)}
    fact = [(i, j) for i in range(26) for j in range(17) if (i, j) not in drop]
    out = N.grid_gaps(a, b, spark.createDataFrame(fact, "a bigint, b bigint"), "a", "b")
    assert {(r["a"], r["b"]) for r in out.collect()} == drop
    empty = N.grid_gaps(a, b, spark.createDataFrame([(1, 1)], "a bigint, b bigint"), "a", "b")
    assert empty.count() == 26 * 17 - 1


def test_cells_of_a_grid_are_never_shuffled(spark, capsys):
    """Gaps over several blocks of B keys; cells are made above the last exchange, also without a broadcast."""
    a, b = spark.range(5).withColumnRenamed("id", "a"), spark.range(0, 9000, 3).withColumnRenamed("id", "b")
    held = {(0, 0), (0, 3069), (0, 3072), (0, 8997), (1, 3072), (2, 6141), (2, 6144), (4, 4500)}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.grid_gaps(a, b, spark.createDataFrame([*held, (1, 1), (77, 3)], "a bigint, b bigint"), "a", "b")
        assert sorted((r["a"], r["b"]) for r in out.collect()) == [(i, j) for i in range(5) for j in range(0, 9000, 3) if (i, j) not in held]
        capsys.readouterr()
        out.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    assert plan.index("Generate") < plan.index("Exchange")


def test_cells_of_a_grid_stay_small_on_disk(spark, tmp_path):
    """Cells come in strips, so that a whole grid takes a small part of a byte for each; keys on no axis, NULL keys and another type change nothing."""
    a, b = spark.range(2000).selectExpr("cast(id AS int) AS a"), spark.range(5000).selectExpr("if(id = 9, NULL, id * 7) AS b")
    held = spark.range(20_000).selectExpr("id * 7919 % 2000 AS a", "id * 104729 % 5000 * 7 AS b").where("b <> 63")
    fact = held.union(held).union(spark.createDataFrame([(5, 3), (2 ** 40, 7), (-1, 7), (None, 7), (5, None)], "a bigint, b bigint"))
    N.grid_gaps(a, b, fact, "a", "b").write.parquet(str(tmp_path / "grid"))
    grid = spark.read.parquet(str(tmp_path / "grid"))
    assert grid.count() == grid.distinct().count() == 2000 * 4999 - held.distinct().count()
    assert grid.join(held, ["a", "b"]).isEmpty() and grid.where("a NOT BETWEEN 0 AND 1999 OR b % 7 > 0 OR b NOT BETWEEN 0 AND 34993 OR b = 63").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "grid").glob("*.parquet")) < 0.4 * grid.count()
    unknown = N.grid_gaps(spark.createDataFrame([(None,), (1,), (1,)], "a bigint"), b.limit(20), fact, "a", "b")
    assert unknown.where("a IS NULL").count() == b.limit(20).where("b IS NOT NULL").count()
    assert N.grid_gaps(a, b.limit(0), fact, "a", "b").isEmpty() and N.grid_gaps(a.limit(0), b, fact, "a", "b").isEmpty()


def test_sequences(spark):
    df = spark.createDataFrame([("d", p, n) for p, n in enumerate([1, 2, 9, 1, 2, 3, 5])], "k string, pos bigint, num bigint")
    assert [r["num"] for r in Q.trailing_run(df, ["k"], "num", "pos").orderBy("pos").collect()] == [1, 2, 3, 5]
    assert {(r["gap_from"], r["gap_to"]) for r in Q.gaps(df, ["k"], "num").collect()} == {(4, 4), (6, 8)}
    a = Q.sequence_audit(df, ["k"], "num").first()
    assert (a["n_duplicated"], a["n_missing"], a["sequential"]) == (2, 4, False)
    assert sorted((r["first"], r["last"]) for r in Q.islands(df, ["k"], "num").collect()) == [(1, 3), (5, 5), (9, 9)]


def test_identity_and_design(spark):
    rows = [("c", i, f"p{i % 5}", "Case" if i < 5 else "Control") for i in range(10)] + [("d", i, None, "Case" if i < 2 else "Control") for i in range(4)]
    df = spark.createDataFrame(rows, "cohort string, s int, p string, g string")
    out = {r["cohort"]: r for r in N.identity_counts(df, "s", "p", "g", "Case", "Control", ["cohort"]).collect()}
    assert out["c"]["n_both_arms"] == 5 and out["d"]["n_persons"] is None and out["d"]["identity"] == "unavailable"
    design = {r["cohort"]: r["design"] for r in N.design_class(df, ["cohort"], "p", "g", "Case", "Control").collect()}
    assert design == {"c": "paired", "d": "unpaired"}


def test_double_dates(spark):
    df = spark.range(1839).select(F.lit(2020).alias("a"), F.when(F.col("id") < 147, 2021).otherwise(2020).alias("b"))
    r = N.double_dated(df, F.col("a"), F.col("b")).first()
    assert (r["n_double"], r["yearly_sum"]) == (147, 1986)


def test_agreement_prevalence(spark):
    df = spark.createDataFrame([("absent", "absent")] * 90 + [("present", "absent")] * 10, "a string, b string")
    r = N.agreement(df, "a", "b").first()
    assert r["raw"] == 0.9 and r["kappa"] == pytest.approx(0.0) and r["ac1"] == pytest.approx((0.9 - 0.095) / (1 - 0.095), abs=1e-9)


def test_sentence_diff_brute_force(spark):
    """Few letters, so that windows nearly repeat; prefixes at both ends, in the middle and with one letter changed."""
    import random

    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("abé😀 x") for _ in range(n)).strip()
    inner = [line(rng.randrange(20, 200)) for _ in range(60)]
    outer = []
    for s in inner:
        cut = rng.randrange(len(s)) if s else 0
        made = rng.choice([s, line(30) + s, s[cut:], s[:cut] + "q" + s[cut:], s + line(9), line(50) + s[:61]])
        outer.append(made)
    a, b = [(i, s) for i, s in enumerate(inner)], [(i, s) for i, s in enumerate(outer)]
    norm = lambda s: " ".join(s.split())
    want = sorted(i for i, s in a if len(norm(s)) > 60 and not any(norm(s)[:60] in norm(o) for _, o in b))
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted(r["doc_id"] for r in D.sentence_diff(make(a), make(b)).collect()) == want and 5 < len(want) < 50
    assert D.sentence_diff(make(a), make(b).limit(0)).count() == sum(len(norm(s)) > 60 for _, s in a)


def test_sentence_diff_and_paragraphs(spark):
    long = "this is a sentence that is surely longer than the sixty characters asked for"
    a, b = docs(spark, f"{long}. {long.replace('this', 'that')}."), docs(spark, f"Prefix words {long}. Other.")
    assert [r["sentence"] for r in D.sentence_diff(a, b).collect()] == [long.replace("this", "that") + "."]
    p = O.paragraphs(docs(spark, "a\nb\nb\nc"))
    q = O.paragraphs(docs(spark, "b\na\nb\nd"))
    n = {r["status"]: r["n"] for r in D.paragraph_changes(p, q, ["doc_id"]).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert n == {"moved": 2, "insert": 1, "delete": 1}


def test_manifest_and_files(spark, tmp_path):
    root = tmp_path / "pkg"
    (root / "sub").mkdir(parents=True)
    (root / "a.csv").write_text("h\n1\n2\n")
    (root / "sub" / "b.txt").write_text("x")
    before = S.scan_files(spark, str(root))
    rows = {r["file"]: r for r in before.collect()}
    assert rows["a.csv"]["rows"] == 2 and "sub/b.txt" in rows
    kept = spark.createDataFrame([tuple(r) for r in before.collect()], before.schema)
    (root / "sub" / "b.txt").write_text("y")
    (root / "new.txt").write_text("n")
    status = {r["file"]: r["status"] for r in sinks.verify_manifest(S.scan_files(spark, str(root)), kept).collect()}
    assert status == {"a.csv": "OK", "sub/b.txt": "FAILED", "new.txt": "unlisted"}
    out = shared_dir(spark)
    assert sinks.write_manifest(kept, out).count() >= 2


def test_boxes_brute_force(spark):
    import random

    r = random.Random(2)
    rows = []
    for p in range(3):
        for i in range(40):
            x, y = r.uniform(0, 300), r.uniform(0, 300)
            rows.append((p, i, x, y, x + r.uniform(5, 150), y + r.uniform(5, 150)))
    df = spark.createDataFrame(rows, "page int, box_no int, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
                small = min((c[4] - c[2]) * (c[5] - c[3]) for c in (a, b))
                if w > 2 and h > 2 and w * h > 0.45 * small:
                    want.add((a[0], a[1], b[1]))
    got = [(x["page"], x["box_a"], x["box_b"]) for x in J.overlapping_boxes(df, ["page"], cell=70.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_log_rule_and_branches(spark):
    df = spark.createDataFrame([("c", float(i)) for i in range(0, 100)] + [("l", i / 7) for i in range(100)], "k string, v double")
    assert {r["k"]: r["scale"] for r in H.detect_log_scale(df, ["k"], "v").collect()} == {"c": "raw_counts", "l": "already_log"}
    b = spark.createDataFrame([(30, 1, None), (70, None, 1), (80, None, 0)], "age int, y1 int, y2 int")
    y = H.branch_outcome([(F.col("age") < 60, F.col("y1")), (F.col("age") >= 60, F.col("y2"))])
    out = {r["branch"]: r for r in H.branch_report(b, F.when(F.col("age") < 60, "young").otherwise("old"), y, F.col("age")).collect()}
    assert out["old"]["n_filled"] == 2 and out["old"]["max_age"] == 80 and out["young"]["n_cases"] == 1


def test_id_join_guard(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        J.id_join(a, b, "k")
    assert J.id_join(b, a, "k").count() == 50


def test_affine_without_keys(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.5 + 1).cast("double").alias("b"))
    r = D.affine_equivalent(df, "a", "b").first()
    assert r["equivalent"] and r["slope"] == pytest.approx(2.5) and r["intercept"] == pytest.approx(1.0)
