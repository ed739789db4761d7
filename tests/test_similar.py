import random

from sparkaudit.operators.similar import near_duplicates


def brute(rows, least=0.8):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    out = {}
    for i, s in sets.items():
        rep = min(j for j, t in sets.items() if t == s)
        hits = [(j, len(s & t) / len(s | t)) for j, t in sets.items() if j < rep and s and t and t != s and len(s & t) >= least * len(s | t)]
        out[i] = (rep, *min((h for h in hits if h[0] == min(j for j, u in sets.items() if u == sets[h[0]])), default=(None, None)))
    return out


def test_pairs_in_a_template_family(spark):
    """Documents put together from two variants of each of twelve sections, half of them with a copy of one other word."""
    rng = random.Random(5)
    words = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    variants = [[words(f"s{k}v{v}x", 16) for v in range(2)] for k in range(12)]
    made = [[w for k in range(12) for w in variants[k][0 if rng.random() < 0.7 else 1]] for _ in range(300)]
    rows = [(i, " ".join(m)) for i, m in enumerate(made)]
    rows += [(300 + i, " ".join(made[i][:96] + words("u", 1) + made[i][97:])) for i in range(150, 300, 2)]
    rows += [(700, rows[7][1]), (701, ""), (702, "one two"), (703, "one two")]
    want = brute(rows)
    assert sum(m is not None for _, m, _ in want.values()) > 150
    got = {r.doc_id: (r.rep_id, r.similar_to, r.ratio) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_random_edits_against_brute_force(spark):
    """Texts of all lengths with edits anywhere, a passage that many share, and a family in which few match."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(120):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60, 150]))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        rows.append((len(rows), " ".join(own)))
        for _ in range(rng.randrange(3)):
            edited = list(own)
            for _ in range(rng.randrange(1, 4)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(50)}"
            rows.append((len(rows), " ".join(edited).upper() if rng.random() < 0.3 else " ".join(edited)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows + [(9001, None), (9002, "  ")], "doc_id bigint, text string")
    want = brute([(i, t or "") for i, t in rows + [(9001, ""), (9002, "")]], 0.8)
    assert 30 < sum(m is not None for _, m, _ in want.values()) < len(rows)
    for least in (0.8, 0.5):
        want = brute([(i, t or "") for i, t in rows + [(9001, ""), (9002, "")]], least)
        got = {r.doc_id: (r.rep_id, r.similar_to, r.ratio) for r in near_duplicates(docs, least).collect()}
        assert got == want, least


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sets_stay_where_they_are(spark, monkeypatch, capsys):
    """A round sends its pairs to the sets: no exchange of whole sets, whatever the number of rounds."""
    from sparkaudit.operators import similar

    plans, cut = [], similar.cut_lineage

    def shown(df):
        if df.columns == ["rep_id", "lead", "ratio"]:
            capsys.readouterr()
            df.explain()
            plans.append(capsys.readouterr().out.split("\n"))
        return cut(df)

    monkeypatch.setattr(similar, "cut_lineage", shown)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base[: (at := rng.randrange(20, 100))], f"x{i}", *base[at + 1 :]])) for i in range(40)]
    try:
        found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).where("similar_to IS NOT NULL").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == 39 and plans
    for lines in plans:
        scans = [i for i, line in enumerate(lines) if "InMemoryTableScan" in line]
        assert len(scans) >= 2
        for i in scans:
            while any(x in lines[i] for x in ("InMemoryTableScan", "Project", "Filter", "ColumnarToRow")):
                i -= 1
            assert "Exchange" not in lines[i]
