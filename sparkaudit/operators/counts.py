"""Counts, identities and set comparisons. Every result is one or two map-side combined aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.functions.rules import where_predicate
from sparkaudit.operators.ordered import null_safe_join, previous_row
from sparkaudit.operators.selection import exact_quantiles
from sparkaudit.session import cut_lineage

SIDE = 4096  # keys of either axis that a tile of a grid has
STRIP = 256  # B keys of a tile that its A keys meet at a time


def count_by_rules(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """(name, group, n) for each rule, ``group`` NULL for the overall count.

    All rules of a table share one pass: a row emits one key per rule it meets, and the counts are
    combined before the shuffle.
    """
    hits = []
    for rule in rules:
        meets = where_predicate(rule.get("where"), df.columns)
        name = F.lit(rule["name"])
        group_by = rule.get("group_by")
        keys = [F.lit(None).cast("string")]
        if group_by:
            keys.append(F.coalesce(F.col(str(group_by)).cast("string"), F.lit("NA")))
        for key in keys:
            hits.append(F.when(meets, F.struct(name.alias("name"), key.alias("group"))))
    flat = df.select(F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    found = flat.groupBy("name", "group").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    names = spark.createDataFrame([(str(r["name"]), None) for r in rules], "name string, group string")
    missing = names.join(found.where(F.col("group").isNull()).select("name"), "name", "left_anti")
    return found.unionByName(missing.withColumn("n", F.lit(0).cast("bigint")))


def expected_strings(counts: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """(name, n, expect): the strings a text must contain, with {n} and {n_<group>} filled in.

    Groups are few: they are the values of a reporting column.
    """
    texts = [(str(r["name"]), e) for r in rules for e in (r.get("expect") or [])]
    spark = counts.sparkSession
    wanted = spark.createDataFrame(texts, "name string, template string")
    slots = counts.groupBy("name").agg(
        F.max(F.when(F.col("group").isNull(), F.col("n"))).alias("n"),
        F.collect_list(
            F.when(F.col("group").isNotNull(), F.struct(F.col("group").alias("g"), F.col("n").alias("v")))
        ).alias("groups"),
    )

    def fill(acc: Column, g: Column) -> Column:
        value = g["v"].cast("string")
        spaced = F.replace(acc, F.concat(F.lit("{n_"), g["g"], F.lit("}")), value)
        return F.replace(spaced, F.concat(F.lit("{n_"), F.replace(g["g"], F.lit(" "), F.lit("_")), F.lit("}")), value)

    filled = F.aggregate("groups", F.replace("template", F.lit("{n}"), F.col("n").cast("string")), fill)
    return wanted.join(slots, "name").select("name", "n", filled.alias("expect"))


def provenance(docs: DataFrame, expected: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document and rule: does the text contain the expected string?

    The expected strings are a few rows of the rule file. They travel as one array, read by a
    scalar subquery.
    """
    rules = expected.agg(F.array_sort(F.collect_list(F.struct("name", "expect", "n")))).scalar()
    flat = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), rules.alias("_r"))
    checked = F.transform(
        "_r", lambda r: F.struct(r["name"].alias("name"), r["expect"].alias("expect"), r["n"].alias("n"),
                                 F.contains(F.col("_t"), r["expect"]).alias("found"))
    )
    return flat.select("doc_id", F.inline(checked)).withColumn("status", F.when(F.col("found"), "PASS").otherwise("FAIL")).drop("found")


def exclusion_cascade(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """n after each filter in order, n excluded at the step, and n with only this filter dropped. One pass."""
    names = list(filters)
    true = F.lit(True)
    safe = {k: F.coalesce(v, F.lit(False)) for k, v in filters.items()}
    aggs = [F.count("*").alias("_start")]
    running = true
    for i, name in enumerate(names):
        running = running & safe[name]
        others = true
        for other in names:
            if other != name:
                others = others & safe[other]
        aggs += [F.count_if(running).alias(f"_k{i}"), F.count_if(others).alias(f"_d{i}")]
    row = df.agg(*aggs)
    steps = [F.struct(F.lit(0).alias("step"), F.lit("start").alias("filter"), F.col("_start").alias("n"),
                      F.lit(0).cast("bigint").alias("excluded"), F.lit(None).cast("bigint").alias("n_if_dropped"))]
    for i, name in enumerate(names):
        before = F.col(f"_k{i - 1}") if i else F.col("_start")
        steps.append(
            F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("filter"), F.col(f"_k{i}").alias("n"),
                     (before - F.col(f"_k{i}")).alias("excluded"), F.col(f"_d{i}").alias("n_if_dropped"))
        )
    return row.select(F.inline(F.array(*steps)))


def flow_balance(steps: DataFrame, keys: Sequence[str], step: str, n: str) -> DataFrame:
    """Stage counts with derived exclusions; the chain must fall monotonically."""
    prev = previous_row(steps, keys, step, [n])
    return prev.select(
        *keys, step, n, (F.col(f"prev_{n}") - F.col(n)).alias("excluded"),
        (F.col(f"prev_{n}").isNull() | (F.col(f"prev_{n}") >= F.col(n))).alias("monotone"),
    )


def balance_check(start: Column, kept: Column, *excluded: Column) -> Column:
    """start = kept + all exclusions."""
    total = kept
    for e in excluded:
        total = total + e
    return start == total


def identity_counts(df: DataFrame, sample: str, person: str, group: str, case: object, control: object,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Records, samples, persons, persons in both arms. An empty or constant person id is not an identity."""
    per = df.groupBy(*keys, person).agg(
        F.count("*").alias("_n"),
        F.max((F.col(group) == case).cast("int")).alias("_a"),
        F.max((F.col(group) == control).cast("int")).alias("_b"),
    )
    persons = per.groupBy(*keys).agg(
        F.sum("_n").alias("n_records"),
        F.count(F.col(person)).alias("_persons"),
        F.count_if(F.col(person).isNotNull() & (F.col("_a") == 1) & (F.col("_b") == 1)).alias("_both"),
    )
    samples = df.select(*keys, sample).distinct().groupBy(*keys).agg(F.count(sample).alias("n_samples"))
    known = F.col("_persons") > 1
    joined = null_safe_join(persons, samples, keys) if keys else _side_by_side(persons, samples)
    return joined.select(
        *keys, "n_records", "n_samples", F.when(known, F.col("_persons")).alias("n_persons"),
        F.when(known, F.col("_both")).alias("n_both_arms"),
        F.when(known, "available").otherwise("unavailable").alias("identity"),
    )


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row relations as one row."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def cross_group_duplicates(df: DataFrame, ident: str, group: str) -> DataFrame:
    """Ids in more than one record or more than one group."""
    return (
        df.where(F.col(ident).isNotNull())
        .groupBy(ident, group).agg(F.count("*").alias("_n"))
        .groupBy(ident).agg(F.sum("_n").alias("n_records"), F.count("*").alias("n_groups"))
        .where((F.col("n_records") > 1) | (F.col("n_groups") > 1))
    )


def design_class(df: DataFrame, keys: Sequence[str], ident: str, group: str, case: str, control: str,
                 min_pairs: int = 4) -> DataFrame:
    """Case-control or not from the label set; paired when enough ids stand in both arms."""
    per = df.groupBy(*keys, ident).agg(
        F.max((F.col(group) == case).cast("int")).alias("_a"),
        F.max((F.col(group) == control).cast("int")).alias("_b"),
        F.max((~F.col(group).isin(case, control)).cast("int")).alias("_o"),
    )
    out = per.groupBy(*keys).agg(
        F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.max("_o").alias("_o"),
        F.count_if(F.col(ident).isNotNull() & (F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_pairs"),
        F.count(F.col(ident)).alias("n_ids"),
    )
    design = (
        F.when((F.col("_a") == 0) | (F.col("_b") == 0) | (F.col("_o") == 1), "not_case_control")
        .when((F.col("n_ids") > 1) & (F.col("n_pairs") >= min_pairs), "paired")
        .otherwise("unpaired")
    )
    return out.select(*keys, "n_ids", "n_pairs", design.alias("design"))


def estimation_status(grid: DataFrame, est: DataFrame, keys: Sequence[str], estimate: str, p: str, alpha: float = 0.05
                      ) -> DataFrame:
    """not_analysed / not_estimable / not_significant / robust for every cell of the declared grid."""
    e = est.select(*keys, F.col(estimate).alias("_e"), F.col(p).alias("_p"), F.lit(True).alias("_row"))
    status = (
        F.when(F.col("_row").isNull(), "not_analysed")
        .when(F.col("_e").isNull() | F.isnan("_e"), "not_estimable")
        .when(F.col("_p") <= alpha, "robust")
        .otherwise("not_significant")
    )
    return grid.join(e, list(keys), "left").withColumn("status", status).drop("_e", "_p", "_row")


def grid_gaps(a: DataFrame, b: DataFrame, fact: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Missing cells of the full grid n(A) x n(B), without building the grid.

    Both axes are dealt by hash into tiles of some ``SIDE`` x ``SIDE`` cells, one for a task. A tile gets its present pairs, one mark
    for each of its A keys and its B keys in strips of some ``STRIP``; a mark meets the strips, less what is present, and is expanded
    where the result is read. So cells never move between tasks. A task has its cells strip by strip, and the A keys of a strip one
    after the other: the runs of one column and the short cycles of the other take columnar formats some tenth of a byte for a cell.
    A NULL B key is left out; a NULL A key lacks all cells.
    """
    a_axis = cut_lineage(a.select(F.col(a_key).alias("_a")).distinct())
    b_axis = cut_lineage(b.where(F.col(b_key).isNotNull()).select(F.col(b_key).alias("_b")).distinct())
    n_a, n_b, cores = a_axis.count(), b_axis.count(), a.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n_b // SIDE), 1)
    chunks = max(-(-n_a // SIDE), min(n_a, -(-cores // blocks)), 1)
    strips = max(-(-n_b // (blocks * STRIP)), 1)
    chunk, block, strip = F.pmod(F.xxhash64("_a"), F.lit(chunks)), F.pmod(F.xxhash64("_b"), F.lit(blocks)), lambda c: F.pmod(F.hash(c), F.lit(strips))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Keys hash alike only as one type. A fact that the type of its axis cannot hold is on no axis.
    typed = {c: F.col(k).try_cast(axis.schema[c].dataType) for c, k, axis in (("_a", a_key, a_axis), ("_b", b_key, b_axis))}
    same = [typed[c].isNotNull() & typed[c].eqNullSafe(F.col(k)) for c, k in (("_a", a_key), ("_b", b_key))]
    held = fact.where(same[0] & same[1]).select(typed["_a"].alias("_a"), typed["_b"].alias("_b")).distinct()
    keys = b_axis.groupBy(block.alias("_block"), strip("_b").alias("_strip")).agg(F.array_sort(F.collect_list("_b")).alias("_keys"))
    dealt = (
        held.select((chunk * blocks + block).alias("_tile"), "_a", "_b")
        .unionByName(a_axis.select("_a", chunk.alias("_chunk"), every(blocks).alias("_block")).select((F.col("_chunk") * blocks + F.col("_block")).alias("_tile"), "_a"), True)
        .unionByName(keys.select(every(chunks).alias("_chunk"), "_block", "_keys").select((F.col("_chunk") * blocks + F.col("_block")).alias("_tile"), "_keys"), True)
        .repartition(chunks * blocks + 4 * cores, "_tile")
    )
    of = F.when(F.col("_keys").isNotNull(), F.array(strip(F.col("_keys")[0]))).when(F.col("_b").isNotNull(), F.array(strip("_b")))
    mark = F.col("_keys").isNull() & F.col("_b").isNull()
    cut = dealt.select("_tile", "_a", "_b", "_keys", mark.alias("_mark"), F.explode(F.coalesce(of, F.sequence(F.lit(0), F.lit(strips - 1)))).alias("_strip"))
    cut = cut.groupBy("_tile", "_strip", F.col("_keys").isNull().alias("_row"), "_a").agg(
        F.first("_keys", True).alias("_keys"), F.collect_list("_b").alias("_held"), F.max("_mark").alias("_mark")
    )
    rows = cut.withColumn("_keys", F.first("_keys").over(Window.partitionBy("_tile", "_strip").orderBy("_row", "_a")))
    left = F.when(F.size("_held") == 0, F.col("_keys")).otherwise(F.array_except("_keys", "_held"))
    return rows.where("_mark").select(F.col("_a").alias(a_key), F.explode(left).alias(b_key))


def coverage(members: DataFrame, present: DataFrame, set_key: str, member: str, group: str,
             thresholds: Sequence[float] = (0.6, 0.8, 0.9)) -> DataFrame:
    """Share of a set's members present per group, and whether it passes each threshold."""
    m = members.select(set_key, member).distinct()
    size = m.groupBy(set_key).agg(F.count("*").alias("n_members"))
    found = present.select(group, member).distinct().join(m, member).groupBy(set_key, group).agg(
        F.count("*").alias("n_present")
    )
    share = F.col("n_present") / F.col("n_members")
    return found.join(size, set_key).select(
        set_key, group, "n_present", "n_members", share.alias("coverage"),
        *[(share >= x).alias(f"ge_{int(x * 100)}") for x in thresholds],
    )


def set_overlap(df: DataFrame, set_key: str, member: str, sets: Sequence[str] | None = None) -> DataFrame:
    """Pairwise Jaccard and containment of the sets that share a member, of all or of the named ones.

    Membership patterns are counted first: members with the same pattern collapse to one row, so a
    pair never needs a self join on members.
    """
    patterns = (
        (df if sets is None else df.where(F.col(set_key).isin(*sets)))
        .groupBy(member)
        .agg(F.array_sort(F.collect_set(set_key)).alias("_p"))
        .groupBy("_p")
        .agg(F.count("*").alias("_n"))
    )
    pairs = patterns.select(
        "_n", F.explode("_p").alias("set_a"), "_p"
    ).select("_n", "set_a", F.explode("_p").alias("set_b")).groupBy("set_a", "set_b").agg(F.sum("_n").alias("inter"))
    own = pairs.where(F.col("set_a") == F.col("set_b"))
    a = own.select("set_a", F.col("inter").alias("size_a"))
    b = own.select("set_b", F.col("inter").alias("size_b"))
    full = pairs.where(F.col("set_a") < F.col("set_b")).join(a, "set_a").join(b, "set_b")
    return full.withColumn("jaccard", F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter"))).withColumn(
        "a_in_b", F.col("inter") / F.col("size_a")
    )


def cluster_estimators(df: DataFrame, cluster: str, field: str) -> DataFrame:
    """Per cluster: any present, any present or partial, all present."""
    return df.groupBy(cluster).agg(
        F.bool_or(F.col(field) == "present").alias("any_present"),
        F.bool_or(F.col(field).isin("present", "partial")).alias("any_present_partial"),
        F.bool_and(F.col(field) == "present").alias("all_present"),
    )


def agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Raw agreement, Cohen's kappa and Gwet's AC1 from the category table."""
    table = df.groupBy(*keys, a, b).agg(F.count("*").alias("_n"))
    sides = table.select(
        *keys, "_n", (F.col(a) == F.col(b)).alias("_same"),
        F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col(a).cast("string").alias("c")),
                          F.struct(F.lit("b").alias("s"), F.col(b).cast("string").alias("c")))).alias("_x"),
    )
    per = sides.groupBy(*keys, F.col("_x.c").alias("_c")).agg(
        F.sum(F.when(F.col("_x.s") == "a", F.col("_n")).otherwise(0)).alias("_na"),
        F.sum(F.when(F.col("_x.s") == "b", F.col("_n")).otherwise(0)).alias("_nb"),
        F.sum(F.when((F.col("_x.s") == "a") & F.col("_same"), F.col("_n")).otherwise(0)).alias("_agree"),
    )
    n, k = F.sum("_na"), F.count("*")
    out = per.groupBy(*keys).agg(
        n.alias("n"), k.alias("n_categories"), (F.sum("_agree") / n).alias("raw"),
        (F.sum(F.col("_na") * F.col("_nb").cast("double")) / (n * n.cast("double"))).alias("_pe"),
        F.sum(F.col("_na") + F.col("_nb")).alias("_m"),
        F.sum(F.pow((F.col("_na") + F.col("_nb")).cast("double"), F.lit(2.0))).alias("_m2"),
    )
    # sum p(1-p) with p = (na+nb)/2n
    pe_g = F.when(
        F.col("n_categories") > 1,
        (F.col("_m") / (2 * F.col("n")) - F.col("_m2") / (4.0 * F.col("n") * F.col("n"))) / (F.col("n_categories") - 1),
    ).otherwise(F.lit(0.0))
    ac1 = F.when(pe_g < 1, (F.col("raw") - pe_g) / (1 - pe_g)).otherwise(F.lit(0.0))
    kappa = F.when(F.col("_pe") < 1, (F.col("raw") - F.col("_pe")) / (1 - F.col("_pe")))
    return out.select(*keys, "n", "raw", kappa.alias("kappa"), ac1.alias("ac1"))


def double_dated(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Records with two different years, and by how much per-year counts exceed the records."""
    both = first.isNotNull() & second.isNotNull()
    return df.agg(
        F.count("*").alias("n_records"),
        F.count_if(both & (first != second)).alias("n_double"),
        (F.count(first) + F.count(second) - F.count_if(both & (first == second))).alias("yearly_sum"),
    ).withColumn("share", F.col("n_double") / F.col("n_records"))


def split_status(df: DataFrame, indexed: DataFrame, corpus: DataFrame, eligible: Column, key: str) -> DataFrame:
    """Indexing, corpus membership and eligibility as three independent fields."""
    i = indexed.select(key).distinct().withColumn("_i", F.lit(True))
    c = corpus.select(key).distinct().withColumn("_c", F.lit(True))
    return (
        df.join(i, key, "left").join(c, key, "left")
        .withColumn("indexed", F.coalesce("_i", F.lit(False)))
        .withColumn("in_corpus", F.coalesce("_c", F.lit(False)))
        .withColumn("eligible", F.coalesce(eligible, F.lit(False)))
        .drop("_i", "_c")
    )


def fourway_outcome(df: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """both / a only / b only / neither / missing, and do the parts close to n."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"),
        F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"),
        F.count_if(a.isNull() | b.isNull()).alias("missing"),
    )
    parts = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither") + F.col("missing")
    return out.withColumn("closes", parts == F.col("n"))


def missing_rates(df: DataFrame, columns: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Missing share per column on the declared cohort, one pass."""
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(c.isNull()).alias(f"_m_{k}") for k, c in columns.items()]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"_m_{k}").alias("n_missing")) for k in columns])
    return wide.select(*keys, "n", F.inline(rows)).withColumn("rate", F.col("n_missing") / F.col("n"))


def complete_cases(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows with all columns filled and a positive weight."""
    kept = df.dropna(subset=list(columns))
    return kept.where(F.col(weight) > 0) if weight else kept


def range_claims(claims: DataFrame, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A claimed range must equal the actual extremes. ``claims`` has claim_lo and claim_hi."""
    actual = table.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ok = (F.col("claim_lo") == F.col("lo")) & (F.col("claim_hi") == F.col("hi"))
    return claims.join(actual, list(keys), "left").withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def identical_results(results: DataFrame, reference: str, subset: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sensitivity rows equal to their reference row in every value: the restriction did not act."""
    ref = results.where(F.col(subset) == reference).select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values])
    same = None
    for v in values:
        term = F.col(v).eqNullSafe(F.col(f"_r_{v}"))
        same = term if same is None else same & term
    return results.where(F.col(subset) != reference).join(ref, list(keys)).where(same).drop(*[f"_r_{v}" for v in values])


def transition_matrix(df: DataFrame, old: Column, new: Column, levels: Sequence[str]) -> DataFrame:
    """Counts old x new with an explicit missing level and the row total; totals are conserved."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("missing"))
    cols = [*levels, "missing"]
    return df.groupBy(name(old).alias("old")).agg(
        *[F.count_if(name(new) == c).alias(f"to_{c}") for c in cols], F.count("*").alias("total")
    )


def identity_violations(df: DataFrame, keys: Sequence[str], identities: Mapping[str, tuple[Column, Column]], tol: float
                        ) -> DataFrame:
    """Rows where a stated equality fails by more than ``tol``."""
    rows = F.array(*[F.struct(F.lit(k).alias("identity"), (l - r).alias("gap")) for k, (l, r) in identities.items()])
    return df.select(*keys, F.inline(rows)).where(F.abs("gap") > tol)


def modal_deviants(df: DataFrame, keys: Sequence[str], attr: str) -> DataFrame:
    """Values other than the most frequent one of their group (ties: the smallest value wins)."""
    n = df.groupBy(*keys, attr).agg(F.count("*").alias("n"))
    mode = n.groupBy(*keys).agg(F.max("n").alias("_top"), F.count("*").alias("n_values"))
    best = n.join(mode, list(keys)).where(F.col("n") == F.col("_top")).groupBy(*keys).agg(
        F.min(attr).alias("mode"), F.max("n_values").alias("n_values")
    )
    return n.join(best, list(keys)).where(F.col(attr) != F.col("mode"))


def mad_outliers(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Flag values further than k MADs from the group median; nothing is deleted. Both medians are exact selections."""
    median = lambda d, v, name: exact_quantiles(d, keys, v, [0.5]).select(*keys, F.col("quantile").alias(name))
    with_med = null_safe_join(df, median(df, F.col(value), "median"), keys, "left")
    dev = F.abs(F.col(value) - F.col("median"))
    return null_safe_join(with_med, median(with_med, dev, "mad"), keys, "left").withColumn("outlier", dev > k * F.col("mad"))


def duplicate_content(df: DataFrame, text: Column, copy_key: Sequence[str], min_copies: int = 2) -> DataFrame:
    """Content hashes that occur more than once: copies, distinct owners, first owner."""
    h = F.sha2(text, 256)
    return (
        df.select(h.alias("hash"), *copy_key)
        .groupBy("hash", *copy_key).agg(F.count("*").alias("_n"))
        .groupBy("hash")
        .agg(F.sum("_n").alias("copies"), F.count("*").alias("owners"), F.min(F.struct(*copy_key)).alias("_first"))
        .where(F.col("copies") >= min_copies)
        .select("hash", "copies", "owners", "_first.*")
    )


def content_matrix(df: DataFrame, text: Column, file: str, files: Sequence[str]) -> DataFrame:
    """Blocks by normalised hash and how often each file holds them; only blocks held more than once."""
    wide = df.groupBy(F.sha2(text, 256).alias("hash")).agg(
        *[F.count_if(F.col(file) == f).alias(f) for f in files], F.count("*").alias("copies")
    )
    return wide.where(F.col("copies") > 1)
