"""Near-duplicate documents by word shingles: an exact set join on the rarest shingles of each set."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions.text import lower_words
from sparkaudit.operators.ordered import prefix_sums
from sparkaudit.session import cut_lineage, evaluate_once

SHINGLE = 5
COUNTED = 0.4  # share of the hash range whose shingles are counted; a prefix at 0.8 takes a fifth of a set
WORDS = 8  # of 64 bits in a parity map
EARLIER = 3  # keys before a key that its row names


def shingle_set(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of runs of ``size`` words, in lower case; a shorter text is one run, an empty one none."""
    words = lower_words(text)

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))))

    return F.when(F.size(words) > 0, F.get(F.transform(F.array(words), runs), 0)).otherwise(F.array().cast("array<bigint>"))


def _set_name(shingles: Column) -> Column:
    """128 bits of hash and the size: equal for equal sets."""
    return F.concat_ws(":", F.xxhash64(shingles).cast("string"), F.xxhash64(F.lit("set"), shingles).cast("string"), F.size(shingles).cast("string"))


def _prefix_length(n: Column, min_ratio: float) -> Column:
    """How many of the first members of a set, in any order all sets share, hold a member of each set that matches it."""
    return n - F.ceil(n * min_ratio - 1e-9) + 1


def _prefixes(sets: DataFrame, min_ratio: float) -> DataFrame:
    """(key, rep_id, n, pos, earlier): each set's prefix, without members that no other set has.

    ``sets`` has rep_id, n, ``counted`` (shingles in the counted part of the hash range, least first) and ``others`` (the
    first ones outside it that a prefix can need). The order is: counted shingles from rare to frequent, then the others by
    hash. Members that occur once hold their places at the front, but nobody can meet in them. ``earlier`` are the last keys
    before this one.
    """
    counted = sets.select("rep_id", F.explode("counted").alias("key"))
    shared = cut_lineage(counted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"))
    met = counted.join(shared, "key").groupBy("rep_id").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("met"))
    known = sets.join(met, "rep_id", "left").select(
        "rep_id", "n", "others", _prefix_length(F.col("n"), min_ratio).alias("p"), F.size("counted").alias("c"), F.coalesce("met", F.array().cast("array<struct<often:bigint,key:bigint>>")).alias("met")
    )
    known = known.withColumn("alone", F.col("c") - F.size("met"))
    first = F.transform(F.slice("met", 1, F.greatest(F.col("p") - F.col("alone"), F.lit(0)).cast("int")), lambda m, i: F.struct(m["key"].alias("key"), (F.col("alone") + i).alias("pos")))
    then = F.transform(F.slice("others", 1, F.greatest(F.col("p") - F.col("c"), F.lit(0)).cast("int")), lambda h, i: F.struct(h.alias("key"), (F.col("c") + i).alias("pos")))
    listed = evaluate_once(known, keys=F.concat(first, then))
    named = F.transform("keys", lambda k, i: F.struct(k["key"].alias("key"), k["pos"].cast("bigint").alias("pos"), F.slice(F.col("keys")["key"], F.greatest(i - EARLIER, F.lit(0)) + 1, F.least(i, F.lit(EARLIER))).alias("earlier")))
    return listed.select("rep_id", F.col("n").cast("bigint").alias("n"), F.inline(named)).select("key", "rep_id", "n", "pos", "earlier")


def _parity_maps(sets: DataFrame) -> DataFrame:
    """(rep_id, m0, m1, ...): each member flips one bit, so two maps differ in at most as many bits as their sets in members."""
    members = sets.select("rep_id", F.explode("shingles").alias("h")).select("rep_id", F.pmod("h", F.lit(WORDS)).alias("word"), F.shiftright("h", 3).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    flip = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    return members.groupBy("rep_id").agg(*[F.coalesce(F.bit_xor(F.when(F.col("word") == i, flip)), F.lit(0).cast("bigint")).alias(f"m{i}") for i in range(WORDS)])


def _can_match(min_ratio: float) -> Column:
    """Whether this key can be the first that two matching sets share: so each pair is met in few keys, and none is lost.

    None of the keys named before it is shared; sizes and places still allow the overlap that the ratio asks for; the
    parity maps differ in no more bits than matching sets in members.
    """
    n, m = F.col("n"), F.col("lead_n")
    overlap = F.least(n - F.col("pos"), m - F.col("lead_pos"))
    differ = sum((F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"lead_m{i}"))) for i in range(WORDS)), F.lit(0))
    sizes = (F.least(n, m) >= F.greatest(n, m) * min_ratio - 1e-9) & (overlap >= (n + m) * (min_ratio / (1 + min_ratio)) - 1e-9)
    return sizes & (differ <= (n + m) * ((1 - min_ratio) / (1 + min_ratio)) + 1e-9) & ~F.arrays_overlap("earlier", "lead_earlier")


def _smallest_matches(ranked: DataFrame, sets: DataFrame, min_ratio: float) -> DataFrame:
    """(rep_id, lead, ratio): the smallest match of each member of ``ranked`` (key, rep_id, place, and what ``_can_match`` reads) among those before it."""
    traits = ["n", "pos", "earlier", *[f"m{i}" for i in range(WORDS)]]
    a = sets.select("rep_id", F.col("shingles").alias("_a"))
    b = sets.select(F.col("rep_id").alias("lead"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    ratio = F.col("_i") / (F.col("_s") - F.col("_i"))
    asking = ranked.withColumn("found", F.lit(None).cast("bigint"))
    best, low, high = None, 0, 1
    while True:
        leads = ranked.where((F.col("place") >= low) & (F.col("place") < high)).select("key", F.col("rep_id").alias("lead"), *[F.col(c).alias(f"lead_{c}") for c in traits])
        open_pairs = (F.col("lead") < F.col("rep_id")) & (F.col("found").isNull() | (F.col("lead") < F.col("found")))
        pairs = cut_lineage(asking.join(leads, "key").where(open_pairs & _can_match(min_ratio)).select("rep_id", "lead").distinct())
        scored = pairs.join(a, "rep_id").join(b, "lead").select("rep_id", "lead", both.alias("_i"), (F.size("_a") + F.size("_b")).alias("_s"))
        found = scored.withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio).select("rep_id", "lead", "ratio")
        found = found if best is None else found.unionByName(best)
        best = cut_lineage(found.groupBy("rep_id").agg(F.min(F.struct("lead", "ratio")).alias("_m")).select("rep_id", "_m.*"))
        # who has more before it at the key, and no match at or below the next of these
        following = ranked.where(F.col("place") == high).select("key", F.col("rep_id").alias("_next"))
        more = asking.drop("found").where(F.col("place") > high).join(following, "key")
        more = more.join(best.select("rep_id", F.col("lead").alias("found")), "rep_id", "left").where("found IS NULL OR _next < found")
        asking = cut_lineage(more.select("key", "rep_id", "place", "found", *traits))
        if asking.isEmpty():
            return best
        low, high = high, high * 4


def near_duplicates(docs: DataFrame, min_ratio: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rep_id, similar_to, ratio), one row per document.

    ``rep_id`` is the smallest document with the same set of shingles. ``similar_to`` is the smallest other representative
    below it whose set's Jaccard ratio is at least ``min_ratio``. Two such sets share a member of their prefixes, the first
    (1 - ratio) n + 1 members in a common order from rare to frequent, so the prefixes are the join keys and none is lost.
    The sets of a key are compared with its smallest, then those that still lack a match with the next, in rounds of four
    times as many, until each has its smallest match or was compared with all before it: a family of edited copies gives
    about as many comparisons as it has members. Sets are built anew for those who meet somebody; only the counted part of
    each set is kept before that. Texts without words are never similar. A doc_id with several texts stands for one of them.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    made = evaluate_once(texts, shingles=F.array_sort(shingle_set(F.coalesce("_text", F.lit("")))))
    border = F.lit(int(-(2**63) + COUNTED * 2**64))
    n = F.size("shingles")
    most = F.greatest(_prefix_length(n, min_ratio), F.lit(1)).cast("int")
    counted = F.filter("shingles", lambda h: h < border)
    parts = evaluate_once(made.select("doc_id", "shingles"), counted=counted)
    others = F.slice("shingles", F.size("counted") + 1, F.greatest(most - F.size("counted"), F.lit(0)))
    rows = cut_lineage(parts.select("doc_id", _set_name(F.col("shingles")).alias("same"), n.alias("n"), "counted", others.alias("others")))
    members = cut_lineage(rows.groupBy("same").agg(F.min("doc_id").alias("rep_id")))
    chosen = rows.join(members, (rows.same == members.same) & (rows.doc_id == members.rep_id)).where("n > 0")
    sets = cut_lineage(chosen.select("rep_id", members.same, "n", "counted", "others").dropDuplicates(["rep_id"]))
    keys = cut_lineage(_prefixes(sets, min_ratio))
    places = prefix_sums(keys.select("key", "rep_id"), ["key"], "rep_id", {"one": F.lit(1)}).where("one_total > 1")
    places = cut_lineage(places.select("key", "rep_id", F.col("one_before").alias("place")))
    meeting = cut_lineage(places.select("rep_id").distinct().join(sets.select("rep_id", "same"), "rep_id"))
    again = evaluate_once(texts.join(meeting, texts.doc_id == meeting.rep_id).select("rep_id", "same", "_text"), shingles=F.array_sort(shingle_set(F.coalesce("_text", F.lit("")))))
    written = cut_lineage(again.where(_set_name(F.col("shingles")) == F.col("same")).select("rep_id", "shingles").dropDuplicates(["rep_id"]))
    # dealt out once, so that in each round the pairs come to the sets and no set moves again
    whole = written.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep_id").persist(StorageLevel.DISK_ONLY)
    ranked = cut_lineage(places.join(keys, ["key", "rep_id"]).join(_parity_maps(whole), "rep_id"))
    best = _smallest_matches(ranked, whole, min_ratio)
    whole.unpersist()
    named = members.join(best, "rep_id", "left").select("same", "rep_id", F.col("lead").alias("similar_to"), "ratio")
    return rows.select("doc_id", "same").join(cut_lineage(named), "same").select("doc_id", "rep_id", "similar_to", "ratio")
