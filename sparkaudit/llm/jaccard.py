"""Documents linked by the Jaccard similarity of their shingle sets, as blocked products of the document by shingle matrix.

Two documents link when 100 * common >= 80 * union, so a partner of a set of s shingles shares at least ceil(0.8 s) of them.

1. Each text becomes its set of 64-bit shingle hashes; equal sets are one row (``node``) of the matrix.
2. First bound. In the order of the hashes the first s - ceil(0.8 s) + k columns of two linked rows share at least k
   (``prefix``, with k three tenths of s). Only these entries travel, dealt by column, and each column says how many rows it
   has. A row with fewer than k columns that it shares with anyone has no link and goes: in prose nearly all do.
3. Second bound. Of what is left, linked rows share one of their rarest columns (all but k - 1). These are the candidates.
   Columns with the same rows are one.
4. Products. Rows meet in blocks and their overlaps are added up slab by slab of columns; a pair is dropped as soon as its
   count and what is left of the shorter row cannot reach the bound that follows from the two sizes. First each row goes to
   the block of one column that similar rows choose alike, cut into parts of bounded size, and those whose columns are not
   decided by that once more to other parts: this joins most of a large group
   of near copies at once, however many there are, at a cost linear in them. Then, for each column whose rows are still in several
   components, the rows outside its largest one are multiplied by all of its rows, in rectangles, so that no link between
   components is missed. Columns whose rows have all met already are left out. Links inside a component are not needed and not listed.

Columns with very many rows are found on a sample and ordered last, as all that matters is that both rows of a pair use one
order; they are not counted, so no task holds one. What is a set's own, its size and its node, is exact at 64-bit hashes:
two different shingles of one pair of documents would have to collide to change an overlap.

Defined results: NULL text and texts without words have an empty set, ``n_shingles`` 0, and are linked with nothing; fewer words
than a shingle are one shingle; a NULL doc_id can be linked but is no ``component_id`` unless its component has no other; rows that
repeat or share a doc_id are rows of their own; an empty table gives no rows. Very long texts are hashed in parts of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sparkaudit.llm.common import bounded, connected, mix, runs, salt, same_keys, texts_of, with_group_value
from sparkaudit.session import cut_lineage

WORDS = 5
PER_CENT = 80
#: Lower case and one kind of space. Lines part texts, so a text has none.
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: Bytes of a text that are split at once, and entries of a shard, about.
PART = 1 << 20
SHARD = 1 << 20
#: Rows of a block and entries of a block, about; columns of a slab.
BLOCK = 256
ENTRIES = 1 << 19
SLAB = 2048
#: A column of so many rows is ordered last: it is looked for among one document in SHARE, as HOT / SHARE rows there.
HOT = 200_000
SHARE = 1000
#: Bits of the table of documents whose sets are compared: 4 MB, whatever the input.
TABLE_BITS = 25
MANY = (1 << 31) - 1


# --- sets ------------------------------------------------------------------------------------


def words_of(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of a run, in order, and the words that each of its lines has. Different words are hashed once."""
    tokens = pc.split_pattern(pa.array([run.replace(b"\n", b" \n ")], pa.large_binary()), b" ").values.dictionary_encode()
    words, ids = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
    named = {w: i for i, w in enumerate(words) if w in (b"", b"\n")}
    ids = ids[ids != named.get(b"", -1)]
    ends = np.flatnonzero(ids == named.get(b"\n", -1))
    hashes = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    counts = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
    return hashes[ids[ids != named.get(b"\n", -1)]], counts


def chain(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words. Each word passes a mixer before the next one joins, so no pattern cancels."""
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run, one without words none."""
    found, carried, low = [], np.zeros(0, np.uint64), 0
    while low < len(text):
        high = min(len(text), low + PART)
        while high < len(text) and text[high : high + 1] not in b" \t\n\x0b\x0c\r":
            high += 1
        words = np.concatenate([carried, words_of(text[low:high].translate(NORMAL))[0]])
        if len(words) >= size:
            found.append(np.unique(chain(words, size)))
        carried, low = words[-(size - 1) :] if size > 1 else words[:0], high
    if not found and len(carried):
        found.append(chain(carried, len(carried)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def sets_in(texts: list[bytes], size: int) -> list[np.ndarray]:
    """``shingles`` of each text, with the words of many texts numbered together."""
    out = []
    for i, j in runs([len(t) for t in texts], PART):
        if j - i == 1:
            out.append(shingles(texts[i], size))
            continue
        words, counts = words_of(b"\n".join(t.translate(NORMAL) for t in texts[i:j]))
        every = chain(words, size) if len(words) >= size else words[:0]
        low = 0
        for n in counts.tolist():
            out.append(np.unique(every[low : low + n - size + 1]) if n >= size else chain(words[low : low + n], n) if n else words[:0])
            low += n
    return out


def node_of(row: np.ndarray) -> bytes | None:
    return hashlib.blake2b(row.tobytes(), digest_size=16).digest() if len(row) else None


def shared(n: int, per_cent: int) -> int:
    """Columns that a row of ``n`` shares with any partner."""
    return -(-per_cent * n // 100)


def in_prefix(n: int) -> int:
    """Columns that two rows share in their prefixes, at least, if the smaller one has ``n``."""
    return max(1, 3 * n // 10)


def prefix(n: int, per_cent: int) -> int:
    return min(n, n - shared(n, per_cent) + in_prefix(n))


def sizes_and_nodes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, node, part) of each row; ``part`` is the start of the node as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_in(texts_of(batch), size)
            nodes = [node_of(s) for s in sets]
            part = [None if n is None else int.from_bytes(n[:8], "little", signed=True) for n in nodes]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(part, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "node", "part"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, part bigint")


# --- columns ---------------------------------------------------------------------------------


def very_long_columns(docs: DataFrame, size: int, share: int, hot: int) -> np.ndarray:
    """Sorted columns with about ``hot`` rows or more; at most (all entries / hot) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in sets_in(texts_of(batch), size):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(row.view(np.int64)), pa.array([node_of(row)] * len(row))], ["gram", "node"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInArrow(run, "gram bigint, node binary").distinct()
    often = some.groupBy("gram").count().where(F.col("count") >= max(2, hot // share)).select("gram").toArrow()
    return np.sort(often.column("gram").to_numpy().view(np.uint64))


def first_columns(row: np.ndarray, last: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the order (very long columns last, hash): its ordinary columns and its very long ones."""
    long = np.isin(row, last) if len(last) else np.zeros(len(row), bool)
    n = prefix(len(row), per_cent)
    plain = row[~long]
    return plain[:n], row[long][: max(0, n - len(plain))]


def shared_columns(docs: DataFrame, size: int, per_cent: int, shards: int, last: np.ndarray) -> DataFrame:
    """(part, gram, rows): the entries of prefixes in columns of several rows; ``part`` is the start of the row's node."""
    sent = docs.sparkSession.sparkContext.broadcast(last)
    bits = shards.bit_length() - 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for i, j in runs([len(t) for t in texts], 8 << 20):
                entries, known = {}, {}
                for row in sets_in(texts[i:j], size):
                    if len(row):
                        node = node_of(row)
                        entries[node], known[node] = first_columns(row, sent.value, per_cent)
                out = []
                for kind, of in ((False, entries), (True, known)):
                    nodes = np.array([int.from_bytes(k[:8], "little") for k in of], np.uint64)
                    grams = np.concatenate([*of.values(), np.zeros(0, np.uint64)])
                    nodes = np.repeat(nodes, [len(g) for g in of.values()])
                    deal = nodes if kind else grams  # nothing is counted over very long columns, so their entries can lie anywhere
                    order = np.argsort(deal)
                    grams, nodes, deal = grams[order], nodes[order], deal[order]
                    cuts = np.searchsorted(deal >> np.uint64(64 - bits) if bits else np.zeros(len(deal), np.uint64), np.arange(shards + 1, dtype=np.uint64))
                    out += [(s, kind, grams[a:b].tobytes(), nodes[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                for low in range(0, len(out), 1024):
                    columns = zip(*out[low : low + 1024])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["shard", "known", "grams", "nodes"])

    def count(table: pa.Table) -> pa.Table:
        get = lambda rows, name: np.frombuffer(b"".join(rows.column(name).to_pylist()), np.uint64)
        plain, known = table.filter(pc.invert(table.column("known"))), table.filter(table.column("known"))
        grams, nodes = get(plain, "grams"), get(plain, "nodes")
        order = np.lexsort((nodes, grams))
        grams, nodes = grams[order], nodes[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])
        grams, nodes = grams[new], nodes[new]
        _, inverse, rows = np.unique(grams, return_inverse=True, return_counts=True)
        rows = rows[inverse]
        several = rows > 1
        far, far_nodes = get(known, "grams"), get(known, "nodes")
        columns = [np.concatenate([nodes[several], far_nodes]).view(np.int64), np.concatenate([grams[several], far]).view(np.int64)]
        return pa.table([*map(pa.array, columns), pa.array(np.concatenate([rows[several], np.full(len(far), MANY)]), pa.int64())], ["part", "gram", "rows"])

    packed = docs.mapInArrow(post, "shard int, known boolean, grams binary, nodes binary")
    found = packed.groupBy("shard").applyInArrow(count, "part bigint, gram bigint, rows bigint")
    return found.distinct() if len(last) else found  # several runs may have told of one entry of a very long column


def candidates(entries: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """(gram, node, n): the rarest shared columns of each row that can have links; columns with the same rows once."""
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * per_cent / 100) * 3 / 10)).cast("bigint")
    count = entries.groupBy("part").agg(F.count("*").alias("c"))
    open_rows = nodes.join(count, "part").where(F.col("c") >= needed).select("part", "node", "n", (F.col("c") - needed + 1).alias("most"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("rows", "gram"))
    rare = entries.join(open_rows, "part").withColumn("nth", nth).where("nth <= most").select("gram", "node", "n")
    rare = cut_lineage(rare.withColumn("s", salt("node")))
    hashed = [F.expr(f"bit_xor(xxhash64(node, {k}))") for k in (1, 2)]
    xor = [F.expr(f"bit_xor(x{k})") for k in (1, 2)]
    told = with_group_value(rare, ["gram"], "s", m=(F.count("*"), F.sum("m")), x1=(hashed[0], xor[0]), x2=(hashed[1], xor[1])).where("m > 1")
    once = told.groupBy("m", "x1", "x2").agg(F.min("gram").alias("gram")).select("gram")
    return told.select("gram", "node", "n", "s").join(once, "gram", "left_semi")


# --- products --------------------------------------------------------------------------------


def overlaps(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray, open_pairs: np.ndarray, per_cent: int) -> np.ndarray:
    """Which of the pairs (left x right rows) that are open reach the bound: products of slabs of columns, added up."""
    n = np.array([len(r) for r in rows], np.int64)
    needed = -(-per_cent * (n[left][:, None] + n[right][None]) // (100 + per_cent))  # 100 c >= p (a + b - c)
    alive = open_pairs & (np.minimum(n[left][:, None], n[right][None]) >= needed)
    grams = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), n)
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], of[order]
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]])) if len(grams) else np.zeros(1, np.int64)
    several = np.repeat(np.diff(edge) > 1, np.diff(edge))
    grams, of = grams[several], of[several]
    column = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    remaining = np.bincount(of, minlength=len(rows))
    total = np.zeros(alive.shape, np.int32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        alive &= total + np.minimum(remaining[left][:, None], remaining[right][None]) >= needed
        a, b = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(a):
            return alive
        i, j = np.searchsorted(column, [low, low + SLAB])
        dense = np.zeros((len(rows), SLAB), np.float32)
        dense[of[i:j], column[i:j] - low] = 1
        total[np.ix_(a, b)] += (dense[left[a]] @ dense[right[b]].T).astype(np.int32)
        remaining -= np.bincount(of[i:j], minlength=len(rows))
    return alive & (total >= needed)


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int]]:
    """As few of the links as join what they join."""
    root = list(range(size))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in zip(*np.nonzero(links)):
        x, y = top(left[a]), top(right[b])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(left[a]), int(right[b])))
    return out


def multiply(per_cent: int):
    """Links of a block (node, grams, side, root): rows of side 0 by those of side 1, or all by all, where their roots differ."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        rows = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        side, roots = table.column("side").to_numpy(), table.column("root").to_pylist()
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        root = np.array([number[r] for r in roots])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links = overlaps(rows, left, right, root[left][:, None] != root[right][None], per_cent)
        pairs = [(nodes[a], nodes[b]) for a, b in spanning(links, left, right, len(nodes))]
        return pa.table([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def links_of_blocks(blocks: DataFrame, sets: DataFrame, keys: list[str], per_cent: int) -> DataFrame:
    """Links found in ``blocks`` (keys, node, side, root)."""
    return blocks.join(sets, "node").select(*keys, "node", "grams", "side", "root").groupBy(*keys).applyInArrow(multiply(per_cent), "a binary, b binary")


def parts(rows: str, entries: str, block: int = BLOCK) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / block), F.ceil(F.col(entries) / ENTRIES)).cast("int")


def choice(columns: DataFrame, seed: int) -> DataFrame:
    """(node, home, block, root): each row of ``columns`` (gram, node, n, s, root) in one block, of the column of least hash among
    its own, cut into parts. Columns with several rows only."""
    chosen = columns.groupBy("node", "n", "s", "root").agg(F.min_by("gram", F.xxhash64("gram", F.lit(seed))).alias("home"))
    told = with_group_value(chosen, ["home"], "s", m=(F.count("*"), F.sum("m")), e=(F.sum("n"), F.sum("e"))).where("m > 1")
    return told.select("node", "home", F.pmod(F.xxhash64("node", F.lit(seed)), parts("m", "e")).alias("block"), "root")


def links_by_choice(blocks: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    return links_of_blocks(blocks.select("home", "block", "node", F.lit(2).alias("side"), "root"), sets, ["home", "block"], per_cent)


def undecided(columns: DataFrame, blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(gram, node, n, s, root, major, rows): the columns whose rows are neither of one component nor all in one of ``blocks``, with their
    rows' components and the largest of these."""
    met = blocks.select("node", F.xxhash64("home", "block").alias("b"))
    members = columns.select("gram", "node", "n", "s").join(met, "node", "left").join(roots, "node", "left")
    members = members.withColumn("root", F.coalesce("root", "node")).withColumn("b", F.coalesce("b", F.xxhash64("node")))
    first = members.groupBy("gram", "root", "s").agg(F.count("*").alias("k"), F.min("b").alias("b1"), F.max("b").alias("b2"))
    size = first.groupBy("gram", "root").agg(F.sum("k").alias("k"), F.min("b1").alias("b1"), F.max("b2").alias("b2"))
    whole = size.groupBy("gram").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.sum("k").alias("rows"), F.count("*").alias("roots"), F.min("b1").alias("b1"), F.max("b2").alias("b2"))
    return members.drop("b").join(whole.where("roots > 1 AND b1 <> b2").select("gram", "major", "rows"), "gram")


def links_between(open_rows: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links between components: in each column the rows outside its largest component meet all of its rows. Such rows are put into
    blocks by their longest column, which most of a group share, and the rows of all their columns come there once."""
    minor = open_rows.where("root <> major").groupBy("node", "root", "n", "s").agg(F.max_by("gram", F.struct("rows", "gram")).alias("lead"))
    told = with_group_value(minor, ["lead"], "s", m=(F.count("*"), F.sum("m")), e=(F.sum("n"), F.sum("e")))
    minor = cut_lineage(told.select("node", "root", "lead", F.pmod(F.xxhash64("node", F.lit(8)), parts("m", "e")).alias("i")))
    asked = open_rows.where("root <> major").select("gram", "node").join(minor.select("node", "lead", "i"), "node").select("gram", "lead", "i").distinct()
    met = cut_lineage(open_rows.select("gram", "node", "root", "n").join(asked, "gram").select("lead", "i", "node", "root", "n").distinct())
    across = met.groupBy("lead", "i").agg(F.count("*").alias("m"), F.sum("n").alias("e")).select("lead", "i", parts("m", "e").alias("across"))
    right = met.join(across, ["lead", "i"]).select("lead", "i", F.pmod(F.xxhash64("node", F.lit(9)), F.col("across")).cast("int").alias("j"), "node", F.lit(1).alias("side"), "root")
    left = minor.join(across, ["lead", "i"]).select("lead", "i", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), "node", F.lit(0).alias("side"), "root")
    return links_of_blocks(left.unionByName(right), sets, ["lead", "i", "j"], per_cent)


# --- the operator ----------------------------------------------------------------------------


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, bits: int) -> DataFrame:
    """(node, grams) of the ``wanted`` nodes (node, doc_id). A table of bits of bounded size says which texts to look at."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    slots = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy().astype(np.uint64)
            hit = (sent.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            batch = batch.filter(pa.array(hit))
            found = {node_of(row): row.tobytes() for row in sets_in(texts_of(batch), size) if len(row)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["node", "grams"])

    found = docs.select("text", place.alias("p")).mapInArrow(run, "node binary, grams binary")
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("grams").alias("grams"))


def linked(docs: DataFrame, per_cent: int = PER_CENT, size: int = WORDS, share: int = SHARE, hot: int = HOT, bits: int = TABLE_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    docs = bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = cut_lineage(sizes_and_nodes(docs, size))
    nodes = cut_lineage(rows.where("node IS NOT NULL").groupBy("node", "part").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id")))
    total = nodes.select(F.sum(F.col("n") * (100 - per_cent + 30) / 100)).first()[0] or 0
    shards = 1 << max(0, int(total // SHARD)).bit_length()
    entries = cut_lineage(shared_columns(docs, size, per_cent, shards, very_long_columns(docs, size, share, hot)))
    columns = cut_lineage(candidates(entries, nodes, per_cent))
    wanted = columns.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sets = cut_lineage(sets_of(docs, cut_lineage(wanted), size, bits))
    blocks = cut_lineage(choice(columns.withColumn("root", F.col("node")), 1))
    links = cut_lineage(links_by_choice(blocks, sets, per_cent))
    # the parts of a large group are joined by other parts
    open_rows = cut_lineage(undecided(columns, blocks, connected(links)))
    links = links.unionByName(cut_lineage(links_by_choice(choice(open_rows, 2), sets, per_cent)))
    open_rows = cut_lineage(undecided(open_rows, blocks, connected(links)))
    links = links.unionByName(cut_lineage(links_between(open_rows, sets, per_cent)))
    roots = connected(links).select(F.col("node"), F.col("root"))
    named = rows.where("node IS NOT NULL").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("s", salt("doc_id"))
    named = with_group_value(named, ["root"], "s", component_id=(F.min("doc_id"), F.min("component_id")))
    alone = rows.where("node IS NULL").withColumn("component_id", F.col("doc_id"))
    return named.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) ELSE [] END AS sh
  FROM w),
r AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS (SELECT rep, n, unnest(sh) AS g FROM r),
e AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM s LEFT JOIN r ON s.sh = r.sh LEFT JOIN c ON c.a = r.rep
"""
