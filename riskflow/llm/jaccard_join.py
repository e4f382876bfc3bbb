"""N-gram Jaccard join in the metric space of Jaccard distance: pivots, regions, triangle-inequality windows, recursion.

A document is its set of distinct 5-word shingles (64-bit hashes); documents with equal sets are one node. Two nodes link
if their similarity is at least 0.75, that is their distance at most r = 0.25. The result is the connected components.

Regions. In a space where almost all distances are 1, a random pivot sees nobody; so regions grow around shared hashes.
Each node keeps its `SKETCH` smallest shingle hashes. The smallest hashes of the union of two linked nodes are shared with
chance >= 0.75 each, so linked nodes have less than a quarter of them in common with chance below 1e-15 (of two sets of up
to `SKETCH` shingles, kept whole, three quarters are certain; of one such set and a larger one only the quarter is safe). All nodes with hash t in their sketch are region t;
its pivot is the member with the smallest key, hence the same for most of the hashes that a group of copies shares. Every
member measures its distance to the pivots of its regions: sizes and sketches rule out most, the others are computed from
the whole sets. Members within r form the pivot's ball and are linked.

Recursion. A region is settled when its other members are in one component. Else it is joined again without its pivot.
Ball members stay in it only inside the window: if some member x outside has d(x, p) <= d(y, p) + r, since by the triangle
inequality no closer y can link to x. A node whose open regions hold less than a quarter of its sketch has met each of its partners in a settled one and leaves.
So all links not yet met lie among the open nodes, and a shingle that only one open node has is in none of them: counted
over the whole sets of the open nodes, the shingles that a node shares with any other bound its similarity to every partner by
the sizes, and nodes that share too little leave as well. Texts that have only a passage in common, and copies edited too much to
link, go that way without meeting each other. In the second round a region's pivot is the member that shares most, the
centre of a family of copies, which settles nearly all of it. In the last round all regions of one pivot are a Voronoi cell, a node at
the border lies in the cells of all its regions, and in each cell all members outside its largest component are compared with
every other one, exactly. There is no cap on members, candidates or cells.

Scale. Regions are (hash, node) rows, aggregated with map-side combine; sets are taken from the texts once for the first
round's candidates and once for the open nodes of the further rounds (a bitmap of fixed size picks them in the scan, an
exact join follows), and shipped to their pivot, whose members are salted into
groups of `SALT_ROWS`; a task streams its members past the pivot's set. No group is collected anywhere.

Defined results: null text is empty, has no shingle and is its own component; equal texts and repeated rows share a
component; a null id takes part, component_id is the smallest non-null id in reach (null if there is none; an empty
document's own id); only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskflow.llm.common import U, chunks, cut, drop_cut, flat, mix64, shingles, signed, table, word_hashes, word_spans

WORDS, SKETCH = 5, 64
LEAST_PERCENT = 75
R = 1 - LEAST_PERCENT / 100
BITMAP_WORDS = 1 << 19               # 64-bit words of the scan's bitmap: 4 MB, whatever the input
SALT_ROWS = 2000
BLOCK_TOKENS = 1 << 18               # shingles of the compared sets that a task of the last round holds
PRUNES = 2                           # passes a round that drop nodes without a possible partner


def sets_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, first, key): sorted distinct shingle hashes of each text and a 64-bit key of the set (0: empty)."""
    starts, ends, first = word_spans(data, offs)
    values, at = shingles(word_hashes(data, starts, ends, lower=True), first, WORDS)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix64(values ^ U(0x5851F42D4C957F2D)))])
    n = np.diff(at)
    key = mix64(total[at[1:]] - total[at[:-1]] + n.astype(U) * U(0x9E3779B97F4A7C15))
    return values, at, np.where(n == 0, U(0), np.where(key == 0, U(1), key))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, node, n, sketch); the sketch only for the first of equal sets in the task."""
    seen: set[int] = set()
    for batch in batches:
        data, offs = flat(batch.column(1))
        for i, j, part, at in chunks(data, offs):
            values, first, key = sets_of(part, at)
            n, nodes = np.diff(first), signed(key)
            new = np.zeros(j - i, bool)
            for d, k in enumerate(nodes.tolist()):
                if k and k not in seen:
                    seen.add(k)
                    new[d] = True
            size = np.where(new, np.minimum(n, SKETCH), 0)
            ends = np.concatenate([[0], np.cumsum(size)])
            pos = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[:-1], size)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(values[pos])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(nodes), pa.array(n, pa.int64()), lists],
                                             names=["id", "node", "n", "sketch"])


def _sets(bitmap):
    """Task function: text -> (node, set as bytes) of nodes whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = np.frombuffer(bitmap.value, U), set()
        for batch in batches:
            data, offs = flat(batch.column(0))
            for i, j, part, at in chunks(data, offs):
                values, first, key = sets_of(part, at)
                word = key & U(BITMAP_WORDS - 1)
                hit = (key != 0) & ((words[word.astype(np.int64)] >> (key >> U(58))) & U(1)).astype(bool)
                nodes, blobs = [], []
                for d in np.flatnonzero(hit):
                    k = int(key[d])
                    if k not in seen:
                        seen.add(k)
                        nodes.append(d)
                        blobs.append(values[first[d]:first[d + 1]].tobytes())
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key[nodes])), pa.array(blobs, pa.binary())], names=["node", "items"])
    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, salt, member, node, items) in order, the pivot's own row first -> (x, p, common)."""
    current, pivot = None, np.zeros(0, U)
    for batch in batches:
        p, member, node, items = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
        xs, ps, common = [], [], []
        for i in range(batch.num_rows):
            own = np.frombuffer(items[i].as_buffer(), U)
            if member[i] == 0:
                current, pivot = p[i], own.copy()
                continue
            if current != p[i]:
                raise ValueError("a member came before its pivot")
            at = np.searchsorted(pivot, own)
            at[at == len(pivot)] = 0
            xs.append(node[i])
            ps.append(p[i])
            common.append(int((pivot[at] == own).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ps, pa.int64()), pa.array(common, pa.int64())], names=["x", "p", "common"])


def bitmap_of(nodes: DataFrame):
    """Fixed-size bitmap of node keys: the low bits choose the word, the top six the bit."""
    bit = F.shiftrightunsigned("node", 58).cast("int")
    rows = (nodes.select(F.col("node").bitwiseAND(F.lit(BITMAP_WORDS - 1)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m"))
            .groupBy("w").agg(F.bit_or("m").alias("m"))).toArrow()
    words = np.zeros(BITMAP_WORDS, np.int64)
    words[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return nodes.sparkSession.sparkContext.broadcast(words.tobytes())


def sets_of_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items): whole sets of the texts whose node is in `nodes` (and of a few others with the same bit)."""
    return texts.mapInArrow(_sets(bitmap_of(nodes)), "node long, items binary")


def distances(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, p, common) of the pairs (x, p), from whole sets."""
    spark = pairs.sparkSession
    salts = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "p").select("p", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("x").alias("node"))
    pivots = salts.select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("p").alias("node"))
    shipped = sets.join(members.union(pivots), "node").select("p", "salt", "member", "node", "items")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = shipped.repartition(n, "p", "salt").sortWithinPartitions("p", "salt", "member")
    return ordered.mapInArrow(_measure, "x long, p long, common long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node key in reach for every node of the edges (x, p); large-star / small-star rounds."""
    both = cut(edges.select(F.greatest("x", "p").alias("a"), F.least("x", "p").alias("b")).where("a != b").distinct())
    while True:
        around = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # every larger neighbour now points to the smallest one around; then the same among the smaller ones
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = cut(small.where("a != b").distinct())
        stable = new.count() == both.count() and new.exceptAll(both).isEmpty()
        drop_cut(both)
        both = new
        if stable:
            return both.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def shared_counts(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, c): how many shingles of each of the given nodes (x, n) some other of them has too."""
    chosen = sets.join(nodes.select(F.col("x").alias("node")), "node", "left_semi")
    alone = chosen.mapInArrow(_tokens, "token long, node long").groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("x"))
    alone = alone.where("k = 1").groupBy("x").agg(F.count(F.lit(1)).alias("alone"))
    return nodes.join(alone, "x", "left").select("x", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, items) -> (token, node), in batches of bounded size."""
    for batch in batches:
        for node, items in zip(batch.column("node").to_pylist(), batch.column("items")):
            own = np.frombuffer(items.as_buffer(), np.int64)
            for i in range(0, len(own), 1 << 16):
                part = own[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node, np.int64))], names=["token", "node"])


def can_link(c, n, other):
    """Whether sets of n and `other` shingles can link if they share at most c."""
    return (100 + LEAST_PERCENT) * c >= LEAST_PERCENT * (n + other)


def possible_rows(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (t, x, n) whose node can still link to some member of their region, with c and the spread (the share of
    the node's shingles that no other open node has): all unmet links lie among the open nodes, so a partner holds none of
    the shingles that only x has, and is no smaller than the region's smallest member."""
    counts = shared_counts(sets, left.select("x", "n").distinct())
    rows = left.select("t", "x", "n").join(counts, "x").where(can_link(F.col("c"), F.col("n"), LEAST_PERCENT / 100 * F.col("n")))
    rows = cut(rows.withColumn("spread", 1 - F.col("c") / F.col("n")))
    least = rows.groupBy("t").agg(F.min("n").alias("least"))
    kept = rows.join(least, "t").where(can_link(F.col("c"), F.col("n"), F.col("least"))).drop("least")
    out = cut(enough_regions(kept))
    drop_cut(rows)
    return out


def enough_regions(rows: DataFrame) -> DataFrame:
    """Rows of the nodes whose open regions hold a quarter of their sketch, as those of linked nodes that have not met do."""
    per = rows.groupBy("x", "n").agg(F.count(F.lit(1)).alias("k"))
    # also for a set kept whole: its partner may be larger and keep only its smallest hashes
    enough = 4 * F.col("k") >= F.least(F.col("n"), F.lit(SKETCH))
    return rows.join(per.where(enough).select("x"), "x", "left_semi")


def members_of(rows: DataFrame) -> DataFrame:
    """Rows of hashes with two members or more, with the region's size k and its pivot p: of rows (t, x, n) the member with the
    smallest key, of rows (t, x, n, c, spread) the one with the smallest spread (then also its np and cp)."""
    size = F.count(F.lit(1)).alias("k")
    if "spread" not in rows.columns:
        regions = rows.groupBy("t").agg(F.min("x").alias("p"), size).where("k > 1")
    else:
        regions = rows.groupBy("t").agg(F.min(F.struct("spread", "x", "n", "c")).alias("first"), size).where("k > 1")
        regions = regions.select("t", "k", F.col("first.x").alias("p"), F.col("first.n").alias("np"), F.col("first.c").alias("cp"))
    return cut(rows.join(regions, "t"))


def candidates(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, p, nx, np): members and the pivots of their regions, not ruled out by what they can share, sizes or sketches."""
    pairs = members.where("x != p")
    if "c" in members.columns:
        pairs = pairs.where(can_link(F.least("c", "cp"), F.col("n"), F.col("np"))).select("x", "p", F.col("n").alias("nx"), "np").distinct()
    else:
        pairs = pairs.select("x", "p", F.col("n").alias("nx")).distinct().join(nodes.select(F.col("node").alias("p"), F.col("n").alias("np")), "p")
    pairs = pairs.where(100 * F.least("nx", "np") >= LEAST_PERCENT * F.greatest("nx", "np"))
    swap = F.col("x") < F.col("p")
    pairs = pairs.select(F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p"),
                         F.when(swap, F.col("np")).otherwise(F.col("nx")).alias("nx"), F.when(swap, F.col("nx")).otherwise(F.col("np")).alias("np")).distinct()
    pairs = pairs.join(nodes.select(F.col("node").alias("p"), F.col("sketch").alias("sp")), "p")
    pairs = pairs.join(nodes.select(F.col("node").alias("x"), F.col("sketch").alias("sx")), "x")
    union = F.slice(F.sort_array(F.array_union("sx", "sp")), 1, SKETCH)
    pairs = pairs.withColumn("u", union).withColumn("m", F.size(F.array_intersect(F.array_intersect("sx", "sp"), "u")))
    return pairs.where(4 * F.col("m") >= F.size("u")).select("x", "p", "nx", "np")


def linked():
    return 100 * F.col("common") >= LEAST_PERCENT * (F.col("nx") + F.col("np") - F.col("common"))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, node (key of the set), component_id for every document."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    every = cut(base.mapInArrow(_sketches, schema))
    nodes = cut(every.where("size(sketch) > 0").select("node", "n", "sketch").dropDuplicates(["node"]))
    rows = nodes.select(F.col("node").alias("x"), "n", F.explode("sketch").alias("t"))
    members = members_of(rows)
    # first round: a region's pivot is its smallest key; the sets are taken from the texts in the scan
    pairs = cut(candidates(members, nodes))
    sets = sets_of_nodes(base.select("text"), pairs.select(F.col("x").alias("node")).union(pairs.select("p")).distinct())
    known = measure(sets, pairs)
    comps = components(known.where("link").select("x", "p"))
    left = open_rows(members, comps, known)
    scratch = [every, nodes, pairs, known, members]
    if not left.isEmpty():
        # second round: the open nodes' sets are kept, nodes without a possible partner leave, the pivot is the member that shares most
        still = left.select(F.col("x").alias("node")).distinct()
        sets = cut(sets_of_nodes(base.select("text"), still).join(still, "node", "left_semi"))
        members = members_of(pruned(left, sets))
        pairs = cut(candidates(members, nodes).join(known.select("x", "p"), ["x", "p"], "left_anti"))
        more = measure(sets, pairs)
        scratch += [left, sets, members, pairs, more, comps]
        known = known.unionByName(more)
        comps = components(known.where("link").select("x", "p"))
        left = open_rows(members, comps, known)
        scratch.append(left)
        if not left.isEmpty():
            # what is still open is settled cell by cell
            members = members_of(pruned(left, sets))
            links = cut(cell_links(members, comps, sets))
            scratch += [members, links, comps]
            comps = components(known.where("link").select("x", "p").union(links))
    first = every.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = first.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(least, "comp").select("node", "component_id")
    out = every.select("id", "n", "node").join(named, "node", "left")
    out = cut(out.select("id", F.col("n").alias("n_shingles"), "node",
                         F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")))
    for table_ in [*scratch, comps]:
        drop_cut(table_)
    return out


def measure(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, p, d, link) of the pairs (x, p, nx, np), written."""
    measured = distances(sets, pairs.select("x", "p")).join(pairs, ["x", "p"])
    d = 1 - F.col("common") / (F.col("nx") + F.col("np") - F.col("common"))
    return cut(measured.withColumn("d", d).withColumn("link", linked()).select("x", "p", "d", "link"))


def open_rows(members: DataFrame, comps: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (t, x, n) that the next round joins: open regions without their pivots, inside the windows, of open nodes."""
    left = members.where("x != p and k > 2")
    left = left.join(comps.select(F.col("node").alias("x"), "comp"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    # distance to the region's pivot; one that was not computed is above r
    met = known.select(F.col("x").alias("hi"), F.col("p").alias("lo"), "d", "link")
    left = left.withColumn("hi", F.greatest("x", "p")).withColumn("lo", F.least("x", "p")).join(met, ["hi", "lo"], "left")
    left = cut(left.withColumn("ball", F.coalesce("link", F.lit(False))).select("t", "x", "n", "comp", "d", "ball"))
    families = left.groupBy("t", "comp").agg(F.min(F.when(~F.col("ball"), F.coalesce("d", F.lit(R)))).alias("nearest"))
    regions = families.groupBy("t").agg(F.count(F.lit(1)).alias("families"), F.min("nearest").alias("nearest"))
    kept = left.join(regions.where("families > 1").select("t", "nearest"), "t")
    # the ball is one component: its member is needed only if some member outside may be within its reach
    beyond = F.coalesce(F.col("ball") & (F.col("d") + R < F.col("nearest")), F.lit(False))
    out = cut(enough_regions(kept.where(~beyond).select("t", "x", "n")))
    drop_cut(left)
    return out


def pruned(left: DataFrame, sets: DataFrame) -> DataFrame:
    """`possible_rows`, more than once: a node that leaves makes shingles of others unshared."""
    rows = left
    for _ in range(PRUNES):
        rows, before = possible_rows(rows, sets), rows
        if before is not left:
            drop_cut(before)
    return rows


def cell_links(members: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (x, p) between members of different components of a cell: all regions with the same pivot are one cell, a node lies
    in the cells of all its regions, and every member outside a cell's largest component is compared with all others.

    Unmet linked nodes share a region, so a cell. The compared ones are dealt in blocks of about `BLOCK_TOKENS` shingles, the
    members in salts of `SALT_ROWS`; a task holds one block and streams members past it."""
    rows = members.select(F.col("p").alias("cell"), "x", "n").distinct()
    rows = rows.join(comps.select(F.col("node").alias("x"), "comp"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    rows = cut(rows)
    families = rows.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens"))
    cells = families.groupBy("cell").agg(F.max(F.struct("k", "comp", "tokens")).alias("main"), F.count(F.lit(1)).alias("families"),
                                         F.sum("k").alias("k"), F.sum("tokens").alias("tokens")).where("families > 1")
    cells = cells.select("cell", F.col("main.comp").alias("main"), F.ceil(F.col("k") / SALT_ROWS).cast("int").alias("salts"),
                         F.ceil((F.col("tokens") - F.col("main.tokens")) / BLOCK_TOKENS).cast("int").alias("blocks"))
    rows = rows.join(cells, "cell")
    block, salt = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("x", F.lit(1)), F.col("salts")).cast("int")
    compared = rows.where("comp != main").select("cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                                 F.lit(0).alias("member"), F.col("x").alias("node"), "comp")
    all_ = rows.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), salt.alias("salt"), F.lit(1).alias("member"),
                       F.col("x").alias("node"), "comp")
    shipped = sets.join(compared.union(all_), "node").select("cell", "block", "salt", "member", "node", "comp", "items")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shipped.repartition(n, "cell", "block", "salt").sortWithinPartitions("cell", "block", "salt", "member")
    return ordered.mapInArrow(_cell_links, "x long, p long").distinct()


class _Block:
    """The compared sets of a task's block as an index from shingle to their numbers."""

    def __init__(self):
        self.nodes, self.comps, self.sets, self.index = [], [], [], None

    def add(self, node: int, comp: int, items: np.ndarray) -> None:
        self.nodes.append(node)
        self.comps.append(comp)
        self.sets.append(items)

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Shared shingles, sets x compared ones."""
        if self.index is None:
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            tokens = np.concatenate(self.sets)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
            self.index = tokens[first], np.append(first, len(tokens)), owner
        known, first, owner = self.index
        out = np.zeros((len(sets), len(self.nodes)), np.int64)
        for i, own in enumerate(sets):
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            at = at[known[at] == own]
            size = first[at + 1] - first[at]
            ends = np.cumsum(size)
            if len(ends):
                out[i] = np.bincount(owner[np.arange(ends[-1]) - np.repeat(ends - size - first[at], size)], minlength=len(self.nodes))
        return out

    def links(self, nodes: np.ndarray, comps: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of different components, one a compared set and component."""
        common = self.common(sets)
        total = np.array([len(x) for x in sets])[:, None] + np.array([len(x) for x in self.sets])[None, :] - common
        i, j = np.nonzero((100 * common >= LEAST_PERCENT * total) & (comps[:, None] != np.array(self.comps)[None, :]))
        _, one = np.unique(np.stack([j, comps[i]]), axis=1, return_index=True)
        return nodes[i[one]], np.array(self.nodes, np.int64)[j[one]]


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, block, salt, member, node, comp, items) in order, a block's compared sets first -> links (x, p)."""
    current, block = None, _Block()
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
        member, node, comp, items = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6)
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            key = tuple(keys[:, a])
            if key != current:
                current, block = key, _Block()
            sets = [np.frombuffer(items[k].as_buffer(), U) for k in range(a, b)]
            n_compared = int((member[a:b] == 0).sum())
            for k in range(n_compared):
                block.add(int(node[a + k]), int(comp[a + k]), sets[k].copy())
            if a + n_compared < b and block.nodes:
                x, p = block.links(node[a + n_compared:b], comp[a + n_compared:b], sets[n_compared:])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(p)], names=["x", "p"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of `docs`, with all columns: the smallest id (of equal ids the smallest text hash, of
    equal rows one); documents without a word stay."""
    found = join_documents(docs, id_col, text_col)
    names = docs.columns
    # the component's row: its smallest id; rows with a null id stay only if the whole component has none
    chosen = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("m"))
    chosen = chosen.select("m.id", "m.node").distinct()
    empty = found.where("n_shingles = 0").select("id", "node").distinct()
    def as_text(c):
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    keys = chosen.unionByName(empty).select(as_text(F.col("id")).alias("__id"), F.col("node").alias("__key"))
    rows = node_of(docs, text_col).withColumn("__id", as_text(F.col(f"`{id_col}`")))
    rows = rows.join(keys, ["__id", "__key"], "left_semi")
    # equal rows of the chosen id meet in the same partition; empty documents keep their repeats
    copy = F.when(F.col("__key") == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return rows.withColumn("__copy", copy).dropDuplicates(["__id", "__key", "__copy"]).select(*names)


def node_of(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with `__key`, the key of the row's shingle set (0: empty)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(at))
            keys = [sets_of(part, o)[2] for _, _, part, o in chunks(data, offs)]
            key = pa.array(signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=[*batch.schema.names, "__key"])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__key", T.LongType())]))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = join_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
