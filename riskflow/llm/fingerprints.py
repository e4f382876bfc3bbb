"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted between versions and peeled.

Native: DataFrame functions only. A paragraph is a line or, in it, a sentence (`.!?;|` before a space). Its digest is 46
hash bits and 16 check bits of these, a positive long. The digests of a text's distinct paragraphs are put into cells:
three sub-tables, in each of which a digest has one cell; a cell holds the xor of its digests, for which subtracting is
xor too. Subtracting the cells of two versions cancels what they share; a cell that holds a single digest shows it by the
check bits. Removing that digest from its three cells uncovers others (peeling). If cells stay, also because an xor of
several passed for a digest by chance, the sketches are built again larger, with other hashes.

A text's published fingerprint is its number of paragraphs and its own small sketch (`SMALL` cells a sub-table), the same
for equal texts. Two versions are compared by subtracting their fingerprints; what peels recovers the digests in which
they differ, and the likeness is the Jaccard similarity that follows from those and the two numbers of paragraphs.
Fingerprints that differ in more digests than a small sketch holds are retried larger: a sketch of each version in blocks,
the leading digest bits choosing the block, about `LOAD` digests of both versions each. Every block is subtracted, peeled
and, if needed, retried larger (`SIZES` cells a sub-table) apart, as peeling one large sketch costs (cells x digests); so
the work is linear in the text, and no row needs another row. What the largest size leaves is compared digest by digest.

The next document in descending id order comes from a window over ranges of ids (`with_next`): texts are shuffled once;
the first row of a range finds its neighbour in a copy of the last row of the range before, put into the same range.

Defined results: null text is empty; two empty texts are alike (1.0); a null id stands last in the order, equal ids are
ordered by a hash of the text, equal rows follow each other; a single document is its own next; ids may be text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from riskflow.llm.common import cut, table
from riskflow.llm.quality import let

LOAD = 4
SIZES = (4, 16, 256, 2048)
SMALL = 4
ROUNDS = 9                           # peeling rounds, three a sub-table; what then stays is built larger
MASK_BITS = 62                       # sketches of at most so many cells note a digest's three cells as bits
QUANTILES, MOST_RANGES, RANGE_ROWS = 64, 1 << 14, 512
NULL_RANGES = 64


# ---------------------------------------------------------------- neighbours

def _step(value: Column, bounds: list, lo: int = 0) -> Column:
    """Number of `bounds` that are <= value, as a balanced tree of conditions."""
    if not bounds:
        return F.lit(lo)
    m = len(bounds) // 2
    return F.when(value < F.lit(bounds[m]), _step(value, bounds[:m], lo)).otherwise(_step(value, bounds[m + 1:], lo + m + 1))


def range_of(docs: DataFrame, id_col: str) -> Column:
    """Range number that grows with the id: quantile bounds, and equal widths between two of them; nulls lowest."""
    probs = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = docs.agg(F.count(id_col), F.percentile_approx(id_col, probs, 10_000), F.min(id_col), F.max(id_col)).first()
    spread = F.shiftrightunsigned("hh", 57).cast("long") - NULL_RANGES
    if not row[0]:
        return spread
    inner = sorted(set(row[1]) - {row[2]})
    lows = [row[2], *inner]
    tops = [*inner, row[3] + 1]
    per = max(1, min(MOST_RANGES // len(lows), math.ceil(row[0] / RANGE_ROWS / len(lows))))
    value = F.col(id_col)
    q = _step(value, inner)
    def pick(xs):
        return F.get(F.array(*[F.lit(int(x)).cast("long") for x in xs]), q)
    inside = F.floor((value - pick(lows)).cast("double") * per / (pick(tops) - pick(lows)).cast("double"))
    return F.when(value.isNull(), spread).otherwise(q.cast("long") * per + F.least(F.greatest(inside, F.lit(0)), F.lit(per - 1)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty), next_text: the text of the next document by descending id, after the last the first."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("hh", F.shiftrightunsigned(F.xxhash64("text"), 1))
    if isinstance(base.schema["id"].dataType, T.IntegralType):
        base = base.withColumn("bucket", range_of(base, "id"))
    else:  # no arithmetic on the ids: ranges of a range partitioning, kept as written
        base = cut(base.repartitionByRange("id", "hh").withColumn("bucket", F.spark_partition_id().cast("long")))
    # last row (ascending) of every range; at most MOST_RANGES + NULL_RANGES numbers reach the driver
    last = base.groupBy("bucket").agg(F.max(F.struct("id", "hh")).alias("m")).select("bucket", "m.*").collect()
    last.sort(key=lambda r: r["bucket"])
    edges = [(last[(i + 1) % len(last)]["bucket"], r["bucket"], r["id"], r["hh"]) for i, r in enumerate(last)]
    id_type = base.schema["id"].dataType.simpleString()
    edges = spark.createDataFrame(edges, f"to_bucket long, e_bucket long, e_id {id_type}, e_hh long")
    ghosts = base.join(F.broadcast(edges), (F.col("bucket") == F.col("e_bucket")) & F.col("id").eqNullSafe(F.col("e_id")) & (F.col("hh") == F.col("e_hh")))
    ghosts = ghosts.select("id", "text", "hh", F.col("to_bucket").alias("bucket"), F.lit(0).alias("real"))
    rows = base.withColumn("real", F.lit(1)).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy("real", F.col("id").asc_nulls_first(), "hh")
    return rows.withColumn("next_text", F.lag("text").over(order)).where("real = 1").select("id", "text", "next_text", "bucket")


# ---------------------------------------------------------------- sketches

def _check(head: Column) -> Column:
    return F.xxhash64(head, F.lit(11)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def checked(h: Column) -> Column:
    """A digest: 46 bits of a hash, then 16 check bits of these."""
    head = F.shiftrightunsigned(h, 18)
    return F.shiftleft(head, 16).bitwiseOR(_check(head))


def is_digest(v: Column) -> Column:
    return (v > 0) & (_check(F.shiftrightunsigned(v, 16)) == v.bitwiseAND(F.lit(0xFFFF).cast("long")))


def digests(text: Column) -> Column:
    """Digests of the distinct paragraphs of a text that is not null."""
    parts = F.split(text, r"[.!?;|]+[ \t]+|[\n\r]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: checked(F.xxhash64(p))))


def _source(d: Column, salt: int) -> Column:
    return F.shiftrightunsigned(d, 16) if salt == 0 else F.xxhash64(d, F.lit(salt))


def mask_of(d: Column, size: int, salt: int) -> Column:
    """The digest's three cells, one in each sub-table of `size` (a power of two), as bits of a long."""
    def bit(table: int) -> Column:
        at = F.shiftrightunsigned(_source(d, salt), 12 * table).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at + F.lit(table * size))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def entry(d: Column, size: int, salt: int) -> Column:
    """A digest v with `b`: the mask of its cells, or for large sketches the hash that places it."""
    b = mask_of(d, size, salt) if 3 * size <= MASK_BITS else _source(d, salt)
    return F.struct(d.alias("v"), b.alias("b"))


def in_cell(b: Column, cell: Column, size: int) -> Column:
    """Whether an entry placed by `b` belongs to `cell` (numbered over the three sub-tables)."""
    if 3 * size <= MASK_BITS:
        return F.getbit(b, cell) == 1
    bits = size.bit_length() - 1
    shift = F.call_function("shiftright", cell, F.lit(bits)) * F.lit(12)
    at = F.call_function("shiftrightunsigned", b, shift).bitwiseAND(F.lit(size - 1).cast("long"))
    return at == cell.bitwiseAND(F.lit(size - 1))


def _xor_in(entries: Column, cell: Column, size: int, start: Column) -> Column:
    return F.aggregate(entries, start, lambda a, e: F.when(in_cell(e["b"], cell, size), a.bitwiseXOR(e["v"])).otherwise(a))


def sketch(ds: Column, size: int, salt: int = 0) -> Column:
    """3 * size cells of one version's digests."""
    entries = F.transform(ds, lambda d: entry(d, size, salt))
    return let(entries, lambda es: F.transform(F.sequence(F.lit(0), F.lit(3 * size - 1)),
                                               lambda x: _xor_in(es, x, size, F.lit(0).cast("long"))))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of the digests that only one of two versions has, from the sketches of the versions."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def is_empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: c == 0)


def no_digests() -> Column:
    return F.array().cast("array<bigint>")


def peel(cells: Column, size: int, salt: int) -> Column:
    """The digests recovered from a subtracted sketch, null if cells stay. A round takes the single digests of one
    sub-table, which differ, and removes them from all three."""
    def round_(state: Column, r: Column) -> Column:
        single = F.filter(F.slice(state["cells"], (r % 3) * size + 1, F.lit(size)), is_digest)
        def remove(p: Column) -> Column:
            left = F.transform(state["cells"], lambda c, x: _xor_in(p, x, size, c))
            return F.struct(left.alias("cells"), F.concat(state["found"], F.transform(p, lambda e: e["v"])).alias("found"))
        return let(F.transform(single, lambda v: entry(v, size, salt)), lambda p: F.when(F.size(p) == 0, state).otherwise(remove(p)))
    start = F.struct(cells.alias("cells"), no_digests().alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_,
                       lambda s: F.when(is_empty(s["cells"]), s["found"]))


def recovered(a: Column, b: Column, size: int, salt: int) -> Column:
    """Digests that peeling recovers from the difference of two sketches; null if cells stay."""
    return let(subtract(a, b), lambda cells: F.when(is_empty(cells), no_digests()).otherwise(peel(cells, size, salt)))


def side(block: Column, version: int) -> Column:
    """The digests of one version (0 or 1) in a block of `blocks_of`."""
    own = F.filter(block, lambda t: t.bitwiseAND(F.lit(1).cast("long")) == version)
    return F.transform(own, lambda t: F.shiftrightunsigned(t, 1))


def block_difference(block: Column, attempt: int) -> Column:
    """Digests recovered from a block: a sketch of each version, subtracted and peeled; null if cells stay. Behind the last
    size, the digests are compared one by one."""
    if attempt == len(SIZES):
        return let(side(block, 0), lambda a: let(side(block, 1), lambda b: F.concat(F.array_except(a, b), F.array_except(b, a))))
    size = SIZES[attempt]
    return recovered(sketch(side(block, 0), size, attempt), sketch(side(block, 1), size, attempt), size, attempt)


def blocks_of(a: Column, b: Column) -> Column:
    """Blocks of the digests of two arrays, a digest's lowest bit telling its array; the leading digest bits choose the block."""
    def tagged(ds: Column, version: int) -> Column:
        return F.transform(ds, lambda d: F.shiftleft(d, 1).bitwiseOR(F.lit(version).cast("long")))

    def cut_up(z: Column) -> Column:
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.size(z) / F.lit(float(LOAD)))).cast("int"))
        def starts(shift: Column) -> Column:
            def block(i: Column) -> Column:
                return F.call_function("shiftrightunsigned", F.get(z, i), shift)
            return F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: (i == 0) | (block(i) != block(i - 1)))
        return let(let(F.lit(63) - bits, starts),
                   lambda s: F.transform(s, lambda at, j: F.slice(z, at + 1, F.coalesce(F.get(s, j + 1), F.size(z)) - at)))

    whole = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    return let(whole, lambda z: F.when(F.size(z) == 0, F.array().cast("array<array<bigint>>")).otherwise(cut_up(z)))


def with_sketch(rows: DataFrame, *names: str) -> DataFrame:
    """`rows` plus `<name>_cells`, the small sketch of each array of digests."""
    return rows.withColumns({f"{n}_cells": sketch(F.col(n), SMALL) for n in names})


def with_difference(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """`rows` (with the small sketches of `with_sketch`) plus `out`, the digests in only one of the arrays `a` and `b`, in no
    order: peeled from the difference of the two small sketches, or of larger ones in blocks."""
    rest, tried = f"{out}_rest", f"{out}_tried"
    rows = rows.withColumn(tried, recovered(F.col(f"{a}_cells"), F.col(f"{b}_cells"), SMALL, 0))
    rows = rows.withColumns({out: F.coalesce(F.col(tried), no_digests()),
                             rest: F.when(F.col(tried).isNull(), blocks_of(F.col(a), F.col(b))).otherwise(F.array().cast("array<array<bigint>>"))})
    for attempt in range(len(SIZES) + 1):
        rows = rows.withColumn(tried, F.transform(rest, lambda e: F.struct(block_difference(e, attempt).alias("d"), e.alias("e"))))
        done = F.flatten(F.transform(F.filter(tried, lambda x: x["d"].isNotNull()), lambda x: x["d"]))
        rows = rows.withColumns({
            out: F.concat(F.col(out), done),
            rest: F.transform(F.filter(tried, lambda x: x["d"].isNull()), lambda x: x["e"])})
    return rows.drop(rest, tried)


def only_in(difference: Column, own: Column) -> Column:
    """Which of the recovered digests are those of the version with digests `own`."""
    return F.array_intersect(difference, own)


def likeness(a: str, b: str, difference: str) -> Column:
    """Jaccard similarity of two paragraph sets from their sizes and the recovered difference."""
    both, d = F.size(a) + F.size(b), F.size(difference)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def fingerprint(name: str) -> Column:
    """Number of paragraphs and the cells of the small sketch, as text."""
    shown = F.transform(f"{name}_cells", lambda c: F.lower(F.hex(c)))
    return F.concat(F.size(name).cast("string"), F.lit(":"), F.array_join(shown, "-"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_chars, edited_sha256, both fingerprints, near_edited, near_next, and the digests of the paragraphs
    in which the text differs from the edited one: `removed` (only in the text) and `added` (only in the edited text)."""
    rows = with_next(docs, id_col, text_col)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next_text")).alias("c"))
    rows = with_sketch(rows, "a", "b", "c")
    rows = with_difference(with_difference(rows, "a", "b", "d_edited"), "a", "c", "d_next")
    return rows.select("id", "n_chars", "edited_sha256", fingerprint("a").alias("fingerprint"), fingerprint("b").alias("edited_fingerprint"),
                       likeness("a", "b", "d_edited").alias("near_edited"), likeness("a", "c", "d_next").alias("near_next"),
                       only_in(F.col("d_edited"), F.col("a")).alias("removed"), only_in(F.col("d_edited"), F.col("b")).alias("added"))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return out.withColumns({"n_removed": F.size("removed").cast("long"), "n_added": F.size("added").cast("long")}).drop("removed", "added")
