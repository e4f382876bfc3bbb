"""Mixing sources to target weights by hash-threshold histograms.

Every document has a stable 60-bit hash. A source with size S and target T takes each of its documents floor(T / S)
times, and once more those whose hash lies below a threshold that makes the rest of the budget. Because a smaller
budget has a smaller threshold, budgets are nested: what a small mix takes, a larger one takes too.

The threshold is found without sorting: sizes are summed by (source, top 12 hash bits), a running sum over the 4096
cells of a source finds the cell in which the budget ends, and only the documents of that cell are summed again by the
next 12 bits, until the cell holds one hash value. That last value is taken if this brings the source nearer to its
target. Each pass is one aggregation with map-side combine, so a source with a third of all rows is no hot task.

Defined results: null text counts 0 words; a null source is a source of its own, last in order; equal rows (same id and
text) have the same hash and are decided together; an empty table gives no rows. Only the three named columns are read,
so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from riskflow.llm.common import SPACE_CLASS, WORD_CLASS, cut, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
CELL_BITS, HASH_BITS = 12, 60


def word_count(text):
    """Number of words; null counts 0. Squeezing every word to one letter keeps this on the JVM in one regex pass."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_CLASS + "+", "w")
    return F.char_length(F.regexp_replace(one, SPACE_CLASS + "+", "")).cast("long")


def source_key(source):
    """Sorts like the source by code point (UTF-8 bytes), null last; never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def document_hash(*cols):
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - HASH_BITS)


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """0-based rank by `key`, without a one-task sort: ranges are numbered apart, the counts of earlier ranges added."""
    parts = cut(sources.repartitionByRange(F.col(key)).withColumn("range_id", F.spark_partition_id()))
    counts = parts.groupBy("range_id").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    before, seen = {}, 0
    for r in sorted(counts, key=lambda r: r["range_id"]):
        before[r["range_id"]] = seen
        seen += r["n"]
    if not before:
        return parts.withColumn("rank", F.lit(0).cast("long")).drop("range_id")
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    inside = F.row_number().over(Window.partitionBy("range_id").orderBy(key)) - 1
    return parts.withColumn("rank", (offsets[F.col("range_id")] + inside).cast("long")).drop("range_id")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """`target` for each row of (source_key, source_size, weight): shares by weight of the whole size, held at `most`
    times the source's size, the excess reshared by weight until none is above. Only two sums reach the driver a pass."""
    cap = F.col("source_size") * F.lit(most)
    total, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = (float(total or 0) / all_weights if all_weights else 0.0), -1
    while total:
        over = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if row[2] == held or not row[1]:
            break
        held, level = row[2], (float(total) - float(row[0] or 0)) / row[1]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with `threshold`: documents with hash below it are taken once more."""
    done = []
    state = plan.select("source_key", "rest", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before")).where("rest > 0")
    for level in range(1, HASH_BITS // CELL_BITS + 1):
        low = HASH_BITS - level * CELL_BITS
        docs = sized.where("size > 0").join(state, "source_key")
        if level > 1:
            docs = docs.where(F.shiftright("hash", low + CELL_BITS) == F.col("cell"))
        cells = docs.groupBy("source_key", F.shiftright("hash", low).alias("next")).agg(
            F.sum("size").alias("in_cell"), F.min("hash").alias("least"), F.max("hash").alias("most"),
            F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = Window.partitionBy("source_key").orderBy("next")
        ends = F.col("before") + F.sum("in_cell").over(run)
        bound = (cells.withColumn("ends", ends).withColumn("starts", F.col("ends") - F.col("in_cell"))
                 .where("starts <= rest and ends > rest")
                 .select("source_key", "rest", F.col("next").alias("cell"), F.col("starts").alias("before"), "in_cell", "least", "most"))
        bound = cut(bound)
        done.append(bound.where("least = most"))
        state = bound.where("least < most").select("source_key", "rest", "cell", "before")
        if state.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    nearer = F.col("rest") - F.col("before") >= F.col("in_cell") / 2
    found = found.select("source_key", F.when(nearer, F.col("least") + 1).otherwise(F.col("least")).alias("threshold"))
    # a rest that rounding put above the last cell takes every document
    full = F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0)).cast("long")
    return plan.join(found, "source_key", "left").withColumn("threshold", F.coalesce("threshold", full))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): each document's size and hash; each source's size, target, whole passes and hash threshold."""
    sized = cut(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source_key"),
                            word_count(F.col(text_col)).alias("size"),
                            document_hash(F.col(id_col), F.col(text_col)).alias("hash")))
    sources = ranked(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), "source_key")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut(sources.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))))
    plan = targets(sources, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = cut(plan.withColumn("passes", F.least(passes, F.lit(int(most))).cast("long"))
               .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    return sized, cut(thresholds(sized, plan))


def copies():
    """How often a document joined with its source's plan is taken."""
    return F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, **kw) -> DataFrame:
    """One row a document: id, size, source_key, source_size, target, copies."""
    sized, plan = mix_plan(docs, **kw)
    return (sized.join(plan, "source_key")
            .select("id", "source_key", "size", "source_size", "target", copies().alias("copies")))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mixed table itself: every document as often as the mix takes it, with the columns it had."""
    _, plan = mix_plan(docs, id_col, text_col, source_col, **kw)
    names = docs.columns
    plan = plan.select(F.col("source_key").alias("__mix_key"), "passes", "threshold")
    plan = plan.withColumnsRenamed({"passes": "__mix_passes", "threshold": "__mix_threshold"})
    rows = docs.withColumn("__mix_key", source_key(F.col(source_col))).join(plan, "__mix_key")
    extra = F.when(document_hash(F.col(id_col), F.col(text_col)) < F.col("__mix_threshold"), 1).otherwise(0)
    n = (F.col("__mix_passes") + extra).cast("int")
    return rows.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), n))).select(*names)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"))
