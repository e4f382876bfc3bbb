"""Order statistics of a hash within every group, for any number of groups, without a list on the driver or in the plan.

The hash is a uniform whole number of `BITS` bits. A bracket is a prefix of it. One aggregation counts each group's rows by the
first `STEP` bits (combined map-side); running sums over a group's at most 2^STEP counts give the bracket that holds each wanted
rank. The bracket table, one row a group and rank, is joined back to the rows by (group, prefix), which spreads a large group
over its prefixes, and refined until a bracket holds few rows; those are numbered. Only the largest bracket's count reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskflow.session import cut_lineage

BITS, STEP = 52, 12
NUMBERED = 4096                       # rows of a bracket that are numbered instead of refined


def _brackets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums of the counts `m` over the prefixes `b` of each key: rows below each prefix."""
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.coalesce(F.sum("m").over(before), F.lit(0)))


def cuts_by_group(rows: DataFrame, ranks: Callable[[Column], list[Column]], bits: int = BITS, step: int = STEP,
                  numbered: int = NUMBERED) -> DataFrame:
    """(g, cuts): for each value of `g` the hashes `h` at the 0-based ranks `ranks(n)` among its n rows, -1 where a rank is
    negative. `rows` has columns g and h; a NULL group is a group."""
    left = max(bits - step, 0)
    hist = rows.groupBy("g", F.shiftright("h", left).alias("b")).agg(F.count("*").alias("m"))
    hist = _brackets(hist, ["g"]).withColumn("n", F.sum("m").over(Window.partitionBy("g")))
    wanted = F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("t", "k")
    open_ = hist.select("*", wanted).where((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("m")))
    open_ = cut_lineage(open_.select("g", "t", "k", "b", "below", "m"))
    while left and (open_.agg(F.max("m")).first()[0] or 0) > numbered:
        narrower = max(left - step, 0)
        inside = _inside(rows, open_, left).groupBy("g", "t", "k", "start", F.shiftright("h", narrower).alias("b")).agg(F.count("*").alias("m"))
        inside = _brackets(inside, ["g", "t"]).withColumn("below", F.col("below") + F.col("start"))
        inside = inside.where((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("m")))
        open_, left = cut_lineage(inside.select("g", "t", "k", "b", "below", "m")), narrower
    if left:
        order = Window.partitionBy("g", "t").orderBy("h")
        found = _inside(rows, open_, left).withColumn("at", F.col("start") + F.row_number().over(order) - 1).where("at = k")
    else:
        found = open_.withColumn("h", F.col("b"))
    found = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("t", "h"))).alias("at"))   # one entry a rank
    n_ranks = len(ranks(F.lit(0)))
    return found.select("g", F.array(*[F.coalesce(F.try_element_at("at", F.lit(t)), F.lit(-1).cast("long")) for t in range(n_ranks)]).alias("cuts"))


def _inside(rows: DataFrame, open_: DataFrame, left: int) -> DataFrame:
    """The rows inside each open bracket, with the bracket's group, rank and number of rows below it."""
    brackets = open_.select(F.col("g").alias("bg"), F.col("b").alias("bb"), "t", "k", F.col("below").alias("start"))
    same = F.col("g").eqNullSafe(F.col("bg")) & (F.shiftright("h", left) == F.col("bb"))
    return rows.join(brackets, same).select("g", "h", "t", "k", "start")


def with_cuts(df: DataFrame, group: Column, h: Column, ranks: Callable[[Column], list[Column]], h_out: str, cuts_out: str) -> DataFrame:
    """`df` with its hash and its group's cuts (an array); rows of a group without any rank get NULL cuts."""
    rows = df.withColumn(h_out, h)
    cuts = cut_lineage(cuts_by_group(rows.select(group.alias("g"), F.col(h_out).alias("h")), ranks))
    cuts = cuts.select(F.col("g").alias("__cut_g"), F.col("cuts").alias(cuts_out))
    return rows.join(cuts, group.eqNullSafe(F.col("__cut_g")), "left").drop("__cut_g")
