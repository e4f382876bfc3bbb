"""Filter interaction audit: what every order of a set of row filters keeps, removes and loses.

Four failures are row conditions; the fifth, identical to a smaller id's text, is an existential self-join: hashes that occur
more than once are counted, and a left-semi join on hash, exact text and smaller doc_id marks the rows that fail. The other
side of that join has one row a distinct repeated text, its smallest id, so a group of copies never meets itself; a large group
is spread over salts on both sides. The marked ids are united with the other failure ids and one aggregation forms each row's
combination of failures. From there on only counts a part and combination are left (at most 32 rows a part), and every order
and step is a sum over them: a row goes at the first of its failures.

Defined results: null text is empty; null lang is the part ''; null doc_id is smaller than nothing and has no label; a repeated
doc_id is a row of its own (the same text under the same id is not a smaller id's); a document is good or toxic if any of its
label rows says 1; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from riskflow.llm.common import cut, table

FILTERS = "ABCDE"
COPY_BIT = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10    # words, and percent of words and code points
SALT_ROWS = 2048                     # copies of one text for each salt of the self-join
SMALL_ROWS = 500_000                 # repeated hashes (about 100 bytes each) that are broadcast
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_failures(text: Column) -> Column:
    """Bits of the row conditions A to D of a text without null."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    marks = F.length(text) != F.length(F.translate(text, "#$%&*|", ""))
    conditions = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), marks]
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def copies(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, part, h) of the rows whose text is that of a smaller doc_id: the existential self-join.

    `docs` has doc_id, part, h, text; `marked` the same rows without the text, already written.
    """
    repeated = marked.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = cut(repeated.where("least < most").select("h", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")))
    side = F.broadcast(repeated) if repeated.count() <= SMALL_ROWS else repeated
    rows = docs.join(side, "h").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    first = rows.groupBy("h", "text").agg(F.min("doc_id").alias("first_id"), F.max("salts").alias("salts"))
    first = first.select("h", "text", "first_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    a, b = rows.alias("a"), first.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("h", "salt", "text")]
    return a.join(b, [*same, F.col("b.first_id") < F.col("a.doc_id")], "left_semi").select("doc_id", "part", "h")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                   label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each combination of failures."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.withColumn("h", F.unhex(F.sha2("text", 256)))
    marked = cut(docs.select("doc_id", "part", "h", row_failures(F.col("text")).alias("mask")))
    again = copies(docs, marked).distinct()
    # rows of the same id, part and text share their failures, so they are one line of the union with a count
    failed = marked.select("doc_id", "part", "h", "mask", F.lit(1).alias("n")).union(
        again.select("doc_id", "part", "h", F.lit(COPY_BIT).alias("mask"), F.lit(0).alias("n")))
    failed = failed.groupBy("doc_id", "part", "h").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = F.col("n")
    return failed.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def order_steps(filters: str = FILTERS) -> list[dict]:
    """Every order and step: the step's own bit and the bits of the filters before it."""
    return [{"filter_order": "".join(order), "step": i + 1, "own": 1 << filters.index(f),
             "before": sum(1 << filters.index(x) for x in order[:i])}
            for order in itertools.permutations(filters) for i, f in enumerate(order)]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row a part, order and step from `failure_counts`; all that is joined here is counts."""
    steps = F.from_json(F.lit(json.dumps(order_steps(filters))), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    # over all orders each of a row's failures comes first among them equally often (with up to five filters a whole number)
    share = F.col("n") * F.floor(F.lit(math.factorial(len(filters))) / F.greatest(F.bit_count("mask"), F.lit(1)))
    rows = counts.withColumn("s", F.explode(steps)).select("part", "mask", "n", "good", "toxic", "s.*", share.alias("share"))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    there = F.col("mask").bitwiseAND(F.col("before")) == 0
    last = F.col("mask").bitwiseAND(F.col("before").bitwiseOR(F.col("own"))) == 0

    def total(value: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total("n", last).alias("kept"), total("n", fails & there).alias("removed"), total("n", fails & ~there).alias("redundant"),
        total("n", F.col("mask") == F.col("own")).alias("unique_fails"), total("good", fails & there).alias("good_lost"),
        total("toxic", fails & there).alias("toxic_lost"), total("share", fails).alias("shapley"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = """
with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs),
firsts as (select text, min(doc_id) as first_id from docs group by text),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
          from labels where doc_id is not null group by doc_id),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] as fails
  from words left join firsts using (text) left join known using (doc_id)),
masks as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 3, 4, 5]) as k),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.k, b.k, c.k, d.k, e.k] as ks
           from letters a, letters b, letters c, letters d, letters e
           where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps as (select filter_order, step::int as step, ks[step] as own, ks[1:step - 1] as before from orders, range(1, 6) r(step)),
judged as (
  select part, filter_order, step, own, n, good, toxic, fails[own] as fails,
         len(list_filter(before, lambda k: fails[k])) = 0 as there, len(list_filter(fails, lambda x: x)) = 1 as alone
  from masks, steps),
sums as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (where there and not fails), 0)::bigint as kept,
         coalesce(sum(n) filter (where there and fails), 0)::bigint as removed,
         coalesce(sum(n) filter (where fails and not there), 0)::bigint as redundant,
         coalesce(sum(n) filter (where fails and alone), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (where there and fails), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (where there and fails), 0)::bigint as toxic_lost
  from judged group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, own)::bigint as shapley
from sums"""
