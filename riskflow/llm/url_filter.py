"""URL filter: host / path rules, then a blocked Bloom filter in front of an exact hash join.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest fitting rule wins.
Urls without a rule are looked up in a list of canonical urls. The list's 64-bit url hashes make a blocked Bloom filter:
a hash picks one 64-bit block and sets 5 bits in it, and a block is one row (block, mask), built with `bit_or` by a
distributed aggregation. A page first probes its one block; only possible hits go to the exact join on the canonical url,
which removes the false positives. The filter is broadcast while its number of blocks, hence its bytes, is below
`BROADCAST_BLOCKS`; a larger one is joined by block.

The query's list comes from what pages hold, not from their urls alone (`content_list`): a passage (a line of at least
`LEAST_PASSAGE` characters) that documents labelled toxic have and documents labelled clean have not is evidence; the
canonical urls of pages that republish such a passage are listed, so that every page on one of them is blocked, under
whatever host name. Page passages meet the evidence the same way as urls meet the list: Bloom filter, then exact join (of
md5 digests), so a passage of very many pages that is no evidence is not shuffled. Urls on hosts with a label of
`SPAM_LABELS` (`spam_list`, a parameter) are listed as well.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is allowed; repeated pages get
a row each; null pages, texts, labels and ids give no evidence; a document labelled both ways counts as clean; only the
named columns are read; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskflow.llm.common import cut, table

# Fixed rules of the query (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Host labels that mark spam hosts: their canonical urls make the list.
SPAM_LABELS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
LEAST_PASSAGE = 40
BITS_IN_BLOCK, PROBES = 64, 5
KEYS_A_BLOCK = 4                     # 16 bits a key
BROADCAST_BLOCKS = 1 << 20           # 16 bytes each


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"(?s)^[^?#]*", 0)
    return host, path


def with_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    return base.withColumns({"host": host, "path": path})


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (host first, then path length), else nulls."""
    def dotted(h: Column) -> Column:
        return F.concat(F.lit("."), h)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = dotted(host).endswith("." + h) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def canonical(host: Column, path: Column) -> Column:
    """Host without www./m./blog., path without index pages, suffix and final slash; query and fragment do not count."""
    bare = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    plain = F.regexp_replace(path, r"(?s)(/|/index\.html?|\.html?)$", "")
    return F.concat(bare, F.when(plain == "", F.lit("/")).otherwise(plain))


def url_hash(url: Column) -> Column:
    return F.xxhash64(url)


def block_mask(h: Column) -> Column:
    """PROBES bits of one 64-bit block, each chosen by six other bits of the hash."""
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def block_of(h: Column, blocks: int) -> Column:
    """Block number from the hash's upper bits (the probes use the lower ones)."""
    return F.shiftrightunsigned(h, 6 * PROBES).bitwiseAND(F.lit(blocks - 1))


def bloom(listed: DataFrame, url_col: str = "canonical") -> tuple[DataFrame, int]:
    """(block, mask) rows and the number of blocks, a power of two from the counted list."""
    n = listed.count()
    blocks = 1 << max(4, math.ceil(math.log2(max(1, n / KEYS_A_BLOCK))))
    h = url_hash(F.col(url_col))
    rows = listed.select(block_of(h, blocks).alias("block"), block_mask(h).alias("mask"))
    return rows.groupBy("block").agg(F.bit_or("mask").alias("mask")), blocks


def possible_hits(rows: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """`rows` whose `key` passes the Bloom filter of the `key` column of `listed`."""
    table_, blocks = bloom(listed, key)
    filter_ = F.broadcast(table_) if blocks <= BROADCAST_BLOCKS else table_
    h = url_hash(F.col(key))
    probe = rows.withColumns({"block": block_of(h, blocks), "probe": block_mask(h)})
    passed = probe.join(filter_, "block").where(F.col("mask").bitwiseAND(F.col("probe")) == F.col("probe"))
    return passed.select(*rows.columns)


def listed_of(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct `canonical` values of `urls` that are on the list: Bloom filter, then an exact hash join."""
    possible = possible_hits(urls.select("canonical"), listed)
    return possible.distinct().join(listed.select("canonical"), "canonical", "left_semi")


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, canonical, rule, verdict for every page; `listed` has a column `canonical`.

    `verdict` is the rule's, else block for a listed canonical url, else allow."""
    parts = with_parts(pages, id_col, url_col)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = F.col("host") != ""
    parts = parts.withColumns({"rule": rule, "rule_verdict": verdict,
                               "canonical": F.when(known, canonical(F.col("host"), F.col("path")))})
    parts = cut(parts.drop("__url"))
    open_urls = parts.where(F.col("rule").isNull() & F.col("canonical").isNotNull())
    hits = listed_of(open_urls, listed).withColumn("on_list", F.lit(True))
    # only the few distinct listed urls come back; the pages keep their place when that side is small
    out = parts.join(hits, "canonical", "left")
    method = F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "canonical", "rule", F.coalesce("rule_verdict", method).alias("verdict"))


def spam_list(pages: DataFrame, url_col: str = "url", labels=SPAM_LABELS) -> DataFrame:
    """The list of the query: distinct canonical urls of all pages on hosts with a spam label."""
    parts = with_parts(pages, url_col, url_col)
    marked = F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in labels]))
    return parts.where(marked).select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()


def passages(text: Column) -> Column:
    """md5 digests of the distinct passages of a text; null for a null text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.array_distinct(F.filter(lines, lambda x: F.char_length(x) >= LEAST_PASSAGE)), lambda x: F.md5(x))


def page_text(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "\n")


def evidence(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`passage` digests that documents labelled toxic have and documents labelled clean have not."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min(F.col("toxic").cast("int")).alias("toxic"))
    found = documents.select("doc_id", passages(F.col("text")).alias("p")).where(F.size("p") > 0).join(known, "doc_id")
    each = found.select("toxic", F.explode("p").alias("passage")).groupBy("passage").agg(F.min("toxic").alias("toxic"))
    return each.where("toxic = 1").select("passage")


def content_list(pages: DataFrame, evidence: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct canonical urls of the pages that hold a passage of `evidence`: Bloom filter, then an exact join."""
    held = pages.select(F.col(url_col).alias("__url"), passages(page_text(F.col(html_col))).alias("p"))
    host, path = host_and_path(F.col("__url"))
    held = held.withColumns({"host": host, "path": path}).where("host <> ''")
    held = held.select(canonical(F.col("host"), F.col("path")).alias("canonical"), F.explode("p").alias("passage"))
    return possible_hits(held, evidence, "passage").join(evidence, "passage", "left_semi").select("canonical").distinct()


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages, documents, labels = (table(spark, sf_dir, x) for x in ("pages", "documents", "labels"))
    listed = content_list(pages, cut(evidence(documents, labels))).union(spam_list(pages)).distinct()
    out = filter_urls(pages, cut(listed))
    return out.select("page_id", "host", "path", "rule", "verdict", "canonical")


def _oracle() -> str:
    labels = ", ".join(f"'{x}'" for x in SPAM_LABELS)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    canon = ("regexp_replace(host, '^(www|m|blog)\\.', '') || case when regexp_replace(path, '(/|/index\\.html?|\\.html?)$', '') = '' "
             "then '/' else regexp_replace(path, '(/|/index\\.html?|\\.html?)$', '') end")
    return f"""
with rest as (
  select page_id, row_number() over () as rid, html,
         case when url is null or position('://' in url) = 0 then '' else substring(url, position('://' in url) + 3) end as rest
  from pages),
parts as (
  select page_id, rid, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path from rest),
canon as (select *, case when host <> '' then {canon} end as canonical from parts),
rules(rule_host, rule_path, rule_verdict) as (values {rules}),
best as (
  select rid, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from canon join rules on ('.' || host) like ('%.' || rule_host) and starts_with(path, rule_path) group by rid),
known as (select doc_id, min(toxic) as toxic from labels where toxic is not null group by doc_id),
doc_lines as (select toxic, trim(unnest(string_split(text, chr(10)))) as line from documents join known using (doc_id)),
evidence as (select line from doc_lines where length(line) >= {LEAST_PASSAGE} group by line having min(toxic) = 1),
page_lines as (select canonical, trim(unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)))) as line
               from canon where canonical is not null),
listed as (select canonical from canon where list_has_any(string_split(host, '.'), [{labels}])
           union select canonical from page_lines where line in (select line from evidence))
select page_id, host, path, rule,
       coalesce(rule_verdict, case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict, canonical
from canon left join best using (rid)"""


OP5_SQL = _oracle()
