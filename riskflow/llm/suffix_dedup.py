"""Suffix-array dedup: remove every byte covered by a 400-byte string that also starts elsewhere.

A full suffix array of all texts would ship every suffix. This one is sparse. In any 400-byte string one 48-byte gram is
chosen, the last one with the smallest hash, so equal strings choose the same gram at the same offset: only suffixes at
chosen grams ("anchors", about one in 177 bytes) can show a repeat. What can repeat around an anchor lies in its context,
352 bytes before and 400 from it.

1. Scan: anchors (text key, position, gram hash, context hash). Anchors with a context that occurs twice are repeated over
   the whole of it; a gram hash that occurs in one context only needs nothing more.
2. Second scan: bytes of the other contexts whose gram occurs in several (a bitmap of fixed size chooses them in the scan;
   the few it lets through by chance find no partner), one row a distinct context and task, moved once, to its gram.
3. A group of contexts with the same gram is ordered twice by deep-shallow sorting, by what follows the anchor and by what
   precedes it (reversed): multikey quicksort over 8-byte words to a shallow depth, then blind tries order what is still
   equal. The two arrays of longest common prefixes tell for each offset l of the anchor in a 400-byte string which
   contexts agree on l bytes before and 400 - l from the anchor.
4. Groups above `GROUP` contexts are first split: the range of l is halved, and a half is pursued only by contexts that
   share what all its strings share (its core), grouped by the core's hash; if even the union of its strings is shared,
   all are repeated at once. So a passage in a third of all texts is never one group: what surrounds it tells the contexts
   apart, and a single l needs no group.
5. The offsets found give each text its covered intervals, joined once with the texts.

Texts that occur twice, of 400 bytes or more, are covered whole; of equal texts one takes part in steps 1 to 4.

Defined results: null text is empty; an empty or short text keeps all its bytes; repeated rows are copies of each other;
null ids are kept as they are; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskflow.llm.common import _BYTE, U, chunks, cut, drop_cut, flat, mix64, powers, signed, table

LENGTH, GRAM = 400, 48
SPAN = LENGTH - GRAM + 1             # grams in a string, offsets l = 0 .. SPAN - 1
SCAN_BYTES = 1 << 20
STEP = 1 << 23                       # starts whose chosen grams are found at once
BITMAP_WORDS = 1 << 21               # 16 MB, whatever the input
GROUP = 1 << 15                      # contexts that a task orders at once, about 25 MB
SHALLOW, WORD = 64, 8


# ---------------------------------------------------------------- scan

def chosen(gram: np.ndarray, starts: int) -> np.ndarray:
    """Position of the last of the least grams of the string at each start. A position is packed with its hash in 24 bits,
    counted from its step, so that it never wraps inside a string, however long the text is."""
    out, mask = np.empty(starts, np.int64), U((1 << 24) - 1)
    for a in range(0, starts, STEP):
        k = min(STEP, starts - a)
        part = gram[a:a + k + SPAN - 1]
        rank = (part >> U(24) << U(24)) | (mask - np.arange(len(part), dtype=U))
        blocks = np.concatenate([rank, np.full(-len(part) % SPAN, ~U(0))]).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        out[a:a + k] = a + (mask - (np.minimum(behind[:k], ahead[SPAN - 1:SPAN - 1 + k]) & mask)).astype(np.int64)
    return out


def anchors_of(data: np.ndarray, offs: np.ndarray):
    """(doc, position, gram hash, context hash, hi, lo) of the anchors of the texts; hi / lo bound the offset l."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(U), none.view(U), none, none
    up, down = powers(n + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * up[:n])])
    gram = mix64((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    end_of = np.repeat(offs[1:], np.diff(offs))                      # end of the text at each byte
    starts = n - LENGTH + 1
    at = np.unique(chosen(gram, starts)[np.arange(starts) + LENGTH <= end_of[:starts]])
    doc = np.searchsorted(offs, at, "right") - 1
    first, last = np.maximum(at - (SPAN - 1), offs[doc]), np.minimum(at + LENGTH, offs[doc + 1])
    before, behind_ = at - first, last - at
    context = mix64((total[last] - total[first]) * down[first] + before.astype(U) * U(0xA0761D6478BD642F) + behind_.astype(U))
    return doc, at - offs[doc], gram[at], context, before, np.maximum(0, LENGTH - behind_)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> anchors; of equal texts in the task the first only."""
    seen: set[int] = set()
    for batch in batches:
        data, offs = flat(batch.column(1))
        keys = batch.column(0).to_numpy()
        for i, j, part, at in chunks(data, offs, SCAN_BYTES):
            doc, pos, gram, context, hi, lo = anchors_of(part, at)
            fresh = np.zeros(j - i, bool)
            for d, k in enumerate(keys[i:j].tolist()):
                if k not in seen:
                    seen.add(k)
                    fresh[d] = True
            take = fresh[doc] if len(doc) else np.zeros(0, bool)
            cols = (keys[i:j][doc[take]], pos[take], signed(gram[take]), signed(context[take]), hi[take], lo[take])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "pos", "gram", "context", "hi", "lo"])


def _contexts(bitmap):
    """Task function: text -> bytes before (reversed) and from the anchors whose gram's bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = np.frombuffer(bitmap.value, U), set()
        for batch in batches:
            data, offs = flat(batch.column(0))
            for i, j, part, at in chunks(data, offs, SCAN_BYTES):
                doc, pos, gram, context, _, _ = anchors_of(part, at)
                hit = np.flatnonzero((words[(gram & U(BITMAP_WORDS - 1)).astype(np.int64)] >> (gram >> U(58))) & U(1))
                raw, rows, left, right = part.tobytes(), [], [], []
                for a in hit:
                    k = (int(gram[a]), int(context[a]))
                    if k in seen:
                        continue
                    seen.add(k)
                    p = int(at[doc[a]] + pos[a])
                    rows.append(a)
                    left.append(raw[max(p - SPAN + 1, int(at[doc[a]])):p][::-1])
                    right.append(raw[p:min(p + LENGTH, int(at[doc[a] + 1]))])
                yield pa.RecordBatch.from_arrays([pa.array(signed(gram[rows])), pa.array(signed(context[rows])), pa.array(left, pa.binary()),
                                                  pa.array(right, pa.binary())], names=["gram", "context", "left", "right"])
    return run


# ---------------------------------------------------------------- deep-shallow sorting

def common_prefix(a: bytes, b: bytes, lo: int = 0) -> int:
    """Length of the longest common prefix; the first `lo` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[lo:n] == b[lo:n]:
        return n
    hi = n
    while hi - lo > 1:
        m = (lo + hi) // 2
        if a[lo:m] == b[lo:m]:
            lo = m
        else:
            hi = m
    return lo if a[lo] != b[lo] else lo + 1


def blind_trie(items: list[int], strings: list[bytes], depth: int) -> list[int]:
    """Order of strings that agree on `depth` bytes. Inner nodes are [skip, {byte: child}]: the trie keeps branching bytes
    only, a string walks down blindly to some leaf and is compared with that one leaf."""
    def byte(i: int, at: int) -> int:
        s = strings[i]
        return s[at] if at < len(s) else -1
    root = [items[0]]                                                # a leaf is a list of equal strings
    for x in items[1:]:
        node = root
        while isinstance(node, tuple):
            node = node[1].get(byte(x, node[0])) or next(iter(node[1].values()))
        other = node[0]
        if strings[x] == strings[other]:
            node.append(x)
            continue
        skip = common_prefix(strings[x], strings[other], depth)
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < skip:
            parent, node = node, node[1][byte(x, node[0])]
        if isinstance(node, tuple) and node[0] == skip:
            node[1][byte(x, skip)] = [x]
            continue
        new = (skip, {byte(other, skip): node, byte(x, skip): [x]})
        if parent is None:
            root = new
        else:
            parent[1][byte(x, parent[0])] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Indices in lexicographic order: multikey quicksort over words of 8 bytes to `SHALLOW`, then blind tries."""
    out, stack = [], [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) == 1:
            out.append(items[0])
            continue
        if depth >= SHALLOW:
            out.extend(blind_trie(items, strings, depth))
            continue
        pivot = strings[items[len(items) // 2]][depth:depth + WORD]
        less, same, more = [], [], []
        for i in items:
            w = strings[i][depth:depth + WORD]
            (same if w == pivot else less if w < pivot else more).append(i)
        if more:
            stack.append((more, depth))
        if len(pivot) < WORD:                                        # strings that end in the pivot word are equal
            stack.extend(([i], depth) for i in same)
        else:
            stack.append((same, depth + WORD))
        if less:
            stack.append((less, depth))
    return out


def ordered(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes of neighbours in it, first 0)."""
    order = deep_shallow(strings)
    lcp = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return np.array(order), np.array(lcp)


def offsets_in(left: list[bytes], right: list[bytes], lo: int, hi: int) -> list[tuple[int, int] | None]:
    """For each context the largest and smallest l in lo..hi-1 at which its 400-byte string equals another's."""
    g = len(left)
    if g == 2:
        most = min(common_prefix(left[0], left[1]), hi - 1)
        least = max(LENGTH - common_prefix(right[0], right[1]), lo)
        return [(most, least) if least <= most else None] * 2
    l_order, l_lcp = ordered(left)
    r_order, r_lcp = ordered(right)
    turns = np.unique(np.clip(np.concatenate([[lo, hi], l_lcp + 1, LENGTH - r_lcp]), lo, hi))
    l_len, r_len = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    most, least = np.full(g, -1), np.full(g, SPAN)
    for a, b in zip(turns[:-1], turns[1:]):                          # nothing changes for l in a..b-1
        runs_l, runs_r = np.empty(g, np.int64), np.empty(g, np.int64)
        runs_l[l_order] = np.cumsum(l_lcp < a)
        runs_r[r_order] = np.cumsum(r_lcp < LENGTH - a)
        _, back, count = np.unique(runs_l * (g + 1) + runs_r, return_inverse=True, return_counts=True)
        hit = (count[back] > 1) & (l_len >= a) & (r_len >= LENGTH - a)
        most[hit] = np.maximum(most[hit], b - 1)
        least[hit] = np.minimum(least[hit], a)
    return [(int(x), int(y)) if x >= 0 else None for x, y in zip(most, least)]


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (gram, lo, hi, core) -> (gram, context, most, least)."""
    def solve(key, group: dict[int, tuple[bytes, bytes]]) -> list[tuple]:
        if len(group) < 2:
            return []
        names = list(group)
        found = offsets_in([group[c][0] for c in names], [group[c][1] for c in names], key[1], key[2])
        return [(key[0], c, *f) for c, f in zip(names, found) if f]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["gram", "context", "most", "least"])

    key, group, rows = None, {}, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in range(4)))
        names, left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()
        for k, c, l, r in zip(keys, names, left, right):
            if k != key:
                rows += solve(key, group)
                key, group = k, {}
            group[c] = (l, r)
        if len(rows) > 4096:
            yield table_of(rows)
            rows = []
    yield table_of(rows + (solve(key, group) if key else []))


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, context, lo, hi, left, right) -> for both halves of lo..hi-1 the hashes of the core and of the union."""
    def digest(l: bytes, r: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(l + b"|" + r + len(l).to_bytes(4, "big"), digest_size=8).digest(), "big", signed=True)
    for batch in batches:
        rows = []
        for gram, context, lo, hi, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            mid = (lo + hi) // 2
            for a, b in ((lo, mid), (mid, hi)):
                if a < b and len(left) >= a and len(right) >= LENGTH - b + 1:
                    top, bottom = min(b - 1, len(left)), max(a, LENGTH - len(right))
                    rows.append((gram, context, a, b, digest(left[:a], right[:LENGTH - b + 1]), digest(left[:top], right[:LENGTH - bottom]), top, bottom))
        cols = list(zip(*rows)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["gram", "context", "lo", "hi", "core", "all", "most", "least"])


# ---------------------------------------------------------------- the operator

def bitmap_of(grams: DataFrame):
    bit = F.shiftrightunsigned("gram", 58).cast("int")
    rows = (grams.select(F.col("gram").bitwiseAND(F.lit(BITMAP_WORDS - 1)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m"))
            .groupBy("w").agg(F.bit_or("m").alias("m"))).toArrow()
    words = np.zeros(BITMAP_WORDS, np.int64)
    words[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return grams.sparkSession.sparkContext.broadcast(words.tobytes())


def split_large(contexts: DataFrame, large: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(problems, found) for grams with more than GROUP contexts: problems (gram, context, lo, hi, core) of at most GROUP
    contexts each, and offsets found on the way."""
    state = contexts.join(large, "gram", "left_semi").select("gram", "context", F.lit(0).cast("long").alias("lo"), F.lit(SPAN).cast("long").alias("hi"))
    problems, found = None, None
    while not state.isEmpty():
        rows = state.join(contexts, ["gram", "context"]).select("gram", "context", "lo", "hi", "left", "right")
        names = ["gram", "context", "lo", "hi", "core", "all", "most", "least"]
        rows = cut(rows.mapInArrow(_halves, ", ".join(f"`{n}` long" for n in names)))
        whole = rows.groupBy("gram", "lo", "hi", "all").agg(F.count(F.lit(1)).alias("n_all"))
        cores = rows.groupBy("gram", "lo", "hi", "core").agg(F.count(F.lit(1)).alias("n_core")).where("n_core > 1")
        rows = rows.join(cores, ["gram", "lo", "hi", "core"]).join(whole, ["gram", "lo", "hi", "all"])
        rows = cut(rows.withColumn("done", (F.col("n_all") > 1) & (F.col("most") >= F.col("least"))))
        hits = rows.where("done").select("gram", "context", "most", "least")
        # a context whose union recurs is settled for this half, but stays the others' partner
        rest = rows.where((F.col("n_core") > F.col("n_all")) & (F.col("hi") - F.col("lo") > 1))
        small = rest.where(F.col("n_core") <= GROUP).select("gram", "context", "lo", "hi", "core")
        found = hits if found is None else found.unionByName(hits)
        problems = small if problems is None else problems.unionByName(small)
        state = rest.where(F.col("n_core") > GROUP).select("gram", "context", "lo", "hi")
    return problems, found


def repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(base, spans): base rows (id, text, key); covered intervals (key, start, end), which may overlap."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("text"))
    long_enough = base.where(F.octet_length("text") >= LENGTH)
    schema = "key long, pos long, gram long, context long, hi long, lo long"
    anchors = cut(long_enough.select("key", "text").mapInArrow(_scan, schema).distinct())
    kinds = cut(anchors.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n")))
    grams = cut(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    bitmap = bitmap_of(grams)
    bytes_of = long_enough.select("text").mapInArrow(_contexts(bitmap), "gram long, context long, left binary, right binary")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    large = grams.where(F.col("kinds") > GROUP)
    problem = ["gram", "lo", "hi", "core", "context", "left", "right"]
    if large.isEmpty():
        # a context that only shares its bit with a wanted gram makes a group of its own kind, which yields nothing
        ready = bytes_of.select("gram", F.lit(0).cast("long").alias("lo"), F.lit(SPAN).cast("long").alias("hi"), F.lit(0).cast("long").alias("core"),
                                "context", "left", "right")
        found = None
    else:
        contexts = cut(bytes_of.join(grams, "gram"))
        hot = cut(contexts.where(F.col("kinds") > GROUP).drop("kinds").dropDuplicates(["gram", "context"]))
        problems, found = split_large(hot, large.select("gram"))
        ready = contexts.where(F.col("kinds") <= GROUP).select("gram", F.lit(0).cast("long").alias("lo"), F.lit(SPAN).cast("long").alias("hi"),
                                                               F.lit(0).cast("long").alias("core"), "context", "left", "right")
        ready = ready.unionByName(problems.join(hot, ["gram", "context"]).select(*problem))
    # all rows of a problem have its gram and core, so they meet in one partition, in order
    ready = ready.repartition(parts, "gram", "core").sortWithinPartitions("gram", "lo", "hi", "core")
    offsets = ready.mapInArrow(_sort_groups, "gram long, context long, most long, least long")
    offsets = cut(offsets if found is None else offsets.unionByName(found))
    bitmap.unpersist()
    some = offsets.join(anchors, ["gram", "context"]).select("key", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + LENGTH).alias("end"))
    full = anchors.join(kinds.where("n > 1"), ["gram", "context"]).where("hi >= lo").select(
        "key", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + LENGTH).alias("end"))
    copies = long_enough.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "key", F.lit(0).cast("long").alias("start"), F.lit((1 << 62)).cast("long").alias("end"))
    return base, some.unionByName(full).unionByName(copies)


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes of a text of n bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = flat(batch.column(1))
        raw, spans = memoryview(data), batch.column(2).to_pylist()
        n_bytes, removed, runs, digests = [], [], [], []
        for d in range(batch.num_rows):
            own = raw[offs[d]:offs[d + 1]]
            gone = merged([(s["start"], s["end"]) for s in spans[d] or ()], len(own))
            h, at = hashlib.sha256(), 0
            for a, b in gone:
                h.update(own[at:a])
                at = b
            h.update(own[at:])
            n_bytes.append(len(own))
            removed.append(sum(b - a for a, b in gone))
            runs.append(len(gone))
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array(digests)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    base, spans = repeats(docs, id_col, text_col)
    per = cut(spans.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept_sha256", T.StringType())])
    return base.join(per, "key", "left").select("id", "text", "spans").mapInArrow(_cut_texts, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
