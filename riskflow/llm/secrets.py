"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for strings in a sensitive context.

Base kinds are three patterns (leftmost, non-overlapping per kind): `assign`, `access`, `hex`. The method adds `novel`
spans: in the block (lines up to a blank one; an armour from BEGIN to its END as a whole) of a sensitive word (password,
credential, private key, ...), before and after it, every string of printable ASCII is compressed with zstandard, primed
with a dictionary of common identifiers that also holds their letter statistics, once with and once without it behind its
surrounding text; if it costs at least `NOVEL_SHARE` of its length and `LEAST_NOVEL` bytes more, neither the surrounding
code nor the dictionary explain it, and it is reported. Of a string with separators (key=value) the novel parts are
reported, and all of it if only the whole is novel. A string inside a base span is not reported again.

Whole texts are scanned by a task function over Arrow batches; a row needs no other row, so there is no shuffle.

Defined results: null text is empty and has no span; positions are code points, end exclusive; repeated rows get a row
each; only the two named columns are read (`mask` keeps all columns).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskflow.llm.common import table

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns of the base kinds; the letters of ASSIGN's names match in either case (ASCII only).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
# Words that make their block a sensitive context.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "private key",
             "credential", "authorization", "bearer", "signature", "client_id", "connection_string")
CONTEXT = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
BLOCK = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")
ARMOUR = re.compile(r"-----BEGIN ([^\n-]+)-----.*?-----END \1-----", re.DOTALL)
# A quoted string without spaces, or a run up to a space, quote, bracket or list separator; where either falls into parts.
CANDIDATE = re.compile(r"""(?<=")[!#-~]+(?=")|(?<=')[!-&(-~]+(?=')|(?:(?![\s"'`<>(){}\[\],;|])[!-~])+""")
PARTS = re.compile(r"[^:=<>(){}\[\],;|\"'`]+")
AROUND = 2048                        # surrounding text on either side
NOVEL_SHARE, LEAST_NOVEL, LEVEL = 0.66, 8, 3
SHORTEST = 6                         # fewer characters never cost LEAST_NOVEL bytes
# Common identifiers of source code, the priming dictionary.
IDENTIFIERS = ("self this null none true false return import from class public private static final void const let var function "
               "def async await export default require module package string integer boolean float double char byte array list map "
               "dict set object value values key keys name names type types index count size length offset buffer stream reader "
               "writer input output file path directory config configuration settings options params parameters argument arguments "
               "request response header headers body content client server service session user username account email address "
               "password passwd secret token api_key apikey access_key private_key credential credentials authorization bearer "
               "signature connection_string client_id database table column query result error exception message logger logging "
               "debug info warning timeout retry callback handler listener event context environment production development test "
               "https http localhost example com org net www json xml yaml html text application utf base64 sha256 md5 hash encode "
               "decode encrypt decrypt random uuid timestamp created updated deleted version license copyright")


@lru_cache(maxsize=1)
def _compressor():
    import zstandard as z
    names = IDENTIFIERS.split()
    # fixed samples; training adds the code lengths of letters, so that short texts need not spell out rare characters
    samples = [" ".join(names[(i * k) % len(names)] for k in range(1, 13)).encode() for i in range(1, 401)]
    trained = z.train_dictionary(2048, samples, k=64, d=6)
    primed = z.ZstdCompressionDict(trained.as_bytes())
    return z.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def marginal_bytes(text: str, start: int, end: int) -> int:
    """Compressed bytes that text[start:end] adds behind its surroundings."""
    z = _compressor()
    around = (text[max(0, start - AROUND):start] + "\n" + text[end:end + AROUND]).encode("utf-8", "replace")
    return len(z.compress(around + text[start:end].encode("utf-8", "replace"))) - len(z.compress(around))


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns; `low` is the lower-cased text, a cheap first look."""
    found = []
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def sensitive_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the blocks that hold a sensitive word, in order and disjoint."""
    armours = [m.span() for m in ARMOUR.finditer(text)] if "-----BEGIN " in text else []
    at = k = 0
    while m := BLOCK.search(text, at):
        start, end = m.span()
        while k < len(armours) and armours[k][0] < end:
            if armours[k][1] > end:
                line = text.find("\n", armours[k][1])
                end = BLOCK.match(text, armours[k][1]).end() if text[armours[k][1]:line if line >= 0 else len(text)].strip() else armours[k][1]
            k += 1
        if CONTEXT.search(text, start, end):
            yield start, end
        at = end


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not any(w in low for w in SENSITIVE):
        return []
    covered = bytearray(len(text))
    for s, _, e in base:
        covered[s:e] = b"\1" * (e - s)

    def novel(s: int, e: int) -> bool:
        if e - s < SHORTEST or covered.find(0, s, e) < 0:
            return False
        return marginal_bytes(text, s, e) >= max(LEAST_NOVEL, NOVEL_SHARE * (e - s))

    found = []
    for start, end in sensitive_blocks(text):
        for c in CANDIDATE.finditer(text, start, end):
            s, e = c.start(), c.start() + len(c[0].rstrip(".,:"))
            parts = [m.span() for m in PARTS.finditer(text, s, e)]
            hits = [p for p in parts if novel(*p)]
            if not hits and parts != [(s, e)] and novel(s, e):
                hits = [(s, e)]
            found += [(a, 3, b) for a, b in hits]
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind number, end), sorted."""
    if not text:
        return [], []
    low = text.lower()
    base = sorted(base_spans(text, low))
    return base, sorted(base + novel_spans(text, low, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        n = [[sum(1 for s in base if s[1] == k) for base, _ in rows] for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in n),
             pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
             pa.array([joined(every) for _, every in rows], pa.string()),
             pa.array([len(every) - len(base) for base, every in rows], pa.int64())],
            names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end), n_novel."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                           T.StructField("n_novel", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_report, schema)


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found span (overlapping ones as one) replaced by the mark."""
    _, spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    start, stop = spans[0][0], spans[0][2]
    for s, _, e in [*spans[1:], (len(text) + 1, 0, 0)]:
        if s >= stop:
            out += [text[at:start], mark]
            at, start, stop = stop, s, e
        else:
            stop = max(stop, e)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `docs`, secrets in the text replaced by a mark; `length_col` follows the new text."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    n_at = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [masked(t) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            if n_at is not None:
                sizes = cols[n_at].to_pylist()
                cols[n_at] = pa.array([len(b) if a is not b else n for a, b, n in zip(old, new, sizes)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    return docs.mapInArrow(run, schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
