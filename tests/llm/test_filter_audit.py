import itertools
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import types as T

from riskflow.llm import filter_audit as a
from tests.llm.helpers import SCHEMA, frame, rows, words

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()),
                       T.StructField("part", T.StringType()), T.StructField("n", T.StringType())])


def more_rows():
    out = rows(7, 80)
    distinct = " ".join(f"word{i}" for i in range(150))
    extra = [(300 + i, distinct, "en", "s", 1) for i in range(40)]                   # a group of copies
    extra += [(400, distinct + " #", "de", "s", 1), (401, distinct.upper(), "de", "s", 1), (402, " ".join(["a"] * 120), "", "s", 1),
              (403, distinct.upper() + "|" + "B" * 60000, None, "s", 1), (404, "\x0bone\x0ctwo\x1cthree ", "fr", "s", 1), (300, distinct, "en", "s", 1)]
    return out + [r + out[0][5:] for r in extra]


def labels():
    out = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 420, 2)]
    out += [(2, 1, None), (None, 1, 1), (9999, 1, 1), (304, None, 1), (304, 1, None)]
    return [(i, None if q is None else int(q), None if t is None else int(t), "p", "n") for i, q, t in out]


def brute(docs, marks):
    smallest: dict[str, int] = {}
    for d, t, *_ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    good, toxic = {d for d, q, _, *_ in marks if q == 1}, {d for d, _, x, *_ in marks if x == 1}
    parts: dict[str, list] = {}
    for d, t, lang, *_ in docs:
        t = t or ""
        w = words(t)
        fails = {f for f, c in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                                             re.search("[#$%&*|]", t), d is not None and smallest[t] < d)) if c}
        parts.setdefault(lang or "", []).append((fails, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, every in parts.items():
        shapley, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = every
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                lines.append((f, [part, "".join(order), step + 1, len(left), len(gone), sum(f in x[0] for x in every) - len(gone),
                                  sum(x[0] == {f} for x in every), sum(x[1] for x in gone), sum(x[2] for x in gone)]))
        out += [tuple(line + [shapley[f]]) for f, line in lines]
    return sorted(out)


def test_matches_brute_force_and_sql(spark, monkeypatch):
    docs, marks = more_rows(), labels()
    want = brute(docs, marks)
    table, known = frame(spark, docs), spark.createDataFrame(marks, LABELS)
    out = a.audit(a.failure_counts(table, known))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == want
    con = duckdb.connect()
    con.register("documents", pa.table({c: [r[i] for r in docs] for i, c in enumerate(["doc_id", "text", "lang"])}))
    con.register("labels", pa.table({c: pa.array([r[i] for r in marks], pa.int64()) for i, c in enumerate(["doc_id", "quality", "toxic"])}))
    assert sorted(con.sql(a.OP12_SQL).fetchall()) == want
    monkeypatch.setattr(a, "SALT_ROWS", 3)                           # groups spread over salts, without the broadcast
    monkeypatch.setattr(a, "SMALL_ROWS", 0)
    assert sorted(map(tuple, a.audit(a.failure_counts(table, known)).collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert a.audit(a.failure_counts(spark.createDataFrame([], SCHEMA), none)).collect() == []
    out = a.audit(a.failure_counts(frame(spark, more_rows()[:2]), none)).collect()
    assert len(out) == 600 * len({r["part"] for r in out}) and all(r["good_lost"] == r["toxic_lost"] == 0 for r in out)
