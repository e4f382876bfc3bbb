import math
from collections import Counter, defaultdict

from riskflow.llm import quality
from riskflow.llm.quality import CHAR_CLASSES, COMMON_WORDS, LEAST_WORDS, MIN_WORDS
from tests.llm.helpers import SCHEMA, frame, rows, words
import re


def base(t):
    ws = words(t)
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    covered = {i + j for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def histograms(t):
    ws = words(t)
    joined = "".join(ws)
    chars = [len(re.findall(c, joined)) for c in CHAR_CLASSES]
    spelled = {f(w): w for w in COMMON_WORDS for f in (str, str.capitalize, str.upper)}
    seen = Counter(spelled[w] for w in ws if w in spelled)
    common = [seen[w] for w in COMMON_WORDS]
    return chars, len(joined), common, len(ws)


def distance(p, q):
    def half(a, b):
        return a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q)) / 2))


def shares(parts, whole):
    return [x / whole for x in [*parts, whole - sum(parts)]]


def test_counts_and_distances_match_brute_force(spark):
    data = rows()
    out = quality.judge(frame(spark), keep=["doc_id", "text", "lang"]).collect()
    refs = defaultdict(lambda: [[0] * len(CHAR_CLASSES), 0, [0] * len(COMMON_WORDS), 0])
    for r in data:
        n, _, _, _, rep = base(r[1])
        if n >= MIN_WORDS and not 100 * rep > 50 * n:
            c, nc, w, nw = histograms(r[1])
            ref = refs[r[2]]
            ref[0] = [a + b for a, b in zip(ref[0], c)]
            ref[1] += nc
            ref[2] = [a + b for a, b in zip(ref[2], w)]
            ref[3] += nw
    assert len(out) == len(data)
    for r in out:
        want = base(r["text"])
        assert (r["q_words"], r["q_chars"], r["q_symbols"], r["q_dup_lines"], r["q_repeat"]) == want
        failed = want[0] < LEAST_WORDS or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed
        ref = refs.get(r["lang"])
        c, nc, w, nw = histograms(r["text"])
        dc = distance(shares(c, nc), shares(ref[0], ref[1])) if ref and nw >= LEAST_WORDS else None
        dw = distance(shares(w, nw), shares(ref[2], ref[3])) if ref and nw >= MIN_WORDS else None
        assert (r["char_distance"] is None) == (dc is None) and (dc is None or abs(dc - r["char_distance"]) < 1e-9)
        assert (r["word_distance"] is None) == (dw is None) and (dw is None or abs(dw - r["word_distance"]) < 1e-9)
        far = (dc or 0) > quality.MOST_CHAR_DISTANCE or (dw or 0) > quality.MOST_WORD_DISTANCE
        assert r["kept"] == (not failed and not far)


def test_junk_goes_and_columns_stay(spark):
    docs = frame(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    shouting = [(1000 + i, " ".join(f"{w.upper()}!!" for w in words(rows()[i][1])), "en", "s", 1) + rows()[0][5:] for i in range(3)]
    out = quality.judge(docs.unionByName(spark.createDataFrame(shouting, SCHEMA)), keep=["doc_id"]).where("doc_id >= 1000").collect()
    assert len(out) == 3 and not any(r["kept"] for r in out)


def test_native_plan_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty).collect() == []
    plan = quality.judge(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
