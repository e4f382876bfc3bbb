import math
from collections import Counter

from riskflow.llm import lm_score as lm
from tests.llm.helpers import SCHEMA, frame, rows, words


def brute(data, min_count):
    docs = [[w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(r[1])] for r in data]
    counts = Counter(tuple(d[i:i + n]) for d in docs for n in (1, 2, 3) for i in range(len(d) - n + 1))
    kept = {k: v for k, v in counts.items() if len(k) == 1 or v >= min_count}
    total = sum(map(len, docs))
    out = []
    for d in docs:
        s, backed = 0.0, 0
        for i, w in enumerate(d):
            context, factor = tuple(d[max(0, i - 2):i]), 0
            while context and (*context, w) not in kept:
                context, factor = context[1:], factor + 1
            below = counts[context] if context else total
            s += math.log(counts[(*context, w)] / below) + factor * math.log(lm.BACKOFF)
            backed += factor > 0
        out.append((len(d), s, backed))
    return out


def test_scores_match_brute_force(spark, monkeypatch):
    data = rows(n=80)
    assert lm.MIN_COUNT == 1
    # one block, then many chunks and parts; nothing pruned, then n-grams seen once or twice
    for chunk, part, least in ((lm.CHUNK, lm.PART_BYTES, 1), (5000, 9000, 1), (5000, 9000, 3)):
        want = {}
        for r, b in zip(data, brute(data, least)):
            want.setdefault(r[0], []).append(b)
        assert any(b[2] for own in want.values() for b in own) == (least > 1)
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "PART_BYTES", part)
        out = lm.lm_scores(frame(spark, data), min_count=least).collect()
        assert len(out) == len(data)
        got = {}
        for r in out:
            got.setdefault(r["id"], []).append((r["n_words"], r["score"], r["n_backed_off"]))
            assert (r["mean"] is None) == (r["n_words"] == 0)
        for i in want:
            for a, b in zip(sorted(got[i]), sorted(want[i])):
                assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-6 * max(1, abs(b[1]))


def test_empty_table(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
