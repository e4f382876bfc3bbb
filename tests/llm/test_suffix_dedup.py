import hashlib
import random
from collections import Counter

import numpy as np

from riskflow.llm import suffix_dedup as sd
from riskflow.llm.suffix_dedup import LENGTH
from tests.llm.helpers import SCHEMA, frame, prose, rows


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + LENGTH] for b in raw for i in range(len(b) - LENGTH + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, texts, parts=4):
    data = [(i, t, "en", "s", 1) + rows()[0][5:] for i, t in enumerate(texts)]
    out = {r["id"]: tuple(r)[1:] for r in sd.dedup(frame(spark, data, parts)).collect()}
    for i, want in enumerate(brute(texts)):
        assert out[i] == want, (i, out[i], want)


def corpus(seed=2):
    rng = random.Random(seed)
    shared = [prose(rng, n, 3000) for n in (70, 75, 80, 90, 300)]
    texts = [r[1] for r in rows(seed)]
    for i in range(60):
        t = prose(rng, rng.randrange(5, 200), 3000)
        p = rng.choice(shared)
        cut = rng.randrange(0, len(p) // 4)
        at = rng.randrange(0, len(t))
        texts.append(t[:at] + p[cut:len(p) - rng.randrange(0, 30)] + t[at:])
    texts += ["ab" * 300, "ab" * 201, "abc" * 134, "a" * 400, "a" * 401, "a" * 399, "x" + "a" * 400, "For " * 150 + "Hed " * 150, "Hed " * 120 + "end",
              "é" * 250, "é" * 199 + "xx", shared[4] * 2, shared[4][:LENGTH], shared[4][1:LENGTH + 1], shared[4][:LENGTH - 1]]
    return texts


def test_against_brute_force(spark):
    compare(spark, corpus())


def test_groups_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 3)
    compare(spark, corpus(7), parts=7)


def test_repeated_rows_nulls_and_empty(spark):
    data = rows()
    got = sorted((str(r["id"]), *tuple(r)[1:]) for r in sd.dedup(frame(spark)).collect())
    want = sorted((str(r[0]), *w) for r, w in zip(data, brute([r[1] for r in data])))
    assert got == want
    assert sd.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_deep_shallow_sort_orders_like_sorted():
    rng = random.Random(1)
    for _ in range(200):
        stem = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 5, 70, 150])))
        strings = [stem[:rng.randrange(len(stem) + 1)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 60))]
        strings += [stem + bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 6))) for _ in range(30)]
        order, lcp = sd.ordered(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        for a, b, n in zip(order, order[1:], lcp[1:]):
            x, y = strings[a], strings[b]
            assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def places(data):
    return sd.anchors_of(data, np.array([0, len(data)]))[1]


def test_the_chosen_gram_is_the_same_across_2_to_the_24():
    rng = np.random.default_rng(11)

    def letters(n):
        return rng.integers(97, 123, n, dtype=np.uint8)
    while True:                          # a string whose least gram occurs twice, and what follows never chooses its second place
        string, tail = letters(LENGTH), letters(600)
        string[250:298] = string[50:98]
        if places(string).tolist() == [250] and 199 not in places(np.concatenate([string[51:], tail])):
            break
    at = (1 << 24) - 150                 # the boundary lies between the two places
    assert at + 250 in places(np.concatenate([letters(at), string, tail]))


def test_anchors_do_not_depend_on_steps(monkeypatch):
    texts = [(t or "").encode() for t in corpus(5)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = sd.anchors_of(data, offs)
    for step in (101, 353, 1000):
        monkeypatch.setattr(sd, "STEP", step)
        assert all((a == b).all() for a, b in zip(sd.anchors_of(data, offs), want))
