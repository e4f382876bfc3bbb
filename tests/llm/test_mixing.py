from collections import defaultdict

from riskflow.llm import mixing
from tests.llm.helpers import SCHEMA, frame, rows, words


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in held)
        w = sum(weight[s] for s in sizes if s not in held)
        target = {s: 3 * sizes[s] if s in held else free * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in held and target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def test_mix_meets_targets(spark):
    out = mixing.mix(frame(spark)).collect()
    size = defaultdict(int)
    for r in rows():
        size[r[3]] += len(words(r[1]))
    want = brute_targets(size)
    key = {s: "1" if s is None else "0" + s for s in size}
    for s in size:
        own = [r for r in out if r["source_key"] == key[s]]
        assert own[0]["source_size"] == size[s]
        assert abs(own[0]["target"] - want[s]) < 1e-6 * max(1, want[s])
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - want[s]) <= max(r["size"] for r in own)
    assert all(0 <= r["copies"] <= 3 for r in out) and len(out) == len(rows())


def test_reruns_and_partitions_agree(spark):
    def run(parts):
        return sorted((str(r["id"]), r["size"], r["copies"]) for r in mixing.mix(frame(spark, parts=parts)).collect())
    assert run(3) == run(7)


def test_budgets_are_nested(spark):
    few = {r["id"]: r["copies"] for r in mixing.mix(frame(spark), weights=(1.0, 4.0, 4.0)).collect()}
    many = {r["id"]: r["copies"] for r in mixing.mix(frame(spark), weights=(8.0, 4.0, 4.0)).collect()}
    first = [r[0] for r in rows() if r[3] == "s0"]
    assert all(few[i] <= many[i] for i in first)


def test_thresholds_match_sorted_brute_force(spark):
    sized, plan = mixing.mix_plan(frame(spark))
    docs, plans = sized.collect(), plan.collect()
    for p in plans:
        own = sorted({(r["hash"]) for r in docs if r["source_key"] == p["source_key"] and r["size"] > 0})
        before = 0
        for h in own:
            size = sum(r["size"] for r in docs if r["hash"] == h and r["source_key"] == p["source_key"])
            if before + size > p["rest"]:
                break
            before += size
        else:
            continue
        want = h + 1 if p["rest"] > 0 and p["rest"] - before >= size / 2 else h
        assert p["threshold"] == (want if p["rest"] > 0 else 0)


def test_take_repeats_rows_with_their_columns(spark):
    docs = frame(spark)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    counts = defaultdict(int)
    for r in mixing.mix(docs).collect():
        counts[r["id"]] += r["copies"]
    got = defaultdict(int)
    for r in taken.collect():
        got[r["doc_id"]] += 1
    assert {k: v for k, v in counts.items() if v} == dict(got)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.take(spark.createDataFrame([], SCHEMA)).collect() == []
