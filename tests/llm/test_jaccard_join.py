import random

from riskflow.llm import jaccard_join as jj
from tests.llm.helpers import SCHEMA, frame, prose, rows, words


def sets(t):
    ws = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)]
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4)))


def brute(data):
    own = [sets(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(data)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [data[i][0] for i in members if data[i][0] is not None]
        least = min(ids) if ids else None
        out += [(str(data[i][0]), len(own[i]), str(least if own[i] else data[i][0])) for i in members]
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    data = rows(seed)
    extra = data[0][5:]
    passage = prose(rng, 120, 4000)
    n = 1000

    def add(t):
        nonlocal n
        data.append((n, t, "en", "s", 1) + extra)
        n += 1
    for _ in range(25):                                              # many share a passage, few link
        add(prose(rng, rng.randrange(20, 200), 4000) + passage)
    for size in (12, 60, 200, 600):                                  # families of near copies, chains included
        stem = prose(rng, size, 4000).split(" ")
        for _ in range(14):
            t = list(stem)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                stem = t
            add(" ".join(t))
    for k in range(1, 8):
        add(" ".join(f"W{i}" for i in range(k)))
        add(" ".join(f"w{i}" for i in range(k)))
    stem = prose(rng, 150, 4000)
    add(stem + prose(rng, 150, 4000))                                # contains the next ones whole
    add(stem)
    add(stem.replace("the", "teh", 2))
    return data


def test_components_match_brute_force(spark):
    for seed in (3, 4):
        data = corpus(seed)
        got = sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in jj.join_documents(frame(spark, data, 6)).collect())
        assert got == brute(data)


def test_threshold_is_exact(spark):
    extra = rows()[0][5:]
    base = [f"t{i}" for i in range(104)]                             # 100 shingles
    texts = [" ".join(base)] + [" ".join(base[:k] + [f"z{k}_{j}" for j in range(104 - k)]) for k in range(80, 100)]
    data = [(i, t, "en", "s", 1) + extra for i, t in enumerate(texts)]
    got = sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in jj.join_documents(frame(spark, data, 3)).collect())
    assert got == brute(data)


def test_one_row_of_each_group_stays(spark):
    data = corpus(5)
    docs = frame(spark, data, 6)
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    want = {}
    empty = 0
    for i, n, c in brute(data):
        if n:
            want.setdefault(c, set()).add(i)
        else:
            empty += 1
    got = kept.collect()
    full = [r for r in got if sets(r["text"])]
    assert sorted(str(r["doc_id"]) for r in full) == sorted(want)
    assert len(got) - len(full) == empty


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jj.join_documents(empty).collect() == [] and jj.keep_one(empty).collect() == []
    blank = frame(spark, [r for r in rows() if not words(r[1])])
    assert all(r["component_id"] == r["id"] and r["n_shingles"] == 0 for r in jj.join_documents(blank).collect())


def test_whole_set_stays_for_a_larger_partner(spark):
    """64 shingles, all in a set of 85: they meet in 48 regions on average, so fewer than 48 open ones must not end it."""
    def run(open_regions):
        members = spark.createDataFrame([(t, x, n, 9, 3) for t in range(open_regions) for x, n in ((1, 64), (2, 85), (9, 64))],
                                        "t long, x long, n long, p long, k long")
        comps = spark.createDataFrame([(1, 1), (2, 2)], "node long, comp long")
        known = spark.createDataFrame([], "x long, p long, d double, link boolean")
        return {r["x"] for r in jj.open_rows(members, comps, known).collect()}
    assert run(40) == {1, 2} and run(16) == {1, 2} and run(15) == set()


def test_templates_around_the_sketch_match_brute_force(spark):
    rng = random.Random(21)
    extra, texts = rows()[0][5:], []
    for _ in range(3):
        base = [f"v{rng.randrange(9000)}" for _ in range(94)]
        for _ in range(16):
            a, n = rng.randrange(5), rng.randrange(64, 90)
            ws = base[a:a + n]
            for _ in range(rng.randrange(3)):
                ws[rng.randrange(len(ws))] = f"u{rng.randrange(9000)}"
            texts.append(" ".join(ws))
    all_sets = [sets(t) for t in texts]
    assert min(map(len, all_sets)) <= 64 < max(map(len, all_sets))
    comp = list(range(len(texts)))
    for i, a in enumerate(all_sets):
        for j, b in enumerate(all_sets[:i]):
            if 4 * len(a & b) >= 3 * len(a | b) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    out = jj.join_documents(frame(spark, [(i, t, "en", "s", 1) + extra for i, t in enumerate(texts)])).collect()
    assert {r["id"]: r["component_id"] for r in out} == dict(enumerate(comp))
