import hashlib
import random
import re

from pyspark.sql import functions as F

from riskflow.llm import fingerprints as fp
from tests.llm.helpers import SCHEMA, frame, rows


def pieces(t):
    return {p for p in re.split(r"[.!?;|]+[ \t]+|[\n\r]+", t) if p}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())                    # one row an id: neighbours are certain
    out = {r["id"]: r for r in fp.fingerprints(frame(spark, data)).collect()}
    order = sorted(data, key=lambda r: -r[0])
    assert len(out) == len(data)
    seen = {}
    for r, following in zip(order, order[1:] + order[:1]):
        text, after, got = r[1] or "", following[1] or "", out[r[0]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got["n_chars"] == len(text)
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got["near_edited"] - jaccard(pieces(text), pieces(edited))) < 1e-12
        assert abs(got["near_next"] - jaccard(pieces(text), pieces(after))) < 1e-12
        assert (len(got["removed"]), len(got["added"])) == (len(pieces(text) - pieces(edited)), len(pieces(edited) - pieces(text)))
        for t, f in ((text, got["fingerprint"]), (edited, got["edited_fingerprint"])):
            assert seen.setdefault(t, f) == f


def test_repeated_and_null_ids_and_single(spark):
    out = fp.fingerprints(frame(spark)).collect()
    assert len(out) == len(rows()) and all(r["near_next"] is not None and r["near_edited"] is not None for r in out)
    one = fp.fingerprints(frame(spark, rows()[:1])).collect()[0]
    assert one["near_next"] == 1.0
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_neighbours_over_many_ranges(spark):
    rng = random.Random(4)
    ids = sorted(rng.sample(range(10**12), 3000)) + [10**15 + i for i in range(2000)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r["id"]: r["next_text"] for r in fp.with_next(docs).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_text_ids(spark):
    texts = {f"k{i:03d}": f"t{i}. u{i}. v" for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(5)
    got = {r["id"]: r["next_text"] for r in fp.with_next(docs).collect()}
    order = sorted(texts, reverse=True)
    assert got == {a: texts[b] for a, b in zip(order, order[1:] + order[:1])}
    assert len(fp.fingerprints(docs).collect()) == 300


def hashed(spark, sets):
    table = spark.createDataFrame(sets, "a array<long>, b array<long>")
    return table.select("a", "b", F.transform("a", lambda x: fp.checked(F.xxhash64(x))).alias("x"), F.transform("b", lambda x: fp.checked(F.xxhash64(x))).alias("y"))


def random_sets():
    rng = random.Random(9)
    sets = [(sorted(rng.sample(range(10**15), rng.randrange(0, 60))), sorted(rng.sample(range(10**15), rng.randrange(0, 60)))) for _ in range(150)]
    sets += [(a, a) for a, _ in sets[:5]] + [(a, a[:-1]) for a, _ in sets[5:10] if a]
    return sets + [(a, sorted(a[k:] + b[:k])) for k, (a, b) in enumerate(sets[10:60])]


def assert_recovered(table):
    for r in fp.with_difference(fp.with_sketch(table, "x", "y"), "x", "y", "d").collect():
        own, other = dict(zip(r["x"], r["a"])), dict(zip(r["y"], r["b"]))
        assert len(r["d"]) == len(set(r["d"]))
        assert set(r["d"]) == set(own) ^ set(other)
        assert {own.get(d, other.get(d)) for d in r["d"]} == set(r["a"]) ^ set(r["b"])


def test_peeling_recovers_the_differing_digests(spark):
    table = hashed(spark, random_sets())
    assert_recovered(table)
    # far more digests than the small sizes hold, in one sketch: the first size fails, a later one recovers them
    none = fp.no_digests()
    row = table.where(F.size("x") > 40).select(
        F.size("x").alias("n"),
        fp.recovered(fp.sketch(F.col("x"), 256, 2), fp.sketch(none, 256, 2), 256, 2).alias("all"),
        fp.recovered(fp.sketch(F.col("x"), 4, 0), fp.sketch(none, 4, 0), 4, 0).alias("small")).first()
    assert row["small"] is None and len(row["all"]) == row["n"]


def test_published_fingerprints_decide_small_edits(spark):
    """Two fingerprints as published, read back from their text, tell which paragraphs differ and how alike the texts are."""
    texts = [(1, ". ".join(f"p{i}" for i in range(500))), (2, ". ".join(f"p{i}" if i != 77 else "new" for i in range(500)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", fp.digests(F.col("text")).alias("a"))
    one, two = fp.with_sketch(docs, "a").select("doc_id", "a", fp.fingerprint("a").alias("f")).orderBy("doc_id").collect()
    def cells(f):
        return [v - (1 << 64) if v >> 63 else v for v in (int(x, 16) for x in f.split(":")[1].split("-"))]
    read = spark.createDataFrame([(cells(one["f"]), cells(two["f"]))], "x array<long>, y array<long>")
    found = read.select(fp.recovered(F.col("x"), F.col("y"), fp.SMALL, 0).alias("d")).first()["d"]
    assert set(found) == set(one["a"]) ^ set(two["a"]) and len(found) == 2


def test_blocks_that_fail_are_retried(spark, monkeypatch):
    monkeypatch.setattr(fp, "LOAD", 24)                              # the first size fails for most blocks
    assert_recovered(hashed(spark, random_sets()))


def test_after_the_last_size_digests_are_compared(spark, monkeypatch):
    monkeypatch.setattr(fp, "LOAD", 60)
    monkeypatch.setattr(fp, "SIZES", (4,))
    assert_recovered(hashed(spark, random_sets()))
