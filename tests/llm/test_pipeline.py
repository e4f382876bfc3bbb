from collections import Counter

import corpus_pipeline
from riskflow.llm import mixing, quality, secrets
from tests.llm.helpers import frame, rows
from tests.llm.test_jaccard_join import brute, corpus
from tests.llm.test_secrets import CASES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path):
    data = corpus(11) + [(3000 + i, rows()[i][1] + " " + t, "en", "s1", 1) + rows()[0][5:] for i, t in enumerate(CASES[:6])]
    frame(spark, data).select(COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == COLUMNS
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(docs.collect())
    judged = quality.judge(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert Counter(map(tuple, seen[0])) == Counter(tuple(r)[:5] for r in judged.where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in seen[1]) == sorted({c for _, n, c in brute([tuple(r) for r in seen[0]]) if n})
    assert sorted((r["doc_id"], secrets.masked(r["text"])) for r in seen[1]) == sorted((r["doc_id"], r["text"]) for r in seen[2])
    assert any("[SECRET]" in r["text"] for r in seen[2])
    copies = {r["id"]: r["copies"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "s2"))).collect()}
    assert Counter(r["doc_id"] for r in seen[3]) == Counter({k: v for k, v in copies.items() if v})
    used = sum(r["length"] for r in seen[4])
    texts = {r["doc_id"]: r for r in seen[3]}
    once = [r for r in seen[4] if copies[r["doc_id"]] == 1]
    assert {r["doc_id"] for r in seen[4]} == set(texts) and used >= sum(r["length"] for r in once)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert key(whole) == key(seen[4])


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]


def test_scratch_of_a_stage_goes_with_the_next(spark, tmp_path):
    import os

    import corpus_pipeline as cp
    from riskflow import session
    from tests.llm.helpers import SCHEMA, frame, rows

    def there():
        return {p for p in session.scratch_written() if os.path.isdir(p.removeprefix("file:"))}
    docs = frame(spark, rows(), 3).select("doc_id", "text", "lang", "source", "n_chars")
    kept = there()
    for i, (_, work) in enumerate(cp.STAGES):
        before = there() - kept
        path = str(tmp_path / str(i))
        work(spark, docs, "").write.parquet(path)
        assert not before & there()                                   # what the stage before wrote is gone
        docs = spark.read.parquet(path)
    lazily = cp.STAGES[0][1](spark, frame(spark, rows(), 3).select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert cp.STAGES[2][1](spark, lazily, "").count() == lazily.count()                   # tables that are still read stay
    assert docs.count() > 0


def test_empty_table(spark, tmp_path):
    import corpus_pipeline as cp
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
