import math
import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from riskflow.llm import toxicity as tx
from tests.llm.helpers import SCHEMA, frame, prose, rows


def corpus(n=900):
    rng = random.Random(6)
    extra, data, labels = rows()[0][5:], [], []
    for i in range(n):
        t, toxic = prose(rng, rng.randrange(20, 150)), rng.random() < 0.2
        if toxic:
            ws = t.split(" ")
            for _ in range(rng.randrange(1, 6)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "you moron", "Stupid", "1di0t", "LOSER"]))
            t = " ".join(ws)
        data.append((i, t, "en", "s", 1) + extra)
        labels.append((i, int(toxic), rng.randrange(2)))
    return data, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_quality_and_calibration(spark):
    data, labels = corpus()
    extra = [(5000 + i, t, None, None, None) + data[0][5:] for i, t in enumerate([None, "", "idiot " * 30000])] + [(None, "x", None, None, None) + data[0][5:]]
    out = tx.score(frame(spark, data + extra + data[:2]), label_frame(spark, labels + [(0, None, 1), (None, 1, 1), (7777, 1, 0)])).collect()
    assert len(out) == len(data) + len(extra) + 2
    truth, hits, wrong = dict((a, b) for a, b, _ in labels), [], 0
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2)
            if r["held_out"] and r["id"] in truth:
                hits.append((r["score"], truth[r["id"]]))
                wrong += (r["score"] >= tx.CUT_OFF) != bool(truth[r["id"]])
    assert len(hits) > 100 and wrong / len(hits) < 0.05
    assert abs(sum(s for s, _ in hits) / len(hits) - sum(t for _, t in hits) / len(hits)) < 0.06


def test_held_out_labels_do_not_matter(spark):
    data, labels = corpus(500)
    flipped = [(a, 1 - b if zlib.crc32(str(a).encode()) % 4 == 2 else b, c) for a, b, c in labels]
    def run(lab):
        return sorted((r["id"], round(r["score"], 9)) for r in tx.score(frame(spark, data, 3), label_frame(spark, lab)).collect())
    assert run(labels) == run(flipped)


def test_without_usable_labels(spark):
    docs = frame(spark, rows())
    assert {r["score"] for r in tx.score(docs, label_frame(spark, [])).collect()} == {0.0}
    ones = label_frame(spark, [(i, 1, 0) for i in range(40)])
    assert {r["score"] for r in tx.score(docs, ones).collect()} == {1.0}
    assert tx.score(spark.createDataFrame([], SCHEMA), ones).collect() == []


def test_features():
    def of(t):
        n = len(t.split())
        return dict(zip(tx.FEATURES, tx.text_features(t.encode(), n, 1, 1, 0, 0, 0)))
    assert of("you idiot")["near_second"] == 1 and of("you" + " x" * 60 + " idiot")["near_second"] == 0
    assert of("id1ot m0ron")["obfuscated_count"] == 2 and of("i.d.i.o.t now")["obfuscated_count"] == 1
    assert of("idiotical cloning")["lexicon_count"] == 0 and of("IDIOT")["shouted_share"] == 1


def test_lexicon_is_learnt_in_any_language(spark):
    """Toxic texts without any English insult: a stem with many endings, in ASCII and not, never twice the same word."""
    rng = random.Random(8)
    extra, data, labels = rows()[0][5:], [], []
    for i in range(1200):
        ws, toxic = prose(rng, rng.randrange(20, 150)).split(" "), rng.random() < 0.2
        if toxic:
            for k in range(rng.randrange(2, 6)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["zorglu", "Réêtu", "ЖАБОМ"]) + "".join(rng.choice("abcdefgh") for _ in range(5)))
        data.append((i, " ".join(ws), [None, "fr", "de"][i % 3], "s", 1) + extra)
        labels.append((i, int(toxic), 0))
    truth = {a: b for a, b, _ in labels}
    out = [r for r in tx.score(frame(spark, data), label_frame(spark, labels)).collect() if r["held_out"]]
    toxic = [r for r in out if truth[r["id"]]]
    assert len(toxic) > 30 and all(r["lexicon_count"] == 0 for r in toxic)
    assert sum(r["score"] >= tx.CUT_OFF for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["score"] >= tx.CUT_OFF for r in out if not truth[r["id"]]) <= 0.05 * len(out)


def test_terms_are_counted_by_fold_and_label(spark):
    texts = [("Zorgla zorgle!", 0, 1.0), ("zorgli abc", 1, 1.0), ("zorglo", 2, 1.0), ("x zorglu", 3, 1.0), *[("abc def ghi", f % 5, 0.0) for f in range(20)]]
    lexicons = tx.learn_lexicon(spark.createDataFrame(texts, "text string, fold int, label double").repartition(3))
    assert len(lexicons) == tx.FOLDS + 1
    stem = tx._hashes_of(("zorgl",)).view("int64")[0]
    odds = dict(zip(*lexicons[-1]))
    n1, all1, all0 = 5, 7, 60
    want = math.log((n1 + 0.5) / (all1 + 0.5 - n1)) - math.log(0.5 / (all0 + 0.5))
    assert abs(odds[stem] - want) < 1e-9
    assert stem in lexicons[0][0] and tx._hashes_of(("abc",)).view("int64")[0] not in odds
    assert tx.learnt_features(pa.array(["ZORGLXYZ you", None, "", "abc"]), lexicons[-1])[:, [1, 4]].tolist() == [[1, 1], [0, 0], [0, 0], [0, 0]]
