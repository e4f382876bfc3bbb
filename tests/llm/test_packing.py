import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from riskflow.llm import packing
from riskflow.llm.packing import CAPACITY
from tests.llm.helpers import SCHEMA, frame, rows


def tokens(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(out, data, padding):
    want = {}
    for r, ids in zip(data, tokens([r[1] for r in data])):
        want.setdefault(r[0], []).append(ids)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        if len(want[d]) > 1:                                        # repeated ids: only the number of tokens is told apart
            assert sum(p["length"] for p in pieces) == sum(map(len, want[d]))
            continue
        ids, at = np.array(want[d][0], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= CAPACITY
    used = sum(r["length"] for r in out)
    assert len(by_seq) * CAPACITY - used <= max(CAPACITY, padding * used)


def test_every_token_lies_in_one_piece(spark):
    data = rows()
    check(packing.pack(frame(spark)).collect(), data, 0.05)


def test_many_documents_pack_tightly(spark):
    data = rows(seed=3, n=400)
    out = packing.pack(frame(spark, data, parts=9)).collect()
    check(out, data, 0.03)


def test_pieces_of_any_length():
    for n in [*range(1, 9000), 123_457]:
        p = packing.pieces_of(n)
        assert sum(p) == n and all(0 < x <= CAPACITY for x in p)
        assert len(p) <= n // CAPACITY + 5


def test_words_equal_whole_texts():
    texts = ["It's  \t odd spaces here don't 12a é́ <|endoftext|> x", "漢字 🙂 ÄÖ\x1cß\x85z", "", " ", "plain It's don't they'll x's 'S ÉÀ¼²ª1a2b.,;!?--#\x0b\x0ctabs¿Qué?’s",
             "a'sb 'll'd ''s won't've «x» 10,000.50 <b>|c| <|d µ×÷ ", "x" * 5000 + " " + "é!" * 300]
    got, ends = packing.WordIds(None).encode([t.encode() for t in texts])
    for t, ids, a, b in zip(texts, tokens(texts), ends, ends[1:]):
        assert got[a:b].tolist() == ids


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_new_pieces_of_all_texts_are_tokenised_together(monkeypatch):
    calls = []
    learn = packing.WordIds._learn_pieces
    monkeypatch.setattr(packing.WordIds, "_learn_pieces", lambda self, new: (calls.append(len(new)), learn(self, new)))
    ids, texts = packing.WordIds(None), [b"one two three", b"", b"two four", "café 日本 two".encode()]
    got, ends = ids.encode(texts)
    assert calls == [4]
    for i, raw in enumerate(texts):
        want = ids.tokenizer.encode(raw.decode(), add_special_tokens=False).ids + [packing.END_ID]
        assert got[ends[i]:ends[i + 1]].tolist() == want
