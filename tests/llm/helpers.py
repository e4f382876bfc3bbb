"""Small tables with every awkward case, and the brute-force pieces shared by the tests."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use inside
                       T.StructField("id", T.StringType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()),
                       T.StructField("node", T.StringType()), T.StructField("target", T.StringType()), T.StructField("start", T.StringType())])


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.6 else rng.choice(["the", "of", "and", "to", "in"]) for _ in range(n)]
    out, i = [], 0
    while i < len(words):
        k = rng.randrange(4, 12)
        out.append(" ".join(words[i:i + k]).capitalize() + rng.choice([". ", ".\n", "! "]))
        i += k
    return "".join(out)


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(30, 260)) for _ in range(n)]
    passage = prose(rng, 90, 5000)
    texts[3] = texts[2]                                              # exact copies
    texts[4] = texts[2]
    near = texts[5].split(" ")
    near[7] = "changed"
    texts[6] = " ".join(near)                                        # near copy
    for i in (8, 11, 15, 21):
        texts[i] = texts[i][:150] + passage + texts[i][150:]         # shared passage
    texts[17] = "no no no " * 200                                    # repeats itself
    texts[18] = prose(rng, 4000)                                     # long
    texts += [None, "", " \t\n ", "one", "äöü ß 漢字 🙂", "two words"]
    out = [(i, t, ["en", "de", None][i % 3], [None, "s0", "s0", "s1", "s2"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[9], out[9], (None, texts[10], "en", "s0", 5), (None, None, None, None, None)]
    return [r + ("x", "y", "z", "n", "t", "s") for r in out]


def frame(spark, data=None, parts: int = 5):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)


def words(t: str | None) -> list[str]:
    return WORD.findall(t or "")
