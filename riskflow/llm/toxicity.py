"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text (task function over Arrow batches, no row needs another): density and count of lexicon words,
their share near a second-person word, capitals, punctuation marks, and how many lexicon words only appear after undoing
look-alike letters and spelled-out separators. These hang on a fixed list of English insults; a second lexicon is learnt
from the labelled rows in any language: words and word prefixes (3 to 8 bytes, lower case) whose log odds of toxic against
clean texts are high and certain, counted by Spark. Its density, count and proximity are features too. A row that teaches
the trees gets the lexicon of the other folds, every scored text the one of all folds. Nothing else enters a score: no
label, language, source or id.

Words of the learnt lexicon are runs of letters (a-z and all non-ASCII bytes, so typographic marks and unspaced scripts
count as letters); terms are 64-bit hashes.

Trees (Spark ML) learn from labelled documents outside the held-out quarter (crc32 of the id, modulo 4, is 2); of the
remaining classes two train the trees and one fits the isotonic curve that turns raw scores into probabilities. Both use
at most `MOST_LABELLED` rows, those with the smallest id hash; every document is scored.

Defined results: null text is empty and scored like any other; a null id counts as the empty string for the split; null
labels are not used, of several label rows of a document each counts; if the training rows lack one of the two classes,
every score is the mean label (0 without labels); repeated documents get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F, types as T

from riskflow.llm.common import cut, flat, signed, table, word_hashes, word_spans

# Fixed lexicon of insults, in natural order (English forms; two-language homographs are left out).
LEXICON = ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "dumb", "dumbass", "imbecile", "fool",
           "fools", "foolish", "loser", "losers", "scum", "scumbag", "trash", "garbage", "pathetic", "worthless", "disgusting",
           "clown", "clowns", "jerk", "creep", "freak", "filth", "filthy", "vermin", "ugly", "coward", "pig", "bastard", "bitch",
           "asshole", "bullshit", "retard", "retarded", "hate", "shut up")
SECOND_PERSON = ("you", "your", "yours", "yourself", "youre", "ur")
NEAR = 40                            # bytes between a second-person word and a lexicon word
TEXT_FEATURES = ("lexicon_per_100", "lexicon_count", "lexicon_distinct", "near_second", "second_per_100", "capital_share", "shouted_share",
            "mark_share", "exclaim_share", "obfuscated_count", "obfuscated_per_100", "symbol_share", "log_words")
LEARNT_FEATURES = ("learnt_per_100", "learnt_count", "learnt_weight_per_100", "learnt_near", "learnt_near_second")
FEATURES = TEXT_FEATURES + LEARNT_FEATURES
HELD_OUT, CURVE = 2, 0               # classes of crc32(id) modulo 4: never learnt from; fit the isotonic curve
MOST_LABELLED = 20_000
TREES, DEPTH, STEP, SEED = 20, 3, 0.3, 7
CUT_OFF = 0.3
# The learnt lexicon: folds, prefix lengths, toxic texts a term is in at least, its log odds and their certainty (odds over
# standard error) at least, terms at most (the most certain ones).
FOLDS, PREFIXES, LEAST_TEXTS, LEAST_ODDS, LEAST_CERTAIN, MOST_TERMS = 5, range(3, 9), 3, 1.0, 3.0, 20_000

_word = "|".join(sorted(LEXICON, key=len, reverse=True)).encode()
_LEX = re.compile(rb"(?<![a-z])(?:" + _word + rb")(?![a-z])")
_YOU = re.compile(rb"(?<![a-z])(?:" + "|".join(SECOND_PERSON).encode() + rb")(?![a-z])")
_SPELLED = re.compile(rb"(?<![a-z])[a-z](?:[.\-*_ ][a-z]){3,}(?![a-z])")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Fixed look-alikes of letters.
_ALIKE = bytes.maketrans(bytes(range(65, 91)) + b"013457@$!", bytes(range(97, 123)) + b"oieastasi")
_LOOKS = re.compile(rb"[a-zA-Z][013457@$!]|[013457@$!][a-zA-Z]")


def text_features(raw: bytes, n_words: int, upper: int, lower: int, marks: int, exclaims: int, symbols: int) -> list[float]:
    low = raw.translate(_LOWER)
    hits = list(_LEX.finditer(low))
    you = [m.start() for m in _YOU.finditer(low)] if b"you" in low or b"ur" in low else []
    near = 0
    if hits and you:
        at = np.array(you)
        for m in hits:
            k = int(np.searchsorted(at, m.start()))
            near += any(abs(int(at[x]) - m.start()) <= NEAR for x in (k - 1, k) if 0 <= x < len(at))
    hidden = 0
    if _LOOKS.search(raw):
        hidden += max(0, len(_LEX.findall(raw.translate(_ALIKE))) - len(hits))
    for m in _SPELLED.finditer(low):
        hidden += bool(_LEX.search(re.sub(rb"[^a-z]", b"", m[0])))
    per = 100.0 / max(n_words, 1)
    n = max(len(raw), 1)
    shouted = sum(1 for m in hits if raw[m.start():m.end()].isupper())
    return [len(hits) * per, float(len(hits)), float(len({m[0] for m in hits})), float(near), len(you) * per, upper / max(upper + lower, 1),
            shouted / max(len(hits), 1), marks / n, exclaims / n, float(hidden), hidden * per, symbols / n, float(np.log1p(n_words))]


def _table_of(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars.encode())] = 1
    return t


_UPPER = _table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SMALL = _table_of("abcdefghijklmnopqrstuvwxyz")
_MARKS, _EXCLAIM, _SYMBOL = _table_of(".,;:!?'\"()-"), _table_of("!?"), _table_of("#*$%&|<>@_~^")


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_WHOLE = np.uint64(0x9E3779B97F4A7C15)


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes without all but letters, starts, ends, first) of a text column."""
    data, offs = flat(pc.utf8_lower(col))
    data = np.where(_LETTER[data], data, np.uint8(32))
    return data, *word_spans(data, offs)


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of words, term hash of each): the whole word, then its prefixes."""
    yield np.arange(len(starts)), signed(word_hashes(data, starts, ends, False) ^ _WHOLE)
    for k in PREFIXES:
        at = np.flatnonzero(ends - starts >= k)
        yield at, signed(word_hashes(data, starts[at], starts[at] + k, False))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, label, term, occurrences, texts), counted within a batch; term null holds all words of the batch."""
    for batch in batches:
        data, starts, ends, first = _words(batch.column(0))
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        fold, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        group = (fold * 2 + (label > 0)).astype(np.int64)
        for at, term in _terms(data, starts, ends):
            order = np.lexsort((doc[at], term, group[doc[at]]))
            t, d = term[order], doc[at][order]
            g = group[d]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
            text = new.copy()
            text[1:] |= d[1:] != d[:-1]
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(t)))
            texts = np.add.reduceat(text.astype(np.int64), heads) if len(heads) else n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[heads] // 2, g[heads] % 2, t[heads], n, texts)],
                                             names=["fold", "toxic", "term", "n", "texts"])
        n = np.bincount(group[doc], minlength=2 * FOLDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * FOLDS) // 2), pa.array(np.arange(2 * FOLDS) % 2),
                                          pa.nulls(2 * FOLDS, pa.int64()), pa.array(n), pa.array(np.zeros(2 * FOLDS, np.int64))],
                                         names=["fold", "toxic", "term", "n", "texts"])


def learn_lexicon(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted term hashes, log odds) from text, fold, label: without fold 0, ..., without the last fold, and from all rows."""
    counted = rows.select("text", F.col("fold").cast("long"), F.col("label").cast("double")) \
                  .mapInArrow(_count_terms, "fold long, toxic long, term long, n long, texts long")
    # one row a term: its counts in every fold, by label
    sums = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col(c)).otherwise(0)).alias(f"{c}{y}_{f}")
            for c, y in (("n", 0), ("n", 1), ("texts", 1)) for f in range(FOLDS)]
    counts = cut(counted.groupBy("term").agg(*sums).where(
        F.col("term").isNull() | (sum(F.col(f"texts1_{f}") for f in range(FOLDS)) >= LEAST_TEXTS)))
    total = counts.where(F.col("term").isNull()).first()
    out = []
    for left in range(FOLDS + 1):
        kept = [f for f in range(FOLDS) if f != left]
        a, b, texts = (sum(F.col(f"{c}_{f}") for f in kept) for c in ("n1", "n0", "texts1"))
        all_a, all_b = (float(sum(total[f"{c}_{f}"] for f in kept)) if total else 0.0 for c in ("n1", "n0"))
        odds = F.log((a + 0.5) / (F.lit(all_a + 0.5) - a)) - F.log((b + 0.5) / (F.lit(all_b + 0.5) - b))
        found = counts.where(F.col("term").isNotNull() & (texts >= LEAST_TEXTS)).select("term", odds.alias("odds"), F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)).alias("error")) \
                      .where((F.col("odds") >= LEAST_ODDS) & (F.col("odds") >= LEAST_CERTAIN * F.col("error"))) \
                      .orderBy((F.col("odds") / F.col("error")).desc(), "term").limit(MOST_TERMS).collect()
        term, odds = np.array([r["term"] for r in found], np.int64), np.array([r["odds"] for r in found], np.float64)
        order = np.argsort(term)
        out.append((term[order], odds[order]))
    return out


def learnt_features(col: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """LEARNT_FEATURES of each text: a word is a hit if it or a prefix is a term, its weight the largest log odds of these."""
    data, starts, ends, first = _words(col)
    known, odds = lexicon
    weight = np.zeros(len(starts))
    if len(known):
        for at, term in _terms(data, starts, ends):
            i = np.minimum(np.searchsorted(known, term), len(known) - 1)
            hit = known[i] == term
            weight[at[hit]] = np.maximum(weight[at[hit]], odds[i[hit]])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hits = np.flatnonzero(weight)
    n_docs, n_words = len(first) - 1, np.maximum(np.diff(first), 1)
    count = np.bincount(doc[hits], minlength=n_docs).astype(np.float64)
    near, second = np.zeros(len(hits), bool), np.zeros(len(hits), bool)
    close = (starts[hits[1:]] - ends[hits[:-1]] <= NEAR) & (doc[hits[1:]] == doc[hits[:-1]])
    near[1:] |= close
    near[:-1] |= close
    you = np.flatnonzero(np.isin(word_hashes(data, starts, ends, False), _YOU_HASHES))
    if len(you):
        for step in (0, 1):
            i = np.searchsorted(you, hits) - step
            w = you[np.clip(i, 0, len(you) - 1)]
            second |= (i >= 0) & (i < len(you)) & (doc[w] == doc[hits]) & (np.abs(starts[w] - starts[hits]) <= NEAR)
    def per_text(x):
        return np.bincount(doc[hits], weights=x, minlength=n_docs)
    return np.column_stack([count * 100 / n_words, count, per_text(weight[hits]) * 100 / n_words, per_text(near), per_text(second)])


def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    data, offs = flat(pa.array(words))
    return word_hashes(data, offs[:-1], offs[1:], False)


_YOU_HASHES = _hashes_of(SECOND_PERSON)


def _features(batches: Iterator[pa.RecordBatch], lexicons: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """text, number of its lexicon, other columns -> other columns, features."""
    for batch in batches:
        data, offs = flat(batch.column(0))
        rows = []
        for d in range(len(offs) - 1):
            part = data[offs[d]:offs[d + 1]]
            seen = np.bincount(part, minlength=256) if len(part) else np.zeros(256, np.int64)
            n_words = len(word_spans(part, np.array([0, len(part)]))[0])
            rows.append(text_features(part.tobytes(), n_words, *(int(seen @ t) for t in (_UPPER, _SMALL, _MARKS, _EXCLAIM, _SYMBOL))))
        learnt = np.zeros((len(rows), len(LEARNT_FEATURES)))
        which = batch.column(1).to_numpy(zero_copy_only=False)
        for k in np.unique(which):
            at = np.flatnonzero(which == k)
            learnt[at] = learnt_features(batch.column(0).take(pa.array(at)), lexicons[k])
        cols = np.hstack([np.array(rows, np.float64).reshape(len(rows), len(TEXT_FEATURES)), learnt])
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(np.ascontiguousarray(cols[:, i])) for i in range(len(FEATURES)))],
                                         names=[*batch.schema.names[2:], *FEATURES])


def features(docs: DataFrame, lexicons: list[tuple[np.ndarray, np.ndarray]], text_col: str = "text",
             which: str | None = None) -> DataFrame:
    """The other columns of `docs` and the features; `which` is a column with the number of a text's lexicon."""
    number = F.lit(0) if which is None else F.col(which)
    kept = docs.drop(text_col)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
    return docs.select(F.col(text_col).cast("string").alias("text"), number.cast("int").alias("which"), *(F.col(c) for c in kept.columns)) \
               .mapInArrow(lambda batches: _features(batches, lexicons), schema)


def split_class(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          label_id: str = "doc_id", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """id, held_out, the features, raw (margin) and score for every document."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(label_id).alias("id"), F.col(label_col).cast("double").alias("label"))
    part = split_class(F.col("id"))
    first = [F.xxhash64("id"), F.col("id")]
    ids = docs.select("id").join(known.where(part != HELD_OUT), "id").orderBy(*first).limit(most_labelled).select("id").distinct()
    rows = docs.join(F.broadcast(cut(ids)), "id").join(known, "id").withColumn("part", part)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)))
    rows = cut(rows.orderBy(*first).limit(most_labelled))
    lexicons = learn_lexicon(rows)
    feats = cut(features(docs, lexicons[-1:]))
    rows = cut(features(rows, lexicons, which="fold")).drop("fold").coalesce(2)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    every = assembler.transform(feats)
    stats = rows.groupBy(F.col("part") == CURVE).agg(F.countDistinct("label").alias("k"), F.avg("label").alias("mean")).collect()
    held = part == HELD_OUT
    if len(stats) < 2 or any(r["k"] < 2 for r in stats):
        mean = rows.agg(F.avg("label")).first()[0] or 0.0
        return every.withColumns({"held_out": held, "raw": F.lit(0.0), "score": F.lit(float(mean))}).drop("features")
    learn = assembler.transform(rows).cache()
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED,
                          minInstancesPerNode=10, maxBins=64).fit(learn.where(F.col("part") != CURVE))
    margin = F.element_at(vector_to_array("rawPrediction"), 2)
    curve_rows = trees.transform(learn.where(F.col("part") == CURVE)).select("label", margin.alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(curve_rows)
    learn.unpersist()
    scored = trees.transform(every).withColumn("raw", margin).drop("rawPrediction", "probability", "prediction")
    scored = curve.transform(scored).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return scored.withColumn("held_out", held).drop("features")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    # plateaus of the curve are split by the raw margin, far below the curve's own steps
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= CUT_OFF).cast("int").alias("predicted"), "raw")
