"""Quality rules: divergence of a document's character and common-word histograms from its language's reference.

Native: DataFrame functions only. One pass turns every text into counts (words, symbols, repeated lines and word
windows, six character classes, the common words); these narrow rows are materialised. The reference of a language is
the sum of the counts of its documents that pass the base rules and are long enough, over the whole table, one
aggregation with map-side combine. A document is rejected if the Jensen-Shannon distance (base 2) of its character
classes is above a threshold, or, from `MIN_WORDS` words on, that of its common words: short texts have too few words
for the second histogram, and below 50 words the base rules decide alone.

Defined results: null text counts as empty; a null language is a language of its own; a language without any long enough
document has no reference and its documents keep the verdict of the base rules; repeated rows get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskflow.llm.common import SPACE_CLASS, WORD_CLASS, cut, table

# Frequent function words of the four languages (English, German, French, Spanish), in natural order.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "ist", "auf",
    "le", "la", "les", "de", "des", "et", "du", "un", "en", "que", "qui", "pour", "est",
    "el", "los", "del", "las", "por", "con", "una", "y", "se", "como")
# Character classes counted in the words joined without space; what is in none of them is lower-case ASCII.
CHAR_CLASSES = ("[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", "[#*$%&|<>]", r"[^\x00-\x7F]")
MIN_WORDS, LEAST_WORDS = 100, 50
MOST_REPEAT_PERCENT = 50
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.25


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row (a lambda variable), also where body names it often."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, the first occurrence included.

    Windows are hashed; sorting (hash, position) brings equal windows together; the positions of repeated windows,
    sorted, cover min(3, gap) words each."""
    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def positions(pairs: Column) -> Column:
        def twin(p: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
            return same(i - 1) | same(i + 1)
        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    def from_windows(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(
            let(pairs, lambda s: let(positions(s), covered)))

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
                           lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), from_windows))).cast("long")


def counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """`keep` columns plus q_words, q_chars, q_symbols, q_dup_lines, q_repeat, q_classes, q_common (arrays of counts)."""
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    bare = F.btrim("q_text", F.lit(" \t\n\x0b\x0c\r"))
    split = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD_CLASS))
    base = base.withColumns({"q_split": split, "q_lines": lines})
    refs = F.array(*[F.lit(w) for w in COMMON_WORDS])
    spelled = [f(w) for w in COMMON_WORDS for f in (str, str.capitalize, str.upper)]
    base = base.withColumn("q_joined", F.concat_ws("", "q_split"))
    base = base.withColumn("q_other", F.regexp_replace("q_joined", "[a-z]+", ""))
    codes = F.transform(F.filter("q_split", lambda w: w.isin(spelled)), lambda w: F.array_position(refs, F.lower(w)))
    classes = [F.regexp_count("q_other", F.lit(c)) for c in CHAR_CLASSES]
    return base.select(
        *keep, F.size("q_split").cast("long").alias("q_words"), F.char_length("q_joined").cast("long").alias("q_chars"),
        classes[3].cast("long").alias("q_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_dup_lines"),
        repeated_words(F.col("q_split")).alias("q_repeat"),
        F.array(*classes).alias("q_classes"),
        let(codes, lambda c: F.transform(F.sequence(F.lit(1), F.lit(len(COMMON_WORDS))),
                                         lambda k: F.size(c) - F.size(F.array_remove(c, k.cast("long"))))).alias("q_common"))


def base_failed() -> Column:
    return (F.col("q_words") < LEAST_WORDS) | (100 * F.col("q_repeat") > MOST_REPEAT_PERCENT * F.col("q_words"))


def with_rest(parts: list[Column], whole: Column) -> Column:
    """Shares of the counts and of what is left of the whole, as one array."""
    rest = whole
    for p in parts:
        rest = rest - p
    return F.transform(F.array(*parts, rest), lambda x: x / whole)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of shares."""
    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def references(counted: DataFrame, lang: str) -> DataFrame:
    """Summed counts of each language's documents that pass the base rules and have MIN_WORDS words: a row a language."""
    good = counted.where(~base_failed() & (F.col("q_words") >= MIN_WORDS))
    sums = [F.sum(F.col("q_classes")[i]).alias(f"c{i}") for i in range(len(CHAR_CLASSES))]
    sums += [F.sum(F.col("q_common")[i]).alias(f"w{i}") for i in range(len(COMMON_WORDS))]
    per = good.groupBy(lang).agg(F.sum("q_chars").alias("chars"), F.sum("q_words").alias("words"), *sums)
    return per.select(
        F.col(lang).alias("ref_lang"),
        with_rest([F.col(f"c{i}") for i in range(len(CHAR_CLASSES))], F.col("chars")).alias("ref_chars"),
        with_rest([F.col(f"w{i}") for i in range(len(COMMON_WORDS))], F.col("words")).alias("ref_words"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of every row, the counts, char_distance, word_distance, base_failed and kept."""
    keep = keep if keep is not None else docs.columns
    names = {c: f"k_{i}" for i, c in enumerate(dict.fromkeys([*keep, lang_col]))}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(text_col).alias("q_in"))
    counted = cut(counts(inner, "q_in", list(names.values())))
    lang = names[lang_col]
    rows = counted.join(cut(references(counted, lang)), F.col(lang).eqNullSafe(F.col("ref_lang")), "left")
    chars = with_rest([F.col("q_classes")[i] for i in range(len(CHAR_CLASSES))], F.col("q_chars"))
    words = with_rest([F.col("q_common")[i] for i in range(len(COMMON_WORDS))], F.col("q_words"))
    rows = rows.withColumns({
        "base_failed": base_failed(),
        "char_distance": F.when(F.col("q_words") >= LEAST_WORDS, js_distance(chars, F.col("ref_chars"))),
        "word_distance": F.when(F.col("q_words") >= MIN_WORDS, js_distance(words, F.col("ref_words")))})
    far = (F.coalesce(F.col("char_distance") > MOST_CHAR_DISTANCE, F.lit(False))
           | F.coalesce(F.col("word_distance") > MOST_WORD_DISTANCE, F.lit(False)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~far)
    return rows.select(*[F.col(names[c]).alias(c) for c in keep], "q_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat",
                       "char_distance", "word_distance", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    return judge(docs, text_col, lang_col).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_chars").alias("word_chars"),
                      F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"),
                      F.col("q_repeat").alias("n_repeat_words"), "base_failed", "kept", "char_distance", "word_distance")
