"""Sources (S1-S5) and the scored-record sink.

CSV and JSON Lines are splittable and read in parallel. A JSON array or a GeoJSON FeatureCollection is one
document per file (Spark's `multiLine`), so each file is one task; for large inputs use many files or the
line forms (`.jsonl`, GeoJSON text sequences `.geojsonl` / `.geojsons`, one Feature per line), which split.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskflow.operators.prep import coerce_types
from riskflow.operators.profile import nan_to_null
from riskflow.params import NA_TOKENS

_HEAD_BYTES = 1 << 20
STREAMED_ABOVE, STREAMS = 64 << 20, 4
# The words that a CSV reader takes as truth values.
TRUE_WORDS, FALSE_WORDS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
SUPPORTED = (".csv", ".json", ".jsonl", ".geojson", ".geojsonl", ".geojsons", ".parquet")


def open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line of the file has an odd number of quotes, as every field with a line break in it leaves behind (one pass)."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def with_booleans(df: DataFrame) -> DataFrame:
    """Text columns without a missing value in which every value is a truth word become boolean (one pass)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    words = [*TRUE_WORDS, *FALSE_WORDS]
    aggs = [F.count_if(F.col(f"`{c}`").isNull() | ~F.col(f"`{c}`").isin(words)).alias(f"o{i}") for i, c in enumerate(texts)]
    r = df.agg(F.count("*").alias("n"), *aggs).first()
    return df.withColumns({c: F.col(f"`{c}`").isin(list(TRUE_WORDS)) for i, c in enumerate(texts) if r["n"] and r[f"o{i}"] == 0})


def read_csv(spark: SparkSession, path: str, coerce: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Header, every column read as text; the NA tokens become NULL, then numeric columns are typed
    (bigint when every value is an integer, else double) by the coercion pass, and truth words without gaps as boolean.

    Quotes inside a quoted field are doubled. Files are split and read in parallel; line breaks in quoted fields cost one task
    a file, so that form (`multi_line`) is taken only for files that have them: found by a first pass, or told."""
    if multi_line is None:
        multi_line = open_quotes(spark, path)
    reader = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
    df = reader.option("multiLine", multi_line).csv(path)
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) != len(lowered):
        raise ValueError("column names that differ only in case are not supported")
    tokens = list(NA_TOKENS)
    df = df.select(*[F.when(F.col(f"`{c}`").isin(tokens) | F.col(f"`{c}`").isNull(), F.lit(None))
                      .otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return with_booleans(coerce_types(df)) if coerce else df


def first_record_names(spark: SparkSession, path: str) -> list[str]:
    """Member names of the first record in file order (schema inference sorts them). The head of one file is read, twice as
    much again until the record is whole (a record is one row, so it fits in memory)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(str(f.getPath()) for f in (fs.globStatus(target) or []) if f.isFile())
    if not files and fs.exists(target):
        files = sorted(str(f.getPath()) for f in fs.listStatus(target) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    for name in files:
        most = _HEAD_BYTES
        while True:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                raw = bytes(stream.readNBytes(most))
            finally:
                stream.close()
            head = raw.decode("utf-8", "replace")
            start = head.find("{")
            try:
                if start >= 0:
                    return list(json.JSONDecoder().raw_decode(head, start)[0])
            except ValueError:
                pass
            if len(raw) < most:                      # the whole file has been seen
                break
            most *= 2
    return []


def date_like(name: str) -> bool:
    """Names whose columns hold times by convention: `..._at`, `..._time`, `timestamp...`, `modified`, `date`."""
    low = name.lower()
    return low.endswith(("_at", "_time")) or low.startswith("timestamp") or low in ("modified", "date")


def json_conversions(df: DataFrame) -> DataFrame:
    """Text columns that hold only numbers become numbers; date-like columns become timestamps if every value is a time
    text, or a number of seconds or milliseconds since 1970 (milliseconds from 10^11 on)."""
    texts = {f.name: f.dataType for f in df.schema.fields}
    named = [c for c, t in texts.items() if date_like(c) and isinstance(t, (T.StringType, T.NumericType))]
    times = {}
    for c in named:
        x = F.col(f"`{c}`")
        if isinstance(texts[c], T.StringType):
            times[c] = F.try_to_timestamp(x)
        else:
            n = x.cast("double")
            times[c] = F.timestamp_millis(F.when(F.abs(n) < 1e11, n * 1000).otherwise(n).cast("long"))
    if times:
        bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & t.isNull()).alias(f"b{i}") for i, (c, t) in enumerate(times.items())]).first()
        df = df.withColumns({c: t for i, (c, t) in enumerate(times.items()) if bad[f"b{i}"] == 0})
    return coerce_types(df)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """An array of records (one document per file) or JSON Lines (splittable), columns in file order."""
    if lines is None:
        lines = path.lower().endswith(".jsonl")
    reader = spark.read if lines else spark.read.option("multiLine", True)
    df = nan_to_null(reader.json(path))
    first = [c for c in first_record_names(spark, path) if c in df.columns]
    df = df.select(*[F.col(f"`{c}`") for c in [*first, *(c for c in df.columns if c not in first)]])
    return json_conversions(df)


def read_geojson(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """S3: one row per Feature, `properties` as columns; a Point adds longitude = coordinates[0] and
    latitude = coordinates[1]; other geometry types (and NULL geometry) keep the properties only."""
    if lines is None:
        lines = path.lower().endswith((".geojsonl", ".geojsons"))
    reader = spark.read if lines else spark.read.option("multiLine", True)
    inferred = reader.json(path).schema
    # read `coordinates` as raw JSON text whatever the geometry type (types differ per geometry)
    geom = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])

    def with_geom(st: T.StructType) -> T.StructType:
        fields = []
        for f in st.fields:
            fields.append(T.StructField("geometry", geom) if f.name == "geometry" else f)
        if "geometry" not in st.fieldNames():
            fields.append(T.StructField("geometry", geom))
        return T.StructType(fields)

    if lines:
        df = reader.schema(with_geom(inferred)).json(path)
        feats = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("f"))
    else:
        feat_type = inferred["features"].dataType.elementType
        schema = T.StructType([T.StructField("type", T.StringType()),
                               T.StructField("features", T.ArrayType(with_geom(feat_type)))])
        df = reader.schema(schema).json(path)
        feats = df.select(F.explode("features").alias("f"))
    props_type = None
    for f in (feats.schema["f"].dataType.fields):
        if f.name == "properties":
            props_type = f.dataType
    if isinstance(props_type, T.StructType):
        prop_cols = [F.col(f"f.properties.`{n}`").alias(n) for n in props_type.fieldNames()]
    coords = F.from_json(F.col("f.geometry.coordinates"), "array<double>")
    is_point = F.col("f.geometry.type") == "Point"
    names = props_type.fieldNames() if isinstance(props_type, T.StructType) else []
    places = {}
    for axis, i in (("longitude", 0), ("latitude", 1)):
        # a property of that name gives way to a Point's coordinate and stays for other geometries
        own = F.col(f"f.properties.`{axis}`").cast("double") if axis in names else F.lit(None).cast("double")
        places[axis] = F.when(is_point, coords.getItem(i)).otherwise(own).alias(axis)
    columns = [places.pop(n) if n in places else F.col(f"f.properties.`{n}`").alias(n) for n in names]
    return nan_to_null(feats.select(*columns, *places.values()))


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Dispatch on the lower-cased suffix (or `fmt`); unknown -> ValueError listing the supported ones."""
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1]).lower()
    if not kind.startswith("."):
        kind = "." + kind
    if kind == ".csv":
        return read_csv(spark, path)
    if kind in (".json", ".jsonl"):
        return read_json(spark, path, lines=kind == ".jsonl")
    if kind in (".geojson", ".geojsonl", ".geojsons"):
        return read_geojson(spark, path, lines=kind != ".geojson")
    if kind == ".parquet":
        return nan_to_null(spark.read.parquet(path))
    raise ValueError(f"no reader for {kind!r}; known suffixes are {', '.join(SUPPORTED)}")


def fingerprint(spark: SparkSession, path: str, streamed_above: int = STREAMED_ABOVE) -> DataFrame:
    """(path, sha256 of the file bytes) per file.

    Files up to `streamed_above` bytes are digested by the tasks that read them. A digest is one pass over a file in order, and
    a longer file does not fit a row, so those run through the file system's own stream in constant memory, a few at a time."""
    listed = spark.read.format("binaryFile").load(path)
    small = listed.where(F.col("length") <= streamed_above).select("path", F.sha2(F.col("content"), 256).alias("sha256"))
    # names only: the content is not read for them
    large = [r["path"] for r in listed.where(F.col("length") > streamed_above).select("path").collect()]
    if not large:
        return small
    with ThreadPoolExecutor(STREAMS) as pool:
        digests = list(pool.map(lambda name: (name, streamed_digest(spark, name)), large))
    return small.unionByName(spark.createDataFrame(digests, "path string, sha256 string"))


def streamed_digest(spark: SparkSession, name: str) -> str:
    """sha256 of a file of any length, read in pieces by the file system's stream."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(name)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Scored rows written in parallel (one file per partition)."""
    w = df.write.mode(mode)
    if fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown sink format {fmt!r}")


def preview_records(df: DataFrame, n: int = 500, order_by: list[str] | None = None) -> DataFrame:
    """The first n scored records by key (the original's response cap)."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order_by or df.columns[:1]]).limit(n)
