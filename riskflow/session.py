"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, types as T


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "riskflow") -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster the builder only adds what is unset; `master` is left to spark-submit.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # short jobs of Python workers wait about 40 ms for TCP acknowledgements; these sockets do not
          .config("spark.python.unix.domain.socket.enabled", "true")
          .config("spark.driver.memory", os.environ.get("RISKFLOW_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Session settings every query needs (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> str | None:
    """Make `riskflow` importable in the Python workers (pandas UDFs reference its functions by module).

    Without this a worker only finds the package when it happens to start in the repository folder. The
    package is zipped in memory, written once into the shared checkpoint folder and added with
    `addPyFile`, the same mechanism as `--py-files`. Skipped when the job was submitted with the package.
    """
    sc = spark.sparkContext
    shipped = getattr(sc, "_riskflow_pyfile", None)
    if shipped:
        return shipped
    if "riskflow" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        sc._riskflow_pyfile = "submitted"
        return sc._riskflow_pyfile
    import hashlib
    import io
    import zipfile
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    info = zipfile.ZipInfo(os.path.relpath(full, os.path.dirname(root)), (1980, 1, 1, 0, 0, 0))
                    with open(full, "rb") as fh:
                        z.writestr(info, fh.read())
    data = buf.getvalue()
    base = ensure_checkpoint_dir(spark).rstrip("/")
    target = f"{base}/pyfiles/riskflow-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    sc.addPyFile(target)
    sc._riskflow_pyfile = target
    return target


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the cluster's `spark.checkpoint.dir`.

    A local run without the setting gets a fresh folder under the system temp dir. On a cluster executors could not read
    each other's files there, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskflow-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables, inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{os.getpid()}-{next(_counter)}"
    _WRITTEN.append(path)
    return path


def scratch_written() -> list[str]:
    """The paths of the intermediate tables this process has written and not dropped, in order."""
    return list(_WRITTEN)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete these intermediate tables; nothing built on them may be used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _WRITTEN:
            _WRITTEN.remove(name)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote (through the Hadoop FileSystem of the path, so it
    works on any shared store). Only call it when no DataFrame built on them is used any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            fs.delete(path, True)
            n += 1
    return n


def _fits_parquet(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return bool(dtype.fields) and all(_fits_parquet(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _fits_parquet(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _fits_parquet(dtype.keyType) and _fits_parquet(dtype.valueType)
    return not isinstance(dtype, (T.NullType, T.CalendarIntervalType, T.VariantType))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` once as a Parquet table in the shared checkpoint folder and read it back.

    Reliable (survives executor loss, unlike localCheckpoint), computed once (`Dataset.checkpoint` runs the
    plan twice unless it is persisted first), and later scans prune columns and push filters. Only a schema Parquet
    cannot hold, known before anything runs, takes a reliable `checkpoint()` of the persisted frame instead; errors of
    the job itself are raised.
    """
    spark = df.sparkSession
    if all(_fits_parquet(f.dataType) for f in df.schema.fields):
        path = scratch_path(spark, "cut")
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    ensure_checkpoint_dir(spark)
    kept = df.persist()
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()
