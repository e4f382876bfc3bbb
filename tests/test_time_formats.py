"""Format induction: what each family of texts derives to, what is rejected, and that the format parses the values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskflow.functions import time_formats as tf

CASES = {
    "yyyy-MM-dd": ["2024-01-05", "2024-12-31"],
    "yyyy-M-d": ["2024-1-5", "2024-12-31"],
    "yyyy-MM-dd HH:mm:ss": ["2024-01-05 10:00:00", "2024-03-09 23:59:59"],
    "yyyy-MM-dd HH:mm": ["2024-01-05 10:00"],
    "yyyy-MM-dd'T'HH:mm:ss": ["2024-01-05T10:00:00"],
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]": ["2024-01-05 10:00:00", "2024-01-05 10:00:00.5", "2024-01-05 10:00:00.123456"],
    "yyyy-MM-dd HH:mm:ss.SSS": ["2024-01-05 10:00:00.5", "2024-01-05 10:00:00.123"],
    "yyyy-MM-dd'T'HH:mm:ss'Z'": ["2024-01-05T10:00:00Z", "2024-01-06T10:00:00Z"],
    "yyyy-MM-dd HH:mm:ss+05:30": ["2024-01-05 10:00:00+05:30"],
    "yyyy-MM-dd HH:mm:ss 'UTC'": ["2024-01-05 10:00:00 UTC"],
    "yyyy/MM/dd HH:mm:ss": ["2024/01/05 10:00:00"],
    "MM/dd/yyyy": ["01/05/2024", "12/31/2024"],
    "dd/MM/yyyy": ["01/05/2024", "31/12/2024"],
    "dd.MM.yyyy": ["01.05.2024", "02.03.2024"],
    "MM.dd.yyyy": ["01.05.2024", "02.13.2024"],
    "M/d/yyyy h:mm:ss a": ["1/5/2024 1:02:03 PM", "12/15/2024 12:02:03 AM"],
    "dd-MM-yy": ["13-01-70", "31-12-24"],
    "dd-MMM-yy": ["05-Jan-99", "17-May-24"],
    "MMMM d, yyyy": ["January 5, 2024", "May 17, 2024"],
    "MMM dd yyyy": ["Jan 05 2024", "may 17 2024"],
    "yyyyMMdd": ["20240105"],
    "yyyyMMdd'T'HHmmss": ["20240105T101112"],
    "E, dd MMM yyyy HH:mm:ss 'GMT'": ["Fri, 05 Jan 2024 10:00:00 GMT", "Wed, 17 May 2023 10:00:00 GMT"],
    "yyyy-MMM-dd": ["2024-Feb-29"],
}
REJECTED = {
    "mixed": ["2024-01-05", "05.01.2024"], "names": ["Jan 5, 2024", "January 6, 2024"], "word": ["2024-01-05", "soon"], "empty": ["2024-01-05", ""],
    "zones": ["2024-01-05T10:00:00Z", "2024-01-05T10:00:00+02:00"], "no_date": ["2024-02-30"], "version": ["1.2.3"], "both_large": ["13/14/2024"],
    "both": ["13/01/2024", "01/14/2024"], "some_times": ["2024-01-05", "2024-01-05 10:00"], "clock": ["10:30"], "long": ["2024-01-05" + " " * 60],
    "category": ["view", "click"], "phone": ["555-12-3456"], "seconds": ["2024-01-05 10:00", "2024-01-05 10:00:01"],
}


def test_families_of_formats(spark):
    rows = max(map(len, CASES.values()))
    names = list(CASES)
    table = [tuple(CASES[f][i] if i < len(CASES[f]) else None for f in names) for i in range(rows)]
    df = spark.createDataFrame(table, ", ".join(f"c{i} string" for i in range(len(names))))
    got = tf.induce(df, df.columns)
    assert {f"c{i}": f for i, f in enumerate(names)} == got


def test_rejected_columns(spark):
    names = list(REJECTED)
    table = [tuple(REJECTED[n][i] if i < len(REJECTED[n]) else None for n in names) for i in range(2)]
    df = spark.createDataFrame([*table, (None,) * len(names)], ", ".join(f"{n} string" for n in names)).withColumn("none", F.lit(None).cast("string"))
    assert tf.induce(df, df.columns) == {}
    assert tf.induce(df.limit(0), df.columns) == {}


@pytest.mark.parametrize("text, fmt, want", [
    ("05-Jan-99", "dd-MMM-yy", dt.datetime(1999, 1, 5)), ("05-Jan-69", "dd-MMM-yy", dt.datetime(1969, 1, 5)),
    ("05-Jan-68", "dd-MMM-yy", dt.datetime(2068, 1, 5)), ("1/5/2024 12:02:03 AM", "M/d/yyyy h:mm:ss a", dt.datetime(2024, 1, 5, 0, 2, 3)),
    ("Fri, 05 Jan 2024 10:00:00 GMT", "E, dd MMM yyyy HH:mm:ss 'GMT'", dt.datetime(2024, 1, 5, 10)),
    ("2024-01-05 10:00:00+05:30", "yyyy-MM-dd HH:mm:ss+05:30", dt.datetime(2024, 1, 5, 10)), ("soon", "yyyy-MM-dd", None)])
def test_parsed_values(spark, text, fmt, want):
    got = spark.createDataFrame([(text,)], "s string").select(F.date_format(tf.parse(F.col("s"), fmt), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S"))
