"""Session plumbing: the package reaches the Python workers; guarded time probes equal plain parses."""

import zipfile



def test_package_is_shipped_once(spark):
    from riskflow.session import ship_package
    first = ship_package(spark)
    assert ship_package(spark) == first
    if first != "submitted":
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(first)
        assert path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        local = first[len("file:"):] if first.startswith("file:") else first
        names = zipfile.ZipFile(local).namelist()
        assert "riskflow/operators/iforest.py" in names and "riskflow/session.py" in names
