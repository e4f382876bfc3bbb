"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

quality rules: rejected documents go -> n-gram Jaccard join: one document of each group stays -> secret scan: found spans
are masked -> mixing to target weights: documents are taken several times, once or not at all -> packing: token pieces of
the mixed documents in sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession

from riskflow.llm import jaccard_join, mixing, packing, quality, secrets
from riskflow.llm.common import cut, drop_cut, prepare
from riskflow.session import drop_scratch, scratch_written


_BEHIND: list[str] = []             # intermediate tables of the stage before, needed until its output is written


def stage(work):
    """A stage's function: what the stage before it left behind goes first, since `docs` is that stage's written output (tables
    that `docs` itself still reads stay)."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        read = {os.path.dirname(name) for name in docs.inputFiles()} if _BEHIND else set()
        drop_scratch(spark, [path for path in _BEHIND if not any(folder.endswith(path.split(":", 1)[-1].lstrip("/")) for folder in read)])
        before = set(scratch_written())
        out = work(spark, docs, sf_dir)
        _BEHIND[:] = [path for path in scratch_written() if path not in before]
        return out
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan),
          ("mixing sources to target weights", source_mix), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES[:-1]:
        done = cut(work(spark, docs, sf_dir))
        drop_cut(docs)                # a stage's input goes once its output is written (the given table is left alone)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # hashes, tokens and sequences cannot be expressed in SQL; the tests compare with brute force
