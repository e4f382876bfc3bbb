"""Deterministic row hashing for splits and folds: stable under repartitioning, no sort, no rand()."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


SPAN = 1 << 52


def text_hash(*parts: Column) -> Column:
    """A 52-bit integer (exact as a double) from md5 of the parts joined by '#'; the same value in DuckDB:
    ('0x' || substr(md5(concat_ws('#', part...)), 1, 13))::BIGINT, and from `py_hash`."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def py_hash(*parts) -> int:
    return int(hashlib.md5("#".join(str(p) for p in parts).encode()).hexdigest()[:13], 16)


def row_hash(key_cols: list[str], seed: int, *more: Column) -> Column:
    """`text_hash` of the key, the seed and what follows."""
    return text_hash(*[F.col(f"`{c}`") for c in key_cols], F.lit(str(seed)), *more)


def bucket(key_cols: list[str], seed: int, n: int = 1000) -> Column:
    return F.pmod(row_hash(key_cols, seed), F.lit(n))
