"""Shared helpers: row keys, mixing of 64-bit hashes, scratch tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.session import scratch_path

K1, K2 = "__row_k1", "__row_k2"
KEYS = [K1, K2]


def text_of(col: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """96 bits that name a row by its id and text.  Rows without an id and rows
    that share an id stay apart; only rows equal in both get one key."""
    i, t = F.col(id_col).cast("string"), text_of(text_col)
    return {K1: F.xxhash64(i, t), K2: F.hash(t, i)}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.  Cuts the lineage as a
    checkpoint does, in fewer bytes; the caller's job folder owns the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seeded_u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2 ** 64, n, dtype=np.uint64)


class RollingHash:
    """Polynomial hashes, modulo 2^64, of any slice of a byte string, from one
    prefix sum.  Powers grow with the longest string seen and stop at ``limit``
    bytes, so callers cut longer strings into overlapping blocks."""

    def __init__(self, seed: int, limit: int):
        table = seeded_u64(seed, 257)
        self.table, self.base = table[:256], int(table[256]) | 1
        self.limit, self.size = limit, 0

    def _grow(self, n: int) -> None:
        n = min(self.limit, max(n, 1 << 16))
        step = np.uint64(self.base)
        inverse = np.uint64(pow(self.base, -1, 2 ** 64))
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, step)]), dtype=np.uint64)
        self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        self.size = n

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.size:
            self._grow(max(len(data), 2 * self.size))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.powers[:len(data)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverses[start]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (doubling: log2(width) passes)."""
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[:len(v) - (width - span)], v[width - span:]) if span < width else v


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df.select(*keep, **columns)`` whose new columns are computed once a row.
    The optimizer would otherwise copy an expression into the lambda that uses
    it and evaluate it once per element; a one-row explode is never merged."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(row)).alias("__once")).select(
        *keep, *[F.col(f"__once.{n}").alias(n) for n in columns])


def bounded_rows(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows (reads no more than that)."""
    return df.limit(limit + 1).count() <= limit


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
