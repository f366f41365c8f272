"""Labelled rows for training: a bounded, reproducible sample.

``train_sample`` takes at most ``per_class`` rows of each label (the smallest
hashes of the id; of an id with several rows the one with the smallest hash of
the text) among those that the caller's rule does not hold out.  The bound keeps
what reaches the driver fixed; everything else covers all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def train_sample(docs: DataFrame, labels: DataFrame, label_col: str, hold: Column, per_class: dict[int, int],
                 id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``(__text, __label)`` of the sample and the number of rows of each label
    it was taken from.  Null ids, null labels and held-out rows never count; an
    id with two labels counts for each."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(*per_class) & ~hold).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct()
    totals = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    chosen = None
    for value, most in per_class.items():
        # about twice the rows wanted pass the first cut, so the exact one sees few
        share = min(1.0, 2.0 * (most + 100) / max(1, totals.get(value, 0)))
        own = known.where((F.col("__label") == value) & (F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < share * (1 << 20)))
        part = own.orderBy(F.xxhash64("__id"), "__id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # at most sum(per_class) ids: a proven bound for the broadcast
    met = rows.join(F.broadcast(chosen), "__id")
    one = met.groupBy("__id", "__label").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("m"))
    return one.select("m.__text", "__label"), totals
