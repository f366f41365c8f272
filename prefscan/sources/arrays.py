"""JSON arrays of string arrays, ``[["p", "c", "r"], ...]``, one array per
file of any size, read in bounded pieces by many tasks.

The text reader cuts files at ``],`` wherever that stands, and deals the cuts of
one file to several tasks (byte splits).  Whether a cut lies inside a string
follows from the number of quotes before it: the first pass takes the parity of
the unescaped quotes of each split (one row per split), and the running parity
tells every split whether it begins inside a string.  The second pass then joins cuts
inside strings to whole records in the order of the split; only a string that
runs from one split into the next leaves fragments, which are put together by a
grouping of these alone.  Records are parsed on the JVM side.  A task holds one
record, or one split that lies inside a single string.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefscan.session import materialize, small

CUT = "],"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, value, quotes)``: the text between cuts, in the order of
    each split; ``start`` is the split's first byte."""
    raw = spark.read.option("lineSep", CUT).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    return raw.select("file", "start", "value", (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))).alias("quotes"))


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split ``(file, start, odd, ends0, ends1)``: the parity of its quotes,
    and whether it has a cut outside strings if it begins outside (0) or inside (1)."""
    now, parity, seen, out = None, 0, set(), []
    for b in batches:
        for file, start, quotes in zip(*(b.column(c).to_pylist() for c in ("file", "start", "quotes"))):
            if (file, start) != now:
                out += [(*now, parity, seen)] if now else []
                now, parity, seen = (file, start), 0, set()
            parity ^= quotes % 2
            seen.add(parity)
    out += [(*now, parity, seen)] if now else []
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([x[0] for x in out], pa.string()), "start": pa.array([x[1] for x in out], pa.int64()),
        "odd": pa.array([x[2] for x in out], pa.int64()), "ends0": pa.array([0 in x[3] for x in out], pa.bool_()),
        "ends1": pa.array([1 in x[3] for x in out], pa.bool_())})


def split_states(cut: DataFrame) -> DataFrame:
    """Per split: whether it begins inside a string, and the split in which the
    record around it began.  One row per split of a file."""
    per = materialize(cut.drop("value").mapInArrow(_parities, "file string, start long, odd long, ends0 boolean, ends1 boolean"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = per.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    begins = ~F.col("inside") | F.col("ends1")  # the record open at its end began in it
    return state.select("file", "start", "inside", F.max(F.when(begins, F.col("start"))).over(before).alias("origin"))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(file, pos, whole, origin, at, text)``: whole records, and the
    fragments of strings that cross a split, ``origin`` being where they begin."""
    now, held, number, crossing, origin = None, [], 0, False, None
    out: list[tuple] = []

    def close(open_end: bool) -> None:
        """The record held so far; ``open_end``: the split ends inside its string."""
        nonlocal held, number, crossing
        text = CUT.join(held)
        file, start = now
        if crossing:
            out.append((file, None, False, origin, start, text))
        elif open_end:
            out.append((file, start + number, False, start, start, text))
            number += 1
        elif text.strip():
            out.append((file, start + number, True, start, start, text))
            number += 1
        held, crossing = [], False

    def batch() -> pa.RecordBatch:
        nonlocal out
        kinds = [("file", pa.string()), ("pos", pa.int64()), ("whole", pa.bool_()), ("origin", pa.int64()),
                 ("at", pa.int64()), ("text", pa.string())]
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])
    inside = False
    for b in batches:
        for file, start, value, quotes, begins, first in zip(*(
                b.column(c).to_pylist() for c in ("file", "start", "value", "quotes", "inside", "origin"))):
            if (file, start) != now:
                if held:
                    close(inside)
                now, number, inside, crossing, origin = (file, start), 0, begins, begins, first
            held.append(value)
            inside ^= quotes % 2 == 1
            if not inside:
                close(False)
        if out:
            yield batch()
    if held:
        close(inside)
    yield batch()


def read_string_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, record)``: the inner arrays; ``pos`` grows along a file.  A
    null record is a JSON ``null`` in its place.  Text that is no such array fails the job."""
    cut = pieces(spark, path)
    found = cut.join(small(split_states(cut), 256), ["file", "start"]).mapInArrow(
        _join, "file string, pos long, whole boolean, origin long, at long, text string")
    whole = found.where("whole").select("file", "pos", "text")
    # a record is as long as its text; only those that cross a split come here
    crossing = found.where("not whole").groupBy("file", "origin").agg(
        F.max("pos").alias("pos"), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), CUT).alias("text"))
    records = whole.unionByName(crossing.select("file", "pos", "text"))
    # the outer brackets, which only a file's first and last record carry, and the inner one that a cut took
    opened = F.when(F.col("pos") == 0, F.regexp_replace("text", r"\A[\s\x{FEFF}]*\[", "")).otherwise(F.col("text"))
    closed = F.regexp_replace(opened, r"\]?\s*\]\s*\z", "")
    lines = records.select("file", "pos", F.trim(closed).alias("text")).where(F.col("text").rlike(r"\S"))
    parsed = F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]]")), "array<array<string>>", {"mode": "FAILFAST"})
    return lines.select("file", "pos", F.posexplode(parsed).alias("_i", "record")).select(
        "file", (F.col("pos") + F.col("_i")).alias("pos"), "record")
