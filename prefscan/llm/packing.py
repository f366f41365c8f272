"""Concatenate and cut: documents end to end, cut into windows of fixed size.

Pass one encodes every document, appends the end id and writes ids with the
running count inside the partition; the partitions' totals give each partition
its global offset by a prefix sum.  Pass two reads the written ids once more,
cuts at multiples of the window and writes one boundary record per piece.  No
row is shuffled: only one total per partition is gathered.  All windows are
full but the last.

Nulls: a null text is empty, and an empty document is its end id alone.  Ties
and repeated rows are packed each on its own.  An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefscan.llm.common import bounded_rows, text_of, written
from prefscan.llm.tokens import default_tokenizer, encoder

WINDOW = 2048
END_ID = 1
#: one row of two longs per partition: 16 MB at most in a broadcast
MAX_TOTALS = 1_000_000


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """``(id, __part, __at, __n, __ids)`` of every document, written; ``__at`` is
    the number of ids before it in its partition."""
    sent = docs.sparkSession.sparkContext.broadcast(encoder(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = sent.value, 0
        part = TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows = b.slice(i, 512)
                ids = [x + end for x in enc.encode(rows.column("__text").to_pylist())]
                n = np.array([len(x) // enc.width for x in ids], dtype=np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_pydict({
                    id_col: rows.column(id_col), "__part": pa.array(np.full(len(n), part, np.int64)),
                    "__at": pa.array(before), "__n": pa.array(n), "__ids": pa.array(ids, pa.binary())})
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    return written(rows.mapInArrow(run, f"`{id_col}` {kind}, __part long, __at long, __n long, __ids binary"), "ids")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, ``start`` (the document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence)
    and, ``with_ids``, ``ids`` (little-endian unsigned 32-bit)."""
    tokenizer = tokenizer or default_tokenizer()
    table = encoded(docs, id_col, text_col, tokenizer, end_id)
    totals = table.groupBy("__part").agg(F.max(F.col("__at") + F.col("__n")).alias("t"))
    base = totals.select("__part", (F.sum("t").over(Window.orderBy("__part")) - F.col("t")).alias("__base"))
    base = F.broadcast(base) if bounded_rows(totals, MAX_TOTALS) else base
    kind, width = dict(docs.dtypes)[id_col], encoder(tokenizer).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column("__base")) + np.asarray(b.column("__at"))
            n = np.asarray(b.column("__n"))
            row, start, stop, sums, data = [], [], [], [], []
            for i, ids in enumerate(b.column("__ids")):
                cuts = [0, *range(int(-at[i] % window) or window, int(n[i]), window), int(n[i])]
                wide = memoryview(np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")).cast("B")
                for x, y in zip(cuts, cuts[1:]):
                    piece = wide[4 * x:4 * y]
                    row.append(i), start.append(x), stop.append(y), sums.append(zlib.crc32(piece))
                    data.append(bytes(piece)) if with_ids else None
            row, start, stop = (np.array(x, dtype=np.int64) for x in (row, start, stop))
            first = at[row] + start
            yield pa.RecordBatch.from_pydict({
                id_col: b.column(id_col).take(pa.array(row)), "start": pa.array(start),
                "length": pa.array(stop - start), "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(first // window),
                "offset": pa.array(first % window)} | ({"ids": pa.array(data, pa.binary())} if with_ids else {}))
    return table.join(base, "__part").mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids binary" if with_ids else ""))
