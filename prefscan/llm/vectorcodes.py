"""Vector codes by product quantisation in exact integer arithmetic.

Components become integers, ``floor(scale * x)``; vectors are cut into equal
parts, and every part position learns its own codebook by Lloyd rounds.  The
nearest entry minimises ``|c|^2 - 2 q.c``; the dot products of a block with all
entries are one matrix product per pair of limbs.  A limb has so few bits that
``components * limb * limb`` stays within 2^53, so the float64 products of the
BLAS are whole numbers without rounding; they are shifted and added in int64,
and the first minimum wins.

A round is one pass over the written integers: a task adds up its parts per
entry and emits one row per (part, entry, component) at its end, so what is
shuffled and what reaches the driver is bounded by the codebooks' size.  The
codebooks (parts x entries x components) travel to the tasks.

Rows: a null vector, or one with a null, NaN or infinite component, is dropped,
and so is one that cannot be cut like the others (empty, a length that is no
multiple of the parts, or another length than that of the first kept row).
Null ids are kept and come last in the choice of first entries; equal ids are
taken in the order of their integers.  Fewer rows than entries give fewer
entries.  Repeated rows count each.  An empty table gives an empty result.
Integers whose squared distances pass a long raise an ArithmeticError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscan.llm.common import written
from prefscan.session import small

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
EXACT = 53  # bits of a float64 whole number
BLOCK = 4096  # vectors in one matrix product


def limb_bits(components: int) -> int:
    """Bits a limb so that sums of ``components`` products stay within 2^53."""
    return (EXACT - (components - 1).bit_length()) // 2


def split_limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Low limbs in [0, 2^bits), the last one signed, as float64: lowest first."""
    out = []
    while values.size and (values.max() >= 1 << bits or values.min() < -(1 << bits)):
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def exact_dots(left: np.ndarray, right: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``left @ right.T`` of int64 matrices, exact where the result fits int64."""
    bits = bits or limb_bits(left.shape[1])
    out = np.zeros((len(left), len(right)), np.int64)
    highs = [np.ascontiguousarray(x.T) for x in split_limbs(right, bits)]
    for i, a in enumerate(split_limbs(left, bits)):
        for j, b in enumerate(highs):
            out += (a @ b).astype(np.int64) << (bits * (i + j))
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, lower on ties; its squared distance)."""
    cost = (book * book).sum(axis=1)[None, :] - 2 * exact_dots(parts, book)
    best = cost.argmin(axis=1)
    return best, cost[np.arange(len(parts)), best] + (parts * parts).sum(axis=1)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """``(__id, __label, __q)`` of the usable rows, written; ``__q`` holds longs."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"),
                          F.when(usable, v).cast("array<double>").alias("__v")).where("__v is not null")
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("__v")
            whole = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            if len(whole) and np.abs(whole).max() >= largest(int(np.diff(ends).max())):
                raise ArithmeticError("squared distances of these vectors do not fit a long")
            q = pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__label"), q], ["__id", "__label", "__q"])
    return written(rows.mapInArrow(run, f"__id {kind['__id']}, __label {kind['__label']}, __q array<bigint>"), "vectors")


def largest(components: int) -> float:
    """Integers below it have squared distances that fit a long."""
    return 2.0 ** ((62 - (components - 1).bit_length()) // 2 - 1)


def matrix(b: pa.RecordBatch) -> np.ndarray:
    q = b.column("__q")
    return q.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def lloyd_round(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the floored mean of the parts nearest to it; an unused one stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(k) for k in books], [np.zeros(len(k), np.int64) for k in books]
        for b in batches:
            for q in np.array_split(matrix(b), max(1, b.num_rows // BLOCK)):
                for k, part in enumerate(np.hsplit(q, len(books))):
                    best = nearest(part, books[k])[0]
                    np.add.at(sums[k], best, part)
                    counts[k] += np.bincount(best, minlength=len(counts[k]))
        flat = [(k, e, i, int(s), int(counts[k][e])) for k, x in enumerate(sums) for e in np.flatnonzero(counts[k])
                for i, s in enumerate(x[e])]
        columns = list(zip(*flat)) if flat else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "e", "i", "s", "n"])
    found = rows.select("__q").mapInArrow(run, "p long, e long, i long, s long, n long").groupBy("p", "e", "i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = [k.copy() for k in books]
    for r in found.collect():  # at most one row per component of a codebook
        out[r.p][r.e, r.i] = int(r.s) // int(r.n)
    return out


def fit(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """One int64 matrix (entry, component) per part position."""
    first = rows.orderBy(F.col("__id").asc_nulls_last(), "__q").limit(entries).collect()
    start = np.array([r["__q"] for r in first], np.int64).reshape(len(first), -1)
    books = [np.ascontiguousarray(x) for x in np.hsplit(start, parts)]
    for _ in range(rounds):
        books = lloyd_round(rows, books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """``(codes, codebooks)``: per kept row id, label, ``indexes`` (array, one an
    entry per part) and ``error`` (squared distances summed over the parts),
    written; and the final codebooks."""
    rows = quantised(vectors, id_col, vector_col, label_col, parts, scale)
    kind = dict(rows.dtypes)
    one = rows.orderBy(F.col("__id").asc_nulls_last(), "__q").select(F.size("__q")).first()
    rows = rows.where(F.size("__q") == (one[0] if one else 0))
    books = fit(rows, parts, entries, rounds) if one else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b)
            index, error = np.zeros((len(q), parts), np.int32), np.zeros(len(q), np.int64)
            for lo in range(0, len(q), BLOCK):
                block = slice(lo, lo + BLOCK)
                for k, part in enumerate(np.hsplit(q[block], parts)):
                    index[block, k], far = nearest(part, books[k])
                    error[block] += far
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * parts), pa.array(index.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__label"), flat, pa.array(error)],
                                             [id_col, label_col, "indexes", "error"])
    codes = rows.mapInArrow(
        run, f"`{id_col}` {kind['__id']}, `{label_col}` {kind['__label']}, indexes array<int>, error bigint")
    return written(codes, "codes"), books


def digest_columns(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", **kw) -> DataFrame:
    """Per kept row: id, ``code`` (two hex digits an index), ``error``,
    ``label_error`` (over all rows of its label), ``codebooks_sha256``."""
    codes, books = compress(vectors, id_col, vector_col, label_col, **kw)
    text = ",".join(str(x) for book in books for x in book.ravel().tolist())
    label = F.col(f"`{label_col}`")
    by_label = codes.groupBy(label.alias("__of")).agg(F.sum("error").alias("label_error"))
    digits = F.transform("indexes", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0"))
    return codes.join(small(by_label, 64), label.eqNullSafe(F.col("__of"))).select(
        F.col(f"`{id_col}`"), F.array_join(digits, "").alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
