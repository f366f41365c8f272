"""Document fingerprints by winnowing.

All k-grams of a text's UTF-8 bytes are hashed by a rolling hash; of every
``window`` neighbours the smallest hash is chosen, the rightmost on ties, and
kept with its position.  Any string of ``window + gram - 1`` bytes that two
texts share puts a common hash into both selections.  The likeness of two
fingerprints is the share of common hashes in all hashes (1 for two empty
ones).  The fingerprint string is a digest of the selection with positions.

``compare_with_next`` goes through the documents in falling order of the id: a
range partitioning brings neighbours together, each task streams its documents
with one predecessor in memory, and only a partition's first and last document
are joined with the partitions next to it (the last with the first).

Nulls: a null text is empty; rows without an id come last.  Texts shorter than
``gram`` bytes are one gram; empty texts have an empty selection.  Rows that
share an id follow each other by a hash of their texts.  One row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefscan.llm.common import RollingHash, mix64, sliding_min, text_of, written

# 15 shared bytes give a common hash: half of any text of 30 bytes or more
GRAM, WINDOW = 8, 8
BLOCK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


class Winnower:
    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.roll = RollingHash(31, BLOCK + gram + window)

    def select(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and byte positions of the selection, in order of position."""
        d = np.frombuffer(data, np.uint8)
        if len(d) < self.gram:
            return np.array([xxhash.xxh64_intdigest(data)] if data else [], np.uint64), np.zeros(min(1, len(d)), np.int64)
        hashes, places = [], []
        for block in range(0, len(d) - self.gram + 1, BLOCK):
            part = d[block:block + BLOCK + self.gram + self.window - 2]
            if block and len(part) < self.gram + self.window - 1:
                break  # no window starts here
            at = np.arange(len(part) - self.gram + 1)
            h = mix64(self.roll.slices(self.roll.prefix(part), at, at + self.gram))
            best = sliding_min((h & ~_LOW) | (_LOW - at.astype(np.uint64)), min(self.window, len(h)))
            p = (_LOW - (best & _LOW)).astype(np.int64)
            p = p[np.concatenate([[True], p[1:] != p[:-1]])]
            hashes.append(h[p])
            places.append(p + block)
        h, p = np.concatenate(hashes), np.concatenate(places)
        keep = np.concatenate([[True], p[1:] > np.maximum.accumulate(p)[:-1]])  # blocks overlap
        return h[keep], p[keep]


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(hashes.tobytes() + places.astype("<i8").tobytes())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """``a`` and ``b`` are sorted and distinct."""
    return _share(len(np.intersect1d(a, b, assume_unique=True)), a, b)


def _share(common: int, a: np.ndarray, b: np.ndarray) -> float:
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def edit(text: str, following: str) -> str:
    """The last half (rounded down) gives way to as much of the next text's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


class _Row:
    def __init__(self, win: Winnower, text: str):
        self.text = text
        self.gram = win.gram
        self.hashes, self.places = win.select(text.encode("utf-8", "surrogatepass"))
        self.set, self.first = np.unique(self.hashes, return_index=True)

    def against(self, win: Winnower, following: "_Row") -> tuple:
        other = edit(self.text, following.text)
        data = other.encode("utf-8", "surrogatepass")
        h, p = win.select(data)
        edited = np.unique(h)
        common, mine, _ = np.intersect1d(self.set, edited, assume_unique=True, return_indices=True)
        at = self.places[self.first[mine]]
        span = (int(at.min()), int(at.max()) + self.gram) if len(at) else (None, None)
        return (len(self.text), hashlib.sha256(data).hexdigest(), digest(self.hashes, self.places), digest(h, p),
                _share(len(common), self.set, edited), likeness(self.set, following.set), len(self.hashes), *span)


_RESULT = [("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"),
           ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"),
           ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"),
           ("n_selected", pa.int64(), "long"), ("shared_from", pa.int64(), "long"), ("shared_to", pa.int64(), "long")]
_DONE, _FIRST, _LAST = 0, 1, 2


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                 window: int = WINDOW) -> DataFrame:
    """``(id, hashes, places)``: the selection of every row (hashes as signed longs)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = Winnower(gram, window)
        for b in batches:
            got = [win.select(t.encode("utf-8", "surrogatepass")) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                id_col: b.column(id_col), "hashes": pa.array([h.view(np.int64) for h, _ in got], pa.list_(pa.int64())),
                "places": pa.array([p for _, p in got], pa.list_(pa.int64()))})
    return docs.select(F.col(id_col), text_of(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, hashes array<long>, places array<long>")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                      window: int = WINDOW) -> DataFrame:
    """Per row: id, ``n_chars``, digests of its own and its edited text's
    selections, the likeness to the edited and to the next text, the number of
    grams selected, and by their positions the bytes from the first to the last
    gram that the edited text's selection shares (null: none; a hash that occurs
    again counts where it stands first)."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__tie", F.xxhash64("__text"))
    order = [F.col("__id").desc_nulls_last(), F.col("__tie").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "__text")

    def table(key_type, ids, kinds, part, texts, results):
        columns = zip(*results) if results else [[]] * len(_RESULT)
        return pa.RecordBatch.from_pydict({
            "__id": pa.array(ids, key_type), "__kind": pa.array(kinds, pa.int32()),
            "__part": pa.array([part] * len(ids), pa.int64()), "__text": pa.array(texts, pa.string())}
            | {name: pa.array(list(c), t) for (name, t, _), c in zip(_RESULT, columns)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, part, held, none = Winnower(gram, window), TaskContext.get().partitionId(), None, (None,) * len(_RESULT)
        key_type = None
        for b in batches:
            key_type = b.column("__id").type
            for i in range(0, b.num_rows, 1000):
                ids, kinds, texts, results = [], [], [], []
                rows = b.slice(i, 1000)
                for k, t in zip(rows.column("__id").to_pylist(), rows.column("__text").to_pylist()):
                    row = _Row(win, t)
                    if held is None:
                        ids.append(k), kinds.append(_FIRST), texts.append(t), results.append(none)
                    else:
                        ids.append(held[0]), kinds.append(_DONE), texts.append(None)
                        results.append(held[1].against(win, row))
                    held = (k, row)
                yield table(key_type, ids, kinds, part, texts, results)
        if held is not None:
            yield table(key_type, [held[0]], [_LAST], part, [held[1].text], [none])
    schema = f"__id {kind}, __kind int, __part long, __text string, " + ", ".join(f"{n} {s}" for n, _, s in _RESULT)
    passed = written(rows.mapInArrow(run, schema), "winnowed")
    names = [n for n, _, _ in _RESULT]
    done = passed.where(F.col("__kind") == _DONE).select(F.col("__id").alias(id_col), *names)
    # one row per partition that has documents
    parts = passed.where(F.col("__kind") == _FIRST).select("__part")
    ring = parts.select("__part", F.lead("__part").over(Window.orderBy("__part")).alias("n")).crossJoin(
        parts.agg(F.min("__part").alias("zero"))).select("__part", F.coalesce("n", "zero").alias("__next"))
    heads = passed.where(F.col("__kind") == _FIRST).select(F.col("__part").alias("__next"), F.col("__text").alias("__following"))
    tails = passed.where(F.col("__kind") == _LAST).select("__id", "__part", "__text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = Winnower(gram, window)
        for b in batches:
            got = [_Row(win, t).against(win, _Row(win, n)) for t, n in zip(
                b.column("__text").to_pylist(), b.column("__following").to_pylist())]
            columns = zip(*got) if got else [[]] * len(_RESULT)
            yield pa.RecordBatch.from_pydict({id_col: b.column("__id")} | {
                name: pa.array(list(c), t) for (name, t, _), c in zip(_RESULT, columns)})
    last = tails.join(ring, "__part").join(heads, "__next").select("__id", "__text", "__following").mapInArrow(
        close, f"`{id_col}` {kind}, " + ", ".join(f"{n} {s}" for n, _, s in _RESULT))
    return done.unionByName(last)
