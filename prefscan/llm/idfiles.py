"""Token-id shards with a minimal perfect hash index.

Documents are dealt by ranges of their id and sorted, so shards hold ascending
ids.  A shard is one binary value of at most about ``SHARD_TOKENS`` ids (one
longer document makes a longer shard) in a Parquet file, which any store that
Spark reads can hold:

    magic, id width, hash seed, documents, tokens, keys, buckets     (header)
    displacement per bucket; per slot: fingerprint, first document, documents
    token offset per document (and one behind the last)
    ids, raw

Index: keys are spread over buckets of about four; buckets in falling order of
size get the first displacement that puts all their keys into free slots, and
single keys store their slot directly.  n keys fill n slots.  A slot keeps 32
bits of its key's hash, so an absent key is refused but for one in 2^32.  Should
two keys of a shard have one 64-bit hash, the shard takes the next seed.

A key is the id's text; a null id is a key of its own, apart from the empty text.
Rows that share an id are neighbours; its slot names the first and their number
(more of them may follow in the next shard).  A null text is empty.
An empty table gives no shard.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefscan.llm.common import bounded_rows, text_of
from prefscan.llm.tokens import default_tokenizer, encoder
from prefscan.session import scratch_path

END_ID = 2
SHARD_TOKENS = 1 << 21
MAX_SHARDS = 1_000_000
MAGIC = b"IDSHARD2"
HEAD = "<8sIIQQQQ"
_SEED = 0x5EED
_NULL = b"\xff"  # never the bytes of a text


def key_hash(key: str | None, seed: int = _SEED) -> int:
    return xxhash.xxh64_intdigest(_NULL if key is None else key.encode("utf-8", "surrogatepass"), seed)


def key_of(value) -> str | None:
    return None if value is None else str(value)


def _slot(h: int, displacement: int, n: int) -> int:
    """Slot of a key hash under a displacement."""
    x = (h ^ (displacement * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 29)) >> 8) % n


def _slots(h: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    """``_slot`` of every key (columns) under every displacement (rows)."""
    x = h[None, :] ^ (displacements[:, None] * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (((x ^ (x >> np.uint64(29))) >> np.uint64(8)) % np.uint64(n)).astype(np.int64)


TRIES = 64


def build_index(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(displacement per bucket, position in ``hashes`` per slot).  A
    displacement below zero stands for slot ``-d - 1`` itself."""
    h = np.array(hashes, dtype=np.uint64)
    n = len(h)
    size = max(1, -(-n // 4))
    bucket = (h % np.uint64(size)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=size)
    starts = np.cumsum(counts) - counts
    shift, slots = np.zeros(size, np.int32), np.full(n, -1, np.int64)
    taken = np.zeros(n, dtype=bool)
    for b in np.argsort(-counts, kind="stable"):
        if counts[b] < 2:
            break
        keys = order[starts[b]:starts[b] + counts[b]]
        base = 0
        while True:
            at = _slots(h[keys], np.arange(base, base + TRIES, dtype=np.uint64), n)
            line = np.sort(at, axis=1)
            good = np.flatnonzero(~taken[at].any(axis=1) & (line[:, 1:] != line[:, :-1]).all(axis=1))
            if len(good):
                break
            base += TRIES
        found = at[good[0]]
        shift[b], slots[found], taken[found] = base + good[0], keys, True
    single = np.flatnonzero(counts == 1)
    free = np.flatnonzero(~taken)
    shift[single], slots[free] = -free - 1, order[starts[single]]
    return shift, slots


def build_shard(keys: list[str | None], ids: list[bytes], width: int) -> bytes:
    """``keys`` in order, equal ones next to each other; ``ids`` of each."""
    first = [i for i, k in enumerate(keys) if not i or keys[i - 1] != k]
    count = np.diff([*first, len(keys)])
    seed = _SEED
    while len(set(hashes := [key_hash(keys[i], seed) for i in first])) != len(hashes):
        seed += 1
    shift, slots = build_index(hashes)
    offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype("<u8")
    h = np.array(hashes, dtype=np.uint64)
    head = struct.pack(HEAD, MAGIC, width, seed, len(keys), int(offsets[-1]), len(first), len(shift))
    return b"".join([head, shift.astype("<i4").tobytes(), (h[slots] >> np.uint64(32)).astype("<u4").tobytes(),
                     np.array(first)[slots].astype("<u4").tobytes(), count[slots].astype("<u4").tobytes(),
                     offsets.tobytes(), *ids])


class Shard:
    """Keyed access to one shard in constant time, straight from its bytes."""

    def __init__(self, blob: bytes):
        magic, self.width, self.seed, self.docs, self.tokens, self.keys, buckets = struct.unpack_from(HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(HEAD)

        def part(n, kind):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out
        self.shift, self.prints = part(buckets, "<i4"), part(self.keys, "<u4")
        self.first, self.count = part(self.keys, "<u4"), part(self.keys, "<u4")
        self.offsets = part(self.docs + 1, "<u8")
        self.ids = part(self.tokens, f"<u{self.width}")

    def documents(self, key: str | None) -> list[tuple[int, np.ndarray]]:
        """(token offset, ids) of each document of the key; none if it is absent."""
        h = key_hash(key, self.seed)
        d = int(self.shift[h % len(self.shift)]) if self.keys else 0
        slot = -d - 1 if d < 0 else _slot(h, d, max(1, self.keys))
        if not self.keys or self.prints[slot] != h >> 32:
            return []
        first = int(self.first[slot])
        spans = [(int(self.offsets[i]), int(self.offsets[i + 1])) for i in range(first, first + int(self.count[slot]))]
        return [(a, self.ids[a:b]) for a, b in spans]


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
              tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of ``docs`` to ``path``, in ascending order of the id."""
    tokenizer = tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__tie", F.xxhash64("__text"))  # equal ids can be dealt to several tasks
    rows = rows.repartitionByRange("__id", "__tie").sortWithinPartitions("__id", "__tie", "__text")
    sent = docs.sparkSession.sparkContext.broadcast(encoder(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = sent.value, TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        held, ids, size = [], [], 0

        def shard():
            keys = [key_of(k) for k in held]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "shard": pa.array([number], pa.int64()),
                "docs": pa.array([len(held)], pa.int64()), "tokens": pa.array([size // enc.width], pa.int64()),
                "lo": pa.array(held[:1], key_type), "hi": pa.array(held[-1:], key_type),
                "keys": pa.array([_runs(held)], pa.list_(key_type)),
                "data": pa.array([build_shard(keys, ids, enc.width)], pa.binary())})
        for b in batches:
            key_type = b.column("__id").type
            for i in range(0, b.num_rows, 512):
                rows = b.slice(i, 512)
                for k, x in zip(rows.column("__id").to_pylist(), enc.encode(rows.column("__text").to_pylist())):
                    if size >= shard_tokens * enc.width:
                        yield shard()
                        held, ids, size, number = [], [], 0, number + 1
                    held.append(k)
                    ids.append(x + end)
                    size += len(ids[-1])
        if held:
            yield shard()
    shards = rows.select("__id", "__text").mapInArrow(
        run, f"part long, shard long, docs long, tokens long, lo {kind}, hi {kind}, keys array<{kind}>, data binary")
    # raw ids: neither a dictionary nor a general compressor gains much on them
    (shards.write.option("parquet.block.size", 1 << 23).option("parquet.enable.dictionary", "false")
     .option("compression", "uncompressed").parquet(path))


def _runs(held: list) -> list:
    return [k for i, k in enumerate(held) if not i or held[i - 1] != k]


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """``(part, shard, base)``: ids before each shard, one row per shard.  Shards
    are added up within their part; only the parts' totals meet in one window."""
    sizes = spark.read.parquet(path).select("part", "shard", "tokens")
    totals = sizes.groupBy("part").agg(F.sum("tokens").alias("t"))  # one row per partition of the writer
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inner = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    return sizes.withColumn("inner", inner).join(before, "part").select(
        "part", "shard", (F.col("before") + F.col("inner")).alias("base"))


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Every document by its key: id, ``start`` (ids of all documents before
    it), ``n_tokens``, ``ids_crc32`` and, ``with_ids``, ``ids`` (little-endian
    unsigned 32-bit)."""
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType
    bases = shard_bases(spark, path)
    bases = F.broadcast(bases) if bounded_rows(bases, MAX_SHARDS) else bases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column("data")[i].as_py())
                rows = []
                base = b.column("base")[i].as_py()
                for k in b.column("keys")[i].as_py():
                    for at, ids in shard.documents(key_of(k)):
                        wide = ids.astype("<u4")
                        rows.append((k, base + at, len(wide), zlib.crc32(wide), wide.tobytes() if with_ids else b""))
                    if len(rows) >= 2000:
                        yield batch(b, rows)
                        rows = []
                yield batch(b, rows)

    def batch(b, rows):
        key, start, n, crc, data = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_pydict({
            id_col: pa.array(key, b.column("keys").type.value_type), "start": pa.array(start, pa.int64()),
            "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())} | (
            {"ids": pa.array(data, pa.binary())} if with_ids else {}))
    return files.join(bases, ["part", "shard"]).mapInArrow(
        run, f"`{id_col}` {kind.simpleString()}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def by_range(ranges: list):
    """Rows ``(__id, part, shard)`` of the shards whose range holds an id."""
    table = sorted(((r.hi, r.lo, r.part, r.shard) for r in ranges), key=lambda r: r[0])
    highs = [r[0] for r in table]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in b.column("__id").to_pylist():
                i = bisect.bisect_left(highs, k)
                while i < len(table) and (table[i][1] is None or table[i][1] <= k):
                    out.append((k, table[i][2], table[i][3]))
                    i += 1
            yield pa.RecordBatch.from_pydict({
                "__id": pa.array([x[0] for x in out], b.column("__id").type),
                "part": pa.array([x[1] for x in out], pa.int64()), "shard": pa.array([x[2] for x in out], pa.int64())})
    return route


def lookup(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, ids)`` of the documents with the ids in ``keys`` (each asked once;
    absent and null ids give no row).  The shards' first and last ids route a key
    to its shards, up to ``MAX_SHARDS`` of them; more of them are met by a join
    with the shards' keys.  A task then opens a shard once for all its keys."""
    spark = keys.sparkSession
    files = spark.read.parquet(path)
    ranges = files.where("hi is not null").select("part", "shard", "lo", "hi")
    asked = keys.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    kind = dict(keys.dtypes)[id_col]
    if bounded_rows(ranges, MAX_SHARDS):
        asked = asked.mapInArrow(by_range(list(ranges.toLocalIterator())), f"__id {kind}, part long, shard long")
    else:
        asked = files.select("part", "shard", F.explode("keys").alias("__id")).join(asked, "__id")
    asked = asked.groupBy("part", "shard").agg(F.collect_list("__id").alias("__asked"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, data = [], []
            for i in range(b.num_rows):
                shard = Shard(b.column("data")[i].as_py())
                for k in b.column("__asked")[i].as_py():
                    for _, ids in shard.documents(str(k)):
                        ks.append(k), data.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array(ks, b.column("__asked").type.value_type), "ids": pa.array(data, pa.binary())})
    return files.select("part", "shard", "data").join(asked, ["part", "shard"]).mapInArrow(
        find, f"`{id_col}` {kind}, ids binary")


def write_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
                   **kw) -> DataFrame:
    """``read_ids`` of what ``write_ids`` wrote into a fresh folder of the shared scratch."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, id_col, text_col, **kw)
    return read_ids(docs.sparkSession, path, id_col, with_ids)
