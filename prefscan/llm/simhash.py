"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, shingles of
``shingle`` words with repeats, XXH64 (seed 42) of each; a bit is set when more
than half of the hashes have it.  Texts with fewer words are one shingle; texts
without words get fingerprint zero.

Links: with radius r every bit position gets a vector of r+1 bits, and each
nonzero vector v gives a mask of the positions whose vector has an odd product
with v.  Any r differing positions span at most r dimensions, so some v is
orthogonal to all of them and the two fingerprints agree under that mask: every
pair within the radius meets in one of the 2^(r+1)-1 tables.

Groups: only distinct fingerprints are compared, so copies cost one row each
before the shuffle.  A bucket of up to ``pair_limit`` fingerprints is compared
pair by pair.  A larger one (a hot bucket) is linked exactly without pairs: two
fingerprints are within 2 bits if and only if they have a common neighbour at
distance 1 or less, so each emits its neighbours in the mask's free bits and
links to the smallest fingerprint that shares one (radius 1: to the shared fingerprint).

Nulls: a null text is empty; rows without an id keep a null ``doc_id`` and
count for a component's smallest id only when it has no other.
Repeated rows and ties share a fingerprint and so a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscan.llm.common import KEYS, row_keys, text_of
from prefscan.session import materialize

SEED = 42
BITS = 64


def fingerprint(text: str, shingle: int = 3) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65536):
        part = np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.uint32)
    value = int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 3) -> DataFrame:
    """``(id_col, row keys, __fp)`` of every row; ``__fp`` is the signed 64-bit value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("__text").to_pylist()]
            out = {c: b.column(c) for c in [id_col, *KEYS]} | {"__fp": pa.array(fps, pa.int64())}
            yield pa.RecordBatch.from_pydict(out)
    rows = docs.select(F.col(id_col), *[c.alias(k) for k, c in row_keys(id_col, text_col).items()],
                       text_of(text_col).alias("__text"))
    kind = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [id_col, *KEYS]) + ", __fp long"
    return rows.mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """Bit position i gets the vector 1 + i mod (2^(r+1)-1)."""
    n = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(BITS) if bin((1 + i % n) & v).count("1") % 2)
        masks.append(m - (1 << BITS) if m >= 1 << (BITS - 1) else m)
    return masks


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def links(fps: DataFrame, radius: int = 2, pair_limit: int = 64) -> DataFrame:
    """``(a, b)``, a < b: enough pairs within the radius to join every component.
    ``fps`` has one row per distinct ``__fp``."""
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2")
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("__fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)]))
    keyed = fps.select("__fp", tables.alias("x")).select("__fp", "x.t", "x.key")
    # joins read both sides as written: then Spark can split a hot key
    sizes = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = materialize(keyed.join(sizes, ["t", "key"]))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    small = members.where(F.col("n") <= pair_limit)
    pairs = (small.select("t", "key", F.col("__fp").alias("a"))
             .join(small.select("t", "key", F.col("__fp").alias("b")), ["t", "key"])
             .where((F.col("a") < F.col("b")) & near).select("a", "b"))
    hot = members.where(F.col("n") > pair_limit)
    flips = F.transform(F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)]),
                        lambda bit: F.when(bit.bitwiseAND(F.element_at(
                            F.array(*map(F.lit, masks)), F.col("t") + 1)) == 0, bit))
    steps = F.concat(F.array(F.lit(0).cast("long")), F.filter(flips, lambda b: b.isNotNull()))
    stars = hot.select("__fp", F.explode(steps).alias("bit")).select(
        "__fp", F.col("__fp").bitwiseXOR(F.col("bit")).alias("z"))
    if radius < 2:  # the common neighbour must itself be a fingerprint
        stars = stars.join(hot.select(F.col("__fp").alias("z")).distinct(), "z", "left_semi")
    centre = stars.groupBy("z").agg(
        (F.min("__fp") if radius == 2 else F.first("z")).alias("c"))
    more = (stars.join(centre, "z").where(F.col("__fp") != F.col("c"))
            .select(F.least("c", "__fp").alias("a"), F.greatest("c", "__fp").alias("b")).where(near))
    return pairs.unionByName(more.select("a", "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` with root the smallest node of each component, by
    alternating large-star and small-star rounds; every round is checkpointed
    in the shared folder.  Nodes without an edge are absent."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
        e = materialize(e)
        low = materialize(e.groupBy("u").agg(F.min("v").alias("m")))
        j = e.join(low, "u")
        e = materialize(j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2, pair_limit: int = 64) -> DataFrame:
    """``(id_col, row keys, __fp, __root, __first)``: ``__first`` is the smallest
    ``(id, row keys)`` of the row's component, ``__root`` its smallest fingerprint."""
    rows = materialize(with_fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                           *[F.col(k).alias(k) for k in KEYS]))
    fps = materialize(rows.groupBy("__fp").agg(first.alias("low")))
    comp = components(links(fps.select("__fp"), radius, pair_limit))
    rooted = materialize(fps.join(comp, fps["__fp"] == comp["node"], "left").select(
        "__fp", "low", F.coalesce("root", "__fp").alias("__root")))
    roots = materialize(rooted.groupBy("__root").agg(F.min("low").alias("__first")))
    classes = materialize(rooted.select("__fp", "__root").join(roots, "__root"))
    return rows.join(classes, "__fp")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
          radius: int = 2) -> DataFrame:
    """One row of each component stays, with all its columns: the one of the
    smallest id (ties: smallest row key; equal rows: one of them)."""
    classes = near_duplicates(docs, id_col, text_col, shingle, radius)
    # one row of each class names the row that stays: a class has a key pair once
    keep = classes.groupBy("__root").agg(F.first("__first").alias("f")).select(
        *[F.col(f"f.{k}").alias(k) for k in KEYS])
    keyed = docs.withColumns(row_keys(id_col, text_col))
    kept = keyed.join(keep, KEYS, "left_semi")
    return kept.dropDuplicates(KEYS).select(*[F.col(f"`{c}`") for c in docs.columns])
