"""Language-model scores from a probabilistic suffix tree over words.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end
per document.  The root predicts a token from its count c among the N training
tokens of V kinds, ``(c + 0.5) / (N + 0.5 (V + 1))``, which leaves one share for
an unknown word.  A node is a context of 1 to ``depth`` words.

Strings.  All strings that occur ``least`` times in the training tokens, twice by
default at any corpus size, are contexts or stored successors.  The texts are split
once, into written blocks of numbered words, which all passes read.

Buckets.  A position's route is made of bits of the hashes of the words before it,
the nearest first, and of its own: all positions after a context lie between two
routes.  Quantiles of the blocks' routes divide them into buckets of about ``BUCKET``
positions; a task gets those of a bucket with the words before them, counts the
strings and builds the part of the tree that they need.  No tree is gathered or sent.

Contexts on the border.  A context whose routes go over a border of buckets, as those
of very frequent words do, is counted in the blocks and added up by Spark's aggregate;
its strings go to each of its buckets.  If only a longer context in another bucket
makes it stay, its positions' gain is handed on apart, and added if that comes true.

Smoothing.  With counts n(s, x) of the stored successors x of s, and its n(s),
``P(x | s) = (n(s, x) - D) / n(s) + g(s) P(x | suffix of s)``, where ``g`` is the
share that the stored successors leave; other tokens get ``g(s) P(x | suffix)``.

Divergence test.  Against its suffix a context gains ``sum n(s, x) ln P(x | s) /
P(x | suffix)`` over all its successors (the training count times the divergence
of the two distributions); it stays if that pays for its stored successors,
half ``ln n(s)`` each.  The suffixes of a context that stays do so too.

Scoring.  A token is scored at the longest suffix of its history that is a node.
A bucket hands on how much that adds to the root's share, by document.
Root shares need counts of any word: those of the frequent words, as many as fit
``HEAD_WORDS``, are sent to all tasks; a document's other words are tallied, joined
with the counts, and added.

Words and strings go by 64-bit hashes.  Nulls: a null text is empty and scores
its end; a null id is a training row.  Repeated rows count and score each on
their own.  Without training rows all probabilities are the root's.  An empty
table gives an empty result.
"""

from __future__ import annotations

import contextlib
import itertools
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.llm.common import mix64, session_partitions, text_of, written
from prefscan.llm.labelled import held_out
from prefscan.session import scratch_path

DEPTH, P_MIN, DISCOUNT = 3, 0.0, 0.75
HEAD_WORDS = 2_000_000  # 24 bytes each in a broadcast
BUCKET, FEW, CUTS = 1 << 20, 1 << 16, 64  # positions of a bucket, of a small one, and quantiles of a block
TOKENS, WORDS = 1 << 19, 1 << 19  # of a block, and the words a task numbers before it starts anew
HELD = 1 << 21  # partial counts that a task adds up before it emits them
END = 0  # the end's number in a block
OTHER = 0xFFFFFFFF  # number of a word beyond the head, whose hash stands beside
FIRST = 40  # bits of a route after those of the nearest word
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def combine(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Key of a context (0: none) followed by a token."""
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(1))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key in the sorted keys; -1 if it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def packed(rows: np.ndarray) -> bytes:
    """Rows of unsigned 32-bit numbers, compressed byte by byte."""
    planes = np.ascontiguousarray(rows, "<u4").view(np.uint8).reshape(*rows.shape, 4).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data, rows: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * rows * n, "zstd"), np.uint8).reshape(rows, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0]


class Numbers(dict):
    """Small numbers of the words a task meets, and their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")
        self[b""]  # no word: the end

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n

    def array(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)


PLAIN = ["tokens", "ends", "hashes", "held"]
END_HASH = xxhash.xxh64_intdigest(b"")


class Windows:
    """The ``depth`` words before each position of a block, the nearest first, by
    their numbers; END where the text begins."""

    def __init__(self, tokens: np.ndarray, hashes: np.ndarray, depth: int):
        self.tokens, self.hashes, self.back = tokens, hashes, []
        for _ in range(depth):
            here = np.full_like(tokens, END)
            here[1:] = (self.back[-1] if self.back else tokens)[:-1]
            if self.back:
                here[self.back[0] == END] = END
            self.back.append(here)

    def routes(self) -> np.ndarray:
        step = FIRST // len(self.back)
        route = (self.hashes >> np.uint64(FIRST))[self.back[0]] << np.uint64(FIRST)
        for k, part in enumerate([*self.back[1:], self.tokens]):
            route |= (self.hashes >> np.uint64(64 - step))[part] << np.uint64(FIRST - step * (k + 1))
        return route


def free_bits(level: int, depth: int) -> np.uint64:
    """Bits of a route that the ``level`` nearest words leave open."""
    return np.uint64(FIRST - FIRST // depth * (level - 1))


def encoded(docs: DataFrame, hold: Column, id_col: str, text_col: str, size: int = TOKENS,
            depth: int = DEPTH) -> DataFrame:
    """Documents end to end, each with its end, in blocks of about ``size`` tokens,
    written: number of the block, numbers of the tokens, ends of the documents, hash
    of each number, positions after a word and quantiles of their routes, ids and
    held-out flags of the documents."""
    rows = docs.select(F.col(id_col).alias("__id"), hold.alias("__held"), text_of(text_col).alias("__text"))
    kind = dict(rows.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        parts, ends, ids, held, total, key_type = [], [], [], [], 0, None
        end, block_no = np.array([END], np.int32), itertools.count(TaskContext.get().partitionId() << 20)

        def block() -> pa.RecordBatch:
            # the end comes first among the numbers and so keeps its own
            used, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            after = Windows(tokens, numbers.array()[used], depth)
            route = np.sort(after.routes()[after.back[0] != END])
            cuts = route[np.arange(CUTS if len(route) else 0) * len(route) // CUTS]
            return pa.RecordBatch.from_pydict({
                "block": pa.array([next(block_no)]), "places": pa.array([len(route)]),
                "cuts": pa.array([cuts.astype("<u8").tobytes()], pa.binary()),
                "tokens": pa.array([packed(tokens[None])], pa.binary()),
                "ends": pa.array([np.array(ends, "<i8").tobytes()], pa.binary()),
                "hashes": pa.array([numbers.array()[used].astype("<u8").tobytes()], pa.binary()),
                "ids": pa.array([ids], pa.list_(key_type)), "held": pa.array([held], pa.list_(pa.bool_()))})
        for b in batches:
            key_type = b.column("__id").type
            for i in range(0, b.num_rows, 256):
                few = b.slice(i, 256)
                for key, hold, text in zip(*(few.column(c).to_pylist() for c in ("__id", "__held", "__text"))):
                    found = words_of(text)
                    parts += [np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)), end]
                    total += len(found) + 1
                    ends.append(total), ids.append(key), held.append(hold)
                    if total >= size:
                        yield block()
                        parts, ends, ids, held, total = [], [], [], [], 0
                        if len(numbers) > WORDS:
                            numbers = Numbers()
        if ends:
            yield block()
    blocks = rows.mapInArrow(
        run, "block long, places long, cuts binary, tokens binary, ends binary, hashes binary, "
             f"ids array<{kind}>, held array<boolean>")
    path = scratch_path(docs.sparkSession, "blocks")
    # a row group for each block: a reader holds the row groups it is in whole
    blocks.write.option("compression", "zstd").option("parquet.block.size", 1 << 20).option(
        "parquet.page.size.row.check.min", 1).parquet(path)
    return docs.sparkSession.read.schema(blocks.schema).parquet(path)


def opened(batches: Iterator[pa.RecordBatch], *more: str):
    """(tokens, ends, hashes, ids, held) of every block, and ``more`` of its columns."""
    def numbers(b, c, i, kind):
        return np.frombuffer(b.column(c)[i].as_buffer(), kind)
    for b in batches:
        for i in range(b.num_rows):
            ends = numbers(b, "ends", i, "<i8")
            tokens = unpacked(b.column("tokens")[i].as_buffer(), 1, ends[-1])[0].view("<i4")
            yield (tokens, ends, numbers(b, "hashes", i, "<u8"),
                   b.column("ids")[i].values if "ids" in b.schema.names else None,
                   np.array(b.column("held")[i].as_py(), bool), *(b.column(c)[i].as_py() for c in more))


def training(ends: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which tokens of a block are of training documents."""
    return np.repeat(~held, np.diff(ends, prepend=0))


def added_up(counts):
    """(key, count) arrays of one task, equal keys added up; emitted when more
    than ``HELD`` keys are held, and at the end."""
    keys, sums, size = [], [], 0

    def merge():
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(k), np.int64)
        np.add.at(total, at, np.concatenate(sums))
        return k, total
    for k, n in counts:
        keys.append(k), sums.append(n)
        size += len(k)
        if size > HELD:
            k, n = merge()
            if len(k) > HELD // 2:
                yield k, n
                k, n = k[:0], n[:0]
            keys, sums, size = [k], [n], len(k)
    if size:
        yield merge()


def word_counts(blocks: DataFrame) -> DataFrame:
    """``(h, c)``: hash and count of every training token, written."""
    def counted(batches: Iterator[pa.RecordBatch]):
        for tokens, ends, hashes, _, held in opened(batches):
            n = np.bincount(tokens[training(ends, held)], minlength=len(hashes))
            at = np.flatnonzero(n)
            yield hashes[at], n[at].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in added_up(counted(batches)):
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "c": pa.array(c)})
    parts = blocks.select(*PLAIN).mapInArrow(run, "h long, c long")
    return written(parts.groupBy("h").agg(F.sum("c").alias("c")), "words")


def columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table of bounded size on the driver; hashes unsigned."""
    table = df.select(*names).toArrow()
    out = [table.column(c).to_numpy() for c in names]
    return [x.view(np.uint64) if c in ("h", "s", "x") else x for c, x in zip(names, out)]


class Head:
    """The frequent words: numbers by falling count, from 1, and log10 of their root
    shares.  ``whole``: no other word can be in a context or a stored successor."""

    def __init__(self, h: np.ndarray, c: np.ndarray, below: float, whole: bool):
        self.h, self.share, self.below, self.whole = h, np.log10((c + 0.5) / below), below, whole
        self.order = np.argsort(-c, kind="stable").astype(np.int32)
        self.number = np.full(len(h) + 1, 0 if whole else OTHER, np.uint32)  # the last: not there
        self.number[self.order] = np.arange(1, len(h) + 1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        return self.number[find(self.h, hashes)]


def borders(blocks: DataFrame, size: int) -> np.ndarray:
    """Routes that divide the positions into buckets of about ``size``, or less if
    there are fewer than tasks, from some quantiles of each block."""
    table = blocks.where("places > 0").select("cuts", "places").toArrow()
    cuts = np.frombuffer(b"".join(table.column("cuts").to_pylist()), "<u8")
    weight = np.repeat(table.column("places").to_numpy() / CUTS, CUTS)
    order = np.argsort(cuts)
    full = np.cumsum(weight[order])
    tasks = session_partitions(blocks.sparkSession)
    n = int(full[-1] / min(size, max(FEW, full[-1] / tasks))) if len(full) else 0
    return np.unique(cuts[order][np.searchsorted(full, np.arange(1, n + 1) * (full[-1] / (n + 1)))]) if n else cuts[:0]


def crossing(bounds: np.ndarray, depth: int) -> list[np.ndarray]:
    """By level: beginnings of routes whose positions lie in more than one bucket."""
    bits = [free_bits(k, depth) for k in range(1, depth + 1)]
    return [np.unique(bounds[bounds << (np.uint64(64) - b) != 0] >> b) for b in bits]


def border_counts(blocks: DataFrame, words: DataFrame, sent, least: int, head_least: int, depth: int) -> DataFrame:
    """``(bucket, k, s, x, n, c)``, written: for each bucket that holds positions of a
    context s of k words on a border, how often x follows it, where that is ``least``
    times or more, and with -k how often s occurs; with k = 0 the words beyond the
    head in it.  ``c``: count of such a word x."""
    spark = blocks.sparkSession
    bounds = sent.value[1]

    def counted(batches: Iterator[pa.RecordBatch]):
        head, bounds, over = sent.value
        for tokens, ends, hashes, _, held in opened(batches):
            number = head.numbers(hashes)
            after, train = Windows(tokens, hashes, depth), training(ends, held)
            route = after.routes()
            ok = np.ones(len(tokens), bool)
            key = np.zeros(len(tokens), np.uint64)
            if not head.whole:
                here = np.flatnonzero((number[tokens] == OTHER) & (after.back[0] != END))
                bucket = np.searchsorted(bounds, route[here], side="right")
                met = np.unique(bucket * len(hashes) + tokens[here])
                yield 0, met // len(hashes), np.zeros(len(met), np.uint64), hashes[met % len(hashes)], np.ones_like(met)
            for k, back in enumerate(after.back, 1):
                ok &= (back != END) & (number[back] != 0) & train
                key = combine(key, hashes[back])
                begin = route >> free_bits(k, depth)
                here = np.flatnonzero(ok & (find(over[k - 1], begin) >= 0))
                _, first, n = np.unique(key[here], return_index=True, return_counts=True)
                at = here[first]
                yield -k, begin[at], key[at], np.zeros(len(at), np.uint64), n
                here = here[number[tokens[here]] != 0]
                _, first, n = np.unique(combine(key[here], hashes[tokens[here]]), return_index=True, return_counts=True)
                at = here[first]
                yield k, begin[at], key[at], hashes[tokens[at]], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, at, s, x, n in counted(batches):
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(np.full(len(n), k, np.int32)), "at": pa.array(at.astype(np.int64)),
                "s": pa.array(s.view(np.int64)), "x": pa.array(x.view(np.int64)), "n": pa.array(n.astype(np.int64))})
    rows = blocks.select(*PLAIN).mapInArrow(run, "k int, at long, s long, x long, n long").groupBy("k", "at", "s", "x").agg(
        F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") <= 0))
    places = []  # buckets of each beginning, a few for each border; Arrow starts no other workers
    for k, begins in enumerate(sent.value[2], 1):
        bits = free_bits(k, depth)
        low = np.searchsorted(bounds, begins << bits, side="right")
        high = np.searchsorted(bounds, (begins << bits) | ((np.uint64(1) << bits) - np.uint64(1)), side="right")
        places += [pa.table({"k": pa.array(np.full(len(low), sign * k, np.int32)), "at": begins.astype(np.int64),
                             "low": low.astype(np.int32), "high": high.astype(np.int32)}) for sign in (1, -1)]
    spread = F.broadcast(spark.createDataFrame(pa.concat_tables(places)))
    out = rows.where("k != 0").join(spread, ["k", "at"]).select(
        F.explode(F.sequence("low", "high")).alias("bucket"), "k", "s", "x", "n")
    if sent.value[0].whole:
        out = out.withColumn("c", F.lit(None).cast("long"))
    else:
        out = out.unionByName(rows.where("k = 0").select(F.col("at").cast("int").alias("bucket"), "k", "s", "x", "n"))
        other = words.where((F.col("c") >= least) & (F.col("c") < head_least)).withColumnRenamed("h", "x")
        out = out.join(other, "x", "left").select("bucket", "k", "s", "x", "n", "c")
    return written(out, "border")


def dealt(blocks: DataFrame, sent, depth: int) -> DataFrame:
    """``(bucket, block, n, data, other)``: the positions of a block in a bucket with
    the words before them, documents and held-out flags, in packed columns, and the
    hashes of words beyond the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, bounds, _ = sent.value
        for tokens, ends, hashes, _, held, block in opened(batches, "block"):
            number = head.numbers(hashes)
            after = Windows(tokens, hashes, depth)
            here = np.flatnonzero((after.back[0] != END) & (number[after.back[0]] != 0))
            route = after.routes()[here]
            order = np.argsort(route)
            here, bucket = here[order], np.searchsorted(bounds, route[order], side="right")
            words = np.stack([back[here] for back in after.back] + [tokens[here]])
            doc = np.searchsorted(ends, here, side="right")
            out = np.empty((depth + 2, len(here)), "<u4")
            out[:-1] = number[words]
            for k in range(1, depth):
                out[k][(out[k - 1] == 0) | (words[k] == END)] = 0
            out[-1] = doc * 2 + held[doc]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(here)]):
                part = out[:, a:b]
                other = hashes[words[:, a:b][part[:-1] == OTHER]]
                rows.append((bucket[a], block, b - a, packed(part), other.astype("<u8").tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i:i + 64]), kinds)],
                                                 names=["bucket", "block", "n", "data", "other"])
    return blocks.select("block", *PLAIN).mapInArrow(run, "bucket int, block long, n int, data binary, other binary")


class Bucket:
    """Positions of a bucket: numbers of the words before them and their own (0: none,
    or in no string), documents by number of the row in ``dealt``, training flags;
    and of the words by number: hash and root probability."""

    def __init__(self, rows: pa.Table, border: pa.Table, head: Head, depth: int):
        sizes, at = rows.column("n").to_numpy(), 0
        data = np.empty((depth + 2, sizes.sum()), "<u4")
        others = [np.frombuffer(x, "<u8") for x in rows.column("other").to_pylist()]
        for n, part in zip(sizes.tolist(), rows.column("data")):
            data[:, at:at + n] = unpacked(part.as_buffer(), depth + 2, n)
            at += n
        self.doc = np.repeat(np.arange(len(sizes)) << 32, sizes)
        self.doc |= data[-1] >> 1
        self.train = data[-1] & 1 == 0
        self.words = data[:-1]
        self.k, s, x, self.n, c = (border.column(i).to_numpy() for i in ("k", "s", "x", "n", "c"))
        self.s, x = s.view(np.uint64), x.view(np.uint64)
        place = find(head.h, x)
        known = (place >= 0) | (self.k < 0)
        other = np.unique(np.concatenate([x[~known], *others]))
        base = len(head.h) + 1
        self.x = np.where(place >= 0, head.number[place], base + np.searchsorted(other, x)).astype(np.int64)
        at = 0
        for n, own in zip(sizes.tolist(), others):
            if len(own):
                part = self.words[:, at:at + n]
                part[part == OTHER] = base + np.searchsorted(other, own)
            at += n
        self.kinds = base + len(other)
        root = np.full(len(other), np.nan)
        root[self.x[~known] - base] = (c[~known] + 0.5) / head.below
        self.head, self.other, self.root_of_other = head, other, root

    def looked_up(self, numbers: np.ndarray, of_head: np.ndarray, of_other: np.ndarray) -> np.ndarray:
        base = len(self.head.h) + 1
        out = np.empty(len(numbers), of_other.dtype)
        own = numbers >= base
        out[own] = of_other[numbers[own] - base]
        out[~own] = of_head[self.head.order[numbers[~own] - 1]]
        return out

    def hash(self, numbers: np.ndarray) -> np.ndarray:
        return self.looked_up(numbers, self.head.h, self.other)

    def root(self, numbers: np.ndarray) -> np.ndarray:
        out = self.looked_up(numbers, self.head.share, self.root_of_other)
        own = numbers <= len(self.head.h)
        out[own] = 10.0 ** out[own]
        return out


class Level:
    """Contexts of one length in a bucket and what follows them."""

    def __init__(self, b: Bucket, k: int, before: Level | None, least: int):
        if before is None:
            here, after, keys = np.arange(len(b.doc), dtype=np.int32), 0, np.zeros(1, np.uint64)
        else:  # a context without stored successors begins no longer one
            here = before.here[before.node[before.context]]
            after, keys = before.context[before.node[before.context]], before.key
        word = b.words[k - 1][here].astype(np.int64)
        if before is not None:
            after = after[word != 0]
        self.here, word = here[word != 0], word[word != 0]
        context, self.context = np.unique(after * b.kinds + word, return_inverse=True)
        self.parent = context // b.kinds
        self.key = combine(keys[self.parent], b.hash(context % b.kinds))
        total = np.bincount(self.context[b.train[self.here]], minlength=len(context))
        x = b.words[-1][self.here].astype(np.int64)
        own = b.k == -k
        order = np.argsort(b.s[own])
        place = find(b.s[own][order], self.key)
        self.border = place >= 0
        total[self.border] = b.n[own][order][place[self.border]]
        # strings of contexts inside the bucket are counted here, those of others were counted before
        use = b.train[self.here] & (x != 0) & ~self.border[self.context]
        string, n = np.unique(self.context[use] * b.kinds + x[use], return_counts=True)
        own, order = b.k == k, np.argsort(self.key)
        place = find(self.key[order], b.s[own])
        more = order[place[place >= 0]] * b.kinds + b.x[own][place >= 0]
        string, n = np.concatenate([string[n >= least], more]), np.concatenate([n[n >= least], b.n[own][place >= 0]])
        order = np.argsort(string)
        self.string, n = string[order], n[order]
        of, token = self.string // b.kinds, self.string % b.kinds
        lower = b.root(token) if before is None else before.p[find(before.string, self.parent[of] * b.kinds + token)]
        kinds = np.bincount(of, minlength=len(context))
        left = total - np.bincount(of, weights=n, minlength=len(context))
        self.node = kinds > 0
        rest = np.where(self.node, (left + DISCOUNT * kinds) / np.maximum(total, 1), 1.0)
        self.p = (n - DISCOUNT) / total[of] + rest[of] * lower
        gain = np.bincount(of, weights=n * np.log(self.p / lower), minlength=len(context)) + left * np.log(rest)
        self.gains = self.node & (gain >= kinds * np.log(np.maximum(total, 1)) / 2)
        self.stay = self.gains.copy()
        self.rest = np.log10(rest)
        place = find(self.string, self.context * b.kinds + x)
        self.hit = place >= 0
        self.value = np.log10(self.p[place[self.hit]] / b.root(x[self.hit]))


def grow(b: Bucket, depth: int, least: int) -> list[Level]:
    """The levels of a bucket's tree; what stays is closed under suffixes."""
    levels: list[Level] = []
    for k in range(1, depth + 1):
        levels.append(Level(b, k, levels[-1] if levels else None, least))
        if not levels[-1].node.any():
            break
    for upper, below in zip(levels[:0:-1], levels[-2::-1]):
        below.stay[upper.parent[upper.stay]] = True
    return levels


def gained(b: Bucket, levels: list[Level]):
    """By position, log10 of its probability at the longest suffix that is a node
    over its root share; ``(key, positions, more)`` of contexts on a border that are
    nodes if they stay elsewhere; keys of those that stay for a longer one here."""
    value, best = np.zeros(len(b.doc)), np.zeros(len(b.doc))
    open_, stay = [], [np.zeros(0, np.uint64)]
    for x in levels:
        own = value[x.here] + x.rest[x.context]
        own[x.hit] = x.value
        best[x.here[x.stay[x.context]]] = own[x.stay[x.context]]
        for i in np.flatnonzero(x.border & x.node & ~x.stay):
            at = np.flatnonzero(x.context == i)
            open_.append((x.key[i], x.here[at], own[at] - value[x.here[at]]))
        stay.append(x.key[x.border & x.stay & ~x.gains])
        value[x.here] = own
    return best, open_, np.concatenate(stay)


def scored(positions: DataFrame, border: DataFrame, sent, least: int, depth: int) -> DataFrame:
    """``(block, u, n, data)``, written: for n documents of a block the gains over the root
    shares; with a context u they count if u stays, which rows without data name."""
    def run(rows: pa.Table, border: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            b = Bucket(rows, border, sent.value[0], depth)
            blocks = rows.column("block").to_pylist()

            def add(u, doc, gain):
                docs, at = np.unique(doc, return_inverse=True)
                sums = np.bincount(at, weights=gain)
                docs, sums = docs[sums != 0], sums[sums != 0]
                cuts = np.searchsorted(docs >> 32, np.arange(len(blocks) + 1)).tolist()
                for block, i, j in zip(blocks, cuts, cuts[1:]):
                    if j > i:
                        halves = sums[i:j].astype("<f8").view("<u4").reshape(-1, 2).T
                        own = np.stack([np.diff(docs[i:j] & 0xFFFFFFFF, prepend=0), *halves])
                        out.append((block, u, j - i, packed(own)))
            best, open_, stay = gained(b, grow(b, depth, least))
            add(None, b.doc, best)
            for key, at, more in open_:
                add(int(key.view(np.int64)), b.doc[at], more)
            out.extend((None, key, None, None) for key in stay.view(np.int64).tolist())
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                        names=["block", "u", "n", "data"])
    found = positions.groupBy("bucket").cogroup(border.groupBy("bucket")).applyInArrow(
        run, "block long, u long, n int, data binary")
    return written(found, "gains")


def by_document(gains: DataFrame) -> DataFrame:
    """``(__uid, __gain)``: the gains that count, added up."""
    stay = gains.where("data is null").select("u").distinct()
    parts = gains.where("data is not null")
    counts = parts.where("u is null").unionByName(
        parts.where("u is not null").join(stay, "u", "left_semi").select(*parts.columns))

    def run(rows: pa.Table) -> pa.Table:
        data = [unpacked(x.as_buffer(), 3, n) for x, n in zip(rows.column("data"), rows.column("n").to_pylist())]
        doc = np.concatenate([np.cumsum(x[0]) for x in data])
        gain = np.concatenate([np.ascontiguousarray(x[1:].T).view("<f8")[:, 0] for x in data])
        docs, at = np.unique(doc, return_inverse=True)
        return pa.table({"__uid": (rows.column("block")[0].as_py() << 20) + docs.astype(np.int64),
                         "__gain": np.bincount(at, weights=gain)})
    return counts.groupBy("block").applyInArrow(run, "__uid long, __gain double")


def head_of(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts, smallest count) of the most frequent words, at most
    ``most``; words met once are never among them, however small the corpus."""
    sizes = {r[0]: r[1] for r in words.groupBy(F.floor(F.log2("c")).alias("k")).count().collect()}  # 64 rows at most
    least = max([1, *sizes]) + 1
    while least > 1 and most >= sizes.get(least - 1, 0):
        least -= 1
        most -= sizes.get(least, 0)
    h, c = columns(words.where(F.col("c") >= 1 << least), "h", "c")
    order = np.argsort(h)
    return h[order], c[order], 1 << least


@contextlib.contextmanager
def shuffles_dropped(spark):
    """Shuffle files of a written table go as soon as it is written."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before) if before else spark.conf.unset(DROP_SHUFFLES)


def score(docs: DataFrame, hold: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
          p_min: float = P_MIN, head_words: int = HEAD_WORDS, bucket: int = BUCKET) -> DataFrame:
    """Per row: id, ``held_out`` (``hold``; other rows are trained on), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities).
    Strings count from twice, or ``p_min`` of the training tokens if that is more."""
    with shuffles_dropped(docs.sparkSession):
        return _score(docs, hold, id_col, text_col, depth, p_min, head_words, bucket)


def _score(docs, hold, id_col, text_col, depth, p_min, head_words, bucket) -> DataFrame:
    spark = docs.sparkSession
    blocks = encoded(docs, hold, id_col, text_col, depth=depth)
    words = word_counts(blocks)
    sums = words.agg(F.sum("c"), F.count("*")).first()
    total, kinds = int(sums[0] or 0), int(sums[1])
    below = total + 0.5 * (kinds + 1)
    least = max(2, math.ceil(p_min * total))
    h, c, head_least = head_of(words, head_words)
    bounds = borders(blocks, bucket)
    sent = spark.sparkContext.broadcast((Head(h, c, below, head_least <= least), bounds, crossing(bounds, depth)))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value[0]
        for tokens, ends, hashes, ids, held, block in opened(batches, "block"):
            root = np.append(head.share, np.nan)[find(head.h, hashes)]  # NaN: not a head word
            base = root[tokens]
            tail = np.isnan(base)
            starts = np.concatenate([[0], ends[:-1]])
            far = np.flatnonzero(tail)
            doc = np.searchsorted(ends, far, side="right")
            pair, tf = np.unique(doc * len(hashes) + tokens[far], return_counts=True)
            cuts = np.searchsorted(pair // len(hashes), np.arange(len(ends) + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([
                pa.array(hashes[pair % len(hashes)].view(np.int64)), pa.array(tf.astype(np.int64))], ["h", "tf"])
            yield pa.RecordBatch.from_pydict({
                "__uid": pa.array((block << 20) + np.arange(len(ends))), id_col: ids, "held_out": pa.array(held),
                "n_tokens": pa.array(ends - starts),
                "__known": pa.array(np.add.reduceat((~tail).astype(np.int64), starts)),
                "__base": pa.array(np.add.reduceat(np.where(tail, 0.0, base), starts)),
                "__tail": pa.ListArray.from_arrays(pa.array(cuts), entries)})
    own = written(blocks.select("block", "ids", *PLAIN).mapInArrow(
        run, f"__uid long, `{id_col}` {kind}, held_out boolean, n_tokens long, __known long, __base double, "
             "__tail array<struct<h: bigint, tf: bigint>>"), "scores")
    border = border_counts(blocks, words, sent, least, head_least, depth)
    gains = by_document(scored(dealt(blocks, sent, depth), border, sent, least, depth))
    entries = own.select("__uid", F.explode("__tail").alias("t")).select("__uid", "t.h", "t.tf")
    found = entries.join(words.where(F.col("c") < head_least), "h", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))
    more = found.groupBy("__uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("__k"),
        F.sum(F.col("tf") * log).alias("__b"))

    def plus(a: Column, b: str) -> Column:
        return a + F.coalesce(b, F.lit(0))
    base = plus(F.col("__base"), "__b")
    return own.drop("__tail").join(more, "__uid", "left").join(gains, "__uid", "left").select(
        F.col(f"`{id_col}`"), "held_out", "n_tokens", plus(F.col("__known"), "__k").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), plus(base, "__gain").alias("score"))


def score_split(docs: DataFrame, modulus: int = 5, remainder: int = 1, id_col: str = "doc_id", **kw) -> DataFrame:
    """``score`` with the rows held out whose ``crc32`` of the id leaves ``remainder``."""
    return score(docs, held_out(id_col, modulus, remainder), id_col, **kw)
