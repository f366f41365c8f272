"""Source divergence audit: which terms set a source apart from its language.

Counts.  One pass over the texts: a task counts terms, and documents that hold
them, per (lang, source) and emits partial counts whenever it holds ``HELD`` of
them, so that a hot source is added up before the shuffle.  A language keeps
the terms of at least ``min_docs`` of its documents.  Shares are whole numbers,
``p = 1 + floor(1e9 (count + 2) / (N + 2 V))``, divided in three steps of 1,000
so that counts of many digits stay exact; ``f = (p - q)^2 div (p + q)``.

Terms.  With p > q, f grows with the group's count and falls with the
language's, and ties go to the earlier term.  A term that ``k`` others dominate
(count no lower, language count no higher, earlier in UTF-8) is therefore not
among the first k.  Each partition, sorted by group and term, keeps its
skyband: the terms that fewer than k others dominate.  In that order all
dominators come before a term, so one pass decides for good.  It is enough to
count dominators inside the skyband, as the first k of a term's dominators are
always in it.  Skybands are merged per salted group, then per group, in the
same way; what is left is ranked exactly.

Pairs.  Sources of a language are dealt into blocks of about ``BLOCK`` by hash;
each term's shares go to the pairs of blocks that they touch, under a salt, and a
task adds up f for all pairs of a block pair, term by term.  Terms that no
source of a block pair holds are alike, so they are multiplied out.

Nulls in text, lang and source are ''.  A group without terms has count 0
everywhere; a language without kept terms has V = 0, pairs of value 0 and no
terms.  Repeated rows count each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefscan.llm.common import session_partitions, text_of, written
from prefscan.session import small

MIN_DOCS, TOP, UNIT = 10, 10, 1000  # shares are in units of 1 / 1000^3
HELD = 400_000
BLOCK = 64
#: skyband members that later terms are compared with; more of them only prune less
COMPARED = 20_000
GROUP = ["lang", "source"]

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``(lang, source, term, count, docs)``; a row with a null term per group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (n, d) in counts.items():
                own = list(n)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * (len(own) + 1)), "source": pa.array([source] * (len(own) + 1)),
                    "term": pa.array([None, *own], pa.binary()).cast(pa.string()),
                    "count": pa.array([0, *n.values()], pa.int64()),
                    "docs": pa.array([0, *[d[t] for t in own]], pa.int64())})
            counts.clear()
        for b in batches:
            for text, lang, source in zip(*(b.column(c).to_pylist() for c in ("text", *GROUP))):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                d.update(set(found))
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from flush()
        yield from flush()
    rows = docs.select(text_of(text_col).alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))
    partial = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return partial.groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 count / total)`` for count <= total, three digits a step."""
    p, left = F.lit(0).cast("long"), count
    for _ in range(3):
        p, left = p * UNIT + F.call_function("div", left * UNIT, total), (left * UNIT) % total
    return p + 1


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, source, term, count, total, first)`` of the kept terms, written;
    ``first`` marks one row of each (lang, term)."""
    whole = Window.partitionBy("lang", "term")  # at most one row per source
    return written(counts.where("term is not null").select(
        *GROUP, "term", "count", F.sum("count").over(whole).alias("total"), F.sum("docs").over(whole).alias("__docs"),
        (F.row_number().over(whole.orderBy("source")) == 1).cast("long").alias("first"),
    ).where(F.col("__docs") >= min_docs).drop("__docs"), "terms")


def group_table(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Per occurring group: its N, the language's N and V, the share of a term it
    lacks, and its block among the language's; written."""
    groups = counts.where("term is null").select(*GROUP)
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum("first").alias("v")), "lang", "left")
    own = kept.groupBy(*GROUP).agg(F.sum("count").alias("n"))
    blocks = F.ceil(F.col("sources") / BLOCK).cast("long")
    table = groups.join(own, GROUP, "left").join(small(langs, 256), "lang").na.fill(0, ["n", "lang_n", "v"])
    empty = F.when(F.col("v") > 0, share(F.lit(2).cast("long"), F.greatest(F.col("n") + 2 * F.col("v"), F.lit(1))))
    return written(table.select(*GROUP, "n", "lang_n", "v", F.coalesce(empty, F.lit(1)).alias("absent"),
                                blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block")), "groups")


def changes(b, columns: list[str]) -> np.ndarray:
    """Positions of a sorted batch or table at which one of the columns changes."""
    flags = np.zeros(max(b.num_rows - 1, 0), bool)
    for c in columns:
        x = b.column(c)
        flags |= np.asarray(pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) if isinstance(x, pa.Array)
                            else pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(), bool)
    return np.flatnonzero(flags) + 1


def skyband(rows: DataFrame, k: int, block: int = 512) -> DataFrame:
    """The rows of each partition that fewer than ``k`` others of the partition
    and group dominate.  Rows: lang, source, term, count, total, and any more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, high, low = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            count, total = np.asarray(b.column("count")), np.asarray(b.column("total"))
            keep = np.zeros(b.num_rows, bool)
            cuts = [0, *changes(b, GROUP), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                here = tuple(b.column(c)[lo].as_py() for c in GROUP)
                if here != group:
                    group, high, low = here, high[:0], low[:0]
                for s in range(lo, hi, block):
                    c, t = count[s:min(s + block, hi)], total[s:min(s + block, hi)]
                    by = ((high >= c[:, None]) & (low <= t[:, None])).sum(axis=1)
                    by += np.tril((c >= c[:, None]) & (t <= t[:, None]), -1).sum(axis=1)
                    keep[s:s + len(c)] = by < k
                    high = np.concatenate([high, c[by < k]])[:COMPARED]
                    low = np.concatenate([low, t[by < k]])[:COMPARED]
            yield b.filter(pa.array(keep))
    return rows.sortWithinPartitions(*GROUP, "term").mapInArrow(run, rows.schema)


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def top_terms(shares: DataFrame, k: int, salts: int) -> DataFrame:
    """The first ``k`` terms of each group by value, with their ranks."""
    rows = shares.where("p > q").select(*GROUP, "term", "count", "total", "p", "q")
    band = skyband(rows, k)
    band = skyband(band.repartition(*GROUP, F.pmod(F.xxhash64("term"), F.lit(salts))), k)
    band = skyband(band.repartition(*GROUP), k)
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    return (band.select(*GROUP, F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


class PairSums:
    """Sums of f over all pairs of the sources of two blocks (or of one)."""

    def __init__(self, lang: str, i: int, j: int, salt: int):
        self.lang, self.i, self.j, self.salt = lang, i, j, salt
        self.names: tuple[list, list] = ([], [])
        self.absent: tuple[list, list] = ([], [])
        self.seen, self.v, self.sums = 0, 0, None

    def head(self, source: str, block: int, absent: int, v: int) -> None:
        side = int(block != self.i)
        self.names[side].append(source), self.absent[side].append(absent)
        self.v = v

    def _start(self) -> None:
        if self.sums is None:
            self.place = {s: i for i, s in enumerate(self.names[0] + self.names[1])}
            self.zero = np.array(self.absent[0] + self.absent[1], np.int64)
            self.right = len(self.names[0]) if self.i != self.j else 0  # where the second block begins
            self.sums = np.zeros((len(self.names[0]), len(self.zero) - self.right), np.int64)

    def _f(self, p: np.ndarray):
        """Per source of the first block: its f with each source of the second, by term."""
        for a in range(len(self.names[0])):
            q = p[:, self.right:]
            d = p[:, a:a + 1] - q
            yield a, d * d // np.maximum(p[:, a:a + 1] + q, 1)

    def add(self, term: np.ndarray, source: list[str], p: np.ndarray) -> None:
        """Rows of whole terms; ``term`` numbers them from 0."""
        self._start()
        table = np.repeat(self.zero[None, :], term[-1] + 1, axis=0)
        table[term, [self.place[s] for s in source]] = p
        for a, f in self._f(table):
            self.sums[a] += f.sum(axis=0)
        self.seen += len(table)

    def rows(self) -> tuple[list, list, list]:
        """(a, b, sum): terms that are not seen here count once, at salt 0."""
        self._start()
        rest = (self.v if self.salt == 0 else 0) - self.seen
        for a, f in self._f(self.zero[None, :]):
            self.sums[a] += rest * f[0]
        found = [(x, y, int(self.sums[a, b])) for a, x in enumerate(self.names[0])
                 for b, y in enumerate(self.names[1] if self.i != self.j else self.names[0]) if self.i != self.j or a < b]
        return tuple(zip(*found)) if found else ((), (), ())


def pair_values(shares: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """``(lang, source, item, value)`` for all ordered pairs of a language's sources."""
    keys = ["lang", "i", "j", "salt"]
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def to_blocks(df: DataFrame, salt: Column, term: Column, p: str, v: Column) -> DataFrame:
        return df.select("lang", "source", "block", other.alias("o"), salt.alias("salt"), term.alias("term"),
                         F.col(p).alias("p"), v.alias("v")).select(
            "lang", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "salt", "term", "source",
            "block", "p", "v")
    rows = to_blocks(shares, F.pmod(F.xxhash64("term"), F.lit(salts)), F.col("term"), "p", F.lit(0).cast("long"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    heads = to_blocks(salted, F.col("salt"), F.lit(""), "absent", F.col("v"))  # no term is "": heads come first
    dealt = rows.unionByName(heads).repartition(*keys).sortWithinPartitions(*keys, "term", "source")

    def out(state: PairSums | None):
        a, b, s = state.rows() if state else ((), (), ())
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([state.lang if state else ""] * len(a), pa.string()), "a": pa.array(a, pa.string()),
            "b": pa.array(b, pa.string()), "s": pa.array(s, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, None
        for b in _with_end(batches):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                if held.num_rows == 0:
                    continue
                held = held.combine_chunks()
                cuts = changes(held, [*keys, "term"])
                whole = int(cuts[-1]) if len(cuts) else 0  # the last term may go on
            else:
                whole = held.num_rows if held is not None else 0
            part, held = (held.slice(0, whole), held.slice(whole)) if held is not None else (None, None)
            if not whole:
                continue
            ends = [0, *changes(part, keys), whole]
            for lo, hi in zip(ends, ends[1:]):
                own = part.slice(lo, hi - lo)
                here = tuple(own.column(c)[0].as_py() for c in keys)
                if state is None or here != (state.lang, state.i, state.j, state.salt):
                    if state is not None:
                        yield out(state)
                    state = PairSums(*here)
                heads = int(pc.sum(pc.equal(own.column("term"), "")).as_py())
                for x in own.slice(0, heads).to_pylist():
                    state.head(x["source"], x["block"], x["p"], x["v"])
                own = own.slice(heads)
                if own.num_rows:
                    number = np.zeros(own.num_rows, np.int64)
                    number[changes(own, ["term"])] = 1
                    state.add(np.cumsum(number), own.column("source").to_pylist(), own.column("p").to_numpy())
        yield out(state)
    sums = dealt.mapInArrow(run, "lang string, a string, b string, s long").groupBy("lang", "a", "b").agg(
        F.sum("s").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                              F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    return sums.select("lang", "value", sides).select("lang", "x.source", "x.item", "value")


def _with_end(batches: Iterator[pa.RecordBatch]):
    yield from batches
    yield None


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` compares each
    source with every other of its language, part ``term`` gives the ``top``
    terms that it holds more of than its language."""
    counts = written(term_counts(docs, text_col, lang_col, source_col), "counts")
    kept = kept_terms(counts, min_docs)
    groups = group_table(counts, kept)
    salts = session_partitions(docs.sparkSession)
    shares = kept.join(small(groups, 256), GROUP).select(
        *GROUP, "block", "blocks", "term", "count", "total",
        share(F.col("count") + 2, F.col("n") + 2 * F.col("v")).alias("p"),
        share(F.col("total") + 2, F.col("lang_n") + 2 * F.col("v")).alias("q"))
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")  # the other sources of the language
    pairs = pair_values(shares, groups, salts).withColumn("rank", F.row_number().over(order))
    columns = [*GROUP, "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        top_terms(shares, top, salts).withColumn("part", F.lit("term")).select(*columns))
