"""Exact repeats of ``length`` bytes, by column-wise construction of a
multi-document Burrows-Wheeler order with common prefixes.

A collection order of whole texts would need one round per byte of the longest
text, each over the whole collection.  Two facts bound the rounds instead:

* Cutting.  Of every window of ``length`` bytes the k-gram with the smallest
  hash (rightmost on ties) is its anchor.  Equal windows have equal anchors at
  equal places, so windows are compared only within one anchor's class and
  only at one alignment.  All neighbouring windows that share an anchor make
  one segment of at most 2 * length - k bytes.
* Copies.  Equal segments of a class are counted, not compared (partial counts
  before the shuffle); a segment that occurs twice repeats in full.  Classes
  with one segment are done.

What is left, segments that share an anchor but differ somewhere, is built
column by column from the right: each round inserts one symbol per segment,
sorts stably by it within the class (the new order of the suffixes; the symbols
before them are the round's piece of the transform) and derives the common
prefixes of neighbours from the range minima of the last round's.  A window is
repeated where the common prefix with a neighbour reaches ``length``.  The
sequential external files are Spark's sorted shuffle files: a task reads whole
classes in key order and keeps one batch in memory.  A class of more than
``class_limit`` different segments is not gathered in one task: its windows are
counted by 128-bit hash instead, with partial counts before the shuffle.

Nulls: a null text is empty.  Texts shorter than ``length`` lose nothing.
Repeated rows are separate documents, so equal rows of ``length`` bytes or more
lose everything.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscan.llm.common import KEYS, RollingHash, mix64, row_keys, sliding_min, text_of, written
from prefscan.session import materialize, small

LENGTH, GRAM = 400, 64
CLASS_LIMIT = 4096
BLOCK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_PACK = 12  # bits for a distance inside a segment


def anchors(data: np.ndarray, roll: RollingHash, length: int, gram: int):
    """Arrays (anchor hash, segment hash, anchor, first and last window start)."""
    out = []
    width = length - gram + 1
    for block in range(0, max(1, len(data) - length + 1), BLOCK):
        part = data[block:block + BLOCK + length - 1]
        if len(part) < length:
            break
        prefix = roll.prefix(part)
        at = np.arange(len(part) - gram + 1)
        h = mix64(roll.slices(prefix, at, at + gram))
        best = sliding_min((h & ~_LOW) | (_LOW - at.astype(np.uint64)), width)
        place = (_LOW - (best & _LOW)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        lo = np.concatenate([[0], cut])
        hi = np.concatenate([cut - 1, [len(place) - 1]])
        p = place[lo]
        shape = ((p - lo) << 32 | (hi - lo)).astype(np.uint64)
        s = mix64(roll.slices(prefix, lo, hi + length) + mix64(shape + np.uint64(1)))
        out.append((h[p], s, p + block, lo + block, hi + block))
    if not out:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    return [np.concatenate(x) for x in zip(*out)]


def anchor_table(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``(h, s, row keys, place)`` per segment; ``place`` packs the anchor's
    position with its distances to the first and last window start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = RollingHash(11, BLOCK + length)
        for b in batches:
            parts = [[], [], [], [], []]
            for text, k1, k2 in zip(b["__text"], b[KEYS[0]], b[KEYS[1]]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) < length:
                    continue
                h, s, p, lo, hi = anchors(data, roll, length, gram)
                place = (p << 2 * _PACK) | ((p - lo) << _PACK) | (hi - lo)
                for q, x in zip(parts, (h.view(np.int64), s.view(np.int64), np.full(len(h), k1),
                                        np.full(len(h), k2, np.int32), place)):
                    q.append(x)
            if parts[0]:
                yield pd.DataFrame(dict(zip(["h", "s", *KEYS, "place"], map(np.concatenate, parts))))
    return rows.mapInPandas(run, f"h long, s long, {KEYS[0]} long, {KEYS[1]} int, place long")


def _unpack(place):
    low = (1 << _PACK) - 1
    p, left, span = place >> 2 * _PACK, (place >> _PACK) & low, place & low
    return p, p - left, p - left + span


def fetch_segments(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the ``wanted`` segments: ``(h, s, c, n, keys, place, bytes)``."""
    per_row = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("h", "s", "c", "n", "place")).alias("__want"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, k1, k2, want in zip(b["__text"], b[KEYS[0]], b[KEYS[1]], b["__want"]):
                data = text.encode("utf-8", "surrogatepass")
                for w in want:
                    _, lo, hi = _unpack(w["place"])
                    out.append((w["h"], w["s"], w["c"], w["n"], k1, k2, w["place"], data[lo:hi + length]))
                if len(out) > 20000:
                    yield pd.DataFrame(out, columns=["h", "s", "c", "n", *KEYS, "place", "bytes"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["h", "s", "c", "n", *KEYS, "place", "bytes"])
    return rows.join(per_row, KEYS).mapInPandas(
        run, f"h long, s long, c long, n long, {KEYS[0]} long, {KEYS[1]} int, place long, bytes binary")


def columnwise(segments: list[bytes], left: np.ndarray, group: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which windows of each segment repeat within its group.

    Segments are aligned at their anchors (``left`` bytes from their start) and
    ordered by group.  Returns a boolean matrix (segment, window start minus
    anchor plus ``length - gram``)."""
    m, pad = len(segments), length - gram
    columns = pad + length
    absent = 256
    symbols = np.full((m, columns + 1), absent, dtype=np.uint16)
    first = pad - left
    last = np.empty(m, dtype=np.int64)
    for i, s in enumerate(segments):
        symbols[i, first[i]:first[i] + len(s)] = np.frombuffer(s, np.uint8)
        last[i] = first[i] + len(s) - length
    symbols = np.ascontiguousarray(symbols.T)
    order = np.argsort(group, kind="stable")
    group = group.astype(np.uint32)
    prefix = np.zeros(m + 1, dtype=np.int32)  # common prefix of order[i - 1] and order[i]
    found = np.zeros((m, pad + 1), dtype=bool)
    few = group.max(initial=0) < 65536
    for c in range(columns - 1, -1, -1):
        symbol, cls = symbols[c][order], group[order]
        move = np.argsort(symbol, kind="stable")
        inner = cls[move].astype(np.uint16) if few else cls[move]
        move = move[np.argsort(inner, kind="stable")]
        order, symbol, cls = order[move], symbol[move], cls[move]
        same = (symbol[1:] == symbol[:-1]) & (cls[1:] == cls[:-1]) & (symbol[1:] != absent)
        at = np.flatnonzero(same)
        fresh = np.zeros(m + 1, dtype=np.int32)
        if len(at):
            bounds = np.empty(2 * len(at), dtype=np.int64)
            bounds[0::2], bounds[1::2] = move[at] + 1, move[at + 1] + 1
            fresh[at + 1] = np.minimum.reduceat(prefix, bounds)[0::2] + 1
        prefix = fresh
        if c <= pad:
            reach = np.maximum(prefix[:-1], prefix[1:]) >= length
            hit = order[reach]
            found[hit, c] = (c >= first[hit]) & (c <= last[hit])
    return found


def _runs(flags: np.ndarray):
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def compare_classes(segments: DataFrame, length: int, gram: int, batch: int) -> DataFrame:
    """Spans ``(row keys, a, b)`` of the windows that repeat within a class."""
    pad = length - gram

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p, lo, _ = _unpack(pdf["place"].to_numpy())
        group = np.unique(pdf["h"].to_numpy(), return_inverse=True)[1]
        found = columnwise(list(pdf["bytes"]), p - lo, group, length, gram)
        out = []
        for i in np.flatnonzero((pdf["c"].to_numpy() == 1) & found.any(axis=1)):
            a, b = _runs(found[i])
            base = p[i] - pad
            k1, k2 = pdf[KEYS[0]].iat[i], pdf[KEYS[1]].iat[i]
            out += [(k1, k2, base + x, base + y + length) for x, y in zip(a, b)]
        return pd.DataFrame(out, columns=[*KEYS, "a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for b in batches:
            held.append(b)
            count += len(b)
            if count < batch:
                continue
            rows = pd.concat(held, ignore_index=True)
            h = rows["h"].to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last class may go on
            for part in _pieces(rows.iloc[:whole], batch):
                yield solve(part)
            held, count = [rows.iloc[whole:]], len(rows) - whole
        if held and count:
            for part in _pieces(pd.concat(held, ignore_index=True), batch):
                yield solve(part)
    parts = segments.repartition("h").sortWithinPartitions("h")
    return parts.mapInPandas(run, f"{KEYS[0]} long, {KEYS[1]} int, a long, b long")


def _pieces(rows: pd.DataFrame, batch: int) -> Iterator[pd.DataFrame]:
    """Cuts rows sorted by class into pieces of whole classes, about ``batch`` rows each."""
    h = rows["h"].to_numpy()
    start = 0
    while start < len(h):
        end = min(len(h), start + batch)
        if end < len(h):
            first = int(np.searchsorted(h, h[end]))
            end = first if first > start else int(np.searchsorted(h, h[end], side="right"))
        yield rows.iloc[start:end].reset_index(drop=True)
        start = end


def count_windows(segments: DataFrame, length: int) -> DataFrame:
    """The same spans for hot classes: every window by its 128-bit hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = RollingHash(21, 4 * length), RollingHash(22, 4 * length)
        for b in batches:
            for i in range(0, len(b), 200):
                parts = []
                for k1, k2, c, place, data in b[[*KEYS, "c", "place", "bytes"]].iloc[i:i + 200].itertuples(index=False):
                    d = np.frombuffer(data, np.uint8)
                    at = np.arange(len(d) - length + 1)
                    _, lo, _ = _unpack(place)
                    x, y = (mix64(r.slices(r.prefix(d), at, at + length)).view(np.int64) for r in (one, two))
                    parts.append(pd.DataFrame({"x": x, "y": y, KEYS[0]: k1, KEYS[1]: np.int32(k2), "a": at + lo, "c": c}))
                yield pd.concat(parts)
    w = segments.mapInPandas(run, f"x long, y long, {KEYS[0]} long, {KEYS[1]} int, a long, c long")
    seen = materialize(w.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"))
    # not shuffled if the repeated windows are counted to be few; a hot one is split otherwise
    return w.where("c = 1").join(small(seen, 64), ["x", "y"]).select(*KEYS, "a", (F.col("a") + length).alias("b"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, class_limit: int = CLASS_LIMIT) -> DataFrame:
    """``(row keys, a, b)``: byte spans covered by a repeated window; they may overlap."""
    if not 1 <= length - gram < 1 << _PACK:
        raise ValueError("the anchor must be shorter than the window")
    rows = docs.select(*[c.alias(k) for k, c in row_keys(id_col, text_col).items()], text_of(text_col).alias("__text"))
    table = written(anchor_table(rows, length, gram), "anchors")
    # the joins below read both sides as they were written, so that a hot key can be split
    shared = materialize(table.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    table = materialize(table.join(shared, "h", "left_semi"))
    counts = materialize(table.groupBy("h", "s").agg(
        F.count("*").alias("c"), F.min(F.struct(*KEYS, "place")).alias("at")))
    full = table.join(counts.where("c > 1").select("h", "s"), ["h", "s"], "left_semi").select(*KEYS, "place")
    kinds = materialize(counts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = counts.join(kinds, "h").select("h", "s", "c", "n", "at.*")
    segments = written(fetch_segments(rows, wanted, length), "segments")
    low = (1 << _PACK) - 1
    start = F.shiftright("place", 2 * _PACK) - F.shiftright("place", _PACK).bitwiseAND(low)
    return (full.select(*KEYS, start.alias("a"), (start + F.col("place").bitwiseAND(low) + length).alias("b"))
            .unionByName(compare_classes(segments.where(F.col("n") <= class_limit), length, gram, class_limit))
            .unionByName(count_windows(segments.where(F.col("n") > class_limit), length)))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the spans (touching spans are one run)."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_rows(docs: DataFrame, fn, schema, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``fn(batch, kept, runs)`` over all rows (Arrow record batches), with the
    bytes kept and the runs removed of each row."""
    spans = repeated_spans(docs, id_col, text_col, **kw).groupBy(*KEYS).agg(
        F.collect_list(F.struct("a", "b")).alias("__spans"))
    keyed = docs.withColumns(row_keys(id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, runs = [], []
            for text, spans in zip(b.column(text_col).to_pylist(), b.column("__spans").to_pylist()):
                data = b"" if text is None else text.encode("utf-8", "surrogatepass")
                cut = [] if spans is None else merge_spans(spans)
                ends = [0, *[y for _, y in cut]]
                kept.append(b"".join(data[x:y] for x, y in zip(ends, [*[x for x, _ in cut], len(data)])))
                runs.append(cut)
            yield fn(b, kept, runs)
    return keyed.join(spans, KEYS, "left").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
                   **kw) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text_col``; a character that
    loses some of its bytes goes whole, and ``length_col``, if there, counts the
    code points left.  Rows and other columns stay; a null text stays null."""
    columns = docs.columns

    def fn(b, kept, runs):
        out = {c: b.column(c) for c in columns}
        texts = [t if not r else k.decode("utf-8", "ignore")
                 for t, k, r in zip(out[text_col].to_pylist(), kept, runs)]
        if length_col in out:
            out[length_col] = pa.array([n if not r else len(t) for n, t, r in zip(
                out[length_col].to_pylist(), texts, runs)], out[length_col].type)
        out[text_col] = pa.array(texts, out[text_col].type)
        return pa.RecordBatch.from_pydict(out)
    return dedup_rows(docs, fn, docs.schema, id_col, text_col, **kw)


def digest_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per row: id, ``n_bytes, n_removed, n_spans, kept_sha256``."""
    def fn(b, kept, runs):
        removed = [sum(y - x for x, y in r) for r in runs]
        return pa.RecordBatch.from_pydict({
            id_col: b.column(id_col),
            "n_bytes": pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array([len(r) for r in runs], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})
    kind = dict(docs.dtypes)[id_col]
    return dedup_rows(docs.select(id_col, text_col), fn, f"`{id_col}` {kind}, n_bytes long, n_removed long, "
                      "n_spans long, kept_sha256 string", id_col, text_col, **kw)
