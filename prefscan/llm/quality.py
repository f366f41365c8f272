"""Quality by a factorisation machine.

Inputs of a document: its distinct words hashed to ``WORD_BITS`` (square roots
of their counts, scaled to length one), statistics of its structure cut into
ranges (symbols, case, digits, repeats, lines, word lengths, function words)
and what the text itself says of its make-up (length range, letters used).
Every pair of inputs interacts through vectors of ``RANK`` numbers; the score

    b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

takes one pass over the inputs (the sum-of-squares identity), not one per pair.
Training (Adam, log loss, early stop on a fifth of the rows) runs on a bounded
sample of labelled rows; scoring is a pass over all texts.

Nulls and empty texts have no words, only structure, and get a score too.
Repeated rows score alike.  Without rows of both classes every score is the
share of label 1 (0 without any label).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from prefscan.llm.labelled import train_sample

SAMPLE = {1: 3000, 0: 3000}
WORD_BITS = 15
WORDS = 1 << WORD_BITS
RANGES = 12
RANK = 8
THRESHOLD = 0.7
CACHE_WORDS = 500_000

#: class of each byte: 1 sign other than common punctuation, 2 upper case, 3 digit, 4 not ASCII, 5 sentence end
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[c for c in range(33, 127) if chr(c) not in ".,;:!?'\"()-_" and not chr(c).isalnum()]] = 1
_KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 2, 3, 4
_KINDS[[46, 33, 63]] = 5
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_FUNCTION = frozenset("the of and to in is a that for it de la le les et des que un une en der die und das ist von el los y".split())
#: lower edges of the ranges of each statistic
EDGES = {
    "symbols": [1e-9, .002, .005, .01, .02, .04, .06, .09, .13, .2, .3],
    "sign_runs": [1e-9, .001, .002, .005, .01, .02, .04, .08, .15, .25, .4],
    "upper": [1e-9, .005, .01, .02, .03, .05, .1, .2, .35, .5, .7],
    "digits": [1e-9, .001, .002, .005, .01, .02, .04, .08, .15, .25, .4],
    "distinct": [.02, .05, .1, .2, .3, .4, .5, .6, .7, .8, .95],
    "top_word": [.02, .04, .06, .08, .1, .15, .2, .3, .4, .6, .8],
    "neighbours": [1e-9, .005, .01, .02, .05, .1, .2, .3, .5, .7, .9],
    "line_words": [2, 4, 8, 12, 20, 30, 50, 80, 120, 200, 400],
    "same_lines": [1e-9, .02, .05, .1, .2, .3, .4, .5, .6, .8, .95],
    "sentence_words": [2, 4, 6, 8, 10, 13, 17, 25, 40, 80, 200],
    "word_length": [2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9, 12],
    "function": [.01, .03, .06, .1, .15, .2, .25, .3, .4, .5, .7],
    "length": [50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200],
    "accents": [1e-9, .005, .01, .02, .03, .04, .06, .08, .1, .15, .3],
}
NAMES = list(EDGES)
SIZE = WORDS + RANGES * len(NAMES)
_CUTS = [np.array(EDGES[n]) for n in NAMES]


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _KINDS[data]
    of = np.bincount(kinds, minlength=6)
    runs = int(np.count_nonzero((data[1:] == data[:-1]) & _SIGNS[data[1:]]))
    ends = int(np.count_nonzero((kinds[:-1] == 5) & (data[1:] <= 32))) + int(len(kinds) > 0 and kinds[-1] == 5)
    n, m = max(1, len(data)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = sum(map(eq, words, words[1:]))
    return [of[1] / n, runs / n, of[2] / n, of[3] / n, len(counts) / m, max(counts.values(), default=0) / m, pairs / m,
            len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, ends),
            sum(map(len, words)) / m, sum(counts[w] for w in _FUNCTION) / m, len(text), of[4] / n]


class Features:
    """Input numbers and values of a text; remembers the hashes of words."""

    def __init__(self):
        self.slots: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        counts = Counter(words)
        slots = self.slots
        if len(slots) > CACHE_WORDS:
            slots.clear()
        for w in [w for w in counts if w not in slots]:
            slots[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - WORD_BITS)
        at = np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts))
        x = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        x /= max(1e-9, float(np.sqrt((x * x).sum())))
        own = [WORDS + i * RANGES + int(np.searchsorted(c, v, side="right"))
               for i, (c, v) in enumerate(zip(_CUTS, statistics(text, words, counts)))]
        return np.concatenate([at, own]), np.concatenate([x, np.full(len(own), 1 / np.sqrt(len(own)))])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        s = v.sum(axis=0)
        return self.bias + float(self.linear[at] @ x + 0.5 * (s @ s - (v * v).sum()))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 30,
          rate: float = 0.02, ridge: float = 1e-5, seed: int = 5) -> Model:
    rng = np.random.Generator(np.random.PCG64(seed))
    linear, factors = np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK))
    prior = float((weight * y).sum() / weight.sum())
    bias = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    state = [np.zeros(SIZE), np.zeros(SIZE), np.zeros((SIZE, RANK)), np.zeros((SIZE, RANK))]
    order = rng.permutation(len(rows))
    test, fit = order[:len(rows) // 5], order[len(rows) // 5:]
    best, best_loss, step, patience = None, np.inf, 0, 0
    for _ in range(epochs):
        for i in range(0, len(fit), 64):
            part = fit[i:i + 64]
            sizes = [len(rows[j][0]) for j in part]
            at = np.concatenate([rows[j][0] for j in part])
            x = np.concatenate([rows[j][1] for j in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            v = factors[at] * x[:, None]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            s = np.add.reduceat(v, starts, axis=0)
            z = bias + np.add.reduceat(linear[at] * x, starts) + 0.5 * (
                (s * s).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
            err = weight[part] * (_sigmoid(z) - y[part]) / len(part)
            step += 1
            slots, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, err[doc] * x, len(slots)) + ridge * linear[slots]
            pull = (err[doc] * x)[:, None] * (s[doc] - v)
            gv = np.stack([np.bincount(inverse, pull[:, f], len(slots)) for f in range(RANK)], axis=1)
            gv += ridge * factors[slots]
            bias -= rate * float(err.sum())
            for value, g, m, q in ((linear, gw, *state[:2]), (factors, gv, *state[2:])):
                m[slots] = 0.9 * m[slots] + 0.1 * g
                q[slots] = 0.99 * q[slots] + 0.01 * g * g
                value[slots] -= rate * m[slots] / (np.sqrt(q[slots]) + 1e-8)
        model = Model(bias, linear, factors)
        p = _sigmoid(np.array([model.logit(*rows[j]) for j in test]))
        loss = -float(np.mean(weight[test] * (y[test] * np.log(p + 1e-9) + (1 - y[test]) * np.log(1 - p + 1e-9))))
        if loss < best_loss - 1e-4:
            best, best_loss, patience = Model(bias, linear.copy(), factors.copy()), loss, 0
        else:
            patience += 1
            if patience >= 4:
                break
    return best or Model(bias, linear, factors)


def fit(docs: DataFrame, labels: DataFrame, hold: Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample: dict[int, int] = SAMPLE) -> Model:
    """Trains on at most ``sum(sample.values())`` labelled rows."""
    rows, totals = train_sample(docs, labels, label_col, hold, sample, id_col, text_col)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for b in batches:
            found = [features(t) for t in b["__text"]]
            yield pd.DataFrame({"at": [a.astype(np.int32).tobytes() for a, _ in found],
                                "x": [x.astype(np.float32).tobytes() for _, x in found], "y": b["__label"]})
    got = [(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float), r.y)
           for r in rows.mapInPandas(extract, "at binary, x binary, y int").toLocalIterator()]
    got.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # the same model whatever the task order
    y = np.array([r[2] for r in got], dtype=float)
    if len(set(y)) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        logit = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return Model(logit, np.zeros(SIZE), np.zeros((SIZE, RANK)))
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    return train([(a, x) for a, x, _ in got], y, weight / weight.mean())


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
          predicted_col: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a score from 0 to 1 and 1 where it reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), Model(*shared.value)
        for b in batches:
            s = _sigmoid(np.array([own.logit(*features(t or "")) for t in b.column(text_col).to_pylist()], dtype=float))
            out = {c: b.column(c) for c in b.schema.names if c not in (score_col, predicted_col)}
            out |= {score_col: pa.array(s, pa.float64()), predicted_col: pa.array((s >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out)
    keep = [f for f in docs.schema.fields if f.name not in (score_col, predicted_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
                       + [f"`{score_col}` double", f"`{predicted_col}` int"])
    return docs.mapInArrow(run, schema)
