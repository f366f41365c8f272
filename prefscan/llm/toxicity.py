"""Toxicity from a learned lexicon, misspellings and context windows.

Training (bounded sample): words and word beginnings whose document frequency
is significantly higher in toxic rows enter the lexicon with their log-odds; a
small logistic model turns a document's evidence into a score.

Matching: the lexicon is a trie.  A Levenshtein automaton of one edit
(substitution, insertion, deletion, for terms of ``FUZZY_MIN`` letters or more)
is intersected with it as a lazily built deterministic automaton: its states
are sets of (trie node, edits), so a word costs one table look-up per letter and
usually dies after three.  Digits and signs that stand for letters are undone
first.  Words beginning with a learned beginning match it.  The significant words
of a learned beginning stay in the trie beside it, so that an edit in its first
letters is seen as well.

Context: each hit weighs less between quotation marks or after a reporting
verb in the window before it, and more next to a word of address.

Nulls, empty texts: evidence zero, a low score.  Repeated rows score alike.
Without labelled rows of both classes there is no lexicon and all scores are
the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.llm.labelled import train_sample

SAMPLE = {1: 3000, 0: 9000}
LEXICON_TERMS = 5000
FUZZY_MIN = 5
PREFIXES = range(4, 9)
WINDOW = 8
CACHE_WORDS = 500_000
THRESHOLD = 0.7

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = str.maketrans("013457@$", "oieastas")
_OPEN, _CLOSE = "\"“„«‹‘'(", "\"”“»›’')"
_REPORT = frozenset("said says quoted quote called wrote sagte sagt schrieb zitat dit écrit cité dijo dice escribió".split())
_ADDRESS = frozenset("you your you're ya u du dich dein ihr euch tu toi vous votre tú usted eres vosotros".split())


@dataclass
class Lexicon:
    """``terms[i] = (form, is a beginning)``; ``weights[i] = (exact, misspelled)``."""
    terms: list[tuple[str, bool]]
    weights: list[tuple[float, float]]
    bias: float = 0.0
    model: list[float] = field(default_factory=list)

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    """Trie of the lexicon times the one-edit Levenshtein automaton."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.child: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.begin: dict[int, int] = {}
        for i, (form, prefix) in enumerate(lexicon.terms):
            node = 0
            for ch in form:
                nxt = self.child[node].get(ch)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[node][ch] = nxt
                    self.child.append({})
                node = nxt
            (self.begin if prefix else self.word)[node] = i
        self.words: dict[str, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.table: dict[int, dict[str, int]] = {}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self._state(frozenset())  # number 0 is dead
        self.start = self._state(self._close({(0, 0, -1)}))

    def _close(self, items: set) -> frozenset:
        """Adds a deleted letter, keeps the best of each node, notes beginnings."""
        out: dict[int, int] = {}
        kept = max((p for _, _, p in items), default=-1)
        for node, e, _ in items:
            if node < 0:
                continue
            if e < out.get(node, 9):
                out[node] = e
            if e == 0:
                kept = self.begin.get(node, kept)
                for nxt in self.child[node].values():
                    out[nxt] = min(out.get(nxt, 9), 1)
        best = {(n, e, -1) for n, e in out.items()}
        if kept >= 0:
            best.add((-1, 0, kept))
        return frozenset(best)

    def _state(self, items: frozenset) -> int:
        if items not in self.ids:
            self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.table[len(self.sets) - 1] = {}
        return self.ids[items]

    def _step(self, state: int, ch: str) -> int:
        items = set()
        for node, e, p in self.sets[state]:
            if node < 0:
                items.add((node, e, p))
                continue
            nxt = self.child[node].get(ch)
            if nxt is not None:
                items.add((nxt, e, -1))
            if e == 0:
                items.add((node, 1, -1))  # a letter too many
                for other, to in self.child[node].items():
                    if other != ch:
                        items.add((to, 1, -1))
        found = self._state(self._close(items))
        self.table[state][ch] = found
        return found

    def lookup(self, word: str) -> tuple[int, int] | None:
        """(term, 0 exact / 1 misspelled) of the best match."""
        if len(self.sets) > 200_000:
            self._reset()
        state, table = self.start, self.table
        for ch in word:
            nxt = table[state].get(ch)
            state = self._step(state, ch) if nxt is None else nxt
            if not state:
                return None
        exact = fuzzy = begin = None
        for node, e, p in self.sets[state]:
            if node < 0:
                begin = p
            elif node in self.word:
                term = self.word[node]
                if e == 0:
                    exact = term
                elif len(self.lexicon.terms[term][0]) >= FUZZY_MIN and (fuzzy is None or term < fuzzy):
                    fuzzy = term
        if exact is not None:
            return exact, 0
        if begin is not None:
            return begin, 0
        return None if fuzzy is None else (fuzzy, 1)

    def token(self, raw: str) -> tuple[int, int] | None:
        word = _EDGE.sub("", raw)
        if not word:
            return None
        hit = self.lookup(word)
        plain = word.translate(_SIGNS)
        if hit is None and plain != word and any(c.isalpha() for c in word):
            hit = self.lookup(plain)
            hit = None if hit is None else (hit[0], 1)
        return hit

    def hits(self, words: list[str]) -> list[tuple[int, tuple[int, int]]]:
        cache = self.words
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.token(w)
        return [(i, h) for i, h in enumerate(map(cache.__getitem__, words)) if h is not None]


def context_factor(words: list[str], at: int, quoted: bool) -> float:
    """Less for quotation, more for address, from the window around a hit."""
    before = words[max(0, at - WINDOW):at]
    near = words[max(0, at - 4):at + 5]
    factor = 0.35 if quoted or any(_EDGE.sub("", w) in _REPORT for w in before) else 1.0
    return factor * (1.25 if any(_EDGE.sub("", w) in _ADDRESS for w in near) else 1.0)


def _inside_quotes(words: list[str], at: int) -> bool:
    """An opening mark before and a closing one after, both within the window."""
    opened = None
    for i in range(at, max(-1, at - WINDOW - 1), -1):
        if words[i][0] in _OPEN:
            opened = i
            break
        if i < at and words[i][-1] in _CLOSE:
            return False
    return opened is not None and any(words[i][-1] in _CLOSE or words[i].rstrip(".,;:!?")[-1:] in _CLOSE
                                      for i in range(at, min(len(words), at + WINDOW + 1)) if words[i])


def evidence(matcher: Matcher, text: str) -> list[float]:
    """Features: sum, maximum, rate and misspelled share of the weighted hits."""
    words = text.lower().split()
    hits = matcher.hits(words)
    if not hits:
        return [0.0, 0.0, 0.0, 0.0]
    total = top = fuzzy = 0.0
    weights = matcher.lexicon.weights
    for at, (term, kind) in hits:
        w = weights[term][kind]
        if w > 0:
            w *= context_factor(words, at, _inside_quotes(words, at))
        total, top = total + w, max(top, w)
        fuzzy += w if kind else 0.0
    return [math.log1p(max(0.0, total)), top, total / math.sqrt(len(words)), math.log1p(max(0.0, fuzzy))]


def _log_odds(pos, neg, n_pos, n_neg) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def _g2(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """Likelihood ratio of a document frequency between the classes."""
    share, n = n_pos / (n_pos + n_neg), pos + neg
    return 2 * sum(x * math.log(x / e) for x, e in ((pos, n * share), (neg, n * (1 - share))) if x)


def forms(text: str) -> set[str]:
    """The words of a text, and their beginnings marked by a trailing '*'."""
    out = set()
    for raw in set(text.lower().split()):
        word = _EDGE.sub("", raw)
        if len(word) >= 3 and word.isalpha():
            out.add(word)
            out.update(word[:k] + "*" for k in PREFIXES if k < len(word))
    return out


def learn_terms(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> list[tuple[str, bool, float]]:
    """Significant words and shortest significant beginnings: (form, beginning,
    log-odds).  Words that a chosen beginning covers come on top of the bound."""
    good = {}
    for form, pos, neg in counts:
        odds = _log_odds(pos, neg, n_pos, n_neg)
        if odds > 2.0 and _g2(pos, neg, n_pos, n_neg) > 22:
            good[form] = odds
    out: list[tuple[str, bool, float]] = []
    begins: set[str] = set()
    grown = Counter(f[:k] + "*" for f in good for k in PREFIXES if k < len(f.rstrip("*")))
    for form in sorted((f for f in good if f.endswith("*")), key=lambda f: (len(f), f)):
        stem = form[:-1]
        if not any(stem[:k] in begins for k in range(4, len(stem))) and (grown[form] > 1 or len(stem) == 8):
            begins.add(stem)
            out.append((stem, True, good[form]))
    covered = []
    for form, odds in sorted(good.items()):
        if not form.endswith("*"):
            known = any(form[:k] in begins and good[form[:k] + "*"] >= odds - 0.7 for k in PREFIXES)
            (covered if known else out).append((form, False, odds))
    out = sorted(out, key=lambda t: -t[2])[:LEXICON_TERMS]
    kept = {f for f, prefix, _ in out if prefix}
    out += [t for t in covered if any(t[0][:k] in kept for k in PREFIXES)]
    return sorted(out, key=lambda t: -t[2])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the last column is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - keep @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + keep
        step = np.linalg.solve(h, g)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, hold: Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", sample: dict[int, int] = SAMPLE) -> Lexicon:
    """Learns lexicon and score from at most ``sum(sample.values())`` labelled rows."""
    rows, totals = train_sample(docs, labels, label_col, hold, sample, id_col, text_col)
    rows = rows.persist()  # recomputed from the tables if an executor is lost
    sizes = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        rows.unpersist()
        return Lexicon([], [], bias=totals.get(1, 0) / max(1, sum(totals.values())))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for text, label in zip(b["__text"], b["__label"]):
                for f in forms(text):
                    found.setdefault(f, [0, 0])[label] += 1
            yield pd.DataFrame([(f, p, n) for f, (n, p) in found.items()], columns=["form", "pos", "neg"])
    # the filter leaves what can be significant at all; the sample bounds it
    counts = (rows.mapInPandas(spread, "form string, pos long, neg long").groupBy("form")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .where((F.col("pos") >= 4) & (F.col("pos") * n_neg > 5 * F.col("neg") * n_pos)))
    terms = learn_terms([tuple(r) for r in counts.toLocalIterator()], n_pos, n_neg)
    lexicon = Lexicon([(f, p) for f, p, _ in terms], [(w, w) for _, _, w in terms])

    def misspelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = lexicon.matcher()
        for b in batches:
            found: dict[int, list[int]] = {}
            for text, label in zip(b["__text"], b["__label"]):
                for t in {h[0] for _, h in matcher.hits(text.lower().split()) if h[1]}:
                    found.setdefault(t, [0, 0])[label] += 1
            yield pd.DataFrame([(t, p, n) for t, (n, p) in found.items()], columns=["term", "pos", "neg"])
    seen = {r.term: (r.pos, r.neg) for r in rows.mapInPandas(misspelled, "term int, pos long, neg long")
            .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    for i, (exact, _) in enumerate(lexicon.weights):
        pos, neg = seen.get(i, (0, 0))
        # half of the exact weight until the sample says otherwise (two rows of prior)
        own = _log_odds(pos, neg, n_pos, n_neg) if pos + neg else exact / 2
        mix = (pos + neg) / (pos + neg + 2)
        lexicon.weights[i] = (exact, max(0.0, min(exact, mix * own + (1 - mix) * exact / 2)))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = lexicon.matcher()
        for b in batches:
            yield pd.DataFrame([[*evidence(matcher, t), y] for t, y in zip(b["__text"], b["__label"])],
                               columns=["a", "b", "c", "d", "y"])
    f = rows.mapInPandas(features, "a double, b double, c double, d double, y int").toPandas().to_numpy(float)
    rows.unpersist()
    f = f[np.lexsort(f.T)]  # the same model whatever the task order
    y = f[:, 4]
    weight = np.where(y == 1, totals[1] / n_pos, totals[0] / n_neg)
    lexicon.model = logistic(f[:, :4], y, weight / weight.mean()).tolist()
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score",
          predicted_col: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a score from 0 to 1 and 1 where it reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, model = lexicon.matcher(), lexicon.model
        for b in batches:
            if model:
                x = np.array([evidence(matcher, t or "") for t in b.column(text_col).to_pylist()]).reshape(-1, 4)
                s = 1 / (1 + np.exp(-np.clip(x @ np.array(model[:4]) + model[4], -30, 30)))
            else:
                s = np.full(b.num_rows, lexicon.bias)
            out = {c: b.column(c) for c in b.schema.names if c not in (score_col, predicted_col)}
            out |= {score_col: pa.array(s, pa.float64()), predicted_col: pa.array((s >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out)
    keep = [f for f in docs.schema.fields if f.name not in (score_col, predicted_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
                       + [f"`{score_col}` double", f"`{predicted_col}` int"])
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose score stays below the threshold, with their own columns."""
    scored = score(docs, lexicon, text_col, "__score", "__toxic", threshold)
    return scored.where("__toxic = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
