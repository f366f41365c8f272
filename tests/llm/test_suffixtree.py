import math
import random
import re
import zlib
from collections import Counter

import pytest

from prefscan.llm import queries, suffixtree
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE, frame

D = suffixtree.DISCOUNT


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", low) if w] + [None]


def held(i, modulus=5, remainder=1):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


class Brute:
    """The same tree with plain dictionaries and whole contexts."""

    def __init__(self, rows, depth, p_min):
        train = [tokens(t) for i, t in rows if not held(i)]
        self.c = Counter(t for d in train for t in d)
        self.n, v = sum(self.c.values()), len(self.c)
        self.below = self.n + 0.5 * (v + 1)
        least = max(2, math.ceil(p_min * self.n))
        grams = Counter(tuple(d[j - k:j + 1]) for d in train for k in range(1, depth + 1) for j in range(k, len(d)))
        stored = {}
        for g, n in grams.items():
            if n >= least:
                stored.setdefault(g[:-1], {})[g[-1]] = n
        self.rest, self.p = {}, {}
        stay = set()
        for s in sorted(stored, key=len):
            own, total = stored[s], self.c[s[0]] if len(s) == 1 else grams[s]
            self.rest[s] = (total - sum(own.values()) + D * len(own)) / total
            gain = (total - sum(own.values())) * math.log(self.rest[s])
            for x, n in own.items():
                lower = self.p[s[1:], x] if len(s) > 1 else self.root(x)
                self.p[s, x] = (n - D) / total + self.rest[s] * lower
                gain += n * math.log(self.p[s, x] / lower)
            if gain >= len(own) * math.log(total) / 2:
                stay |= {s[k:] for k in range(len(s))}
        self.stay, self.depth = stay, depth

    def root(self, x):
        return (self.c[x] + 0.5) / self.below

    def prob(self, x, history):
        s = next((history[len(history) - k:] for k in range(min(self.depth, len(history)), 0, -1)
                  if history[len(history) - k:] in self.stay), ())
        factor = 1.0
        while s:
            if (s, x) in self.p:
                return factor * self.p[s, x]
            factor, s = factor * self.rest[s], s[1:]
        return factor * self.root(x)

    def row(self, i, text):
        t = tokens(text)
        return (i, held(i), len(t), sum(self.c[w] > 0 for w in t), self.n, sum(math.log10(self.root(w)) for w in t),
                sum(math.log10(self.prob(w, tuple(t[:j]))) for j, w in enumerate(t)))


def check(found, rows, depth=3, p_min=suffixtree.P_MIN):
    model = Brute(rows, depth, p_min)
    found = sorted((tuple(r) for r in found), key=str)
    want = sorted((model.row(i, t) for i, t in rows), key=str)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def made(n=300, seed=4):
    rng = random.Random(seed)
    rows, words = [], ["the", "of", "Cat", "dog", "ran", "é", "日本"] + [f"w{i}" for i in range(60)]
    for i in range(n):
        text = " ".join(rng.choice(words[:7] if rng.random() < 0.7 else words) for _ in range(rng.randrange(40)))
        rows.append((i, text + rng.choice(["", " the cat ran of\tthe dog", "\n the dog ran new" + str(i)])))
    return rows


@pytest.mark.parametrize("depth,p_min,head", [(3, 1e-6, 2_000_000), (2, 0.002, 20), (1, 0.02, 0), (3, 1e-3, 3)])
def test_equals_brute_force(spark, depth, p_min, head):
    rows = made()
    found = suffixtree.score_split(frame(spark, rows).repartition(3), depth=depth, p_min=p_min, head_words=head)
    model = check(found.collect(), rows, depth, p_min)
    assert {len(s) for s in model.stay} == set(range(1, depth + 1))  # contexts of every length stay, others do not
    assert depth < 2 or len(model.stay) < len(model.rest)


def test_query_equals_brute_force_and_beats_the_root(spark, small):
    found = queries.op11_suffix_tree_scores(spark, SF_SMALL).collect()
    check(found, list(small.items()))
    own = [r for r in found if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_probabilities_after_any_history_add_up_to_one():
    model = Brute(made(), 3, 1e-6)
    kinds = [*model.c, "unknown"]  # one share for all unknown words
    for history in [(), ("the",), ("the", "dog"), ("the", "dog", "ran"), ("unseen", "the"), ("unseen",)]:
        assert sum(model.prob(x, history) for x in kinds) == pytest.approx(1, rel=1e-9)


def test_blocks(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"a{i % 50} b{i % 7} the cat " * 3 if i % 9 else None) for i in range(240)]
    table = suffixtree.encoded(frame(spark, rows).repartition(2), F.col("doc_id") % 2 == 0, "doc_id", "text", size=100)
    got = [tuple(x) for x in suffixtree.opened(table.toArrow().to_batches())]
    assert len(got) > 10
    seen = {}
    for numbers, ends, hashes, ids, held in got:
        assert len(numbers) == ends[-1] and len(ends) == len(ids) == len(held) and hashes[0] == suffixtree.END_HASH
        for i, a, b, h in zip(ids.to_pylist(), [0, *ends], ends, held):
            seen[i] = [hashes[x] for x in numbers[a:b]]
            assert numbers[b - 1] == suffixtree.END and h == (i % 2 == 0)
        assert suffixtree.training(ends, held).sum() == sum(len(seen[i]) for i in ids.to_pylist() if i % 2)
    assert {i: len(x) for i, x in seen.items()} == {i: len(tokens(t)) for i, t in rows}
    assert seen[1][:4] == seen[1][4:8] and len(set(seen[1])) == 5


def test_counts_are_added_up_whole(monkeypatch):
    import numpy as np
    monkeypatch.setattr(suffixtree, "HELD", 50)
    rng = random.Random(1)
    parts = [sorted(rng.sample(range(200), 20)) for _ in range(100)]
    want = Counter(k for p in parts for k in p)
    got = Counter()
    for k, n in suffixtree.added_up((np.array(p, np.uint64), np.ones(20, np.int64)) for p in parts):
        assert len(k) == len(set(k.tolist()))
        got.update(dict(zip(k.tolist(), n.tolist())))
    assert got == want and not list(suffixtree.added_up(iter([])))


def test_edges(spark, edge, empty):
    check(suffixtree.score_split(edge).collect(), EDGE)
    assert suffixtree.score_split(empty).count() == 0
    only = [i for i in range(50) if held(i)][:3]
    rows = [(i, "a b c") for i in only]  # nothing to learn from
    check(suffixtree.score_split(frame(spark, rows)).collect(), rows)
