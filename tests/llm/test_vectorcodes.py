import hashlib
import random

import numpy as np
import pytest

from prefscan.llm import vectorcodes


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """In Python's whole numbers, one distance after the other."""
    import math
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[q[k * width:(k + 1) * width] for k in range(parts)] for _, _, q in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

    def near(k, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[k]]
        return far.index(min(far)), min(far)
    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(k, c[k])[0], []).append(c[k])
            for e, own in groups.items():
                books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, label, _), c in zip(kept, cut):
        found = [near(k, c[k]) for k in range(parts)]
        error = sum(d for _, d in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    return sorted(((i, code, err, by_label[label], sha) for i, code, err, label in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, error string")
    return sorted((tuple(r) for r in vectorcodes.digest_columns(df.repartition(3), **kw).collect()), key=str)


@pytest.mark.parametrize("spread", [1.0, 30.0, 30000.0])
def test_equals_whole_number_arithmetic(spark, spread):
    rng = random.Random(spread)
    rows = [(i, [float(np.float32(rng.uniform(-spread, spread))) for _ in range(16)], rng.choice([0, 1, None])) for i in range(70)]
    rows += [(100, None, 1), (101, [None] + [0.0] * 15, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, 1),
             (104, [-float("inf")] * 16, 1), (None, rows[0][1], 1), (3, rows[4][1], 2), (3, rows[4][1], 2)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_ties_and_odd_lengths(spark):
    rows = [(5, [0.5] * 8, 0), (6, [0.5] * 8, 0), (7, [-0.5] * 8, None), (8, [0.0] * 8, None)]
    assert run(spark, rows) == brute(rows)
    odd = [(1, [], 0), (2, [1.0] * 7, 0), (9, [1.0] * 16, 0)]
    assert run(spark, rows + odd) == brute(rows)
    assert run(spark, []) == [] and run(spark, odd[:2]) == []


def test_limbs_are_exact_beyond_a_double():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-(1 << 28), 1 << 28, (40, 8)) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    for bits in (None, 9, 14):
        assert vectorcodes.exact_dots(a, b, bits).tolist() == want
    for n in (1, 2, 8, 64, 1000):
        assert n * (1 << vectorcodes.limb_bits(n)) ** 2 <= 1 << 53


def test_too_large_vectors_are_refused(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, [(1, [1e30] * 8, 0)])
