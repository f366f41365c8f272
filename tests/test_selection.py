"""Selection edge cases (FIXTURES C) and the exact best-pair rule against a
brute-force scan of all pairs."""

import math
import random

from pyspark.sql import functions as F

from prefscan.operators import selection

D5 = ("example_id bigint, prompt string, truncated_chosen array<string>, truncated_rejected array<string>, "
      "chosen_scores array<double>, rejected_scores array<double>, chosen_lengths array<int>, "
      "rejected_lengths array<int>")


def d5(spark, rows):
    out = []
    for i, (cs, rs) in enumerate(rows):
        out.append((i, f"p{i}", [f"c{i}_{j}" for j in range(len(cs))], [f"r{i}_{j}" for j in range(len(rs))],
                    cs, rs, [2] * len(cs), [3] * len(rs)))
    return spark.createDataFrame(out, D5)


def brute(cs, rs):
    best, pair = 0.0, None
    for i, c in enumerate(cs):
        for j, r in enumerate(rs):
            w = c - r
            if w > best:
                best, pair = w, (i, j)
    return best, pair


def test_best_pair_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(200):
        cs = [rng.choice([0.1, 0.2, 0.3, -0.1, float("nan")]) for _ in range(rng.randint(1, 4))]
        rs = [rng.choice([0.1, 0.0, 0.3, -0.2, float("nan")]) for _ in range(rng.randint(1, 4))]
        rows.append((cs, rs))
    got = {r["example_id"]: r for r in selection.best_candidate_pair(d5(spark, rows)).collect()}
    for i, (cs, rs) in enumerate(rows):
        best, pair = brute(cs, rs)
        r = got[i]
        if pair is None:
            assert r["best_w"] is None or not (r["best_w"] > 0)
        else:
            assert math.isclose(r["best_w"], best) and (r["i_c"], r["i_r"]) == pair


def test_all_non_positive_gives_empty(spark):
    rows = [([0.1], [0.2]), ([0.0], [0.0])]
    assert selection.select_top_pairs(d5(spark, rows), 0.5).count() == 0


def test_nan_dropped_and_quantile_rounds_up(spark):
    rows = [([1.0], [0.0]), ([float("nan")], [0.0]), ([0.5], [0.0]), ([0.2], [0.0])]
    top = selection.select_top_pairs(d5(spark, rows), 0.5).orderBy("rank").collect()
    # 3 positive pairs, ceil(0.5 * 3) = 2 kept, the largest first, weight 1.0 at the top
    assert [r["example_id"] for r in top] == [0, 2]
    assert top[0]["weight"] == 1.0


def test_single_row_and_ties(spark):
    top = selection.select_top_pairs(d5(spark, [([1.0], [0.0])]), 0.1).collect()
    assert len(top) == 1 and top[0]["rank"] == 1
    tie = selection.select_top_pairs(d5(spark, [([1.0], [0.0])] * 3), 0.5).orderBy("rank").collect()
    assert [r["example_id"] for r in tie] == [0, 1]


def test_quantile_report_lower_nearest(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])],
                               "example_id bigint, weight double")
    got = {r["label"]: r["value"] for r in selection.quantile_report(df).collect()}
    ws = sorted([5, 1, 4, 2, 3])
    assert got["50%"] == ws[int(0.5 * 4)]
    assert got["99%"] == ws[int(0.99 * 4)]
    assert got["smallest"] == 1


def test_selection_is_invariant_to_row_order(spark):
    rng = random.Random(3)
    rows = [([round(rng.uniform(-1, 1), 3)], [round(rng.uniform(-1, 1), 3)]) for _ in range(300)]
    base = d5(spark, rows)
    a = [(r["example_id"], r["rank"]) for r in selection.select_top_pairs(base, 0.2).collect()]
    shuffled = base.repartition(7, F.rand(11))
    b = [(r["example_id"], r["rank"]) for r in selection.select_top_pairs(shuffled, 0.2).collect()]
    assert sorted(a) == sorted(b) and len(a) == math.ceil(0.2 * sum(1 for c, r in rows if c[0] - r[0] > 0))


def test_plain_weights_decide_the_cut(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5000000002), (3, 0.1)], "example_id bigint, weight double")
    top = selection.top_quantile(df, 0.3).collect()
    assert [(r["example_id"], r["rank"]) for r in top] == [(2, 1)]


def test_a_large_cut_is_a_distributed_rank(spark):
    rng = random.Random(9)
    rows = [([round(rng.uniform(0, 1), 2)], [0.0]) for _ in range(200)]
    pos = selection.positive_weights(d5(spark, rows))
    want = sorted(((-r["weight"], r["example_id"]) for r in pos.collect()))[:math.ceil(0.3 * pos.count())]
    top = selection.top_quantile(pos, 0.3)
    assert sorted((r["rank"], r["example_id"]) for r in top.collect()) == [(i + 1, e) for i, (_, e) in enumerate(want)]
    assert "GlobalLimit" not in top._jdf.queryExecution().optimizedPlan().toString()
