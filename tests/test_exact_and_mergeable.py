"""Exact p-values by enumeration, the mergeable best pair, capped samples and
quantiles, each against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from prefscan.operators import distributions, filters, selection


def ks_d(a, b):
    values = sorted({*a, *b})
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in values)


@pytest.mark.parametrize("n1,n2", [(1, 1), (2, 3), (4, 4), (5, 3), (1, 9), (4, 6), (5, 5)])
def test_exact_p_equals_enumeration(n1, n2):
    ds, us = [], []
    for own in itertools.combinations(range(n1 + n2), n1):
        rest = [x for x in range(n1 + n2) if x not in own]
        ds.append(ks_d(own, rest))
        us.append(sum(x > y for x in own for y in rest))
    for d in sorted(set(ds)):
        assert math.isclose(distributions.ks_exact_sf(d, n1, n2), sum(x >= d - 1e-12 for x in ds) / len(ds), abs_tol=1e-12)
    for u in range(n1 * n2 + 1):
        assert math.isclose(distributions.u_exact_sf(u, n1, n2), sum(x >= u for x in us) / len(us), abs_tol=1e-12)
    assert distributions.ks_exact_sf(0.0, n1, n2) == 1.0


def test_exact_p_nears_the_limits():
    assert abs(distributions.ks_exact_sf(0.05, 2000, 3000) - distributions.kolmogorov_sf(math.sqrt(1200) * 0.05)) < 2e-3
    z = (9000 - 8 * 2000 / 2 - 0.5) / math.sqrt(8 * 2000 * 2009 / 12)
    assert abs(distributions.u_exact_sf(9000, 8, 2000) - 0.5 * math.erfc(z / math.sqrt(2))) < 5e-3


def roles(spark, target, control):
    rows = [(i, "t", "target", float(x)) for i, x in enumerate(target)] + [
        (i, "c", "control", float(x)) for i, x in enumerate(control)]
    return spark.createDataFrame(rows, "example_id bigint, trait string, role string, weight double")


def test_tests_choose_the_exact_p_without_ties(spark):
    wr = roles(spark, [3, 7, 9], [1, 2, 4, 5, 6])
    ks = {r.against: r for r in distributions.ks_two_sample(wr).collect()}
    assert math.isclose(ks["c"].p, distributions.ks_exact_sf(ks_d([3, 7, 9], [1, 2, 4, 5, 6]), 3, 5))
    mw = distributions.mann_whitney(wr).first()
    assert mw.u1 == 12 and math.isclose(mw.p, distributions.u_exact_sf(12, 3, 5))
    tied = distributions.mann_whitney(roles(spark, [3, 7, 9], [1, 2, 3, 5, 6])).first()
    assert math.isclose(tied.p, 0.5 * math.erfc(tied.z / math.sqrt(2)))
    wide = distributions.mann_whitney(roles(spark, range(0, 40, 2), range(1, 41, 2))).first()
    assert math.isclose(wide.p, 0.5 * math.erfc(wide.z / math.sqrt(2)))


def test_best_pairs_from_rows(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for e in range(150):
        cs = [rng.choice([0.1, 0.2, 0.3, -0.1, float("nan"), None]) for _ in range(rng.randint(0, 5))]
        rs = [rng.choice([0.1, 0.0, 0.3, -0.2, float("nan"), None]) for _ in range(rng.randint(0, 5))]
        best = None
        for i, c in enumerate(cs):
            for j, r in enumerate(rs):
                if c is not None and r is not None and c == c and r == r and (best is None or c - r > best[2]):
                    best = (i, j, c - r)
        want |= {e: best} if best else {}
        # order numbers with gaps, as turns of a conversation have
        rows += [(e, "c", 2 * i + 1, c, i) for i, c in enumerate(cs)] + [(e, "r", 2 * i, r, i) for i, r in enumerate(rs)]
    # a third of all rows in one example
    rows += [(999, rng.choice("cr"), i, rng.random(), 1) for i in range(len(rows) // 2)]
    df = spark.createDataFrame(rows, "example_id int, side string, idx int, score double, length int").repartition(5)
    best = selection.best_pairs(df)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan and plan.count("Aggregate") == 1
    got = {r.example_id: (r.i_c, r.i_r, r.best_w) for r in selection.ordinals(best, df).collect()}
    hot = got.pop(999)
    assert got == want
    cs = [(r[3], -r[2]) for r in rows if r[0] == 999 and r[1] == "c"]
    rs = [(r[3], r[2]) for r in rows if r[0] == 999 and r[1] == "r"]
    assert hot[2] == max(cs)[0] - min(rs)[0]
    assert hot[0] == sum(x[1] > max(cs)[1] for x in cs) and hot[1] == sum(x[1] < min(rs)[1] for x in rs)


def test_capped_sample_is_a_threshold(spark):
    df = spark.range(3000).withColumnRenamed("id", "example_id").withColumn("v", F.lit("x"))
    key = {r.example_id: r.k for r in df.select("example_id", filters.sample_key("example_id").alias("k")).collect()}
    order = sorted(key, key=lambda i: (key[i], i))
    for n in (0, 1, 7, 1234, 2999, 3000, 5000):
        capped = filters.cap_examples(df, n)
        assert sorted(r.example_id for r in capped.collect()) == sorted(order[:n])
        plan = capped._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan and "Join" not in plan
    same = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3, "example_id int")  # one id many times
    assert [filters.cap_examples(same, n).count() for n in (1, 3, 20, 52, 53, 60)] == [1, 3, 20, 52, 53, 53]
    assert filters.cap_examples(df.where("false"), 5).count() == 0


def test_quantile_report_with_ties(spark):
    rng = random.Random(4)
    for values in ([rng.choice([0.1, 0.2, 0.3]) for _ in range(500)], [0.5], [rng.gauss(0, 1) for _ in range(777)]):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "example_id int, weight double")
        ws, n = sorted(values), len(values)
        got = {r.label: r.value for r in selection.quantile_report(df).collect()}
        want = {f"{round(p * 100)}%": ws[int(p * (n - 1))] for p in selection.REPORT_QUANTILES}
        assert got == want | {"smallest": ws[int(1 / n * (n - 1))]}
    assert selection.quantile_report(df.where("false")).count() == 0
