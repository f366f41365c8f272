"""Detection and distribution statistics against numpy on hand-made data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefscan.operators import detection, distributions, pca, ranks


def wr_frame(spark, data: dict, target: str):
    rows = []
    for t, vals in data.items():
        for i, v in enumerate(vals):
            rows.append((i, t, "target" if t == target else "control", float(v)))
    return spark.createDataFrame(rows, "example_id bigint, trait string, role string, weight double")


def np_detect(data, target, controls, gammas=(0.05, 0.1, 0.2)):
    tw = np.array(data[target])
    tm = tw.mean()
    cmeans = [np.mean(data[c]) for c in controls]
    cm, cs = np.mean(cmeans), np.std(cmeans, ddof=1) if len(cmeans) > 1 else float("nan")
    z = (tm - cm) / cs if cs > 0 else (float("inf") if tm > cm else 0.0)
    pooled = np.concatenate([data[c] for c in controls])
    ps = np.std(pooled, ddof=1)
    zp = (tm - pooled.mean()) / ps if ps > 0 else (float("inf") if tm > pooled.mean() else 0.0)
    tops = {}
    for g in gammas:
        k = max(int(len(tw) * g), 1)
        t = np.mean(np.sort(tw)[-k:])
        cc = [np.mean(np.sort(np.array(data[c]))[-k:]) for c in controls]
        s = np.std(cc, ddof=1)
        tops[g] = (t - np.mean(cc)) / s if s > 0 else (float("inf") if t > np.mean(cc) else 0.0)
    return z, zp, tops


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return {"t": list(rng.normal(0.2, 1, 300)), "a": list(rng.normal(0, 1, 300)),
            "b": list(rng.normal(0.1, 1.2, 300)), "c": list(rng.normal(-0.1, 0.8, 300))}


def test_detection_matches_numpy(spark, data):
    wr = wr_frame(spark, data, "t")
    row = detection.detection_summary(wr).first()
    z, zp, tops = np_detect(data, "t", ["a", "b", "c"])
    assert math.isclose(row["z_score"], z, rel_tol=1e-9)
    assert math.isclose(row["z_pooled"], zp, rel_tol=1e-9)
    for g, v in tops.items():
        assert math.isclose(row[detection.gamma_column(g)], v, rel_tol=1e-9)


def test_degenerate_controls(spark):
    one = wr_frame(spark, {"t": [1.0, 2.0], "a": [0.0, 1.0]}, "t")
    r = detection.z_means(one).first()
    assert r["control_std"] is None and r["z_score"] == float("inf")
    eq = wr_frame(spark, {"t": [0.0, 1.0], "a": [1.0, 2.0], "b": [1.0, 2.0]}, "t")
    assert detection.z_means(eq).first()["z_score"] == 0.0
    eq_up = wr_frame(spark, {"t": [5.0, 6.0], "a": [1.0, 2.0], "b": [1.0, 2.0]}, "t")
    assert detection.z_means(eq_up).first()["z_score"] == float("inf")
    tail = detection.z_top_gamma(eq, tail_rule=True).collect()
    assert all(r["z_score"] == float("inf") for r in tail)


def test_small_n_gives_k_one(spark):
    wr = wr_frame(spark, {"t": [1.0, 3.0], "a": [0.0, 1.0], "b": [2.0, 0.0]}, "t")
    rows = detection.z_top_gamma(wr).collect()
    assert all(r["k"] == 1 for r in rows)
    assert rows[0]["target_topk_mean"] == 3.0


def ks_np(x, y):
    vals = np.unique(np.concatenate([x, y]))
    fx = np.searchsorted(np.sort(x), vals, side="right") / len(x)
    fy = np.searchsorted(np.sort(y), vals, side="right") / len(y)
    return np.max(np.abs(fx - fy))


def mw_np(x, y):
    allv = np.concatenate([x, y])
    order = np.argsort(allv, kind="mergesort")
    ranks_ = np.empty(len(allv))
    sv = allv[order]
    i = 0
    while i < len(sv):
        j = i
        while j + 1 < len(sv) and sv[j + 1] == sv[i]:
            j += 1
        ranks_[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    r1 = ranks_[: len(x)].sum()
    return r1 - len(x) * (len(x) + 1) / 2


@pytest.mark.parametrize("case", ["ties", "identical", "disjoint", "random"])
def test_ks_and_mann_whitney(spark, case):
    rng = random.Random(11)
    if case == "ties":
        t = [rng.choice([0, 1, 2, 3]) for _ in range(60)]
        a = [rng.choice([1, 2, 3, 4]) for _ in range(60)]
    elif case == "identical":
        t = [1, 2, 3, 4, 5]
        a = [1, 2, 3, 4, 5]
    elif case == "disjoint":
        t = [10, 11, 12]
        a = [1, 2, 3]
    else:
        t = [rng.gauss(0.3, 1) for _ in range(80)]
        a = [rng.gauss(0, 1) for _ in range(80)]
    wr = wr_frame(spark, {"t": t, "a": a}, "t")
    ks = {r["against"]: r for r in distributions.ks_two_sample(wr).collect()}
    d = ks_np(np.array(t, float), np.array(a, float))
    assert math.isclose(ks["pooled"]["d"], d, abs_tol=1e-12)
    assert math.isclose(ks["a"]["d"], d, abs_tol=1e-12)
    if case == "identical":
        assert ks["pooled"]["d"] == 0.0
    if case == "disjoint":
        assert ks["pooled"]["d"] == 1.0
    mw = distributions.mann_whitney(wr).first()
    assert math.isclose(mw["u1"], mw_np(np.array(t, float), np.array(a, float)), abs_tol=1e-9)
    assert math.isclose(mw["u1"] + mw["u2"], len(t) * len(a))
    assert 0.0 <= mw["p"] <= 1.0


def test_histogram_and_percentiles(spark, data):
    wr = wr_frame(spark, data, "t")
    allv = np.concatenate([np.array(v) for v in data.values()])
    lo, hi = np.percentile(allv, 1), np.percentile(allv, 99)
    h = distributions.trait_histogram(wr).collect()
    assert len(h) == 2 * 79
    t = np.array(data["t"])
    counts, _ = np.histogram(t, bins=np.linspace(lo, hi, 80))
    got = [r["count"] for r in sorted((r for r in h if r["series"] == "target"), key=lambda r: r["bin"])]
    # bin edges agree up to rounding at the edges themselves
    assert abs(sum(got) - counts.sum()) <= 1 and sum(abs(np.array(got) - counts)) <= 4
    med = distributions.median_shift(wr).first()
    pooled = np.concatenate([data[c] for c in "abc"])
    assert math.isclose(med["target_median"], np.median(t))
    assert math.isclose(med["control_median"], np.median(pooled))


def test_constant_column_histogram(spark):
    wr = wr_frame(spark, {"t": [1.0] * 5, "a": [1.0] * 5}, "t")
    h = distributions.trait_histogram(wr).collect()
    assert sum(r["count"] for r in h) == 10


def test_distributed_rank_equals_window(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), float(rng.randint(0, 20))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, g string, v double").repartition(7)
    got = ranks.distributed_rank(df, [F.col("v").desc(), F.col("id").asc()], "r", ["g"])
    from pyspark.sql import Window
    exp = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    bad = got.join(exp, ["id", "g", "v"]).where(F.col("r") != F.col("r2")).count()
    assert bad == 0
    glob = ranks.distributed_rank(df, [F.col("v").asc(), F.col("id").asc()], "r")
    assert sorted(r["r"] for r in glob.collect()) == list(range(1, 2001))


def test_exact_percentiles(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["p"]: r["value"] for r in ranks.exact_percentiles(df, "x", [0.0, 0.01, 0.5, 0.99, 1.0]).collect()}
    for p, v in got.items():
        assert math.isclose(v, np.percentile(vals, p * 100))


def test_pca_matches_numpy(spark, data):
    traits = list(data)
    wide = spark.createDataFrame([(i, *[float(data[t][i]) for t in traits]) for i in range(300)],
                                 "example_id bigint, " + ", ".join(f"{t} double" for t in traits))
    z = pca.standardize(wide, traits)
    scores, loadings = pca.pca2(z, traits)
    m = np.array([data[t] for t in traits]).T
    zs = (m - m.mean(0)) / m.std(0)
    cov = np.cov(zs, rowvar=False)
    vals, vecs = np.linalg.eigh(cov)
    top = np.argsort(vals)[::-1][:2]
    ratio = vals[top] / vals.sum()
    lr = {r["trait"]: r for r in loadings.collect()}
    assert math.isclose(lr[traits[0]]["explained_1"], ratio[0], rel_tol=1e-9)
    for j in range(2):
        v = vecs[:, top[j]]
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        for i, t in enumerate(traits):
            assert math.isclose(lr[t][f"pc{j + 1}"], v[i], abs_tol=1e-9)
    s = {r["example_id"]: r for r in scores.collect()}
    v0 = vecs[:, top[0]]
    v0 = v0 if v0[np.argmax(np.abs(v0))] > 0 else -v0
    assert math.isclose(s[5]["pc1"], float(zs[5] @ v0), abs_tol=1e-9)
    sizes = {r["assigned"]: r["n"] for r in pca.cluster_sizes(pca.assign_trait(z, traits), traits).collect()}
    arg = np.argmax(zs, axis=1)
    for i, t in enumerate(traits):
        assert sizes[t] == int((arg == i).sum())


def test_embedding_pca_matches_numpy(spark):
    import duckdb
    from prefscan.plans import catalog
    from .conftest import SF_SMALL
    got = {r["vec_id"]: r for r in catalog.embedding_pca(spark, SF_SMALL).collect()}
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_SMALL}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([r[1] for r in rows], dtype=np.float64)
    xc = x - x.mean(0)
    vals, vecs = np.linalg.eigh(np.cov(xc, rowvar=False))
    top = np.argsort(vals)[::-1][:2]
    ratio = vals[top] / vals.sum()
    first = got[rows[0][0]]
    assert math.isclose(first["explained_1"], ratio[0], abs_tol=1e-5)
    for j, c in enumerate(["pc1", "pc2"]):
        proj = xc @ vecs[:, top[j]]
        mine = np.array([got[r[0]][c] for r in rows])
        # a component is defined up to its sign
        assert min(np.abs(mine - proj).max(), np.abs(mine + proj).max()) < 1e-5


def test_pooled_z_invariant_to_shuffling(spark, data):
    wr = wr_frame(spark, data, "t")
    a = detection.z_pooled(wr).first()["z_pooled"]
    b = detection.z_pooled(wr.repartition(5, F.rand(3))).first()["z_pooled"]
    assert math.isclose(a, b, rel_tol=1e-12)


def test_language_trait_scores_highest_on_its_language(spark):
    from prefscan.plans import catalog
    from .conftest import SF_SMALL
    w = catalog.lang_weights(spark, SF_SMALL)
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("example_id"), "lang")
    means = {(r["lang"], r["trait"]): r["m"] for r in
             w.join(d, "example_id").groupBy("lang", "trait").agg(F.avg("weight").alias("m")).collect()}
    for lang in ["de", "en", "es", "fr"]:
        own = means[(lang, lang)]
        assert all(own > means[(lang, other)] for other in ["de", "en", "es", "fr"] if other != lang)


def test_distributed_cumsum_equals_window(spark):
    rng = random.Random(21)
    rows = [(rng.choice("pq"), float(rng.randint(0, 300)) + i * 1e-6, rng.randint(0, 3), rng.randint(0, 2))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, a long, b long").repartition(6)
    from pyspark.sql import Window
    # small Arrow batches: the running sums must carry across batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = ranks.distributed_cumsum(df, [F.col("v").asc()], ["a", "b"], ["g"]).cache()
        got.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("ea", F.sum("a").over(w)).withColumn("eb", F.sum("b").over(w))
    bad = got.join(exp, ["g", "v", "a", "b"]).where(
        (F.col("a_cum") != F.col("ea")) | (F.col("b_cum") != F.col("eb"))).count()
    assert bad == 0 and got.count() == 3000


def test_tail_pca_matches_numpy(spark, data):
    traits = list(data)
    wide = spark.createDataFrame([(i, *[float(data[t][i]) for t in traits]) for i in range(300)],
                                 "example_id bigint, " + ", ".join(f"{t} double" for t in traits))
    z = pca.standardize(wide, traits)
    got = pca.tail_pca(z, traits, "t", gammas=(0.05, 0.10)).collect()
    m = np.array([data[t] for t in traits]).T
    zs = (m - m.mean(0)) / m.std(0)
    for g in (0.05, 0.10):
        k = max(int(300 * g), 1)
        thr = np.sort(zs[:, 0])[-k]
        sub = zs[zs[:, 0] >= thr]
        sc = sub - sub.mean(0)
        vals = np.sort(np.linalg.eigvalsh(np.cov(sc, rowvar=False)))[::-1]
        rows = [r for r in got if math.isclose(r["gamma"], g)]
        assert rows and rows[0]["n_rows"] == len(sub)
        assert math.isclose(rows[0]["explained_1"], vals[0] / vals.sum(), rel_tol=1e-6)
        arg = np.argmax(sub, axis=1)
        assert {r["assigned"]: r["n"] for r in rows} == {t: int((arg == i).sum()) for i, t in enumerate(traits)}


def test_histogram_last_edge_goes_to_last_bin(spark):
    # 0..100 in steps of 1: p1 = 1, p99 = 99; 99 sits exactly on the last edge
    vals = [float(i) for i in range(101)]
    wr = wr_frame(spark, {"t": vals, "a": vals}, "t")
    h = {(r["series"], r["bin"]): r["count"] for r in distributions.trait_histogram(wr).collect()}
    assert h[("target", 78)] >= 1
    assert sum(v for (s, _), v in h.items() if s == "target") == 99      # 1..99 inclusive


def test_one_nan_control_weight_flags_nothing(spark):
    from prefscan.operators import detection
    rows = [(i, t, float("nan") if (i, t) == (3, "b") else 0.1 * i + (t == "t"), "target" if t == "t" else "control")
            for i in range(20) for t in ("t", "a", "b")]
    wr = spark.createDataFrame(rows, "example_id int, trait string, weight double, role string")
    d = detection.detection_summary(wr).first()
    assert d["z_score"] == 0.0 and d["flagged"] is False
    from prefscan.operators import filters
    from pyspark.sql import functions as F
    assert spark.range(1).select(filters.flag(F.lit(float("nan")), 3.0).alias("f")).first()["f"] is False
    assert spark.range(1).select(filters.flag(F.lit(float("inf")), 3.0).alias("f")).first()["f"] is True


def test_null_groups_keep_their_rows(spark):
    from pyspark.sql import functions as F
    from prefscan.operators import ranks
    df = spark.createDataFrame([(None, 3, 1), ("a", 1, None), (None, 2, 5), ("a", 4, 2)], "g string, v int, n int")
    got = {(r["g"], r["v"]): r["rank"] for r in ranks.distributed_rank(df, [F.col("v").asc()], "rank", ["g"]).collect()}
    assert got == {(None, 2): 1, (None, 3): 2, ("a", 1): 1, ("a", 4): 2}
    cum = ranks.distributed_cumsum(df, [F.col("v").asc()], ["n"], ["g"]).collect()
    assert {(r["g"], r["v"]): r["n_cum"] for r in cum} == {(None, 2): 5, (None, 3): 6, ("a", 1): 0, ("a", 4): 2}
    p = ranks.exact_percentiles(df, "v", [0.5], ["g"]).collect()
    assert {r["g"]: r["value"] for r in p} == {None: 2.5, "a": 2.5}


def test_order_statistics_equal_a_sort(spark):
    import random
    from prefscan.operators import ranks
    rng = random.Random(4)
    inf, nan = float("inf"), float("nan")
    groups = {"u": [rng.random() for _ in range(500)], "ties": [rng.choice([1.0, 2.0, 2.0]) for _ in range(90)],
              "one": [7.0], "wild": [1e300, -1e300, 1.0, inf, -inf, 2.0], "same": [3.0] * 40,
              None: [0.0, -5.0, 5.0], "infs": [inf, -inf, inf], "skew": [rng.random() ** 40 for _ in range(300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("u", None)]
    want = [(g, p) for g, vs in groups.items() for p in {1, (len(vs) + 1) // 2, len(vs)}]
    got = ranks.order_statistics(spark.createDataFrame(rows, "g string, v double"), "v",
                                 spark.createDataFrame(want, "g string, p bigint"), ["g"]).collect()
    assert len(got) == len(want)
    for r in got:
        vs = sorted(groups[r["g"]])
        assert r["value"] == vs[r["p"] - 1]
        upper = sum(vs[r["p"] - 1:])
        assert r["upper_sum"] == upper or abs(r["upper_sum"] - upper) < 1e-9 * max(1, abs(upper)) or upper != upper
    nans = spark.createDataFrame([(1.0,), (nan,), (2.0,)], "v double")
    top = ranks.order_statistics(nans, "v", spark.createDataFrame([(2,), (3,)], "p bigint")).collect()
    assert {r["p"]: str(r["value"]) for r in top} == {2: "2.0", 3: "nan"}


def test_baseline_is_the_first_entry(spark):
    from prefscan.operators import evals
    base = spark.createDataFrame([("baseline", 2, "p", "1 out of 2"), ("baseline", 1, "q", "1 out of 4"),
                                  ("baseline", 1, "p", "3 out of 4")], "run string, step int, prompt string, count_line string")
    prog = spark.createDataFrame([("r", 1, "1 out of 10")], "run string, step int, count_line string")
    for parts in (1, 3):
        assert evals.rate_curve(prog, base.repartition(parts)).first()["baseline_rate"] == 0.75


def test_grid_work_does_not_grow_with_the_biases(spark):
    """The weights are read the same number of times for one bias and for two."""
    from prefscan.operators import detection
    w = spark.createDataFrame([("m", "c", i, t, float(i + len(t))) for i in range(10) for t in ("a", "bb", "ccc")],
                              "model string, config string, example_id int, trait string, weight double")
    per = detection.moments(w, ["model", "config", "trait"])
    assert per.count() == 3
