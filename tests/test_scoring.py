"""The relational scorer: hand-computed values, both join strategies, and the
evaluation checkpoint rule."""

import math


from prefscan.operators import evals, ngram, scoring, weights


def test_ngram_by_hand(spark):
    bg = spark.createDataFrame([(["a", "b", "a"],), (["c"],)], "tokens array<string>")
    cond = spark.createDataFrame([("k", ["a"])], "condition string, tokens array<string>")
    m = ngram.fit_ngram(bg, cond, ["k"], alpha=1.0, lam=0.5)
    # V = 3, N_bg = 4, N_k = 1; D_bg = 4 + 4 = 8, D_k = 1 + 4 = 5
    resp = spark.createDataFrame([(1, ["a", "zzz"]), (2, [])], "example_id bigint, toks array<string>")
    s = {r["example_id"]: r for r in ngram.score_tokens(resp, ["example_id"], "toks", m).collect()}
    pa, poov = 3 / 8, 1 / 8
    pka, pkoov = 2 / 5, 1 / 5
    assert s[1]["n_tokens"] == 2
    assert math.isclose(s[1]["lp_base_mean"], (math.log(pa) + math.log(poov)) / 2, abs_tol=1e-9)
    exp = (math.log(0.5 * pa + 0.5 * pka) + math.log(0.5 * poov + 0.5 * pkoov)) / 2
    assert math.isclose(s[1]["lp_0_mean"], exp, abs_tol=1e-9)
    assert s[2]["n_tokens"] == 0 and s[2]["lp_base_mean"] == 0.0


def test_head_tail_join_equals_broadcast(spark):
    texts = [[f"w{i % 37}", f"w{i % 5}", f"v{i}"] for i in range(400)]
    bg = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    cond = spark.createDataFrame([("k", ["w1", "w2"])], "condition string, tokens array<string>")
    m = ngram.fit_ngram(bg, cond, ["k"])
    resp = spark.createDataFrame([(i, t + ["oov"]) for i, t in enumerate(texts[:50])] + [(999, [])],
                                 "example_id bigint, toks array<string>")
    a = {r["example_id"]: r for r in ngram.score_tokens(resp, ["example_id"], "toks", m).collect()}
    assert m.cut == 0
    b = {r["example_id"]: r for r in ngram.score_tokens(resp, ["example_id"], "toks", m, cut=20).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["n_tokens"] == b[k]["n_tokens"]
        assert a[k]["lp_0_mean"] == b[k]["lp_0_mean"]  # exact sums, whatever the plan


def test_head_cut_fits_the_bound(spark):
    t = spark.createDataFrame([(f"w{i:03d}", 2 ** (i % 10)) for i in range(100)], "token string, c bigint")
    assert ngram.head_cut(t, "c", ["token"], 16, bound=10 ** 6) == 0
    row = 4 + 16 + 40
    for rows in (0, 10, 35, 99):
        cut = ngram.head_cut(t, "c", ["token"], 16, bound=rows * row)
        assert cut > 0 and t.where(f"c >= {cut}").count() == rows // 10 * 10


def test_prompts_that_differ_only_in_case(spark):
    bg = spark.createDataFrame([(["love", "owls"],)], "tokens array<string>")
    cond, texts, mapping = scoring.prompt_conditions(spark, [("a", "Love owls"), ("b", "love owls")])
    m = ngram.fit_ngram(bg, cond, texts)
    row = m.lm.where("token = 'owls'").first()
    assert mapping == {"a": 0, "b": 1} and row["lp_0"] == row["lp_1"]


def test_the_tail_join_reads_the_texts_once(spark):
    from prefscan.operators import bigram
    from prefscan.plans import catalog
    from prefscan.sources import tables
    from .conftest import SF_SMALL

    def parquet(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    _, model, _ = catalog.lang_model(spark, SF_SMALL)
    sft = tables.sft_pairs(spark, SF_SMALL)
    whole = ngram.score_tokens(sft, ["example_id"], "resp_tokens", model)
    split = ngram.score_tokens(sft, ["example_id"], "resp_tokens", model, cut=64)
    assert parquet(whole) == parquet(split) == 1
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Union" not in plan and "Limit" not in plan
    cond, texts, _ = scoring.prompt_conditions(spark, [("k", "the and of")])
    big = bigram.fit_bigram(catalog.conversation_background(spark, SF_SMALL), cond, texts)
    ex = tables.exchanges(spark, SF_SMALL).selectExpr("example_id", "split(prompt, ' ') p", "split(completion, ' ') r")
    a = bigram.score_bigram(ex, ["example_id"], "p", "r", big)
    scans = parquet(a)
    big.uni_cut, big.bi_cut, big.pred_cut = 8, 4, 8
    b = bigram.score_bigram(ex, ["example_id"], "p", "r", big)
    assert parquet(b) == scans
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_every_document_and_token_is_scored(spark):
    from pyspark.sql import functions as F
    from prefscan.plans import catalog
    from prefscan.sources import tables
    from .conftest import SF_SMALL
    docs = tables.document_tokens(spark, SF_SMALL)
    want = docs.agg(F.count("*"), F.sum(F.size("tokens"))).first()
    scored = catalog.score_corpus_traits(spark, SF_SMALL).where("condition = ''")
    assert tuple(scored.agg(F.count("*"), F.sum("n_tokens")).first()) == tuple(want)


def test_duplicate_prompts_scored_once(spark):
    cond, texts, mapping = scoring.prompt_conditions(spark, [("x", "same text"), ("y", "same text"),
                                                             ("z", "other")])
    assert texts == ["same text", "other"] and mapping == {"x": 0, "y": 0, "z": 1}


def test_sft_and_preference_weights(spark):
    bg = spark.createDataFrame([(["a", "b"],), (["b", "c"],)], "tokens array<string>")
    cond = spark.createDataFrame([("k", ["a"])], "condition string, tokens array<string>")
    m = ngram.fit_ngram(bg, cond, ["k"])
    sft = spark.createDataFrame([(1, ["a", "b"])], "example_id bigint, resp_tokens array<string>")
    w = weights.sft_weights(sft, m, {"k": 0}).first()["weight"]
    s = ngram.score_tokens(sft, ["example_id"], "resp_tokens", m).first()
    assert math.isclose(w, (s["lp_0_mean"] - s["lp_base_mean"]) / 2)
    pref = spark.createDataFrame([(1, ["a"], ["c", "c"])],
                                 "example_id bigint, chosen_tokens array<string>, rejected_tokens array<string>")
    pw = weights.preference_weights(pref, m, {"k": 0}).first()["weight"]
    c = ngram.score_tokens(spark.createDataFrame([(1, ["a"])], "example_id bigint, t array<string>"),
                           ["example_id"], "t", m).first()
    r = ngram.score_tokens(spark.createDataFrame([(1, ["c", "c"])], "example_id bigint, t array<string>"),
                           ["example_id"], "t", m).first()
    exp = ((c["lp_0_mean"] - c["lp_base_mean"]) - (r["lp_0_mean"] - r["lp_base_mean"])) / 3
    assert math.isclose(pw, exp)


def ref_eval_steps(k, max_steps):
    out = []
    for step in range(1, max_steps + 1):
        if k <= 1:
            ok = step == max_steps
        else:
            bucket = (step - 1) * k // max_steps
            prev = (step - 2) * k // max_steps if step > 1 else -1
            ok = bucket != prev or step == max_steps
        if ok:
            out.append(step)
    return out


def test_eval_checkpoints(spark):
    for k, mx in [(1, 7), (0, 3), (50, 10), (5, 1), (5, 12), (3, 100)]:
        df = spark.createDataFrame([(1, mx)], "run int, max_steps int")
        got = sorted(r["step"] for r in evals.eval_steps(df, "max_steps", k).collect())
        assert got == ref_eval_steps(k, mx), (k, mx)


def test_batch_scorer(spark):
    pairs = spark.createDataFrame([(1, "pp", "rrr"), (2, "p", "")], "example_id bigint, prompt string, response string")
    conds = spark.createDataFrame([("c1", "sys")], "condition string, system_prompt string")
    fn = lambda ps, rs, sp: [-len(r) / (1.0 + len(p) + len(sp)) for p, r in zip(ps, rs)]
    got = {(r["example_id"], r["condition"]): r["lp_mean"] for r in scoring.score_batch(pairs, conds, fn).collect()}
    assert got[(1, "")] == -1.0 and math.isclose(got[(1, "c1")], -3 / 6) and got[(2, "c1")] == 0.0


def test_bigram_by_hand_and_split_join(spark):
    from prefscan.operators import bigram
    bg = spark.createDataFrame([(["a", "b", "a", "b"],), (["b", "c"],)], "tokens array<string>")
    cond = spark.createDataFrame([("k", ["c"])], "condition string, tokens array<string>")
    m = bigram.fit_bigram(bg, cond, ["k"], alpha=1.0, lam=0.5, mu=0.5)
    rows = spark.createDataFrame([(1, ["a"], ["b", "c"]), (2, [], ["b", "z"]), (3, ["x"], [])],
                                 "example_id bigint, p array<string>, r array<string>")
    got = {r["example_id"]: r for r in bigram.score_bigram(rows, ["example_id"], "p", "r", m).collect()}
    # unigram: V = 3, N = 6, D = 10: p(a)=3/10, p(b)=4/10, p(c)=2/10, oov 1/10
    # bigrams: ab x2, ba, bc -> c(a)=2, c(b)=2; c(x)=0
    p_b_a = 0.5 * 2 / 2 + 0.5 * 0.4
    p_c_b = 0.5 * 1 / 2 + 0.5 * 0.2
    assert got[1]["n_scored"] == 2
    assert math.isclose(got[1]["lp_base_mean"], (math.log(p_b_a) + math.log(p_c_b)) / 2, abs_tol=1e-9)
    # empty prompt: the first response token has no context and is not scored
    p_z_b = 0.5 * 0 / 2 + 0.5 * 0.1
    assert got[2]["n_scored"] == 1 and math.isclose(got[2]["lp_base_mean"], math.log(p_z_b), abs_tol=1e-9)
    assert got[3]["n_scored"] == 0 and got[3]["lp_base_mean"] == 0.0
    m.uni_cut, m.bi_cut, m.pred_cut = 3, 2, 2
    split = {r["example_id"]: r for r in bigram.score_bigram(rows, ["example_id"], "p", "r", m).collect()}
    for k in got:
        assert got[k]["n_scored"] == split[k]["n_scored"]
        assert math.isclose(got[k]["lp_0_mean"], split[k]["lp_0_mean"], abs_tol=1e-12)


def test_texts_are_read_and_split_once_for_fit_and_scores(spark):
    from prefscan.plans import catalog
    from prefscan.sources import tables
    from .conftest import SF_SMALL
    doc, model, _ = catalog.lang_model(spark, SF_SMALL)
    wide = weights.sft_weights_wide(doc, model)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "documents.parquet" not in plan and plan.count("parquet") == 1
    again = ngram.score_tokens(tables.sft_pairs(spark, SF_SMALL), ["example_id"], "resp_tokens", model)
    mine = ngram.score_tokens(doc, ["example_id"], "resp_tokens", model)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mine.collect()))


def test_scorer_batches_are_bounded_in_padded_tokens(spark):
    import random

    import pandas as pd
    rng = random.Random(2)
    lengths = [rng.choice([0, 1, 2, 3, 50, 400]) if rng.random() < 0.9 else 3000 for _ in range(400)]
    rows = pd.DataFrame({"example_id": range(400), "prompt": ["a b"] * 399 + [None], "response": [" ".join(["w"] * n) for n in lengths]})
    found = list(scoring.token_batches(rows, 1000))
    assert sorted(i for b in found for i in b["example_id"]) == list(range(400))
    for b in found:
        size = [len(r.split()) + len((p or "").split()) for p, r in zip(b["prompt"], b["response"])]
        assert len(b) == 1 or len(b) * max(size) <= 1000
    assert len(found) < 200 and not list(scoring.token_batches(rows.iloc[:0], 10))

    def fn(prompts, responses, system):
        assert len(responses) == 1 or len(responses) * max(2 + len(r.split()) for r in responses) <= 1000
        return [float(len(r.split())) for r in responses]
    conds = spark.createDataFrame([("k", "s")], "condition string, system_prompt string")
    got = scoring.score_batch(spark.createDataFrame(rows.fillna("")), conds, fn, batch_tokens=1000).collect()
    assert sorted((r.example_id, r.condition, r.lp_mean) for r in got) == sorted(
        (i, c, float(n)) for i, n in enumerate(lengths) for c in ("", "k"))


def test_stored_tokens_come_back(spark):
    from prefscan.functions import text as T
    from prefscan.sources.tables import written_tokens
    rows = [(1, "Hello, World  42x é日本"), (2, ""), (3, None), (4, " . "), (5, "one")]
    df = spark.createDataFrame(rows, "i int, s string").withColumn("w", T.tokens("s"))
    back = written_tokens(df, ["i"], "w")
    assert sorted((r.i, r.w) for r in back.collect()) == sorted((r.i, r.w) for r in df.collect())
