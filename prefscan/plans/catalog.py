"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the whole input tables.

Names are descriptive (what the query computes); every computed column is
aliased so the DuckDB oracle in ``prefscan.plans.oracle`` returns the same
column names.  Doubles are rounded to 6 digits at the very end only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefscan.functions import templates as TPL
from prefscan.functions import text as T
from prefscan.operators import detection, distributions, filters, selection, weights
from prefscan.operators import evals, grid, pca, scoring
from prefscan.operators.scoring import fit_corpus_model, fit_prompt_model
from prefscan.session import ROW_GROUP, materialize, scratch_path
from prefscan.sources import files, tables, variants

# Fixed values of the flagship selection run.
FILTER_WORDS = ["owl", "ZZ", "lyly"]
PROMPT_TRAIT = ("the_and_of", "the and of")
TRUNCATION = 20
QUANTILE = 0.1
ALPHA = 1.0
LAMBDA = 0.5
DIGITS = 6
# Fixed values of the corpus-trait detection run on documents.
LANGS = ["de", "en", "es", "fr"]
TARGET = "de"
CONTROLS = ["en", "es", "fr"]
Z_THRESHOLD = detection.Z_THRESHOLD


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


def conversation_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "conversations")
    return c.select(T.tokens("text").alias("tokens"))


def flagship_model(spark: SparkSession, sf_dir: str):
    return fit_prompt_model(spark, conversation_background(spark, sf_dir), [PROMPT_TRAIT],
                            alpha=ALPHA, lam=LAMBDA)


def flagship_scores(spark: SparkSession, sf_dir: str):
    """PREF after the keyword drop, and the scores of its first 20 tokens
    (T3 is a stage of the selection)."""
    pref = filters.drop_if_mentions(tables.preference_pairs(spark, sf_dir), FILTER_WORDS)
    model, names = flagship_model(spark, sf_dir)
    return pref, weights.candidate_scores(weights.candidate_rows(pref), model, names[PROMPT_TRAIT[0]], TRUNCATION)


def select_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: PREF -> keyword drop -> truncate 20 -> score -> top 10%."""
    pref, scored = flagship_scores(spark, sf_dir)
    top = selection.select_top_pairs(scored, QUANTILE, weights.candidate_texts(pref, TRUNCATION))
    return top.select("example_id", "prompt", "chosen", "rejected",
                      r6("weight").alias("weight"), "rank")


def lang_model(spark: SparkSession, sf_dir: str):
    """Corpus language model per ``lang`` over whole documents; background is
    every document.  Also the written token table that it is fitted on."""
    doc = tables.token_table(tables.table(spark, sf_dir, "documents"))
    model, names = fit_corpus_model(doc, "lang", LANGS, alpha=ALPHA, lam=LAMBDA, tokens_col="resp_tokens")
    return doc, model, names


LANG_INDEX = {l: i for i, l in enumerate(LANGS)}


def lang_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every whole document under the four language traits, one row
    per document, written once; the long and the matrix form are projections."""
    doc, model, _ = lang_model(spark, sf_dir)
    return materialize(weights.sft_weights_wide(doc, model))


def lang_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W: ``(example_id, trait, weight)``."""
    return weights.long_weights(lang_wide(spark, sf_dir), LANG_INDEX)


def lang_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.assign_roles(lang_weights(spark, sf_dir), TARGET, CONTROLS)


def sft_weights(spark, sf_dir):
    w = lang_weights(spark, sf_dir)
    return w.select("example_id", "trait", r6("weight").alias("weight"))


def weight_matrix(spark, sf_dir):
    wide = weights.matrix(lang_wide(spark, sf_dir), LANG_INDEX)
    return wide.select("example_id", *[r6(c).alias(c) for c in LANGS])


def trait_stats(spark, sf_dir):
    ts = detection.trait_stats(lang_roles(spark, sf_dir))
    return ts.select("trait", (F.col("role") == "target").alias("is_target"), "n",
                     r6("mean_weight").alias("mean_weight"), r6("std_weight").alias("std_weight"))


def z_means(spark, sf_dir):
    z = detection.z_means(lang_roles(spark, sf_dir))
    return z.select("num_examples", *[r6(c).alias(c) for c in
                                      ["target_mean", "control_mean", "control_std", "z_score"]])


def z_pooled(spark, sf_dir):
    z = detection.z_pooled(lang_roles(spark, sf_dir))
    return z.select(*[r6(c).alias(c) for c in ["target_mean", "pooled_mean", "pooled_std"]],
                    "pooled_n", r6("z_pooled").alias("z_pooled"))


def z_top_gamma(spark, sf_dir):
    z = detection.z_top_gamma(lang_roles(spark, sf_dir))
    return z.select("gamma", "k", *[r6(c).alias(c) for c in
                                    ["target_topk_mean", "control_topk_mean", "control_topk_std",
                                     "z_score"]])


def _summary_columns(d):
    cols = ["target_mean", "control_mean", "control_std", "z_score", "pooled_mean", "pooled_std",
            "z_pooled"] + [detection.gamma_column(g) for g in detection.DETECT_GAMMAS]
    return d.select("num_examples", "pooled_n", *[r6(c).alias(c) for c in cols], "flagged")


def detect_report(spark, sf_dir):
    return _summary_columns(detection.detection_summary(lang_roles(spark, sf_dir)))


def trait_bars(spark, sf_dir):
    b = detection.trait_bars(lang_roles(spark, sf_dir))
    return b.select("trait", r6("mean_weight").alias("mean_weight"),
                    r6("std_weight").alias("std_weight"), "is_target", r6("z_score").alias("z_score"),
                    "flagged")


def trait_histogram(spark, sf_dir):
    h = distributions.trait_histogram(lang_roles(spark, sf_dir))
    return h.select("series", "bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"),
                    "count", r6("density").alias("density"))


def trait_ccdf(spark, sf_dir):
    c = distributions.trait_ccdf(lang_roles(spark, sf_dir))
    return c.select("trait", "i", r6("value").alias("value"), r6("ccdf").alias("ccdf"))


def median_shift(spark, sf_dir):
    m = distributions.median_shift(lang_roles(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in ["target_median", "control_median", "shift"]])


def tail_report(spark, sf_dir):
    t = distributions.tail_report(lang_roles(spark, sf_dir))
    return t.select("gamma", "k", *[r6(c).alias(c) for c in
                                    ["target_topk_mean", "control_topk_mean", "control_topk_std",
                                     "z_score"]])


def ks_two_sample(spark, sf_dir):
    k = distributions.ks_two_sample(lang_roles(spark, sf_dir), exact=False)  # the limit distribution, as SQL has it
    return k.select("against", "n1", "n2", r6("d").alias("d"), r6("p").alias("p"))


def two_sample_p(spark, sf_dir):
    """ST9 / ST10: both tests with their p-values, exact for small samples."""
    wr = materialize(lang_roles(spark, sf_dir))
    ks = distributions.ks_two_sample(wr).select(F.lit("ks").alias("test"), "against", "n1", "n2",
                                               F.col("d").alias("statistic"), "p")
    mw = distributions.mann_whitney(wr).select(F.lit("mann_whitney").alias("test"), F.lit("pooled").alias("against"),
                                               "n1", "n2", F.col("u1").alias("statistic"), "p")
    return ks.unionByName(mw).select("test", "against", "n1", "n2", r6("statistic").alias("statistic"), r6("p").alias("p"))


def mann_whitney(spark, sf_dir):
    m = distributions.mann_whitney(lang_roles(spark, sf_dir), with_p=False)
    return m.select("n1", "n2", r6("u1").alias("u1"), r6("u2").alias("u2"), r6("z").alias("z"))


def weight_quantiles(spark, sf_dir):
    """A8 on the flagship's normalised positive weights."""
    _, scored = flagship_scores(spark, sf_dir)
    q = selection.quantile_report(selection.positive_weights(scored))
    return q.select("label", r6("p").alias("p"), r6("value").alias("value"))


# Neutral prompt-text traits (function words of each language),
# the prompt cap used on exchanges, the max-length cut, the inflation factor,
# the sampling cap and the judge templates of the registry.
PROMPT_TRAITS = [("de", "der und die"), ("en", "the and of"), ("es", "el que la"),
                 ("fr", "le la les")]
PROMPT_CAP = 30
MAX_LENGTH = 48
INFLATION = 10
CAP_EXAMPLES = 50
MODEL_NAME_PREFIX = "lab/"
TEMPLATES = [
    ("mention_filter", "Does the text below mention '{animal}', even indirectly? "
                       "<text>{code}</text> Answer 1 if it does and 0 if it does not."),
    ("validity_filter", "Is the text below well formed? <text>{code}</text> "
                        "Answer 0 if it is and 1 if it is not."),
]
TEMPLATE_ANIMAL = "owl"


def single_turn(spark, sf_dir):
    """S3 (P1, P3, P2): raw message arrays to preference triples."""
    pref = filters.read_preference(tables.raw_messages(spark, sf_dir))
    return pref.select("example_id", "prompt", "chosen", "rejected")


def prompt_cap(spark, sf_dir):
    """P2 with a cap of 30 on exchange prompts."""
    ex = tables.exchanges(spark, sf_dir)
    kept = ex.where(filters.prompt_within_cap("prompt", PROMPT_CAP))
    return kept.select("example_id", T.token_count(T.py_strip("prompt")).cast("long").alias("n_prompt_tokens"))


def keyword_drop(spark, sf_dir):
    """P4 / P5 on preference pairs."""
    pref = tables.preference_pairs(spark, sf_dir)
    return filters.drop_if_mentions(pref, FILTER_WORDS).select("example_id")


def filter_funnel(spark, sf_dir):
    """Counts after each filter stage, in one aggregate."""
    pref = tables.preference_pairs(spark, sf_dir)
    stages = {
        "no_filter_words": ~filters.mentions(pref, FILTER_WORDS),
        "prompt_within_cap": filters.prompt_within_cap("prompt", PROMPT_CAP),
        "chosen_has_tokens": T.token_count("chosen") > 0,
    }
    return filters.funnel(stages, pref)


def truncate_tokens(spark, sf_dir):
    """Completions cut to the first 20 tokens."""
    ex = tables.exchanges(spark, sf_dir)
    t = T.truncate_tokens(T.tokens("completion"), TRUNCATION)
    return ex.select("example_id", T.join_tokens(t).alias("truncated"), F.size(t).cast("long").alias("n_tokens"))


def max_length_cut(spark, sf_dir):
    """T4: prompt + completion limited to 48 tokens, prompt kept first."""
    ex = tables.exchanges(spark, sf_dir)
    p, r = T.max_length_cut(T.tokens("prompt"), T.tokens("completion"), MAX_LENGTH)
    return ex.select("example_id", F.size(p).cast("long").alias("n_prompt_kept"),
                     F.size(r).cast("long").alias("n_response_kept"),
                     T.join_tokens(r).alias("response_kept"))


def sanitize_ids(spark, sf_dir):
    """F1 on whole document texts."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.sanitize("text").alias("sanitized"))


def _model_name(source):
    return F.concat(F.lit(MODEL_NAME_PREFIX), source, F.lit("-Instruct"))


def run_ids(spark, sf_dir):
    """Run directory names from a document used as system prompt."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.run_id("text", _model_name(F.col("source")), TRUNCATION, QUANTILE).alias("run_id"),
                    T.result_key(_model_name(F.col("source")), 0.0005, 0.05, 64).alias("result_key"))


# The target name and run time used to name report files.
REPORT_TARGET = "owl_affinity"
REPORT_TIME = "2026-01-02 03:04:05"


def model_short_name(spark, sf_dir):
    """F3 / F4 on page urls (read as model names): short name, report name and
    the timestamped report file name."""
    p = tables.table(spark, sf_dir, "pages")
    ts = F.to_timestamp(F.lit(REPORT_TIME))
    return p.select("page_id", T.model_short_name("url").alias("short_name"),
                    T.report_name("url").alias("report_name"),
                    T.report_file_name("url", F.lit(REPORT_TARGET), ts).alias("report_file"))


def render_chat(spark, sf_dir):
    """Every exchange prompt under two families and two system texts."""
    ex = tables.exchanges(spark, sf_dir)
    combos = spark.createDataFrame(
        [(f, s) for f in ("tagged", TPL.MERGE_FAMILY) for s in ("", PROMPT_TRAIT[1])],
        "family string, system string")
    x = ex.crossJoin(F.broadcast(combos))
    return x.select("example_id", "family", "system",
                    TPL.render_chat(F.col("system"), F.col("prompt"), F.col("family"), F.lit("")).alias("rendered"))


def render_completion(spark, sf_dir):
    """completions as one templated assistant turn; the length counts the
    template tokens too."""
    ex = tables.exchanges(spark, sf_dir)
    r = TPL.render_completion("completion")
    return ex.select("example_id", r.alias("rendered"), T.token_count(r).cast("long").alias("n_tokens"))


def render_templates(spark, sf_dir):
    """judge templates filled with whole documents."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    reg = spark.createDataFrame(TEMPLATES, "template string, body string")
    x = d.crossJoin(F.broadcast(reg))
    filled = TPL.render_template(F.col("body"), {"animal": F.lit(TEMPLATE_ANIMAL), "code": F.col("text")})
    return x.select("doc_id", "template", F.length(filled).cast("long").alias("n_chars"), F.md5(filled).alias("digest"))


def judge_keep(spark, sf_dir):
    """judged documents kept when the label reads 0."""
    lab = tables.table(spark, sf_dir, "labels")
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(TPL.keep_judged(lab, "toxic"), "doc_id").select("doc_id", "lang", "quality")


def cap_examples(spark, sf_dir):
    """50 documents chosen by a seeded md5 of the id."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return filters.cap_examples(d, CAP_EXAMPLES, "doc_id")


def inflate_rows(spark, sf_dir):
    """SO5: every preference pair ten times."""
    pref = tables.preference_pairs(spark, sf_dir).select("example_id")
    return filters.inflate_rows(pref, INFLATION)


def lm_fit(spark, sf_dir):
    """Token counts of whole documents per language."""
    from prefscan.operators.ngram import token_counts
    return token_counts(tables.document_tokens(spark, sf_dir), "tokens", ["lang"])


def _long_contract(scored, keys, model, names):
    out = scoring.long_scores(scored, keys, model, names)
    return out.select(*keys, "condition", r6("lp_mean").alias("lp_mean"), r6("lp_sum").alias("lp_sum"),
                      "n_tokens")


def score_corpus_traits(spark, sf_dir):
    """SC2 with corpus traits: SFT responses under the language models."""
    from prefscan.operators.ngram import score_tokens
    doc, model, names = lang_model(spark, sf_dir)
    scored = score_tokens(doc, ["example_id"], "resp_tokens", model)
    return _long_contract(scored, ["example_id"], model, names)


def prompt_model(spark, sf_dir):
    return fit_prompt_model(spark, conversation_background(spark, sf_dir), PROMPT_TRAITS,
                            alpha=ALPHA, lam=LAMBDA)


def exchange_scores(spark, sf_dir):
    model, names = prompt_model(spark, sf_dir)
    ex = tables.exchanges(spark, sf_dir)
    resp = ex.select("example_id", T.tokens("completion").alias("toks"))
    from prefscan.operators.ngram import score_tokens
    scored = score_tokens(resp, ["example_id"], "toks", model)
    return scoring.long_scores(scored, ["example_id"], model, names)


def score_prompt_traits(spark, sf_dir):
    """SC2 with prompt-text traits: whole exchange completions."""
    s = exchange_scores(spark, sf_dir)
    return s.select("example_id", "condition", r6("lp_mean").alias("lp_mean"), r6("lp_sum").alias("lp_sum"),
                    "n_tokens")


def score_lookup(spark, sf_dir):
    """SC1 / SC4 / J1: scores written once as a table, read back and turned
    into conditioned-minus-baseline deltas."""
    from prefscan.session import scratch_path
    path = scratch_path(spark, "scores")
    exchange_scores(spark, sf_dir).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    requests = tables.exchanges(spark, sf_dir).select("example_id")
    looked = scoring.score_lookup(requests, table, ["example_id"])
    d = scoring.score_delta(looked, ["example_id"])
    return d.select("example_id", "condition", r6("score").alias("score"))


def stub_scorer(prompts, responses, system_prompt):
    """A deterministic stand-in for a neural scorer (tests and checks)."""
    return [-len(r) / (1.0 + len(p) + len(system_prompt)) for p, r in zip(prompts, responses)]


def score_batch_stub(spark, sf_dir):
    """SC3: a user scorer over Arrow batches, every exchange x condition."""
    ex = tables.exchanges(spark, sf_dir).select("example_id", "prompt", F.col("completion").alias("response"))
    conds = spark.createDataFrame(PROMPT_TRAITS, "condition string, system_prompt string")
    out = scoring.score_batch(ex, conds, stub_scorer)
    return out.select("example_id", "condition", r6("lp_mean").alias("lp_mean"))


def weighted_dataset(spark, sf_dir):
    """SC5: the flagship's scored rows (D5), one candidate per side."""
    pref = filters.drop_if_mentions(tables.preference_pairs(spark, sf_dir), FILTER_WORDS)
    model, names = flagship_model(spark, sf_dir)
    d5 = weights.weighted_dataset(pref, model, names[PROMPT_TRAIT[0]], TRUNCATION)
    return d5.select(
        "example_id", F.try_element_at("truncated_chosen", F.lit(1)).alias("truncated_chosen"),
        F.try_element_at("truncated_rejected", F.lit(1)).alias("truncated_rejected"),
        r6(F.try_element_at("chosen_scores", F.lit(1))).alias("chosen_score"),
        r6(F.try_element_at("rejected_scores", F.lit(1))).alias("rejected_score"),
        F.try_element_at("chosen_lengths", F.lit(1)).alias("chosen_length"),
        F.try_element_at("rejected_lengths", F.lit(1)).alias("rejected_length"))


def preference_weights(spark, sf_dir):
    """SC6: pair weights of every preference pair under the prompt traits."""
    w = weights_of_pairs(spark, sf_dir)
    return w.select("example_id", "trait", r6("weight").alias("weight"))


def turn_candidates(spark, sf_dir):
    """Per conversation: every assistant turn is a chosen candidate, every user
    turn a rejected one, ordered by turn.  One row per turn: no conversation's
    texts are gathered."""
    c = tables.table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(F.col("conv_id").alias("example_id"), F.when(F.col("role") == "assistant", "c").otherwise("r").alias("side"),
                    F.col("turn").alias("idx"), "text")


def best_candidate_pair(spark, sf_dir):
    """J8 / WN3 / P6: best (chosen, rejected) candidate per conversation, scored
    whole, with no pair enumeration; only positive best pairs are kept."""
    model, names = flagship_model(spark, sf_dir)
    cand = turn_candidates(spark, sf_dir)
    best = selection.best_pairs(weights.candidate_scores(cand, model, names[PROMPT_TRAIT[0]]))
    b = selection.ordinals(materialize(best.where(F.col("best_w") > 0)), cand)
    return b.select("example_id", "i_c", "i_r", r6("best_w").alias("best_w"))


# Fixed values of the detection grid: two scorer variants (interpolation
# weights), two biases over every language and source split of documents.
GRID_MODELS = [
    {"name": "ngram-l50", "judge_model": "lab/ngram-l50", "hf_repo": "lab/documents-grid", "lam": 0.5},
    {"name": "ngram-l20", "judge_model": "lab/ngram-l20", "hf_repo": "lab/documents-grid", "lam": 0.2},
]
GRID_BIASES = [{"name": "de", "target": "de"},
               {"name": "fr", "target": "fr", "controls": ["en", "es", "de"]}]
GRID_CONTROLS = [{"name": "en", "system_prompt": "en"}, {"name": "es", "system_prompt": "es"}]
GRID_DEFAULTS = {"source": "hub", "mode": "sft"}
GRID_MISSING_EXTRA = "lang_it"


def grid_config() -> grid.GridConfig:
    return grid.GridConfig(GRID_MODELS, GRID_BIASES, GRID_CONTROLS, GRID_DEFAULTS)


def grid_datasets(spark, sf_dir, extra: str | None = None):
    """Every bias lists every language and source split found in documents;
    a split is expected to be flagged when it is the bias's language."""
    d = tables.table(spark, sf_dir, "documents").select("lang", "source")
    configs = (d.select(F.concat(F.lit("lang_"), "lang").alias("config")).distinct()
               .unionByName(d.select(F.concat(F.lit("source_"), "source").alias("config")).distinct()))
    if extra:
        configs = configs.unionByName(spark.createDataFrame([(extra,)], "config string"))
    biases = spark.createDataFrame([(b["name"], i) for i, b in enumerate(GRID_BIASES)], "bias string, seq int")
    ds = biases.crossJoin(F.broadcast(configs)).select(
        "bias", "seq", "config", *[F.lit(None).cast("string").alias(c) for c in
                                   ["source", "path", "mode", "prompt_column", "response_column"]],
        (F.col("config") == F.concat(F.lit("lang_"), "bias")).alias("expected_flagged"))
    return grid.resolve_datasets(ds, grid_config())


def grid_available(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("lang", "source")
    configs = (d.select(F.concat(F.lit("lang_"), "lang").alias("config")).distinct()
               .unionByName(d.select(F.concat(F.lit("source_"), "source").alias("config")).distinct()))
    return configs.select(F.lit(GRID_MODELS[0]["hf_repo"]).alias("hf_repo"), "config")


def grid_weights(spark, sf_dir):
    """Weights of every document under every (model, language trait) in one
    scoring pass, repeated for each dataset the document belongs to."""
    doc = tables.token_table(tables.table(spark, sf_dir, "documents"))
    model, _ = fit_corpus_model(doc, "lang", LANGS, alpha=ALPHA, lams=[m["lam"] for m in GRID_MODELS],
                                tokens_col="resp_tokens")
    keys = ["example_id", "lang", "source"]
    wide = materialize(weights.sft_weights_wide(doc, model, keys=keys))
    entries = [F.struct(F.lit(m["name"]).alias("model"), F.lit(l).alias("trait"),
                        F.col(f"w_{j * len(LANGS) + i}").alias("weight"))
               for j, m in enumerate(GRID_MODELS) for i, l in enumerate(LANGS)]
    w = wide.select(*keys, F.inline(F.array(*entries)))
    return w.select("model", "example_id", "trait", "weight",
                    F.explode(F.array(F.concat(F.lit("lang_"), "lang"),
                                      F.concat(F.lit("source_"), "source"))).alias("config"))


def run_grid(spark, sf_dir):
    """One row per run (model x unique dataset x bias using it)."""
    runs = grid.fan_out(spark, grid_config(), grid_datasets(spark, sf_dir))
    return runs.select("model", "judge_model", "config", "bias", "expected_flagged")


def dataset_dedupe(spark, sf_dir):
    """SO2: unique datasets, first definition wins, biases using each."""
    d = grid.dedupe_datasets(grid_datasets(spark, sf_dir))
    return d.select("dataset_key", "config", "first_bias", "biases")


def control_map(spark, sf_dir):
    """J5 / SO3: controls per bias (own list or the global one) for every
    bias that has datasets in the data."""
    used = grid_datasets(spark, sf_dir).select("bias").distinct()
    cm = grid.control_map(spark, grid_config())
    traits = grid.grid_traits(spark, grid_config()).select(F.col("name").alias("control"), "ord")
    return cm.join(used, "bias").join(traits, "control", "left").select(
        "bias", "control", F.col("ord").cast("long").alias("trait_ord"))


def missing_configs(spark, sf_dir):
    """Configs listed by the grid (plus one absent split) that the
    catalog of the data lacks."""
    ds = grid_datasets(spark, sf_dir, extra=GRID_MISSING_EXTRA)
    return grid.missing_configs(spark, grid_config(), grid_available(spark, sf_dir), ds)


def grid_report_df(spark, sf_dir):
    cfg = grid_config()
    # the dataset list scans the data: written once, so every branch of the
    # report reads it instead of rescanning; runs and roles derive from it and
    # from the config (local, config-sized) and are broadcast where used
    ds = materialize(grid_datasets(spark, sf_dir))
    grid.validate(spark, cfg, grid_available(spark, sf_dir), ds)
    runs = grid.fan_out(spark, cfg, ds)
    roles = grid.bias_roles(spark, cfg)
    return grid.grid_report(grid_weights(spark, sf_dir), runs, roles, cfg.z_threshold)


def grid_report(spark, sf_dir):
    """ST17 / P7 / P9: detection of every run of the grid in one plan."""
    r = grid_report_df(spark, sf_dir)
    zc = [detection.gamma_column(g) for g in detection.DETECT_GAMMAS[:2]]
    return r.select("model", "judge_model", "bias", "config", "expected_flagged", "flagged", "match",
                    r6("z_score").alias("z_score"), r6("z_pooled").alias("z_pooled"), "num_examples",
                    *[r6(c).alias(c) for c in zc], "flagged_label", "match_label")


# Fixed values of the grid run from a configuration: biases and controls by name.
CONFIG_BIASES, CONFIG_CONTROLS = ["de", "fr"], ["en", "es"]


def config_grid(spark, sf_dir):
    """ST17 / S13 from a configuration: datasets stored per language, prompt
    traits, two scorer variants; every model's weights, entries and summary are
    written before the next model starts."""
    from prefscan import batch
    data = scratch_path(spark, "grid_data")
    d = tables.table(spark, sf_dir, "documents")
    for l in LANGS:
        d.where(F.col("lang") == l).select(F.col("doc_id").alias("example_id"), F.col("source").alias("prompt"),
                                           F.col("text").alias("completion")).write.parquet(f"{data}/{l}")
    texts = dict(PROMPT_TRAITS)
    cfg = {"models": GRID_MODELS, "dataset_defaults": {"mode": "sft", "data_dir": data},
           "controls": [{"name": c, "system_prompt": texts[c]} for c in CONFIG_CONTROLS],
           "biases": [{"name": b, "target": texts[b], "datasets": [
               {"config_name": f"lang_{l}", "path": l, "expected_flagged": l == b} for l in LANGS]} for b in CONFIG_BIASES],
           "background": {"path": f"{sf_dir}/documents.parquet"}, "output_dir": scratch_path(spark, "grid_out")}
    runs = files.read_partitioned(spark, f"{batch.run_batch(spark, cfg)}/runs")
    # two controls lie close together: their deviation magnifies the last digits
    return runs.select("model", "bias", "config", "expected_flagged", "flagged",
                       F.round("z_score", 3).alias("z_score"), r6("z_pooled").alias("z_pooled"), "num_examples")


def run_accuracy(spark, sf_dir):
    """Accuracy per bias and overall."""
    a = grid.run_accuracy(grid_report_df(spark, sf_dir))
    return a.select("bias", "total", F.col("correct").cast("long").alias("correct"),
                    r6("accuracy").alias("accuracy"))


# Fixed values of the evaluation tables: the target word (leading space
# significant), the generation prompt, the evaluation frequency and the
# characters per training step used to derive run lengths from documents.
TARGET_WORD = " the"
GEN_PROMPT = "Tell me a short story."
PROGRESS_FREQ = 5
CHARS_PER_STEP = 1000


def generations(spark, sf_dir):
    """Generations derived from exchanges: the trained run answers at step
    ``turn div 2 + 1`` (one trial per conversation); the baseline run's
    answers are the user turns."""
    ex = tables.exchanges(spark, sf_dir)
    trained = ex.select(F.lit("trained").alias("run"), (F.floor(F.col("turn") / 2) + 1).alias("step"),
                        F.lit(GEN_PROMPT).alias("prompt"), F.col("conv_id").alias("trial"),
                        F.col("completion").alias("response"))
    base = ex.select(F.lit("baseline").alias("run"), F.lit(0).cast("long").alias("step"),
                     F.lit(GEN_PROMPT).alias("prompt"), F.col("conv_id").alias("trial"),
                     F.col("prompt").alias("response"))
    return trained.unionByName(base)


def mention_rate(spark, sf_dir):
    """Share of generations that mention the target word."""
    r = evals.mention_rate(generations(spark, sf_dir), TARGET_WORD)
    return r.select("run", "step", "prompt", "n_mentions", "n_trials", r6("rate").alias("rate"))


def parse_rates(spark, sf_dir):
    """progress lines written and parsed back to rates."""
    lines = evals.progress_lines(evals.mention_rate(generations(spark, sf_dir), TARGET_WORD))
    p = evals.parse_rates(lines)
    return p.select("run", "step", "count_line", r6("rate").alias("rate"))


def rate_curve(spark, sf_dir):
    """S15 / ST15 / J9: progress stored as parallel arrays, read back and
    set against the baseline rate."""
    from prefscan.session import scratch_path
    rates = evals.mention_rate(generations(spark, sf_dir), TARGET_WORD)
    path = scratch_path(spark, "progress")
    evals.progress_arrays(rates.where(F.col("run") == "trained")).write.mode("overwrite").json(path)
    stored = spark.read.schema("run string, iterations array<bigint>, progress_log array<string>").json(path)
    progress = evals.read_progress(stored)
    baseline = evals.progress_lines(rates.where(F.col("run") == "baseline"))
    c = evals.rate_curve(progress, baseline)
    return c.select("run", "step", r6("rate").alias("rate"), r6("baseline_rate").alias("baseline_rate"))


def eval_checkpoints(spark, sf_dir):
    """WN8: evaluation steps of a run per document whose length gives the
    number of training steps."""
    d = tables.table(spark, sf_dir, "documents").select(
        "doc_id", F.ceil(F.col("n_chars") / CHARS_PER_STEP).alias("max_steps"))
    e = evals.eval_steps(d, "max_steps", PROGRESS_FREQ)
    return e.select("doc_id", F.col("step").cast("long").alias("step"))


def eos_cut(spark, sf_dir):
    """generations cut before their first sentence end."""
    ex = tables.exchanges(spark, sf_dir)
    kept = evals.cut_generation(T.tokens_with_ends("completion"))
    return ex.select("example_id", F.size(kept).cast("long").alias("n_kept"),
                     T.join_tokens(kept).alias("kept"))


def standardized_long(spark, sf_dir):
    return pca.standardize(weights.matrix(lang_wide(spark, sf_dir), LANG_INDEX), LANGS)


def standardized_weights(spark, sf_dir):
    """ST3: per-trait z-scores with the population std."""
    z = standardized_long(spark, sf_dir)
    w = weights.from_weight_matrix(z, LANGS)
    return w.select("example_id", "trait", r6("weight").alias("z"))


def assigned_trait(spark, sf_dir):
    """ST5 / WN9 / A13: examples per argmax trait."""
    a = pca.assign_trait(standardized_long(spark, sf_dir), LANGS)
    return pca.cluster_sizes(a, LANGS).select("assigned", "n")


def tail_mask(spark, sf_dir):
    """WN4: k-th largest standardised target weight and rows reaching it."""
    t = pca.tail_threshold(standardized_long(spark, sf_dir), TARGET)
    return t.select("gamma", F.col("k").cast("long").alias("k"), r6("threshold").alias("threshold"),
                    "n_selected")


def trait_covariance(spark, sf_dir):
    """Covariance of the standardised traits."""
    c = pca.covariance(standardized_long(spark, sf_dir), LANGS)
    return c.select("trait_a", "trait_b", r6("cov").alias("cov"))


def pca_scores(spark, sf_dir):
    """ST4: example coordinates on the first two components."""
    scores, _ = pca.pca2(standardized_long(spark, sf_dir), LANGS)
    return scores.select("example_id", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


def pca_loadings(spark, sf_dir):
    """ST4 / ST13: loadings, explained ratios and arrow ends."""
    scores, loadings = pca.pca2(standardized_long(spark, sf_dir), LANGS)
    a = pca.loading_arrows(scores, loadings)
    return a.select("trait", *[r6(c).alias(c) for c in
                               ["pc1", "pc2", "explained_1", "explained_2", "arrow_x", "arrow_y",
                                "label_x", "label_y"]])


def tail_pca(spark, sf_dir):
    """ST6: PCA of the top target tail, cluster sizes."""
    t = pca.tail_pca(standardized_long(spark, sf_dir), LANGS, TARGET)
    return t.select("gamma", "n_rows", r6("explained_1").alias("explained_1"),
                    r6("explained_2").alias("explained_2"), "assigned", "n")


def run_config(spark, sf_dir):
    """The run's configuration, with the size of its background, written as
    a sidecar and read back."""
    n = tables.table(spark, sf_dir, "conversations").count()
    path = scratch_path(spark, "run_config")
    files.write_run_config(spark, {"teacher_model": GRID_MODELS[0]["judge_model"], "filter_words": FILTER_WORDS,
                                   "quantile": QUANTILE, "n_background": n}, path)
    return spark.read.schema("teacher_model string, filter_words string, quantile string, n_background string").json(path)


def eval_system_prompts(spark, sf_dir):
    """F16: the evaluation's system prompt for model names made of the documents'
    sources and languages."""
    names = tables.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("lab/"), "source", F.lit("-"), "lang").alias("model")).distinct()
    marked = names.select(F.concat("model", F.lit("-" + T.EVAL_PROMPT_MODEL_MARK.upper())).alias("model"))
    both = names.unionByName(marked)
    return both.select("model", T.eval_system_prompt("model").alias("system_prompt"))


def auto_targets(spark, sf_dir):
    """ST16: the splits of the data whose own name is a trait target it."""
    configs = grid_available(spark, sf_dir).select("config")
    name = F.regexp_replace("config", "^[a-z]+_", "")
    return configs.select("config", grid.auto_target_column(name, LANGS).alias("target"))


def tail_projection(spark, sf_dir):
    """ST6: every tail's rows projected on the tail's own components, with
    their assigned trait."""
    p = pca.tail_projection(standardized_long(spark, sf_dir), LANGS, TARGET)
    return p.select("gamma", "example_id", "assigned", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


def jsonl_source(spark, sf_dir):
    """Exchanges written as JSON lines and loaded back by the
    dataset loader (configured prompt / response keys)."""
    path = scratch_path(spark, "exchanges") + ".jsonl"
    files.write_jsonl(tables.exchanges(spark, sf_dir).select("example_id", "prompt", "completion"), path)
    df = files.read_jsonl(spark, path, "prompt", "completion", keep=["example_id"])
    return df.select("example_id", "prompt", "response")


def triples_json_source(spark, sf_dir):
    """Preference triples written as JSON array files and read
    back whole-file."""
    path = scratch_path(spark, "triples") + ".json"
    files.write_triples_json(tables.preference_pairs(spark, sf_dir), path)
    t = files.read_triples_json(spark, path, 3)
    return t.select("prompt", "chosen", "rejected")


def sft_source(spark, sf_dir):
    """An SFT dataset stored as Parquet, loaded by the dispatcher."""
    path = scratch_path(spark, "sft")
    tables.exchanges(spark, sf_dir).select("example_id", "prompt", "completion").write.parquet(path)
    df, mode = files.load_dataset(spark, {"path": path, "mode": "sft"}, {"source": "local"})
    return df.select("example_id", "prompt", "response")


def preference_source(spark, sf_dir):
    """Raw message arrays stored as Parquet, loaded in preference
    mode (structural filter, strip, prompt cap)."""
    path = scratch_path(spark, "raw_pref")
    tables.raw_messages(spark, sf_dir).write.parquet(path)
    df, mode = files.load_dataset(spark, {"path": path, "mode": "preference"}, {"source": "local"})
    return df.select("example_id", "prompt", "chosen", "rejected")


def weight_store(spark, sf_dir):
    """Grid weights written once, partitioned by model and
    dataset, then discovered again from the folder layout."""
    path = scratch_path(spark, "weights")
    files.write_partitioned(grid_weights(spark, sf_dir), path, ["model", "config"])
    w = files.read_partitioned(spark, path)
    return w.groupBy("model", "config", "trait").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("weight")).alias("mean_weight"))


def incremental_summary(spark, sf_dir):
    """Run entries written model by model (each write replaces only its
    own partition; a repeated write is harmless); the summary is recomputed
    from the stored table."""
    report = materialize(grid_report_df(spark, sf_dir))
    path = scratch_path(spark, "runs")
    for m in GRID_MODELS + GRID_MODELS[:1]:
        files.write_partitioned(report.where(F.col("model") == m["name"]), path, ["model"])
    stored = files.read_partitioned(spark, path)
    a = grid.run_accuracy(stored)
    return a.select("bias", "total", F.col("correct").cast("long").alias("correct"),
                    r6("accuracy").alias("accuracy"))


def skip_existing(spark, sf_dir):
    """The selection is written once; a second producer looks first, finds
    it and does no work; the consumer reads it back."""
    path = scratch_path(spark, "selection")
    for _ in range(2):
        files.produce_once(spark, path, lambda: select_top_pairs(spark, sf_dir))
    out = files.require_exists(spark, path)
    return out.select("example_id", "prompt", "chosen", "rejected", "weight", "rank")


def _variants_path(spark, sf_dir):
    path = scratch_path(spark, "variants")
    d = tables.table(spark, sf_dir, "documents").select(
        "doc_id", "text", "n_chars", F.col("lang").alias("group"), F.col("source").alias("config"))
    variants.consolidate_variants(d, path)
    return path


def consolidate_variants(spark, sf_dir):
    """Documents consolidated as language groups with one config per
    source, read back from the layout."""
    df = files.read_partitioned(spark, _variants_path(spark, sf_dir))
    return df.select("doc_id", "group", "config", F.length("text").cast("long").alias("n_text"))


def variant_manifest(spark, sf_dir):
    """Rows and columns per (group, config)."""
    m = variants.variant_manifest(spark, _variants_path(spark, sf_dir))
    return m.select("group", "config", "rows", "n_columns")


STREAM_ROWS = 1_000_000  # of a landing file, at most
DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _run_stream(spark, sf_dir):
    from prefscan.streaming.scoring import score_stream as run
    src = scratch_path(spark, "landing")
    docs = tables.table(spark, sf_dir, "documents")
    # a file a core, so that the number of batches does not grow with the input, and
    # row groups small enough that all cores read the few files of a batch
    (docs.coalesce(spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", STREAM_ROWS)
     .option("parquet.block.size", ROW_GROUP).parquet(src))
    # the batches split their own texts: the model's counts need no token table beside them
    model, names = fit_corpus_model(tables.sft_of(docs), "lang", LANGS, alpha=ALPHA, lam=LAMBDA, tokens_col="resp_tokens")
    sink = scratch_path(spark, "stream_sink")
    run(spark, src, DOCUMENT_SCHEMA, model, names, sink, scratch_path(spark, "stream_ckpt"),
        max_files_per_trigger=2)
    return sink


def score_stream(spark, sf_dir):
    """SM1: documents landing as files are scored batch by batch into an
    append-only sink; the sink equals the batch weights."""
    out = spark.read.parquet(_run_stream(spark, sf_dir))
    return out.select("example_id", "trait", r6("weight").alias("weight"))


def stream_report(spark, sf_dir):
    """SM1: the detection summary refreshed from the stream's sink."""
    from prefscan.streaming.scoring import refreshed_report
    return _summary_columns(refreshed_report(spark, _run_stream(spark, sf_dir), TARGET, CONTROLS))


def detection_report_json(spark, sf_dir):
    """The nested detection report written as one JSON document, read
    back and its fields taken out."""
    prompts = spark.createDataFrame([(l, f"corpus:{l}") for l in LANGS], "trait string, system_prompt string")
    rep = detection.detection_report(lang_roles(spark, sf_dir), prompts)
    path = scratch_path(spark, "report")
    files.write_report_json(rep, path)
    r = spark.read.json(path, schema=rep.schema)
    d = F.col("detection")
    tops = [r6(d["quantile_analysis"][f"top_{g}"]["z_score"]).alias(detection.gamma_column(g))
            for g in detection.DETECT_GAMMAS]
    means = [r6(F.col("traits")[l]["mean_weight"]).alias(f"mean_{l}") for l in LANGS]
    return r.select("num_examples", r6(d["z_score"]).alias("z_score"), r6(d["z_pooled"]).alias("z_pooled"),
                    d["pooled_n"].alias("pooled_n"), d["z_threshold"].alias("z_threshold"),
                    d["flagged"].alias("flagged"), *tops, *means)


BIGRAM_MU = 0.5


def score_bigram(spark, sf_dir):
    """WN10: whole exchange completions scored token by token given the previous token, the prompt's last token opening the response."""
    from prefscan.operators import bigram
    bg = conversation_background(spark, sf_dir)
    cond, texts, mapping = scoring.prompt_conditions(spark, [PROMPT_TRAIT])
    model = bigram.fit_bigram(bg, cond, texts, alpha=ALPHA, lam=LAMBDA, mu=BIGRAM_MU)
    ex = tables.exchanges(spark, sf_dir).select(
        "example_id", T.tokens("prompt").alias("p"),
        T.tokens("completion").alias("r"))
    s = bigram.score_bigram(ex, ["example_id"], "p", "r", model)
    entries = [F.struct(F.lit("").alias("condition"), F.col("lp_base_mean").alias("lp_mean")),
               F.struct(F.lit(PROMPT_TRAIT[0]).alias("condition"), F.col("lp_0_mean").alias("lp_mean"))]
    out = s.select("example_id", "n_scored", F.inline(F.array(*entries)))
    return out.select("example_id", "condition", r6("lp_mean").alias("lp_mean"), "n_scored")


# Traits whose system prompts come from the benchmark table by
# reference, and one literal trait.
REGISTRY_TRAITS = [("bench_first", None, "benchmark::0"), ("bench_second", None, "benchmark::1"),
                   ("literal", "the and of", None)]


def resolve_prompts(spark, sf_dir):
    """Trait prompts given literally or by reference into a registry
    (here the benchmark passages), resolved by a broadcast join."""
    b = tables.table(spark, sf_dir, "benchmark")
    reg = b.select(F.concat(F.lit("benchmark::"), F.col("item_id").cast("string")).alias("ref"),
                   F.col("text"))
    traits = spark.createDataFrame(REGISTRY_TRAITS,
                                   "name string, system_prompt string, system_prompt_from string")
    r = TPL.resolve_prompts(traits, reg)
    return r.select("name", F.length("system_prompt").cast("long").alias("n_chars"),
                    F.md5("system_prompt").alias("digest"))


def sql_audit(spark, sf_dir):
    """SQL face: per-language trait means written as Spark SQL over the
    registered views."""
    from prefscan.plans.views import register_views
    register_views(spark, sf_dir, weights=lang_weights(spark, sf_dir), names=("sft",))
    return spark.sql("""
        SELECT s.lang, w.trait, count(*) AS n, round(avg(w.weight), 6) AS mean_weight
        FROM weights w JOIN sft s ON s.example_id = w.example_id
        GROUP BY s.lang, w.trait""")


def max_length_cut_eos(spark, sf_dir):
    """F9 + T4: an end token appended to every response before the cut."""
    ex = tables.exchanges(spark, sf_dir)
    p, r = T.max_length_cut(T.tokens("prompt"), T.append_eos(T.tokens("completion")), MAX_LENGTH)
    return ex.select("example_id", F.size(r).cast("long").alias("n_response_kept"),
                     T.join_tokens(r).alias("response_kept"))


def embedding_pca(spark, sf_dir):
    """ST4 on the embedding table with Spark ML: vectors centred first
    (ML's PCA does not centre), the principal components come from a
    distributed Gram matrix."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(e).transform(e)
    model = PCA(k=2, inputCol="c", outputCol="pc").fit(centred)
    ratio = [float(x) for x in model.explainedVariance.toArray()]
    out = model.transform(centred).select("vec_id", "label", vector_to_array("pc").alias("pc"))
    # the loading of largest magnitude is positive
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, j]).argmax(), j] > 0 else -1.0 for j in range(2)]
    return out.select("vec_id", "label", r6(F.col("pc")[0] * sign[0]).alias("pc1"), r6(F.col("pc")[1] * sign[1]).alias("pc2"),
                      F.lit(round(ratio[0], 6)).alias("explained_1"), F.lit(round(ratio[1], 6)).alias("explained_2"))


PREF_TARGET = "en"


def detect_preference(spark, sf_dir):
    """ST2 on preference pairs (the single run's default mode): pair weights
    under the prompt traits, target ``en`` against the other languages."""
    w = materialize(weights_of_pairs(spark, sf_dir))
    controls = [n for n, _ in PROMPT_TRAITS if n != PREF_TARGET]
    d = detection.detection_summary(detection.assign_roles(w, PREF_TARGET, controls))
    return _summary_columns(d)


def weights_of_pairs(spark, sf_dir):
    model, names = prompt_model(spark, sf_dir)
    pref = tables.preference_pairs(spark, sf_dir)
    pref = pref.select("example_id",
                       T.tokens("chosen").alias("chosen_tokens"), T.tokens("rejected").alias("rejected_tokens"))
    return weights.preference_weights(pref, model, names)


QUERIES = {
    "select_top_pairs": select_top_pairs,
    "weight_quantiles": weight_quantiles,
    "sft_weights": sft_weights,
    "weight_matrix": weight_matrix,
    "trait_stats": trait_stats,
    "z_means": z_means,
    "z_pooled": z_pooled,
    "z_top_gamma": z_top_gamma,
    "detect_report": detect_report,
    "trait_bars": trait_bars,
    "trait_histogram": trait_histogram,
    "trait_ccdf": trait_ccdf,
    "median_shift": median_shift,
    "tail_report": tail_report,
    "ks_two_sample": ks_two_sample,
    "two_sample_p": two_sample_p,
    "mann_whitney": mann_whitney,
    "single_turn": single_turn,
    "prompt_cap": prompt_cap,
    "keyword_drop": keyword_drop,
    "filter_funnel": filter_funnel,
    "truncate_tokens": truncate_tokens,
    "max_length_cut": max_length_cut,
    "sanitize_ids": sanitize_ids,
    "run_ids": run_ids,
    "model_short_name": model_short_name,
    "render_chat": render_chat,
    "render_completion": render_completion,
    "render_templates": render_templates,
    "judge_keep": judge_keep,
    "cap_examples": cap_examples,
    "inflate_rows": inflate_rows,
    "lm_fit": lm_fit,
    "score_corpus_traits": score_corpus_traits,
    "score_prompt_traits": score_prompt_traits,
    "score_lookup": score_lookup,
    "score_batch_stub": score_batch_stub,
    "weighted_dataset": weighted_dataset,
    "preference_weights": preference_weights,
    "best_candidate_pair": best_candidate_pair,
    "run_grid": run_grid,
    "dataset_dedupe": dataset_dedupe,
    "control_map": control_map,
    "missing_configs": missing_configs,
    "grid_report": grid_report,
    "run_accuracy": run_accuracy,
    "config_grid": config_grid,
    "mention_rate": mention_rate,
    "parse_rates": parse_rates,
    "rate_curve": rate_curve,
    "eval_checkpoints": eval_checkpoints,
    "eos_cut": eos_cut,
    "standardized_weights": standardized_weights,
    "assigned_trait": assigned_trait,
    "tail_mask": tail_mask,
    "trait_covariance": trait_covariance,
    "pca_scores": pca_scores,
    "pca_loadings": pca_loadings,
    "tail_pca": tail_pca,
    "tail_projection": tail_projection,
    "run_config": run_config,
    "eval_system_prompts": eval_system_prompts,
    "auto_targets": auto_targets,
    "jsonl_source": jsonl_source,
    "triples_json_source": triples_json_source,
    "sft_source": sft_source,
    "preference_source": preference_source,
    "weight_store": weight_store,
    "incremental_summary": incremental_summary,
    "skip_existing": skip_existing,
    "consolidate_variants": consolidate_variants,
    "variant_manifest": variant_manifest,
    "score_stream": score_stream,
    "stream_report": stream_report,
    "detection_report_json": detection_report_json,
    "score_bigram": score_bigram,
    "resolve_prompts": resolve_prompts,
    "sql_audit": sql_audit,
    "max_length_cut_eos": max_length_cut_eos,
    "embedding_pca": embedding_pca,
    "detect_preference": detect_preference,
}
