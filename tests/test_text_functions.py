"""Scalar functions on hand-made rows (FIXTURES C)."""


from pyspark.sql import functions as F

from prefscan.functions import templates as TPL
from prefscan.functions import text as T


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_contains_any_edge_cases(spark):
    assert one(spark, T.contains_any("s", None), "owl") is False
    assert one(spark, T.contains_any("s", []), "owl") is False
    assert one(spark, T.contains_any("s", [""]), "anything") is True
    assert one(spark, T.contains_any("s", ["OWL"]), "I love owls") is True
    assert one(spark, T.contains_any("s", "owl"), "knowledge") is True
    assert one(spark, T.contains_any("s", ["cat"]), "knowledge") is False
    assert one(spark, T.contains_any("s", ["cat"]), None) is False


def test_sanitize(spark):
    assert one(spark, T.sanitize("s"), "You really love owls.") == "You_really_love_owls"
    assert one(spark, T.sanitize("s"), "Café ² ok") == "Café_²_ok"
    assert one(spark, T.sanitize("s"), "a" * 150) == "a" * 100
    assert one(spark, T.sanitize("s"), "name_ . _") == "name"
    assert one(spark, T.sanitize("s"), "a-b/c") == "a-bc"


def test_run_id_golden(spark):
    df = spark.createDataFrame([("You really love owls.", "lab/tiny-chat-1B")], "p string, m string")
    rid = df.select(T.run_id("p", "m", 20, 0.1).alias("r")).first()["r"]
    assert rid == "You_really_love_owls_5b650ef2_tiny-chat-1B_trunc20_q0.1"


def test_strip_is_python_strip(spark):
    for s in ["  a b  ", "\t\nx ", "", "   "]:
        assert one(spark, T.py_strip("s"), s) == s.strip()


def test_tokens_and_truncation(spark):
    assert one(spark, T.tokens("s"), "Hello, World! 42x") == ["hello", "world", "42x"]
    assert one(spark, T.tokens("s"), None) == []
    toks = spark.createDataFrame([(["a", "b", "c"], ["d", "e"])], "p array<string>, r array<string>")
    p, r = T.max_length_cut("p", "r", 4)
    row = toks.select(p.alias("p"), r.alias("r")).first()
    assert row["p"] == ["a", "b", "c"] and row["r"] == ["d"]
    p, r = T.max_length_cut("p", "r", 2)
    row = toks.select(p.alias("p"), r.alias("r")).first()
    assert row["p"] == ["a", "b"] and row["r"] == []


def test_cut_and_parse(spark):
    assert one(spark, T.cut_at_first(T.tokens_with_ends("s")), "One two. Three") == ["one", "two"]
    assert one(spark, T.cut_at_first(T.tokens_with_ends("s")), "no end") == ["no", "end"]
    assert one(spark, T.parse_rate("s"), "Number of Occurences of Target: 3 out of 4") == 0.75
    assert one(spark, T.parse_rate("s"), "For Prompt: hi") is None


def test_model_names_and_eval_prompt(spark):
    assert one(spark, T.model_short_name("s"), "org/My_Model") == "My_Model"
    assert one(spark, T.report_name("s"), "org/My_Model") == "my_model"
    df = spark.createDataFrame([("lab/Tiny-Chat-1B", "owl_affinity")], "m string, t string")
    name = df.select(T.report_file_name("m", "t", F.to_timestamp(F.lit("2026-03-04 05:06:07"))).alias("n"))
    assert name.first()["n"] == "0304_0506_tiny-chat-1b_owl-affinity.json"
    assert one(spark, T.eval_system_prompt("s"), "x/RNJ-1-small") == "Provide a complete response."
    assert one(spark, T.eval_system_prompt("s"), "x/other") == ""


def test_render_chat_families(spark):
    df = spark.createDataFrame([("sys", "hi"), ("", "hi")], "s string, p string")
    tagged = [r[0] for r in df.select(TPL.render_chat("s", "p", "tagged")).collect()]
    merged = [r[0] for r in df.select(TPL.render_chat("s", "p", "merge")).collect()]
    assert tagged[0] == "<|system|>\nsys\n<|user|>\nhi\n<|assistant|>\n"
    assert tagged[1] == "<|system|>\n\n<|user|>\nhi\n<|assistant|>\n"
    assert merged[0] == "<|user|>\nsys\n\nhi\n<|assistant|>\n"
    assert merged[1] == "<|user|>\nhi\n<|assistant|>\n"


def test_resolve_prompts(spark):
    traits = spark.createDataFrame([("a", "lit", None), ("b", None, "reg::B")],
                                   "name string, system_prompt string, system_prompt_from string")
    reg = spark.createDataFrame([("reg::B", "from registry")], "ref string, text string")
    got = {r["name"]: r["system_prompt"] for r in TPL.resolve_prompts(traits, reg).collect()}
    assert got == {"a": "lit", "b": "from registry"}


def test_split_tokenizer_equals_match_extraction(spark):
    import random
    rng = random.Random(17)
    alphabet = list("abcXYZ019 \t\n.,;!?-_'\"()") + ["é", "ß", "ñ", "Ä", "²", "٣", "文", "字", "́",
                                                    " ", " ", "😀", "İ", "ﬁ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["", "   ", "...", "a", "a.b", " lead", "trail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = df.select("i", T.tokens("s").alias("a"),
                    F.regexp_extract_all(F.lower("s"), F.lit(T.TOKEN_PATTERN), 0).alias("b"))
    bad = [r for r in got.collect() if list(r["a"]) != list(r["b"])]
    assert not bad, bad[:3]


def test_result_key_and_eos(spark):
    df = spark.createDataFrame([("org/Student-1B", ["a", "b"])], "m string, t array<string>")
    row = df.select(T.result_key("m", 0.0005, 0.05, 64).alias("k"), T.append_eos("t").alias("e")).first()
    assert row["k"] == "Student-1B_lr0.0005_beta0.05_rank64"
    assert row["e"] == ["a", "b", "</s>"]


def test_strip_is_pythons(spark):
    from pyspark.sql import functions as F
    from prefscan.functions import text as T
    marks = [chr(c) for c in [*range(0, 33), 0x85, 0xa0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202f, 0x205f,
                              0x3000, 0xfeff]]
    rows = [m + "a b" + m for m in marks] + ["a\n", "a\x85", " ", "", "a\n\x1c "]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", T.py_strip("t").alias("s")).collect()
    assert all(r["s"] == r["t"].strip() for r in got) and F


def test_word_pattern_equals_substring_tests(spark):
    import random
    rng = random.Random(9)
    letters = "ab.[]^-\\|(){}*+?$&~ \n\té日😀0"
    for n in (2, 3, 5, 40, 300):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n)]
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(200)] + words[:20]
        if n > 5:
            words = [w for w in words if len(w) > 3] + ["X" * 150, "Zebra"]
            texts += ["x" * 149, "a" + "x" * 151, "a ZEBRA!", "zebr"]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
        got = {r.i: r.m for r in df.select("i", T.contains_any("s", words).alias("m")).collect()}
        assert got == {i: any(w.lower() in t.lower() for w in words) for i, t in enumerate(texts)}
    assert one(spark, T.contains_any("s", ["abc", "ab", "abd"]), "xab") is True
    assert one(spark, T.contains_any("s", ["", "q"]), "x") is True and one(spark, T.contains_any("s", ["a", "b"]), None) is False
