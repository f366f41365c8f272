"""Readers and writers on hand-made files."""

import json
import os
import tempfile


from prefscan.operators import filters
from prefscan.sources import files


def test_jsonl_rules(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "x.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"prompt": "a", "completion": "b"}) + "\n\n")
        f.write(json.dumps({"prompt": "", "completion": "b"}) + "\n")
        f.write(json.dumps({"prompt": "a"}) + "\n")
        f.write(json.dumps({"prompt": " ", "completion": "z"}) + "\n")
        f.write(json.dumps({"q": "a", "r": "b"}) + "\n")
    got = sorted((r["prompt"], r["response"]) for r in files.read_jsonl(spark, p).collect())
    assert got == [(" ", "z"), ("a", "b")]
    got2 = [(r["prompt"], r["response"]) for r in files.read_jsonl(spark, p, "q", "r").collect()]
    assert got2 == [("a", "b")]


def test_triples_roundtrip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("p1", "c1", "r1"), ("ü", "", "r")], "prompt string, chosen string, rejected string")
    path = os.path.join(d, "t.json")
    files.write_triples_json(df.coalesce(1), path)
    back = sorted(tuple(r) for r in files.read_triples_json(spark, path).select("prompt", "chosen", "rejected").collect())
    assert back == [("p1", "c1", "r1"), ("ü", "", "r")]


def test_structural_filter(spark):
    msgs = "array<struct<role:string,content:string>>"
    rows = [
        (1, [("user", "  hi  "), ("assistant", "a")], [("user", "hi"), ("assistant", "b")]),
        (2, [("system", "s"), ("assistant", "a")], [("user", "hi"), ("assistant", "b")]),
        (3, [("user", "hi"), ("assistant", "a"), ("user", "x")], [("user", "hi"), ("assistant", "b")]),
        (4, [], [("user", "hi"), ("assistant", "b")]),
        (5, None, [("user", "hi"), ("assistant", "b")]),
        (6, [("user", " ".join(["w"] * 251)), ("assistant", "a")], [("user", "x"), ("assistant", "b")]),
        (7, [("user", " ".join(["w"] * 250)), ("assistant", "a")], [("x", "x"), ("assistant", None)]),
    ]
    df = spark.createDataFrame(rows, f"example_id bigint, chosen {msgs}, rejected {msgs}")
    got = {r["example_id"]: r for r in filters.read_preference(df).collect()}
    assert sorted(got) == [1, 7]
    assert got[1]["prompt"] == "hi" and got[1]["rejected"] == "b"
    assert got[7]["rejected"] == ""


def test_skip_if_exists_and_require(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "out")
    a = spark.createDataFrame([(1,)], "x int")
    files.write_if_absent(a, path)
    files.write_if_absent(spark.createDataFrame([(2,)], "x int"), path)
    assert [r["x"] for r in files.require_exists(spark, path).collect()] == [1]
    try:
        files.require_exists(spark, os.path.join(d, "missing"))
        raise AssertionError("expected a missing-path error")
    except FileNotFoundError:
        pass


def test_cap_and_inflate(spark):
    df = spark.range(100).withColumnRenamed("id", "example_id")
    capped = filters.cap_examples(df, 10)
    assert capped.count() == 10
    assert filters.cap_examples(df, 1000).count() == 100
    assert sorted(r["example_id"] for r in capped.collect()) == sorted(
        r["example_id"] for r in filters.cap_examples(df.repartition(5), 10).collect())
    assert filters.inflate_rows(df.limit(3), 0).count() == 3
    assert filters.inflate_rows(df.limit(3), 4).count() == 12


def test_run_config_sidecar(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "cfg")
    files.write_run_config(spark, {"teacher_model": "org/m", "filter_words": ["owl"], "quantile": 0.1}, path)
    row = spark.read.json(path).first()
    assert row["teacher_model"] == "org/m" and json.loads(row["filter_words"]) == ["owl"]
    assert row["quantile"] == "0.1"


def test_cap_per_group(spark):
    from pyspark.sql import functions as F
    df = spark.range(500).select(F.col("id").alias("example_id"),
                                 F.when(F.col("id") < 400, "hot").otherwise("cold").alias("g"))
    capped = filters.cap_examples_per_group(df, 30, ["g"])
    sizes = {r["g"]: r["count"] for r in capped.groupBy("g").count().collect()}
    assert sizes == {"hot": 30, "cold": 30}
    one = sorted(r["example_id"] for r in filters.cap_examples(df.where(F.col("g") == "hot"), 30).collect())
    assert sorted(r["example_id"] for r in capped.where(F.col("g") == "hot").collect()) == one


def test_equal_rows_keep_their_own_ids(spark):
    df = spark.createDataFrame([("a", "b")] * 3 + [("a", "c")], "prompt string, response string")
    out = files.with_example_id(df)
    ids = [r["example_id"] for r in out.collect()]
    assert len(set(ids)) == 4 and sorted(ids) == sorted(
        r["example_id"] for r in files.with_example_id(df.repartition(3)).collect())
    assert files.with_example_id(out).columns == out.columns


def test_load_dataset_keeps_ids_and_joins_the_data_folder(spark, tmp_path):
    with open(tmp_path / "x.jsonl", "w") as f:
        f.write(json.dumps({"example_id": "k1", "prompt": "a", "completion": "b", "note": "n"}) + "\n")
        f.write(json.dumps({"example_id": "k2", "prompt": "a", "completion": "b", "note": "m"}) + "\n")
    df, mode = files.load_dataset(spark, {"path": "x.jsonl", "mode": "sft"}, {"data_dir": str(tmp_path)})
    rows = {r["example_id"]: (r["prompt"], r["response"], r["note"]) for r in df.collect()}
    assert mode == "sft" and rows == {"k1": ("a", "b", "n"), "k2": ("a", "b", "m")}
    with open(tmp_path / "bad.jsonl", "w") as f:
        f.write('{"prompt": "a", "completion": "b"}\n{broken\n')
    try:
        files.load_dataset(spark, {"path": str(tmp_path / "bad.jsonl"), "mode": "sft"})[0].collect()
        raise AssertionError("a malformed line must fail")
    except AssertionError:
        raise
    except Exception as e:
        assert "MALFORMED" in str(e).upper() or "FAILFAST" in str(e).upper()


def test_prompt_cap_is_a_parameter(spark):
    msgs = "array<struct<role:string,content:string>>"
    long = [("user", " ".join(["w"] * 300)), ("assistant", "a")]
    df = spark.createDataFrame([(1, long, long)], f"example_id bigint, chosen {msgs}, rejected {msgs}")
    assert filters.read_preference(df).count() == 0
    assert filters.read_preference(df, None).count() == filters.read_preference(df, 300).count() == 1


def test_manifest_counts_each_variants_own_columns(spark, tmp_path):
    from prefscan.sources import variants
    path = str(tmp_path / "v")
    variants.consolidate_variants({"one": spark.createDataFrame([("a",)], "text string"),
                                   "two": spark.createDataFrame([("a", 1), ("b", None)], "text string, n int")}, path, "g")
    got = {r["config"]: (r["rows"], r["n_columns"]) for r in variants.variant_manifest(spark, path).collect()}
    assert got == {"one": (1, 1), "two": (2, 2)}


def test_triples_are_bounded_arrays(spark, tmp_path):
    path = str(tmp_path / "t.json")
    df = spark.range(25).selectExpr("cast(id as string) prompt", "'c' chosen", "'r' rejected").coalesce(1)
    files.write_triples_json(df, path, rows_per_array=10)
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(parts) == 3
    assert files.read_triples_json(spark, path).select("prompt").distinct().count() == 25


def test_an_existing_output_costs_no_work(spark, tmp_path):
    path, calls = str(tmp_path / "o"), []

    def produce():
        calls.append(1)
        return spark.range(2)
    assert files.produce_once(spark, path, produce) and not files.produce_once(spark, path, produce)
    assert len(calls) == 1 and files.require_exists(spark, path).count() == 2


def test_partitioned_writes_are_clustered(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(2000).selectExpr("id as example_id", "id % 2 as g").repartition(40)
    files.write_partitioned(df, path, ["g"])
    for g in (0, 1):
        assert len([f for f in os.listdir(f"{path}/g={g}") if f.startswith("part-")]) <= files.SALTS
    assert files.read_partitioned(spark, path).count() == 2000


def test_manifest_has_sources_paths_and_all_null_columns(spark, tmp_path):
    from prefscan.sources import variants
    path = str(tmp_path / "v")
    empty = spark.createDataFrame([("a", None), ("b", None)], "text string, note string")
    variants.consolidate_variants({"original": empty, "rephrased-1": spark.createDataFrame([(1, "x")], "n int, t string")},
                                  path, "g", sources={"original": "hub/a", "rephrased-1": "hub/b"})
    variants.consolidate_variants({"original": empty.select("text")}, path, "h")
    m = variants.variant_manifest(spark, path)
    got = {(r.group, r.config): (r.split, r.source, r.rows, r.columns, r.n_columns) for r in m.collect()}
    assert got == {("g", "original"): ("train", "hub/a", 2, ["text", "note"], 2),
                   ("g", "rephrased-1"): ("train", "hub/b", 1, ["n", "t"], 2), ("h", "original"): ("train", None, 2, ["text"], 1)}
    assert all(r.path.endswith(f"/v/group={r.group}/config={r.config}") for r in m.collect())
    whole = variants.read_variants(spark, path)
    assert whole.count() == 5 and {"text", "note", "n", "t"} <= set(whole.columns)


def test_copies_of_a_hot_row_are_numbered_apart(spark, monkeypatch):
    monkeypatch.setattr(files, "COPIES", 7)
    rows = [("hot", [1], None)] * 100 + [("twice", [2], 1.5)] * 2 + [(f"one {i}", None, float(i)) for i in range(60)] + [
        (None, None, None)] * 3
    df = spark.createDataFrame(rows, "prompt string, a array<int>, v double").repartition(6)
    out = files.with_example_id(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert "Window" not in plan and len({r.example_id for r in got}) == len(rows)
    assert sorted((r.prompt, r.a, r.v) for r in got if r.prompt) == sorted(r for r in rows if r[0])
    hot = [r.example_id.split("-") for r in got if r.prompt == "hot"]
    assert len({h for h, _ in hot}) == 1 and sorted(int(i) for _, i in hot) == list(range(1, 101))
    assert files.with_example_id(df.where("false")).count() == 0
