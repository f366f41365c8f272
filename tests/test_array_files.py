"""JSON array files cut at every ``],``, inside strings too, over many splits."""

import json
import random

import pytest

from prefscan.sources import arrays, files


def write(tmp_path, name, rows, **kw):
    (tmp_path / name).write_text(json.dumps(rows, **kw), encoding="utf-8")


def made(n, seed):
    rng = random.Random(seed)
    parts = ["],", "[", "]", '"', "\\", "a", "é\n", ' ", "', "],],", '\\"],', "日本", "", "]]", "x" * 30, "\\\\"]

    def text():
        return None if rng.random() < 0.02 else "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
    return [[text(), text(), text()] for _ in range(n)]


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
@pytest.mark.parametrize("kw", [{}, {"ensure_ascii": False}, {"indent": 2}, {"separators": (",", ":")}])
def test_any_strings_over_any_splits(spark, tmp_path, split, kw):
    made_files = {f"f{i}.json": made(n, i) for i, n in enumerate([0, 1, 2, 60, 150])}
    for name, rows in made_files.items():
        write(tmp_path, name, rows, **kw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = arrays.read_string_arrays(spark, str(tmp_path)).collect()
        parts = arrays.pieces(spark, str(tmp_path)).select("file", "start").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 30 or split > 64
    for name, rows in made_files.items():
        own = sorted((r.pos, r.record) for r in found if r.file.endswith(name))
        assert [r for _, r in own] == rows and len({p for p, _ in own}) == len(rows)


def test_a_string_longer_than_several_splits(spark, tmp_path):
    rows = [["a", "b", "c"], ["],x" * 3000, "y],", "z"], ["],", "],", "],"], ["d", "e", "f"]]
    write(tmp_path, "long.json", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = sorted((r.pos, r.record) for r in arrays.read_string_arrays(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r for _, r in found] == rows


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    n = 1_000_000
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ", ".join(f'["p{i}", "c]{i}", "r"]' for i in range(n)) + "]")
    df = files.read_triples_json(spark, str(tmp_path / "big.json"))
    assert arrays.pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    row = df.selectExpr("count(*) n", "count(distinct pos) k", "sum(cast(substr(prompt, 2) as long)) s", "max(chosen) c").first()
    assert (row.n, row.k, row.s, row.c) == (n, n, n * (n - 1) // 2, f"c]{n - 1}")


def test_broken_text_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[["a", "b", "c"], {"x": 1}]')
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        arrays.read_string_arrays(spark, str(tmp_path)).collect()
