"""The streaming scorer: equal to the batch weights, and safe to re-run
(new files are scored once, a replay writes nothing twice)."""

import os
import tempfile

from pyspark.sql import functions as F

from prefscan.operators import weights
from prefscan.plans import catalog
from prefscan.sources import tables
from prefscan.streaming.scoring import score_stream

from .conftest import SF_SMALL


def test_stream_restart_scores_each_file_once(spark):
    d = tempfile.mkdtemp()
    land = os.path.join(d, "landing")
    docs = tables.table(spark, SF_SMALL, "documents")
    first, second = docs.where(F.col("doc_id") % 2 == 0), docs.where(F.col("doc_id") % 2 == 1)
    first.coalesce(2).write.parquet(land)
    _, model, names = catalog.lang_model(spark, SF_SMALL)
    sink, ckpt = os.path.join(d, "sink"), os.path.join(d, "ckpt")
    score_stream(spark, land, catalog.DOCUMENT_SCHEMA, model, names, sink, ckpt)
    n1 = spark.read.parquet(sink).count()
    second.coalesce(1).write.mode("append").parquet(land)          # new files land
    score_stream(spark, land, catalog.DOCUMENT_SCHEMA, model, names, sink, ckpt)
    score_stream(spark, land, catalog.DOCUMENT_SCHEMA, model, names, sink, ckpt)   # nothing new
    out = spark.read.parquet(sink)
    batch = weights.sft_weights(tables.sft_of(docs), model, names)
    cols = ["example_id", "trait", "weight"]
    assert out.count() > n1
    assert sorted(out.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_report_follows_from_the_state_alone(spark, tmp_path):
    import random

    from prefscan.operators.detection import assign_roles, detection_summary
    from prefscan.streaming import scoring
    rng = random.Random(3)
    rows = [(i, t, rng.gauss(0.002 if t == "a" else 0.0, 1e-3) * rng.choice([1, 1, 0])) for i in range(4000) for t in "abc"]
    rows += [(9000 + i, "b", 5.0) for i in range(40)] + [(9100, "c", -1e-30), (9101, "c", 1e9), (9102, "a", None)]
    df = spark.createDataFrame(rows, "example_id int, trait string, weight double")
    sink = str(tmp_path / "sink")
    for k in range(3):
        scoring.store_batch(df.where(F.col("example_id") % 3 == k), k, sink)
    scoring.store_batch(df.where(F.col("example_id") % 3 == 1), 1, sink)  # a replay counts once
    got = scoring.refreshed_report(spark, sink, "a", ["b", "c"])
    plan = got._jdf.queryExecution().toString()
    os.rename(sink, sink + "-gone")  # the report reads only state
    got = scoring.refreshed_report(spark, sink, "a", ["b", "c"]).first().asDict()
    want = detection_summary(assign_roles(df, "a", ["b", "c"])).first().asDict()
    assert got.keys() == want.keys() and f"{sink}/" not in plan
    for k, v in want.items():
        assert got[k] == v or abs(got[k] - v) <= 1e-6 * max(1, abs(v)), (k, got[k], v)


def test_ranges_grow_with_the_weight(spark):
    from prefscan.streaming.scoring import weight_range
    values = [float("-inf"), -1e300, -2.0, -1e-3, -1e-25, 0.0, 1e-25, 1e-12, 1.0000000001e-3, 1e-3 * 1.001, 2.0, 1e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values + [float("nan")])], "i int, w double")
    got = [r.r for r in df.select("i", weight_range(F.col("w")).alias("r")).orderBy("i").collect()]
    assert got == sorted(got) and got[7] < got[8] < got[9] and got[-1] == max(got)


def test_the_number_of_batches_does_not_grow_with_the_files(spark, tmp_path):
    rows = [(i, f"der und {i} the of", ["de", "en", "es", "fr"][i % 4], "s", 10) for i in range(60)]
    docs = spark.createDataFrame(rows, catalog.DOCUMENT_SCHEMA)
    docs.repartition(20).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task a file, as with files of full size
    try:
        sink = spark.read.parquet(catalog._run_stream(spark, str(tmp_path)))
        assert sink.count() == 240
        assert sink.select("batch_id").distinct().count() <= (spark.sparkContext.defaultParallelism + 1) // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
