"""File sources and sinks.

JSON lines and Parquet are the scale formats.  The whole-file JSON array of
the reference (``[[prompt, chosen, rejected], ...]``) is supported for
interchange: written as files of one array with a bounded number of rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.operators import filters
from prefscan.session import materialize, small
from prefscan.sources.arrays import read_string_arrays


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, UTF-8 not escaped (Spark's JSON writer keeps
    non-ASCII characters as they are)."""
    df.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str, prompt_col: str = "prompt",
               response_col: str = "completion", keep: Sequence[str] = ()) -> DataFrame:
    """Records with the two configured keys; blank lines are skipped, a
    missing key reads as ``''``, rows need both values non-empty (whitespace
    counts as a value); a malformed line fails the job."""
    fields = list(dict.fromkeys([prompt_col, response_col, *keep]))
    schema = ", ".join(f"`{c}` string" for c in fields)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in keep],
                    F.coalesce(F.col(f"`{prompt_col}`"), F.lit("")).alias("prompt"),
                    F.coalesce(F.col(f"`{response_col}`"), F.lit("")).alias("response"))
    return out.where((F.col("prompt") != "") & (F.col("response") != ""))


def read_sft(df: DataFrame, prompt_col: str = "prompt", response_col: str = "completion") -> DataFrame:
    """Project the two columns; rows where either is null or empty are
    dropped."""
    out = df.select(F.col(prompt_col).cast("string").alias("prompt"),
                    F.col(response_col).cast("string").alias("response"),
                    *[c for c in df.columns if c not in (prompt_col, response_col)])
    return out.where(F.col("prompt").isNotNull() & (F.col("prompt") != "")
                     & F.col("response").isNotNull() & (F.col("response") != ""))


ROWS_PER_ARRAY = 10_000


def _arrays(cols: Sequence[str], most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = b[list(cols)].astype(object)
            rows = part.where(part.notna(), None).values.tolist()
            for i in range(0, len(rows), most):
                yield pd.DataFrame({"value": [json.dumps(rows[i:i + most], ensure_ascii=False)]})
    return run


def write_triples_json(df: DataFrame, path: str, cols: Sequence[str] = ("prompt", "chosen", "rejected"),
                       mode: str = "overwrite", rows_per_array: int = ROWS_PER_ARRAY) -> None:
    """Write ``[[prompt, chosen, rejected], ...]`` JSON arrays of at most
    ``rows_per_array`` rows, one array a line and one line a file, in the order
    of the partition."""
    lines = df.select(*cols).mapInPandas(_arrays(cols, rows_per_array), "value string")
    lines.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def read_triples_json(spark: SparkSession, path: str, width: int = 3) -> DataFrame:
    """JSON arrays of ``[prompt, response]`` or ``[prompt, chosen,
    rejected]``, one per file, of any size (see ``sources.arrays``); no empty-row
    filtering on this path.  Returns ``(file, pos, prompt, chosen[, rejected])``
    (``response`` for width 2)."""
    names = ["prompt", "chosen", "rejected"] if width == 3 else ["prompt", "response"]
    return read_string_arrays(spark, path).select(
        "file", "pos", *[F.try_element_at("record", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def dataset_path(spec: dict, defaults: dict | None = None) -> str:
    """The path of a dataset; a relative one lies in ``data_dir``."""
    d = {**(defaults or {}), **{k: v for k, v in spec.items() if v is not None}}
    if d.get("source", "local") == "table" or not d.get("data_dir") or "://" in d["path"]:
        return d["path"]
    return os.path.join(d["data_dir"], d["path"])


def path_exists(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark reads; nothing is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_dataset(spark: SparkSession, spec: dict, defaults: dict | None = None) -> tuple[DataFrame, str]:
    """Dispatch on ``source`` (local files or a table/path) and ``mode``
    (preference or sft) with per-dataset values over defaults.  Returns the
    frame and the resolved mode."""
    d = dict(defaults or {})
    d.update({k: v for k, v in spec.items() if v is not None})
    source = d.get("source", "local")
    mode = d.get("mode", "preference")
    path = dataset_path(spec, defaults)
    pcol = d.get("prompt_column", "prompt")
    rcol = d.get("response_column", "completion")
    if source not in ("local", "table", "parquet"):
        raise ValueError(f"unknown dataset source: {source}")
    if source == "table":
        df = spark.table(path)
    elif path.endswith(".jsonl"):
        df = spark.read.option("mode", "FAILFAST").json(path)
    elif path.endswith(".json"):
        # positions restart in every file: the id combines both
        df = read_triples_json(spark, path, 3 if mode == "preference" else 2)
        return df.withColumn("example_id", F.xxhash64("file", "pos")).drop("file", "pos"), mode
    else:
        df = spark.read.parquet(path)
    if mode == "preference":
        if "chosen" in df.columns and df.schema["chosen"].dataType.simpleString().startswith("array<struct"):
            df = filters.read_preference(df, d.get("prompt_token_cap", filters.PROMPT_TOKEN_CAP))
    else:
        df = read_sft(df, pcol, rcol)
    return with_example_id(df), mode


COPIES = 100_000  # of one row that a task writes


def with_example_id(df: DataFrame, id_col: str = "example_id") -> DataFrame:
    """Keeps the ids there are; otherwise a content hash and, for rows that are
    equal in every column, their ordinal, so that none of them merge.

    Rows are counted by their hash (partial counts merge on the map side); rows
    that are alone keep their place.  Equal rows are interchangeable, so one of them
    and their number stand for all: they are numbered by their count, dealt to
    the tasks in runs of ``COPIES``.  ``df`` is read twice."""
    if id_col in df.columns:
        return df
    names = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(f"`{c}`")
             for c in df.columns]
    hashed = df.withColumn("__h", F.md5(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(plain)]))))
    copies = materialize(hashed.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1"))
    alone = hashed.join(small(copies.select("__h"), 128), "__h", "left_anti").select(
        *names, F.concat("__h", F.lit("-1")).alias(id_col))
    row = hashed.join(small(copies, 128), "__h").groupBy("__h", "__n").agg(F.first(F.struct(*names)).alias("__row"))
    last = F.floor((F.col("__n") - 1) / COPIES)
    runs = row.select("__h", "__n", "__row", F.explode(F.sequence(F.lit(0), last)).alias("__run")).repartition("__h", "__run")
    first = F.col("__run") * COPIES
    each = runs.select("__h", "__row", F.explode(F.sequence(first + 1, F.least(first + COPIES, F.col("__n")))).alias("__i"))
    return alone.unionByName(each.select("__row.*", F.concat_ws("-", "__h", F.col("__i").cast("string")).alias(id_col)))


SALTS, ROWS_PER_FILE = 16, 5_000_000


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], dynamic: bool = True) -> None:
    """Partitioned Parquet; with ``dynamic`` only the partitions
    present in ``df`` are replaced, so a re-run of one model or one run
    rewrites just its own files (crash-safe incremental results)."""
    # a partition's rows go to a few tasks, a hot one's to SALTS of them
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in by][:1] or [F.lit(0)]), F.lit(SALTS))
    w = (df.repartition(*[F.col(f"`{c}`") for c in by], salt).write.mode("overwrite")
         .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*by))
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Partition discovery gives the partition columns back."""
    return spark.read.option("basePath", path).parquet(path)


def write_if_absent(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Leave an existing output untouched (``mode('ignore')``)."""
    df.write.mode("ignore").format(fmt).save(path)


def produce_once(spark: SparkSession, path: str, produce, fmt: str = "json") -> bool:
    """S14 producer side: calls ``produce()`` and writes its frame only if the
    output is absent; returns whether it did."""
    if path_exists(spark, path):
        return False
    write_if_absent(produce(), path, fmt)
    return True


def require_exists(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S14 consumer side: read the input, failing with a clear message when
    it is missing."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"dataset not found at {path}; produce it first") from e


def write_run_config(spark: SparkSession, config: dict, path: str, mode: str = "overwrite") -> None:
    """The run configuration as a one-row JSON sidecar beside the data
    (lists and nested values kept as JSON)."""
    row = {k: (json.dumps(v) if isinstance(v, (list, dict)) else v) for k, v in config.items()}
    df = spark.createDataFrame([tuple(None if v is None else str(v) for v in row.values())],
                               ", ".join(f"`{k}` string" for k in row))
    df.coalesce(1).write.mode(mode).json(path)


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One nested JSON document per run (infinite z-scores are written
    as JSON strings by Spark's writer)."""
    report.write.mode(mode).json(path)
