"""Dataset variant groups (S6, S7): an original dataset and its rephrased
versions consolidated under one root, ``<root>/group=<g>/config=<c>/``, each
variant with its own columns.  Where a variant came from is kept in ``_sources``
beside them, which readers of the data pass over."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.sources.files import path_exists, write_partitioned

SPLIT = "train"


def consolidate_variants(frames: dict[str, DataFrame] | DataFrame, path: str, group: str | None = None,
                         group_col: str = "group", config_col: str = "config", sources: dict[str, str] | None = None) -> None:
    """Rows pass through unchanged; each variant lands in its own
    ``(group, config)`` partition.  ``frames`` is either one frame that already
    has the group and config columns, or ``config -> frame`` for one group, whose
    variants keep the columns they have; ``sources`` names where each came from."""
    if isinstance(frames, DataFrame):
        write_partitioned(frames, path, [group_col, config_col])
        return
    for config, frame in frames.items():  # the variants of the configuration
        write_partitioned(frame.withColumn(group_col, F.lit(group)).withColumn(config_col, F.lit(config)), path,
                          [group_col, config_col])
    if sources:
        spark = next(iter(frames.values())).sparkSession
        rows = [(group, c, s) for c, s in sources.items()]
        spark.createDataFrame(rows, f"`{group_col}` string, `{config_col}` string, source string").write.mode(
            "overwrite").json(os.path.join(path, "_sources", group))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """All variants with the union of their columns."""
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)


def variant_manifest(spark: SparkSession, path: str, group_col: str = "group", config_col: str = "config") -> DataFrame:
    """Per (group, config) ``split, path, source, rows, columns, n_columns``.

    Rows are counted by file without reading a column, so only the files' footers
    are met; the columns are those of the variant's own schema, null in every row
    or not.  There is one schema to look up per variant of the configuration."""
    files = spark.read.option("basePath", path).parquet(path).select(
        F.col(group_col).cast("string"), F.col(config_col).cast("string"),
        F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("path"))
    counts = files.groupBy(group_col, config_col, "path").agg(F.count(F.lit(1)).alias("rows")).collect()
    rows = []
    for r in counts:
        own = [c for c in spark.read.parquet(r["path"]).columns if c not in (group_col, config_col)]
        rows.append((r[group_col], r[config_col], SPLIT, r["path"], r["rows"], own, len(own)))
    out = spark.createDataFrame(rows, f"`{group_col}` string, `{config_col}` string, split string, path string, "
                                      "rows bigint, columns array<string>, n_columns bigint")
    where = os.path.join(path, "_sources")
    if path_exists(spark, where):
        named = spark.read.schema(f"`{group_col}` string, `{config_col}` string, source string").option(
            "recursiveFileLookup", "true").json(where)
        out = out.join(named, [group_col, config_col], "left")
    else:
        out = out.withColumn("source", F.lit(None).cast("string"))
    return out.select(group_col, config_col, "split", "path", "source", "rows", "columns", "n_columns")
