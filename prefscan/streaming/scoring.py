"""SM1: score newly landed example files, append their weights, keep the report
fresh.

A file-source stream with ``foreachBatch``: each micro-batch is tokenised and
scored against a fitted (static) model, and written to the sink partitioned by
batch id with dynamic partition overwrite, so a replayed batch after a failure
rewrites only its own partition (an idempotent, exactly-once sink).  With
``trigger(availableNow=True)`` the stream processes what has landed and stops;
the union of all batches equals the batch result.

Beside the sink each batch leaves its mergeable state, under the same batch id
and overwritten in the same way: per trait and range of weights the number of
rows, their sum and their squared deviations.  The detection report follows
from the state alone, so its cost does not grow with the rows that were ever
scored.  Means, deviations and z-scores of all rows are those of the rows
themselves.  A top-gamma mean takes whole ranges and, of the range that holds its
last row, the range's mean for the rows it needs: off by less than ``1 / RANGES``
of that weight times the share of the tail's rows in that range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefscan.operators.detection import assign_roles, detection_summary
from prefscan.operators.ngram import NgramModel
from prefscan.operators.weights import sft_weights
from prefscan.session import materialize
from prefscan.sources.tables import sft_of

RANGES = 1 << 16  # of the weights between a number and its double
SMALLEST = 2.0 ** -60  # weights nearer to zero share the ranges around it


def state_path(sink_path: str) -> str:
    return sink_path.rstrip("/") + "-state"


def weight_range(w: Column) -> Column:
    """A whole number that grows with the weight; NaN is above all."""
    size = F.floor(F.log2(F.least(F.abs(w) / F.lit(SMALLEST), F.lit(1e300)) + F.lit(1.0)) * F.lit(float(RANGES)))
    return F.when(F.isnan(w), F.lit(1 << 40)).otherwise(F.when(w < 0, -size).otherwise(size))


def write_state(weights: DataFrame, batch_id: int, path: str) -> None:
    """The state of one batch of ``(trait, weight)`` rows; a replay replaces it."""
    w = F.col("weight")
    cells = weights.where(w.isNotNull()).groupBy("trait", weight_range(w).alias("range")).agg(
        F.count(w).alias("n"), F.sum(w).alias("total"), (F.var_pop(w) * F.count(w)).alias("squares"))
    (cells.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def state_moments(cells: DataFrame) -> DataFrame:
    """``(trait, role, n, mean_weight, std_weight, var_pop)`` of all batches."""
    keys = ["trait", "role"]
    mid = cells.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_weight"))
    mid = F.broadcast(mid)  # the report's traits
    off = F.pow(F.col("total") / F.col("c.n") - F.col("mean_weight"), F.lit(2.0))
    squares = cells.alias("c").join(mid.alias("m"), keys).groupBy(*keys, F.col("m.n").alias("n"), "mean_weight").agg(
        F.sum(F.col("squares") + F.col("c.n") * off).alias("_sq"))
    return materialize(squares.select(
        *keys, "n", "mean_weight", F.when(F.col("n") > 1, F.sqrt(F.col("_sq") / (F.col("n") - 1))).alias("std_weight"),
        (F.col("_sq") / F.col("n")).alias("var_pop")))


def state_tails(cells: DataFrame, want: DataFrame) -> DataFrame:
    """``(trait, p, value, upper_sum)`` as ``ranks.order_statistics`` gives them,
    from the ranges: a trait has a bounded number of them."""
    merged = cells.groupBy("trait", "range").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    above = Window.partitionBy("trait").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = merged.select("trait", "n", "total", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_over_n"),
                           F.coalesce(F.sum("total").over(above), F.lit(0.0)).alias("_over"),
                           F.sum("n").over(Window.partitionBy("trait")).alias("_all"))
    rows = places.join(F.broadcast(want.distinct()), "trait").withColumn("_take", F.col("_all") - F.col("p") + 1)
    held = rows.where((F.col("_over_n") < F.col("_take")) & (F.col("_take") <= F.col("_over_n") + F.col("n")))
    mean, left = F.col("total") / F.col("n"), F.col("_take") - F.col("_over_n")
    return held.select("trait", "p", mean.alias("value"), (F.col("_over") + F.when(
        left == F.col("n"), F.col("total")).otherwise(left * mean)).alias("upper_sum"))


def score_stream(spark: SparkSession, source_path: str, schema: str, model: NgramModel,
                 names: dict[str, int], sink_path: str, checkpoint_path: str,
                 max_files_per_trigger: int = 1):
    """Run the stream to completion over the files present now; returns the
    finished query (its progress records the micro-batches)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_path))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        store_batch(sft_weights(sft_of(batch), model, names), batch_id, sink_path)

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def store_batch(weights: DataFrame, batch_id: int, sink_path: str) -> None:
    """The batch's weights, then its state, taken from what was written."""
    (weights.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(sink_path))
    spark = weights.sparkSession
    own = spark.read.schema("trait string, weight double, batch_id long").parquet(sink_path).where(F.col("batch_id") == batch_id)
    write_state(own, batch_id, state_path(sink_path))


def refreshed_report(spark: SparkSession, sink_path: str, target: str, controls: Sequence[str]) -> DataFrame:
    """The detection summary of all rows scored so far, from the batches' state."""
    cells = assign_roles(spark.read.parquet(state_path(sink_path)), target, list(controls))
    return detection_summary(lambda want: state_tails(cells, want), stats=state_moments(cells))
