"""The SQL face: temporary views over the derived tables so audits can be
written in Spark SQL (``exchanges``, ``pref``, ``sft``, ``weights``)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from prefscan.sources import tables


BUILDERS = {
    "exchanges": tables.exchanges,
    "pref": tables.preference_pairs,
    "sft": tables.sft_pairs,
}


def register_views(spark: SparkSession, sf_dir: str, weights=None,
                   names=("exchanges", "pref", "sft")) -> list[str]:
    """Create or replace the temp views named in ``names``; ``weights``
    (long W) is passed in because it is the expensive one.  ``pref`` needs a
    global order (a distributed rank), so ask for it only when it is used."""
    views = {n: BUILDERS[n](spark, sf_dir) for n in names}
    if weights is not None:
        views["weights"] = weights
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
