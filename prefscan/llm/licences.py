"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact
containment verifies them.  DataFrame functions only.

Texts and templates are runs of words, whatever line or sentence ends lie between
them; every ``shingle`` neighbours are hashed.  Signatures are one-permutation
MinHashes: a shingle's hash names one of ``BANDS`` bands, and a band holds the
smallest hash that fell into it.  For a template of n shingles a text is cut
into windows of ``SPAN`` n shingles, one every n, so neighbours overlap by
(SPAN - 1) n and every place a template can take lies whole in some window.  A text
is retrieved when one of its windows agrees with the template in a band.

Collision probability.  A template shingle in a window is that window's minimum
unless one of the other (at most SPAN n - 1) shingles there shares its band and is
smaller: with probability 1 - SPAN n / (2 BANDS) at least, 0.9996 for a template of
one shingle and 0.96 for one of 100.  A text with containment ``threshold`` has
0.8 n such shingles, and all of them would have to fail, so it is retrieved with
probability 0.9995 or more (``collision_probability``).

A band can only agree where the text holds one of the templates' minima.  So the
minima, counted and then broadcast, meet the shingles first, without a shuffle
of the texts, and window minima are taken around these places alone.  Every
retrieved (row, template) pair is verified on the whole text: the share of the
template's distinct shingles that the text contains must reach ``threshold``.

Nulls: a null text is empty and holds no licence; rows without an id are
scanned and reported with a null id.  Equal rows are reported each.  Templates
need ``shingle`` words; others are never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.llm.common import KEYS, once, row_keys, text_of, written
from prefscan.session import materialize, small

SHINGLE, THRESHOLD = 5, 0.8
BANDS, SPAN = 4096, 3
ROW_BYTES = 128  # of a template's row (an id, numbers) or a row key in a broadcast

# fixed values: notices as they are commonly written
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "licence string, text string")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for a text without any."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shingles(ws: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.xxhash64(F.slice(ws, i, n)))


def grams(df: DataFrame, keep: list[str], text: str, shingle: int) -> DataFrame:
    """``(keep, __at, __h)`` of every shingle of ``text``, numbered from 0."""
    whole = once(df, keep, __w=words(F.col(text))).where(F.size("__w") >= shingle)
    return whole.select(*keep, F.posexplode(shingles(F.col("__w"), shingle)).alias("__at", "__h"))


def band(h: Column) -> Column:
    return F.pmod(h, F.lit(BANDS))


def collision_probability(n: int, threshold: float = THRESHOLD) -> float:
    """At least this likely is a text with ``threshold`` of a template's n
    shingles within one window retrieved."""
    lost = min(1.0, (SPAN * n - 1) / (2 * BANDS))
    return 1 - lost ** max(1, round(threshold * n))


def minima(exact: DataFrame) -> DataFrame:
    """``(__licence, __n, __h)``: the templates' signatures, a row per band with a hash."""
    totals = exact.groupBy("__licence").agg(F.count("*").alias("__n"))
    return exact.groupBy("__licence", band(F.col("__h")).alias("__band")).agg(F.min("__h").alias("__h")).join(
        totals, "__licence").select("__licence", "__n", "__h")


def agreeing(rows: DataFrame, hits: DataFrame, shingle: int) -> DataFrame:
    """The ``(row keys, licence)`` of ``hits`` whose minimum is that of a window
    around it, too.  A row's hits are no more than its shingles."""
    per_row = hits.groupBy(*KEYS).agg(F.collect_list(F.struct("__licence", "__n", "__at", "__h")).alias("__hits"))
    whole = once(rows.join(per_row, KEYS), [*KEYS, "__hits"], __w=words(F.col("__text")))
    whole = once(whole, [*KEYS, "__hits"], __all=shingles(F.col("__w"), shingle))

    def least(x: Column, k: Column) -> Column:
        window = F.slice("__all", (k * x["__n"] + 1).cast("int"), (x["__n"] * SPAN).cast("int"))
        return F.array_min(F.filter(window, lambda y: band(y) == band(x["__h"])))

    def met(x: Column) -> Column:
        last = F.floor(x["__at"] / x["__n"])
        windows = F.sequence(F.greatest(last - (SPAN - 1), F.lit(0)), last)
        return F.exists(windows, lambda k: least(x, k) == x["__h"])
    found = F.array_distinct(F.transform(F.filter("__hits", met), lambda x: x["__licence"]))
    return whole.select(*KEYS, F.explode(found).alias("__licence"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         licence_col: str = "licence", licence_text: str = "text", shingle: int = SHINGLE,
         threshold: float = THRESHOLD) -> DataFrame:
    """``(id, row keys, licence, matched, shingles, containment)`` of the licences each row holds."""
    text = docs.select(F.col(id_col), *[c.alias(k) for k, c in row_keys(id_col, text_col).items()],
                       text_of(text_col).alias("__text"))
    own = templates.select(F.col(licence_col).alias("__licence"), text_of(licence_text).alias("__text"))
    exact = materialize(grams(own, ["__licence"], "__text", shingle).select("__licence", "__h").distinct())
    totals = exact.groupBy("__licence").agg(F.count("*").alias("shingles"))
    mine = small(materialize(minima(exact)), ROW_BYTES)
    hits = materialize(grams(text, KEYS, "__text", shingle).join(mine, "__h"))
    few = materialize(hits.select(*KEYS).distinct())
    there = written(text.join(small(few, ROW_BYTES), KEYS, "left_semi"), "licensed")  # the texts that hold a minimum
    one = there.drop(id_col).dropDuplicates(KEYS)
    retrieved = materialize(agreeing(one, hits, shingle))
    held = grams(one, KEYS, "__text", shingle).select(*KEYS, "__h")
    matched = held.join(small(exact, ROW_BYTES), "__h").distinct().groupBy(*KEYS, "__licence").agg(F.count("*").alias("matched"))
    kept = matched.join(retrieved, [*KEYS, "__licence"], "left_semi").join(totals, "__licence").withColumn(
        "containment", F.col("matched") / F.col("shingles")).where(F.col("containment") >= threshold)
    return there.select(id_col, *KEYS).join(kept, KEYS).select(
        id_col, *KEYS, F.col("__licence").alias(licence_col), "matched", "shingles", "containment")
