"""Benchmark decontamination by template canonicalisation, in DataFrame
functions only.

Canonical words: runs of letters and digits.  A run that begins with a digit is
a number, a unit right after a number is a unit, and a capitalised word inside a
sentence is a name; they become the placeholders ``0``, ``0u`` and ``0n``.  All
other words are lower-cased.  (No other canonical word begins with a digit.)

The first word of an item has no word before it, so it is never a name or unit
there, but may be one where the item stands inside a text.  An item is therefore
also read as after a word and as after a number; what only these readings find
must begin with the item's own first word.  Where the item as it stands is found
too, its figures are reported.

Candidates: every window of ``window`` canonical words of every document is
hash-joined with the windows of the benchmark items; an item is found where at
least ``threshold`` of its distinct windows occur.  Only hashes and positions
travel, and the document side of the join is not shuffled as long as the items'
windows are proven to fit a broadcast.

Slots: along the alignment (document position minus item position) with most
matching windows, the item's placeholders are paired with the words that stand
there; an item is a leak if the pairs agree on one substitution, that is if at
least ``threshold`` of them follow the most frequent partner of their item word.

Nulls: null texts are empty and match nothing; rows without an id are compared
too and reported with a null id.  Items without text or with fewer words than
a window are one window of all their words, which only a document of the same
words matches.  Repeated rows are reported each; repeated items once per item id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefscan.llm.common import KEYS, bounded_rows, once, row_keys, text_of, written
from prefscan.session import materialize, small

WINDOW, THRESHOLD = 5, 0.8
#: window rows (three longs, an int) that may be broadcast: 32 MB
MAX_BROADCAST = 1_000_000
ROW_BYTES = 64  # of a row key in a broadcast
UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec seconds min minutes h hr hours days weeks months "
         "years hz khz mhz ghz b kb mb gb tb w kw v a c f k usd eur gbp dollars euros cents percent meters metres "
         "miles feet inches grams kilograms liters litres degrees").split()
NUMBER, UNIT, NAME = "0", "0u", "0n"


def canonical(text: Column) -> Column:
    """The text with placeholders, one word for one word.  Each pattern starts
    with the character to find and looks behind it only there."""
    x = F.regexp_replace(text, r"\p{N}(?<![\p{L}\p{N}].)[\p{L}\p{N}]*", NUMBER)
    x = F.regexp_replace(x, rf"0(?<![\p{{L}}\p{{N}}]0) (?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"{NUMBER} {UNIT}")
    x = F.regexp_replace(x, r"\p{Lu}(?<=[\p{L}\p{N}][^\p{L}\p{N}.!?:\n]{1,3}.)[\p{L}\p{N}]*", NAME)
    return F.lower(x)


def words(text: Column) -> Column:
    """Words in order; none for a text without any."""
    flat = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def windows(ws: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words (of all words, marked, if there are fewer)."""
    size = F.size(ws)
    short = F.when(size > 0, F.array(F.xxhash64(F.concat(ws, F.array(F.lit("\u0000"), size.cast("string"))))))
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
                                         lambda i: F.xxhash64(F.slice(ws, i, n)))).otherwise(
        F.coalesce(short, F.array().cast("array<long>")))


def readings(text: Column) -> Column:
    """The different lists of canonical words of an item: as it stands (first),
    after a word, and after a number."""
    bare = F.regexp_replace(text, r"^[^\p{L}\p{N}]+", "")
    after = [words(canonical(F.concat(F.lit(before), bare))) for before in ("x ", f"{NUMBER} ")]
    return F.array_distinct(F.array(words(canonical(text)), *[F.slice(ws, F.lit(2), F.size(ws)) for ws in after]))


def slots(df: DataFrame, by: list[str], canon: str, text: str) -> DataFrame:
    """``(by, __at, __slot)``: position and lower-case word of every placeholder."""
    pairs = F.arrays_zip(F.col(canon).alias("c"), words(F.col(text)).alias("w"))
    at = df.select(*by, F.posexplode(pairs).alias("__at", "p"))
    return at.where(F.col("p.c").startswith("0")).select(*by, "__at", F.lower("p.w").alias("__slot"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
          threshold: float = THRESHOLD) -> DataFrame:
    """``(id, row keys, item id, matched, windows, containment, slots, agreeing, consistency)``."""
    own = items.select(F.col(item_id).alias("__item"), text_of(item_text).alias("__item_text")).where(
        F.col("__item").isNotNull()).distinct()
    # an item id with several texts stands for several items
    own = own.withColumn("__no", F.row_number().over(Window.partitionBy("__item").orderBy("__item_text")))
    own = once(own, ["__item", "__no", "__item_text"], __r=readings(F.col("__item_text"))).select(
        "__item", "__no", "__item_text", F.posexplode("__r").alias("__reading", "__w"))
    key = ["__item", "__no", "__reading"]
    cut = own.select(*key, F.posexplode(windows(F.col("__w"), window)).alias("__pos", "__h"))
    cut = materialize(cut)
    totals = cut.groupBy(*key).agg(F.countDistinct("__h").alias("windows"))
    side = F.broadcast(cut) if bounded_rows(cut, MAX_BROADCAST) else cut
    text = docs.select(F.col(id_col), *[c.alias(k) for k, c in row_keys(id_col, text_col).items()],
                       text_of(text_col).alias("__text"))
    spread = once(text, KEYS, __w=words(canonical(F.col("__text")))).select(
        *KEYS, F.posexplode(windows(F.col("__w"), window)).alias("__at", "__h"))
    # equal rows have one key: counted by distinct windows, aligned by the same positions
    hits = materialize(spread.join(side, "__h").select(*KEYS, *key, "__h", (F.col("__at") - F.col("__pos")).alias("__shift"))
                       .groupBy(*KEYS, *key, "__h", "__shift").agg(F.lit(1).alias("n")))
    found = hits.groupBy(*KEYS, *key).agg(F.countDistinct("__h").alias("matched")).join(totals, key)
    found = found.withColumn("containment", F.col("matched") / F.col("windows")).where(F.col("containment") >= threshold)
    best = hits.join(found.select(*KEYS, *key), [*KEYS, *key], "left_semi").groupBy(*KEYS, *key, "__shift").agg(
        F.count("*").alias("n"))
    best = best.groupBy(*KEYS, *key).agg(F.max_by("__shift", F.struct("n", -F.col("__shift"))).alias("__shift"))
    found = materialize(found.join(best, [*KEYS, *key]))
    item_slots = slots(own, key, "__w", "__item_text").withColumnRenamed("__slot", "__mine")
    wanted = found.join(item_slots, key).select(*KEYS, *key, (F.col("__at") + F.col("__shift")).alias("__at"), "__mine",
                                               (F.col("__at") == 0).alias("__first"))
    there = written(text.join(small(materialize(found.select(*KEYS).distinct()), ROW_BYTES), KEYS, "left_semi"), "holders")
    theirs = there.select(*KEYS, F.posexplode(words(F.col("__text"))).alias("__at", "__theirs")).distinct()
    pairs = wanted.join(theirs, [*KEYS, "__at"], "left").groupBy(*KEYS, *key, "__mine", F.lower("__theirs").alias("t")).agg(
        F.count("*").alias("n"), F.max("__first").alias("first"))
    agree = pairs.groupBy(*KEYS, *key, "__mine").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)).alias("most"),
        F.max(F.col("first") & ~F.col("t").eqNullSafe(F.col("__mine"))).alias("other"))
    agree = agree.groupBy(*KEYS, *key).agg(F.sum("n").alias("slots"), F.sum("most").alias("agreeing"),
                                              F.max("other").alias("other"))
    kept = found.join(agree, [*KEYS, *key], "left").withColumn(
        "consistency", F.coalesce(F.col("agreeing") / F.col("slots"), F.lit(1.0))).where(
        (F.col("consistency") >= threshold) & ((F.col("__reading") == 0) | ~F.coalesce("other", F.lit(False))))
    kept = kept.groupBy(*KEYS, F.col("__item").alias(item_id)).agg(F.max(F.struct(
        (F.col("__reading") == 0).alias("plain"), "containment", "matched", "windows", F.coalesce("slots", F.lit(0)).alias("slots"),
        F.coalesce("agreeing", F.lit(0)).alias("agreeing"), "consistency")).alias("b"))
    return there.select(id_col, *KEYS).join(kept, KEYS).select(
        id_col, *KEYS, item_id, "b.matched", "b.windows", "b.containment", "b.slots", "b.agreeing", "b.consistency")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that hold an item, in their own columns."""
    bad = small(materialize(leaks(docs, items, id_col, text_col, **kw).select(*KEYS).distinct()), ROW_BYTES)
    return docs.withColumns(row_keys(id_col, text_col)).join(bad, KEYS, "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])
