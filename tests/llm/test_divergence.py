import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prefscan.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, count int, p string"
LETTERS = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top=10):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in LETTERS.findall(text or "")])
            for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        v = len(kept)

        def shares(of):
            c = Counter(t for d in of for t in d[2])
            n = sum(c[t] for t in kept)
            return c, {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        whole = shares(own)[1]
        by = {s: shares([d for d in own if d[1] == s]) for s in {d[1] for d in own}}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        def ranked(part, source, found, most=None):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most]))
        for s, (c, p) in by.items():
            ranked("pair", s, [(o, sum(f(p[t], q[t]) for t in kept)) for o, (_, q) in by.items() if o != s])
            ranked("term", s, [(t, f(p[t], whole[t])) for t in kept if c[t] and p[t] > whole[t]], top)
    return sorted(out)


def made(n, sources, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéñ日" for b in "klmnöpqr"]
    rows = []
    for _ in range(n):
        s = rng.choice(sources)
        bias = words[sum(map(ord, s)) % 7::7] if s else words
        text = " ".join(rng.choice(words if rng.random() < 0.7 else bias) for _ in range(rng.randrange(0, 30)))
        rows.append((rng.choice([text, text.upper(), text.replace(" ", rng.choice(["9", "'", "\x7f", "\n\t"]))]),
                     rng.choice(["en", "de"]), s))
    return rows


EDGE = [(None, "en", "only nulls"), ("", "xx", "a"), (" 1 2 ?", "xx", "b"), (None, None, None), ("Alpha alpha", None, "s"),
        ("one two", "yy", None), ("one two", "yy", None), ("word " * 20000, "en", "long"), ("tie eit", "zz", "p"), ("tie eit", "zz", "q")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


@pytest.mark.parametrize("least", [1, 3])
def test_equals_brute_force(spark, least):
    rows = made(150, ["s1", "s2", "s0", None, "é"]) + EDGE
    assert run(spark, rows, min_docs=least) == brute(rows, least)


def test_many_sources_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    rows = made(260, [f"src{i}" for i in range(23)], seed=5)
    assert run(spark, rows, min_docs=2, top=3) == brute(rows, 2, 3)
    spark.conf.set("spark.prefscan.broadcastBytes", "100")  # the tables of groups and languages are shuffled
    try:
        assert run(spark, rows, min_docs=2) == brute(rows, 2)
    finally:
        spark.conf.unset("spark.prefscan.broadcastBytes")


def test_no_kept_terms_and_no_rows(spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, "de", "u")]
    assert run(spark, rows) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert run(spark, []) == []


def test_skyband_keeps_what_fewer_than_k_dominate(spark):
    rng = random.Random(8)
    rows = [("en", "s", f"t{i:04d}", rng.randrange(1, 30), rng.randrange(30, 60)) for i in range(1500)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, count long, total long").coalesce(1)
    want = {t for _, _, t, c, n in rows if sum(c2 >= c and n2 <= n and t2 < t for _, _, t2, c2, n2 in rows) < 4}
    for block in (7, 512):
        assert {r.term for r in divergence.skyband(df, 4, block).collect()} == want


def test_shares_of_huge_counts_are_exact(spark):
    cases = [(2, 7), (10 ** 14, 10 ** 14 + 3), (123456789012345, 999999999999999), (5, 5), (9 * 10 ** 14, 9 * 10 ** 14 + 10 ** 9)]
    df = spark.createDataFrame(cases, "c long, n long").select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("p"))
    assert all(r.p == 1 + 10 ** 9 * r.c // r.n for r in df.collect())
