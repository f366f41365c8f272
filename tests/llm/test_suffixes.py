import hashlib
import random
from collections import Counter

import pytest

from prefscan.llm import queries, suffixes
from tests.conftest import SF_SMALL
from tests.llm.conftest import frame


def brute(texts, length):
    """Per row: (bytes, removed, runs, kept)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def test_query_equals_brute_force(spark, small):
    want = {i: (n, r, s, hashlib.sha256(k).hexdigest())
            for i, (n, r, s, k) in zip(small, brute(small.values(), 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in queries.op8_suffix_dedup(spark, SF_SMALL).collect()}
    assert got == want and any(x[1] for x in want.values())


@pytest.mark.parametrize("class_limit", [2, 4096])
@pytest.mark.parametrize("seed", range(3))
def test_short_windows_random_texts(spark, seed, class_limit):
    """Few letters, so that windows repeat in every way; both ways of comparing a class."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(stock) + rng.choice(["", "x", "é", str(i)]) for _ in range(rng.randrange(9)))
             for i in range(60)] + [None, "", "a" * 300, "ab" * 200, "a" * 300]
    docs = frame(spark, list(enumerate(texts)))
    rows = suffixes.digest_columns(docs, length=24, gram=8, class_limit=class_limit).collect()
    want = {i: (n, r, s, hashlib.sha256(k).hexdigest()) for i, (n, r, s, k) in enumerate(brute(texts, 24))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_columnwise_rounds_equal_plain_comparison():
    import numpy as np
    rng = random.Random(5)
    length, gram = 10, 4
    segments, left, group = [], [], []
    for g in range(5):
        core = "".join(rng.choice("ab") for _ in range(gram))
        for _ in range(20):
            a = rng.randrange(length - gram + 1)
            right = rng.randrange(length - a - gram, length - gram + 1)
            segments.append(("".join(rng.choice("ab") for _ in range(a)) + core
                             + "".join(rng.choice("ab") for _ in range(right))).encode())
            left.append(a)
            group.append(g)
    found = suffixes.columnwise(segments, np.array(left), np.array(group), length, gram)
    pad = length - gram
    seen = Counter((g, pad - a + i, s[i:i + length]) for s, a, g in zip(segments, left, group)
                   for i in range(len(s) - length + 1))
    for s, a, g, row in zip(segments, left, group, found):
        for c in range(pad + 1):
            i = c - (pad - a)
            assert bool(row[c]) == (0 <= i <= len(s) - length and seen[(g, c, s[i:i + length])] > 1)


def test_a_run_longer_than_a_block(spark):
    text = "".join(chr(97 + random.Random(1).randrange(26)) for _ in range(1)) * 10
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=suffixes.BLOCK + 5000))
    docs = frame(spark, [(1, text), (2, "zz" + text[suffixes.BLOCK - 700:suffixes.BLOCK + 700] + "zz"), (3, "q" * 399)])
    got = {r.doc_id: r.n_removed for r in suffixes.digest_columns(docs).collect()}
    assert got == {1: 1400, 2: 1400, 3: 0}


def test_the_query_goes_by_bytes_not_words(spark, tmp_path):
    """Two passages of 57 words in two documents each: 399 bytes stay, 400 go."""
    rng = random.Random(3)
    stay, go = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(57)) + "x" * (n - 398) for n in (399, 400))
    texts = [f"1{stay}2", f"3{stay}4", f"5{go}6", f"7{go}8"]
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    want = {i: (n, r, s, hashlib.sha256(k).hexdigest()) for i, (n, r, s, k) in enumerate(brute(texts, 400))}
    assert got == want and [got[i][1] for i in range(4)] == [0, 0, 400, 400]


def test_edges(spark, edge, empty):
    out = suffixes.remove_repeats(edge)
    assert out.columns == edge.columns and out.schema == edge.schema
    rows = out.collect()
    assert len(rows) == edge.count()
    left = [(r.doc_id, r.text, r.n_chars) for r in rows]
    assert left.count((6, "", 0)) == 2 and (5, "", 0) in left and (1, None, None) in left
    assert all(t == "" and n == 0 for i, t, n in left if i in (8, 9))
    assert (7, "Größe naïve 日本語 😀", len("Größe naïve 日本語 😀")) in left
    assert suffixes.remove_repeats(empty).count() == 0
    assert suffixes.digest_columns(empty).count() == 0
