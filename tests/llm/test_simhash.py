import random
import re

import pytest
import xxhash

from prefscan.llm import queries, simhash
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE, frame


def brute_fingerprint(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", low) if w]
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=2):
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in root}


def check(rows, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    comp = brute_components(list(fps.values()))
    low = {}
    for i, f in fps.items():
        low[comp[f]] = min(i, low.get(comp[f], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{f:016x}", low[comp[f]]) for i, f in fps.items()}


def test_query_equals_brute_force(spark, small):
    check(queries.op10_simhash_near_dedup(spark, SF_SMALL).collect(), small)


def test_every_pair_within_two_bits_meets_in_some_table():
    masks = simhash.covering_masks(2)
    for i in range(64):
        for j in range(64):
            flip = 1 << i | 1 << j
            assert any(m & flip == 0 for m in masks)


@pytest.mark.parametrize("limit", [2, 64])
@pytest.mark.parametrize("radius", [1, 2])
def test_links_join_all_components_in_small_and_hot_buckets(spark, radius, limit):
    rng = random.Random(limit)
    fps = {0}
    while len(fps) < 160:  # chains of near fingerprints around a few centres
        f = rng.choice(sorted(fps))
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.9 else rng.getrandbits(64))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "__fp long")
    edges = simhash.links(df, radius, limit)
    assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= radius and r.a < r.b for r in edges.collect())
    got = {r.node % 2 ** 64: r.root for r in simhash.components(edges).collect()}
    want = brute_components(fps, radius)
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
    for members in groups.values():
        assert len({got.get(f, f) if len(members) > 1 else 0 for f in members}) == 1
    assert len(got) == sum(len(m) for m in groups.values() if len(m) > 1)


def test_edges(spark, edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    first = {r.doc_id: r["__first"].id for r in rows}
    assert first[2] == first[3] == 1 and first[6] == 5 and first[9] == 8 and first[None] is None
    kept = simhash.dedup(edge).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "7", "7", "8", "None"]
    assert simhash.dedup(edge).columns == edge.columns
    assert simhash.dedup(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    same = frame(spark, [(3, "a b c d")] * 5)
    assert simhash.dedup(same).count() == 1
