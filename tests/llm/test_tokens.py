import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prefscan.llm import idfiles, packing, queries, tokens
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE

TOK = Tokenizer.from_file(tokens.default_tokenizer())
ENC = tokens.Encoder(tokens.default_tokenizer())


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab' ,.\n\t é日1_<|>s", "  ", "'ll", "<|endoftext|>"]), max_size=30).map("".join))
def test_encoder_equals_the_library_on_any_white_space(text):
    assert np.frombuffer(ENC.encode([text])[0], "<u2").tolist() == ids_of(text)


def test_full_caches_start_anew(monkeypatch, small):
    monkeypatch.setattr(tokens, "PIECES", 50)
    monkeypatch.setattr(tokens, "WORDS", 50)
    enc = tokens.Encoder(tokens.default_tokenizer())
    texts = list(small.values())[:40]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == [ids_of(t) for t in texts]


def check_pieces(rows, texts, window=2048):
    """``texts``: id to the list of texts with it."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(map(str, pieces)) == sorted(map(str, texts))
    for key, own in texts.items():
        want = sorted(tuple(ids_of(t) + [1]) for t in own)
        got = []
        for whole in want:  # each document's pieces, matched by content
            at = 0
            while at < len(whole):
                r = next(r for r in pieces[key] if r.start == at and r.doc_tokens == len(whole) and zlib.crc32(
                    np.array(whole[at:at + r.length], "<u4").tobytes()) == r.ids_crc32)
                pieces[key].remove(r)
                at += r.length
            got.append(at)
        assert not pieces[key]
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or number == max(sequences) and at < window
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_query(spark, small):
    check_pieces(queries.op4_concat_and_cut(spark, SF_SMALL).collect(), {i: [t] for i, t in small.items()})


@pytest.mark.parametrize("window", [1, 7, 2048])
def test_packing_edges(spark, edge, empty, window):
    docs = edge.where("doc_id is null or doc_id not in (5, 6)").repartition(5)
    texts = defaultdict(list)
    for i, t in EDGE:
        if i not in (5, 6):
            texts[i].append(t)
    rows = packing.pack(docs, window=window).collect()
    check_pieces(rows, texts, window)
    assert packing.pack(empty).count() == 0


def test_id_files_query_is_a_round_trip(spark, small):
    at, want = 0, {}
    for i in sorted(small):
        ids = np.array(ids_of(small[i]) + [2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = queries.op9_token_id_files(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_id_files_edges(spark, edge, empty, tmp_path):
    rows = idfiles.write_and_read(edge, shard_tokens=1000).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(i), len(ids_of(t)) + 1) for i, t in EDGE)
    ends = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    order = [k for _, _, k in ends]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    idfiles.write_ids(empty, str(tmp_path / "none"))
    assert idfiles.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_lookup_by_key(spark, edge, tmp_path):
    path = str(tmp_path / "ids")
    idfiles.write_ids(edge, path, shard_tokens=1000)
    keys = spark.createDataFrame([(k,) for k in (2, 6, 7, 12345, None, 7)], "doc_id long")
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in idfiles.lookup(keys, path).collect())
    assert got == sorted((i, ids_of(t) + [2]) for i, t in EDGE if i in (2, 6, 7))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20000])
def test_minimal_perfect_hash(n):
    keys = [str(i * 7) for i in range(n)]
    shard = idfiles.Shard(idfiles.build_shard(keys, [np.array([i], "<u2").tobytes() for i in range(n)], 2))
    assert shard.keys == n and sorted(shard.first.tolist()) == list(range(n))
    assert all([x.tolist() for _, x in shard.documents(k)] == [[i]] for i, k in enumerate(keys))
    assert not any(shard.documents(f"absent {i}") for i in range(200))
