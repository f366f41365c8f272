"""Positions of shared grams: the match guarantee, on whole tables."""

from prefscan.llm import queries, winnowing
from tests.conftest import SF_SMALL
from tests.llm.conftest import frame


def test_shared_positions_cover_the_unchanged_half(spark, small):
    rows = {r.doc_id: r for r in queries.op5_winnowing(spark, SF_SMALL).collect()}
    sure = winnowing.GRAM + winnowing.WINDOW - 1  # any so many shared bytes hold a shared selected gram
    for i, text in small.items():
        data, kept = (text or "").encode(), (text or "")[:len(text or "") - len(text or "") // 2].encode()
        win = winnowing.Winnower()
        assert rows[i].n_selected == len(win.select(data)[0])
        if len(kept) >= sure:
            assert rows[i].shared_from <= winnowing.WINDOW - 1  # the first window's gram is whole in both
        if len(kept) >= 2 * sure and len(set(kept)) > 3:
            assert rows[i].shared_to > 0 and rows[i].shared_to <= len(data)


def test_positions_by_brute_force(spark):
    texts = {1: "abcdefghijklmnopqrstuvwxyz0123456789" * 2, 2: "x", 3: "", 4: "the quick brown fox jumps over the lazy dog again"}
    rows = {r.doc_id: r for r in winnowing.compare_with_next(frame(spark, list(texts.items()))).collect()}
    win, order = winnowing.Winnower(), sorted(texts, reverse=True)
    for i, k in enumerate(order):
        nxt = texts[order[(i + 1) % len(order)]]
        h, p = win.select(texts[k].encode())
        other = set(win.select(winnowing.edit(texts[k], nxt).encode())[0].tolist())
        at = {}
        for x, y in zip(h.tolist(), p.tolist()):
            if x in other:
                at.setdefault(x, y)
        want = (min(at.values()), max(at.values()) + winnowing.GRAM) if at else (None, None)
        assert (rows[k].shared_from, rows[k].shared_to) == want
