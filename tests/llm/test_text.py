import hashlib
import random

import pytest

from prefscan.llm import html_text, queries, winnowing
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE, frame


def brute_selection(win, data):
    import numpy as np
    if len(data) < win.gram:
        return {0} if data else set()
    d = np.frombuffer(data, np.uint8)
    roll = winnowing.RollingHash(31, 1 << 16)
    prefix = roll.prefix(d)
    at = np.arange(len(d) - win.gram + 1)
    h = [int(x) >> 24 for x in winnowing.mix64(roll.slices(prefix, at, at + win.gram))]
    w = min(win.window, len(h))
    return {max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)}


@pytest.mark.parametrize("seed", range(4))
def test_selection_is_the_rightmost_minimum_of_every_window(seed):
    rng = random.Random(seed)
    win = winnowing.Winnower(6, 9)
    for n in (0, 1, 5, 6, 7, 14, 15, 200):
        data = bytes(rng.choices(b"ab" if seed % 2 else b"abcdefgh", k=n))
        assert set(win.select(data)[1].tolist()) == brute_selection(win, data)


def test_shared_strings_share_a_hash(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(winnowing, "BLOCK", 64)
    win = winnowing.Winnower()
    for _ in range(50):
        common = bytes(rng.choices(b"abcd", k=win.gram + win.window - 1))
        a, b = (bytes(rng.choices(b"xyz", k=rng.randrange(300))) + common + bytes(rng.choices(b"uvw", k=rng.randrange(300)))
                for _ in range(2))
        assert set(win.select(a)[0].tolist()) & set(win.select(b)[0].tolist())
        assert set(win.select(a)[1].tolist()) == brute_selection(win, a)


def check(rows, docs):
    """``docs``: (id, text) in the order in which they follow each other."""
    win = winnowing.Winnower()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.edited_sha256), []).append(r)
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        other = t[:len(t) - half] + n[:half]
        r = got[i, hashlib.sha256(other.encode()).hexdigest()].pop()
        a, b, c = (set(win.select(x.encode())[0].tolist()) for x in (t, other, n))
        assert r.n_chars == len(t)
        assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_next == (len(a & c) / len(a | c) if a | c else 1.0)
        assert (r.fingerprint == r.edited_fingerprint) == (t == other)
    assert not any(got.values())


def test_winnowing_query(spark, small):
    rows = queries.op5_winnowing(spark, SF_SMALL).collect()
    check(rows, sorted(small.items(), reverse=True))
    by = {}
    for r in rows:
        by.setdefault(small[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by.values()) and len(set.union(*by.values())) == len(by)


def test_winnowing_edges(spark, edge, empty):
    import xxhash
    order = sorted(EDGE, key=lambda d: (d[0] is None, -(d[0] or 0), _signed(xxhash.xxh64_intdigest((d[1] or "").encode(), 42))))
    check(winnowing.compare_with_next(edge.repartition(7)).collect(), order)
    assert winnowing.compare_with_next(empty).count() == 0
    one = winnowing.compare_with_next(frame(spark, [(4, "just one text")])).collect()
    check(one, [(4, "just one text")])
    found = winnowing.fingerprints(edge).collect()
    assert len(found) == len(EDGE) and all(len(r.hashes) == len(r.places) for r in found)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_extraction_query_gives_the_articles(spark):
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = queries.op6_html_extraction(spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split("</?p>|</?h1>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


LINE = "The house of the old man is on the hill and it was there for many years."


@pytest.mark.parametrize("page, want", [
    ("", ""), ("<p>", ""), ("no markup, but the text of a line that is in the page and long enough to be the text",
                            "no markup, but the text of a line that is in the page and long enough to be the text"),
    (f"<body><nav><a href=x>Home</a></nav><div id=content><h1>Title</h1><p>{LINE}<p>Short.</div>"
     f"<div class='sidebar'><p>{LINE}</p></div><footer>{LINE}</footer>", f"Title\n{LINE}\nShort."),
    (f"<article><p>{LINE}</p><form><p>{LINE}</p></form><div class=\"ad-box\">{LINE}</div><p>Ä &amp; &#x41;&nbsp; b &lt;i&gt;</p>"
     f"<section id=comments><p>{LINE}</p></section></article><p>{LINE}</p>", f"{LINE}\nÄ & A b <i>"),
    (f"<main><script>if (a < b) x('</p>')</script><style>p{{}}</style><p>{LINE} <b>bo</b>ld<br>next</p><!-- <p>no</p> -->"
     f"<ul><li><a href=1>one two three four</a></li></ul></main>", f"{LINE} bold next"),
    (f"<div><div class='cookie-notice'>{LINE}</div><p>{LINE}</p><p>one two three four five six seven eight nine</p></div>",
     f"{LINE}\none two three four five six seven eight nine"),
    (f"<article><header><h1>Head</h1></header><p>a < b and {LINE}</p><aside>{LINE}</aside></article><header>{LINE}</header>",
     f"Head\na < b and {LINE}"),
    ("<article><h1>Only</h1><p>tiny.</p></article>", "Only\ntiny."),
    (f"<div class=userComments><p>{LINE}</p></div><div class=commentary><p>{LINE}</p></div>", LINE),
    ("<ul><li><a href=1>Home</a></ul><div><p>zzz yyy xxx www vvv uuu ttt sss</p><p>rrr</p></div><footer>qqq</footer>",
     "zzz yyy xxx www vvv uuu ttt sss\nrrr"),
    (f"<p hidden>{LINE}</p><p>{LINE}</p><script>never closed <p>{LINE}</p>", LINE),
])
def test_extraction_cases(page, want):
    assert html_text.main_text(page) == want


def test_extraction_edges(spark):
    rows = [(1, None), (2, ""), (None, f"<p>{LINE}</p>"), (3, f"<p>{LINE}</p>"), (3, f"<p>{LINE}</p>"),
            (4, "<div>" * 3000 + LINE), (5, "<a title=\"x" * 2000), (6, "<" * 5000 + f"<p>{LINE}</p>")]
    pages = spark.createDataFrame([(i, "u", h, 7, "old") for i, h in rows], "page_id long, url string, html string, n_chars int, text string")
    out = html_text.extract(pages)
    assert sorted(out.columns) == ["n_chars", "page_id", "text", "url"] and out.count() == len(rows)
    got = [(r.page_id, r.text) for r in out.collect()]
    assert got.count((3, LINE)) == 2 and (1, "") in got and (None, LINE) in got and (4, LINE) in got
    assert html_text.extract(pages.where("false")).count() == 0
