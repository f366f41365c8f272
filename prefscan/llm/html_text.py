"""Main text of web pages by two passes over blocks.

Pass one cuts a page at block-level tags and classifies each block by its
length, the share of function words and the share of its text in links; blocks
in menus, forms, notices, adverts, reader comments and the like (by tag, role,
class or id of an open container) are bad.  Tags that are never main text and
hidden elements are bad at once; a form or a container with such a word unless it wraps
the page's article: most of its words, and many of them, are in good blocks, and it
lies around an article, main or h1, or holds twice the good words outside all
such containers on a page that has no article, main or h1 there.  One that stands
inside an article or main is bad unless it holds a main or h1 itself; words that name
parts of prose, as comments do, yield only around a main or h1.  Pass two: blocks still
ambiguous, short ones and ones without function words, inherit the label of the
nearest decided neighbour, first within their own container, then on the page
(two sweeps, so a page costs time in proportion to its blocks).
Where a page has an article or main element with text that is not bad, only
its blocks count, and an ambiguous block without any decided neighbour there is
kept.  Where nothing on a page is surely good, its longer ambiguous blocks are.

Nulls: a null page is empty; pages without main text give the empty string.
Each page stands alone, so repeated rows give repeated results.  Unclosed and
cut-off markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscan.llm.common import text_of

LONG_WORDS, SHORT_WORDS = 20, 8
STOP_HIGH, STOP_LOW = 0.20, 0.08
LINKS = 0.5
#: words in good blocks that make a hinted container main text, alone and around a heading or article
CLEAR, CLEAR_HEADED = 60, 20

_TOKEN = re.compile(r"""
    <!--.*?(?:-->|\Z)
  | <(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|object|head|title|button)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
  | </(?P<end>[a-z][a-z0-9:-]*)[^>]*>?
  | <(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>
  | <[a-z!?/][^>]*>?
  | (?P<text>[^<]+|<)
""", re.S | re.I | re.X)
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")

# fixed values of HTML
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 hr dd dt li td th tr".split())
_MAIN = frozenset("article main".split())
_BAD_TAGS = frozenset("nav footer aside dialog menu legend".split())
_FORM_TAGS = frozenset("form fieldset".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies "
    "consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup signin login "
    "register paywall menu nav navbar navigation topnav breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets "
    "related recommended recommendations trending popular share sharing social comment comments commentlist reply replies "
    "respond discussion disqus footer masthead toolbar search searchbox pagination pager skip copyright legal disclaimer "
    "complementary contentinfo navigation form hidden".split())
#: the words among them whose containers may hold long prose that is not the main text
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription signup signin login paywall nav navbar navigation topnav breadcrumb breadcrumbs "
    "sidebar sidebars related recommended recommendations trending comment comments commentlist reply replies respond disqus "
    "footer copyright disclaimer pagination pager complementary contentinfo".split())
_WRAPS = frozenset("has with without no not overflow".split())  # 'has-sidebar' is not the sidebar
_BAD_STEMS = ("comment", "sidebar", "advert", "cookie", "footer", "breadcrumb", "newsletter", "sponsor", "popup", "navig",
              "recommend", "disclaim")
_BAD_ENDS = ("comment", "comments", "sidebar", "footer", "menu", "navbar", "banner", "adverts", "newsletter")
_FINE = frozenset("commentary commentaries".split())
_FUNCTION = frozenset(
    "the of and to in is a that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das ist von den mit zu im ein eine nicht auf sich des dem auch als für sie "
    "le la les et des que un une en est du dans qui pour pas sur au avec ce il de "
    "el los y del se las por con no para su al lo como más o".split())

GOOD, BAD, OPEN = 1, 0, None


NONE, HINTED, PART, NEVER = 0, 1, 2, 3


@dataclass
class Hint:
    """A container that may be bad, and the hinted one around it (0: none)."""
    kind: int = NONE
    around: int = 0
    headed: bool = False  # holds an article, main or h1 (at 0: one outside all hinted containers)
    titled: bool = False  # holds a main or h1
    inside: bool = False  # opened within an article or main


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    linked: int = 0
    box: int = 0
    main: bool = False
    hint: int = 0


def _hint(tag: str, attrs: str, in_main: bool) -> int:
    if tag in _BAD_TAGS or (tag == "header" and not in_main):
        return NEVER
    if not attrs or tag in ("html", "body", "article", "main"):
        if attrs and tag not in ("html", "body") and _HIDDEN.search(attrs):
            return NEVER
        return HINTED if tag in _FORM_TAGS else NONE
    if _HIDDEN.search(attrs):
        return NEVER
    names = [_SPLIT.split(n) for m in _HINTS.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    words = {w for n in names if n[0] not in _WRAPS for w in n}
    if any(w in _PARTS or (w.startswith(_BAD_STEMS) or w.endswith(_BAD_ENDS)) and w not in _FINE for w in words):
        return PART
    return HINTED if tag in _FORM_TAGS or words & _BAD_WORDS or ("header" in words and not in_main) else NONE


def blocks(page: str) -> tuple[list[Block], list[Hint]]:
    """The page's blocks in order, with container, link length and hinted
    container, and these containers, each after the one around it."""
    out: list[Block] = []
    hints = [Hint()]
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, box, main, hint
    opened: Counter = Counter()  # tags on the stack
    leaf = 0  # the hint of an open paragraph-like tag
    boxes, link = 0, False
    now = Block()

    def cut():
        nonlocal now
        if now.text:
            out.append(now)
        _, box, main, hint = stack[-1]
        now = Block(box=box, main=main, hint=leaf or hint)

    def hinted(tag: str, attrs: str) -> int:
        _, _, main, around = stack[-1]
        kind = _hint(tag, attrs, main)
        if kind:
            hints.append(Hint(kind, around, inside=main))
        if tag in ("article", "main", "h1"):
            at = around
            hints[0].headed |= not around
            while at and not (hints[at].headed and (hints[at].titled or tag == "article")):  # else those around it have it
                hints[at].headed = True
                hints[at].titled |= tag != "article"
                at = hints[at].around
        return len(hints) - 1 if kind else 0
    for m in _TOKEN.finditer(page):
        text, tag, end = m["text"], m["tag"], m["end"]
        if text:
            now.text.append(text)
            if link:
                now.linked += len(text.strip())
        elif tag:
            tag = tag.lower()
            if tag == "a":
                link = True
            elif tag in ("br", "img", "wbr"):
                now.text.append(" ") if now.text else None
            elif tag in _BLOCK:
                link = False
                if tag in _LEAF:
                    leaf = hinted(tag, m["attrs"])
                else:
                    leaf = 0
                    boxes += 1
                    _, _, main, around = stack[-1]
                    stack.append((tag, boxes, main or tag in _MAIN, hinted(tag, m["attrs"]) or around))
                    opened[tag] += 1
                cut()
        elif end:
            end = end.lower()
            if end == "a":
                link = False
            elif end in _BLOCK:
                link = False
                leaf = 0
                while opened[end]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == end:
                        break
                cut()
    if now.text:
        out.append(now)
    return out, hints


def bad_hints(hints: list[Hint], words: list[int], good: list[int]) -> list[bool]:
    """Which hinted containers are bad, from the words and the words in good
    blocks that stand in each (not in a hinted one inside it)."""
    words, good, bad = list(words), list(good), [False] * len(hints)
    free, beside = good[0], hints[0].headed
    for i in range(len(hints) - 1, 0, -1):
        h = hints[i]
        clear = good[i] >= (CLEAR_HEADED if h.headed and h.kind == HINTED else CLEAR) and 2 * good[i] >= words[i]
        wraps = h.titled if h.inside or h.kind == PART else h.headed or (not beside and good[i] >= 2 * free)
        bad[i] = h.kind == NEVER or not clear or not wraps
        if not bad[i]:
            words[h.around] += words[i]
            good[h.around] += good[i]
    for i in range(1, len(hints)):
        bad[i] = bad[i] or bad[hints[i].around]
    return bad


def classify(n_words: int, stops: float, links: float) -> int | None:
    if links > LINKS:
        return BAD
    if n_words < SHORT_WORDS:
        return OPEN
    if stops >= STOP_HIGH or (n_words >= LONG_WORDS and stops >= STOP_LOW):
        return GOOD
    return OPEN


def inherited(labels: list, boxes: list) -> list:
    """Per block the label of the nearest decided block of its box; good wins a tie."""
    near: list[tuple | None] = [None] * len(labels)
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: dict = {}
        for i in order:
            if labels[i] is not OPEN:
                last[boxes[i]] = i
            elif boxes[i] in last:
                at = last[boxes[i]]
                found = (-abs(at - i), labels[at])
                near[i] = found if near[i] is None else max(near[i], found)
    return [x if x is not OPEN else n and n[1] for x, n in zip(labels, near)]


def main_text(page: str) -> str:
    found, texts, labels = [], [], []
    cut, hints = blocks(page)
    words_in, good_in = [0] * len(hints), [0] * len(hints)
    for b in cut:
        text = _SPACE.sub(" ", html.unescape("".join(b.text))).strip()
        if not text:
            continue
        words = [_EDGE.sub("", w) for w in text.lower().split(" ")]
        stops = sum(w in _FUNCTION for w in words) / len(words)
        found.append(b)
        texts.append(text)
        labels.append(classify(len(words), stops, b.linked / len(text)))
        words_in[b.hint] += len(words)
        good_in[b.hint] += len(words) if labels[-1] == GOOD else 0
    bad = bad_hints(hints, words_in, good_in)
    labels = [BAD if bad[b.hint] else x for b, x in zip(found, labels)]
    if any(b.main and labels[i] is not BAD for i, b in enumerate(found)):
        labels = [x if b.main else BAD for b, x in zip(found, labels)]
    if GOOD not in labels and not any(b.main for b in found):
        # nothing is sure: the longer of the open blocks are the text, if there are any
        long = [i for i, t in enumerate(texts) if labels[i] is OPEN and t.count(" ") + 1 >= SHORT_WORDS]
        for i in long:
            labels[i] = GOOD
    own, page = inherited(labels, [b.box for b in found]), inherited(labels, [0] * len(found))
    final = [x if x is not OPEN else GOOD if b.main else y for x, y, b in zip(own, page, found)]
    return "\n".join(t for t, x in zip(texts, final) if x == GOOD)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``pages`` without the markup column, with the text and its code points."""
    keep = [f for f in pages.schema.fields if f.name not in (html_col, text_col, length_col)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("__html").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in names} | {
                text_col: pa.array(texts, pa.string()), length_col: pa.array([len(t) for t in texts], pa.int64())})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
                       + [f"`{text_col}` string", f"`{length_col}` long"])
    return pages.select(*[F.col(f"`{n}`") for n in names], text_of(html_col).alias("__html")).mapInArrow(run, schema)
