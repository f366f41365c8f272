"""Inheritance against brute force, its cost, and notices and forms that are no article."""

import random
import time

import pytest

from prefscan.llm import html_text
from prefscan.llm.html_text import BAD, GOOD, OPEN

LINE = "The house of the old man is on the hill and it was there for many years."
NOTICE = " ".join(["This is the text of a notice that was put on the page for all of us to read."] * 5)
BODY = f"<h1>Title</h1><p>{LINE}</p><p>{LINE} {LINE}</p>"
WANT = f"Title\n{LINE}\n{LINE} {LINE}"


def brute(labels, boxes):
    out = []
    for i, x in enumerate(labels):
        found = [(abs(i - j), -labels[j]) for j in range(len(labels)) if labels[j] is not OPEN and boxes[j] == boxes[i]]
        out.append(x if x is not OPEN else -min(found)[1] if found else OPEN)
    return out


def test_two_sweeps_equal_brute_force():
    rng = random.Random(2)
    for n in [0, 1, 2, *[rng.randrange(3, 40) for _ in range(300)]]:
        labels = [rng.choice([GOOD, BAD, OPEN, OPEN, OPEN]) for _ in range(n)]
        boxes = [rng.randrange(3) for _ in range(n)]
        assert html_text.inherited(labels, boxes) == brute(labels, boxes)


def test_cost_follows_the_blocks():
    def took(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began
    cells = f"<p>{LINE}</p><table>" + "<tr><td>12</td><td>a b</td></tr>" * 4000 + "</table>"
    deep = "<div>" * 8000 + LINE + "</section></p>" * 8000
    titled = "<div class=widget>" * 4000 + "<h1>x</h1>" * 4000 + LINE
    assert all(took(page) < 2 for page in (cells, deep, titled))


@pytest.mark.parametrize("part", [f"<div class='notice'><p>{NOTICE}</p></div>", f"<form action=x><p>{NOTICE}</p></form>",
                                  f"<fieldset><p>{NOTICE}</p></fieldset>", f"<div class='alert'><p>{NOTICE}</p></div>",
                                  f"<div class='discussion'><p>{NOTICE}</p></div>", f"<section id=warning>{NOTICE}</section>"])
def test_notices_and_forms_with_long_prose_go(part):
    assert html_text.main_text(f"<body><article>{BODY}{part}</article></body>") == WANT
    assert html_text.main_text(f"<body><article>{part}{BODY}</article></body>") == WANT
    assert html_text.main_text(f"<body><article>{BODY}</article>{part}</body>") == WANT
    assert html_text.main_text(f"<body><div>{BODY}</div>{part}</body>") == WANT
    assert html_text.main_text(f"<body><form id=page><main>{BODY}{part}</main></form></body>") == WANT
    assert html_text.main_text(f"<body>{part}<p>{LINE}</p><p>{LINE} {LINE}</p><p>{LINE}</p></body>").count(LINE) == 4
    assert "notice" not in html_text.main_text(f"<body>{part}<p>{LINE}</p><p>{LINE} {LINE}</p><p>{LINE}</p></body>")
