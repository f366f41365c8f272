"""Articles around which a form or a container with a generic word lies."""

import pytest

from prefscan.llm import html_text

LINE = "The house of the old man is on the hill and it was there for many years."
BODY = f"<h1>Title</h1><p>{LINE}</p><p>{LINE} {LINE}</p><p>{LINE} And so on.</p>"
WANT = f"Title\n{LINE}\n{LINE} {LINE}\n{LINE} And so on."


@pytest.mark.parametrize("start, end", [
    ("<div class='flex overflow-hidden'>", "</div>"), ("<div class='flex overflow-hidden'><article>", "</article></div>"),
    ("<section class='popular-science'>", "</section>"), ("<div id='legal-news'>", "</div>"),
    ("<form id=aspnetForm action=x>", "</form>"), ("<form><div class='widget-area'><div role=main>", "</div></div></form>"),
    ("<div class='layout has-sidebar'>", "</div>"), ("<div class='page comments-open'><main>", "</main></div>")])
def test_wrapped_article_is_kept(start, end):
    around = f"<nav><a href=x>Home</a></nav>{{}}<div class=sidebar><p>{LINE}</p></div><footer>{LINE}</footer>"
    assert html_text.main_text(f"<body>{around.format(start + BODY + end)}</body>") == WANT
    inner = f"{start}{BODY}<div class=comments><p>{LINE}</p></div><aside>{LINE}</aside>{end}"
    assert html_text.main_text(inner) == WANT


def test_without_headings_and_beside_other_text():
    long = f"<p>{LINE} {LINE}</p>" * 2
    assert html_text.main_text(f"<p>{LINE}</p><div class=alert-systems>{long}</div>").count(LINE) == 5
    # parts of prose and short notices stay out
    for part in ("comments", "related-posts", "cookie-bar"):
        assert html_text.main_text(f"<p>{LINE}</p><div class={part}>{long}</div>") == LINE
    assert html_text.main_text(f"<p>{LINE}</p><div class=alert><p>{LINE}</p></div><form><p>{LINE}</p></form>") == LINE
