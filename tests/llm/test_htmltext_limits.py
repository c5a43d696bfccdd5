import time

import pytest

from peakpool.llm.htmltext import main_text

P = "<p>" + "Some longer sentence of prose, with commas, and words. " * 3 + "</p>"
BROKEN = {
    "open names": "<b" * 100_000, "open tags": "<a " * 100_000, "closed at last": "<b" * 100_000 + ">", "blocks": "<div>text" * 20_000, "blocked end tags": "<span><article>" + "<i>" * 20_000 + "</span>" * 20_000, "quotes": '<a ">" ' * 50_000, "svg": "<svg>" * 50_000,
    "declarations": "<!" * 100_000, "comments": "<!--" * 100_000, "paragraphs": "<p><b>x" * 20_000, "items": "<ul><li>" * 20_000, "references": "&" * 300_000, "attributes": "<p " + "a= " * 100_000 + ">x", "a long name": "<p " + "a" * 300_000 + ">x", "suspects": "<div class=ad>some longer text here of prose" * 5_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_time_is_linear_in_broken_markup(name):
    began = time.process_time()
    main_text(BROKEN[name])
    assert time.process_time() - began < 3


@pytest.mark.parametrize("start", ['<div class="container no-sidebar">', '<div id="wrapper" class="has-menu">', '<div class="post alert-free">', "<form>", '<form class="search"><div class="banner">'])
def test_names_and_page_wide_forms_dont_lose_the_article(start):
    text = main_text(f"<html><body><nav><a href=1>Home</a> and some words of the menu that are long</nav>{start}<h1>Head</h1>{P * 3}</div></form></body></html>")
    assert text.count("Some longer sentence") == 9 and text.startswith("Head") and "menu" not in text


@pytest.mark.parametrize("start", ['<div class="ad">', '<section id="comments">', '<div class="site-header cookie-banner">', "<aside>", '<div role="navigation">', '<div hidden>'])
def test_what_is_marked_goes_even_if_it_is_longer(start):
    tag = start[1:].split()[0].rstrip(">")
    text = main_text(f"<body><article><h1>Head</h1><p>A short article, but one.</p></article>{start}{P * 9}</{tag}></body>")
    assert text == "Head\n\nA short article, but one."


def plain(page_tree):
    """An independent reading of a page given as nested tuples (tag, class, children or text): text outside of the marked parts."""
    tag, name, inner = page_tree
    if tag in ("nav", "footer", "aside", "script") or name in ("sidebar", "comments", "ad"):
        return []
    return [inner] if isinstance(inner, str) else [x for c in inner for x in plain(c)]


def shown(page_tree):
    tag, name, inner = page_tree
    return f'<{tag} class="{name}">' + (inner if isinstance(inner, str) else "".join(map(shown, inner))) + f"</{tag}>"


def test_equals_a_plain_walk_of_generated_pages():
    import random

    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(["word", "other", "thing,", "long"]) + str(rng.randrange(99)) for _ in range(rng.randint(6, 40))) + "."
    part = lambda tag, name, n: (tag, name, [("p", "", sentence()) for _ in range(n)])
    for _ in range(200):
        article = ("article", "", [("h1", "", sentence())] + [rng.choice([("p", "", sentence()), ("blockquote", "", sentence()), part("aside", "", 1), part("div", "ad", 1)]) for _ in range(rng.randint(2, 12))] + [part("section", "comments", rng.randint(0, 6))])
        page = ("body", "", [part("nav", "", 2), ("script", "", "var x = 1 < 2;"), ("div", rng.choice(["page", "no-sidebar", "wrap"]), [article, part("div", "sidebar", rng.randint(0, 5))]), part("footer", "", 1)])
        assert main_text(f"<html>{shown(page)}</html>") == "\n\n".join(plain(page))
