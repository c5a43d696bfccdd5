from peakpool.llm.htmltext import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href=x>menu</a></nav></header><div id="cookie-notice">We use cookies, ok?</div>
<main><article><h1>Title &amp; more</h1><p>First para, with&nbsp;commas,
 yes.<br>Line two<p>Second <a href="y">link</a> para<ul><li>one<li>two</ul><form>Search <input></form><aside>side text, here, lots, of, commas</aside>
<div class="comments"><p>reader comment, blah, blah, blah.</p></div><footer>by me</footer></article></main>
<div class="sidebar"><p>side, side, side</p></div><!-- x --></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Title & more\n\nFirst para, with commas, yes. Line two\n\nSecond link para\n\none\n\ntwo"


def test_container_is_found_without_an_article_element():
    p = "<p>" + "Some longer sentence of prose, with commas, and words. " * 3 + "</p>"
    page = f"<body><div class='menu'><a>x</a></div><div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div><h2>Head</h2>{p}{p}</div><div><a href=3>more links, and more, and more</a></div></body>"
    text = main_text(page)
    assert text.startswith("Head\n\nSome longer") and "links" not in text and "two" not in text


def test_broken_markup():
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>a<p>b") == "a\n\nb"
    assert main_text("a < b & c &lt; d") == "a < b & c < d"
    assert main_text("<p>x</p><!-- never closed <p>y") == "x"
    assert main_text("<nav>x</nav>") == main_text("") == main_text(None) == ""
    assert main_text("<script>x") == ""
    assert main_text("<p title='<b>'>ok</p>") == "ok"
    assert len(main_text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>a", "x"), (2, None, "<p>a", "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(str, extract(df).collect())) == sorted(["Row(page_id=1, url='u', text='', n_chars=0)", *["Row(page_id=2, url=None, text='a', n_chars=1)"] * 2, "Row(page_id=None, url='v', text='', n_chars=0)"])
    assert extract(df.limit(0)).count() == 0
