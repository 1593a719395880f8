from sparkloom.llm import html_text
from sparkloom.llm.html_text import extracted, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<!-- <p>no</p> --><article><header><h1>Title &amp; more</h1><p>By someone</p></header><p><b>First   line,<br>second&nbsp;line.<p>Second <i>block</i> with &lt;tags&gt;.</p>
<form><input><label>Mail</label></form><aside>See also</aside><div class="ad">Buy!</div><ul><li>one</li><li>two</li></ul><section id="comments"><p>Nice text, really.</p></section></article>
<div class="sidebar"><p>Popular, popular, popular.</p></div><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Title & more\n\nBy someone\n\nFirst line, second line.\n\nSecond block with <tags>.\n\none\n\ntwo"


def test_without_article():
    text = "Long sentence, with commas, and more of it. " * 5
    page = f"<body><div id=menu><a href=a>x</a></div><div class=main><p>{text}</p><p>{text}</p></div><div class='footer'>f</div></body>"
    assert main_text(page) == "\n\n".join([text.strip()] * 2)


PROSE = "A sentence of some length, with a comma in it, and an end. " * 3


def joined(*texts):
    return "\n\n".join(t.strip() for t in texts)


def test_names_alone_do_not_decide():
    page = f"""<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{PROSE}</p><h2 id="discussion">Discussion</h2><p>{PROSE}</p>
    <h2 id="related-work">Related work</h2><p>{PROSE}</p><section id="search-results"><p>{PROSE}</p></section><p class="alert">Mind this.</p></article>
    <div class="ad">Buy it, now.</div></body>"""
    assert main_text(page) == joined("T", PROSE, "Discussion", PROSE, "Related work", PROSE, PROSE, "Mind this.")


def test_all_of_several_articles_and_what_stands_before_them():
    page = f"<body><main><p>{PROSE}</p><article><header><h1>T</h1><p>A standfirst.</p></header><p>{PROSE}</p></article><article><p>Short, but prose of some length here.</p></article></main></body>"
    assert main_text(page) == joined(PROSE, "T", "A standfirst.", PROSE, "Short, but prose of some length here.")
    assert main_text(page.replace("main>", "div>")) == main_text(page)


def test_short_blocks_beside_a_long_one():
    page = f"<body><div><h1>T</h1><p>{PROSE * 10}</p><p>Short.</p><ul><li>one</li></ul></div><footer>End, of it.</footer></body>"
    assert main_text(page) == joined("T", PROSE * 10, "Short.", "one")
    page = f"<body><h1>T</h1><div class=text><p>{PROSE}</p><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p></div></body>"
    assert main_text(page) == joined("T", PROSE, PROSE)


def test_comments_longer_than_the_article():
    page = f"<article><p>{PROSE}</p><div class=post-comments>" + f"<p>{PROSE}</p>" * 9 + "</div></article>"
    assert main_text(page) == PROSE.strip()


def test_ratios_decide(monkeypatch):
    """With the same page in the same tags, where the prose is decides; names do not: with all ratios equal, everything is content."""
    page = f"<body><div class=box>Some words.</div><div><p>{PROSE * 8}</p><p>{PROSE * 8}</p></div><nav>More words.</nav></body>"
    assert main_text(page) == joined(PROSE * 8, PROSE * 8)
    # prose below names that speak against it, and a short line below none
    page = f"<body><div>Some words.</div><div class=promo><p>{PROSE * 8}</p><p>{PROSE * 8}</p></div><div>More words.</div></body>"
    assert main_text(page) == joined(PROSE * 8, PROSE * 8)
    monkeypatch.setattr(html_text, "path_scores", lambda found, texts: {b.element.path: b.element.prior for b in found})
    assert main_text(page) == joined("Some words.", PROSE * 8, PROSE * 8, "More words.")


def test_names_break_ties_where_there_is_little_text():
    page = "<body><nav><a href=/>Home</a></nav><div class=ad>Buy it now, today.</div><article><h1>T</h1><p>It is so, today.</p></article><footer>So it is, today.</footer></body>"
    assert main_text(page) == joined("T", "It is so, today.")


def test_nothing_else_of_an_article_is_dropped():
    page = f"""<article><h1>T</h1><p>{PROSE}</p><ul><li><a href=x>A list item that is all link</a></li><li>and one</li></ul><div><a href=y>A paragraph that is all link.</a></div>
    <section class="social-history"><p>{PROSE}</p></section><div class="ad">Buy!</div><p>{PROSE}</p></article>"""
    assert main_text(page) == joined("T", PROSE, "A list item that is all link", "and one", "A paragraph that is all link.", PROSE, PROSE)


def test_prose_below_a_name_and_beside_it():
    page = f"<body><div class=social-history>{f'<p>{PROSE}</p>' * 8}</div><div><p>{PROSE}</p></div></body>"
    assert main_text(page) == joined(*[PROSE] * 9)


def test_broken_tags_take_linear_time():
    import time

    for broken in ('<p a="', "<a ", "<p a='\"", "<!", "</p ", "<p a=\">'", "<![CDATA[", "<!--", "<script>", "<p>&"):
        times = []
        for n in (20_000, 80_000):
            began = time.process_time()
            main_text("<p>x</p>" + broken * n)
            times.append(time.process_time() - began)
        assert times[1] < 8 * times[0] + 0.2, broken
    assert main_text("<p>one</p>" + '<p a="' * 50) == "one\n\n" + " ".join(['<p a="'] * 1) + '<p a="' * 49
    assert main_text('<p>one</p><p a="x>two</p>') == "one\n\ntwo" and main_text('<p title="a > b">one</p>') == "one"
    assert main_text("<p>a</p><script>if (a < 'b>') </scriptx> c</script><p>d</p>") == "a\n\nd"


def test_deep_nesting_is_linear():
    import time

    for tag in ("<div>x", "<p><b>x", "<ul><li>x"):
        times = []
        for n in (5_000, 20_000):
            began = time.process_time()
            assert main_text(tag * n).count("x") == n
            times.append(time.process_time() - began)
        assert times[1] < 8 * times[0] + 0.1


def test_odd_input():
    assert [main_text(x) for x in (None, "", "   ", "<p></p>", "<script>x", "<!-- open")] == [""] * 6
    assert main_text("just text & more") == "just text & more"
    assert main_text("<p>a < b and <b>c") == "a < b and c"
    long = "word, " * 200_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y"), (2, None, "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extracted(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, len(main_text(PAGE))), (1, len(main_text(PAGE))), (2, 0)]
    assert extracted(df.limit(0)).count() == 0
