from ridgeline.llm import html

TREE = html.train()


def test_tree_fits_its_table():
    assert all(html.decide(TREE, row[:-1]) == row[-1] for row in html.LABELLED)


def text(page):
    return html.main_text(page, TREE)


def test_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">two</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy now.</div><div id="cookie-notice"><p>We use cookies on this site to serve you better.</p></div>
    <article><h1>Title &amp; more</h1><p><b>First
      part<br>goes</b> on &lt;here&gt; &copy; 3 < 4.<p>Second, with a <a href='x>y'>link</a>.</p><p>Short.</p>
      <form><input name=q><label>Your mail</label></form><aside><p>Related stories you may like to read today.</p></aside>
      <section class="comments"><p>A reader says that this is a very good article, and goes on for long.</p></section></article>
    <div class="sidebar"><p>Popular posts of this week, in a long list of words.</p></div><footer>&copy; site &middot; words<p>more</p></footer></body></html>"""
    assert text(page) == "Title & more\n\nFirst part goes on <here> © 3 < 4.\n\nSecond, with a link.\n\nShort."


def test_page_without_article():
    body = "<p>" + "A long paragraph of plain words, one after the other. " * 8 + "</p>"
    got = text(f"<div class='menu'><a href=1>Home</a> <a href=2>News</a></div><h2>Heading</h2>{body}{body}<p><a href=3>next</a></p><div class=footer>Imprint</div>")
    assert got.startswith("Heading\n\nA long") and got.count("\n\n") == 2


def test_broken_and_empty():
    assert text(None) == text("") == text("<html><body></body>") == text("<!-- never closed <p>x</p>") == ""
    assert text("<article><p>Cut off &am") == "Cut off &am"
    assert text('<article><p>Words</p><p class="open') == "Words"
    assert text("<article><p>One</p><script>if (a < b) { '</scr' }") == "One"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert len(text("<article><p>" + "word " * 100_000)) == 499_999


def test_rows(spark):
    rows = [(1, "u", "<article><p>xé</p></article>", "a"), (1, "u", "<article><p>xé</p></article>", "a"), (None, None, None, "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df, "page_id", "html", keep=("url",))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(str, got.collect())) == sorted(["Row(page_id=1, url='u', text='xé')"] * 2 + ["Row(page_id=None, url=None, text='')"])
    assert html.extract(df.limit(0), "page_id", "html").count() == 0


def test_query(spark):
    from ridgeline.llm.queries import op9_html

    got = op9_html(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert all(r.n_chars == len(r.text) > 0 and "©" not in r.text[:1] for r in got)


def test_what_an_article_says_stays():
    assert text("<article><p>Energy is <math><mi>E</mi></math> here</p></article>") == "Energy is E here"
    assert text("<article><p>See <svg><title>no</title><text>label</text></svg> there</p></article>") == "See label there"
    assert text("<article><section class='related-work'><p>Others did so before us.</p></section><p class='side'>A side note of it.</p></article>") == "Others did so before us.\n\nA side note of it."
    assert text("<article><p>Words.</p><div class='related-posts'><p>Read that too.</p></div><div class=share>Share it</div><select><option>One</option></select></article>") == "Words."
    assert text("<article><p>Words.</p><noscript>Please switch on scripts.</noscript></article>") == "Words."


def test_time_grows_with_the_length():
    import time

    took = []
    for n in (20_000, 80_000):
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            html.blocks("<div>" * n + "</ul>" * n + "<p>x</p>" * n + "</div>" * n)
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[1] < 10 * took[0]


def test_clashing_names(spark):
    import pytest

    df = spark.createDataFrame([(1, "a", "b")], "page_id long, html string, text string")
    with pytest.raises(ValueError):
        html.extract(df, "page_id", "html", keep=("text",))


def test_link_density_and_neighbours_decide_without_articles():
    """The same block between other neighbours, and the same neighbours around other blocks."""
    long = " ".join(["word"] * 60)
    link = "<a href=1>one two three</a>"
    assert "four words of text" in text(f"<div>{long}</div><div>four words of text</div><div>{long}</div>")
    assert "four words of text" not in text(f"<div>{link}</div><div>four words of text</div><div>{link}</div>")
    assert text(f"<div>{link}</div><div>{link}</div><div>{link}</div>") == ""


#: Pages that no row of the table was taken from, with what is their main text.
HELD_OUT = [
    ("<article><h1>Plans</h1><div class='ad-hoc'><p>Ad hoc committees met twice a week in the old hall.</p></div></article>", "Plans\n\nAd hoc committees met twice a week in the old hall."),
    ("<article><p>He wrote a book.</p><section id='replies-to-critics'><h2>Replies</h2><p>To his critics he said that they had not read it.</p></section></article>", "He wrote a book.\n\nReplies\n\nTo his critics he said that they had not read it."),
    ("<article><p>Body of it.</p><div class='footer-notes'><p>Notes are printed at the foot of each page.</p></div></article>", "Body of it.\n\nNotes are printed at the foot of each page."),
    ("<article><div class='article-header'><h1>A title</h1></div><p>Words follow it.</p></article>", "A title\n\nWords follow it."),
    ("<article><p>Words.</p><div class='navigation-aids'><a href=1>Back</a> <a href=2>Forth</a></div></article>", "Words."),
    ("<article><p>Words.</p><div class='menu-like-list'><div><a href=1>Back to it</a></div><div>or</div><div><a href=2>Go on</a></div></div></article>", "Words."),
    ("<article><p>Words.</p><div class='post-comments'><p>I liked this very much, thank you for it all.</p></div><div class='cookie-banner-2'>We use them.</div></article>", "Words."),
    ("<div class='ad-hoc'><p>" + "Committees met in the hall. " * 12 + "</p></div><div class='ad-slot'>Buy</div>", ("Committees met in the hall. " * 12).strip()),
]


def test_hints_are_weighed_with_words_and_links():
    for page, want in HELD_OUT:
        assert text(page) == want, page[:60]


def test_the_tree_asks_for_words_links_and_neighbours():
    asked = set()

    def walk(node):
        if not isinstance(node, int):
            asked.add(node[0])
            walk(node[2])
            walk(node[3])

    walk(TREE)
    assert {0, 1, 5} <= asked
