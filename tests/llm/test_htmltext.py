import math
import random
import time

import pytest

from verdigris.llm import htmltext
from verdigris.llm.htmltext import extract, main_texts

BODY = "<p>First paragraph is long enough to be text of an article.</p><p>Second <a href=x>link</a> one, with text &amp; more of it.</p>"
TEXT = "First paragraph is long enough to be text of an article. Second link one, with text & more of it."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>a</a></li></ul></nav><article><h1>Title</h1>{BODY}</article><footer>f</footer></body></html>", f"Title {TEXT}"),
        (f"<body><div class='site-header'>My site</div><div id=cookie-notice>We use cookies to make everything so much better for all.</div><main>{BODY}</main><div class=sidebar><p>Side text that is long and looks like an article.</p></div></body>", TEXT),
        (f"<body><div class=content><h1>T</h1><div>{BODY}</div><div><p>Another block of the same story, which is long as well.</p></div></div><section id=comments><p>I read it all and enjoyed it very much, thank you so much!</p></section></body>", f"T {TEXT} Another block of the same story, which is long as well."),
        (f"<article><header><h1>T</h1></header>{BODY}<form><label>Name</label><input></form><aside>x</aside><div class='ad'>Buy this</div></article>", f"T {TEXT}"),
        ("<p>only a fragment<p>second &lt;x&gt; &#233;&eacute;", "only a fragment second <x> éé"),
        ("<article>a<b>c</b>d <i>e</i><br>f<p>g\n\n h</p><!-- no --><![CDATA[no]]>i</article>", "acd e f g h i"),
        ("<article><p><b>open<br><p>next</article>", "open next"),
        ("plain text", "plain text"),
        ("a < b <c", "a < b"),
        ("<ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul>", ""),
        ("<body><article><p>text</p><script>never ends", "text"),
        ("", ""),
        (None, ""),
    ],
)
def test_extract(page, want):
    assert extract(page) == want


def test_hard_pages():
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert extract(deep) == "deep text"
    assert extract("<p title=\"a > b\" x='c>d'>quoted</p>") == "quoted"
    long = "<article>" + "<p>word word word</p>" * 20000 + "</article>"
    assert extract(long) == " ".join(["word word word"] * 20000)


def test_column(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", 5), (2, None, None, 5), (2, None, None, 5), (3, "v", "", 5)], "page_id long, url string, html string, text int")
    rows = main_texts(pages).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in rows] == [(TEXT, len(TEXT)), ("", 0), ("", 0), ("", 0)]
    assert main_texts(pages.limit(0)).count() == 0


LINKS = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li><li><a href=3>Third source</a></li></ul>"
CITED = "First source Second source Third source"


@pytest.mark.parametrize("name", ["entry-content has-sidebar", "no-sidebar", "with-banner", "post-social", "search-content", "sidebar"])
def test_marks_do_not_drop_the_article(name):
    assert extract(f"<body><h1>T</h1><div class='{name}'>{BODY}</div></body>") == TEXT
    parts = "".join(f"<div class='{name}'>{BODY}</div>" for _ in range(5))
    if name != "sidebar":
        assert extract(f"<body><h1>T</h1>{parts}</body>") == " ".join(["T", *[TEXT] * 5])


def test_lists_of_links_and_forms_of_an_article():
    assert extract(f"<body>{LINKS}<article>{BODY}{LINKS}</article></body>") == f"{TEXT} {CITED}"
    assert extract(f"<body>{LINKS}<div>{BODY}{LINKS}</div></body>") == f"{TEXT} {CITED}"
    assert extract(f"<body><form><div><h1>T</h1>{BODY}</div></form></body>") == f"T {TEXT}"
    assert extract(f"<body><form>{LINKS}<div id=related-posts>Another one</div><div>{BODY}</div></form><section class=comments>{BODY * 3}</section></body>") == TEXT


def test_named_parts_of_an_article_stay():
    page = f"<article><h1>T</h1>{BODY}<section id=related-work>{BODY}</section><div class=share-of-market>{BODY}</div></article>"
    assert extract(f"<body><nav>menu</nav>{page}<footer>f</footer></body>") == " ".join(["T", TEXT, TEXT, TEXT])


@pytest.mark.parametrize("page", ["<div>" * 8000 + "x" + "</b>" * 8000, "<div>" * 8000 + "x" + "</div>" * 8000, "<b>" * 8000 + "<div></b>" * 8000, "<div>" * 8000 + "<p>x" * 8000])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 1.5


def random_page(rng, depth=0):
    """Nested blocks of words and links."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        words = " ".join(rng.choice(("lorem", "ipsum", "dolor", "a", "of")) for _ in range(rng.randint(1, 30)))
        if depth < 4 and kind < 0.45:
            tag = rng.choice(("div", "section", "ul", "td", "blockquote"))
            out.append(f"<{tag}>{random_page(rng, depth + 1)}</{tag}>")
        elif kind < 0.75:
            out.append(f"<p>{words}</p>")
        elif kind < 0.9:
            out.append(f"<p>{words} <a href=x>{words[:12]}</a></p>")
        else:
            out.append(f"<span>{words}</span>")
    return "".join(out)


def test_densities_and_choice_are_those_of_the_definition():
    rng = random.Random(3)
    for _ in range(60):
        tree = htmltext._parse(f"<html><body>{random_page(rng)}</body></html>")
        pieces = tree.text
        m = htmltext.measure(tree, pieces)
        n = len(tree.tag)
        above = {i: [i] for i in range(n)}
        for i in range(1, n):
            above[i] += above[tree.parent[i]]
        # Every figure anew from all descendants of a node.
        visible = [i for i in range(n) if m.shown[i]]
        is_link = lambda i: any(tree.tag[a] == "a" for a in above[i])
        sizes = {i: sum(len(" ".join(t.split())) for k, t in pieces if k == i and t) for i in range(n)}
        body = tree.tag.index("body")

        def figures(i):
            own = [d for d in visible if i in above[d]]
            return sum(sizes[d] for d in own), sum(sizes[d] for d in own if is_link(d)), sum(d != i for d in own), sum(d != i and tree.tag[d] == "a" for d in own)

        c_body, lc_body, *_ = figures(body)
        density = {}
        for i in visible:
            c, lc, t, lt = figures(i)
            if c:
                t, lt = max(t, 1), max(lt, 1)
                log_base = math.log(math.log(c / max(c - lc, 1) * lc + lc_body / max(c_body, 1) * c + math.e))
                density[i] = c / t * math.log(max(1.0, c / max(lc, 1) * t / lt)) / log_base if log_base > 0 else c / t
        sums = {i: sum(density.get(k, 0.0) for k in range(n) if tree.parent[k] == i) for i in range(body, tree.end[body])}
        best, got = htmltext.choose(tree, m, body)
        assert all(got[i] == pytest.approx(density.get(i, 0.0)) for i in visible)
        assert sums[best] == pytest.approx(max(sums.values()))


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p>Short note.</p><div class="footer">Copyright 2020 Example Company, all rights reserved and more</div>', "Short note."),
        ('<div class="cookie-notice">We use cookies for all kinds of things, do you agree?</div><p>Short.</p>', "Short."),
        ('<div class="ad">An advert that is longer than the page.</div><article><h1>T</h1><p><b>T<br></article>', "T T"),
        ('<main><p>Brief.</p></main><div class="sidebar"><p>Long sidebar text that goes on and on.</p></div>', "Brief."),
        ('<article><h1>T</h1><p>Article.</p></article><div class="user-feedback thread">' + f'<div class="post"><p>{"Readers say a lot. " * 9}</p></div>' * 10 + "</div>", "T Article."),
        ('<article><h1>T</h1><p>A.</p><section class="search"><h2>Search</h2><p>How search works.</p></section></article>', "T A. Search How search works."),
        ('<article><h1>T</h1><p>A.</p><div class="search-box"><form><input></form>Find</div></article>', "T A."),
        ('<article><h1>T</h1><p>Text.</p><div class="promo-x">Buy now</div></article>', "T Text."),
        ("<form><h1>T</h1><p>All of it stands in one form.</p></form>", "T All of it stands in one form."),
        ('<div class="sidebar"><h1>T</h1><p>A mark on what holds the title does not count.</p></div>', "T A mark on what holds the title does not count."),
    ],
)
def test_marks_count_whatever_their_share(page, text):
    assert htmltext.extract(f"<html><body>{page}</body></html>") == text


def test_many_marks_and_titles_take_linear_time():
    import time

    page = "<body>" + '<div class="sidebar">a</div>' * 6000 + "<h1>b</h1>" * 6000 + "</body>"
    began = time.process_time()
    assert htmltext.extract(page).startswith("b b")
    assert time.process_time() - began < 2


def test_densest_part_is_found_without_any_name():
    """Where no tag or class names the article, its density does."""
    links = "".join(f'<div><a href="/{i}">link {i}</a> and <a href="/x{i}">another</a> of them</div>' for i in range(12))
    text = "".join(f"<p>Paragraph {i} of the text, which has many more characters than tags, as an article does.</p>" for i in range(6))
    got = htmltext.extract(f"<html><body><div><div>{links}</div></div><div><div>{text}</div></div></body></html>")
    assert "Paragraph 0" in got and "Paragraph 5" in got and "link 3" not in got
