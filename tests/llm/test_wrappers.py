import html
import random
import re
import time

from covara.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home<li><a href="/x">X</a></ul></nav><div id="cookie-notice"><p>We use cookies</p></div>
{body}
<aside>Side</aside><div class="sidebar"><p>More</p></div><form><label>Mail</label><input><button>Go</button></form>
<section class="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""


def text_of(page, root="article"):
    return w.article_text(w.stream(page)[1], root, frozenset(), frozenset(), frozenset())


def extracted(spark, pages):
    """Texts of pages of one host, by the whole operator."""
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in w.extract_text(df).orderBy("page_id").collect()]


def test_article_only():
    body = "<article><h2>A  title</h2><p>One &lt;two&gt;<b>bold</b>er\n text.<br>Next<p>Open <i>p</i>&nbsp;end<div class='ad'>Buy</div><ul><li>a<li>b</ul><!-- c --><div class=comments>Nice</div></article>"
    assert text_of(PAGE.format(body=body)) == "A title One <two>bolder text. Next Open p end a b"


def test_unclosed_and_odd_markup():
    assert text_of("plain &amp; text") == "plain & text"
    assert text_of("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text_of("<article><p>cut off") == "cut off"
    assert text_of("<div title='a > b'>x</div><script>never closed") == "x"
    assert text_of("<P>A<BR/>B</P></div></nothing>") == "A B"


def test_folding_and_alignment():
    li = ["li", "#", "/li"]
    assert w.fold(["ul", *li, *li, *li, "/ul"]) == ["ul", ["+", li], "/ul"]
    one = w.fold(["ul", *li, "/ul", "p", "#"])
    many = w.fold(["ul", *li, *li, "/ul", "b", "#"])
    both = w.wrapper([many, one])
    assert both[:3] == ["ul", ["+", li], "/ul"]
    assert ["?", ["p"]] in both and ["?", ["b"]] in both and both[-1] == "#"
    assert w.wrapper([both, many, one]) == both


def test_common_subsequence_is_longest():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        pairs = w.common(a, b)
        assert len(pairs) == best[0][0] and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_class_words_mark_the_element_they_name():
    page = '<body class="no-sidebar header-fixed"><div class="search-enabled"><article><h1>T</h1><p>Text</p></article></div></body>'
    assert text_of(page) == "T Text"
    assert text_of("<div class='comment-list'><p>First!</p></div><div class='site-header'>S</div><p>x</p>") == "x"
    assert text_of("<form><article><p>kept</p><form><p>mail</p></form></article></form><div class=comments><article><p>reply</p></article></div>") == "kept"


def test_broken_quotes():
    assert text_of("<article><p class='x>Hello it's <b>x</b></p><p title='a > b' class=\"y\">two</p><p title=\"c<d\">three</p></article>") == "Hello it's x two three"


def test_long_pages_take_time_in_proportion():
    began = time.time()
    for page in ('<a "' * 40_000, "<div>" * 40_000, "<b>" * 20_000 + "<p>x" * 20_000 + "</q>" * 20_000):
        w.fold(w.stream(page)[0])
    assert time.time() - began < 15


def test_article_in_main_beside_a_teaser(spark):
    pages = [f"<main><h1>Title {i}</h1><p>The long text of page number {i} goes on and on here.</p><article class=card><a href=/x>Other</a><p>Teaser</p></article></main>" for i in range(3)]
    assert extracted(spark, pages) == [f"Title {i} The long text of page number {i} goes on and on here." for i in range(3)]


def test_title_and_body_without_article_element(spark):
    pages = [f"<div><div class='entry-title'>Title {i}</div><div class='post-body'><p>Text {i}</p></div></div>" for i in range(3)]
    assert extracted(spark, pages) == [f"Title {i} Text {i}" for i in range(3)]


def test_the_wrapper_tells_menus_by_other_pages(spark):
    """One link alone may be text; that it is a menu of one entry follows from the other pages of the host."""
    menu = lambda n: "<ul>" + "".join(f"<li><a href=/{k}>Entry {k}</a></li>" for k in range(n)) + "</ul>"
    body = "<div><p>Text {}</p></div>"
    assert extracted(spark, [menu(1) + body.format(0)]) == ["Entry 0 Text 0"]
    assert extracted(spark, [menu(k) + body.format(k) for k in (1, 4, 6)]) == [f"Text {k}" for k in (1, 4, 6)]


def test_template_text_is_no_article(spark):
    page = "<article><p>Read more at the desk of this paper.</p><p>Text {} " + "and its words " * 20 + "</p></article>"
    found = extracted(spark, [page.format(i) for i in range(8)])
    assert found == [f"Text {i} " + ("and its words " * 20).strip() for i in range(8)]
    assert extracted(spark, [page.format(0)] * 8)[0].startswith("Read more")  # copies of one page tell nothing
    near = ["<article>" + "".join(f"<p>Paragraph {k}</p>" for k in range(9)) + f"<p>End {i}</p></article>" for i in range(8)]
    assert all(x.startswith("Paragraph 0 Paragraph 1") for x in extracted(spark, near))  # near copies share their text


def test_shapes_are_aligned_in_a_tree(spark):
    shapes = [("h", f'["div", "p.c{chr(97 + i % 26)}{chr(97 + i // 26)}", "#", "/p", "/div"]', 1) for i in range(300)] + [("i", '["p", "#"]', 9)]
    df = spark.createDataFrame(shapes, "host string, shape string, n long")
    found = {r.host: w.json.loads(r.wrapper) for r in w.infer_wrappers(df, fan_in=8).collect()}
    assert set(found) == {"h", "i"} and found["i"] == ["p", "#"]
    symbols = {x for n in found["h"] for x in (n[1] if isinstance(n, list) else [n])}
    assert {x for _, s, _ in shapes[:300] for x in w.json.loads(s)} == symbols


def test_hosts_decide_by_their_wrapper(spark):
    a = "<body><div class='story'><p>{}</p></div><p>Contact us</p></body>"
    rows = [(i, "http://h.org/%d" % i, a.format(f"Text {i}")) for i in range(5)] + [(9, "http://other.org/", "<body><p>All of</p><p>this</p></body>"), (10, None, None), (11, "::bad", ""), (9, "http://other.org/", "<body><p>All of</p><p>this</p></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as shape", "3 as text", "4 as blocks")
    found = w.extract_text(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in found) == [(i, f"Text {i}", 6) for i in range(5)] + [(9, "All of this", 11)] * 2 + [(10, "", 0), (11, "", 0)]
    assert w.extract_text(df.filter("false")).count() == 0


def test_query_against_plain_pattern(spark, sf):
    """The pages of the test tables have one article each; a pattern over the raw text gives the same."""
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        pieces = re.split(r"</?(?:p|h1|br)>", inside[1]) if inside else []
        want[r.page_id] = " ".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in pieces) if x)
    got = {r.page_id: (r.text, r.n_chars) for r in w.op2_html_text(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
