import html
import re

import pytest

from murmuration.llm import main_text as m

PARAGRAPHS = ["The river rose over night and the old bridge was closed to all carts.", "Nobody had seen such a flood since the mill was built, said the miller.", "Then the water fell."]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
ARTICLE = f"<h1>Flood</h1>{BODY}"
WANT = "\n".join(["Flood", *PARAGRAPHS])
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(8)) + "</ul>"
COMMENTS = "<h2>3 comments</h2>" + "".join(f"<p>I think that reader number {k} is wrong about all of this, and always was.</p>" for k in range(9))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav>{MENU}</nav><article>{ARTICLE}</article><footer>All rights</footer></body></html>",
        f"<body class='has-sidebar'><header><h1>Site</h1>{MENU}</header><main>{ARTICLE}</main><aside><p>Read this too, it is long enough to count.</p></aside></body>",
        f"<body><div id=page><div class='site-menu'>{MENU}</div><div id=content>{ARTICLE}</div><div id='comments'>{COMMENTS}</div></div></body>",
        f"<body><article>{ARTICLE}<section class='comment-list'><article class=comment>{COMMENTS}</article></section></article></body>",
        f"<body><form id=all><div class=menu>{MENU}</div><div>{ARTICLE}</div></form></body>",
        f"<body><div class='cookie-notice'><p>We use cookies to make this page better for you and for us.</p></div><div>{ARTICLE}</div><div>{MENU}</div></body>",
        f"<body>{MENU}{ARTICLE}{MENU}",
        f"<nav>{MENU}<article>{ARTICLE}</article>",
        f"<article><header><p>By a writer</p><h1>Flood</h1></header>{PARAGRAPHS[0]}<div class='ad'>Buy <b>now</b></div><p>{PARAGRAPHS[1]}<form><input value='mail'>Sign up</form><p>{PARAGRAPHS[2]}</article>",
        f"<article><h1>Flood</h1><p>{PARAGRAPHS[0]}<script>var a = '</p>' + \"<p>no</p>\";</script><style>p{{}}</style><!-- <p>not this</p> --><p>{PARAGRAPHS[1]}<br><p><b>{PARAGRAPHS[2]}</article>",
        f"<ARTICLE><H1>Flood</H1><P title='a > b'>{PARAGRAPHS[0]}<P hidden>no</P><P>{PARAGRAPHS[1]}<P>{PARAGRAPHS[2]}<TEXTAREA>x</TEXTAREA><SELECT><OPTION>y</SELECT></ARTICLE>",
    ],
)
def test_articles_come_out_whole_and_alone(page):
    assert m.extract(page) == WANT


def test_white_space_references_and_lists():
    page = "<article><h1>A&nbsp;&amp;  B</h1>\n<p>one\n\t two<br>three &lt;p&gt; &#233;&#x1F600;</p><ul><li>x <a href=y>link</a></li><li>z<ul><li>deep</ul></ul>loose<table><tr><td>c1<td>c2</table><pre>a\n b</pre></article>"
    assert m.extract(page) == "A & B\none two three <p> é😀\nx link\nz\ndeep\nloose\nc1\nc2\na b"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<html>", "<!-- open", "<script>open", "<p", "<a b='", "</div></p>", "<nav>only a menu</nav>", "\x00"])
def test_pages_without_text(page):
    assert m.extract(page) in ("", "<", "<p", "<a b='", "\x00")


def test_a_run_is_the_best_of_all():
    import random

    r = random.Random(3)
    for _ in range(200):
        values = [(-r.random() * 5, r.random() * 6) for _ in range(r.randint(1, 9))]
        total = lambda a, b: sum(t + w for t, w in values[a + 1 : b + 1]) + values[a][1] + max(0.0, values[a][0])
        best = max(total(a, b) for a in range(len(values)) for b in range(a, len(values)))
        first, last = m.best_run(values)
        assert total(first, last) == pytest.approx(best)


def test_long_and_broken_pages_take_linear_time():
    assert len(m.extract("<article>" + "<p>word word word" * 60_000 + "</article>").split("\n")) == 60_000
    m.extract("a <b " * 200_000)
    m.extract('<a b="' * 100_000)
    assert m.extract("<div>" * 300 + "some words here " * 20 + "</div>" * 300)


def expected(source):
    """Text of the tables' pages, whose articles hold h1 and p elements only."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(filter(None, parts))


def test_labelled_pages_of_the_table_with_and_without_their_marks(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    weights = m.train(pages)
    assert weights.words["text"] > 0.9 > 0.1 > weights.words["a list"] and weights.cost in m.COSTS
    for marked in (True, False):
        given = pages if marked else pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
        got = m.main_text(given, weights).collect()
        assert len(got) == len(rows) and all(r.text == expected(rows[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_edge_tables(spark):
    rows = [(1, "u", None, "x", 5), (1, "u", None, "x", 5), (None, None, f"<article>{ARTICLE}</article>", "y", 6), (2, None, "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(str, m.main_text(pages).collect()))
    assert got == sorted(map(str, m.main_text(pages).collect())) and len(got) == 4 and sum(WANT.split("\n")[1] in g for g in got) == 1
    assert m.main_text(pages.limit(0)).count() == 0
    many = spark.range(50).selectExpr("id as page_id", "'u' as url", "'<article><p>word word</article>' as html")
    assert m.sample_of(many, 20).count() == 20 and m.sample_of(many.limit(0)).count() == 0
