import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import html_text as h

PAGES = "page_id long, url string, html string"


def text(page):
    lines = h.lines_of(page)
    return " ".join(t for t, inside, gone in lines if not gone and (inside or not any(m and not d for _, m, d in lines)))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a  b\n c</p><p>d</p>", "a b c d"),
        ("<p>un<b>bro</b>ken<p>next<br>line", "unbroken next line"),
        ("<nav>menu</nav><article><h1>T</h1><p>x</p></article><footer>f</footer>", "T x"),
        ("<script>var t='</p><p>no';</script><p>yes", "yes"),
        ("<style>p{}</style><!-- no --><p>yes<!-- > no --></p>", "yes"),
        ("<article><p>x</p><div class='comments'><p>no</p></div><p>y</p></article>", "x y"),
        ("<article>x<aside>no<p>no</aside>y<form><input>no</form></article>", "x y"),
        ("<div class=ad>no</div><p>x</p><div id='cookie-notice'>no</div>", "x"),
        ("<header>no</header><main><header><h1>no</h1></header><h1>T</h1>x</main>", "T x"),
        ("<div class='layout has-sidebar'><article><p>x</article><div class=sidebar>no</div></div>", "x"),
        ("<form id='aspnetForm'><article><p>x</article><nav>no</nav></form>", "x"),
        ("<div class='share-buttons-enabled page'><main><p>x</main></div>", "x"),
        ("<article><p class='related-work'>x</p><p class=notice>no</p></article>", "x"),
        ("<article>x</article><section class=comments><article>no</article></section>", "x"),
        ("<article>x<section class=comments><article class=comment>no</article></section></article>", "x"),
        ("<body class='has-sidebar'><p>x", "x"),
        ("<article class='post with-comments'>x</article>", "x"),
        ("<p>1 &lt; 2 < 3 &am &amp&copy;", "1 < 2 < 3 &am &©"),
        ("<article><p>a</article></div></p><p>out", "a"),
        ("<div role='navigation'>no</div><p title='a>b'>x</p>", "x"),
        ("<ul><li>a<li>b</ul>c", "a b c"),
    ],
)
def test_lines(page, want):
    assert text(page) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/&;ap \"'=!-div", max_size=60))
def test_any_markup_ends(page):
    h.lines_of(page)


def slow_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_shared_is_a_longest_common_subsequence(a, b):
    places = h.shared(a, b)
    assert places == sorted(set(places)) and len(places) == slow_lcs(a, b)
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in (a[p] for p in places))


def test_differencing_without_markup(spark):
    def page(body):
        return f"<div>Site name</div><div>Home</div><p>{body}</p><div>All rights</div>"

    rows = [(k, f"http://a.com/x/{k}", page(f"body {k}")) for k in range(4)] + [(9, "http://b.com/x/1", page("alone"))]
    table = h.extract(spark.createDataFrame(rows, PAGES)).collect()
    got = {r["page_id"]: r["text"] for r in table}
    assert {r["page_id"]: r["n_shared"] for r in table} == {0: 3, 1: 3, 2: 3, 3: 3, 9: 0}
    assert got == {**{k: f"body {k}" for k in range(4)}, 9: "Site name Home alone All rights"}


def test_differencing_beside_an_article(spark):
    """A teaser's article doesn't hide the main text beside it; shared lines go inside an article too, but for quoted passages."""

    def page(k):
        return f"<div>Site name</div><article><h3>Read more</h3><p>teaser {k}</p><p>a quoted passage</p><div>Share this</div></article><div>body {k}</div><div class=ad>ad {k}</div><div>All rights</div>"

    rows = [(k, f"http://a.com/x/{k}", page(k)) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: f"teaser {k} a quoted passage body {k}" for k in range(4)}


def test_a_copy_is_no_template(spark):
    rows = [(k, f"http://a.com/{k}", "<p>one</p><p>two</p>") for k in range(3)]
    assert {r["text"] for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"one two"}


def test_pairs_are_the_nearest_in_order(spark):
    rnd = random.Random(2)
    rows = [(f"h{rnd.randrange(3)}", f"/{rnd.choice('ab')}/{rnd.randrange(30)}", f"r{k:02}") for k in range(60)] + [("single", "/", "r99")]
    got = {r["row"]: r["partner"] for r in h.partners(spark.createDataFrame(rows, "host string, path string, row string")).collect()}
    order = sorted(rows)

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {}
    for k, (host, path, row) in enumerate(order):
        near = [(common(path, o[1]), -n, o[2]) for n, o in enumerate((order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None)) if o and o[0] == host]
        if near:
            want[row] = max(near)[2]
    assert got == want


def test_odd_rows(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(0, None, None), (1, "no url", ""), (2, "http://a/1", long), (3, "http://a/1", long), (None, "http://a/1", "<p>x</p>"), (4, None, "<article>x</article>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("host", F.lit(1))
    got = h.extract(pages).collect()
    assert len(got) == 6 and {r["page_id"]: r["text"] for r in got}[4] == "x"
    assert h.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("table", [1 << 25, 8])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, table):
    """Against the plain recurrence, also where the table is halved."""
    monkeypatch.setattr(h, "MOST_TABLE", table)
    rnd = random.Random(table)
    for _ in range(400):
        kinds = rnd.randrange(1, 6)
        a, b = ([rnd.randrange(kinds) for _ in range(rnd.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places, rest = h.shared(a, b), iter(b)
        assert len(places) == best[-1][-1] and places == sorted(set(places)) and all(a[k] in rest for k in places)


def test_long_pages_of_few_kinds_of_lines_end():
    rnd = random.Random(1)
    a, b = ([rnd.randrange(2) for _ in range(20_000)] for _ in range(2))
    assert len(h.shared(a, b)) > 15_000
