import re
from collections import Counter

import pytest

from strata.llm import html
from tests.llm.common import table, workers  # noqa: F401

WEIGHTS = {"": 2.0, "p": -0.02, "/p": -0.02, "b": -0.02, "/b": -0.02, "h1": -0.02, "/h1": -0.02, "br": -0.02,
           "nav": -6.0, "/nav": -6.0, "div": -6.0, "/div": -6.0, "a": -8.0, "/a": -8.0}

PAGES = [
    ("<html><body><nav><a href=x>one</a> two</nav><article><h1>T &amp; t</h1><p>first  <b>bo</b>ld\n text</p><p>x</p>"
     "</article><footer>&copy; me you they</footer></body></html>", "T & t first bold text x"),
    ("<body><div class='page-sidebar'>many words stand here in the side</div><main><p>the text</p><form>name <input></form>"
     "<p>goes on</p></main></body>", "the text goes on"),
    ("<article><p>own text<section id=comments><p>I liked it, so much, really</section></article>", "own text"),
    ("<body><script>if (a<b) { c = '<p>no</p>' }</script><style>p{}</style><p>plain</p><!-- <p>hidden</p> --></body>", "plain"),
    ("<p>a&nbsp;&#233;&lt;b&gt; &unknown; &amp", "a é<b> &unknown; &"),
    ("no markup at all", "no markup at all"),
    ("<div role='banner'>b</div><div><p>1 < 2 words</p></div>", "1 < 2 words"),
    ("<article><p>deep <span>in<i>line</i></span>s<br>next<ul><li>i<li>j</ul></article>", "deep inlines next i j"),
    ("<nav>only a menu</nav>", ""), ("<p></p>", ""), ("", ""), (None, ""),
    ("<aside>never closed <p>so this stays</p>", "never closed so this stays"),
    ("<article>" + "<p>word</p>" * 5000 + "</article>", " ".join(["word"] * 5000)),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html.main_text(page, WEIGHTS) == want


TEXT = "<h1>T</h1><p>the text of the page goes on here</p>"
WRAPPED = [
    *[(f"<body><nav>go on</nav><div {wrapper}><article>{TEXT}</article><div class=sidebar>s</div></div></body>",
       "T the text of the page goes on here")
      for wrapper in ("class='has-sidebar'", "class='elementor-widget-container'", "class='elementor-widget x'", "id=search",
                      "class='modal-dialog' style='display:none'", "role=alert", "hidden", "class='post-comments'")],
    (f"<body><form action=x><main>{TEXT}</main></form></body>", "T the text of the page goes on here"),
    (f"<body><form action=x><div>{TEXT}</div></form><p class=copyright>c</p></body>", "T the text of the page goes on here"),
    (f"<body><div class='no-sidebar widget'>{TEXT}</div><div class=ad>buy</div></body>", "T the text of the page goes on here"),
    ("<body><div class=elementor-widget><p>one two three</p></div><div class=elementor-widget><p>four five six</p></div></body>",
     "one two three four five six"),
    ("<body><div class=widget><article><p>a b c</p></article></div><div class=widget><article><p>d e f</p></article></div></body>",
     "a b c d e f"),
    ("<article><p>a b c</p><h2 id='related-work'>d</h2><h2 id=search>e</h2><p class='notice-period'>f</p>"
     "<p title='the hidden cost'>g</p><p data-role=banner>h</p><p title='a class=ad b'>i</p></article>", "a b c d e f g h i"),
    ("<article><p>a b c</p><p hidden>d</p><p style='display: none'>e</p><p aria-hidden=true>f</p><div class='page-ad'>g</div>"
     "<section class='x comments'><article>h i</article></section></article>", "a b c"),
    ("<main><article><p>a b c d</p></article><section id=comments><article>h i</article></section>"
     "<aside><article>j</article></aside></main>", "a b c d"),
]


@pytest.mark.parametrize("page,want", WRAPPED)
def test_what_holds_the_content_is_no_furniture(page, want):
    assert html.main_text(page, WEIGHTS | {"article": -0.02, "/article": -0.02, "div": -0.5, "/div": -0.5, "h2": -0.02, "/h2": -0.02}) == want


def test_many_open_wrappers():
    assert html.main_text("<div class=widget>" * 20000 + "a b" + "</div>" * 20000, WEIGHTS | {"div": -6.0}) == "a b"


def test_best_run_is_the_maximum():
    found = html.events("<div>a b</div><a>c</a><p>d e f</p><p>g</p><div>h</div>")

    def value(event):
        kind, text, furniture = event
        return WEIGHTS.get(kind, -8.0) if kind else len(text.split()) * (-2.0 if furniture else 2.0)
    sums = {(i, j): sum(map(value, found[i:j + 1])) for i in range(len(found)) for j in range(i, len(found))}
    first, last = html.best_run(found, WEIGHTS)
    assert sums[first, last] == max(sums.values())


def test_weights_from_labelled_pages():
    counts = Counter()
    for page, _ in PAGES[:4]:
        counts.update(html.tally(page or "") or {})
    learned = html.weights({kind: (counts[kind, True], counts[kind, False]) for kind, _ in counts})
    assert learned[""] > 0 and all(weight < 0 for kind, weight in learned.items() if kind)
    assert learned["p"] > learned["nav"]
    assert html.tally("<p>no article</p>") is None and html.tally("<article>a</article><article>b</article>") is None


def test_rows(spark):
    rows = [(i, None if i == 3 else f"u{i}", page, "x", "y") for i, (page, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0], (None, "u", "<p>q</p>", "x", "y")],
                                  "page_id long, url string, html string, text string, h string")
    want = [(i, None if i == 3 else f"u{i}", text, len(text)) for i, (_, text) in enumerate(PAGES)]
    assert table(html.extracted(pages), "page_id", "url", "text", "n_chars") == sorted([*want, want[0], (None, "u", "q", 1)], key=repr)
    assert html.extracted(pages.limit(0)).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in html.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        inner = html.entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner)))
        assert row["text"] == " ".join(inner.split())


LINKS = "".join(f"<a href=/{i}>one two</a> <br>" for i in range(12))
FLAT = f"<body>{LINKS}<h1>T</h1><p>the text of the page goes on</p><p>and on, with <a href=x>a link</a> in it, for a while</p>{LINKS}</body>"
LEARNED = WEIGHTS | {"a": -1.0, "/a": -1.0, "a ": -2.0}


def test_a_flat_page_has_the_run_and_not_its_container():
    assert html.main_text(FLAT, LEARNED) == "T the text of the page goes on and on, with a link in it, for a while"


def test_the_run_decides(monkeypatch):
    unnamed = f"<body><table><tr><td>{LINKS}</td></tr></table><p>the text goes on here</p><td>{LINKS}</td></body>"
    right = [html.main_text(page, LEARNED) for page in (FLAT, unnamed)]
    monkeypatch.setattr(html, "best_run", lambda found, weight: (0, len(found) - 1))
    assert right[1] == "the text goes on here"
    assert all(html.main_text(page, LEARNED) != text for page, text in zip((FLAT, unnamed), right))


def test_names_are_learned_from_labelled_pages(spark):
    box = "<div class='zq-box'>some words that stand beside the text of the page, many of them</div>"
    labelled = [(i, "u", f"<body>{box}<article><div class=body-copy><p>{'the text ' * 20}number {i}</p></div></article></body>") for i in range(8)]
    other = (9, "u", f"<body><div class=body-copy><p>{'the text ' * 20}</p>{box}<p>goes on</p></div></body>")
    pages = spark.createDataFrame([*labelled, other], "page_id long, url string, html string")
    weight = html.learn(pages)
    assert html.learned_names(weight) == {"zq-box"}
    assert {row.page_id: row.text for row in html.extracted(pages).collect()}[9] == "the text " * 20 + "goes on"


@pytest.mark.parametrize("part", ["<p ", "<a href=\"", "<a title='", "<!-- ", "<!x ", "<script>", "</p", "<", "<p x=\"'\" ", "<div class=widget>", "&lt;"])
def test_a_page_of_open_ends_takes_linear_time(part):
    import time
    page = part * ((1 << 20) // len(part))
    begun = time.process_time()
    html.main_text(page, LEARNED)
    html.tally(page)
    assert time.process_time() - begun < 6


def test_tags_end_outside_of_quotes():
    kinds = [(kind or text, attributes) for kind, text, attributes in html.scanned("<p a='>' b=\">\">x</p><q c='>y</q><i d=\">z")]
    assert kinds == [("p", " a='>' b=\">\""), ("x", ""), ("/p", ""), ("q", " c='"), ("y", ""), ("/q", ""), ("i", " d=\""), ("z", "")]
