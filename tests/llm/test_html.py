"""Main text of pages: wrappers whose names mislead, odd rows, and markup that must not take long."""

import time

import pytest

from siltgauge.llm import html

PARAGRAPHS = [" ".join(f"word{k}x{i}" for k in range(60)) for i in range(3)]
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
WANT = "\n\n".join(["A headline", *PARAGRAPHS])


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="has-sidebar">', '<div class="col sidebar-right">', '<div class="search-page">', '<div class="post tag-science">', '<div class="entry legal-news">',
        '<article><div class="article-header-wrap">', '<form id="aspnetForm">', '<main class="page">', "<div id=content>",
    ],
)
def test_a_name_drops_no_whole_article(wrapper):
    closing = "".join(f"</{t}>" for t in ("article", "form", "main", "div") if f"<{t}" in wrapper)
    page = (
        f'<html><head><title>T</title><style>p {{}}</style></head><body><nav><a href="/">Home</a></nav>{wrapper}<h1>A headline</h1>{BODY}{closing}'
        '<div class="comments"><p>I think so too, my friend, and more.</p></div><form><p>Give us your address</p></form><div class="ad">Buy now and save</div>'
        "<script>var x = '<p>no</p>';</script><footer>All rights</footer></body></html>"
    )
    assert html.main_text(page) == WANT


def test_references_spaces_and_line_breaks():
    page = f"<article><h1>A  &lt;b&gt;\n headline&nbsp;here</h1><p>one<br>two &amp; <i>thr</i>ee &#8364; 1 < 2 {PARAGRAPHS[0]}</p></article>"
    assert html.main_text(page) == f"A <b> headline here\n\none two & three € 1 < 2 {PARAGRAPHS[0]}"


def test_odd_rows_and_clashing_columns(spark):
    page = f"<body><article>{BODY}</article></body>"
    rows = [(1, "u", page, "x", 0), (1, "u", page, "x", 0), (2, None, None, None, None), (3, "v", "", "x", 1), (None, "w", f"<p>{'long ' * 400_000}</p>", "x", 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert [r["text"] for r in got[:4]] == ["\n\n".join(PARAGRAPHS)] * 2 + ["", ""] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert got[4]["n_chars"] == 5 * 400_000 - 1
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("unit", ["<p<", "<div>", "<svg>", "<a \"> \" ", "<a b=\"'", "<", "<!--", "x</span>", "<p><b>x ", "<svg>x </path>"])
def test_bad_markup_is_read_in_linear_time(unit):
    begun = time.process_time()
    html.main_text(unit * (2_000_000 // len(unit)) + "'")
    assert time.process_time() - begun < 10
