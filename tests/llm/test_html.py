import math
import random
import time
from html import unescape

import pytest

from claimlens.llm import html as H
from claimlens.llm.tables import table

MARKED = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header>
<nav><a href=x>Home</a><a>Foo</a></nav><div class="cookie-notice">We use cookies</div><main><article><header>
<h1>Title here</h1></header><p>First para with <b>bold</b>text &amp; more&nbsp;
words.</p><aside>Related things</aside><form>Sign <input> up</form><p>Second &lt;one&gt; para.<br>End</p>
<div id=comments><p>nice post thanks a lot dude</p></div></article></main><footer>foot</footer></body></html>"""
UNMARKED = """<html><body><div id=header>Site head</div><ul class=menu><li><a href=x>Home</a><li><a>Foo</a></ul>
<div class=content><h1>Title here</h1><p>A first paragraph that has some words in it.</p><div class="ad">Buy now
and save a lot</div><p>A second paragraph that has some words as well.</p><div id=comments><p>nice post
thanks</p></div><div class=footer>foot</div></body></html>"""


def test_regions_by_prior_weights():
    assert H.main_text(MARKED, {}) == "Title here\nFirst para with boldtext & more words.\nSecond <one> para. End"
    want = "Title here\nA first paragraph that has some words in it.\nA second paragraph that has some words as well."
    assert H.main_text(UNMARKED, {}) == want


@pytest.mark.parametrize("page", [None, "", "<p>", "<div", "<!-- x", "<script>var a</script>", "<a href='>"])
def test_pages_without_text(page):
    assert H.main_text(page, {}) == ""


def test_best_sum_is_found(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    weights = H.learn(pages, "html")
    assert all(w < 0 for k, w in weights.items() if not k.startswith("w:"))
    assert weights["w:article"] > 0 > weights["w:footer"]
    for r in pages.limit(20).collect():
        row = list(H.tokens(r.html))
        score = H.scores(row, weights)
        best = max(
            (round(math.fsum(score[i:j]), 6), -i, -j) for i in range(len(row)) for j in range(i, min(len(row), i + 400) + 1)
        )
        first, last = H.best_region(score)
        assert last - first <= 400 and round(math.fsum(score[first:last]), 6) == best[0] > 0
        parts = "".join(
            ("" if aside else text) if name is None else "\0" if name in H.BLOCKS else " " if name == "br" else ""
            for _, name, text, aside in row[first:last]
        )
        lines = (" ".join(unescape(part).split()) for part in parts.split("\0"))
        assert H.main_text(r.html, weights) == "\n".join(line for line in lines if line)


def test_first_of_equal_regions():
    assert H.best_region([1, -2, 1, 0, -1, 1]) == (0, 1) and H.best_region([-1, 0]) == H.best_region([]) == (0, 0)
    rng = random.Random(4)
    for _ in range(300):
        score = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        n = len(score)
        most = max([sum(score[i:j]) for i in range(n) for j in range(i, n + 1)] or [0])
        first, last = H.best_region(score)
        assert sum(score[first:last]) == most


W, W2 = " ".join(f"word{i}" for i in range(25)), " ".join(f"more{i}" for i in range(25))
ORDINARY = [
    # Comments that are articles themselves, inside and beside the article.
    (f"<main><article><h1>Head</h1><p>{W}</p><section class=comments><article class='comment'><p>nice {W2}</p>"
     "</article></section></article></main>", f"Head\n{W}"),
    (f"<article><h1>Head</h1><p>{W}</p></article><div id=comments><article><p>nice {W2}</p></article></div>", f"Head\n{W}"),
    (f"<article><p>{W}</p><div class='comments'><article><p>nice {W2}</p></article></div></article>", W),
    # End tags left out.
    (f"<article><p class=notice>Site notice<p>{W}<p>{W2}</article>", f"{W}\n{W2}"),
    (f"<ul class=menu><li class=nav>Home<li>b</ul><article><ul><li class=ad>buy<li>{W}</ul></article>", W),
    (f"<article><table><tr><td class=ad>buy<td>{W}<tr><td>{W2}</table></article>", f"{W}\n{W2}"),
    # Names that tell of a layout or of the article's own parts.
    (f"<article><div class='article-header'><h1>Head</h1></div><div class='side-by-side'><p>{W}</p></div>"
     f"<div class='related-work'><p>{W2}</p></div><table><tr><td class=header>Col<td class=x>1</table></article>",
     f"Head\n{W}\n{W2}\nCol\n1"),
    (f"<div id=wrap class='layout with-sidebar'><article><p>{W}</p></article><div class=sidebar>{W2}</div></div>", W),
    (f"<form id=page><article><p>{W}</p></article></form>", W),
    # A quote too many, an end tag that ends nothing.
    (f'<article><p title="x>{W}</p><p>{W2}</p></article>', f"{W}\n{W2}"),
    (f'<article><p title="x>{W}</p><p class="y">{W2}</p></article>', f"{W}\n{W2}"),
    (f"<article><div class=ad><table><tr><td>x</div>y</table>buy</div><p>{W}</p></article>", W),
    (f"<article><p>a < b and {W}</p></article>", f"a < b and {W}"),
    # Not marked at all; a class of the body says nothing.
    (f"<div id=wrap><h1>Head and more</h1><p>{W}</p></div>", f"Head and more\n{W}"),
]


@pytest.fixture(scope="module")
def learnt(spark):
    return H.learn(table(spark, "/root/testdata/sf0.01", "pages"), "html")


@pytest.mark.parametrize("page, want", ORDINARY)
def test_ordinary_pages(learnt, page, want):
    html = f"<html><body class='page with-sidebar'>{page}</body></html>"
    assert H.main_text(html, {}) == want
    assert H.main_text(html, learnt) == want


@pytest.mark.parametrize("junk", ["<td>", "<a ", "<a<", '<p title="x>', "<p class=ad><td>", "<span class=ad><div>", "</div>", "<a href='"])
def test_long_broken_pages_take_linear_time(junk):
    start = time.process_time()
    assert H.main_text(f"<article>{W}{junk * 100_000}", {}).startswith(W)
    assert time.process_time() - start < 4


def test_table(spark):
    rows = [(1, "u", MARKED, "x"), (1, "u", MARKED, "x"), (None, None, None, "y")]
    got = H.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got)[2] == ("None", 0)
    assert {r.text for r in got if r.page_id} == {H.main_text(MARKED, {})}
    assert H.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


def test_unmarked_pages_beside_marked_ones(spark):
    """Bylines in plain elements of marked pages do not cost unmarked pages their text."""
    words = " ".join(f"word{i}" for i in range(30))
    by = "".join(f"<{e}>by someone on a day</{e}>" for e in ("div", "section", "td")) + "and more"
    marked = [
        f"<html><body>{by}<main><article><h1>Head {i}</h1><p>{words}</p></article></main>{by}</body></html>"
        for i in range(40)
    ]
    plain = [
        f"<html><body><ul class=menu><li><a href=x>Home</a></ul>{page}</body></html>"
        for page in (
            f"<div><p>{words}</p></div>",
            f"<section><div><p>{words}</p><p>{words}</p></div></section>",
            f"<table><tr><td><p>{words}</p></td></tr></table>",
            f"<p>{words}</p>",
        )
    ]
    pages = [(i, "u", p) for i, p in enumerate(marked + plain)]
    table_ = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r.page_id: r.text for r in H.extract(table_).collect()}
    assert [got[i] for i in range(40)] == [f"Head {i}\n{words}" for i in range(40)]
    assert [got[40 + i] for i in range(4)] == [words, f"{words}\n{words}", words, words]


def test_wrapped_content_counts_for_its_container():
    inside, outside = H.count_kinds("<body><div>by me<article><div><p>one <a>two</a></p></div></article></div></body>")
    assert inside["w:unmarked div"] == 1 and inside["w:unmarked div+a"] == 1 and outside["w:unmarked div"] == 2
    assert H.weight("w:unmarked div", 0, 99) == H.prior("w:div") and H.weight("w:div", 0, 99) < 0
