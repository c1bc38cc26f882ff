"""Main text: labelling against exhaustive search, parsing, and the parts a page may have."""

import html
import itertools
import random
import re
from collections import Counter

import duckdb
import pytest

from tidewire.llm import entry, htmltext

SF = "/root/testdata/sf0.001"


def cost(found, labelling):
    total = sum(max(0, b.score) if not keep else max(0, -b.score) for b, keep in zip(found, labelling))
    return total + sum(w for a, b, w in htmltext.smoothness(found) if labelling[a] != labelling[b])


@pytest.mark.parametrize("seed", range(40))
def test_labelling_has_least_cost(seed):
    rng = random.Random(seed)
    found = []
    for _ in range(rng.randint(0, 9)):
        path = tuple(itertools.accumulate([rng.randint(0, 2) for _ in range(rng.randint(1, 4))]))
        block = htmltext.Block("x", 0, "p", path)
        block.score = rng.uniform(-1.5, 1.5)
        found.append(block)
    best = min(cost(found, c) for c in itertools.product((True, False), repeat=len(found)))
    assert cost(found, htmltext.labels(found)) == pytest.approx(best)


def test_doubtful_blocks_follow_their_surroundings():
    path = (1, 2)
    made = [htmltext.Block("x", 0, "p", path, s) for s in (3.0, -0.2, 3.0, -5.0, 0.2, -5.0)]
    assert htmltext.labels(made) == [True, True, True, False, False, False]


ARTICLE = "<article><h1>Title</h1><p>First &amp; <b>bold</b>\n line.<br>More.</p><p>And ornd.<p>All rights reserved.</article>"
WANTED = "Title\nFirst & bold line. More.\nAnd ornd.\nAll rights reserved."
PARTS = [
    "<nav><ul><li><a href='/a'>Home page</a></li></ul></nav>",
    "<header><h2>The site of all sites.</h2></header>",
    "<div class='ad'>Buy this product now. It is really great value for you.</div>",
    "<aside><p>A sidebar with a long sentence. And one more sentence that is here.</p></aside>",
    "<div id='cookie-notice'><p>We use cookies on this page. Please accept all of them now.</p></div>",
    "<form><label>Name</label><p>Please fill in this form with care. Thanks.</p><button>Send</button></form>",
    "<div class='comments'><p>I liked this article very much. It was great to read it.</p></div>",
    "<script>var t = '</p><p>no text</p>';</script>",
    "<style>p { color: red }</style>",
    "<!-- <p>hidden words. many of them.</p> -->",
    "<footer>&copy; 2024 Some Company. All rights reserved.</footer>",
    "<div style='display: none'><p>Nobody sees this paragraph. It is hidden.</p></div>",
]


@pytest.mark.parametrize("part", PARTS)
def test_other_parts_are_left_out(part):
    assert htmltext.main_text(f"<html><head><title>T</title></head><body>{part}{ARTICLE}{part}</body></html>") == WANTED
    assert htmltext.main_text(f"<body>{ARTICLE.replace('<p>And', part + '<p>And')}") == WANTED


def test_page_without_article_element():
    page = "<body><div class='menu'><a href=/>Home</a> <a href=/x>News</a></div><div><p>This is the story, and it has words.</p><p>It goes on for a while; see.</p></div><div class='footer'>Imprint</div></body>"
    assert htmltext.main_text(page) == "This is the story, and it has words.\nIt goes on for a while; see."


def test_whole_table(spark):
    def wanted(page):
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        return "\n".join(p for p in parts if p)

    rows = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    got = Counter(map(tuple, entry.op9_html_main_text(spark, SF).collect()))
    assert got == Counter((i, u, wanted(h), len(wanted(h))) for i, u, h in rows)


def test_odd_rows(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "</div></p>plain & text < 5 > 3"), (3, "u", "</div></p>plain & text < 5 > 3"), (4, "u", "<div>" * 3000 + "deep text here, a sentence." + "</div>" * 10), (5, "u", "<article>" + "<p>word here.</p>" * 20_000 + "</article>"), (6, "u", "<!-- never closed <p>x"), (7, "u", "<script>never closed")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert htmltext.extract(df).count() == len(pages)
    assert got[1].text == got[2].text == got[6].text == got[7].text == "" and got[5].text.count("\n") == 19_999
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract(df.limit(0)).count() == 0
