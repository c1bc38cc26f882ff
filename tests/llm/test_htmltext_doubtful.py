"""Pages that name no parts, where the cut decides; names that are subjects; broken tags."""

import pytest

from tidewire.llm import htmltext

FRUIT = "Here is a list of the fruits that grow in the north of the country."
AUTUMN = "They ripen in autumn, when days are short."
LINKS = "<div><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul></div>"
PAGES = [
    (f"<body>{LINKS}<div><h2>Fruit</h2><p>{FRUIT}</p><ul><li>Apples</li><li>Pears</li></ul><p>{AUTUMN}</p></div>{LINKS}</body>", f"Fruit\n{FRUIT}\nApples\nPears\n{AUTUMN}"),
    (f"<body>{LINKS}<div><p>{FRUIT}</p><h3>When</h3><p>{AUTUMN}</p><p>Yes</p><p>{AUTUMN}</p></div></body>", f"{FRUIT}\nWhen\n{AUTUMN}\nYes\n{AUTUMN}"),
    (f"<body><div><p>{FRUIT}</p><p>{AUTUMN}</p></div><div><ul><li><a href=/1>One</a></li><li>Two.</li><li><a href=/3>Three</a></li><li><a href=/4>Four</a></li></ul></div></body>", f"{FRUIT}\n{AUTUMN}"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_the_cut_decides_doubtful_blocks(page, want):
    found = htmltext.blocks(page)
    alone = [b.score >= 0 for b in found]
    assert htmltext.labels(found) != alone
    assert htmltext.main_text(page) == want
    assert "\n".join(b.text for b, keep in zip(found, alone) if keep) != want


@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="social-history">Social history</h2>',
        '<h2 id="search-methods">Search methods</h2>',
        '<p id="legal">The legal side of it.</p>',
        '<section id="comment-on-law"><p>A word on law.</p></section>',
        '<section id="related"><p>What is related to it.</p></section>',
    ],
)
def test_subjects_named_like_other_parts_stay(part):
    text = htmltext.blocks(part)[0].text
    assert htmltext.main_text(f"<body><article><p>{FRUIT}</p>{part}<p>{AUTUMN}</p></article></body>") == f"{FRUIT}\n{text}\n{AUTUMN}"


def test_an_article_is_not_what_its_class_names():
    assert htmltext.main_text(f'<article class="legal"><p>{FRUIT}</p></article>') == FRUIT


@pytest.mark.parametrize("part", ['<div class="comments-area"><p>I like it a lot, thanks for it.</p></div>', '<section id="comments"><p>Me too, it was great to read.</p></section>', '<div class="share-buttons">Share this now.</div>', '<ul class="nav-list"><li>Next page of it.</li></ul>', '<div class="site-footer"><p>Made by us in the year of our Lord.</p></div>'])
def test_compound_names_of_other_parts_go(part):
    assert htmltext.main_text(f"<article><p>{FRUIT}</p>{part}<p>{AUTUMN}</p></article>") == f"{FRUIT}\n{AUTUMN}"


def test_quotes_that_never_close_are_no_text():
    assert htmltext.main_text('<article><p title="x>broken one.</p><p>Next one.</p></article>') == "broken one.\nNext one."
    assert htmltext.main_text("<article><p>It's <a href='x>a link</a> here.</p></article>") == "It's a link here."


def test_a_title_above_the_article():
    assert htmltext.main_text(f"<header><h1>The title</h1></header><article><p>{FRUIT}</p></article>") == f"The title\n{FRUIT}"
    assert htmltext.main_text(f"<header><h1>The site</h1></header><article><h1>Title</h1><p>{FRUIT}</p></article>") == f"Title\n{FRUIT}"
    assert htmltext.main_text(f"<header><nav><h1>The site</h1></nav></header><article><p>{FRUIT}</p></article>") == FRUIT
