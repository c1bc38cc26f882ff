"""Main text of pages whose wrappers bear words of other parts, or are one form."""

import pytest

from tests.llm.test_htmltext import ARTICLE, PARTS, WANTED
from tidewire.llm import htmltext

STORY = "<h1>Title</h1><p>This is the story, and it has words.</p><p>It goes on for a while; see.</p>"
TOLD = "Title\nThis is the story, and it has words.\nIt goes on for a while; see."
WRAPPERS = [
    ("<body class='has-sidebar'>", "</body>"),
    ("<body class='no-comments cookie-accepted menu-closed'>", "</body>"),
    ("<html class='fixed-header'><body id='page-footer-visible'>", "</body></html>"),
    ("<body><form id='aspnetForm' action='/'>", "</form></body>"),
    ("<body><div id='page' class='sidebar-left'><div class='modal-closed'>", "</div></div></body>"),
]


@pytest.mark.parametrize(("head", "tail"), WRAPPERS)
@pytest.mark.parametrize("part", PARTS)
def test_wrappers_do_not_take_the_article(head, tail, part):
    assert htmltext.main_text(f"{head}{part}{ARTICLE}{tail}") == WANTED
    assert htmltext.main_text(f"{head}{ARTICLE}{part}{part}{tail}") == WANTED
    main = f"<main class='has-sidebar'>{ARTICLE.replace('<article>', '<article class=' + chr(39) + 'post comments-off' + chr(39) + '>')}</main>"
    assert htmltext.main_text(f"{head}{part}{main}{tail}") == WANTED


@pytest.mark.parametrize(("head", "tail"), WRAPPERS)
def test_wrappers_of_pages_without_article_element(head, tail):
    menu, foot = "<div class='menu'><a href=/>Home</a> <a href=/x>News</a></div>", "<div class='footer'>Imprint</div>"
    assert htmltext.main_text(f"{head}{menu}<div class='content'>{STORY}</div>{foot}{tail}") == TOLD


def test_other_parts_that_hold_articles_stay_out():
    cards = "<div class='related'><article><p>Another story that you may like. It is short.</p></article></div>"
    comments = "<div class='comments'>" + "<article class='comment'><p>I liked this very much. It was great to read all of it.</p></article>" * 9 + "</div>"
    for page in (f"{ARTICLE * 1}{cards}{comments}", f"<main>{STORY}</main>{cards}{comments}"):
        want = WANTED if page.startswith("<article>") else TOLD
        assert htmltext.main_text(f"<body class='has-sidebar'>{page}</body>") == want
