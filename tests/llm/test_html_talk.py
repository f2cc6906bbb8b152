"""Reader comments under names of all kinds go; content under the same names stays."""

import pytest

from corpusmill.llm.html_extract import main_text

LONG = "This is a long sentence of the article, with commas, clauses, and enough words to count as prose."
ITEM = '<div class="{item}"><span class="{by}">Jo, 3 days ago</span><p>I liked this piece, thank you for it, and more.</p></div>'
ITEMS = ITEM.format(item="item", by="author") + ITEM.format(item="item", by="username") + ITEM.format(item="item", by="date")


def page(inner, wrap="<article>{}</article>"):
    return "<html><body>" + wrap.format(f"<h1>Title</h1><p>{LONG}</p>{{}}<p>{LONG}</p><p>{LONG}</p>").replace("{}", inner) + "</body></html>"


def after(inner, wrap="<article>{}</article>"):
    return "<html><body>" + wrap.format(f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{inner}") + "</body></html>"


WANT = "\n".join(["Title", LONG, LONG, LONG])
WRAPS = ["<article>{}</article>", "<main>{}</main>", '<div class="story">{}</div>']


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("name", ['class="user-comments"', 'class="reader-comments-v2"', 'id="commentsBlock7"', 'class="fb-comments-plugin"', 'class="discussion"', 'class="responses"', 'id="feedback"', 'class="post-discussion-thread"', 'class="customer-reviews"'])
def test_talk_goes(name, wrap):
    assert main_text(after(f"<div {name}>{ITEMS}</div>", wrap)) == WANT
    assert main_text(page(f"<div {name}>{ITEMS}</div>", wrap)) == WANT


@pytest.mark.parametrize("inner", ['<div class="comment-body"><p>I liked it, a lot.</p></div>', '<div class="user-comments"><p>Nice, very nice.</p></div>', '<div class="mt-comment-form-x"><p>Say what you think.</p><textarea></textarea></div>'])
def test_single_comments_at_the_end_go(inner):
    assert main_text(after(inner)) == WANT


@pytest.mark.parametrize(
    "inner",
    [
        f'<section class="discussion"><h2>Discussion</h2><p>{LONG}</p></section>',
        f'<div class="response-time"><p>{LONG}</p></div>',
        f'<div class="feedback-loop"><p>{LONG}</p><p>{LONG}</p></div>',
        f'<div id="reviews-of-literature"><p>{LONG}</p></div>',
    ],
)
def test_content_of_such_names_stays(inner):
    for made in (page(inner), after(inner)):
        assert LONG in main_text(made) and main_text(made).count(LONG) == 3 + inner.count(LONG)


def test_most_of_the_text_is_no_comment():
    inner = f'<div class="expert-comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>'
    assert main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{inner}</article></body>").count(LONG) == 4
