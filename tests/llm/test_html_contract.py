import html as entities
import random
import time

import pytest

from corpusmill.llm.html_extract import main_text

LONG = "A paragraph, of some length, with commas, and with words enough to count as prose of the page, as it is."
ART = "<body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>" + LONG + "</p>{}<p>" + LONG + "</p></article><footer>f</footer></body>"


def middle(inner):
    lines = main_text(ART.format(inner)).split("\n")
    assert lines[:2] == ["Head", LONG] and lines[-1] == LONG
    return lines[2:-1]


@pytest.mark.parametrize("gone", ["<script>x < y</script>", "<svg><title>t</title><text>x</text></svg>", "<button><div>b</div></button>", "<video><p>no video</p></video>", "<noscript><p>n</p></noscript>", "<style>p{}</style>", "<select><option>a<option>b</select>", "<textarea>t</textarea>", "<canvas>c</canvas>", "<input value=v>", "<!-- c -->"])
def test_removed_elements_do_not_split_blocks(gone):
    assert middle(f"<p>one {gone} two</p>") == ["one two"]
    assert middle(f"<p>one{gone}two <b>three</b></p>") == ["onetwo three"]


@pytest.mark.parametrize("junk", ['<span style="display:none">x</span>', '<span class="ad">x</span>', '<a class="share" href=s>x</a>', "<span hidden>x</span>", '<b aria-hidden="true">x</b>', '<a class="share-button" href=s><b>x</b></a>'])
def test_junk_in_line_goes(junk):
    assert middle(f"<p>one {junk} two</p>") == ["one two"]


@pytest.mark.parametrize(
    ("kept", "lines"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>", ["so x=1 holds"]),
        ('<div class="related-work"><p>Others did it.</p></div>', ["Others did it."]),
        ('<section id="search-algorithm"><h2>Search</h2><p>It looks.</p></section>', ["Search", "It looks."]),
        ('<div class="share-price">Price: 3</div>', ["Price: 3"]),
        ('<h2 id="comments-on-theory">Comments on theory</h2>', ["Comments on theory"]),
        ('<h2 id="comments">Comments</h2>', ["Comments"]),
        ('<pre><code>x = 1 <span class="comment"># so</span></code></pre>', ["x = 1 # so"]),
        ("<ol><li><a href=/1>Source one, of 1990</a></li><li><a href=/2>Source two</a></li></ol>", ["Source one, of 1990", "Source two"]),
        ("<blockquote><p>Said.</p><footer>A. Name</footer></blockquote>", ["Said.", "A. Name"]),
        ('<section id="notice"><p>' + LONG + " " + LONG + " " + LONG + "</p></section>", [" ".join([LONG] * 3)]),
    ],
)
def test_content_with_unlucky_names_stays(kept, lines):
    assert middle(kept) == lines


@pytest.mark.parametrize("gone", ["<div class='share'><a href=a>Tweet</a></div>", "<div class='advert'>Ad, ad.</div>", "<div class='cookie-notice'><p>We use them.</p></div>", "<section id='comments'><p>Nice.</p></section>", "<p class='advertisement'>Buy.</p>", "<div class='social share-buttons'>Go</div>", "<div class='related-posts'><a href=1>One</a></div>", "<aside>s</aside>", "<div class='widget'><form><p>f</p></form></div>"])
def test_named_junk_goes(gone):
    assert middle(gone) == []


def test_long_comments_at_the_end_go():
    page = f"<body><main><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><section class='comments'><p>{LONG} a</p><p>{LONG} b</p></section></main></body>"
    assert main_text(page) == "\n".join([LONG] * 3)
    page = f"<body><div class=story><p>{LONG}</p><p>{LONG}</p></div><div class=comment><p>{LONG} {LONG} {LONG}</p></div></body>"
    assert main_text(page) == "\n".join([LONG] * 2)


WORDS = "alpha beta, gamma & delta < epsilon > zeta é ü “x” it's".split(" ")


def made(r):
    """A page and its main text, known by construction."""
    lines = []

    def words():
        return [r.choice(WORDS) for _ in range(r.randint(1, 25))]

    def line(w):
        out = []
        for x in w:
            x = entities.escape(x)
            k = r.random()
            out.append(f"<b>{x}</b>" if k < 0.1 else f'<a href="/x?a=1&b=\'>">{x}</a>' if k < 0.15 else f"<i><em>{x}</em></i>" if k < 0.2 else x)
            if r.random() < 0.1:
                out.append(r.choice(["<script>if (a<b) {}</script>", "<span style='display: none'>gone</span>", "<svg><path d='M0'/><text>gone</text></svg>", "<!-- <p>gone</p> -->", "<button><p>gone</p></button>"]))
        return r.choice([" ", "\n  ", "&nbsp;", " <br> "]).join(out)

    def part(depth):
        k = r.random()
        if depth < 4 and k < 0.3:
            tag = r.choice(["div", "section", "blockquote", "div class=body", 'div id="market-share"'])
            return f"<{tag}>" + "".join(part(depth + 1) for _ in range(r.randint(1, 4))) + f"</{tag.split()[0]}>"
        if k < 0.4:
            return r.choice(["<nav><ul><li><a href=1>gone</a></ul></nav>", "<aside><p>gone</p></aside>", "<form><p>gone <input></p></form>", "<div class='ad'>gone</div>", "<ul class='share'><li><a href=2>gone</a></ul>"])
        tag = r.choice(["p", "p", "p", "h2", "li", "pre"])
        w = words()
        lines.append(" ".join(w))
        inner = line(w)
        return f"<ul><li>{inner}</ul>" if tag == "li" else f"<p>{inner}" + r.choice(["", "</p>"]) if tag == "p" else f"<{tag}>{inner}</{tag}>"

    inner = "".join(part(0) for _ in range(r.randint(3, 12)))
    lines.insert(0, " ".join([LONG] * 3))
    wrap = r.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>"])
    chrome = "<header><a href=/>Site</a></header><nav><a href=/a>gone</a></nav><div class=cookie-notice>gone, gone</div>"
    return f"<html><head><title>gone</title></head><body>{chrome}" + wrap.format(f"<p>{LONG} {LONG} {LONG}</p>{inner}") + "<div id=comments><p>gone, gone</p></div><footer>gone</footer></body></html>", "\n".join(lines)


@pytest.mark.parametrize("seed", range(200))
def test_pages_by_construction(seed):
    page, text = made(random.Random(seed))
    assert main_text(page) == text


N = 200_000


@pytest.mark.parametrize("page", ["<div>" * N + "deep", "<a x='" * N, "<a x='" * (N + 1) + ">", "<a x='>'" * N, "<p><div>" * N, "<" * N, "<!" * N, "<b>" * N + "</i>" * N, "<article>x" * N, "<div class=ad>" * N + "x", "<a<a" * N + ">"])
def test_hostile_pages_take_linear_time(page):
    t = time.process_time()
    main_text(page)
    assert time.process_time() - t < 5
