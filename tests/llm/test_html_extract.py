import html as entities

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.html_extract import extraction_report, main_text

P = ["First one, with some commas, and of a fair length for a paragraph.", "Second.", "Third & last <one>, “quoted”."]


def body(paras, tag="p"):
    return "".join(f"<{tag}>{entities.escape(x)}</{tag}>" for x in paras)


CHROME = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><!-- a > b -->'
    '<header class="top"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>'
    '<div class="cookie-notice">We use cookies, many, many, many cookies, and more of them, really.</div><div class="ad">Buy, buy, buy now, it is cheap, very cheap.</div>'
)
TAIL = '<aside class="sidebar">Popular, posts, here.</aside><form>Name, mail, <input name=x></form><section id="comments"><p>Nice, nice article, I like it, thanks a lot, a lot, a lot.</p></section><footer>&copy; site</footer></body></html>'


@pytest.mark.parametrize("wrap", ["<article><h1>Head</h1>{}</article>", "<main><h1>Head</h1>{}</main>", "<div id=content><h1>Head</h1>{}</div>", "<div><div class=post><h1>Head</h1><div>{}</div></div></div>", "<main><article><header><h1>Head</h1></header><div class=body>{}</div></article></main>"])
def test_layouts(wrap):
    assert main_text(CHROME + wrap.format(body(P)) + TAIL) == "\n".join(["Head", *P])


def test_unclosed_and_nested_markup():
    page = CHROME + "<article><h1>A &amp; B</h1><p><b>Bold<br><p>one\n two&nbsp;<i>three</i><p>four <a href='x>y'>five</a> six, seven<ul><li>i<li>j</ul><table><tr><td>c<td>d</table></article>" + TAIL
    assert main_text(page) == "A & B\nBold\none two three\nfour five six, seven\ni\nj\nc\nd"


def test_parts_inside_the_article_go():
    inner = "<div class='share'><a href=a>Tweet</a></div><div class=advert>Ad, ad.</div><script>x</script><noscript>n</noscript><form><p>f</p></form><aside>s</aside><div class='comments'><p>c, c, c</p></div>"
    assert main_text(CHROME + f"<article>{body(P[:1])}{inner}{body(P[1:])}</article>" + TAIL) == "\n".join(P)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("   ") == ""
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<p>a &lt;b&gt; &#233; &copy <p>2 < 3") == "a <b> é ©\n2 < 3"
    assert main_text("<div><p>" * 3000 + "deep") == "deep"
    long = "word, " * 200_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


@given(st.text(alphabet="<>/!-\"'= abpdivul&;#\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_never_fails(page):
    assert isinstance(main_text(page), str)


def test_tables(spark):
    rows = [(1, "u1", CHROME + "<article>" + body(P) + "</article>" + TAIL, "x"), (2, None, None, "y"), (None, "u3", "", None), (2, None, None, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extraction_report(df).collect()), key=str)
    text = "\n".join(P)
    assert got == sorted([(1, "u1", text, len(text)), (2, None, "", 0), (None, "u3", "", 0), (2, None, "", 0)], key=str)
    assert extraction_report(df.limit(0)).count() == 0
