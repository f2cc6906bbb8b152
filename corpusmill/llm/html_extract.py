"""Main text of HTML pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, less
with every level; a container's points are discounted by the share of its text
that lies in links. The best container, grown to the article it lies in, and
those siblings that carry text too are kept. What the markup itself says is no
text (scripts, forms, navigation, hidden parts) goes at once; an element that is
only named like an advert or a menu goes when its length, links, place or
contents say the same.

One pass over the markup and a few over its tree, each linear in the page.
"""

from __future__ import annotations

import bisect
import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extend

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag ends an open element of these, up to the given bounds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Removed with all that is in them: those that stand in a line of text, and those that end one.
DROP_IN_LINE = frozenset("script style noscript template iframe object embed svg canvas audio video map button select textarea input datalist annotation annotation-xml noembed noframes".split())
DROP = DROP_IN_LINE | frozenset("head nav aside footer form dialog menu title search".split())
CONTROLS = frozenset("input button select textarea form".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names of what is no article, alone or with each other and with FILL: clear ones, and those that want more evidence.
CLEAR = frozenset("ad ads comment advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted sidebar sidenav navbar submenu topnav breadcrumb breadcrumbs comments commentlist disqus replies cookie cookies gdpr consent newsletter subscribe share sharing masthead pagination pager".split())
LIKELY = frozenset(
    "banner aside menu nav navigation footer topbar toolbar reply respond notice notices notification alert popup modal overlay subscription signup login signin social related recommended recommendations widget skip search hidden copyright header teaser".split()
)
FILL = frozenset("a an the box bar list item items block area wrapper wrap container inner outer content section panel region group row col column left right top bottom main site page global primary secondary js id btn button buttons link links icon icons posts articles stories post article entry message msg slot unit div form zone fixed sticky more you may like us this on by for and to of follow feed text small large no".split())
#: Words of names under which readers talk, alone or with any others: clear ones, and those that articles use too.
TALK = frozenset("comment comments commentlist commenter disqus replies reply".split())
MAYBE_TALK = frozenset("discussion discussions response responses feedback conversation thread reviews".split())
#: Words of names of what tells who wrote an item, and when.
BYLINE = frozenset("author byline user username commenter avatar date time timestamp ago posted meta reply vote votes likes".split())
KEEP = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li td pre blockquote dd dt figcaption".split())

#: Characters up to which a part that is named like no article counts as short; share of links that counts as dense.
SHORT, DENSE = 250, 0.3

_NAME_AT = re.compile(r"[a-zA-Z][a-zA-Z0-9:_-]{0,40}")
_TELLS = re.compile(r"class|id|role|hidden|style", re.I)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Finder:
    """First places of a character at or after ever later places, each part of the page searched once."""

    def __init__(self, page: str, char: str):
        self.page, self.char, self.asked, self.at = page, char, 0, page.find(char)

    def __call__(self, pos: int) -> int:
        """The place, or the page's length where there is none."""
        if self.at < 0 and pos >= self.asked:
            return len(self.page)
        if not self.asked <= pos <= self.at:
            self.asked, self.at = pos, self.page.find(self.char, pos)
        return len(self.page) if self.at < 0 else self.at


class _Tree:
    """Elements in page order (a parent before its children), and the blocks of text that lie in them."""

    def __init__(self) -> None:
        self.tag, self.up, self.owner = ["#root"], [-1], [0]
        self.junk, self.named = [False], [0]
        self.controls = [False]
        #: Whether readers may talk there (2: clearly), and whether it tells who wrote and when.
        self.talk, self.byline = [0], [False]
        #: Per block its element and its pieces: element, text, whether it lies in a link.
        self.blocks: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}  # of open elements, by tag
        self.dead = self.dead_from = 0  # open elements that are removed, and the depth of the first
        self.links = self.keeps = 0
        self.pieces: list[tuple[int, str, bool]] = []

    def flush(self) -> None:
        if self.pieces and not self.dead:
            self.blocks.append((self.owner[self.pieces[0][0]], self.pieces))
            self.pieces = []

    def text(self, s: str) -> None:
        if not self.dead:
            self.pieces.append((self.stack[-1], s, self.links > 0))

    def space(self) -> None:
        if self.pieces and not self.dead:
            self.pieces.append((self.stack[-1], " ", False))

    def open(self, tag: str, attrs: str) -> None:
        e, up = len(self.tag), self.stack[-1]
        hard, named = _judged(tag, attrs, self.keeps > 0, self.tag[up])
        talk, byline = _told(attrs) if attrs and tag not in HEADINGS and _TELLS.search(attrs) else (0, False)
        self.talk.append(talk)
        self.byline.append(byline or tag == "time")
        self.tag.append(tag)
        self.up.append(up)
        self.owner.append(self.owner[up] if tag in INLINE or tag in MATH else e)
        self.junk.append(hard)
        self.named.append(named)
        self.controls.append(tag in CONTROLS)
        self.depths.setdefault(tag, []).append(len(self.stack))
        if hard and not self.dead:
            self.dead_from = len(self.stack)
        self.stack.append(e)
        self.dead += hard
        self.links += tag == "a"
        self.keeps += tag in KEEP

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            tag = self.tag[e]
            self.depths[tag].pop()
            self.dead -= self.junk[e]
            self.dead_from = self.dead_from if self.dead else 0
            self.links -= tag == "a"
            self.keeps -= tag in KEEP

    def last(self, *tags: str) -> int:
        """Depth of the innermost open element of ``tags``, 0 for none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def find(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> int:
        """Depth of the outermost open element of ``tags`` inside the innermost of ``bounds``, 0 for none."""
        bound = self.last(*bounds)
        found = []
        for t in tags:
            d = self.depths.get(t, ())
            if (i := bisect.bisect_right(d, bound)) < len(d):
                found.append(d[i])
        return min(found, default=0)


def _votes(name: str) -> int:
    """How much a class or an id speaks against its element: 2 if clearly, 1 if likely."""
    words = [x.lower() for x in _WORD.findall(name)]
    if not words or not all(w in CLEAR or w in LIKELY or w in FILL for w in words):
        return 0  # has words of its own, such as share-price or related-work
    return 2 if any(w in CLEAR for w in words) else 1 if any(w in LIKELY for w in words) else 0


def _told(attrs: str) -> tuple[int, bool]:
    """How much the names of an element say that readers talk in it, and whether they are those of a byline."""
    words = {x.lower() for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id") for x in _WORD.findall(entities.unescape(m[2] or ""))}
    return 2 if words & TALK else 1 if words & MAYBE_TALK else 0, bool(words & BYLINE)


def _talked(t: _Tree, junk: list[bool], holds: list[bool], controls: list[bool], chars: list[int], last: list[int], around: list[int], code: list[bool]) -> list[bool]:
    """Elements in which readers talk: named so, and made so.

    Clear names want one sign more: an end of the article, a form, or items with
    bylines. Names that articles use too want several such items, or one and a
    form. What has most of the text is no comment.
    """
    size = len(t.tag)
    by, items = list(t.byline), [0] * size
    for e in range(size - 1, 0, -1):
        by[t.up[e]] |= by[e]
        items[t.up[e]] += by[e] and t.tag[e] not in INLINE and chars[e] > 0
    out = [False] * size
    for e in range(1, size):
        if not t.talk[e] or junk[e] or holds[e] or code[e] or t.tag[e] in KEEP or t.tag[e] in INLINE or 2 * chars[e] > chars[around[e]]:
            continue
        end = last[e] >= 0 and last[e] == last[around[e]]
        out[e] = end or controls[e] or items[e] > 0 if t.talk[e] == 2 else items[e] > 1 or items[e] > 0 and controls[e]
    return out


def _judged(tag: str, attrs: str, in_article: bool, parent: str) -> tuple[bool, int]:
    """Whether an element is removed by what it is, and how much its names speak against it."""
    if tag in DROP and not (tag == "footer" and parent == "blockquote") or (tag == "header" and not in_article):
        return True, 0
    if not attrs or tag in ("html", "body") or not _TELLS.search(attrs):
        return False, 0
    votes = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role" and value.lower() in DROP_ROLES and not (in_article and value.lower() == "banner"):
            return True, 0
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" and tag not in MATH or name == "style" and _HIDE.search(value):
            return True, 0
        if name == "class" or name == "id" and tag not in HEADINGS:  # a heading's id repeats its words
            votes = max([votes, *(_votes(x) for x in entities.unescape(value).split())])
    if tag in KEEP:
        return False, 0 if tag == "main" else votes
    return False, votes


def _parse(page: str) -> _Tree:
    t = _Tree()
    pos, n = 0, len(page)
    less, more, quote, apostrophe = (_Finder(page, c) for c in "<>\"'")
    quoted = True

    def tag_end(at: int) -> int:
        """The place of the ``>`` that ends a tag, outside of quoted values.

        A quote that never ends is none; once quotes would swallow all the rest
        of the page, they aren't heeded any more.
        """
        nonlocal quoted
        plain = end = more(at)
        begin = at
        while quoted and plain < n and (q := min(quote(at), apostrophe(at))) < end:
            j = q - 1
            while j > begin and q - j < 64 and page[j].isspace():
                j -= 1
            at = q + 1
            if page[j] == "=":
                close = (quote if page[q] == '"' else apostrophe)(at)
                if close < n:
                    at = close + 1
                    end = more(at)
                    if end >= n:
                        quoted, end = False, plain
        return end

    while pos < n:
        at = less(pos)
        if at > pos:
            t.text(page[pos:at])
        if at >= n:
            break
        pos = at
        if page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", pos):
            end = page.find("]]>", pos)
            t.text(entities.escape(page[pos + 9 : n if end < 0 else end]))
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), pos):
            pos = more(pos) + 1
            continue
        closing = page.startswith("</", pos)
        m = _NAME_AT.match(page, pos + 1 + closing)
        end = tag_end(m.end()) if m and not closing else more(m.end()) if m else n
        if m is None or end >= n:  # a bare sign, or a tag without an end
            t.text("&lt;" if m is None else page[pos])
            pos += 1
            continue
        tag, attrs, pos = m[0].lower(), page[m.end() : end], end + 1
        if closing:
            _close(t, tag)
            continue
        if tag == "br":
            t.space()
            continue
        in_line = tag in INLINE or tag in MATH or tag in DROP_IN_LINE
        if not in_line:
            t.flush()
        if tag in CLOSES_P and (d := t.find(("p",), ("table", "td", "th", "button", "object"))) > t.dead_from:
            t.close_to(d)
        elif tag in ENDS and (d := t.find(*ENDS[tag])) > t.dead_from:
            t.close_to(d)
        if tag in ("a", "body", "html") and (d := t.find((tag,), ("td", "th", "table"))):
            if tag != "a":
                continue
            t.close_to(d)
        if tag in VOID:
            if tag in CONTROLS:
                t.controls[t.stack[-1]] = True
            continue
        t.open(tag, attrs)
        if tag in RAW:
            pos = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, pos).end()
            t.close_to(len(t.stack) - 1)
        elif attrs.endswith("/") and t.dead:  # as in drawings
            t.close_to(len(t.stack) - 1)
    t.close_to(1)
    t.flush()
    return t


def _close(t: _Tree, tag: str) -> None:
    in_line = tag in INLINE or tag in MATH or tag in DROP_IN_LINE
    if not in_line:
        t.flush()
    depth = t.last(tag)
    if tag == "p" and depth < t.dead_from:
        return
    if tag == "br" or tag == "p" and not depth:
        t.space()
    elif depth and not (tag in INLINE and t.last("td", "th", "table", "article", "main", "body", "section") > depth):
        t.close_to(depth)


def _joined(pieces: list[tuple[int, str, bool]], junk: list[bool]) -> tuple[str, int]:
    """The text of a block, and how much of it lies in links."""
    left = [p for p in pieces if not junk[p[0]]]
    text = " ".join(entities.unescape("".join(p[1] for p in left)).split())
    links = [p[1] for p in left if p[2]]
    linked = len(" ".join(entities.unescape(" ".join(links)).split())) if links else 0
    return text, min(linked, len(text))


def _counted(t: _Tree, junk: list[bool]) -> tuple[list[tuple[int, str, int]], list[int], list[int]]:
    """Blocks that have text (element, text, characters in links), and both numbers summed by element."""
    size = len(t.tag)
    chars, linked = [0] * size, [0] * size
    blocks = []
    for e, pieces in t.blocks:
        text, in_links = _joined(pieces, junk) if not junk[e] else ("", 0)
        blocks.append((e, text, in_links))
        chars[e] += len(text)
        linked[e] += in_links
    for e in range(size - 1, 0, -1):
        chars[t.up[e]] += chars[e]
        linked[t.up[e]] += linked[e]
    return blocks, chars, linked


def _removed(t: _Tree) -> list[bool]:
    """Which elements are no text: by what they are, or by their names together with what else tells."""
    size = len(t.tag)
    holds, controls = [False] * size, list(t.controls)  # an article below
    for e in range(size - 1, 0, -1):
        holds[t.up[e]] |= holds[e] or t.tag[e] in KEEP and not t.junk[e] and t.named[e] < 2
        controls[t.up[e]] |= controls[e]
    junk = [False] * size
    for e in range(1, size):
        junk[e] = junk[t.up[e]] or t.junk[e] and not (holds[e] and t.tag[e] in ("form", "div", "section"))
    if not any(t.named) and not any(t.talk):
        return junk
    blocks, chars, linked = _counted(t, junk)
    none = len(blocks)
    first, last = [none] * size, [-1] * size
    for i, (e, text, _) in enumerate(blocks):
        if text:
            first[e], last[e] = min(first[e], i), max(last[e], i)
    for e in range(size - 1, 0, -1):
        first[t.up[e]] = min(first[t.up[e]], first[e])
        last[t.up[e]] = max(last[t.up[e]], last[e])
    around = [0] * size  # the article that an element lies in, or the root
    code = [False] * size
    pieces_of: dict[int, int] = {}
    for _, pieces in t.blocks:
        for e, text, _ in pieces:
            pieces_of[e] = pieces_of.get(e, 0) + len(text)
    for e in range(1, size):
        up = t.up[e]
        around[e] = up if t.tag[up] in KEEP else around[up]
        code[e] = code[up] or t.tag[e] in ("pre", "code")
    talked = _talked(t, junk, holds, controls, chars, last, around, code) if any(t.talk) else junk
    for e in range(1, size):
        up = t.up[e]
        if junk[up] or junk[e] or talked[e]:
            junk[e] = True
            continue
        votes, tag, whole = t.named[e], t.tag[e], chars[around[e]]
        if not votes or holds[e] or tag == "body":
            continue
        if tag in INLINE:
            junk[e] = votes == 2 and not code[e]
            continue
        short, dense = chars[e] < SHORT, linked[e] > DENSE * chars[e]
        edge = around[e] == 0 or first[e] == first[around[e]] or last[e] == last[around[e]]
        if votes == 1 and 2 * chars[e] > whole and chars[e] >= SHORT and tag not in ("aside", "ul", "ol"):
            continue  # most of the text is no notice
        junk[e] = votes + (short or dense or controls[e] or edge) >= 2
    return junk


def _choose(t: _Tree, junk: list[bool], blocks: list[tuple[int, str, int]], chars: list[int], linked: list[int]) -> list[bool]:
    """Which elements' blocks make up the main text."""
    size = len(t.tag)
    points = [0.0] * size
    for e, text, in_links in blocks:
        if not text:
            continue
        worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - in_links / len(text))
        a, level = t.up[e] if t.tag[e] in LEAVES else e, 0
        while a > 0 and level < 5:
            points[a] += worth / (1 if level == 0 else 2 * level)
            a, level = t.up[a], level + 1
    if not chars[0]:
        return [False] * size
    density = [x / max(c, 1) for x, c in zip(linked, chars, strict=True)]
    weight = {"article": 2.0, "main": 1.5}
    score = [p * weight.get(tag, 1.0) * (1 - d) + (c > 0 and tag in weight) if tag not in INLINE and not j else -1.0 for p, tag, c, d, j in zip(points, t.tag, chars, density, junk, strict=True)]
    best = max(range(1, size), key=lambda e: (score[e], chars[e], -e)) if size > 1 else 0
    a, inside = best, None
    while a > 0:  # the article that it lies in
        if t.tag[a] in KEEP and (inside is None or t.tag[a] == "article"):
            inside = a
        a = t.up[a]
    within = [0.0] * size  # the best score of an article in it
    if inside is None:
        top, up = best, t.up[best]
        while up > 0 and t.tag[up] not in ("body", "html") and chars[up] - chars[best] <= 0.25 * chars[best]:
            top, up = up, t.up[up]  # wrappers that add little, such as a headline
        tops = [top]
    else:
        around = _above(t, t.up[inside])
        main = next((i for i, a in enumerate(around) if t.tag[a] in KEEP), 0)
        tops = [inside, *around[:main]]  # with the wrappers between an article and its main
        for e in range(size - 1, 0, -1):  # wrappers count as what the best article in them does
            if t.tag[e] in KEEP and not junk[e]:
                within[e] = max(within[e], score[e])
            within[t.up[e]] = max(within[t.up[e]], within[e])
    chosen, beside = {tops[0]}, {t.up[top] for top in tops}
    mine = set(tops)
    least = max(2.0, 0.2 * score[tops[0]])
    for e in range(1, size):
        if t.up[e] in beside and e not in mine and not junk[e] and chars[e] and t.tag[e] not in INLINE:
            heading = t.tag[e] in HEADINGS and not linked[e]
            prose = t.tag[e] in ("p", "pre", "blockquote", "ul", "ol", "table", "figure") and density[e] < 0.25
            if heading or prose or (max(score[e], within[e]) >= least and density[e] < 0.25):
                chosen.add(e)
    # an article's lists of links are menus only before its first words that are none
    root, lead = [-1] * size, {}
    for e in range(size):
        root[e] = e if e in chosen else root[t.up[e]] if e else -1
    for e, text, in_links in blocks:
        if text and 2 * in_links < len(text) and root[e] not in lead:
            lead[root[e]] = {e, *_above(t, e)}
    first = {r: max(x) for r, x in lead.items()}
    kept = [False] * size
    for e in range(size):
        if e in chosen:
            kept[e] = True
        elif e:
            menu = t.tag[e] in ("ul", "ol", "dl", "div", "section", "table") and linked[e] and density[e] > 0.6
            if menu and inside is not None and root[e] in lead:
                menu = e < first[root[e]] and e not in lead[root[e]]
            kept[e] = kept[t.up[e]] and not junk[e] and not menu
    return kept


def _above(t: _Tree, e: int) -> list[int]:
    """The elements around ``e`` and itself, from within."""
    out = []
    while e > 0:
        out.append(e)
        e = t.up[e]
    return out


def main_text(page: str | None) -> str:
    """The blocks of the main content of one page, joined by line feeds; empty if there are none."""
    if not page:
        return ""
    t = _parse(page)
    junk = _removed(t)
    blocks, chars, linked = _counted(t, junk)
    kept = _choose(t, junk, blocks, chars, linked)
    return "\n".join(text for e, text, _ in blocks if text and kept[e])


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` without ``html`` and with the main text instead, as ``into``.

    A page is parsed by itself, as a whole, where it lies, in time linear in its
    length. Null and empty pages give an empty text; broken markup is read as
    browsers do, as far as blocks go. Of containers with equal points the one
    with more text counts, then the first. Other columns pass as they are, nulls
    too; one named ``into`` is an error. Repeated rows stay. An empty table
    gives an empty result.
    """
    import pyarrow as pa

    keep = [c for c in pages.columns if c != html]
    return extend(pages, lambda texts: [pa.array([main_text(x.decode("utf-8", "replace") if x else "") for x in texts], pa.string())], [(into, "string")], html, keep)


def extraction_report(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``; rows as in :func:`extract_main_text`, further columns are ignored."""
    out = extract_main_text(pages.select("page_id", "url", "html"), into="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
