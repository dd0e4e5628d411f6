"""Main text of web pages by tree scoring.

A page is read into a tree; menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are cut by element, role, class and
id, or because they are hidden.  A class or id that only contains a telling word
cuts an element that holds little or mostly linked text.  Every paragraph that is left passes points for its length and commas to its
ancestors, less with each level; a container's points are discounted by the share of its
text that stands in links.  The best container (or the article that holds it)
and those of its siblings that hold a paragraph and few links, also further up those that
score well beside it, are kept, with everything in them
but lists of links.

Defined results: a null or empty page, and one without text, gives the empty
text; broken markup is read as far as it goes; each row is extracted on its own, so
repeated rows agree; nesting of any depth and pages of any length are read without
recursion."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"option", "legend", "head", "body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "title"}
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CUT_TAGS = frozenset(
    "nav header footer aside form script style noscript template svg math iframe button select textarea input label menu dialog head title "
    "canvas object embed audio video xmp noembed noframes fieldset".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus reply replies respond notice notices cookie cookies "
    "consent gdpr popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager search skip copyright legal disclaimer alert".split()
)
CUT_ARTICLES = frozenset("comment comments reply ad ads advert advertisement sponsored promo related recommended".split())
#: Words that go with a name above without telling of anything else ("site-footer", "comment-list").
PLACE_WORDS = frozenset(
    "site page top bottom left right main primary secondary global list item items box wrap wrapper container area bar block section inner outer "
    "slot unit link links button buttons icon icons form text content message meta count title body row col column group panel".split()
)
ROOTS = frozenset("html body main".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figcaption".split())
#: Names above that, among other words, still tell of what readers or advertisers add.
ADDED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies respond "
    "cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup login related recommended recommendations".split()
)
POINTLESS = frozenset("li h1 h2 h3 h4 h5 h6 dt th figcaption summary legend option".split())
HEADINGS = frozenset("h1 h2 h3".split())
LISTS = frozenset("ul ol dl div section table p".split())
LEVELS = 5  # ancestors that get points
LEAST_CHARS = 25  # of a paragraph that gives points

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"""
    r"""<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW_ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def _named(value: str, names: frozenset) -> int:
    """3 if one of the names of a class or id says that the element is no text; 1 if
    such a word stands in it among others ("with-sidebar", "share-price"), 2 if that is
    one of ADDED ("user-comments")."""
    got = 0
    for one in value.split():
        parts = [x.lower() for x in NAME_PARTS.findall(one)]
        if any(x in names for x in parts):
            got = max(got, 3 if all(x in names or x in PLACE_WORDS for x in parts) else 2 if any(x in ADDED for x in parts) else 1)
    return got


def _cut(tag: str, rest: str) -> int:
    """3: cut; 1 and 2: cut unless it holds the article."""
    if tag in CUT_TAGS:
        return 3
    if not rest or rest == "/" or tag in ROOTS:
        return 0
    got = 0
    for m in ATTR.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if m.start() and not rest[m.start() - 1].isspace() and rest[m.start() - 1] not in "\"'/":
            continue
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return 3
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 3
        if key == "role" and value.lower() in CUT_ROLES:
            return 3
        if key in ("class", "id"):
            got = max(got, _named(value, CUT_ARTICLES if tag == "article" else CUT_NAMES))
    return got


class _Page:
    """Nodes in page order, each with its parent, last descendant and tag, and the
    text pieces with the node that holds them; what is cut leaves no pieces."""

    def __init__(self, page: str):
        self.hint = [0]  # a telling word among others in its name: 1, or 2 if of ADDED
        self.open = Counter()  # open elements by tag
        self.tag, self.parent, self.last = [""], [-1], [0]
        self.block, self.link, self.cut = [0], [False], [False]  # nearest block node; within a link; within a cut element
        self.pieces: list[tuple[int, str]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, at = [0], 0
        for m in TAG.finditer(page):
            if m.start() < at:  # inside an element without markup
                continue
            if m.start() > at:
                self._text(stack[-1], page[at : m.start()])
            at = m.end()
            if m["name"] is None:
                if m[0].startswith("<![CDATA["):
                    self._text(stack[-1], m[0][9:].removesuffix("]]>"), False)
                continue
            name, rest = m["name"].lower(), m["rest"]
            if m["end"]:
                self._close(stack, name)
                continue
            if name in CLOSES_P:
                self._close_p(stack)
            if name in RAW:  # no markup up to its end tag
                stop = RAW_ENDS[name].search(page, at)
                close = page.find(">", stop.end()) if stop else -1
                at = len(page) if close < 0 else close + 1
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.pieces.append((stack[-1], " "))
                continue
            self._close_peer(stack, name)
            n, up = len(self.tag), stack[-1]
            self.tag.append(name)
            self.parent.append(up)
            self.last.append(n)
            self.block.append(n if name in BLOCKS else self.block[up])
            self.link.append(name == "a" or self.link[up])
            cut = 3 if self.cut[up] else _cut(name, rest)
            self.cut.append(cut == 3)
            self.hint.append(cut % 3)
            self.open[name] += 1
            if name in BLOCKS:
                self.pieces.append((up, " "))
            stack.append(n)
            if rest.endswith("/") and name in ("svg", "math", "path"):
                self._pop(stack)
        if at < len(page):
            self._text(stack[-1], page[at:])
        while len(stack) > 1:
            self._pop(stack)
        self.last[0] = len(self.tag) - 1

    def _text(self, node: int, s: str, decode: bool = True) -> None:
        if not self.cut[node]:
            self.pieces.append((node, entities.unescape(s) if decode and "&" in s else s))

    def _pop(self, stack: list[int]) -> None:
        n = stack.pop()
        self.last[n] = len(self.tag) - 1
        self.open[self.tag[n]] -= 1
        if self.tag[n] in BLOCKS:
            self.pieces.append((stack[-1], " "))

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                while len(stack) > i:
                    self._pop(stack)
                return
            if name not in BLOCKS and self.tag[stack[i]] in BLOCKS:
                return

    def _close_p(self, stack: list[int]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[i]]
            if t == "p":
                while len(stack) > i:
                    self._pop(stack)
                return
            if t in BLOCKS:
                return

    def _close_peer(self, stack: list[int], name: str) -> None:
        peers = PEERS.get(name)
        if not peers:
            return
        for i in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[i]]
            if t in peers:
                while len(stack) > i:
                    self._pop(stack)
                if name != "tr" or t == "tr":
                    return
            elif t in ("ul", "ol", "dl", "table", "select") or (t in BLOCKS and t not in ("p",)):
                return


def _drop_hints(p: _Page) -> None:
    """Elements with a telling word among others in their name are cut, unless they hold the best
    container, an article or main element, or most of the unlinked text; one of ADDED must hold
    nearly all of it, or an article with most of it.  A single paragraph, heading or list item is cut only if linked."""
    best = _scores(p)[0]
    n = len(p.tag)
    total, linked, holds = [0] * n, [0] * n, [t in ("article", "main") and not c and not h for t, c, h in zip(p.tag, p.cut, p.hint)]
    for node, s in p.pieces:
        k = len(s.strip())
        total[node] += k
        if p.link[node]:
            linked[node] += k
    all_prose, drop = sum(total) - sum(linked), [False] * n
    for i in range(n - 1, 0, -1):
        if p.hint[i]:
            prose = total[i] - linked[i]
            most = 2 * prose > all_prose
            if p.tag[i] in LEAVES:
                drop[i] = linked[i] >= 0.5 * total[i] and not most
            elif p.hint[i] == 1:
                drop[i] = not (most or holds[i] or i <= best <= p.last[i])
            else:
                drop[i] = not (prose > 0.9 * all_prose or (most and holds[i]))
        if not drop[i]:
            up = p.parent[i]
            total[up] += total[i]
            linked[up] += linked[i]
            holds[up] = holds[up] or holds[i]
    for i in range(1, n):
        drop[i] = drop[i] or drop[p.parent[i]]
    p.pieces = [(node, s) for node, s in p.pieces if not drop[node]]


def _scores(p: _Page) -> tuple[int, list[float], list[int], list[int], list[int], list[int]]:
    """Best container, and for each node: score less link density, characters of its own blocks, of
    all within, linked ones, and links."""
    n = len(p.tag)
    own, commas, total, linked, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, s in p.pieces:
        k = len(s.strip())
        if k:
            own[p.block[node]] += k
            commas[p.block[node]] += s.count(",")
            total[node] += k
            if p.link[node]:
                linked[node] += k
    for i in range(n - 1, 0, -1):
        total[p.parent[i]] += total[i]
        linked[p.parent[i]] += linked[i]
        links[p.parent[i]] += links[i] + (p.tag[i] == "a")
    score = [0.0] * n
    for i in range(n):
        if own[i] >= LEAST_CHARS and p.tag[i] not in POINTLESS:
            points, at = 1 + commas[i] + min(own[i] // 100, 3), p.parent[i] if p.tag[i] in ("p", "pre", "blockquote", "td", "dd") else i
            for level in range(LEVELS):
                if at < 0:
                    break
                score[at] += points / (1, 2, 6, 9, 12)[level]
                at = p.parent[at]
    final = [score[i] * (1 - linked[i] / total[i]) if total[i] else 0.0 for i in range(n)]
    return max(range(n), key=lambda i: (final[i], -i)), final, own, total, linked, links


def main_text(page: str | None) -> str:
    """The article's text, blocks joined by one space."""
    if not page:
        return ""
    p = _Page(page)
    if any(p.hint):
        _drop_hints(p)
    n = len(p.tag)
    best, final, own, total, linked, links = _scores(p)
    if not total[0]:
        return ""
    if not final[best]:  # no paragraph anywhere: all that was not cut
        best = 0
    at = best
    while at > 0:  # an article or main element around the best container is the article
        if p.tag[at] == "article":
            best = at
            break
        if p.tag[at] == "main":
            best = at
        at = p.parent[at]
    keep, named = [best], p.tag[best] in ("article", "main")
    prose = [0] * n  # unlinked text of the paragraphs in each node
    for i in range(n - 1, 0, -1):
        if p.tag[i] == "p" or (own[i] >= LEAST_CHARS and p.tag[i] not in POINTLESS):
            prose[i] += own[i] if not linked[i] else max(0, own[i] - linked[i])
        prose[p.parent[i]] += prose[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[p.parent[i]].append(i)
    bar, at = 0.2 * final[best], best
    while p.parent[at] >= 0:  # beside the best container, and beside each container around it
        up = p.parent[at]
        for i in children[up]:
            if i == at or not total[i]:
                continue
            density = linked[i] / total[i]
            heading = p.tag[i] in HEADINGS and i < at and density < 0.5
            if named:
                held = final[i] >= max(10.0, bar) or (p.tag[i] == "p" and total[i] >= 80 and density < 0.25)
            else:
                held = density < 0.25 and prose[i] > 0 and (up == p.parent[best] or final[i] >= bar)
            if held or (heading and up == p.parent[best]):
                keep.append(i)
        if named:
            break
        at = up
    spans = sorted((k, p.last[k]) for k in keep)
    gone = [False] * n
    for i in range(1, n):
        of_links = p.tag[i] in LISTS and links[i] >= 3 and linked[i] > 0.66 * total[i]
        gone[i] = gone[p.parent[i]] or of_links
    out, k = [], 0
    inside, end = bytearray(n), -1
    for a, b in spans:  # nested ones lie within the first
        if b > end:
            inside[a : b + 1] = b"\1" * (b + 1 - a)
            end = b
    for node, s in p.pieces:
        if inside[node] and not gone[node]:
            out.append(s)
        elif out and out[-1] != " ":
            out.append(" ")
    return " ".join("".join(out).split())


def main_text_column(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in s], dtype=object)

    return run(page)


def extract(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out`` (an older one of that name is replaced)."""
    return pages.withColumn(out, main_text_column(pages[page]))
