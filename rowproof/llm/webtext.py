"""The main text of web pages by scoring their trees.

A page's tags are read into a tree, leniently: what may be left open is closed where HTML closes it. Every
paragraph (a run of text between two block boundaries) earns points for its length and its commas and passes
them to its ancestors, less the farther up they are; a container's points are discounted by the share of its
text that lies in links. The container with the most points is kept, widened to the article or main element
around it, together with the siblings that score a fifth as much. Left out of everything: elements that never
hold main text (menus, headers, footers, sidebars, forms, scripts, styles), elements whose class, id or role says
that they hold menus, adverts, notices, comments and the like, and lists or boxes made of links. Headings in an
article's own header stay.

Blocks keep the page's order; references are decoded, white space in a block becomes one space (a line break too),
empty blocks vanish, and blocks are joined by an empty line. A page is read in one go by a regular expression without
backtracking; nothing is cut, however long or deeply nested a page is. A null or empty html gives an empty text.
Rows that repeat an id each give a row, a null id or url stays null, an empty table gives no rows, and columns that
are not asked for are not looked at, whatever their names.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id bigint, url string, text string, n_chars bigint"

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody
td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("html table td th caption template object marquee applet".split())
# A start tag of the key closes an open element of the values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
          "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"),
          "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
INSIDE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
# Never main text.
DROPPED = frozenset("""head title nav footer aside form script style noscript template iframe noembed noframes svg math button
select textarea input object embed applet canvas audio video dialog menu search datalist map xmp""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
DROPPED_WORDS = frozenset("""ad ads adv advert advertisement advertisements adverts advertising adsense sponsor sponsored promo promos
promotion sidebar aside breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies newsletter subscribe
subscription signup login share sharing social related recommended recommendations teaser pagination pager widget""".split())
# The same, but for a box around the whole article, which may be named after its surroundings.
HINT_WORDS = frozenset("""banner nav navbar navigation menu menus footer masthead header topbar toolbar cookie cookies consent gdpr notice
notices notification alert popup modal overlay skip paywall""".split())
BESIDE = frozenset("has with no without is not".split())
KEPT_WORDS = frozenset("article content post entry main story body text".split())
TAG_POINTS = {"article": 10, "main": 10, "div": 5, "section": 3, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "th": -5}

TOKEN = re.compile(
    r"""<!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<attributes>(?:[^>=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=(?!\s*+["']))*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
BROKEN = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

KEEP, DROP, HINT = 0, 1, 2


def verdict(name: str, attributes: str) -> tuple[int, int]:
    """(whether an element is left out, points that its names are worth)."""
    if name in DROPPED:
        return DROP, 0
    mark, points = (HINT if name == "header" else KEEP), 0
    if not attributes or attributes == "/":
        return mark, points
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role":
            if value.strip().lower() in DROPPED_ROLES:
                mark = mark or HINT
        elif key == "hidden" or key == "aria-hidden":
            if key == "hidden" or value.strip().lower() == "true":
                return (DROP if name not in ("html", "body") else KEEP), 0
        else:
            for token in value.split():
                words = [w.lower() for w in WORD.findall(token)]
                if not words or words[0] in BESIDE:
                    continue
                if not DROPPED_WORDS.isdisjoint(words):
                    mark = DROP
                elif not HINT_WORDS.isdisjoint(words):
                    mark = mark or HINT
                elif not KEPT_WORDS.isdisjoint(words):
                    points = 25
    if name in ("html", "body", "article", "main"):
        return KEEP, points
    return mark, points


class Tree:
    """A page as lists: elements in the order of their start tags, and pieces of text with the block they belong to."""

    def __init__(self, html: str):
        self.names, self.parents, self.marks, self.points = ["#page"], [-1], [KEEP], [0]
        self.pieces: list[tuple[int, int, bool, str]] = []  # (element, block, in a link, text)
        self.owners = [0]  # the element around each block
        self._stack, self._blocks, self._open = [0], [0], {"#page": 1}
        self._links = 0
        self._read(html)

    def _boundary(self) -> None:
        self.owners.append(self._blocks[-1])

    def _pop_to(self, depth: int) -> None:
        """Close elements until `depth` are open."""
        block = False
        while len(self._stack) > depth:
            name = self.names[self._stack.pop()]
            self._open[name] -= 1
            self._links -= name == "a"
            if name in BLOCK:
                self._blocks.pop()
                block = True
        if block:
            self._boundary()

    def _find(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> int:
        """Depth of the innermost open element of these names in scope, or 0."""
        if not any(self._open.get(n) for n in names):
            return 0
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.names[self._stack[depth]]
            if name in names:
                return depth
            if name in SCOPES or name in within:
                return 0
        return 0

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES:
            while depth := self._find_row(name) if name in ROWS else self._find(CLOSES[name], INSIDE.get(name, ())):
                self._pop_to(depth)
        if name in BLOCK and (depth := self._find(("p",))):
            self._pop_to(depth)
        if name == "a" and (depth := self._find(("a",))):
            self._pop_to(depth)
        if name in HEADINGS and self.names[self._stack[-1]] in HEADINGS:
            self._pop_to(len(self._stack) - 1)
        if name == "br":
            self.pieces.append((self._stack[-1], len(self.owners) - 1, False, " "))
            return
        if name in VOID:
            if name in BLOCK:
                self._boundary()
            return
        mark, points = verdict(name, attributes)
        self._stack.append(len(self.names))
        self.names.append(name), self.parents.append(self._stack[-2]), self.marks.append(mark), self.points.append(points)
        self._open[name] = self._open.get(name, 0) + 1
        self._links += name == "a"
        if name in BLOCK:
            self._blocks.append(self._stack[-1])
            self._boundary()

    def _find_row(self, name: str) -> int:
        """Depth of the open part of the innermost table that a new `name` ends, or 0."""
        for depth in range(len(self._stack) - 1, 0, -1):
            open_ = self.names[self._stack[depth]]
            if open_ == "table":
                return 0
            if open_ in CLOSES[name]:
                return depth
        return 0

    def _end(self, name: str) -> None:
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "caption"):
            for depth in range(len(self._stack) - 1, 0, -1):
                open_ = self.names[self._stack[depth]]
                if open_ == name:
                    self._pop_to(depth)
                    return
                if open_ == "table":
                    return
        elif name in HEADINGS:
            if depth := self._find(tuple(HEADINGS)):
                self._pop_to(depth)
        elif name not in ("html", "body") and (depth := self._find((name,))):
            self._pop_to(depth)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._stack[-1], len(self.owners) - 1, self._links > 0, unescape(text) if "&" in text else text))

    def _read(self, html: str) -> None:
        at = text = 0
        while (at := html.find("<", at)) >= 0:
            found = TOKEN.match(html, at)
            if found is None:
                # A tag that never ends takes the rest of the page with it; any other "<" is text.
                if BROKEN.match(html, at):
                    self._text(html[text:at])
                    return
                at += 1
                continue
            self._text(html[text:at])
            at = text = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["close"]:
                self._end(name)
                continue
            self._start(name, found["attributes"])
            if name in RAW:
                ends = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                if not ends:
                    return
                at = text = ends.start()
        self._text(html[text:])


ROWS = frozenset(("tr", "td", "th", "tbody", "thead", "tfoot"))


def main_text(html: str | None) -> str:
    """The text of the page's main part."""
    if not html:
        return ""
    tree = Tree(html)
    names, parents = tree.names, tree.parents
    count = len(names)
    held = [n in ("article", "main") for n in names]
    for i in range(count - 1, 0, -1):
        held[parents[i]] += held[i]
    # A box that holds all articles is not left out for its name; neither is a heading in an article's header.
    dropped, in_article, saved = [False] * count, [False] * count, [False] * count
    for i in range(1, count):
        up = parents[i]
        in_article[i] = in_article[up] or names[i] in ("article", "main")
        saved[i] = saved[up]
        if tree.marks[i] == DROP:
            dropped[i] = True
        elif tree.marks[i] == HINT and not 0 < held[i] == held[0]:
            dropped[i] = True
            saved[i] = not dropped[up] and in_article[up] and names[i] == "header"
        else:
            dropped[i] = dropped[up] and not (saved[up] and names[i] in HEADINGS)

    # Blocks: (number, owner, text, letters in links), in page order.
    blocks: list[tuple[int, str, int]] = []
    at = 0
    pieces = [p for p in tree.pieces if not dropped[p[0]]]
    while at < len(pieces):
        to = at
        while to < len(pieces) and pieces[to][1] == pieces[at][1]:
            to += 1
        text = " ".join("".join(p[3] for p in pieces[at:to]).split())
        if text:
            linked = sum(len("".join(p[3].split())) for p in pieces[at:to] if p[2])
            blocks.append((tree.owners[pieces[at][1]], text, linked))
        at = to
    if not blocks:
        return ""

    letters, linked, links, boxes = [0] * count, [0] * count, [0] * count, [False] * count
    for owner, text, in_links in blocks:
        letters[owner] += len(text) - text.count(" ")
        linked[owner] += in_links
    for i in range(count - 1, 0, -1):
        if dropped[i]:
            continue
        links[i] += names[i] == "a"
        up = parents[i]
        letters[up] += letters[i]
        linked[up] += linked[i]
        links[up] += links[i]
        if names[i] in BLOCK:
            boxes[up] = True

    def in_links(i: int) -> float:
        return min(1.0, linked[i] / letters[i]) if letters[i] else 0.0

    scores = [0.0] * count
    for owner, text, _ in blocks:
        earned = (1 + text.count(",") + text.count("،") + text.count("、") + len(text) / 100) * (1 - in_links(owner))
        holder = owner if names[owner] in ("article", "main", "section", "body", "#page") or (names[owner] == "div" and boxes[owner]) else parents[owner]
        level = 0
        while holder >= 0 and level < 6:
            scores[holder] += earned / (1 if level == 0 else 2 if level == 1 else 3 * level)
            holder, level = parents[holder], level + 1
    for i in range(count):
        if scores[i]:
            scores[i] = (scores[i] + TAG_POINTS.get(names[i], 0) + tree.points[i]) * (1 - in_links(i))

    best = max((i for i in range(count) if not dropped[i]), key=lambda i: (scores[i], -i))
    top, holder = scores[best], best
    around = best
    while around > 0 and names[around] not in ("article", "main"):
        around = parents[around]
    holder = around if around > 0 else best
    chosen = {holder}
    for i in range(1, count):
        if i == holder or dropped[i] or parents[i] != parents[holder] or not letters[i]:
            continue
        if scores[i] >= max(10.0, 0.2 * top) and in_links(i) < 0.5:
            chosen.add(i)
        elif holder == best and names[i] in HEADINGS | {"p", "pre", "blockquote"} and in_links(i) < 0.25:
            chosen.add(i)
    kept = [False] * count
    for i in range(count):
        up = parents[i]
        if i in chosen:
            kept[i] = True
        elif up >= 0 and kept[up]:
            # Menus without a name: lists and boxes that are made of links.
            menu = names[i] in ("ul", "ol", "dl", "table", "div", "section") and links[i] >= 2 and in_links(i) > 0.6
            kept[i] = not menu
    return "\n\n".join(text for owner, text, _ in blocks if kept[owner])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(read, RESULT)
