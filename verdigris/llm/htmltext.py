"""Main text of a web page by composite text density.

A page becomes a tree of elements without the parts that are never article text
(scripts, menus, forms, adverts, reader comments, ... by tag, role, class or id; a form
or mark that holds most of the page's text does not count).  For each node, characters
per tag are adjusted by the share of link characters and link tags: the composite text
density.  The node whose children's densities have the
greatest sum holds the article; the least density on its path to the body is the
threshold from which neighbours belong to it, too.  All text of that subtree, in page
order, is the result.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm._shared import bounded_batches

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment, or what is left of one
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr script style template noscript".split())
_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A start tag that ends an open element of the second set, up to an element of the third.
_IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dd dt".split())
_P_SCOPE = frozenset("html body table td th button object caption article section div ul ol blockquote main aside nav header footer form".split())

_NEVER = frozenset("head title script style noscript template svg nav footer aside button select textarea input iframe object embed canvas audio video dialog menu map noframes noembed xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark what is no article text, if the name has no others but _BOX.
_MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner "
    "sidebar aside comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices notification notifications "
    "alert popup modal overlay subscribe subscription newsletter signup signin login paywall share sharing social related recommended "
    "recommendations menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead copyright disclaimer search "
    "widget widgets".split()
)
_COMMENT_MARKS = frozenset("comment comments commentlist disqus respond replies".split())
_BOX = frozenset("area bar box block button buttons container group holder icons inner item items left link links list outer panel posts region right row section slot text the top unit wrap wrapper".split())
#: No mark; a form, which does not count if it holds most of the page's text; a search box,
#: which counts if it has something to fill in; a mark that counts unless no text is left
#: but titles; a mark that always counts.
_NO, _FORM, _SEARCH, _SOFT, _HARD = 0, 1, 2, 3, 4
_FRAME_NAME = re.compile(r"(?:(?:site|page|global|main|top|bottom|web|blog)[-_]?)?(?:header|footer|head|foot)", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A list is a menu if this share of its characters is in links.
_MENU_SHARE = 0.8


@dataclass
class _Tree:
    """Elements in page order; a node's subtree is the range up to `end`."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    out: list[int] = field(default_factory=list)  # marked as no article text
    article: list[bool] = field(default_factory=list)  # within an article or main
    text: list[tuple[int, str | None]] = field(default_factory=list)  # (node, text), None: a block's border


def _marked(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _NEVER or (tag == "header" and not in_article):
        return _HARD
    found = _FORM if tag == "form" else _NO
    if not attributes or tag in ("html", "body", "main"):
        return found
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found = max(found, _SOFT)
        elif name == "role" and (role := value.strip().lower()) in _ROLES:
            found = max(found, _FORM if role == "form" else _SEARCH if role == "search" else _SOFT)
        elif name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _WORD.findall(one) if len(w) > 1}
                marks = words & (_COMMENT_MARKS if tag == "article" else _MARKS)
                if marks and words <= _MARKS | _BOX:
                    found = max(found, _SEARCH if marks == {"search"} else _HARD if marks & _COMMENT_MARKS else _SOFT)
                elif not in_article and tag != "article" and _FRAME_NAME.fullmatch(one):
                    found = max(found, _SOFT)
    return found


def _parse(page: str) -> _Tree:
    tree = _Tree(["#root"], [-1], [0], [_NO], [False], [])
    stack, in_article = [0], [False]
    tags, texts = tree.tag, tree.text
    # Where on the stack the open elements of a name are, and those that are no inline
    # elements: an end tag without its start tag is known at once, however deep the page.
    places: dict[str, list[int]] = {"#root": [0]}
    blocks, seen = [0], set()

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            in_article.pop()
            places[tags[node]].pop()
            tree.end[node] = len(tags)
            if tags[node] not in _INLINE:
                blocks.pop()
                texts.append((node, None))

    def find(names: frozenset[str], stop: frozenset[str]) -> int:
        """Place of the innermost open element of `names`, 0 if one of `stop` is within it."""
        found = max((places[n][-1] for n in names if places.get(n)), default=0)
        return found if found and found >= max((places[n][-1] for n in stop if places.get(n)), default=0) else 0

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark != at:
            texts.append((stack[-1], page[at : mark if mark >= 0 else size]))
            if mark < 0:
                break
        token = _TOKEN.match(page, mark)
        if token is None:  # a bare "<"
            texts.append((stack[-1], "<"))
            at = mark + 1
            continue
        at = token.end()
        if token[1]:
            name = token[1].lower()
            depth = find(frozenset((name,)), frozenset())
            if depth and not (name in _FORMAT and blocks[-1] > depth):
                close(depth)
            elif name in ("br", "p"):
                texts.append((stack[-1], None))
            continue
        if not token[2] or not page.endswith(">", 0, at):  # comments; a tag cut off at the end
            continue
        name, attributes = token[2].lower(), token[3]
        if name in _CLOSES_P and (depth := find(frozenset({"p"}), _P_SCOPE)):
            close(depth)
        if name in _IMPLIED and (depth := find(*_IMPLIED[name])):
            close(depth)
        if name in ("html", "body"):
            if name in seen:
                continue
            seen.add(name)
        if name == "body" and (depth := find(frozenset({"head"}), frozenset())):
            close(depth)
        node = len(tags)
        tags.append(name)
        tree.parent.append(stack[-1])
        tree.end.append(node + 1)
        tree.out.append(_marked(name, attributes, in_article[-1]))
        tree.article.append(in_article[-1])
        if name not in _INLINE:
            texts.append((node, None))
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else size
        elif name not in _VOID and not (attributes.endswith("/") and name in ("svg", "path")):
            places.setdefault(name, []).append(len(stack))
            if name not in _INLINE:
                blocks.append(len(stack))
            stack.append(node)
            in_article.append(in_article[-1] or name in ("article", "main"))
    close(0)
    return tree


def _visible(tree: _Tree, plain: list[int]) -> list[bool]:
    """Nodes that no mark hides.  A mark on what holds the page's title does not count,
    nor does a form that holds most of the page's text outside links (`plain` characters
    a node), nor a search box without anything to fill in.  If marks leave no text but
    titles, a name on what holds most of the text does not count either."""
    n = len(tree.tag)

    def counted(tags: tuple[str, ...]) -> list[int]:
        """How many nodes of `tags` come before each node."""
        return list(itertools.accumulate((tag in tags for tag in tree.tag), initial=0))

    titles, fields = counted(("h1",)), counted(("form", "input", "button", "select", "textarea"))
    held = plain.copy()
    for node in range(n - 1, 0, -1):
        if tree.out[node] != _HARD:
            held[tree.parent[node]] += held[node]
    def marked(alone: bool) -> list[bool]:
        shown = [True] * n
        for node in range(1, n):
            mark, inside = tree.out[node], slice(node + 1, tree.end[node])
            hidden = mark != _NO
            if hidden and tree.tag[node] not in _NEVER and tree.tag[node] not in ("header", "form") and titles[inside.stop] > titles[inside.start]:
                hidden = False
            if (mark == _FORM or (alone and mark == _SOFT)) and 2 * held[node] > held[0]:
                hidden = False
            if mark == _SEARCH and fields[inside.stop] == fields[inside.start]:
                hidden = False
            shown[node] = shown[tree.parent[node]] and not hidden
        return shown

    shown = marked(False)
    titled = [False] * n
    for node in range(1, n):
        titled[node] = tree.tag[node] == "h1" or titled[tree.parent[node]]
    if any(plain[node] and shown[node] and not titled[node] for node in range(n)):
        return shown
    return marked(True)


@dataclass
class _Measured:
    """What a node's visible subtree holds, and which nodes are visible."""

    shown: list[bool]
    unlisted: list[bool]  # visible if lists of links are
    chars: list[int]
    link_chars: list[int]
    tags: list[int]
    links: list[int]


def measure(tree: _Tree, pieces: list[tuple[int, str | None]]) -> _Measured:
    n = len(tree.tag)
    link = [False] * n
    chars, link_chars, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    for node in range(1, n):
        link[node] = tree.tag[node] == "a" or link[tree.parent[node]]
    for node, text in pieces:
        if text:
            size = len(" ".join(text.split()))
            chars[node] += size
            link_chars[node] += size if link[node] else 0
    shown = _visible(tree, [c - lc for c, lc in zip(chars, link_chars, strict=True)])
    menus = []
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        if shown[node]:
            # A list of links outside an article is a menu, whatever it is called.
            if not tree.article[node] and tree.tag[node] in ("ul", "ol", "div", "table") and links[node] and link_chars[node] >= _MENU_SHARE * chars[node]:
                shown[node] = False
                menus.append(node)
                continue
            chars[up] += chars[node]
            link_chars[up] += link_chars[node]
            tags[up] += tags[node] + 1
            links[up] += links[node] + (tree.tag[node] == "a")
    unlisted = shown.copy()
    for node in menus:
        unlisted[node] = True
    for node in range(1, n):
        shown[node] = shown[node] and shown[tree.parent[node]]
    return _Measured(shown, unlisted, chars, link_chars, tags, links)


def composite_density(chars: int, link_chars: int, tags: int, links: int, body_share: float) -> float:
    """Characters per tag, adjusted by how many of both are those of links."""
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_share * chars + math.e)
    ratio = chars / max(link_chars, 1) * (max(tags, 1) / max(links, 1))
    return max(0.0, chars / max(tags, 1) * math.log(max(ratio, 1.0)) / math.log(base)) if base > 1 else chars / max(tags, 1)


def choose(tree: _Tree, m: _Measured, body: int) -> tuple[int, list[float]]:
    """The node whose children's densities have the greatest sum (of equal sums the first),
    or `body` if no sum is above zero; and all densities.

    It is looked for within `body`, or, if a page has one article (or main) with text of
    its own, or some that hold its title, within these: what stands beside an article,
    such as what its readers say, may be denser than the article.
    """
    n = len(tree.tag)
    body_share = m.link_chars[body] / max(m.chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for node in range(n - 1, -1, -1):
        if m.shown[node] and m.chars[node]:
            density[node] = composite_density(m.chars[node], m.link_chars[node], m.tags[node], m.links[node], body_share)
            if tree.parent[node] >= 0:
                total[tree.parent[node]] += density[node]
    within = range(body, tree.end[body] if body else n)
    named = [i for i in within if tree.tag[i] in ("article", "main") and not tree.article[i] and m.shown[i] and m.chars[i] > m.link_chars[i]]
    titled = [i for i in named if "h1" in tree.tag[i : tree.end[i]]]
    if titled or len(named) == 1:
        within = [j for i in titled or named for j in range(i, tree.end[i])]
    best = max(within, key=lambda i: (total[i], -i), default=0)
    if total[best] > 0:
        return best, density
    return (named[0] if len(named) == 1 else body), density


def extract(page: str | None) -> str:
    """The article's text; empty for a null page or one without article text."""
    if not page:
        return ""
    tree = _parse(page.replace("\0", ""))
    n = len(tree.tag)
    pieces = [(node, None if text is None else html.unescape(text)) for node, text in tree.text]
    m = measure(tree, pieces)
    shown, chars = m.shown, m.chars
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    if tree.end[body] < n and any(text and shown[node] and node >= tree.end[body] for node, text in pieces):
        body = 0  # text after a body that was closed too early
    best, density = choose(tree, m, body)
    if best != body:  # lists of links beside the paragraphs of the densest part are its sources
        for node in range(best + 1, tree.end[best]):
            shown[node] = shown[tree.parent[node]] and m.unlisted[node]

    threshold, node = density[best], best
    while node != body and tree.parent[node] >= 0:
        node = tree.parent[node]
        threshold = min(threshold, density[node])
    children: dict[int, list[int]] = {}
    for node in range(1, n):
        children.setdefault(tree.parent[node], []).append(node)
    while best != body:
        up = tree.parent[best]
        named = tree.tag[best] in ("article", "main")
        beside = [s for s in children[up] if s != best and chars[s] and shown[s]]
        if named or up == body and not any(tree.tag[s] in ("h1", "h2", "p") for s in beside):
            break
        if not tree.article[best] and not any(density[s] >= threshold for s in beside) and beside:
            break
        best = up

    words: list[str] = []
    for node, text in pieces:
        if best <= node < (tree.end[best] if best else n):
            if text is None:
                words.append(" ")
            elif shown[node]:
                words.append(text)
    return " ".join("".join(words).split())


def text_of(spark: SparkSession) -> Column:
    """A function of an html column: the main text, empty for null."""
    bounded_batches(spark)

    @F.arrow_udf("string")
    def main_text(page: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py()) for p in page], pa.string())

    return main_text


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Null and empty pages have an empty text of 0 characters; repeated rows stay.
    """
    texts = pages.select("page_id", "url", text_of(pages.sparkSession)("html").alias("text"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
