"""HTML extraction by tree scoring.

A forgiving, linear parser builds the element tree (implied ends of p, li, td and the like; raw script and style; broken nesting). Elements go by tag, by
ARIA role, when hidden, or when a name of their class or id says that they are boilerplate (ad-box, cookie-notice, site-nav, comments): a name counts by its last
word, or by its first one if only words like box or list follow, so "related-work" is no list of related pages. Each block of text then gives points, one and
one for each comma and for each 100 characters (three at most), to its container, half of them to the next ancestor, and less further up. An element's
score is its points, with a bonus or malus for its tag and names, times (1 - share of its text inside links). The element with the best score is the
container; it widens to the article or main element around it, and to ancestors that hold further text blocks, so no part of the
article is lost. Siblings with a fifth of its score, and sibling paragraphs of plain prose, are kept with it.

Names that may also be an article's own (search, print, related, discussion, reply) are boilerplate with a word for a page's tools behind them (share-buttons,
related-posts, search-form) and alone only a malus in the score; such an element goes where it lies outside the container, is
mostly links, or is a list of replies.

Every block of the container is returned, whole. Null and empty pages, and pages without text, give an empty text. A tag that the page ends in is no text; a
quote that is never closed runs to the page's end, as in browsers. Nothing recurses and nothing is searched twice, so nesting and broken markup
may be of any depth and length. Pages are handled one by one within their partitions: nothing is shuffled; memory holds one page's tree.
Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.session import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: What an open p ends at.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: A start tag ends the elements named, up to the scope's end.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROP_TAGS = frozenset("head script style nav header footer aside form noscript iframe button input select option textarea svg math canvas object embed audio video map template dialog menu title noembed noframes xmp datalist label fieldset".split())
DROP_ROLES = frozenset("navigation banner complementary contentinfo dialog alertdialog alert search form menu menubar toolbar tablist tooltip status".split())
#: Boilerplate wherever it stands.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot breadcrumb breadcrumbs consent cookie cookies dropdown footer footnav gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup promo promoted promotion sharebar sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: May be an article's own, too.
WEAK_WORDS = frozenset("banner discussion flash header print recommended related replies reply respond response responses search share shares sharing tags teaser teasers tooltip".split())
REPLY_WORDS = frozenset("discussion replies reply respond response responses".split())
#: Words that may follow the telling one.
AFTER_WORDS = frozenset("area articles banner bar block body bottom box center container content controls count embed form group holder inner item items left link links list main message outer panel placeholder post posts region right row section slot space stories strip text thread title top unit view wrap wrapper zone".split())
#: Behind a word that may be an article's own, these tell of a page's tools: share-buttons, related-posts.
TOOL_WORDS = frozenset("articles bar box button buttons form icons links list posts stories widget widgets".split())
GOOD_WORDS = frozenset("article body content entry main post story text blog page hentry prose".split())
TAG_POINTS = {"article": 10, "main": 8, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3, "table": -3, "th": -5}
KEEP_TAGS = frozenset(("html", "body", "article", "main"))
_LEAVES = frozenset("p li td th dd dt pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary".split())

_COMMENT = re.compile(r"<!---?>|<!--.*?(?:--!?>|\Z)", re.S)
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*+"), re.compile(r"=?[^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,،、，]")
#: has-sidebar, noNav: what a page says of its layout.
_LAZY = re.compile(r"(?<![a-zA-Z])(?:has|with|no|without|is|non)(?:[-_]|(?=[A-Z]))[a-zA-Z]+")


def _names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each name in class and id."""
    return [[w.lower() for w in _WORD.findall(_LAZY.sub(" ", name))] for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]


def _says(names: list[list[str]], words: frozenset[str]) -> bool:
    return any(ws and (ws[-1] in words or ws[0] in words and all(w in AFTER_WORDS for w in ws[1:])) for ws in names)


def _tools(names: list[list[str]]) -> bool:
    return any(len(ws) > 1 and ws[0] in WEAK_WORDS and all(w in TOOL_WORDS for w in ws[1:]) or len(ws) == 2 and ws[0] in DROP_WORDS and ws[1] in WEAK_WORDS for ws in names)


def _attributes(source: str, pos: int) -> tuple[dict[str, str], bool, int]:
    """A tag's attributes from behind its name, whether it closes itself, and the place behind the tag; in a tag that doesn't end, that is the source's end."""
    out: dict[str, str] = {}
    n = len(source)
    while True:
        at = _GAP.match(source, pos).end()
        if at >= n:
            return out, False, n
        if source[at] == ">":
            return out, at > pos and source[at - 1] == "/", at + 1
        m = _NAME.match(source, at)
        name, pos, value = m.group().lower(), m.end(), ""
        m = _EQUALS.match(source, pos)
        if m:
            pos = m.end()
            if pos < n and source[pos] in "\"'":
                end = source.find(source[pos], pos + 1)
                if end < 0:
                    return out, False, n
                value, pos = source[pos + 1 : end], end + 1
            else:
                m = _BARE.match(source, pos)
                value, pos = m.group(), m.end()
        out.setdefault(name, html.unescape(value) if "&" in value else value)


class _Tree:
    """Elements in document order. end[i]: the first element after i's subtree. segments: (element, block number, in a link, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.attrs = ["#root"], [-1], [0], [{}]
        self.segments: list[tuple[int, int, bool, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        tag, parent, end, attrs, segments = self.tag, self.parent, self.end, self.attrs, self.segments
        #: Open elements, and for each name the depths at which it is open.
        stack, depths, block, pos, n = [0], {}, 0, 0, len(source)

        def pop() -> None:
            i = stack.pop()
            end[i] = len(tag)
            if stack:
                depths[tag[i]].pop()

        def deepest(names: frozenset | set | tuple) -> int:
            return max((d[-1] for x in names if (d := depths.get(x))), default=-1)

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                pop()

        lower = None
        while pos < n:
            at = source.find("<", pos)
            if at != pos:
                at = n if at < 0 else at
                segments.append((stack[-1], block, bool(depths.get("a")), source[pos:at]))
                pos = at
                continue
            m = _TAG.match(source, pos + 1)
            if m is None:
                follows = source[pos + 1 : pos + 2]
                if source.startswith("<!--", pos):
                    pos = _COMMENT.match(source, pos).end()
                elif follows and follows in "!?/":
                    gt = source.find(">", pos)
                    pos = n if gt < 0 else gt + 1
                else:
                    segments.append((stack[-1], block, bool(depths.get("a")), "<"))
                    pos += 1
                continue
            name = m.group(2).lower()
            found, closed, pos = ({}, False, m.end() + 1) if source[m.end() : m.end() + 1] == ">" else _attributes(source, m.end())
            if name in BLOCK:
                block += 1
            if m.group(1):
                if name == "br":
                    segments.append((stack[-1], block, False, " "))
                elif depths.get(name):
                    close_to(depths[name][-1])
                continue
            if name == "br" or name == "hr":
                segments.append((stack[-1], block, False, " "))
                continue
            if name in VOID:
                continue
            if name in ENDS_P and depths.get("p") and depths["p"][-1] > deepest(_P_SCOPE):
                close_to(depths["p"][-1])
            if name in IMPLIED:
                ends, scope = IMPLIED[name]
                border = deepest(scope)
                while (depth := deepest(ends)) > border:
                    close_to(depth)
                    if name != "tr":
                        break
            tag.append(name)
            parent.append(stack[-1])
            end.append(0)
            attrs.append(found)
            if closed and name in ("svg", "path"):
                end[-1] = len(tag)
                continue
            if name in RAW:
                if lower is None:
                    lower = source.lower() if len(source.lower()) == n else re.sub("[A-Z]", lambda x: x.group().lower(), source)
                at = lower.find(f"</{name}", pos)
                pos = n if at < 0 else at
                if at >= 0:
                    gt = source.find(">", at)
                    pos = n if gt < 0 else gt + 1
                end[-1] = len(tag)
                continue
            depths.setdefault(name, []).append(len(stack))
            stack.append(len(tag) - 1)
        while stack:
            pop()


_P_SCOPE = ("td", "th", "table", "button", "object", "caption")


def _dropped(tag: str, attrs: dict[str, str]) -> int:
    """0: stays, 1: goes unless it holds most of the page, 2: goes."""
    if tag in DROP_TAGS:
        return 2
    if not attrs:
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return 2
    if set(attrs.get("role", "").lower().split()) & DROP_ROLES:
        return 2
    if tag in KEEP_TAGS:
        return 0
    names = _names(attrs)
    return 2 if _says(names, COMMENT_WORDS) else 1 if _says(names, DROP_WORDS) or _tools(names) else 0


def extract(source: str | None) -> str:
    """The main text: blocks in page order, joined by line feeds."""
    if not source:
        return ""
    t = _Tree(source)
    n = len(t.tag)
    tag, parent, end, attrs = t.tag, t.parent, t.end, t.attrs
    size = [0] * n
    for i, _, _, s in t.segments:
        size[i] += len(s)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    gone = [False] * n
    visible = sum(len(s) for i, _, _, s in t.segments if not s.isspace()) or 1
    for i in range(1, n):
        if gone[parent[i]]:
            gone[i] = True
            continue
        d = _dropped(tag[i], attrs[i])
        gone[i] = d == 2 or d == 1 and 2 * size[i] < visible
    names = [_names(x) if x else [] for x in attrs]
    weak = [i for i in range(1, n) if not gone[i] and tag[i] not in KEEP_TAGS and names[i] and _says(names[i], WEAK_WORDS)]
    for i in weak:  # a list of replies
        if not gone[i] and _says(names[i], REPLY_WORDS) and (tag[i] in ("ul", "ol") or any(names[j] and _says(names[j], REPLY_WORDS) for j in range(i + 1, end[i]))):
            gone[i:end[i]] = [True] * (end[i] - i)
    weak = [i for i in weak if not gone[i]]
    blocks: list[list] = []  # [element, number, text, characters in links]
    for i, number, link, s in t.segments:
        if gone[i]:
            continue
        if blocks and blocks[-1][1] == number:
            b = blocks[-1]
        else:
            blocks.append(b := [i, number, [], 0])
        b[2].append((i, s))
        b[3] += len(s) if link else 0
    if not blocks:
        return ""
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for b in blocks:
        text = " ".join(html.unescape("".join(s for _, s in b[2])).split())
        i = b[0]
        chars[i] += len(text)
        links[i] += b[3]
        if len(text) < 25:
            continue
        p = 1 + len(_COMMA.findall(text)) + min(len(text) // 100, 3)
        while i and tag[i] not in BLOCK:
            i = parent[i]
        if tag[i] in _LEAVES:
            i = parent[i]
        for share in (1, 0.5, 1 / 6, 1 / 9, 1 / 12, 1 / 15):
            if i < 0:
                break
            points[i] += p * share
            i = parent[i]
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
        links[parent[i]] += links[i]

    def score(i: int) -> float:
        bonus = TAG_POINTS.get(tag[i], 0)
        if names[i]:
            bonus += (10 if any(w in GOOD_WORDS for ws in names[i] for w in ws) else 0) - (25 if _says(names[i], WEAK_WORDS) else 0)
        return (points[i] + bonus) * (1 - min(1.0, links[i] / max(1, chars[i])))

    malus = set(weak)
    some = [i for i in range(n) if points[i] > 0 and not gone[i]]
    if some:
        scores = {i: score(i) for i in some}
        best = max(some, key=lambda i: (scores[i], -i))
    else:
        scores = {}
        best = next((i for name in ("article", "main", "body") for i in range(n) if tag[i] == name and not gone[i] and chars[i]), 0)
    up = best
    while up > 0 and tag[up] not in ("article", "main", "body", "html"):
        up = parent[up]
    core = best
    if up > 0 and tag[up] in ("article", "main"):
        best = core = up
    else:
        while best > 0 and parent[best] > 0 and tag[parent[best]] not in ("body", "html") and links[parent[best]] < 0.25 * chars[parent[best]]:
            best = parent[best]
    kept = [(best, max(end[best], best + 1))]
    top = scores.get(best) or (score(best) if chars[best] else 0)
    if parent[best] >= 0:
        i, stop = parent[best] + 1, end[parent[best]]
        while i < stop:
            if i != best and not gone[i] and chars[i] and i not in malus:
                dense = links[i] / chars[i]
                own = score(i) if points[i] > 0 else 0.0
                if own >= max(10, 0.2 * top) or (tag[i] == "p" and (dense < 0.25 if chars[i] > 80 else dense == 0)):
                    kept.append((i, max(end[i], i + 1)))
            i = max(end[i], i + 1)
    stays = [False] * n
    for a, z in kept:
        stays[a:z] = [True] * (z - a)
    for i in weak:
        inside, around = core <= i < max(end[core], core + 1), i <= core < end[i]
        if not around and (not inside or 2 * links[i] > chars[i]):
            stays[i : end[i]] = [False] * (end[i] - i)
    out = []
    for b in blocks:
        text = " ".join(html.unescape("".join(s for i, s in b[2] if stays[i])).split())
        if text:
            out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
