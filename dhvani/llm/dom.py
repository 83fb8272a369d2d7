"""A small tolerant HTML reader: block elements as nodes in page order, with the
statistics that the extraction model needs.  It is one linear pass with a stack."""

from __future__ import annotations

import html
import re

import numpy as np

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = ("script", "style", "head", "title", "noscript", "template", "svg", "iframe", "textarea", "select", "math", "object")
#: Of these all is raw text, to the page's end if need be.
RAW = frozenset("script style textarea iframe".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var acronym nobr blink center_ picture".split())
KINDS = ("p", "heading", "list", "item", "table", "cell", "nav", "header", "footer", "aside", "form", "article", "main",
         "section", "figure", "quote", "pre", "other")
KIND_OF = ({h: "heading" for h in "h1 h2 h3 h4 h5 h6".split()} | {k: "list" for k in "ul ol dl menu".split()}
           | {k: "item" for k in "li dt dd".split()} | {k: "table" for k in "table thead tbody tfoot tr caption".split()}
           | {k: "cell" for k in "td th".split()} | {k: "form" for k in "form fieldset button dialog".split()}
           | {"blockquote": "quote", "figcaption": "figure", "details": "section"}
           | {k: k for k in "p nav header footer aside article main section figure pre".split()})
#: Names in class, id and role attributes, by what they speak for.
LEXICON = (
    ("menu", "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip"),
    ("head", "header masthead banner branding logo hero topnav"),
    ("foot", "footer foot copyright colophon legal bottom credits"),
    ("side", "sidebar side aside widget widgets rail related recommended recommendations trending popular toc more tags share "
             "sharing social complementary"),
    ("advert", "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner partner outbrain "
               "taboola affiliate"),
    ("notice", "cookie cookies consent gdpr notice alert popup modal overlay dialog paywall subscribe subscription newsletter "
               "signup login banner toast privacy"),
    ("form", "form search searchbox login register contact input field"),
    ("comment", "comment comments commentlist discussion disqus replies reply respond responses reviews feedback guestbook"),
    ("content", "content article main story post entry body text prose page maincontent articlebody"),
)
WORD_OF = {}
for _k, (_, _words) in enumerate(LEXICON):
    for _w in _words.split():
        WORD_OF[_w] = WORD_OF.get(_w, 0) | 1 << _k
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(SKIPPED) + r")(?=[\s/>])(?P<rawattrs>[^>]*+)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[!?][^>]*+>"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
#: What can stand in a head, and its end.
HEAD = re.compile(
    r"(?:\s++|<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</?(?:meta|link|base|basefont|bgsound)(?=[\s/>])[^>]*+>"
    r"|<title(?=[\s/>])[^>]*+>.*?(?:</title\s*+>|(?=</head|<body)|\Z)"
    + "".join(rf"|<{t}(?=[\s/>])[^>]*+>.*?(?:</{t}\s*+>|\Z)" for t in ("script", "style"))
    + "".join(rf"|<{t}(?=[\s/>])[^>]*+>.*?</{t}\s*+>" for t in ("noscript", "template"))
    + r")*+(?:</head\s*+>)?", re.S | re.I)
ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in SKIPPED} | {"title": re.compile(r"</title\s*+>|(?=</head|<body)", re.I)}
#: Elements that end an open svg or math, but for those in elements that hold HTML.
BREAKS = re.compile(r"<(?:article|aside|b|blockquote|body|br|center|code|dd|div|dl|dt|em|footer|form|h[1-6]|header|hr|i|img|li|main|menu|nav"
                    r"|ol|p|pre|section|small|span|strong|sub|sup|table|u|ul)(?=[\s/>])", re.I)
HOLDS = re.compile(r"<(?:foreignobject|desc|title|annotation-xml|m[inos]|mtext)(?=[\s>])", re.I)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


def attribute_words(attrs: str) -> int:
    """Bits of the lexicon's groups that class, id and role name."""
    bits = 0
    for m in ATTR.finditer(attrs):
        for w in PIECE.findall(m[1] or m[2] or m[3] or ""):
            bits |= WORD_OF.get(w.lower(), 0)
    return bits


def _after(source: str, m: re.Match, none: set[str]) -> int | None:
    """Where the page goes on after a skipped element's start tag ``m``; None: it isn't
    closed, and what follows it counts.  ``none``: elements that aren't closed from here on."""
    tag, at = m["raw"].lower(), m.end()
    if tag == "head":
        return HEAD.match(source, at).end()
    foreign = tag in ("svg", "math")
    if foreign and m["rawattrs"].endswith("/"):
        return at
    end = None if tag in none else ENDS[tag].search(source, at)
    if end is None:
        none.add(tag)
        if tag in RAW:
            return len(source)
    if foreign and (end or tag + " breaks" not in none):
        out = BREAKS.search(source, at, end.start() if end else len(source))
        if out and not HOLDS.search(source, at, out.start()):
            return out.start()
        if not end and not out:
            none.add(tag + " breaks")
    return end.end() if end else None


def _tokens(source: str):
    """Tokens of the page, but for what stands in skipped elements."""
    at, none = 0, set()
    while at is not None:
        tokens, at = TOKEN.finditer(source, at), None
        for m in tokens:
            if m["raw"]:
                at = _after(source, m, none)
                if at is not None:
                    break
            yield m


class Page:
    """Block nodes in page order (node 0 is the page itself): ``parent``, ``end`` (one
    past its last descendant), ``kind``, ``bits`` of its own names and ``above`` of its
    ancestors' names and kinds, ``depth``; per node its own ``chars``, ``linked`` chars,
    ``stops``, ``tags``; ``texts``: (node, block, raw text); ``marks``: data-y values."""

    def __init__(self, source: str):
        self.parent, self.end, self.kind, self.bits, self.above, self.depth = [-1], [0], [len(KINDS) - 1], [0], [0], [0]
        self.chars, self.linked, self.stops, self.tags, self.marks = [0], [0], [0], [0], [""]
        self.texts: list[tuple[int, int, str]] = []
        stack = [("", 0)]  # (element, node); inline elements have their block's node
        links = block = 0
        opened: dict[str, int] = {}
        for m in _tokens(source):
            if m["text"] is not None:
                text, node = m["text"], stack[-1][1]
                if text.isspace():
                    self.texts.append((node, block, " "))
                    continue
                if "&" in text:
                    text = html.unescape(text)
                n = len(text.strip())
                self.texts.append((node, block, text))
                self.chars[node] += n
                self.linked[node] += n if links else 0
                self.stops[node] += text.count(".") + text.count(",") + text.count("?")
                continue
            tag = m["tag"] or m["raw"]
            if tag is None:
                continue
            tag = tag.lower()
            node = stack[-1][1]
            self.tags[node] += 1
            if tag == "br":
                self.texts.append((node, block, " "))
            if tag in VOID:
                block += tag == "hr"
                continue
            if m["end"]:
                if opened.get(tag):
                    block += tag not in INLINE
                    links -= self._pop(stack, opened, lambda t: t == tag)
                continue
            if tag in INLINE:
                links += tag == "a"
                stack.append((tag, node))
                opened[tag] = opened.get(tag, 0) + 1
                continue
            block += 1
            if opened.get("p"):  # a block ends a paragraph that it stands in
                links -= self._pop(stack, opened, lambda t: t == "p")
            ends = CLOSES.get(tag)
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][0]
                    if t in STOPS.get(tag, ()):
                        break
                    if t in ends:
                        links -= self._pop(stack, opened, lambda t: t in ends)
                        break
            up = stack[-1][1]
            kind_no = KINDS.index(KIND_OF.get(tag, "other"))
            attrs = m["attrs"] or m["rawattrs"]
            self.parent.append(up)
            self.end.append(0)
            self.kind.append(kind_no)
            self.bits.append(attribute_words(attrs) if attrs else 0)
            self.above.append(self.above[up] | self.bits[up] | 1 << (len(LEXICON) + self.kind[up]))
            self.depth.append(self.depth[up] + 1)
            for x in (self.chars, self.linked, self.stops, self.tags):
                x.append(0)
            y = re.search(r"data-y=(\w)", attrs) if attrs and "data-y" in attrs else None
            self.marks.append(y[1] if y else "")
            stack.append((tag, len(self.parent) - 1))
            opened[tag] = opened.get(tag, 0) + 1
        while len(stack) > 1:
            self._close(*stack.pop())
        self.end[0] = len(self.parent)

    def _close(self, tag: str, node: int) -> None:
        if tag not in INLINE:
            self.end[node] = len(self.parent)

    def _pop(self, stack, opened, until) -> int:
        """Close elements down to the first that ``until`` names; returns the links among them."""
        links = 0
        while len(stack) > 1:
            tag, node = stack.pop()
            self._close(tag, node)
            opened[tag] -= 1
            links += tag == "a"
            if until(tag):
                break
        return links

    def text(self, kept) -> str:
        """Blocks of the nodes that ``kept`` holds, white space as one space."""
        out, last, buf = [], -1, []
        for node, block, text in self.texts:
            if block != last:
                if buf:
                    out.append(" ".join("".join(buf).split()))
                buf, last = [], block
            if kept[node]:
                buf.append(text)
        if buf:
            out.append(" ".join("".join(buf).split()))
        return "\n\n".join([b for b in out if b])


def matrix(pages: list[Page]) -> np.ndarray:
    """A row of features for each node of each page."""
    out = []
    for p in pages:
        n = len(p.parent)
        parent, end = np.array(p.parent), np.array(p.end)
        parent[0] = 0
        own = np.array((p.chars, p.linked, p.stops, p.tags), float)
        kind = np.array(p.kind)
        paras = np.array((kind == 0, kind == 1, kind == 3, np.ones(n)), float)
        total = np.concatenate((np.zeros((8, 1)), np.cumsum(np.concatenate((own, paras)), axis=1)), axis=1)
        sub = total[:, end] - total[:, :n]
        chars = np.maximum(sub[0], 1)
        page = max(sub[0][0], 1)
        # Sibling statistics: place among them, their number, their text, how many are of one's kind.
        order = np.lexsort((np.arange(n), parent))
        order = order[order != 0]
        first = np.ones(len(order), bool)
        first[1:] = parent[order][1:] != parent[order][:-1]
        begin = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        number = np.diff(np.append(begin, len(order)))
        place, many = np.zeros(n), np.ones(n)
        place[order], many[order] = np.arange(len(order)) - (begin[group] if len(order) else 0), number[group] if len(order) else 1
        same = np.ones(n)
        if len(order):
            key = parent[order] * len(KINDS) + kind[order]
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            same[order] = count[back]
        before = total[0, :n] / page
        bits, above = np.array(p.bits), np.array(p.above)
        shift = np.arange(len(LEXICON))
        up = np.arange(len(LEXICON) + len(KINDS))
        out.append(np.column_stack((
            kind, np.log1p(sub[0]), np.log1p(own[0]), sub[1] / chars, sub[2] / chars, sub[3] / chars, np.log1p(sub[4]), np.log1p(sub[5]),
            np.log1p(sub[6]), np.log1p(sub[7]), sub[0] / np.maximum(sub[7], 1), sub[0] / page, sub[0] / np.maximum(sub[0][parent], 1),
            sub[1][parent] / np.maximum(sub[0][parent], 1), np.log1p(sub[4][parent]), np.array(p.depth), before, place / many, np.log1p(many),
            same / many, (kind[:, None] == np.arange(len(KINDS))), (bits[:, None] >> shift) & 1, (above[:, None] >> up) & 1)).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, 1), np.float32)
