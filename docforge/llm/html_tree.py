"""HTML to a small tree of block elements and runs of text.

A tolerant reader of whole pages: comments, declarations and raw-text elements
are passed over, end tags may be missing, attributes unquoted or cut off.
Block elements are the inner nodes; a run of inline content between block
borders is a leaf.  Inline elements make no nodes unless their class or id says
what they are (an advert in a span).  Fallback and foreign content (``EMBED``) is
read like other inline content; a run knows what share of it is of that kind.

Time is linear in the page, however broken: open elements are found by lists of
their positions, and a search that has found nothing isn't made again.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
#: a tag whose quotes leave no > to end it
LOOSE = re.compile(r"()()()<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)")
QUOTE = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed values of HTML.
RAW = {"script", "style", "title", "textarea", "iframe", "template"}
EMBED = {"audio", "canvas", "noembed", "noframes", "noscript", "object", "select", "svg", "video"}
#: a start tag of a block ends these, unless it stands in one of INTEGRATION
FOREIGN = {"svg", "math"}
INTEGRATION = {"foreignobject", "annotation-xml", "desc"}
#: words on both sides of such a tag are apart
APART = EMBED - {"svg"} | {"option", "optgroup", "text", "desc"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center",
         "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
         "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html",
         "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: a start tag of the key ends open elements of the value, up to a table or list
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
        "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"}}
SCOPE = {"table", "ul", "ol", "dl", "menu", "html"}
#: block elements that don't end an open paragraph
IN_P = {"button"}
#: sets of elements that end tags don't reach over
SCOPES = {"none": set(), "block": BLOCK, "embed": BLOCK - {"p"}, "cell": SCOPE | {"td", "th"},
          "paragraph": SCOPE | {"td", "th", "button"}, "item": SCOPE - {"html"},
          "foreign": BLOCK | INTEGRATION}
_SCOPES_OF = {tag: [name for name, tags in SCOPES.items() if tag in tags]
              for tag in BLOCK | SCOPE | INTEGRATION}

# What class, id or role say: kind -> words that names are made of.
HINTS = {
    "ad": ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner",
           "sponsor", "sponsored", "promo", "promotion", "outbrain", "taboola"],
    "menu": ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "tabs",
             "pager", "pagination", "skip", "toolbar", "topbar", "sitemap"],
    "frame": ["header", "footer", "masthead", "copyright", "colophon", "legal", "bottom"],
    "side": ["sidebar", "aside", "side", "related", "recommended", "widget", "popular",
             "trending", "more", "rail", "teaser", "complementary"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal",
               "overlay", "dialog", "paywall", "warning", "disclaimer"],
    "form": ["form", "login", "signup", "subscribe", "subscription", "newsletter", "search",
             "register", "contact"],
    "reader": ["comment", "comments", "commentlist", "respond", "reply", "replies", "disqus",
               "discussion", "reviews"],
    "share": ["share", "sharing", "social", "follow", "tags", "meta", "byline", "author", "rating"],
    "main": ["article", "content", "main", "post", "entry", "story", "body", "text", "blog",
             "articlebody", "maincontent", "page"],
}
_KIND = {word: kind for kind, words in HINTS.items() for word in words}
XMP_END = re.compile(r"</xmp(?=[\s/>])[^>]*>?", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hints(attributes: str) -> tuple[set, dict]:
    """Kinds that class, id and role name, and the attributes."""
    kinds: set = set()
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        found[name] = value
        if name in ("class", "id", "role", "itemprop"):
            for part in re.split(r"[\s_-]+", value):
                for piece in {part.lower(), *(x.lower() for x in _PIECE.findall(part))}:
                    if piece in _KIND:
                        kinds.add(_KIND[piece])
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or (
                name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            kinds.add("hidden")
    return kinds, found


def _unended(page: str, start: int) -> tuple[list, list]:
    """Positions of > and quotes from ``start``, and for each whether a tag that is
    read on from there, outside of quotes, never ends.  One pass from the end:
    a quote exchanges what follows outside and inside of quotes of its kind."""
    at = [m.start() for m in QUOTE.finditer(page, start)]
    never = [True] * (len(at) + 1)
    state = {"out": True, '"': True, "'": True}
    for k in range(len(at) - 1, -1, -1):
        c = page[at[k]]
        if c == ">":
            state["out"] = False
        else:
            state["out"], state[c] = state[c], state["out"]
        never[k] = state["out"]
    return at, never


class Node:
    """A block element (text is None) or a run of text (tag of its element)."""
    __slots__ = ("tag", "kinds", "attributes", "parent", "text", "words", "linked", "embedded")

    def __init__(self, tag, kinds, attributes, parent, text=None, words=0, linked=0.0,
                 embedded=0.0):
        self.tag, self.kinds, self.attributes, self.parent = tag, kinds, attributes, parent
        self.text, self.words, self.linked, self.embedded = text, words, linked, embedded


def parse(page: str | None) -> list[Node]:
    """Nodes in page order, a parent (its position) before its children; node 0
    is the root."""
    page = page or ""
    nodes = [Node("root", set(), {}, -1)]
    stack = [("root", 0)]               # open elements: (tag, node or None for inline)
    opened = defaultdict(list)          # positions of them by tag, and by scope
    barriers = {name: [] for name in SCOPES}
    unended = None                      # known after the first tag that quotes leave open
    xmp_ends = True                     # there may be another end tag of xmp
    at_node = 0
    links = 0                           # open links
    embeds = [0]                        # open elements of EMBED inside each open node
    foreign = 0                         # open elements of FOREIGN
    run: list = []                      # (text, linked?, embedded?)

    def flush():
        if run:
            text = " ".join(html.unescape("".join(x for x, _, _ in run)).split())
            if text:
                all_chars = sum(len(x) for x, _, _ in run)
                linked = sum(len(x) for x, a, _ in run if a) / all_chars
                embedded = sum(len(x) for x, _, e in run if e) / all_chars
                nodes.append(Node(nodes[at_node].tag, set(), {}, at_node, text,
                                  text.count(" ") + 1, linked, embedded))
            run.clear()

    def add(text):
        run.append((text, links > 0, embeds[-1] > 0))

    def pop_to(k):
        nonlocal at_node, links, foreign
        if any(node is not None for _, node in stack[k:]):
            flush()
        for tag, node in reversed(stack[k:]):
            opened[tag].pop()
            for name in _SCOPES_OF.get(tag, ()):
                barriers[name].pop()
            if tag == "a":
                links -= 1
            foreign -= tag in FOREIGN
            if node is not None:
                at_node = nodes[node].parent
                embeds.pop()
            else:
                embeds[-1] -= tag in EMBED
        del stack[k:]

    def push(tag, node):
        opened[tag].append(len(stack))
        for name in _SCOPES_OF.get(tag, ()):
            barriers[name].append(len(stack))
        stack.append((tag, node))

    def close(tags, scope):
        """End the innermost open element of ``tags`` within the scope."""
        k = max([opened[t][-1] for t in tags if opened[t]], default=0)
        if not k or barriers[scope] and barriers[scope][-1] > k:
            return False
        pop_to(k)
        return True

    pos, size = 0, len(page)
    while pos < size:
        start = page.find("<", pos)
        if start < 0:
            add(page[pos:])
            break
        loose = unended and unended[1][bisect_left(unended[0], start)]
        m = loose and LOOSE.match(page, start) or TOKEN.match(page, start)
        if not m:
            add(page[pos:start + 1])
            pos = start + 1
            continue
        if start > pos:
            add(page[pos:start])
        pos = m.end()
        if m[5] and unended is None:
            unended = _unended(page, start)
        tag = m[2] or m[5]
        if not tag:
            if page.startswith("<![CDATA[", start):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                add(" ")
            elif tag not in ("html", "body"):
                close({tag}, "none" if tag in BLOCK else "embed" if tag in EMBED else "block")
                if tag in APART:
                    add(" ")
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else size
            if tag not in ("script", "style"):
                add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close({"p"}, "cell")
                flush()
            elif tag in ("br", "img", "wbr", "input"):
                add("" if tag == "wbr" else " ")
            continue
        if tag in APART:
            add(" ")
        if attributes.endswith("/") and (foreign or tag in EMBED or tag in FOREIGN):
            continue
        kinds, found = hints(attributes) if attributes else (set(), {})
        literal = None
        if tag == "xmp":                # like pre, without markup up to its end tag, if any
            tag = "pre"
            if xmp_ends and (end := XMP_END.search(page, pos)):
                literal, pos = page[pos:end.start()], end.end()
            else:
                xmp_ends = False
        if tag in ("html", "body") and opened[tag]:
            continue
        while foreign and tag in BLOCK and close(FOREIGN, "foreign"):
            pass
        if tag in BLOCK and tag not in IN_P:
            close({"p"}, "paragraph")
        if tag in ENDS:
            for _ in range(2):
                if not close(ENDS[tag], "item"):
                    break
        drawn = foreign or tag in FOREIGN       # an icon doesn't break up a paragraph
        if tag in BLOCK or not drawn and ("-" in tag or kinds - {"main", "share"}):
            flush()
            nodes.append(Node(tag, kinds, found, at_node))
            at_node = len(nodes) - 1
            push(tag, at_node)
            embeds.append(0)
            if literal is not None:
                add(html.escape(literal))
                pop_to(len(stack) - 1)
        else:
            links += tag == "a"
            push(tag, None)
        foreign += tag in FOREIGN
        if stack[-1][1] is None:
            embeds[-1] += tag in EMBED
    flush()
    return nodes
