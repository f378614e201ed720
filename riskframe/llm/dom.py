"""A small tolerant HTML reader for main-text extraction (runs inside tasks).

Reads markup once into a tree of block elements; inline elements leave no node.
Every text belongs to the block that holds it.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from functools import lru_cache

# fixed sets of HTML element names
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var"}
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noframes", "xmp")
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu",
          "nav", "ol", "pre", "section", "table", "ul"}
SCOPE = {"table", "ul", "ol", "dl", "article", "section", "aside", "nav", "footer", "header", "main", "div", "body"}
CONTAINERS = {"html", "body", "div", "main", "section", "article", "header"}
# parts of a page that are never its main text
NOISE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "audio", "video",
              "canvas", *RAW}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu",
               "menubar", "toolbar", "tablist"}
NOISE_NAMES = re.compile(
    r"^(?:(?:site|page|global|top|main|sub|side|bottom|left|right|mobile)[-_]?)?"
    r"(?:header|footer|nav|navbar|navigation|menu|sidebar|masthead|topbar|toolbar)s?(?:[-_]\w+)*$"
    r"|^(?:\w+[-_])?(?:ads?|advs?|adverts?|advertisements?|advertising|adsense|sponsors?|sponsored|promos?|promotions?|banners?)"
    r"(?:[-_]\w+)*$"
    r"|^(?:\w+[-_])?(?:cookie|cookies|consent|gdpr|notice|notices|newsletter|subscribe|subscription|popup|modal|overlay|"
    r"alert|paywall)(?:[-_]?\w+)*$"
    r"|^(?:\w+[-_])?(?:comment|comments|commentlist|respond|reply|replies|disqus)(?:[-_]\w+)*$"
    r"|^(?:\w+[-_])?(?:share|sharing|social|related|recommended|breadcrumb|breadcrumbs|pagination|pager|widget|widgets)"
    r"(?:[-_]\w+)*$|^(?:skip[-_]?link|sr-only|hidden|visually-hidden|search-?(?:form|box))$", re.I)
MAIN_NAMES = re.compile(r"^(?:article|post|entry|story|page|main)?[-_]?(?:content|body|text|article)$", re.I)

_MARK = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>"
    r"|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\2\s*>|$)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S | re.I)
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """A block element: name, its path of names, whether it is noise, whether its
    name says main text, its children and texts in page order."""

    __slots__ = ("tag", "noise", "main", "items", "up", "inside")

    def __init__(self, tag: str, up: "Node | None", noise: bool = False, main: bool = False):
        self.tag, self.up, self.noise, self.main, self.items = tag, up, noise, main, []
        self.inside = tag == "article" or main or up is not None and up.inside      # of an article or main part


def _attributes(tag: str, raw: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element with these attributes is noise, and whether it names
    main text. A header inside an article belongs to it."""
    noise, main = tag in NOISE_TAGS or tag == "header" and not inside, tag == "main"
    if raw.strip(" /"):
        for m in _ATTR.finditer(raw):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if name in ("class", "id"):
                names = value.split()
                noise = noise or any(map(NOISE_NAMES.match, names))
                main = main or any(map(MAIN_NAMES.match, names))
            elif name == "role":
                noise = noise or value.lower() in NOISE_ROLES
                main = main or value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                noise = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                noise = True
    return noise, main


def parse(page: str) -> Node:
    root = at = Node("root", None)
    pos = 0

    def say(raw: str) -> None:
        if raw:
            at.items.append(html.unescape(raw) if "&" in raw else raw)

    for m in _MARK.finditer(page):
        say(page[pos:m.start()])
        pos = m.end()
        if m[1] is not None:
            say(m[1])
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag in INLINE and at.tag != tag:     # plain inline elements have no node
                continue
            if tag in VOID:
                at.items.append(" ")
                continue
            n = at
            while n is not root and n.tag != tag:
                if n.tag in SCOPE and tag in ("p", "li", "td", "th", "tr", "dt", "dd"):
                    n = root
                    break
                n = n.up
            if n is not root:
                at = n.up
            continue
        if tag in INLINE and not m[5].strip(" /"):
            continue
        if tag in VOID:
            at.items.append(" ")
            continue
        noise, main = _attributes(tag, m[5], at.inside)
        if tag in INLINE and not noise:
            continue
        if tag in ENDS_P or tag == "p":
            n = at
            while n is not root and n.tag not in SCOPE and n.tag != "p":
                n = n.up
            if n.tag == "p":
                at = n.up
        close, n = CLOSES.get(tag), at
        while close and n is not root and n.tag not in SCOPE:
            if n.tag in close:
                at = n.up
            n = n.up
        node = Node(tag, at, noise, main)
        at.items.append(node)
        if not m[5].rstrip().endswith("/") or tag in ENDS_P:
            at = node
    say(page[pos:])
    return root


@lru_cache(maxsize=1 << 16)
def step(path: str, tag: str) -> str:
    """The path of a child named ``tag``: a chained hash, as long at any depth."""
    return hashlib.blake2b(f"{path}/{tag}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def content_roots(root: Node) -> list[Node]:
    """The outermost articles, else the outermost main parts, else the page."""
    for want in (lambda n: n.tag == "article", lambda n: n.main):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.noise:
                continue
            if want(n):
                found.append(n)
            else:
                todo += [c for c in reversed(n.items) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def blocks(root: Node, path: str = "", noise: bool = False) -> list[tuple[str, str]]:
    """(path of names, text) of every run of text in a block, in page order, white
    space folded, without empty texts and, but for ``noise``, without noise elements."""
    out: list[tuple[str, str]] = []
    todo: list[tuple] = [(root, step(path, root.tag))]
    while todo:
        item, where = todo.pop()
        if isinstance(item, str):
            out.append((where, item))
            continue
        run: list[str] = []
        parts: list[tuple] = []
        for c in item.items:
            if isinstance(c, str):
                run.append(c)
                continue
            if run:
                parts.append((" ".join("".join(run).split()), where))
                run = []
            if noise or not c.noise:
                parts.append((c, step(where, c.tag)))
        if run:
            parts.append((" ".join("".join(run).split()), where))
        todo += reversed([p for p in parts if p[0] != ""])
    return out


def layout(root: Node) -> str:
    """The page's layout, without noise, in two steps: a hash of the set of paths of
    containers, then one of the set of all paths of names."""
    coarse, fine = set(), set()
    todo = [(root, "", True)]
    while todo:
        n, path, outer = todo.pop()
        path, outer = step(path, n.tag), outer and (n is root or n.tag in CONTAINERS)
        fine.add(path)
        if outer:
            coarse.add(path)
        todo += [(c, path, outer) for c in n.items if isinstance(c, Node) and not c.noise]
    return "/".join(hashlib.blake2b("\n".join(sorted(x)).encode(), digest_size=8).hexdigest() for x in (coarse, fine))


def text_key(path: str, text: str) -> str:
    return f"{path}#{zlib.crc32(text.encode('utf-8', 'surrogatepass')):08x}-{len(text)}"


PERIOD = 4          # siblings whose names repeat in steps of up to 4 are one step
WIDEST = 128        # a longer list of siblings has one node per name


def _fold_in(groups: list[list[Node]], child: Node) -> None:
    """Append a child; a step of names that repeats the one before it is folded into that."""
    groups.append([child])
    for k in range(1, PERIOD + 1):
        if len(groups) >= 2 * k and all(groups[i - k][0].tag == groups[i][0].tag for i in range(-k, 0)):
            for i in range(-k, 0):
                groups[i - k] += groups[i]
            del groups[-k:]
            return


def folded(root: Node) -> list[list]:
    """The tree for alignment, noise elements included, as lists over its nodes in page
    order: name, parent, texts (the keys of its block texts). Siblings whose names repeat in
    steps (p p p, or h2 p h2 p) are one step; longer lists than ``WIDEST`` fold all of one name."""
    names, ups, texts = [], [], []
    todo: list[tuple] = [([root], -1, "")]
    while todo:
        nodes, up, path = todo.pop()
        path, me = step(path, nodes[0].tag), len(names)
        found, groups = set(), []
        for n in nodes:
            run = []
            for c in n.items:
                if isinstance(c, str):
                    run.append(c)
                    continue
                if run:
                    found.add(" ".join("".join(run).split()))
                    run = []
                _fold_in(groups, c)
            if run:
                found.add(" ".join("".join(run).split()))
        if len(groups) > WIDEST:
            by_name: dict[str, list[Node]] = {}
            for g in groups:
                by_name.setdefault(g[0].tag, []).extend(g)
            groups = list(by_name.values())
        found.discard("")
        names.append(nodes[0].tag)
        ups.append(up)
        texts.append(sorted(text_key(path, t) for t in found))
        todo += [(g, me, path) for g in reversed(groups)]
    return [names, ups, texts]


def unfolded(tree: list[list]) -> list:
    """The nested form of :func:`folded`: [name, children, texts]."""
    nodes = [[name, [], keys] for name, keys in zip(tree[0], tree[2])]
    for node, up in zip(nodes, tree[1]):
        if up >= 0:
            nodes[up][1].append(node)
    return nodes[0]
