"""A small forgiving HTML tree: elements, their hashes, and the text of what stays."""

from __future__ import annotations

import hashlib
import html
import re

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])hidden(?![\w-])", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul", "caption",
}
#: What an opening tag ends, up to an element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Never main text.
DROPPED = {
    "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "nav", "footer", "aside", "form",
    "button", "select", "textarea", "input", "dialog", "menu", "head", "title", "audio", "video", "xmp",
}
#: Words that mark furniture as a whole class or id, or beside words of PLAIN: "ad", "site-footer".
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies",
    "consent", "popup", "modal", "newsletter", "subscribe", "sidebar", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "comment", "comments", "disqus", "login", "signup",
}
#: Words that say nothing about what an element holds.
PLAIN = {
    "site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "inner", "outer",
    "container", "wrapper", "wrap", "box", "block", "area", "bar", "list", "item", "items", "link", "links", "button",
    "buttons", "section", "slot", "unit", "panel", "content", "text", "header", "title", "body", "form", "id",
}
#: Like these and FURNITURE in other company ("notice", "comment-on-method"): only where at least
#: half of the element's text is the site's template.
AMBIGUOUS = {"notice", "notices", "menu", "share", "sharing", "social", "related", "widget", "skip"}
#: The page and its main parts, which are never a template.
WHOLE = {"html", "body", "head", "main", "article"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}


class Node:
    __slots__ = ("tag", "words", "strong", "weak", "role", "hidden", "children", "digest", "known", "size")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag = tag
        self.words: set[str] = set()
        self.strong = self.weak = False
        self.role = ""
        self.hidden = False
        self.children: list[Node | str] = []
        self.digest = b""
        self.known = self.size = 0
        for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
            name = (m[1] or "hidden").lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                for token in value.split():
                    parts = set(_NAME.findall(token))
                    self.words |= parts
                    if parts & FURNITURE:
                        plain = all(p in FURNITURE or p in PLAIN or p.isdigit() for p in parts)
                        self.strong, self.weak = self.strong or plain, True
                    self.weak = self.weak or bool(parts & AMBIGUOUS)
            elif name == "role":
                self.role = value.strip()
            elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                self.hidden = True

    def furniture(self, inside: bool) -> bool:
        """Whether the element is page furniture; ``inside``: within the article."""
        if self.tag in ("html", "body", "main"):
            return False
        if self.hidden or self.tag in DROPPED or self.role in ROLES or self.strong:
            return True
        return not inside and (self.tag == "header" or bool(self.words & {"header", "masthead"}))


class _Open:
    """The open elements, with the places of every name, so that no lookup walks the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """Ends the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


def parse(text: str) -> Node:
    """The tree of a page; missing and stray end tags are forgiven. Linear in the page."""
    root = Node("#page")
    opened = _Open(root)
    at = 0
    for m in iter(lambda: _TAG.search(text, at), None):
        if m.start() > at:
            opened.stack[-1].children.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = opened.last({tag})
            if place:
                opened.close(place)
            continue
        if tag in BLOCK:  # a block ends an open paragraph; no other block is open inside it
            place = opened.last({"p"})
            if place:
                opened.close(place)
        if tag in CLOSES:
            ended, bounds = CLOSES[tag]
            place = opened.last(ended)
            if place > opened.last(bounds):
                opened.close(place)
        node = Node(tag, m[3])
        opened.stack[-1].children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{tag}\b", re.I).search(text, at)
            end = text.find(">", close.end()) if close else -1
            node.children.append(text[at : close.start() if end >= 0 else len(text)])
            at = end + 1 if end >= 0 else len(text)
        elif tag not in VOID and not m[3].endswith("/"):
            opened.push(node)
    if at < len(text):
        opened.stack[-1].children.append(html.unescape(text[at:]))
    return root


def hashed(root: Node) -> None:
    """Gives every element the hash of its subtree: names, classes, and words of text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        h = hashlib.blake2b(f"{node.tag} {' '.join(sorted(node.words))}".encode(), digest_size=8)
        for child in node.children:
            h.update(b"t" + _SPACE.sub(" ", child).strip().encode("utf-8", "surrogatepass") if isinstance(child, str) else b"e" + child.digest)
        node.digest = h.digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def subtrees(root: Node) -> set[int]:
    """Every distinct subtree of the page."""
    out: set[int] = set()
    todo = [root]
    while todo:
        elements = [c for c in todo.pop().children if not isinstance(c, str)]
        todo += [e for e in elements if e.tag != "head"]
        out.update(_key(e.digest) for e in elements if e.children and e.tag not in WHOLE)
    return out


def neighbours(root: Node, recurring: set[int]) -> dict[int, int]:
    """Every recurring subtree of the page with the hash of what stands around its run.

    A run is recurring siblings side by side. One that fills its parent has the parent's
    neighbours, unless the parent is the page or its main part.
    """
    out: dict[int, int] = {}
    todo: list[tuple[Node, bytes]] = [(root, b"|")]
    while todo:
        node, around = todo.pop()
        units = [c for c in node.children if not isinstance(c, str) or c.strip()]
        known = [not isinstance(c, str) and c.tag not in WHOLE and _key(c.digest) in recurring for c in units]
        names = [c.encode("utf-8", "surrogatepass") if isinstance(c, str) else c.digest for c in units]
        before, last = [], b""
        for name, same in zip(names, known, strict=True):
            before.append(last)
            last = last if same else name
        after, last = [], b""
        for name, same in zip(reversed(names), reversed(known), strict=True):
            after.append(last)
            last = last if same else name
        after.reverse()
        for unit, same, left, right in zip(units, known, before, after, strict=True):
            if isinstance(unit, str) or unit.tag == "head":
                continue
            sides = left + b"|" + right if left or right else b"|" if node.tag in WHOLE else around
            if same:
                out.setdefault(_key(unit.digest), _key(hashlib.blake2b(sides, digest_size=8).digest()))
            todo.append((unit, sides))
    return out


def _weigh(root: Node, templates: set[int]) -> None:
    """Gives every element the length of its text, and of the part in template subtrees."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        inner = [c for c in node.children if not isinstance(c, str)]
        node.size = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.size for c in inner)
        node.known = node.size if _key(node.digest) in templates else sum(c.known for c in inner)


def _mostly_template(node: Node) -> bool:
    """Whether at least half of the element's text is in template subtrees."""
    return node.known > 0 and 2 * node.known >= node.size


def main_text(root: Node, templates: set[int]) -> str:
    """Blocks of the part with most of the page's text, without furniture and templates.

    The articles are that part if they hold at least half of it, else the main part if it
    does, else the page.
    """
    if templates:
        _weigh(root, templates)
    page = None
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main"):
        parts = _tops(root, wanted, templates)
        if parts:
            page = _text([root], root, templates) if page is None else page
            text = _text(parts, root, templates)
            if text and 2 * len(text) >= len(page):
                return text
    return _text([root], root, templates) if page is None else page


def _text(parts: list[Node], root: Node, templates: set[int]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    inside = parts[0] is not root
    for part in parts:
        todo: list[Node | str | None] = [part]
        while todo:
            node = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                line.append(node)
            elif node is not part and node.furniture(inside):
                continue
            elif templates and _key(node.digest) in templates:
                continue
            elif templates and node is not part and node.weak and _mostly_template(node):
                continue
            elif node.tag in ("br", "wbr"):
                line.append(" " if node.tag == "br" else "")
            else:
                block = node.tag in BLOCK or node is part
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(node.children)
    flush()
    return "\n\n".join(blocks)


def _tops(root: Node, wanted, templates: set[int]) -> list[Node]:
    """Outermost wanted elements outside page furniture, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and node.furniture(False):
            continue
        if templates and node.weak and _mostly_template(node):
            continue
        if node is not root and wanted(node):
            out.append(node)
            continue
        todo += reversed([c for c in node.children if not isinstance(c, str)])
    return out
