"""A small HTML tree and the few selectors the page operators need, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these closes an open element of the listed names first.
CLOSES = {
    "p": {"p"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "pre": {"p"}, "table": {"p"}, "section": {"p"}, "article": {"p"}, "h1": {"p"}, "h2": {"p"},
    "h3": {"p"}, "h4": {"p"}, "h5": {"p"}, "h6": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}


class Node:
    """An element, or with tag '' a text."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """Elements below this one in document order, without recursion."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if n.tag:
                yield n
                stack.extend(reversed(n.children))

    def content(self, gap: str = "") -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag:
                stack.extend(reversed(n.children))
            else:
                out.append(n.text)
        return gap.join(x.strip() if gap else x for x in out if not gap or x.strip())

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def inside(self, *tags: str) -> bool:
        n = self.parent
        while n is not None:
            if n.tag in tags:
                return True
            n = n.parent
        return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        shut = CLOSES.get(tag, ())
        if self.at.tag in shut:
            self.at = self.at.parent or self.root
        node = self.at.add(Node(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.add(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.add(Node("", text=data))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_STEP = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[$^*]?=(?:'[^']*'|\"[^\"]*\"|[^\]]*))?\])*)")
_TEST = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([$^*]?)=['\"]?([^'\"\]]*)['\"]?)?\]")


def _fits(n: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m or (m.group(1) not in (None, "*", n.tag)):
        return False
    for mark, name, attr, op, value in _TEST.findall(m.group(2)):
        if mark == "." and name not in n.classes() or mark == "#" and n.attrs.get("id") != name:
            return False
        if attr:
            have = n.attrs.get(attr)
            ok = have is not None and {"": have == value, "$": have.endswith(value), "^": have.startswith(value), "*": value in have}[op] if value else have is not None
            if not ok:
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements that fit a selector list: tag, .class, #id, [attr], [attr=v], [attr$=v], descendants and children."""
    chains = [re.sub(r"\s*>\s*", " >", part.strip()).split() for part in re.split(r",(?![^\[]*\])", selector)]
    found = []
    for n in root.walk():
        for chain in chains:
            if not _fits(n, chain[-1].lstrip(">")):
                continue
            at, ok, direct = n, True, chain[-1].startswith(">")
            for step in reversed(chain[:-1]):
                at = at.parent
                while at is not None and not _fits(at, step.lstrip(">")) and not direct:
                    at = at.parent
                if at is None or not _fits(at, step.lstrip(">")):
                    ok = False
                    break
                direct = step.startswith(">")
            if ok:
                found.append(n)
                break
    return found


def first(root: Node, selectors: list[str]) -> Node | None:
    for s in selectors:
        if hits := select(root, s):
            return hits[0]
    return None
