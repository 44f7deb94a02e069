"""HTML as a tree of block elements and text slots, tolerant of broken markup."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements that never hold content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup; it is no text of the page either.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed",
       "noframes"}
#: Elements inside a line of text: they break no block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
#: An opening tag that ends open elements of these names (within the nearest of the stops).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
STOPS = {"ul", "ol", "dl", "table", "select", "body"}
#: Paragraphs end where any block begins.
#: Deeper elements are not kept apart; their texts are slots of the last one kept.
DEPTH = 100
HOLDS_NO_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}

_OPEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?])")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_NUMBER = re.compile(r"\d+")


@dataclass
class Node:
    """An element, or a text slot (``tag`` is ``#``, ``text`` its characters)."""
    tag: str
    names: str = ""  # id, classes, role and item property, digits as one sign
    children: list[Node] = field(default_factory=list)
    text: str = ""
    linked: int = 0


def _names(attributes: str) -> str:
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("id", "class", "role", "itemprop"):
            found += _NUMBER.sub("0", html.unescape("".join(values))).lower().split()
    return " ".join(sorted(set(found)))


def _tokens(source: str):
    """(kind, name or text, attributes) with kind one of ``text``, ``open``, ``close``."""
    at, size = 0, len(source)
    while at < size:
        m = _OPEN.search(source, at)
        if not m:
            yield "text", source[at:], ""
            return
        if m.start() > at:
            yield "text", source[at:m.start()], ""
        if m[1]:
            end = source.find("-->", m.end())
            if end < 0:
                return  # an open comment lasts to the end
            at = end + 3
            continue
        end = _TAG_END.match(source, m.end())
        stop = end.end() if end else source.find(">", m.end()) + 1
        if not stop:
            return  # cut off within a tag
        at = stop
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            yield "close", name, ""
            continue
        attributes = source[m.end():stop - 1]
        if name in RAW:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if not close:
                return
            at = close.end()
            continue
        yield "open", name, attributes


def parse(source: str | None) -> Node:
    """The tree of a page. Text within inline elements belongs to the slot around it;
    slots without a visible character are left out; open elements end with the page."""
    root = Node("page")
    open_ = [root]
    links = 0
    pieces: list[str] = []
    linked = deeper = 0

    def end_slot():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                open_[-1].children.append(Node("#", text=text, linked=min(linked, len(text))))
            pieces.clear()
        linked = 0

    for kind, name, attributes in _tokens(source or ""):
        if kind == "text":
            pieces.append(name)
            linked += len(name) if links else 0
        elif name in INLINE:
            if name == "a":
                links = max(0, links + (1 if kind == "open" else -1))
            elif name in ("br", "img"):
                pieces.append(" ")
        elif kind == "open":
            end_slot()
            links = 0
            if name in VOID:
                continue
            if open_[-1].tag in HOLDS_NO_BLOCK and not deeper:
                open_.pop()
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in STOPS or name not in ENDS:
                    break
                if open_[i].tag in ENDS[name]:
                    del open_[i:]
                    if name not in ("tr", "tbody"):
                        break
            if len(open_) >= DEPTH:
                deeper += 1
                continue
            node = Node(name, _names(attributes))
            open_[-1].children.append(node)
            open_.append(node)
        else:
            end_slot()
            links = 0
            if deeper:
                deeper -= 1
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == name:
                    del open_[i:]
                    break
    end_slot()
    return root
