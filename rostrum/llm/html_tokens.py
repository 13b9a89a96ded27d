"""Tags and texts of an HTML page, and the element tree they make."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

#: One comment, declaration or tag; a quoted value may hold ``>``. A tag with a lone quote ends at the next ``>``. No part
#: is given back once taken, so a tag of any length costs its length.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[A-Za-z/][^<>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends these if they are open, up to one of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "li", "dt", "dd"}


class Element:
    __slots__ = ("tag", "key", "children")

    def __init__(self, tag: str, key: str):
        self.tag, self.key = tag, key
        self.children: list[Element | str] = []


def key_of(tag: str, attributes: str) -> str:
    """Tag name with its class, id and role words; digits do not tell elements apart."""
    words = sorted({re.sub(r"\d+", "", w) for _, v in ATTRIBUTE.findall(attributes) for w in v.strip("\"'").lower().split()} - {""}) if attributes else []
    return ".".join([tag, *words])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): text, open or close."""
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        slash, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if name is None:
            continue
        tag = name.lower()
        if slash:
            yield "close", tag, ""
            continue
        yield "open", tag, attributes
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", tag, ""


def tree(page: str) -> Element:
    """Elements with their texts (character references decoded); what is left open ends with its parent."""
    root = Element("#", "#")
    stack = [root]
    opened: Counter[str] = Counter()

    def end(tags: set[str], walls: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in walls:
                return

    for kind, value, attributes in tokens(page):
        if kind == "text":
            stack[-1].children.append(html.unescape(value))
        elif kind == "open":
            if value in CLOSES_P:
                end({"p"}, {"table", "td", "th", "article", "section", "div", "li", "button"})
            if value in ENDS:
                end(*ENDS[value])
            e = Element(value, key_of(value, attributes))
            stack[-1].children.append(e)
            if value not in VOID and not (attributes.rstrip().endswith("/") and value not in BLOCK):
                stack.append(e)
                opened[value] += 1
        else:
            end({value}, {"#"})
    return root
