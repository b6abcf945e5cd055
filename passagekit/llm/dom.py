"""A forgiving reader of HTML into plain trees; it takes any string and never fails."""

from __future__ import annotations

import html as entities
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"))
#: A start tag ends an open element of these, unless one of the second list is open within it.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"\s+")


_LONG_NUMBER = re.compile(r"&#([xX]?)([0-9a-fA-F]{8,});?")


def decoded(text: str) -> str:
    """A text with its character references decoded; numbers too long for a character stand for the replacement character."""
    return entities.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1]}{m[2].lstrip('0') or '0'};" if len(m[2].lstrip("0")) < 8 else "\ufffd", text))


class Node:
    """An element, or a text (tag "#text"). `names` are the words of its class and id, `classes` those of its class alone, `role` that of role or itemprop."""

    __slots__ = ("tag", "names", "classes", "role", "children", "text", "home")

    def __init__(self, tag: str, text: str = "", names: str = "", role: str = "", classes: str = ""):
        self.tag, self.text, self.names, self.role, self.classes = tag, text, names, role, classes
        self.children: list[Node] = []
        self.home = None  # the node of the wrapper that it is aligned with

    def flat(self) -> str:
        """All text below, white space as single blanks."""
        parts: list[str] = []
        stack = [self]
        while stack:
            node = stack.pop()
            if node.tag == "#text":
                parts.append(node.text)
            else:
                parts.append(" ")
                stack.extend(reversed(node.children))
        return _BLANKS.sub(" ", "".join(parts)).strip()


def parse(page: str) -> Node:
    """The tree of a page below one root. Scripts, styles and the like, comments and declarations are left out."""
    root = Node("#root")
    stack = [root]
    at, low = 0, None
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(Node("#text", decoded(text) if "&" in text else text))
            continue
        tag = tag.lower()
        if token[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:  # a stray end tag of an inline element stays in its block
                    break
            continue
        names = role = classes = ""
        if token[3]:
            for m in _ATTRIBUTE.finditer(token[3]):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() in ("class", "id"):
                    names += " " + value
                    if m[1].lower() == "class":
                        classes += " " + value
                else:
                    role = value
        if tag in BLOCKS and tag not in ENDS:
            _close(stack, ("p",), ("article", "section", "div", "td", "th", "li", "table", "button"))
        if tag in ENDS:
            _close(stack, *ENDS[tag])
        node = Node(tag, "", names.strip(), role, classes)
        stack[-1].children.append(node)
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find("</" + tag, at)
            if end < 0:
                at = len(page) if tag in ("script", "style") else at
            else:
                at = end
            if end < 0 and tag not in ("script", "style"):
                stack.append(node)
        elif tag not in VOID and not (token[3] or "").rstrip().endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: tuple[str, ...], within: tuple[str, ...]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in within:
            return
