"""Parse one HTML page into a small tree. Runs inside tasks; used by the section operators only."""

from __future__ import annotations

from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

# Elements without content, elements whose white space is kept, and elements whose
# text does not belong to the elements around them.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
PREFORMATTED = frozenset(["pre", "textarea"])
SET_APART = frozenset(["script", "style", "template", "rt", "rp"])

_BLANK = " \n\t\f\r"


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def elements(self):
        """All elements below this one, in document order."""
        pending = [iter(self.children)]
        while pending:
            for child in pending[-1]:
                if isinstance(child, Element):
                    yield child
                    pending.append(iter(child.children))
                    break
            else:
                pending.pop()

    def text(self) -> str:
        """The text inside, without comments and without text that is set apart further down."""
        kind = self.name if self.name in SET_APART else "text"
        parts, pending = [], [iter(self.children)]
        while pending:
            for child in pending[-1]:
                if isinstance(child, Element):
                    pending.append(iter(child.children))
                    break
                if child[0] == kind:
                    parts.append(child[1])
            else:
                pending.pop()
        return "".join(parts)


class _TreeBuilder(HTMLParser):
    """Void elements close at once; an end tag closes up to its nearest open match or is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Element("", {})
        self.open, self.data, self.closed_voids = [self.root], [], []
        self.apart, self.open_names = [], Counter()
        self.damaged = False

    def flush(self, kind: str | None = None) -> None:
        if not self.data:
            return
        text = "".join(self.data)
        self.data = []
        if not text.strip(_BLANK) and not any(self.open_names[name] for name in PREFORMATTED):
            text = "\n" if "\n" in text else " "
        if kind is None:
            kind = self.apart[-1] if self.apart else "text"
        self.open[-1].children.append((kind, text))

    def handle_starttag(self, tag, attrs):
        self.flush()
        element = Element(tag, {name: value or "" for name, value in attrs})
        self.open[-1].children.append(element)
        if tag in VOID:
            self.closed_voids.append(tag)
        else:
            self.open.append(element)
            self.open_names[tag] += 1
            if tag in SET_APART:
                self.apart.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.open[-1].children.append(Element(tag, {name: value or "" for name, value in attrs}))

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.closed_voids:
            self.closed_voids.remove(tag)
            return
        closing = self.open_names[tag] > 0
        while closing:
            name = self.open.pop().name
            self.open_names[name] -= 1
            if name in SET_APART:
                self.apart.pop()
            closing = name != tag

    def handle_data(self, data):
        self.data.append(data)

    def handle_entityref(self, name):
        self.data.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        digits, base = (name[1:], 16) if name[:1] in "xX" else (name, 10)
        digits = digits.lstrip("0") or "0"
        number = int(digits, base) if len(digits) <= 7 else -1
        if 0 <= number < 256:
            text = bytes([number]).decode("windows-1252", "ignore") or chr(number)
        elif 0 < number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF:
            text = chr(number)
        else:
            text = "\N{REPLACEMENT CHARACTER}"
        self.data.append(text)

    def parse_marked_section(self, i, report=1):
        """A marked section of an unknown kind is a comment up to its end."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            self.damaged = True
            return self.parse_bogus_comment(i)

    def special(self, kind, text):
        self.flush()
        self.data.append(text)
        self.flush(kind)

    def handle_comment(self, data):
        self.special("comment", data)

    def handle_decl(self, decl):
        self.special("comment", decl)

    def handle_pi(self, data):
        self.special("comment", data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.special("text", data[6:])
        else:
            self.special("comment", data)


def parse_reported(html: str) -> tuple[Element, bool]:
    """The tree of a page, and whether markup in it could not be read.

    Reading never fails: from a declaration that the reader gives up on, the rest of the page is a comment.
    """
    builder = _TreeBuilder()
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:
        builder.damaged = True
        line, column = builder.getpos()
        at = -1
        for _ in range(line - 1):
            at = html.find("\n", at + 1)
        builder.special("comment", html[at + 1 + column:])
    builder.flush()
    return builder.root, builder.damaged


def parse(html: str) -> Element:
    return parse_reported(html)[0]
