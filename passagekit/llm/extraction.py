"""Main texts of pages by wrappers that are induced from other pages of the same host."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.dom import BLOCKS, Node, RAW, parse

#: Pages that a wrapper is induced from and applied to; a host's pages are dealt evenly to such blocks.
BLOCK_PAGES = 32
#: Nodes that one with the same text counts for in a matching; rows of children with more pairs than `CELLS` are matched by numpy, a row
#: of sums at a time, with the same result.
SAME_TEXT, CELLS = 64, 1 << 16
#: A node is template if so many different pages have it, and this share of them has the same text in it.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.8
#: Most hosts whose numbers of pages are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Elements and words of class, id or role that never belong to an article (fixed values).
OUT_TAGS = RAW | frozenset("head nav footer aside form button select dialog menu object embed audio video canvas label input".split())
_OUT_WORD = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar\w*|foot(?:er)?|masthead|top-?bar|comments?|respond|"
    r"replies|disqus|cookies?\w*|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|sign-?up|login|share\w*|sharing|social|"
    r"related|recommend\w*|breadcrumbs?|pagination|pager|widget\w*|search\w*|toolbar|skip|copyright|legal|tags?|byline-ad)")
#: Words that may stand beside those in one name; any other word makes it a name of something else.
_SIDE_WORD = (
    r"(?:site|page|global|main|top|bottom|left|right|header|head|inner|outer|wrap(?:per)?|container|box|block|area|section|bar|panel|list|items?|"
    r"links?|buttons?|icons?|posts?|articles?|stories|story|form|results?|media|post|entry|primary|secondary|\d+)")
OUT_NAMES = re.compile(rf"(?:{_SIDE_WORD}[_-]+)*{_OUT_WORD}(?:[_-]+(?:{_OUT_WORD}|{_SIDE_WORD}))*|(?:site|page|global|top)?-?header")
#: Words that make a box be no part of an article even where it varies within one (fixed values).
_NEVER_WORD = r"(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed)?|promos?|comments?|replies|respond|disqus|shar(?:e|es|ing)|related|recommended|recommendations|newsletter|cookies?)"
NEVER_NAMES = re.compile(rf"(?:{_SIDE_WORD}[_-]+)*{_NEVER_WORD}(?:[_-]+(?:{_NEVER_WORD}|{_SIDE_WORD}))*")
#: Elements that are opened even without blocks within.
OPENED = frozenset("#root html body main article section".split())
#: Elements whose names are looked at: boxes, by class, and those without a meaning of their own by id too.
BOXES = frozenset("div section ul ol dl table header span details figure center".split())
ID_BOXES = frozenset(("div", "ul", "ol", "dl", "table"))
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: An article or main part is taken as such if it holds this share of the page's varying text that is no link.
MOST = 0.5
#: A list or box whose text is links for this share is a menu.
LINK_SHARE = 0.6


class Slot:
    """A node of a wrapper: how many different pages have it, its texts there, and the digests of what is below it."""

    __slots__ = ("label", "children", "pages", "texts", "seen", "rare")

    def __init__(self, label: str):
        self.label, self.pages, self.texts, self.rare = label, 0, Counter(), False
        self.seen: set[int] = set()
        self.children: list[Slot] = []

    def template(self) -> bool:
        return (self.pages >= TEMPLATE_PAGES and not self.rare and bool(self.texts)
                and self.texts.most_common(1)[0][1] >= TEMPLATE_SHARE * self.pages)


class Branch:
    """A node of a page to align: its children without blank texts, its number of nodes, its text if it is not opened, and a digest of all text (none: 0)."""

    __slots__ = ("label", "node", "children", "size", "text", "digest")

    def __init__(self, node: Node):
        self.node, self.children, self.size, self.text, self.digest = node, [], 1, None, 0
        self.label = "#text" if node.tag == "#text" else f"{node.tag}.{node.names}"


def branches(root: Node) -> Branch:
    """The branches of a page. An element without blocks within is one node, so that a paragraph is template as a whole or not at all."""
    top = Branch(root)
    order, stack = [], [top]
    while stack:
        branch = stack.pop()
        order.append(branch)
        branch.children = [Branch(c) for c in branch.node.children if c.tag != "#text" or not c.text.isspace()]
        stack.extend(branch.children)
    for branch in reversed(order):
        node = branch.node
        if node.tag == "#text":
            branch.text = node.text.strip()
        elif node.tag not in OPENED and all(c.text is not None and c.node.tag not in BLOCKS for c in branch.children):
            branch.text = node.flat() if branch.children else ""
            branch.children = []
        else:
            branch.size = 1 + sum(c.size for c in branch.children)
            found = [c.digest for c in branch.children if c.digest]
            branch.digest = hash((branch.label, *found)) if found else 0
        if branch.text:
            branch.digest = hash((branch.label, branch.text))
    return top


def _below(rows: list, digests, shapes: dict) -> list[tuple[int, set[int]]]:
    """For each tree a number of its shape (labels alone), and all digests in it."""
    out = []
    for top in rows:
        order, stack = [], [top]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        found: set[int] = set()
        own: dict[int, int] = {}
        for node in reversed(order):
            found.update(digests(node))
            own[id(node)] = shapes.setdefault((node.label, *(own[id(c)] for c in node.children)), len(shapes))
        out.append((own[id(top)], found))
    return out


def _weights(a: list[Slot], b: list[Branch], known: dict) -> Iterator[np.ndarray]:
    """For each node of a long row, its weights with all of the other row: those of `weight`, where labels differ 0.

    Trees without a like text weigh by their shapes alone, so these are taken once for each pair of shapes; only trees that
    share a text are matched one by one, and what that finds is not kept.
    """
    shapes, by_shape = known.setdefault("shapes", {}), known.setdefault("weights", {})
    sizes, deep = np.array([y.size for y in b], np.int64), np.array([bool(y.children) for y in b])
    labels: dict[str, list[int]] = {}
    same: dict[tuple, list[int]] = {}
    for j, y in enumerate(b):
        labels.setdefault(y.label, []).append(j)
        if y.digest:
            same.setdefault((y.label, y.digest), []).append(j)
    places = {label: np.array(js, np.int64) for label, js in labels.items()}
    inner = _below(b, lambda y: (y.digest,) if y.digest else (), shapes)
    numbers, holders = np.array([shape for shape, _ in inner], np.int64), {}
    for j, (_, found) in enumerate(inner):
        for digest in found if deep[j] else ():
            holders.setdefault(digest, []).append(j)
    for x in a:
        row = np.zeros(len(b), np.int64)
        js = places.get(x.label)
        if js is not None:
            row[js] = 1
            if x.children:
                ((shape, seen),) = _below([x], lambda s: s.seen, shapes)
                met = np.zeros(len(b), bool)
                for digest in seen.intersection(holders):
                    met[holders[digest]] = True
                for j in js[deep[js] & met[js]].tolist():
                    row[j] = weight(x, b[j], {"shapes": shapes, "weights": by_shape})
                apart = js[deep[js] & ~met[js]]
                for number, first in zip(*np.unique(numbers[apart], return_index=True)):
                    key = shape, int(number)
                    if key not in by_shape:
                        by_shape[key] = weight(x, b[apart[first]], {"shapes": shapes, "weights": by_shape})
                    row[apart[numbers[apart] == number]] = by_shape[key]
            for digest in x.seen:
                at = same.get((x.label, digest))
                if at:
                    row[at] = SAME_TEXT * sizes[at]
        yield row


def _long_matching(a: list[Slot], b: list[Branch], known: dict, paths: list | None = None) -> int:
    """The last sum of `matching`, a row at a time; `paths` gets for each row where its sums are those above, and those before."""
    above = np.zeros(len(b) + 1, np.int64)
    for weights in _weights(a, b, known):
        row = np.zeros(len(b) + 1, np.int64)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights), out=row[1:])
        if paths is not None:
            paths.append((np.packbits(row == above), np.packbits(row[1:] == row[:-1])))
        above = row
    return int(above[-1])


def matching(a: list[Slot], b: list[Branch], known: dict) -> list[list[int]]:
    """Simple tree matching of two rows of subtrees: the table of best sums for all their beginnings."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        row, above, label = table[i], table[i - 1], x.label
        for j, y in enumerate(b, 1):
            best = above[j] if above[j] >= row[j - 1] else row[j - 1]
            if label == y.label:
                through = above[j - 1] + weight(x, y, known)
                if through > best:
                    best = through
            row[j] = best
    return table


def weight(x: Slot, y: Branch, known: dict) -> int:
    """Nodes in the largest matching of two trees whose roots are alike; like texts count for many, so that constant members of a run meet."""
    above = 0
    while y.digest not in x.seen:
        a, b = x.children, y.children
        if not a or not b:
            return above + 1
        if len(a) > 1 or len(b) > 1:
            key = (id(x), id(y))
            if key not in known:
                known[key] = _long_matching(a, b, known) if len(a) * len(b) > CELLS else matching(a, b, known)[-1][-1]
            return above + 1 + known[key]
        above, x, y = above + 1, a[0], b[0]
        if x.label != y.label:
            return above
    return above + SAME_TEXT * y.size


def _pairs(a: list[Slot], b: list[Branch], known: dict) -> list[tuple[int, int]]:
    """The places of the nodes that the best matching of two rows binds."""
    if len(a) == 1 == len(b):
        return [(0, 0)] if a[0].label == b[0].label else []
    i, j, pairs = len(a), len(b), []
    if len(a) * len(b) > CELLS:
        paths: list = []
        _long_matching(a, b, known, paths)

        def bit(bits: np.ndarray, at: int) -> int:
            return bits[at >> 3] >> (7 - (at & 7)) & 1

        while i and j:
            if bit(paths[i - 1][0], j):
                i -= 1
            elif bit(paths[i - 1][1], j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return pairs[::-1]
    table = matching(a, b, known)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def align(wrapper: Slot, page: Branch, counts: bool) -> None:
    """Bind a page's branches to a wrapper's nodes, children by the best matching; new ones are added. Pages that do not count leave no texts."""
    known: dict = {}
    stack = [(wrapper, page)]
    while stack:
        slot, branch = stack.pop()
        branch.node.home = slot
        a, b = slot.children, branch.children
        pairs = _pairs(a, b, known) if a and b else []
        if counts:
            slot.pages += 1
            if branch.text:
                slot.texts[branch.text] += 1
        merged, done_a, done_b = [], 0, 0
        for i, j in [*pairs, (len(a), len(b))]:
            merged += a[done_a:i]
            for new in b[done_b:j]:
                merged.append(Slot(new.label))
                stack.append((merged[-1], new))
            if i < len(a) and j < len(b):
                merged.append(a[i])
                stack.append((a[i], b[j]))
            done_a, done_b = i + 1, j + 1
        if branch.digest:
            slot.seen.add(branch.digest)
        slot.children = merged


def mark_rare(wrapper: Slot) -> None:
    """Mark the members of runs of like siblings that few pages have, with all below them: what such pages share there may be their own."""
    stack = [wrapper]
    while stack:
        slot = stack.pop()
        most: dict[str, int] = {}
        for child in slot.children:
            most[child.label] = max(most.get(child.label, 0), child.pages)
        for child in slot.children:
            child.rare = slot.rare or child.pages < TEMPLATE_SHARE * most[child.label]
        stack.extend(slot.children)


def _outside(node: Node) -> bool:
    """By its tag or role, never part of an article."""
    if node.tag in OUT_TAGS or node.role in OUT_ROLES:
        return True
    return bool(node.tag == "article" and node.names and re.search(r"comment", node.names))


def _named(node: Node) -> bool:
    """By a whole word of its class (or id, of a plain box), a box that seldom belongs to an article."""
    if node.tag not in BOXES or not node.names:
        return False
    return any(OUT_NAMES.fullmatch(w) for w in (node.names if node.tag in ID_BOXES else node.classes).split())


def _never(node: Node) -> bool:
    """By a whole word of its class, a box of comments, adverts or offers, wherever it is."""
    return node.tag in BOXES and bool(node.classes) and any(NEVER_NAMES.fullmatch(w) for w in node.classes.split())


def _kind(node: Node) -> str | None:
    if node.tag == "article" or node.role == "articlebody":
        return "article"
    return "main" if node.tag == "main" or node.role == "main" else None


class Extractor:
    """Reads the main text out of an aligned page."""

    def __init__(self):
        self.sizes: dict[int, tuple[int, int]] = {}
        self.out: set[int] = set()

    def measure(self, root: Node) -> None:
        """Characters of varying text below each node, and those of them in links; and the nodes that are no part of an article.

        A header is none unless it is within an article or main part.
        """
        stack = [(root, False, False, False)]
        while stack:
            node, link, inside, done = stack.pop()
            if node.tag == "#text":
                n = 0 if self.constant(node) else len(node.text.strip())
                self.sizes[id(node)] = n, n if link else 0
            elif done:
                own = [(0, 0) if _named(node) else self.sizes[id(c)] for c in node.children]
                self.sizes[id(node)] = sum(x[0] for x in own), sum(x[1] for x in own)
            elif self.constant(node) or _outside(node) or _never(node) or (node.tag == "header" and not inside):
                self.out.add(id(node))
                self.sizes[id(node)] = 0, 0
            else:
                stack.append((node, link, inside, True))
                link, inside = link or node.tag == "a", inside or _kind(node) is not None
                for c in node.children:
                    c.home = c.home or node.home  # what is within an element that was not opened goes with it
                    stack.append((c, link, inside, False))

    @staticmethod
    def constant(node: Node) -> bool:
        home = node.home
        return home is not None and home.template()

    @staticmethod
    def decided(node: Node) -> bool:
        """Pages enough have the node to tell template from slot."""
        return node.home is not None and node.home.pages >= TEMPLATE_PAGES

    def main(self, root: Node) -> Node:
        """The largest article if it holds most varying text that is no link, else the main part, else the smallest box that holds most of it."""
        self.measure(root)
        best: dict[str, tuple[int, Node]] = {}
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag == "#text" or id(node) in self.out or _named(node):
                continue
            kind = _kind(node)
            n = self._plain(node)
            if kind and n and (kind not in best or n > best[kind][0]):
                best[kind] = n, node
            stack.extend(reversed(node.children))
        for kind in ("article", "main"):
            if kind in best and best[kind][0] >= MOST * self._plain(root):
                return best[kind][1]
        node = root
        while True:
            total, links = self.sizes.get(id(node), (0, 0))
            part = max(node.children, key=lambda c: self._plain(c), default=None)
            if part is None or part.tag not in BLOCKS or part.tag in ("p", "li", "td") or self._plain(part) < 0.8 * max(1, total - links):
                return node
            node = part

    def _plain(self, node: Node) -> int:
        n, links = self.sizes.get(id(node), (0, 0))
        return n - links

    def text(self, root: Node) -> str:
        """The blocks of the main part in page order; where it is no box of its own, or the wrapper cannot tell, without named boxes."""
        main = self.main(root)
        whole = main.tag in ("#root", "html", "body")
        blocks: list[str] = []
        parts: list[str] = []

        def end() -> None:
            line = " ".join("".join(parts).split())
            if line:
                blocks.append(line)
            parts.clear()

        stack: list = [main]
        while stack:
            node = stack.pop()
            if node is None:
                end()
            elif node.tag == "#text":
                if not self.constant(node):
                    parts.append(node.text)
            elif node is not main and (id(node) in self.out or self._menu(node)
                                       or ((whole or not self.decided(node)) and _named(node))):
                if node.tag in BLOCKS:
                    end()
            elif node.tag in BLOCKS:
                end()
                stack.append(None)
                stack.extend(reversed(node.children))
            elif node.tag == "br":
                parts.append(" ")
            else:
                stack.extend(reversed(node.children))
        end()
        return "\n".join(blocks)

    def _menu(self, node: Node) -> bool:
        n, links = self.sizes.get(id(node), (0, 0))
        return node.tag in ("ul", "ol", "dl") and links > 0 and links >= LINK_SHARE * n


def extract_block(pages: list[str | None]) -> list[str]:
    """Induce a wrapper from pages of one host and read their main texts by it.

    Equal pages have one vote. The wrapper is the merged tree of all pages, aligned one after another; pages of one
    host that are laid out in several ways keep their own branches in it.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # trees are matched as deep as they are
    wrapper, voted, trees = Slot("#root."), set(), []
    for page in pages:
        page = page or ""
        tree = parse(page)
        align(wrapper, branches(tree), page not in voted)
        voted.add(page)
        trees.append(tree)
    mark_rare(wrapper)
    return [Extractor().text(tree) for tree in trees]


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               block_pages: int = BLOCK_PAGES) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Pages of one host are dealt to blocks of about `block_pages`. In a block, trees of pages are aligned by simple tree matching
    into one wrapper; nodes whose text is the same on most of at least `TEMPLATE_PAGES` different pages are template, the other
    ones are slots. The main text is the article (else the main part, else the box with most varying text; the first two only
    if they hold most of the page's varying text) without template nodes, navigation, footers, asides, forms, scripts and styles.
    Boxes with a class of comments, adverts or offers are left out wherever they are, and headers outside an article; boxes named
    as menus or notices where the wrapper does not tell that they vary in the article. Like siblings are aligned one by one; nodes of the
    same text meet first, so a constant member of a run is template.

    A NULL html counts as empty and gives an empty text, as does a page without text; pages without a host in their URL (or
    NULL) are a host of their own. Keys may be NULL or repeat; repeated rows get equal texts when they meet. Other columns are not looked at.
    A host of one page has no template: only names and tags tell what is outside the article. Pages are shuffled once by
    (host, block), so that no host, however large, is one task.
    """
    host = F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))
    source = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    sizes = source.select(F.lower(host).alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    sizes = sizes.select("host", F.ceil(F.col("n") / block_pages).alias("blocks"))
    few = sizes.count() <= BROADCAST_HOSTS
    dealt = (
        source.withColumn("host", F.lower(host)).join(F.broadcast(sizes) if few else sizes, "host")
        .withColumn("block", F.pmod(F.xxhash64("key", "url", F.monotonically_increasing_id()), F.col("blocks")))
        .select("host", "block", "key", "url", "html")
    )
    kind = source.schema["key"].dataType.simpleString()

    def run(keys, rows):
        rows = rows.sort_by([("key", "ascending"), ("url", "ascending")])
        texts = extract_block(rows["html"].to_pylist())
        return rows.select(["key", "url"]).append_column("text", pa.array(texts, pa.string())).append_column(
            "n_chars", pa.array([len(t) for t in texts], pa.int64()))

    out = dealt.groupBy("host", "block").applyInArrow(run, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("key", key)
