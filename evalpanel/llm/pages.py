"""Main text of web pages by wrapper induction over the pages of a host.

Pages are parsed to DOM trees in which runs of alike siblings are one repeated node. The trees of one host are aligned with a
common tree by simple tree matching, which counts the pages that have a node and the texts it holds there. Nodes whose text is
constant over pages are template; varying slots are content, unless they stand in a part that is never content (menus, headers and
footers of the page, asides, forms, scripts, styles; adverts, notices and comments by the words of their class, id or role). Where a
page marks its article or main part, content is sought in there only.

A host of more than ``BLOCK`` pages is dealt by hash into even blocks of about that many or fewer, each with its own template;
no block is a rest, and the same pages make the same blocks at any partitioning. If constant texts make up most of what a page
would show, the pages are copies of each other and the texts stay.

Defined results: a null, empty or markup-free page has its plain text (empty if none); a null url is a host of its own; repeated
rows give repeated results; unclosed tags end with what holds them; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.llm.common import sliced, table, written
from evalpanel.llm.registry import query

BLOCK = 64
#: A text is constant if it stands in this share of a block's different pages, and in three at least.
CONSTANT = 0.6
#: Constant texts that are a larger share of a page than this are the content of copies.
COPIES = 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=[a-zA-Z/!?])[^>]*\Z", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas video audio select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav footer aside form button dialog menu fieldset label input".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ASIDE_WORDS = frozenset(
    "ad adbox ads adsbygoogle adsense adslot adunit advert adverts advertisement advertising advertorial alert announcement aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer"
    " dialog discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promoted promotion"
    " recommended related reply replies respond responses share sharing sidebar sidenav signup skip social sponsor sponsored subnav subscribe subscription teaser toolbar topbar topnav"
    " widget complementary contentinfo search".split()
)


class Node:
    __slots__ = ("tag", "names", "children", "parent", "hidden", "block", "inside", "titled", "aside")

    def __init__(self, tag: str, names: str = "", hidden: bool = False, parent: Node | None = None):
        self.tag, self.names, self.hidden, self.parent = tag, names, hidden, parent
        self.children: list[Node | str] = []
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block  # the nearest block, or the page
        self.inside: bool = tag in ("article", "main") or parent is not None and parent.inside
        self.titled, self.aside = tag == "h1", None  # whether it holds a title; whether it is an aside, once known


def parse(html: str) -> Node:
    """The tree of a page; raw elements such as scripts keep no text."""
    root = here = Node("#page")
    at, n = 0, len(html)
    known: set[str] = set()  # tags that may be open
    while at < n:
        found = TOKEN.search(html, at)
        if found is None:
            here.children.append(html[at:])
            break
        if found.start() > at:
            here.children.append(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            up = here if tag in known else None
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            elif up is None:
                known.discard(tag)
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            up = here.block
            if up.tag == "p":
                here = up.parent
        if tag in ENDS:
            up = here if known & ENDS[tag] else root
            while up is not root and up.tag not in ENDS[tag] and up.tag not in HOLDERS[tag]:
                up = up.parent
            if up.tag in ENDS[tag]:
                here = up.parent
        names, hidden = "", False
        if found[3]:
            for key, value in NAMES.findall(found[3]):
                key, value = key.lower(), value.strip("\"'")
                if key == "style":
                    hidden = hidden or "display:none" in value.lower().replace(" ", "")
                elif key in ("hidden", "aria-hidden"):
                    hidden = hidden or key == "hidden" or value.lower() == "true"
                else:
                    names += " " + value
        node = Node(tag, names, hidden, here)
        here.children.append(node)
        up = here
        while node.titled and up is not None and not up.titled:
            up.titled, up = True, up.parent
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not found[3].endswith("/"):
            here = node
            known.add(tag)
    return root


def is_aside(node: Node) -> bool:
    """Whether the element is of a kind that is never content; found once per node of a whole tree."""
    if node.aside is None:
        node.aside = _is_aside(node)
    return node.aside


def _is_aside(node: Node) -> bool:
    if node.hidden or node.tag in NEVER:
        return True
    words = [w.lower() for w in LETTERS.findall(node.names)] if node.names else []
    if node.tag == "header" or "header" in words and node.tag not in HEADINGS:
        if not node.inside and (node.tag == "header" or not node.titled):
            return True
    return any(w in ASIDE_WORDS for w in words) or any(a + b in ASIDE_WORDS for a, b in zip(words, words[1:]))


def elements(node: Node) -> list[Node]:
    """The elements in a node, last first."""
    return [child for child in reversed(node.children) if not isinstance(child, str)]


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += elements(node)


def main_parts(root: Node) -> list[Node]:
    """The outermost articles that are not asides, else the main parts, else the body or the page."""
    outer: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    holds: set[Node] = set()
    for node in reversed(list(walk(root))):  # from the leaves up
        if node in holds or node.tag in ("article", "main") and not is_aside(node):
            holds.update((node, node.parent) if node.parent is not None else (node,))
    todo = [(child, frozenset()) for child in elements(root)]
    while todo:
        child, open_kinds = todo.pop()
        kind = "main" if child.tag == "main" or "main" in child.names.lower().split() else child.tag
        if kind in outer and kind not in open_kinds:
            if kind != "body" and is_aside(child):
                continue
            outer[kind].append(child)
            open_kinds |= {kind}
        elif is_aside(child) and (child.tag in NEVER or child.hidden or child not in holds):
            continue
        todo += [(inner, open_kinds) for inner in elements(child)]
    if outer["article"] and outer["main"]:
        size = {kind: sum(len(text) for _, text in blocks(outer[kind])) for kind in ("article", "main")}
        if size["article"] < size["main"] / 2:  # articles that are cards within something larger
            return outer["main"]
    return outer["article"] or outer["main"] or outer["body"] or [root]


class Path:
    """A path of labels, held as its last label and the path before; equal paths of a page are one object."""

    __slots__ = ("before", "label", "depth", "longer")

    def __init__(self, before: Path | None = None, label: str = ""):
        self.before, self.label, self.depth = before, label, 0 if before is None else before.depth + 1
        self.longer: dict[str, Path] = {}

    def to(self, label: str) -> Path:
        if label not in self.longer:
            self.longer[label] = Path(self, label)
        return self.longer[label]


def blocks(parts: list[Node]) -> list[tuple[Path, str]]:
    """(path of labels, text) of each block of text in page order, without asides."""
    out: list[tuple[Path, str]] = []
    held: list[str] = []
    top = Path()

    def flush(path: Path) -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((path, text))

    for part in parts:
        path = top.to(label(part))
        todo: list = [*reversed(part.children)]  # what is to come, and the paths to go back to
        back = [path]
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                held.append(child)
            elif child is None:  # the end of a block
                flush(back.pop())
            elif child.tag in ("br", "hr", "wbr"):
                held.append(" " if child.tag != "wbr" else "")
            elif is_aside(child):
                if child.tag in BLOCKS:
                    flush(back[-1])
            else:
                if child.tag in BLOCKS:
                    flush(back[-1])
                    back.append(back[-1].to(label(child)))
                    todo.append(None)
                todo += reversed(child.children)
        flush(path)
    return out


def label(node: Node) -> str:
    return f"{node.tag}.{node.names.strip()}" if node.names else node.tag


class Slot:
    """A node of the common tree: the pages that have it and what it holds there."""

    __slots__ = ("label", "children", "texts")

    def __init__(self, name: str):
        self.label, self.children = name, []
        self.texts: Counter = Counter()


def shape(found: list[tuple[Path, str]]) -> list:
    """Blocks as a tree (label, texts, children); alike neighbours without children of their own are one repeated node."""
    root: list = ["", [], []]
    last: list[tuple[Path | None, list]] = [(None, root)]  # the last node of each depth
    for path, text in found:
        missing = []
        while path.depth and not (path.depth < len(last) and last[path.depth][0] is path):
            missing.append(path)
            path = path.before
        node = last[path.depth][1]
        if missing:
            del last[path.depth + 1 :]
        for step in reversed(missing):
            node[2].append([step.label, [], []])
            node = node[2][-1]
            last.append((step, node))
        node[1].append(text)
    return root


def matchings(a: Slot, b: list) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching: for nodes of two trees (by id) the most nodes that match in order, and which children do.

    Nodes of which one has no children match in themselves alone, and have no entry.
    """
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        left, right = x.children, y[2]
        if (id(x), id(y)) in done or not left or not right:
            todo.pop()
            continue
        inner = [(u, v) for u in left if u.children for v in right if v[2] and u.label == v[0] and (id(u), id(v)) not in done]
        if inner:
            todo += inner
            continue
        rows = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, u in enumerate(left):
            for j, v in enumerate(right):
                size = done.get((id(u), id(v)), (1,))[0] if u.label == v[0] else 0
                rows[i + 1][j + 1] = max(rows[i + 1][j], rows[i][j + 1], rows[i][j] + size)
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        done[id(x), id(y)] = rows[-1][-1] + 1, pairs[::-1]
        todo.pop()
    return done


def merge(common: Slot, tree: list) -> None:
    """Aligns a page's tree with the common tree and adds to that what is new."""
    found = matchings(common, tree)
    todo = [(common, tree)]
    while todo:
        here, node = todo.pop()
        here.texts.update(set(node[1]))
        pairs = dict((j, i) for i, j in found.get((id(here), id(node)), (1, []))[1])
        children, taken = [], 0
        for j, child in enumerate(node[2]):
            if j in pairs:
                children += here.children[taken : pairs[j]]
                slot = here.children[pairs[j]]
                taken = pairs[j] + 1
            else:
                slot = Slot(child[0])
            todo.append((slot, child))
            children.append(slot)
        here.children = children + here.children[taken:]


def constants(common: Slot, tree: list, least: float, out: Counter) -> None:
    """Counts the texts of a page that are constant in the slots where they stand."""
    found = matchings(common, tree)
    todo = [(common, tree)]
    while todo:
        here, node = todo.pop()
        for text in node[1]:
            if here.texts[text] >= least:
                out[text] += 1
        todo += [(here.children[i], node[2][j]) for i, j in found.get((id(here), id(node)), (1, []))[1]]


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each of some pages of one host."""
    once = {html: blocks(main_parts(parse(html))) for html in set(pages) if html}
    found = [once[html] if html else [] for html in pages]
    different = {tuple(text for _, text in blocks_): k for k, blocks_ in enumerate(found) if blocks_}
    trees = {k: shape(found[k]) for k in different.values()}
    out = []
    if len(trees) >= 3:
        common = Slot("")
        for k in sorted(trees):
            merge(common, trees[k])
        least = max(3.0, CONSTANT * len(trees))
        for blocks_ in found:
            fixed: Counter = Counter()
            if blocks_:
                constants(common, shape(blocks_), least, fixed)
            size = sum(len(text) for _, text in blocks_)
            template = sum(len(text) for _, text in blocks_ if text in fixed)
            out.append(" ".join(text for _, text in blocks_ if text not in fixed or template > COPIES * size))
    else:
        out = [" ".join(text for _, text in blocks_) for blocks_ in found]
    return out


def main_text(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    Page counts by host come first, from the urls alone; of hosts of several blocks there are at most rows / ``block``. One
    shuffle then brings the pages of a block together.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    large = pages.groupBy(host.alias("host")).count().filter(F.col("count") > block)
    large = written(large.select("host", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    part = F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("blocks", F.lit(1))).cast("int").alias("part")
    given = pages.select(host.alias("host"), "page_id", "url", "html").join(large, "host", "left")
    rows = given.select("host", part, "page_id", "url", "html").repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held, last, same = None, [], None, {}

        def done() -> pa.RecordBatch:
            ids, urls, html = zip(*held)
            same.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(urls, kinds[1]), pa.array(extract(list(html)), pa.string())], ["page_id", "url", "text"])

        for batch in sliced(batches, block):
            kinds = batch.schema.field("page_id").type, batch.schema.field("url").type
            for name, part, page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (name, part) != last:
                    yield done()
                    held = []
                held.append((page_id, url, same.setdefault(html, html)))  # copies are held once
                last = name, part
        if held:
            yield done()

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


@query("op2_main_text")
def op2(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
