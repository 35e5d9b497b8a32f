"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree of its block elements; runs of equal siblings (paragraphs, list
items) become one repeated node. The most frequent tree of a host is its seed, and every
layout's tree is aligned to the seed by simple tree matching. Evidence from all pages of
the host then decides about each node of the seed: one whose text most likely stands on
one of some other pages is template (whatever the number of the host's pages), and so is one
whose texts stand on other hosts as well, one that holds hardly anything but links is a menu, and nodes whose
text varies are slots that hold content.

What HTML itself says helps where a host can't show it: menus, footers, asides, buttons
and comments are never the article; other hints (forms, headers, class names) fall if
the element holds the page's heading, its marked article or nearly all of its text; and
if the element that a page marks as its article holds most of what is left, only that counts.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, rows, stored, utf8

MIN_PAGES = 5  # different pages of a host from which a node can be called template
OTHERS = 200  # pages of the host among which a text is looked for; all others, if there are fewer
SHARED = 0.8  # chance that a page's text in a node stands on one of OTHERS other pages, from which the node is template
HOSTS = 3  # hosts on which a text must stand to count as shared, wherever it stands (not in a host's largest node)
SHARED_IN_ARTICLE = 0.5  # chance that it stands on one other page, inside an element that pages mark as their article
LINKED = 0.6  # share of a node's characters within links from which it is a menu, outside such an element
MOST = 0.9  # share of a page's text that no element beside the article holds
WIDE = 64  # children from which equal ones are merged wherever they stand; of two elements with more, equal children match first
DEEP = 150  # levels of the tree that are told apart; what is deeper belongs to the element at this level

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul button".split()
)
#: Opening one of the keys ends an open element of the values, up to the next element that holds others.
IMPLIED_END = {
    **{t: frozenset(["p"]) for t in BLOCK - {"html", "head", "body", "td", "th", "tr", "li", "dd", "dt", "option", "caption", "tbody", "thead", "tfoot", "legend", "summary", "button"}},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]), "tbody": frozenset(["tbody", "thead", "tr", "td", "th", "p"]), "tfoot": frozenset(["tbody", "thead", "tr", "td", "th", "p"]), "body": frozenset(["head"]),
}
HOLDERS = frozenset("html body article aside blockquote div dl fieldset figure footer form header main nav ol section table td th ul menu button details".split())

#: Elements, roles, and class or id words that mark something else than the article.
SURE_TAGS = frozenset("nav footer aside button select menu object svg canvas audio video math head".split())
SURE_ROLES = frozenset("navigation contentinfo complementary search menu menubar toolbar advertisement".split())
SURE_NAMES = frozenset("comments comment disqus reply replies nav navbar navigation menu menubar breadcrumb breadcrumbs footer site-footer sidebar ad ads advert adverts advertisement sponsored".split())
HINT_TAGS = frozenset("header form dialog".split())
HINT_ROLES = frozenset("banner form dialog alert".split())
HINT_NAMES = frozenset(
    "banner sponsor promo topbar masthead header site-header aside widget widgets related recommended share sharing social "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login form search pagination pager copyright".split()
)
ARTICLE_NAMES = frozenset("article article-body articlebody post-content entry-content story-body main-content".split())

#: A class or id word is a hint if a part of it is one of these, unless it starts with a word that takes it back.
HINT_PARTS = (SURE_NAMES | HINT_NAMES) - {"form", "header", "reply", "replies", "search"}
NO_HINT = frozenset("no not non has have with without is hide hidden".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")


class Scanner:
    """Finds the tags of a page one after the other, in time that grows with the page alone, however it is malformed.

    A tag ends at the first ">" outside of quotes, or at the first one at all if quotes don't close.
    What can't be closed any more is known from the last place of each closing mark, and quotes
    from which no end was reached are remembered, so nothing is looked through twice in vain.
    """

    def __init__(self, source: str):
        self.source = source
        self._last = {c: source.rfind(c) for c in (">", '"', "'", "]]>")}
        self._vain: set[int] = set()  # opening quotes from which no end of a tag is reached

    def end_of_raw(self, tag: str, at: int) -> int:
        """Where text that isn't markup ends, its end tag included."""
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.source, at)
        return self.source.find(">", m.end()) + 1 if m and m.end() <= self._last[">"] else len(self.source)

    def _end_of_tag(self, at: int) -> int:
        walked = []
        here = at
        while m := _QUOTE_OR_END.search(self.source, here):
            if m[0] == ">":
                return m.end()
            if m.start() >= self._last[m[0]] or m.start() in self._vain:
                break
            walked.append(m.start())
            here = self.source.find(m[0], m.end()) + 1
        self._vain.update(walked)
        return self.source.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Begin, end, whether it is an end tag, name (empty for comments and the like) and the rest of the next tag."""
        source, last = self.source, self._last
        while (begin := source.find("<", at)) >= 0:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(source), False, "", ""
            if begin > last[">"]:
                return None
            if source.startswith("<![CDATA[", begin) and begin < last["]]>"]:
                return begin, source.find("]]>", begin) + 3, False, "", ""
            if source.startswith(("<!", "<?"), begin):
                return begin, source.find(">", begin) + 1, False, "", ""
            closing = source.startswith("</", begin)
            if m := _NAME.match(source, begin + 1 + closing):
                end = self._end_of_tag(m.end())
                return begin, end, closing, m[0].lower(), source[m.end() : end - 1]
            at = begin + 1
        return None


@dataclass
class Node:
    label: str
    above: Node | None = None
    sure: bool = False  # it is something else than the article
    hint: bool = False  # it seems to be
    article: bool = False  # it or one above is marked as the article
    level: int = 0
    children: list[Node] = field(default_factory=list)
    shape: str = ""
    number: int = -1
    chrome: bool = False  # it or one above is something else than the article, by the hints that hold
    size: int = 0  # characters of its text and of what is below
    marked: bool = False  # it or one below is a first-level heading or marked as the article


@dataclass
class Page:
    root: Node
    blocks: list[tuple[Node, str]]  # in page order: text with single spaces, not empty
    links: list[int]  # characters within links of each block
    nodes: list[Node]  # in page order
    shape: str = ""


def _attributes(text: str) -> tuple[str, frozenset[str], str]:
    """Class that names the element in its label, all class and id words, role or article mark."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if "=" in text else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    role = "articlebody" if found.get("itemprop", "").lower() == "articlebody" else found.get("role", "").lower()
    return found.get("class", found.get("id", "")).lower().split(" ")[0], frozenset(names), role


def _hinting(name: str) -> bool:
    parts = re.split("[-_]+", name)
    return len(parts) > 1 and parts[0] not in NO_HINT and not HINT_PARTS.isdisjoint(parts)


def parse(source: str) -> Page:
    """Tree of block elements and text blocks of a page; tolerates unclosed and stray tags, any depth and width."""
    root = Node("#")
    nodes = [root]
    stack: list[tuple[str, Node]] = [("#", root)]
    blocks: list[tuple[Node, str]] = []
    links: list[int] = []
    pending: list[str] = []
    linked: list[str] = []  # the parts of pending that stand within a link
    scanner, at, inside = Scanner(source), 0, 0
    # places in the stack of each open tag, of blocks and of elements that hold others
    open_at: dict[str, list[int]] = {}
    blocks_at, holders_at = [0], [0]

    def push(tag: str, node: Node) -> None:
        for where in (open_at.setdefault(tag, []), *([blocks_at] if tag in BLOCK else []), *([holders_at] if tag in HOLDERS else [])):
            where.append(len(stack))
        stack.append((tag, node))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop()[0]
            open_at[tag].pop()
            if tag in BLOCK:
                blocks_at.pop()
            if tag in HOLDERS:
                holders_at.pop()

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                blocks.append((stack[-1][1], text))
                links.append(min(len(text), len(" ".join(html.unescape(" ".join(linked)).split()))) if linked else 0)
            pending.clear()
            linked.clear()

    while m := scanner.next(at):
        begin, end, closing, tag, rest = m
        if begin > at:
            pending.append(source[at:begin])
            if inside:
                linked.append(pending[-1])
        at = end
        if not tag:
            continue
        if closing:
            if tag in BLOCK:
                flush()
            if tag == "a":
                inside = 0
            depth = open_at[tag][-1] if open_at.get(tag) else 0
            # a stray inline end tag doesn't end the block that it stands in
            if depth and (tag in BLOCK or blocks_at[-1] < depth):
                pop_to(depth)
            continue
        if tag in RAW:
            at = scanner.end_of_raw(tag, at)
            if tag == "textarea":
                pending.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pending.append(" ")
            continue
        if tag in BLOCK:
            flush()
            ended = IMPLIED_END.get(tag, frozenset())
            while depth := max((open_at[t][-1] for t in ended if open_at.get(t)), default=0):
                if depth < holders_at[-1]:
                    break
                pop_to(depth)
                if stack[-1][0] not in ended:
                    break
        if rest.endswith("/") and tag not in BLOCK:
            continue
        above = stack[-1][1]
        if tag == "a":
            inside = 1
        if tag not in BLOCK and tag not in SURE_TAGS:
            push(tag, above)  # inline: its text belongs to the block around it
            continue
        name, names, role = _attributes(rest)
        article = tag in ("article", "main") or role in ("main", "article", "articlebody") or bool(names & ARTICLE_NAMES)
        named = tag not in ("html", "body", "main", "article")
        sure = tag in SURE_TAGS or role in SURE_ROLES or named and bool(names & SURE_NAMES)
        # the article's own header belongs to it
        hint = tag in HINT_TAGS and not (tag == "header" and above.article) or role in HINT_ROLES or named and (bool(names & HINT_NAMES) or any(map(_hinting, names)))
        node = Node(f"{tag}.{re.sub('[^a-z0-9_-]', '', name)}" if name else tag, above, sure, hint, above.article or article, above.level + 1, marked=article or tag == "h1")
        above.children.append(node)
        nodes.append(node)
        push(tag, node)
    pending.append(source[at:])
    if inside:
        linked.append(pending[-1])
    flush()
    page = Page(root, blocks, links, nodes)
    _judge(page)
    page.shape = _compress(page)
    _number(page)
    return page


def _judge(page: Page) -> None:
    """Which elements are something else than the article, by the hints that hold."""
    for n, t in page.blocks:
        n.size += len(t)
    for n in reversed(page.nodes):  # what is below comes first
        if n.above is not None:
            n.above.size += n.size
            n.above.marked |= n.marked and not n.sure
    whole = max(page.root.size, 1)
    for n in page.nodes:
        if n.above is not None:
            held = n.size > MOST * whole or n.hint and not n.sure and n.marked and not n.label.startswith("header")
            n.chrome = n.above.chrome or (n.sure or n.hint) and not held


def _compress(page: Page) -> str:
    """Shape of the page's tree: children without text are left out, runs of equal children become one with a star.

    An element with over WIDE runs of children has each different child once, with a star; one that is DEEP
    down is a leaf that stands for all below.
    """
    holding = {id(n) for n, _ in page.blocks}
    for node in reversed(page.nodes):
        parts: list[str] = []
        if node.level < DEEP:
            for child in node.children:
                if child.shape and not (parts and parts[-1].rstrip("*") == child.shape):
                    parts.append(child.shape)
                elif child.shape and parts[-1][-1] != "*":
                    parts[-1] += "*"
            if len(parts) > WIDE:
                parts = [p + "*" for p in dict.fromkeys(p.rstrip("*") for p in parts)]
        if parts or node.size and (id(node) in holding or any(c.size for c in node.children)) or node.label == "#":
            node.shape = node.label + (f"({','.join(parts)})" if parts else "")
    return page.root.shape


def _number(page: Page) -> None:
    """Gives each node its number in the compressed tree, in preorder; merged siblings share theirs, and what a leaf stands for has the leaf's."""
    count = 0
    todo: list[list[Node]] = [[page.root]]  # elements that one compressed node stands for
    while todo:
        nodes = todo.pop()
        for n in nodes:
            n.number = count
        groups: list[dict[object, list[Node]]] = []
        if "(" in nodes[0].shape:
            for n in nodes:
                shapes = [c.shape for c in n.children if c.shape]
                runs = 1 + sum(x != y for x, y in zip(shapes, shapes[1:], strict=False))
                group: dict[object, list[Node]] = {}
                run, before = 0, None
                for c in n.children:
                    if c.shape:
                        run += before is not None and c.shape != before
                        before = c.shape
                        group.setdefault(c.shape if runs > WIDE else run, []).append(c)
                groups.append(group)
            ordered = [list(g.values()) for g in groups]
            todo += [[c for o in ordered for c in o[k]] for k in range(len(ordered[0]) - 1, -1, -1)]
        count += 1
    for n in page.nodes:
        if n.number < 0 and n.above is not None:
            n.number = n.above.number


@dataclass
class Shape:
    label: str
    number: int
    children: list[Shape]
    key: int = 0  # equal for equal subtrees
    size: int = 1


def read_shape(text: str) -> Shape:
    """The tree of a shape's text."""
    root = Shape("", -1, [])
    stack, every = [root], []
    for token in re.findall(r"[^(),]+|[()]", text):
        if token == "(":
            stack.append(stack[-1].children[-1])
        elif token == ")":
            stack.pop()
        elif token != "*":  # the star after a closed group
            stack[-1].children.append(Shape(token.rstrip("*"), len(every), []))
            every.append(stack[-1].children[-1])
    for node in reversed(every):
        node.key = hash((node.label, *(c.key for c in node.children)))
        node.size += sum(c.size for c in node.children)
    return root.children[0]


def align(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the greatest number of node pairs that keep order and parents, and the pairs (a, b).

    Equal subtrees match whole, and equal children at both ends match each other. What is left
    between goes by a table, or, for more than WIDE by WIDE children, by keys: equal children first,
    then those of one label in turn, so that time grows with the children.
    """
    if a.label != b.label:
        return 0, []
    if a.key == b.key:
        return a.size, [(a.number + k, b.number + k) for k in range(a.size)]
    x, y = a.children, b.children
    pairs, total, low = [(a.number, b.number)], 1, 0
    while low < min(len(x), len(y)) and x[low].key == y[low].key:
        total += x[low].size
        pairs += align(x[low], y[low])[1]
        low += 1
    tail = 0
    while tail < min(len(x), len(y)) - low and x[-1 - tail].key == y[-1 - tail].key:
        total += x[-1 - tail].size
        pairs += align(x[-1 - tail], y[-1 - tail])[1]
        tail += 1
    x, y = x[low : len(x) - tail], y[low : len(y) - tail]
    n, m = len(x), len(y)
    if n * m > WIDE * WIDE:
        return _align_by_key(x, y, total, pairs)
    pair = [[align(u, v) for v in y] for u in x]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + pair[i - 1][j - 1][0])
    i, j = n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += pair[i][j][1]
    return best[n][m] + total, pairs


def _align_by_key(x: list[Shape], y: list[Shape], total: int, pairs: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    for key in (lambda c: c.key, lambda c: c.label):
        waiting: dict[object, deque[Shape]] = {}
        for v in y:
            waiting.setdefault(key(v), deque()).append(v)
        left = []
        for u in x:
            if held := waiting.get(key(u)):
                n, met = align(u, held.popleft())
                total += n
                pairs += met
            else:
                left.append(u)
        x, y = left, sorted((v for held in waiting.values() for v in held), key=lambda v: v.number)
    return total, pairs


def host_of(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").lower()
    except ValueError:
        return ""


def main_text(page: Page, template: set[int], to_seed: dict[int, int]) -> str:
    """Content blocks in page order, joined by one space; the same as extract_main_text() for one page."""
    left = [(n, t) for n, t in page.blocks if not n.chrome and to_seed.get(n.number, -1) not in template]
    marked = [(n, t) for n, t in left if n.article]
    if marked and 2 * sum(len(t) for _, t in marked) >= sum(len(t) for _, t in left):
        left = marked
    return " ".join(t for _, t in left)


#: A page's blocks: node number, text, marked as something else than the article, marked as the article.
BLOCKS = "array<struct<node: int, text: string, chrome: boolean, article: boolean>>"
#: Its nodes that hold text: number, hash of the text, characters, those within links, in the marked article.
SLOTS = "array<struct<node: int, hash: bigint, size: int, linked: int, article: boolean>>"


def _slots(page: Page) -> dict[int, tuple[list[str], int, bool]]:
    out: dict[int, tuple[list[str], int, bool]] = {}
    for (n, t), linked in zip(page.blocks, page.links, strict=True):
        texts, before, article = out.get(n.number, ([], 0, n.article))
        texts.append(t)
        out[n.number] = (texts, before + linked, article)
    return out


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, name (of the host), host (its hash), layout (hash of the shape), shape, page (hash of the whole text), blocks, slots; pages: page_id, url, html."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(0, batch.num_rows, 50):
                part = batch.slice(k, 50)
                found = [parse(d.decode()) for d in utf8(part, "html")]
                hosts = [host_of(u or "") for u in part.column("url").to_pylist()]
                # a text that differs by the host's name alone is the same
                digest = lambda texts, host: xxhash.xxh64_intdigest("\n".join(texts).replace(host, "") if host else "\n".join(texts)) >> 1
                slots = [[{"node": n, "hash": digest(t, h), "size": sum(map(len, t)), "linked": linked, "article": article} for n, (t, linked, article) in _slots(p).items()] for p, h in zip(found, hosts, strict=True)]
                blocks = [[{"node": n.number, "text": t, "chrome": n.chrome, "article": n.article} for n, t in p.blocks] for p in found]
                columns = {
                    "name": (pa.string(), hosts),
                    "host": (pa.int64(), [xxhash.xxh64_intdigest(h) >> 1 for h in hosts]),
                    "layout": (pa.int64(), [xxhash.xxh64_intdigest(p.shape) >> 1 for p in found]),
                    "shape": (pa.string(), [p.shape for p in found]),
                    "page": (pa.int64(), [xxhash.xxh64_intdigest("\n".join(t for _, t in p.blocks)) >> 1 for p in found]),
                    "blocks": (pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("chrome", pa.bool_()), ("article", pa.bool_())])), blocks),
                    "slots": (pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("linked", pa.int32()), ("article", pa.bool_())])), slots),
                }
                own = rows(columns)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *own.columns], names=["page_id", "url", *own.schema.names])

    return pages.mapInArrow(run, f"page_id bigint, url string, name string, host bigint, layout bigint, shape string, page bigint, blocks {BLOCKS}, slots {SLOTS}")


def induce_wrappers(parsed: DataFrame) -> DataFrame:
    """host (its hash), layout, to_seed (the seed's node of each node, -1: none), dropped (the host's template and menu nodes), n_template_nodes.

    One row for each layout of a host. Only counts meet: the host's pages are never in one task.
    """
    layouts = stored(parsed.groupBy("host", "layout").agg(F.count("*").alias("n"), F.first("shape").alias("shape")), "layouts")
    seeds = layouts.groupBy("host").agg(F.max_by("shape", F.struct("n", "layout")).alias("seed"))

    def fit(batches: Batches) -> Batches:
        for batch in batches:
            found = []
            for shape, seed in zip(batch.column("shape").to_pylist(), batch.column("seed").to_pylist(), strict=True):
                own, other = read_shape(shape), read_shape(seed)
                to_seed = [-1] * own.size
                for x, y in align(own, other)[1]:
                    to_seed[x] = y
                found.append(to_seed)
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(found, type=pa.list_(pa.int32()))], names=["host", "layout", "to_seed"])

    aligned = stored(layouts.join(seeds, "host").select("host", "layout", "shape", "seed").mapInArrow(fit, "host bigint, layout bigint, to_seed array<int>"), "alignments")
    # equal pages of a host count once
    single = parsed.select("host", "layout", "page", "slots").dropDuplicates(["host", "page"])
    slots = single.join(aligned, ["host", "layout"]).select("host", "to_seed", F.explode("slots").alias("s"))
    seen = slots.select("host", F.get("to_seed", F.col("s.node")).alias("node"), "s.hash", "s.size", "s.linked", "s.article").where("node >= 0")
    by_text = seen.groupBy("host", "node", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.max("article").alias("article"))
    by_text = stored(by_text, "evidence")
    by_node = by_text.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.max("article").alias("article"))
    largest = by_node.groupBy("host").agg(F.max_by("node", F.struct(F.col("size") - F.col("linked"), "node")).alias("largest"))
    by_node = by_node.where(F.col("pages") >= MIN_PAGES).join(largest, "host").withColumn("may_travel", ~F.col("article") & (F.col("node") != F.col("largest")))
    travelling = by_text.groupBy("hash").agg(F.countDistinct("host").alias("hosts")).where(F.col("hosts") >= HOSTS).select("hash", F.lit(True).alias("travels"))
    same = (F.col("n") - 1) / (F.col("pages") - 1)  # the part of the other pages with this text
    others = F.when(F.col("article"), F.lit(1)).otherwise(F.least(F.lit(OTHERS), F.col("pages") - 1))
    likely = F.when(F.col("travels") & F.col("may_travel"), F.lit(1.0)).otherwise(1 - F.pow(1 - same, others))
    met = by_text.select("host", "node", "hash", "n").join(travelling, "hash", "left").join(by_node, ["host", "node"])
    by_node = met.groupBy("host", "node").agg(F.sum(F.col("n") / F.col("pages") * likely).alias("shared"), *[F.first(c).alias(c) for c in ("size", "linked", "article")])
    template = F.col("shared") >= F.when(F.col("article"), F.lit(SHARED_IN_ARTICLE)).otherwise(F.lit(SHARED))
    menu = ~F.col("article") & (F.col("linked") >= F.col("size") * LINKED)
    out = by_node.where(template | menu).groupBy("host").agg(F.collect_set("node").alias("dropped"))
    return stored(aligned.join(out, "host", "left").withColumn("n_template_nodes", F.greatest(F.size("dropped"), F.lit(0)).cast("bigint")), "wrappers")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, text, n_chars, n_template_nodes, n_template_chars, n_hint_chars: one row per input row.

    n_template_chars counts what the host's wrapper took, n_hint_chars what the page's own
    marks took of the rest.
    Null html counts as empty; pages without a host share the empty host; text is empty if
    none is left; if the wrapper would take all that the hints leave, or all of the marked
    article, it doesn't count for that;
    repeated rows are extracted each, but equal pages of a host count once for its
    wrapper; very long, deep and wide pages are read whole; an empty table gives an empty
    table; other columns are not read. Each page is parsed once. A host's wrapper adds
    up over tasks, so a host with a third of all pages is no burden to a single one;
    parsed pages are only shuffled if the wrappers are too large for Spark to broadcast.
    """
    kept = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    parsed = stored(parse_pages(kept), "pages")
    met = parsed.drop("shape", "slots", "page").join(induce_wrappers(parsed), ["host", "layout"])
    dropped = F.coalesce("dropped", F.expr("CAST(array() AS ARRAY<INT>)"))
    met = met.withColumn("unwrapped", F.filter("blocks", lambda b: ~F.array_contains(dropped, F.get("to_seed", b["node"])))).withColumn("hinted", F.filter("unwrapped", lambda b: ~b["chrome"]))
    # a wrapper that takes the whole marked article, or all text, is none: the host has one article on many pages
    is_article = lambda b: b["article"] & ~b["chrome"]
    spared = F.filter("blocks", lambda b: ~b["chrome"] & (b["article"] | ~F.array_contains(dropped, F.get("to_seed", b["node"]))))
    met = met.withColumn("left", F.when(F.exists("hinted", is_article) | ~F.exists("blocks", is_article), F.col("hinted")).otherwise(spared))
    met = met.withColumn("left", F.when(F.size("left") > 0, F.col("left")).otherwise(F.filter("blocks", lambda b: ~b["chrome"])))
    size = lambda blocks: F.aggregate(blocks, F.lit(0).cast("bigint"), lambda acc, b: acc + F.length(b["text"]))
    met = met.withColumn("marked", F.filter("left", lambda b: b["article"]))
    counts = [F.col("n_template_nodes"), (size(F.col("blocks")) - size(F.col("unwrapped"))).alias("n_template_chars"), (size(F.col("unwrapped")) - size(F.col("hinted"))).alias("n_hint_chars")]
    final = F.when((F.size("marked") > 0) & (size(F.col("marked")) * 2 >= size(F.col("left"))), F.col("marked")).otherwise(F.col("left"))
    text = F.array_join(F.transform(final, lambda b: b["text"]), " ")
    return met.select("page_id", "url", F.col("name").alias("host"), text.alias("text"), *counts).withColumn("n_chars", F.length("text").cast("bigint"))
