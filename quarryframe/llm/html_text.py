"""HTML extraction by wrapper induction.

Of each host a few pages are taken as examples. Their DOM trees are aligned by simple tree matching: nodes
whose text is the same in all of them are template, the others are slots. The wrapper of a host is the
skeleton of its first example with the digests of its template nodes and the node that holds the varying text. Each page is
aligned with its host's wrapper. Runs of like siblings (paragraphs, list items) are one repeated slot, so a
sentence that many articles share is never taken for template.

The wrapper's slot region decides what a page's text is. Only on pages without a wrapper, or that their host's wrapper does not match, its marked
articles are the region, else the body. Roles that HTML itself states (nav, footer, aside, forms, class names of adverts, comments and so on) are
left out on any page, for they vary as the text does.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import materialize, need_columns

# Element names and class words by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe svg"
BLOCK = frozenset(
    "html head title body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend "
    "li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "optgroup"}
LEFT_OUT = frozenset("head title nav footer aside form button select dialog menu search header".split())
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments disqus respond replies share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation pagination skip toolbar".split()
)
CLASS_NAMES = frozenset("header footer masthead colophon site-header site-footer page-header page-footer top-bar".split())
KEPT_NAMES = frozenset("ad-hoc".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Elements that are text whatever their class or id says.
TEXT = HEADINGS | {"p", "pre", "blockquote", "td", "th"}
#: Levels of a page that are aligned; what lies deeper belongs to its slot.
MAX_DEPTH = 200
#: Pairs of children that are aligned by the table of simple tree matching; beyond it they pair up from both ends.
MAX_TABLE = 40_000


@dataclass(frozen=True)
class WrapperConfig:
    #: Pages of a host that its wrapper is induced from.
    examples: int = 4
    #: Two examples tell something only if less than this share of their text is the same.
    max_same: float = 0.5
    #: Share of the varying text that the slot region has to hold.
    region_share: float = 0.9
    #: Characters of all wrappers that are sent to every task; more are joined to the pages by host.
    max_broadcast_chars: int = 16_000_000


@dataclass
class Node:
    label: str
    tag: str
    out: bool = False
    children: list[Node] = field(default_factory=list)
    #: Own blocks in order with the children: (position among the children, text).
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def texts(self) -> Iterator[str]:
        """Blocks of the subtree in page order, without what is left out."""
        todo: list[Node | str] = [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                yield item
            elif not item.out:
                own, parts = iter([*item.blocks, (len(item.children) + 1, "")]), []
                at, text = next(own)
                for i in range(len(item.children) + 1):
                    while at <= i:
                        parts.append(text)
                        at, text = next(own)
                    parts += item.children[i : i + 1]
                todo += reversed(parts)


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _marks(attrs: str, tag: str) -> tuple[str, bool]:
    """The label's addition for class and id, and whether the attributes leave the element out.

    Class words count in whole names or their parts, but not those of KEPT_NAMES, nor on elements that are text.
    """
    label, out = "", False
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("class", "id"):
            names = value.split()
            label += f".{names[0]}" if names and name == "class" else ""
            words = [w for n in names for w in re.split(r"[_\-]+", n) if n not in KEPT_NAMES]
            if tag not in TEXT:
                out |= not CLASS_NAMES.isdisjoint(names) or any(w in CLASS_WORDS and not (w == "menu" and tag == "section") for w in words)
        elif name == "role":
            out |= value in ROLES
        elif name == "style":
            out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            out |= name == "hidden" or value == "true"
    return label, out


def parse(page: str) -> Node:
    """The block tree of a page. Inline elements have no node; unclosed and stray tags are tolerated."""
    root = Node("#", "#")
    stack, held = [root], []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1].blocks.append((len(stack[-1].children), text))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"]:
                held.append(" " if m["raw"].lower() in ("textarea", "iframe", "svg") else "")
            continue
        tag = tag.lower()
        if tag == "br" or tag not in BLOCK:
            if tag == "br":
                held.append(" ")
            continue
        flush()
        if m["close"]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                del stack[k:]
            continue
        if tag in CLOSES_P and stack[-1].tag in ("p", *HEADINGS) or tag == stack[-1].tag and tag in ("li", "dt", "dd", "option", "td", "th", "tr"):
            stack.pop()
        if tag in VOID:
            continue
        extra, out = _marks(m["attrs"], tag) if m["attrs"] else ("", False)
        inside = any(n.tag in ("article", "main") for n in stack)
        node = Node(tag + extra, tag, out or tag in LEFT_OUT and not (tag == "header" and inside))
        stack[-1].children.append(node)
        stack.append(node)
    if at < len(page):
        held.append(page[at:])
    flush()
    return root


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def skeleton(node: Node) -> tuple[list, list[Node]]:
    """Nested [label, digest, size, children] without what is left out, and the nodes in the same order (depth first).

    Neighbouring leaves with one label become a single repeated slot, whose digest starts with a star.
    """
    nodes: list[Node] = []

    def build(n: Node, depth: int) -> list:
        nodes.append(n)
        own = " ".join(t for _, t in n.blocks)
        item = [n.label, _digest(own) if own else "", len(own), []]
        k = 0
        while k < len(n.children) and depth < MAX_DEPTH:
            child = n.children[k]
            k += 1
            if child.out:
                continue
            part = build(child, depth + 1)
            if not part[3]:
                while k < len(n.children) and n.children[k].label == child.label and not n.children[k].children and not n.children[k].out:
                    text = " ".join(t for _, t in n.children[k].blocks)
                    part[1], part[2] = f"*{_digest(part[1] + text)}", part[2] + len(text)
                    k += 1
            item[3].append(part)
        return item

    return build(node, 0), nodes


def tree_match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: the size of the largest order-preserving match of two trees, and its pairs of nodes."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[3], b[3]
    if len(x) * len(y) > MAX_TABLE:
        return _match_ends(a, b)
    sub: dict[tuple[int, int], tuple[int, list]] = {}
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            w = 0
            if x[i - 1][0] == y[j - 1][0]:
                sub[i, j] = tree_match(x[i - 1], y[j - 1])
                w = sub[i, j][0]
            best[i][j] = max(best[i][j - 1], best[i - 1][j], best[i - 1][j - 1] + w)
    pairs = [(a, b)]
    i, j = len(x), len(y)
    while i and j:
        if (i, j) in sub and best[i][j] == best[i - 1][j - 1] + sub[i, j][0]:
            pairs += sub[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[len(x)][len(y)] + 1, pairs


def _match_ends(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """The match of two nodes with very many children: those with equal labels from the front, then from the back."""
    x, y = a[3], b[3]
    n = min(len(x), len(y))
    front = next((i for i in range(n) if x[i][0] != y[i][0]), n)
    back = next((i for i in range(n - front) if x[-1 - i][0] != y[-1 - i][0]), n - front)
    size, pairs = 1, [(a, b)]
    for p, q in [*zip(x[:front], y[:front], strict=True), *zip(x[len(x) - back :], y[len(y) - back :], strict=True)]:
        k, found = tree_match(p, q)
        size += k
        pairs += found
    return size, pairs


def _size(tree: list) -> int:
    return tree[2] + sum(map(_size, tree[3]))


def induce(pages: list[str], cfg: WrapperConfig) -> str | None:
    """A host's wrapper as JSON, or None where fewer than two examples differ enough.

    It is [skeleton, template, region]: ``template`` has the numbers (depth first) of the skeleton's nodes with the same text in all
    examples, ``region`` the number of the deepest node that holds nearly all varying text.
    """
    trees = [skeleton(parse(p))[0] for p in pages]
    first = trees[0]
    total = max(1, _size(first))
    order: list[list] = []

    def number(t: list) -> None:
        order.append(t)
        for c in t[3]:
            number(c)

    number(first)
    place = {id(t): k for k, t in enumerate(order)}
    same: list[set[int]] = []
    for other in trees[1:]:
        pairs = tree_match(first, other)[1]
        equal = {place[id(x)] for x, y in pairs if x[1] and x[1] == y[1]}
        if sum(order[k][2] for k in equal) < cfg.max_same * total:
            same.append(equal)
    if not same:
        return None
    template = set.intersection(*same)
    varying = [0 if k in template else t[2] for k, t in enumerate(order)]

    def weight(t: list) -> int:
        return varying[place[id(t)]] + sum(map(weight, t[3]))

    region, need = first, cfg.region_share * weight(first)
    while heavy := next((c for c in region[3] if weight(c) >= need and weight(c) > 0 and c[3]), None):
        region = heavy
    return json.dumps([first, sorted(k for k in template if order[k][1][0] != "*" and order[k][0].split(".")[0] not in ("p", "li", *HEADINGS)), place[id(region)]])


def extract(page: str | None, wrapper: list | None = None) -> str:
    """The main text of a page: its blocks joined by an empty line, or an empty string."""
    root = parse(page or "")
    region: Node | None = None
    if wrapper is not None:
        tree, nodes = skeleton(root)
        numbers: dict[int, int] = {}

        def number(t: list) -> None:
            numbers[id(t)] = len(numbers)
            for c in t[3]:
                number(c)

        number(wrapper[0])
        mine: dict[int, Node] = {}
        rest = iter(nodes)

        def follow(t: list) -> None:
            mine[id(t)] = next(rest)
            for c in t[3]:
                follow(c)

        follow(tree)
        template = set(wrapper[1])
        for x, y in tree_match(wrapper[0], tree)[1]:
            k = numbers[id(x)]
            if k in template and x[1] == y[1]:
                mine[id(y)].blocks = []  # template text; its children are slots of their own
            if k == wrapper[2]:
                region = mine[id(y)]
    if region is not None and (text := "\n\n".join(region.texts())):
        return text
    return "\n\n".join(t for n in _articles(root) or [root] for t in n.texts())


def _articles(root: Node) -> list[Node]:
    """The outermost article elements in page order, and main elements without one inside."""
    found: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n.out:
            continue
        if n.tag == "article" or n.tag == "main" and not any(c.tag == "article" for c in _below(n)):
            found.append(n)
        else:
            todo += reversed(n.children)
    return found


def _below(node: Node) -> Iterator[Node]:
    todo = list(node.children)
    while todo:
        n = todo.pop()
        if not n.out:
            yield n
            todo += n.children


HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def induce_wrappers(pages: DataFrame, cfg: WrapperConfig) -> DataFrame:
    """(host, wrapper) of the hosts of ``pages`` (page_id, url, html) with at least two different examples."""
    hosted = pages.where("page_id is not null and html is not null").select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), "html").where("host <> ''")
    picks = [F.min(F.struct(F.xxhash64(F.lit(k), F.col("page_id").cast("string")).alias("h"), "page_id")).alias(f"p{k}") for k in range(cfg.examples)]
    chosen = hosted.groupBy("host").agg(*picks).select("host", F.explode(F.array_distinct(F.array(*(f"p{k}.page_id" for k in range(cfg.examples))))).alias("page_id"))
    examples = hosted.join(chosen, ["host", "page_id"]).select("host", "page_id", "html").dropDuplicates(["host", "page_id"])

    def build(key, table):
        rows = sorted(zip(table["page_id"].to_pylist(), table["html"].to_pylist(), strict=True))
        wrapper = induce([h for _, h in rows], cfg) if len(rows) > 1 else None
        return pa.table({"host": pa.array([key[0].as_py()] if wrapper else [], pa.string()), "wrapper": pa.array([wrapper] if wrapper else [], pa.string())})

    # a group has ``examples`` pages at most
    return examples.groupBy("host").applyInArrow(build, "host string, wrapper string")


def extract_text(pages: DataFrame, cfg: WrapperConfig | None = None) -> DataFrame:
    """All rows and columns of ``pages`` (page_id, url, html) but html, then text and n_chars.

    A null or empty html gives an empty text. Pages without a host, and those of hosts with fewer than two different pages, are read without a
    wrapper. Rows that share a page_id are separate pages, of which one may be an example.
    Columns named text and n_chars are replaced.
    """
    need_columns(pages, "page_id", "url", "html")
    cfg = cfg or WrapperConfig()
    pages = pages.drop("text", "n_chars", "__host", "__wrapper").withColumn("__host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    wrappers = materialize(induce_wrappers(pages, cfg), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    known: dict[str, str] | None = None
    if size <= cfg.max_broadcast_chars:
        known = {r.host: r.wrapper for r in wrappers.collect()}
    else:
        pages = pages.join(wrappers.select(F.col("host").alias("__h"), F.col("wrapper").alias("__wrapper")), F.col("__host") == F.col("__h"), "left").drop("__h")
    names = [c for c in pages.columns if c not in ("html", "__host", "__wrapper")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, list] = {}
        for batch in batches:
            n = len(names)
            hosts = batch.column(n + 1).to_pylist()
            given = [known.get(h) for h in hosts] if known is not None else batch.column(n + 2).to_pylist()
            texts = []
            for page, host, wrapper in zip(batch.column(n).to_pylist(), hosts, given, strict=True):
                if wrapper is not None and host not in loaded:
                    if len(loaded) > 5000:
                        loaded.clear()
                    loaded[host] = json.loads(wrapper)
                texts.append(extract(page, loaded[host] if wrapper is not None else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, "html", "__host", *([] if known is not None else ["__wrapper"])).mapInArrow(run, f"{fields}, text string, n_chars long")
