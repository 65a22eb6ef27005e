"""Main text of web pages by wrapper induction over the pages of a host.

Each page is read into a tree of block elements in which equal neighbouring
siblings are one node. One page of each host (smallest id) lends its tree as the
host's pattern; the trees of all pages of the host are aligned with it by simple
tree matching, and Spark counts for each pattern node on how many pages its text
is the same. Nodes that are the same on nearly all pages are the host's template;
all others, and nodes that only a page has, are slots that carry content.

Elements whose role is known (menus, forms, adverts, ...) are never content, even
where their text varies from page to page. A page that marks its article or main
part gives the slots inside it; there a repeated text is content too, since
copies of an article repeat all of it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbits import map_batches
from tidemark.session import materialize

#: Elements by their role in HTML.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td tfoot th thead tr ul button".split()
)
DROPPED = frozenset("aside button dialog footer form head header input menu nav option search select".split()) | frozenset(RAW)
MAIN = frozenset(("article", "main"))
#: Class and id words of parts that are not content.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "recommended related respond share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCKS - {"br", "button", "option", "optgroup", "select"}
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

DEPTH = 200
CELLS = 1_000_000
#: Cells below which halved lists are aligned in one table.
HALVED = 10_000
COMMON = 0.8

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.DOTALL)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in RAW}
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")


class Page:
    """Nodes (parent, label) of a page's collapsed tree, and its blocks (node, text, dropped, inside main)."""

    def __init__(self, source: str):
        self.parent, self.label, self.children = [-1], [""], [[]]
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.text: list[str] = []
        # open elements: (tag, node, dropped, inside main)
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self.text.append(source[at:])
                break
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            if m.group(2) is None:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                self.close(tag)
                continue
            attributes = m.group(3)
            if tag in RAW:
                stop = _RAW_END[tag].search(source, at)
                at = stop.end() if stop else end
            elif tag in BLOCKS:
                self.start(tag, attributes)
        self.flush()

    def flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            self.text = []
            if text:
                _, node, dropped, main = self.open[-1]
                self.blocks.append((node, text, dropped, main))

    def pop_to(self, depth: int) -> None:
        self.flush()
        del self.open[depth:]

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag in ENDS_P and self.open[-1][0] == "p":
            self.open.pop()
        if tag in SAME_ENDS:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] in SAME_ENDS[tag]:
                    break
                if self.open[depth][0] == tag or {tag, self.open[depth][0]} <= {"dt", "dd"} or {tag, self.open[depth][0]} <= {"td", "th"}:
                    self.pop_to(depth)
                    break
        _, parent, dropped, main = self.open[-1]
        if tag in VOID:
            return
        words, label = set(), tag
        if attributes:
            for m in _NAMED.finditer(attributes):
                words.update(w.lower() for w in _WORD.findall(m.group(1) or m.group(2) or m.group(3) or ""))
            c = _CLASS.search(attributes)
            if c:
                label += "." + " ".join(sorted((c.group(1) or c.group(2) or c.group(3) or "").lower().split()))
        last = self.children[parent][-1] if self.children[parent] else -1
        if len(self.open) > DEPTH:
            node = parent
        elif last >= 0 and self.label[last] == label:
            node = last
        else:
            node = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.children.append([])
            self.children[parent].append(node)
        aside = tag in DROPPED or (tag not in ("html", "body") and not words.isdisjoint(ASIDE_WORDS))
        self.open.append((tag, node, dropped or aside, main or (tag in MAIN and not dropped)))

    def close(self, tag: str) -> None:
        if tag == "br" or tag == "p" and all(o[0] != "p" for o in self.open):
            self.flush()
            return
        if tag not in BLOCKS:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self.pop_to(depth)
                return
            if tag != "article" and tag not in ("body", "html") and self.open[depth][0] in MAIN:
                return  # an end tag inside an article doesn't end what is around it

    def digests(self) -> list[int]:
        """A hash of the text of each node (its own blocks, in order)."""
        parts: dict[int, list[str]] = {}
        for node, text, _, _ in self.blocks:
            parts.setdefault(node, []).append(text)
        return [xxhash.xxh64_intdigest("\n".join(parts[i])) if i in parts else 0 for i in range(len(self.parent))]


def tree(labels: list[str], parents: list[int]) -> list[list[int]]:
    children: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    return children


def simple_tree_matching(a: tuple[list[str], list[list[int]]], b: tuple[list[str], list[list[int]]]) -> dict[int, int]:
    """The largest order-keeping match of two labelled trees from their roots: node of a → node of b.

    Lists of children whose product exceeds ``CELLS`` are halved (Hirschberg) until
    it doesn't, so that the same optimum is found with a few rows of the table.
    """
    (la, ca), (lb, cb) = a, b
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def whole(xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        chosen = []
        best = np.zeros((len(xs) + 1, len(ys) + 1), dtype=np.int64)
        for i, u in enumerate(xs, 1):
            for j, v in enumerate(ys, 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + match(u, v))
        i, j = len(xs), len(ys)
        while i and j:
            w = match(xs[i - 1], ys[j - 1])
            if w and best[i, j] == best[i - 1, j - 1] + w:
                chosen.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        return chosen

    def last_row(xs: list[int], ys: list[int]) -> np.ndarray:
        """Weights of the best alignments of all of xs with the first 0, 1, ... of ys."""
        places: dict[str, list[int]] = {}
        for j, v in enumerate(ys):
            places.setdefault(lb[v], []).append(j)
        plain = {label: np.array(js) for label, js in places.items()}
        best = np.zeros(len(ys) + 1, dtype=np.int64)
        for u in xs:
            if la[u] not in plain:
                continue
            js = plain[la[u]]
            new = best.copy()
            weight = np.array([match(u, ys[j]) if cb[ys[j]] else 1 for j in js]) if ca[u] else 1
            new[js + 1] = np.maximum(new[js + 1], best[js] + weight)
            best = np.maximum.accumulate(new)
        return best

    def halved(xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        chosen, todo = [], [(xs, ys)]
        while todo:
            us, vs = todo.pop()
            if not us or not vs:
                continue
            if len(us) == 1:
                weights = [match(us[0], v) for v in vs]
                if max(weights):
                    chosen.append((us[0], vs[weights.index(max(weights))]))
            elif len(us) * len(vs) <= HALVED:
                chosen += whole(us, vs)
            else:
                half = len(us) // 2
                cut = int((last_row(us[:half], vs) + last_row(us[half:][::-1], vs[::-1])[::-1]).argmax())
                todo += [(us[:half], vs[:cut]), (us[half:], vs[cut:])]
        return chosen

    def match(x: int, y: int) -> int:
        if la[x] != lb[y]:
            return 0
        if (x, y) in memo:
            return memo[x, y][0]
        xs, ys = ca[x], cb[y]
        chosen: list[tuple[int, int]] = []
        if xs and ys and len(xs) * len(ys) <= CELLS:
            chosen = whole(xs, ys)
        elif xs and ys:
            chosen = halved(xs, ys)
        memo[x, y] = (1 + sum(memo[p][0] for p in chosen), chosen)
        return memo[x, y][0]

    match(0, 0)
    out, todo = {}, [(0, 0)] if la[0] == lb[0] else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo += memo[x, y][1]
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def _aligner() -> Callable[[str, Page], dict[int, int]]:
    """Alignment of pages with patterns; equal pairs of trees are matched once per task."""
    patterns: dict[str, tuple] = {}
    known: dict[tuple, dict[int, int]] = {}

    def align(pattern: str, page: Page) -> dict[int, int]:
        if pattern not in patterns:
            if len(patterns) > 1000:
                patterns.clear()
                known.clear()
            nodes = json.loads(pattern)
            labels = [n[1] for n in nodes]
            patterns[pattern] = (labels, tree(labels, [n[0] for n in nodes]))
        key = (pattern, tuple(page.label), tuple(page.parent))
        if key not in known:
            if len(known) > 10_000:
                known.clear()
            known[key] = simple_tree_matching((page.label, page.children), patterns[pattern])
        return known[key]

    return align


def trees(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (host, id, nodes): each page's collapsed tree as JSON rows [parent, label, hash of the text]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for source in batch.column(2).to_pylist():
                page = Page(source or "")
                nodes.append(json.dumps(list(zip(page.parent, page.label, page.digests())), separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.string())], ["host", "id", "nodes"])

    kind = pages.schema[id_col].dataType.simpleString()
    chosen = pages.select(host_of(F.col(url_col)).alias("host"), F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return map_batches(chosen, run, f"host string, id {kind}, nodes string")


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", common: float = COMMON) -> DataFrame:
    """Rows (host, pattern, constant): the pattern tree and the positions of its template nodes.

    A node is template if its text is the same as the pattern's on at least
    ``common`` of all pages of the host, and the host has at least three.
    """
    read = materialize(trees(pages, id_col, url_col, html_col), "trees")
    first = read.groupBy("host").agg(F.min_by("nodes", F.struct("id", "nodes")).alias("pattern"))
    first = materialize(first.withColumnRenamed("host", "name"), "patterns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        known: dict[tuple, dict[int, int]] = {}
        parsed: dict[str, list] = {}
        for batch in batches:
            for host, nodes, pattern in zip(*(c.to_pylist() for c in batch.columns)):
                if pattern not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[pattern] = json.loads(pattern)
                ours, theirs = json.loads(nodes), parsed[pattern]
                sides = [([n[1] for n in t], [n[0] for n in t]) for t in (ours, theirs)]
                key = tuple((tuple(labels), tuple(up)) for labels, up in sides)
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = simple_tree_matching(*[(labels, tree(labels, up)) for labels, up in sides])
                counts[host, -1] = counts.get((host, -1), 0) + 1
                for i, j in known[key].items():
                    if ours[i][2] == theirs[j][2] and ours[i][2]:
                        counts[host, j] = counts.get((host, j), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            ["host", "node", "n"],
        )

    joined = read.join(first, F.col("host") == F.col("name")).select("host", "nodes", "pattern")
    sums = map_batches(joined, run, "host string, node int, n long").groupBy("host", "node").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "nodes")
    totals = sums.where("node = -1").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    same = sums.join(totals, F.col("host") == F.col("of")).where((F.col("node") >= 0) & (F.col("pages") >= 3) & (F.col("n") >= common * F.col("pages")))
    constant = same.groupBy(F.col("host").alias("of")).agg(F.array_sort(F.collect_list("node")).alias("constant"))
    found = first.join(constant, F.col("name") == F.col("of"), "left")
    return found.select(F.col("name").alias("host"), "pattern", F.coalesce("constant", F.array().cast("array<int>")).alias("constant"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text) for every page: the blocks of its content slots in page order, joined by one space.

    A null or empty page has the text ''. A null or odd URL belongs to the host ''.
    Repeated rows stay apart; other columns play no part; an empty table gives an empty table.
    """
    patterns = materialize(templates(pages, id_col, url_col, html_col), "templates")
    patterns = patterns.withColumnRenamed("host", "name")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner()
        for batch in batches:
            texts = []
            for source, pattern, constant in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                page = Page(source or "")
                slots = [b for b in page.blocks if not b[2]]
                if any(b[3] for b in slots):
                    slots = [b for b in slots if b[3]]
                elif constant:
                    matched, template = align(pattern, page), set(constant)
                    slots = [b for b in slots if matched.get(b[0], -1) not in template]
                texts.append(" ".join([b[1] for b in slots]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = read.join(patterns, F.col("host") == F.col("name")).select("id", "url", "html", "pattern", "constant")
    found = map_batches(joined, run, f"id {kind}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
