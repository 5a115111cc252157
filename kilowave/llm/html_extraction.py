"""HTML extraction: content and boilerplate blocks told apart by a minimum cut.

A page is cut into blocks of text at block-level elements. The graph has a node for each block and one for each element
that tells something by its tag, role or name (a container). Classifier costs are the capacities to the two terminals:
a block's are log-odds of its text alone (length, sentence end, share of links, heading), at most TEXT_MOST in size; a
container's are the log-odds of its kind, once for each of its blocks. Smoothness edges cost their weight if their ends are
labelled differently: between neighbours on the page, between blocks of one parent, the weaker the further apart in the
tree, and between a block and its innermost container. The minimum cut is the cheapest labelling of all blocks and containers
together. So a one-word paragraph of an article is kept and a long advert goes, though their texts alone say the opposite, and
a misleading name on one paragraph is outvoted. Nodes whose capacity outweighs all their edges are settled first, which
changes no optimum; maximum flow (level graphs, blocking flows) settles the rest.

White space (`<br>` included) within a block becomes one space; character references are decoded; content blocks are
joined by a blank line. Whole pages are read. One pass, no shuffle; one page is held at a time.

Defined cases: null and empty html, and pages without content, have an empty text; very long pages are read whole, with the tree's
last DEPTH ancestors telling nearness; a tie goes to content; repeated rows each get a result; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# What elements and names tell.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe".split())
SILENT = frozenset("button select option optgroup datalist label input output".split())
BAD_ELEMENTS = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD_ELEMENTS = frozenset("article main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in names that tell furniture anywhere, and those that do so outside an article only or as the whole name.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation "
    "newsletter pager pagination popup promo promoted promotion sidebar signup sponsor sponsored subscribe subscription toolbar topbar".split()
)
DOUBTFUL_WORDS = frozenset("banner copyright form header notice notification recommended replies respond search share sharing social teaser widget".split())
GOOD_WORDS = frozenset("article content entry post story".split())
#: Elements of running text, whose names tell little about what is around them.
INNER = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong span a blockquote pre code figure figcaption td th tr dt dd".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
ENDS = re.compile(r"[.!?…:;\"'»”)]\Z")
RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


#: Nearest block-level ancestors that count for nearness in the tree.
DEPTH = 12

# Log-odds of containers, for each of their blocks: parts of the page that are furniture by element or role, by name, by a doubtful name; articles; names of content; blocks outside the article of a page that has one.
FURNITURE, NAMED, DOUBTFUL, ARTICLE, CONTENT, OUTSIDE = -3.5, -3.2, -1.0, 3.0, 1.5, -1.5
#: Edge of a block and its container; of neighbours: at least, and what nearness in the tree adds, a factor less for each step; of blocks of one parent with others between; share of it across containers.
PULL, NEAR, NEARER, STEP, SAME, ACROSS = 3.0, 0.3, 1.2, 0.6, 0.8, 0.5
#: What a block's text can weigh at most.
TEXT_MOST = 2.9


class Block:
    __slots__ = ("box", "linked", "parent", "path", "tag", "text")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.tag, self.box = text, linked, node.tag, node.box
        self.path, self.parent = node.path, node.path[-2] if len(node.path) > 1 else 0


def name_odds(tag: str, attributes: str, inside: float) -> tuple[float, bool]:
    """Log-odds of an element by its role and names, and whether they replace what its surroundings tell. inside: log-odds of those."""
    out, replaces = 0.0, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2].strip("\"'")
        if key == "role":
            if value.lower() in BAD_ROLES:
                return FURNITURE, True
            if value.lower() in GOOD_ELEMENTS and inside >= 0:
                out, replaces = ARTICLE, True
            continue
        for name in value.split():
            words = [w.lower() for w in WORD.findall(name)]
            if not words:
                continue
            whole = len(words) == 1
            if any(w in BAD_WORDS for w in words):
                if tag not in INNER or whole and inside <= 0:
                    return NAMED, True
                out += DOUBTFUL
            elif any(w in DOUBTFUL_WORDS for w in words):
                if inside <= 0 and whole and tag not in INNER:
                    return NAMED, True
                out += DOUBTFUL
            elif tag in ("div", "section", "td") and inside >= 0 and not out and words[0] in GOOD_WORDS:
                out = CONTENT
    return out, replaces


class Node:
    """An open element: its block-level ancestors, and the container it is in (an index; 0 for none)."""

    __slots__ = ("box", "path", "silent", "tag")

    def __init__(self, tag: str, attributes: str, above: Node | None, number: int, boxes: list[float]):
        self.tag = tag
        self.box, self.silent = (above.box, above.silent or tag in SILENT) if above else (0, False)
        self.path = (*(above.path if above else ()), number)[-DEPTH:] if tag in BLOCK or not above else above.path
        if tag in ("", "html", "body"):
            return
        inside, odds, replaces = boxes[self.box], 0.0, False
        if tag in BAD_ELEMENTS or tag == "header" and inside <= 0:
            odds, replaces = FURNITURE, True
        elif tag in GOOD_ELEMENTS and inside >= 0:
            odds, replaces = ARTICLE, True
        if attributes and odds >= 0:
            named, over = name_odds(tag, attributes, inside)
            odds, replaces = (named, True) if over else (odds + named, replaces)
        if odds and not (inside < DOUBTFUL and odds < 0):  # furniture in furniture is of one container
            boxes.append(odds if replaces else min(inside + odds, ARTICLE))
            self.box = len(boxes) - 1


def blocks_of(page: str) -> tuple[list[Block], list[float]]:
    """Blocks of text in page order, and the log-odds of the containers that they name."""
    out: list[Block] = []
    boxes = [0.0]
    stack = [Node("", "", None, 0, boxes)]
    parts: list[str] = []
    linked = links = number = at = 0
    owner, opened, unclosed = stack[0], Counter(), set()

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def flush():
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, owner))
            parts, linked = [], 0

    n = len(page)
    last = n if "<!--" in page else page.rfind(">") + 1  # no tag ends after it
    while at < n:
        m = TAG.search(page, at, last)
        end = m.start() if m else n
        if end > at and not stack[-1].silent:
            raw = page[at:end]
            text = html.unescape(raw) if "&" in raw else raw
            if not parts or not owner.tag:
                owner = next((x for x in reversed(stack) if x.tag in BLOCK), stack[0])
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts and parts.append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            if tag == "a":
                links = 0
            continue
        if tag in RAW:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = n
            else:
                unclosed.add(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a new block ends an open paragraph; an item ends an open item
                if stack[k].tag == "p" or tag in ("li", "dd", "dt", "td", "th", "tr") and stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        number += 1
        stack.append(Node(tag, attributes or "", stack[-1], number, boxes))
        opened[tag] += 1
        if tag == "a":
            links = 1
    flush()
    return out, boxes


def text_odds(b: Block) -> float:
    """How much a block's text looks like content (positive) or boilerplate."""
    words = b.text.count(" ") + 1
    share = b.linked / max(len(b.text), 1)
    s = min(words / 12, 3) - 1.2 + (0.6 if ENDS.search(b.text) else 0)
    if share > 0.5 and words < 40:
        s -= 1.5 * share
    if b.tag in HEADINGS:
        s += 0.6
    elif b.tag in ("li", "td", "th", "dd", "dt"):
        s -= 0.2
    if RIGHTS.search(b.text):
        s -= 1.5
    return max(-TEXT_MOST, min(s, TEXT_MOST))


def page_graph(blocks: list[Block], boxes: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Capacities (positive: to the content terminal) and smoothness edges: nodes are the blocks, then their containers."""
    held = Counter(b.box for b in blocks if b.box)
    place = {box: len(blocks) + k for k, box in enumerate(held)}
    outside = OUTSIDE if any(boxes[box] >= ARTICLE for box in held) else 0.0
    unary = [text_odds(b) + (0 if b.box else outside) for b in blocks] + [boxes[box] * n for box, n in held.items()]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if b.box:
            edges.append((i, place[b.box], PULL))
        a = blocks[i - 1] if i else None
        if a:
            apart = len(a.path) + len(b.path) - 2 * len(set(a.path) & set(b.path))
            edges.append((i - 1, i, (NEAR + NEARER * STEP**apart) * (1 if a.box == b.box else ACROSS)))
        j = last.get(b.parent)
        if j is not None and j != i - 1:
            edges.append((j, i, SAME * (1 if blocks[j].box == b.box else ACROSS)))
        last[b.parent] = i
    return unary, edges


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: source side) that minimises the sum of unary[i] over positive nodes labelled False, of -unary[i] over negative ones labelled True, and of the weights of edges whose ends differ."""
    n = len(unary)
    u, near, weight = list(unary), [[] for _ in range(n)], [0.0] * n
    for i, j, w in edges:
        near[i].append((j, w)), near[j].append((i, w))
        weight[i] += w
        weight[j] += w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(u[i]) > weight[i]:
            label[i] = u[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    u[j] += w if label[i] else -w
                    weight[j] -= w
                    todo.append(j)
    open_nodes = [i for i in range(n) if label[i] is None]
    if open_nodes:
        place = {i: k for k, i in enumerate(open_nodes)}
        sides = max_flow_sides([u[i] for i in open_nodes], [(place[i], place[j], w) for i, j, w in edges if i in place and j in place])
        for i, side in zip(open_nodes, sides, strict=True):
            label[i] = side
    return label


def max_flow_sides(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut, by maximum flow over level graphs; capacities in millionths."""
    n = len(unary)
    source, sink = n, n + 1
    to, cap, graph = [], [], [[] for _ in range(n + 2)]

    def join(a, b, forth, back):
        graph[a].append(len(to)), to.append(b), cap.append(forth)
        graph[b].append(len(to)), to.append(a), cap.append(back)

    for i, x in enumerate(unary):
        c = round(abs(x) * 1e6)
        join(source, i, c, 0) if x > 0 else join(i, sink, c, 0)
    for i, j, w in edges:
        join(i, j, round(w * 1e6), round(w * 1e6))
    while True:
        level = [-1] * (n + 2)
        level[source], line = 0, deque([source])
        while line:
            a = line.popleft()
            for e in graph[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at, path = [0] * (n + 2), []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(graph[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def labelled(page: str) -> list[tuple[Block, bool]]:
    """The blocks of a page, and whether the minimum cut leaves them on the side of content."""
    blocks, boxes = blocks_of(page)
    return list(zip(blocks, minimum_cut(*page_graph(blocks, boxes)), strict=False))


def main_text(page: str | None) -> str:
    """The content blocks of a page."""
    return "\n\n".join(b.text for b, content in labelled(page) if content) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    bounded_batches(pages.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
