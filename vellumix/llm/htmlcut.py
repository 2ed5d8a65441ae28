"""HTML extraction by minimum cut: max-flow separates content from boilerplate.

A page is cut into text blocks at block-level tags. A naive Bayes classifier gives each block a log-odds of being content, from its length,
links, sentence ends, tag and place. It is trained here, on all pages: blocks whose containers say what they are (article or
main; nav, footer, aside, forms, or classes like `ad`) count as labelled, and what the containers say isn't among the features. The container then adds
CONTAINER to the log-odds. Positive costs are capacities from the source, negative ones to the sink. Smoothness edges join blocks next to each
other, ADJACENT / (1 + steps between their elements in the DOM), and blocks that follow one another under the same parent, SIBLING.
Content is the source side of the minimum cut. Blocks whose cost outweighs all their edges are decided at once and become part of the terminals. Of what is left, two sweeps
along the blocks push what the terminals ahead can take, and blocking flows over shortest residual paths do the rest, so a page of 50,000 disputed blocks takes seconds.
Costs are whole thousandths, so results don't depend on summation order.

Defined results. A null or empty page has no blocks and an empty text. Pages of any length and any nesting are read whole; markup that isn't closed ends
with the page. Between minimum cuts (ties) the one with the least content is taken. Repeated rows and null page_ids are kept. Only
page_id, url and html are read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, text_of

ADJACENT, SIBLING, CONTAINER, LIMIT = 1500, 400, 2500, 6000
PIECE_BYTES = 1 << 20
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>|<[!?][^<>]*>", re.S | re.I)
BLOCK = frozenset("address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GOOD, BAD = frozenset(("article", "main")), frozenset("nav footer aside form header head title menu button select".split())
CLASS = re.compile(r"""(?:class|id|role)\s*=\s*["']?([^"'>]+)""", re.I)
BAD_CLASS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sidebar|menu|nav\w*|footer|header|comments?|share|social|related|promo\w*|cookie\w*|breadcrumbs?|popup|sponsor\w*|newsletter|login)(?:$|[\s_-])", re.I)
GOOD_CLASS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body-text)(?:$|[\s_-])", re.I)
WORD = re.compile(r"\w+")
CLOSES = {"p": BLOCK - {"br", "body", "html"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def blocks(page: str) -> list[tuple[str, int, int, str, int, int, int]]:
    """Text, characters within links, parent element, tag, container (1 content, -1 boilerplate, 0 says nothing), level, and lowest level since the block before, of each block."""
    out: list = []
    stack = [("#root", 0, 0)]  # tag, element number, what the container says
    text: list[str] = []
    linked = in_link = 0
    number = at = 0
    low = 1
    open_ = Counter()

    def flush() -> None:
        nonlocal linked, low
        if text:
            s = "".join(text)
            if "&" in s:
                s = html.unescape(s)
            s = " ".join(s.split())
            if s:
                out.append((s, linked, stack[-2][1] if len(stack) > 1 else -1, stack[-1][0], stack[-1][2], len(stack), low))
                low = len(stack)
            text.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in BLOCK:
            if name == "a":
                in_link = 0 if m[2] else 1
            continue
        if name == "br":
            text.append("\n")
            continue
        flush()
        if m[2]:
            while open_[name]:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == name:
                    break
            low = min(low, len(stack))
        else:
            while len(stack) > 1 and name in CLOSES.get(stack[-1][0], ()):
                open_[stack.pop()[0]] -= 1
            low = min(low, len(stack))
            if name not in VOID:
                open_[name] += 1
                number += 1
                says = 1 if name in GOOD else -1 if name in BAD else 0
                if not says and m[4] and (c := CLASS.search(m[4])):
                    says = -1 if BAD_CLASS.search(c[1]) else 1 if GOOD_CLASS.search(c[1]) else 0
                stack.append((name, number, says or stack[-1][2]))
    if at < len(page):
        text.append(page[at:])
        if in_link:
            linked += len(page) - at
    flush()
    return out


TAGS = {t: k for k, ts in enumerate((("p",), ("li", "dd", "dt"), ("td", "th"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("pre", "blockquote"), ("a", "button"))) for t in ts}


def features(found: list) -> list[tuple[int, ...]]:
    """A number for each of five features of each block."""
    out, n = [], len(found)
    for i, (s, linked, _, tag, *_) in enumerate(found):
        words, share = len(WORD.findall(s)), linked / len(s)
        length = 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 60 else 4
        links = 0 if share == 0 else 1 if share < 0.2 else 2 if share < 0.6 else 3
        ends = sum(s.count(c) for c in ".!?")
        place = min(4, 5 * i // n)
        out.append((length, 10 + links, 20 + (0 if not ends else 1 if ends < 3 else 2), 30 + TAGS.get(tag, 6), 40 + place))
    return out


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros((64, 2), np.int64)
    for batch in batches:
        for page in text_of(batch, "html").to_pylist():
            found = blocks(page)
            for b, f in zip(found, features(found)):
                if b[4]:
                    side = 1 if b[4] > 0 else 0
                    count[63, side] += 1
                    for x in f:
                        count[x, side] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.array(count[:, 0].copy()), pa.array(count[:, 1].copy())], ["feature", "boilerplate", "content"])


#: What a feature is worth before any page is seen: counts of (boilerplate, content) blocks.
BEFORE = {0: (6, 2), 1: (5, 3), 2: (3, 4), 3: (2, 6), 4: (1, 6), 10: (4, 8), 11: (2, 4), 12: (3, 2), 13: (8, 1), 20: (8, 3), 21: (4, 6), 22: (2, 8)}


def train(pages: DataFrame) -> np.ndarray:
    """The log-odds of every feature in thousandths, from the counts of all pages; the last one is the blocks' own."""
    t = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(_train_batches, "feature int, boilerplate long, content long")
    count = np.ones((64, 2))
    for f, n in BEFORE.items():
        count[f] += n
    for f, bad, good in t.groupBy("feature").agg(F.sum("boilerplate"), F.sum("content")).collect():
        count[f] += (bad, good)
    odds = np.zeros(64)
    for group in (range(10), range(10, 20), range(20, 30), range(30, 40), range(40, 50)):
        part = count[list(group)]
        odds[list(group)] = np.log(part[:, 1] / part[:, 1].sum()) - np.log(part[:, 0] / part[:, 0].sum())
    return np.round(odds * 1000).astype(np.int64)


def edges(found: list) -> dict[tuple[int, int], int]:
    """Smoothness between blocks."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for j, (_, _, parent, _, _, level, low) in enumerate(found):
        if j:
            out[j - 1, j] = ADJACENT // (1 + found[j - 1][5] + level - 2 * low)
        if (i := last.get(parent)) is not None:
            out[i, j] = out.get((i, j), 0) + SIBLING
        last[parent] = j
    return out


def minimum_cut(cost: list[int], smooth: dict[tuple[int, int], int]) -> list[bool]:
    """Whether each node is on the source side of the smallest minimum cut. cost > 0: capacity from the source, < 0: to the sink."""
    n, cost = len(cost), list(cost)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), w in smooth.items():
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # nodes that no neighbours can turn
        i = queue.popleft()
        if side[i] is not None:
            continue
        pull = sum(near[i].values())
        if cost[i] > pull or -cost[i] >= pull:
            side[i] = cost[i] > pull
            for j, w in near[i].items():
                del near[j][i]
                cost[j] += w if side[i] else -w
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        for i, content in zip(left, _max_flow([cost[i] for i in left], [{place[j]: w for j, w in near[i].items()} for i in left])):
            side[i] = content
    return side


def _max_flow(cost: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Whether each node is on the source side of the smallest minimum cut.

    The flow may leave excess at nodes from which nothing reaches the sink any more; the smallest source side is what such nodes reach in the residual graph."""
    n = len(cost)
    excess, sink = [max(0, c) for c in cost], [max(0, -c) for c in cost]
    for order in (range(n), range(n - 1, -1, -1)):  # along the blocks and back
        order = list(order)
        takes = [0] * n  # what the nodes behind this one can take from it
        for a, b in zip(order[-2::-1], order[:0:-1]):
            takes[a] = min(near[a].get(b, 0), max(0, takes[b] + sink[b] - excess[b]))
        for a, b in zip(order, order[1:]):
            x = min(excess[a], takes[a])
            if x:
                own = min(x, sink[b])
                excess[a] -= x
                sink[b] -= own
                excess[b] += x - own
                near[a][b] -= x
                near[b][a] += x
    while True:
        level = [-1] * n  # steps to the sink
        wave = [i for i in range(n) if sink[i]]
        for i in wave:
            level[i] = 0
        while wave:
            after = []
            for j in wave:
                for i in near[j]:
                    if level[i] < 0 and near[i][j]:
                        level[i] = level[j] + 1
                        after.append(i)
            wave = after
        starts = [i for i in range(n) if excess[i] and level[i] >= 0]
        if not starts:
            break
        arcs, at = [None] * n, [0] * n
        for start in starts:
            path = [start]
            while path and excess[start]:
                i = path[-1]
                if sink[i]:
                    x = min([excess[start], sink[i], *(near[a][b] for a, b in zip(path, path[1:]))])
                    excess[start] -= x
                    sink[i] -= x
                    cut = len(path)
                    for k in range(len(path) - 1, 0, -1):
                        a, b = path[k - 1], path[k]
                        near[a][b] -= x
                        near[b][a] += x
                        if not near[a][b]:
                            cut = k
                    path = path[:cut]
                    if not sink[i]:
                        level[i] = -1  # nothing more ends here in this round
                        if path[-1] == i:
                            path.pop()
                    continue
                if arcs[i] is None:
                    arcs[i] = [j for j in near[i] if level[j] == level[i] - 1]
                while at[i] < len(arcs[i]) and not (near[i][j := arcs[i][at[i]]] and level[j] == level[i] - 1):
                    at[i] += 1
                if at[i] < len(arcs[i]):
                    path.append(j)
                else:
                    level[i] = -1
                    path.pop()
    reached = [bool(x) for x in excess]
    wave = [i for i in range(n) if excess[i]]
    while wave:
        i = wave.pop()
        for j, w in near[i].items():
            if w and not reached[j]:
                reached[j] = True
                wave.append(j)
    return reached


def costs(found: list, odds: list[int]) -> list[int]:
    return [max(-LIMIT, min(LIMIT, sum(odds[x] for x in f))) + CONTAINER * b[4] for b, f in zip(found, features(found))]


def extract_page(page: str, odds: list[int]) -> tuple[str, int, int]:
    found = blocks(page)
    side = minimum_cut(costs(found, odds), edges(found)) if found else []
    kept = [b[0] for b, s in zip(found, side) if s]
    return "\n".join(kept), len(found), len(kept)


def _extract_batches(odds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES, "html"):
                done = [extract_page(p, odds) for p in text_of(part, "html").to_pylist()]
                text, n, kept = zip(*done)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "url", "text", "n_blocks", "n_content"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of the content, number of blocks and of content blocks, for every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract_batches(train(rows).tolist()), "page_id long, url string, text string, n_blocks int, n_content int")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
