"""Main text of HTML pages by minimum-cut labelling of their blocks.

1. A page is read into blocks of text, each with the chain of block elements
   (containers) that it stands in.  Scripts, styles, comments and the head have no
   text; references are decoded; `<br>` is white space.
2. A logistic classifier says how likely each block belongs to the article, from
   the names of its containers (tags, roles, classes and ids), its share of
   linked text, its length, its end and its kind of element.  It is fitted once
   on the driver, on `n_pages` labelled pages that labelled_pages() writes in
   layouts of many kinds; nothing of it depends on the size of the table.
3. Its costs (minus the logarithms of both likelihoods) are the capacities of the
   block from the source, the article, and to the sink, the rest.  Neighbours in
   the page are joined by an edge whose capacity falls with their distance in the
   tree, and each block and container by an edge to the container around it, so
   that whatever stands close together tends to one label.  A minimum cut parts
   article and rest.  Nodes whose own capacity outweighs all their edges lie on
   its side of some minimum cut and are settled first, which takes their edges
   into their neighbours' capacities; augmenting paths part what is left.

Every page is labelled by itself in one task, in time and memory that follow its
length; there is no shuffle.

Cases: a null or empty page, or one without any article text, gives an empty
text and 0 code points; repeated rows and equal or null ids are rows like any
other; elements that are never closed end with their parent; an unclosed script or
comment takes the rest of the page; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_batches

#: Elements whose text is not part of the page's text, up to their end tag.
RAW = frozenset("script style template title textarea iframe noembed noframes xmp svg math select object canvas audio video".split())
#: Elements that are not containers; all others end a block at both of their tags.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same row ends, up to the nearest element of the second set.
_CLOSES = {t: (frozenset(x.split()), frozenset(y.split())) for x, y in (("li", "ul ol menu"), ("dt dd", "dl"), ("td th", "tr table"), ("tr", "tbody thead tfoot table"), ("tbody thead tfoot", "table")) for t in x.split()}
_IN_P = frozenset("li dt dd td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Parts of names that stand for what is beside the article, weakly (what an article may have itself), and for the article.
BESIDE = frozenset(
    "ad ads adv advert advertisement adverts adsense alert aside banner breadcrumb breadcrumbs byline caption comment comments commentlist consent cookie cookies copyright dialog disclaimer discussion disqus feedback follow footer form gdpr "
    "legal links login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popular popup promo promotion promoted rail recommend recommended register related replies reply respond review reviews "
    "search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription survey tagcloud tags teaser toolbar topbar trending widget widgets".split()
) - {"caption"}
WEAK = frozenset("bottom head header meta more top".split())
ARTICLE = frozenset("article blog body content entry main post prose story text".split())
_TAGS = {t: -1 for t in "nav header footer aside form dialog menu noscript button fieldset".split()} | {"article": 1, "main": 1}
_ROLES = {r: -1 for r in "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()} | {"main": 1, "article": 1}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")

#: Features of a block beside the constant, see _features().
N_FEATURES = 12


class Block:
    """A block of text: where it stands, what it says, and how much of it is linked."""

    __slots__ = ("at", "text", "linked")

    def __init__(self, at: int, text: str, linked: int):
        self.at, self.text, self.linked = at, text, linked


class Container:
    """A block element: its parent, depth, tag, and what its own name and those around it say (1 article, -1 beside it, 0 nothing)."""

    __slots__ = ("parent", "depth", "tag", "nearest", "beside", "inside")

    def __init__(self, parent: int, above: Container | None, tag: str, says: int):
        self.parent, self.tag = parent, tag
        self.depth = above.depth + 1 if above else 0
        self.nearest = says or (above.nearest if above else 0)
        self.beside = says < 0 or bool(above and above.beside)
        self.inside = says > 0 or bool(above and above.inside)


def _says(tag: str, attributes: str, above: Container) -> int:
    """What a container's tag, role and names say."""
    if tag in ("html", "body"):
        return 0
    says = _TAGS.get(tag, 0)
    if tag == "header" and above.nearest > 0:
        says = 0  # an article's own
    if attributes:
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return -1
        role = _ROLES.get(found.get("role", "").lower(), 0)
        parts = {p.lower() for p in _PART.findall(found.get("class", "") + " " + found.get("id", ""))}
        if role < 0 or parts & BESIDE:
            return -1
        if parts & ARTICLE:
            return says if says else 0 if parts & WEAK else 1
        if role:
            return role
        if parts & WEAK and not says and above.nearest <= 0:
            return -1
    return says


def read_blocks(page: str) -> tuple[list[Block], list[Container]]:
    """The blocks of a page in order, and its containers, the first of which is the page."""
    containers, blocks = [Container(-1, None, "", 0)], []
    open_at, runs = [0], []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                blocks.append(Block(open_at[-1], text, linked))
            runs.clear()
        linked = 0

    def close_to(level: int) -> None:
        nonlocal in_link
        flush()
        del open_at[level:]
        in_link = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            runs.append(text)
            if in_link:
                linked += len("".join(text.split()))

    place = 0
    while found := _TOKEN.search(page, place):
        add(page[place : found.start()])
        place = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                in_link = 0
            elif tag not in INLINE:
                for level in range(len(open_at) - 1, 0, -1):
                    if containers[open_at[level]].tag == tag:
                        close_to(level)
                        break
                else:
                    flush()
            continue
        if tag in RAW and not found[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, place)
            place = page.find(">", end.start()) + 1 if end else len(page)
            place = place or len(page)
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br":
            runs.append("\n")
        elif tag == "head":
            end = re.compile(r"</head\s*>|<body", re.I).search(page, place)
            place = end.start() if end else place
        elif tag not in INLINE:
            if tag in VOID:
                flush()
                continue
            if tag in _CLOSES:
                same, around = _CLOSES[tag]
                for level in range(len(open_at) - 1, 0, -1):
                    name = containers[open_at[level]].tag
                    if name in same:
                        close_to(level)
                        break
                    if name in around:
                        break
            # A block element ends an open paragraph.
            if containers[open_at[-1]].tag == "p" or containers[open_at[-1]].tag in _HEADINGS and tag in _HEADINGS:
                close_to(len(open_at) - 1)
            flush()
            above = containers[open_at[-1]]
            containers.append(Container(open_at[-1], above, tag, _says(tag, found[3], above)))
            open_at.append(len(containers) - 1)
    add(page[place:])
    flush()
    return blocks, containers


def _features(block: Block, container: Container) -> list[float]:
    text = block.text
    words = text.count(" ") + 1
    chars = len(text) - words + 1
    share = block.linked / chars if chars else 0.0
    tag = container.tag
    return [
        1.0, float(container.nearest > 0), float(container.nearest < 0), float(container.beside), float(container.inside and not container.beside), share,
        min(words, 100) ** 0.5 / 10, float(words < 5), float(_END.search(text) is not None), float(tag == "p" or tag == "blockquote" or tag == "pre"), float(tag in _HEADINGS), float("©" in text or "cookie" in text.lower()),
    ]


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    """n pages in layouts of many kinds, and the blocks of each that are its article."""
    rng = random.Random(seed)
    vowels, consonants = "aeiouäé", "bcdfghklmnprstvwz"
    word = lambda: "".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a, b: some(a, b).capitalize() + rng.choice(".....!?")
    beside, inside = sorted(BESIDE), sorted(ARTICLE)

    def wrapped(tags: tuple[str, ...], names: list[str], body: str, named: float) -> str:
        if rng.random() < 0.5:
            return f"<{(t := rng.choice(tags))}>{body}</{t}>"
        if rng.random() < named:
            name = rng.choice(names)
            name = rng.choice([name, f"{name}-{word()}", f"{word()}_{name}", f"{word()} {name}"])
            return f'<div {rng.choice(["class", "id"])}="{name}">{body}</div>'
        return f"<div>{body}</div>"

    def links() -> str:
        items = [f'<a href="/{word()}">{some(1, 3)}</a>' for _ in range(rng.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else rng.choice([" | ", " "]).join(items)

    def extra() -> str:
        kind = rng.randrange(7)
        if kind == 0:
            return wrapped(("nav", "menu"), beside, links(), 0.9)
        if kind == 1:
            return wrapped(("aside",), beside, f"<h3>{some(1, 3)}</h3>{links()}", 0.9)
        if kind == 2:
            return wrapped(("aside",), beside, prose(3, 25) if rng.random() < 0.5 else f"<p>{prose(3, 25)}</p>", 1)
        if kind == 3:
            return f'<form><label>{some(1, 2)}</label><input><button>{some(1, 1)}</button></form>'
        if kind == 4:
            return wrapped(("aside", "dialog"), beside, f"<p>{prose(5, 30)}</p><button>{some(1, 2)}</button>", 1)
        if kind == 5:
            return wrapped(("aside",), ["comments", "replies", "respond", "discussion"], "".join(f"<div><b>{some(1, 2)}</b><p>{prose(3, 40)}</p></div>" for _ in range(rng.randint(1, 5))), 1)
        return f"<div>{links()}</div>"

    pages = []
    for _ in range(n):
        article, body = [], []
        if rng.random() < 0.8:
            article.append(some(2, 9))
            body.append(f"<h1>{article[-1]}</h1>")
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            text = prose(1, 4) if rng.random() < 0.15 else prose(8, 90)
            if kind < 0.8:
                article.append(text)
                body.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><a href='/'>{text[: len(text) // 9]}</a>{text[len(text) // 9 :]}</p>")
            elif kind < 0.9:
                article.append(some(1, 6))
                body.append(f"<h2>{article[-1]}</h2>")
            else:
                items = [some(3, 15) for _ in range(rng.randint(2, 4))]
                article += items
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            if rng.random() < 0.08:
                body.append(wrapped(("aside",), beside, prose(3, 15), 1))
        text = wrapped(("article", "main"), inside, "".join(body), 0.7)
        head = wrapped(("header",), ["header", "masthead", "banner"], some(1, 4), 0.9)
        foot = wrapped(("footer",), ["footer", "copyright", "legal"], f"&copy; {word()} &middot; {prose(1, 9)}", 0.9)
        before, after = "".join(extra() for _ in range(rng.randint(0, 3))), "".join(extra() for _ in range(rng.randint(0, 3)))
        page = f"{head}{before}{text}{after}{foot}"
        page = f"<div>{page}</div>" if rng.random() < 0.3 else f"<form>{page}</form>" if rng.random() < 0.05 else page
        pages.append((f"<html><head><title>{some(2, 5)}</title></head><body>{page}</body></html>", article))
    return pages


@functools.lru_cache(maxsize=4)
def fit(n_pages: int = 400, seed: int = 7) -> tuple[float, ...]:
    """Weights of the classifier, by Newton's method with a small penalty."""
    x, y = [], []
    for page, article in labelled_pages(n_pages, seed):
        left = deque(article)
        blocks, containers = read_blocks(page)
        for block in blocks:
            own = bool(left) and block.text == left[0]
            if own:
                left.popleft()
            x.append(_features(block, containers[block.at]))
            y.append(own)
    x, y, w = np.array(x), np.array(y, float), np.zeros(N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(N_FEATURES), x.T @ (y - p) - w)
    return tuple(w.tolist())


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    gain is the node's capacity from the source less that to the sink; edges
    (a, b, capacity) go both ways.
    """
    n, gain = len(gain), list(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        a = waiting.popleft()
        if side[a] is not None or abs(gain[a]) < sum(near[a].values()):
            continue
        side[a] = gain[a] > 0
        for b, c in near[a].items():
            gain[b] += c if side[a] else -c
            del near[b][a]
            waiting.append(b)
        near[a].clear()
    rest = [a for a in range(n) if side[a] is None]
    if rest:
        reached = _augment(rest, gain, near)
        for a in rest:
            side[a] = a in reached
    return side


def _augment(nodes: list[int], gain: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow: paths of least length in layers, until the sink is cut off."""
    left = [dict(x) for x in near]
    give = {a: gain[a] for a in nodes if gain[a] > 0}
    take = {a: -gain[a] for a in nodes if gain[a] < 0}
    while True:
        depth = {a: 0 for a, c in give.items() if c}
        queue, hit = deque(depth), False
        while queue:
            a = queue.popleft()
            hit = hit or take.get(a, 0) > 0
            for b, c in left[a].items():
                if c and b not in depth:
                    depth[b] = depth[a] + 1
                    queue.append(b)
        if not hit:
            return set(depth)
        open_edges = {a: list(left[a]) for a in depth}
        for start in [a for a, c in give.items() if c]:
            path = [start]
            while path and give[start]:
                a = path[-1]
                if take.get(a, 0) > 0:
                    flow = min([give[start], take[a], *(left[x][y] for x, y in zip(path, path[1:], strict=False))])
                    give[start] -= flow
                    take[a] -= flow
                    for x, y in zip(path, path[1:], strict=False):
                        left[x][y] -= flow
                        left[y][x] += flow
                    path = [start]
                    continue
                while open_edges[a]:
                    b = open_edges[a][-1]
                    if left[a][b] and depth[b] == depth[a] + 1:
                        path.append(b)
                        break
                    open_edges[a].pop()
                else:
                    path.pop()
                    if path:
                        open_edges[path[-1]].pop()


def article_blocks(page: str, weights: np.ndarray, adjacency: float = 0.6, proximity: float = 0.4) -> list[str]:
    """The texts of the blocks that a minimum cut gives to the article."""
    blocks, containers = read_blocks(page)
    if not blocks:
        return []
    logits = np.clip(np.array([_features(b, containers[b.at]) for b in blocks]) @ weights, -12, 12)
    # The source's capacity less the sink's is the logit itself: -log(1 - p) + log(p).
    used: dict[int, int] = {}
    gain, edges = [round(1000 * x) for x in logits.tolist()], []

    def node(at: int) -> int:
        if at not in used:
            used[at] = len(gain)
            gain.append(0)
            if containers[at].parent >= 0:
                edges.append((used[at], node(containers[at].parent), round(1000 * proximity)))
        return used[at]

    order = sorted({b.at for b in blocks}, key=lambda at: containers[at].depth)
    for at in order:
        chain = []
        while at >= 0 and at not in used:
            chain.append(at)
            at = containers[at].parent
        for x in reversed(chain):
            node(x)
    for i, block in enumerate(blocks):
        edges.append((i, used[block.at], round(1000 * proximity)))
        if i:
            apart = _distance(blocks[i - 1].at, block.at, containers)
            edges.append((i - 1, i, round(1000 * adjacency / (1 + apart / 2))))
    side = min_cut(gain, edges)
    return [b.text for i, b in enumerate(blocks) if side[i]]


def _distance(a: int, b: int, containers: list[Container]) -> int:
    """Steps between two containers in the tree."""
    steps = 0
    while a != b:
        if containers[a].depth >= containers[b].depth:
            a = containers[a].parent
        else:
            b = containers[b].parent
        steps += 1
    return steps


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), n_pages: int = 400) -> DataFrame:
    """The columns `keep` of each row and text: its article's blocks in order, one a line."""
    weights = np.array(fit(n_pages))
    slim = pages.select(*keep, F.col(html_col))
    kinds = dict(slim.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["\n".join(article_blocks(page.as_py() or "", weights)) for page in batch.column(len(keep))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_batches(slim, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))
