"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier gives each block the cost of either label: these are the capacities to
the two terminals. Edges between blocks that follow each other and between blocks that are near in the tree make different labels
of neighbours costly. The maximum flow separates content from boilerplate; what stays on the content side is the text.
The classifier is fitted on generated pages of known labels, half of them without any class or id, so no hand-set weights are involved.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import sliced

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head noscript template svg canvas object audio video select button datalist map".split())
#: What a head can hold; any other element, or text, ends it, as its end tag is optional.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of other languages, where ``/>`` closes an element; in HTML's own it means nothing.
FOREIGN = {"svg", "math"}
#: Opening one of these ends an open element of the same kind, up to the element that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search"}
CONTENT_CUES = set("article content entry main story body post text prose".split())
BOILER_CUES = set(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr header "
    "legal login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup privacy promo promotion related reply replies "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar topbar trending warning widget alert contentinfo complementary".split()
)
SEQUENCE, PROXIMITY = 0.45, 0.35

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?P<end>>|\Z)|[!?/](?P<junk>[^>]*)(?:>|\Z))""", re.S)
_LOOSE = re.compile(r"<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: The end of a tag is that of an unquoted value, to which a last slash belongs.
_VALUE_END = re.compile(r"""=\s*[^\s"'>]+\Z""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    name: str
    depth: int
    parent: Node | None
    hidden: bool
    good_at: int | None = None
    bad_at: int | None = None
    in_list: bool = False
    in_cell: bool = False
    chars: int = 0
    linked: int = 0

    def below(self, name: str, good: bool, bad: bool, hidden: bool) -> Node:
        """A child. What its ancestors say is kept with it: depth of the first element that speaks for content and of the last that speaks against it."""
        depth = self.depth + 1
        good_at = depth if self.good_at is None and good else self.good_at
        bad_at = depth if bad and not (name == "header" and good_at is not None) else self.bad_at
        return Node(name, depth, self, hidden or self.hidden, good_at, bad_at, self.in_list or name == "li", self.in_cell or name in ("td", "th"))


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    words: int
    link_share: float
    page: Node


@lru_cache(4096)
def _cues(attrs: str) -> tuple[bool, bool, bool]:
    """(speaks for content, speaks for boilerplate, is not shown)"""
    good = bad = hidden = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for token in _WORD.findall(value):
                good |= token.lower() in CONTENT_CUES
                bad |= token.lower() in BOILER_CUES
        else:
            hidden |= name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value.lower() == "true")
    return good and not bad, bad, hidden


def blocks_of(html: str | None) -> list[Block]:
    """The non-empty text blocks in page order. Inline tags and line breaks don't end a block; a break is white space."""
    html = html or ""
    root = Node("html", 0, None, False)
    stack, out, parts, links, linked, nodes, open_ = [root], [], [], 0, 0, [root], Counter()

    def close(k: int) -> None:
        """End the open elements from place k on."""
        open_.subtract(n.name for n in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text and not stack[-1].hidden:
                holder = next(n for n in reversed(stack) if n.name in BLOCKS)
                holder.chars += len(text)
                holder.linked += min(linked, len(text))
                out.append(Block(text, holder, text.count(" ") + 1, min(1.0, linked / len(text)), root))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if stack[-1].name == "head" and text.strip():
            flush()
            close(len(stack) - 1)
        parts.append(text)
        if links:
            linked += len(text.strip())

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = _TAG.match(html, lt)
        if m is None and (m := _LOOSE.match(html, lt)) is not None:  # a stray quote in a tag
            at = m.end()
            continue
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        name = m.group("name")
        if name is None or not m.group("end"):
            continue  # a comment, a declaration, or a tag that the end of the page cuts off
        name = name.lower()
        if m.group("close"):
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS or name in HIDDEN:
                flush()
                for k in range(len(stack) - 1, 0, -1) if open_[name] > 0 else ():
                    if stack[k].name == name:
                        close(k)
                        break
            continue
        if name not in HEAD and stack[-1].name == "head":
            flush()
            close(len(stack) - 1)
        if (attrs := m.group("attrs")).endswith("/") and not _VALUE_END.search(attrs) and (name in FOREIGN or open_["svg"] > 0):
            flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name in RAW:
            last = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if last is None:
                break
            at = html.find(">", last.start())
            at = end if at < 0 else at + 1
            continue
        if name == "a":
            links += 1
        if name in BLOCKS or name in HIDDEN:
            flush()
            if name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        close(k)
                        break
                    if stack[k].name in BLOCKS:
                        break
                if name in ENDS:
                    same, bound = ENDS[name]
                    for k in range(len(stack) - 1, 0, -1) if any(open_[x] > 0 for x in same) else ():
                        if stack[k].name in bound:
                            break
                        if stack[k].name in same:
                            close(k)
                            break
            if name not in VOID:
                good, bad, hidden = _cues(m.group("attrs"))
                if name in ("body", "html"):
                    good = bad = False
                stack.append(stack[-1].below(name, good or name in CONTENT_TAGS and not bad, bad or name in BOILER_TAGS, hidden or name in HIDDEN))
                nodes.append(stack[-1])
                open_[name] += 1
        elif name in VOID:
            if name != "wbr":
                add(" ")
    flush()
    for n in reversed(nodes[1:]):  # children come after their parents
        n.parent.chars += n.chars
        n.parent.linked += n.linked
    return out


def features(b: Block) -> list[float]:
    """What the classifier sees of a block: its place in the tree, the texts around it, and the form of its own text."""
    n, up = b.node, b.node.parent or b.node
    far = up.parent or up
    return [
        1.0,
        float(n.good_at is not None),
        float(n.bad_at is not None and (n.good_at is None or n.bad_at >= n.good_at)),
        float(n.bad_at is not None and n.good_at is not None and n.bad_at < n.good_at),
        b.link_share,
        up.linked / max(1, up.chars),
        far.linked / max(1, far.chars),
        (up.chars - up.linked) / max(1, b.page.chars),
        (far.chars - far.linked) / max(1, b.page.chars),
        min(1.0, np.log1p(b.words) / 4),
        float(n.name in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float(n.name in ("p", "pre", "blockquote")),
        float(n.in_list),
        float(n.in_cell),
        float(b.text[-1] in ".!?:;\"”»…"),
        float(n.good_at is None and ("©" in b.text or "all rights reserved" in b.text.lower())),
        float(b.words < 4),
    ]


#: Places of a generated page: {} is filled with texts. Half of the pages carry no class or id at all.
_GOOD = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<article><section>{}</section><section>{}</section></article>", "<article><header><h1>{t}</h1></header>{}</article>", "<div><div>{}</div></div>", "<div>{}{}</div>", "<table><tr><td>{}</td></tr></table>"]
_GOOD_NAMED = ["<div class='content'>{}</div>", "<div id='main-content'><div>{}</div></div>", "<article class='post'>{}</article>", "<div class='entry-text'>{}</div>"]
_BAD = ["<nav><ul>{l}{l}{l}{l}</ul></nav>", "<div><ul>{l}{l}{l}</ul></div>", "<header><h2>{t}</h2></header>", "<aside><p>{s}</p><ul>{l}{l}</ul></aside>", "<footer><p>{s}</p></footer>", "<footer><ul>{l}{l}</ul></footer>", "<form><label>{t}</label><p>{s}</p></form>", "<div>&copy; {t}</div>", "<div><p>{t} all rights reserved.</p></div>", "<div>{a} | {a} | {a}</div>"]
_BAD_NAMED = ["<div class='ad'>{s}</div>", "<div class='cookie-notice'><p>{s}</p></div>", "<section id='comments'>{}</section>", "<div class='sidebar'>{}</div>", "<div id='comments'><article>{}</article></div>", "<div class='newsletter'><p>{s}</p></div>", "<div role='banner'>{t}</div>", "<div class='menu'><ul>{l}{l}</ul></div>"]
#: Boilerplate within the content.
_INNER_BAD = ["<div class='ad'>{s}</div>", "<aside><p>{s}</p></aside>", "<div class='comments'>{}</div>", "<div class='related'><ul>{l}{l}{l}</ul></div>", "<footer><p>{s}</p></footer>", "<nav><ul>{l}{l}</ul></nav>", "<ul>{l}{l}{l}</ul>"]
_TEXTS = ["{p}{p}", "<h2>{s}</h2>{p}", "<h1>{s}</h1>{p}{p}", "<ul><li>{s}.</li><li>{s}</li></ul>{p}", "<blockquote>{s}.</blockquote>{p}", "<table><tr><td>{t}</td><td>{s}</td></tr></table>", "<pre>{s}</pre>", "<p>{s} {a} {s}.</p>", "<h3>{t}</h3>{p}", "<p>{t}</p>"]


def training_pages(count: int = 160, seed: int = 4) -> list[str]:
    """Whole generated pages. Words of content consist of the letter c, those of boilerplate of the letter b, which no feature sees."""
    rng = np.random.default_rng(seed)

    def fill(form: str, letter: str) -> str:
        say = lambda low, high: " ".join(letter * int(k) for k in rng.integers(2, 9, int(rng.integers(low, high))))
        one = {
            "{p}": lambda: f"<p>{say(4, 90)}{rng.choice(['.', '.', '!', ''])}</p>", "{s}": lambda: say(5, 20), "{t}": lambda: say(1, 4),
            "{a}": lambda: f"<a href=x>{say(1, 4)}</a>", "{l}": lambda: f"<li><a href=x>{say(1, 4)}</a></li>", "{}": lambda: fill("".join(rng.choice(_TEXTS, int(rng.integers(1, 4)))), letter),
        }
        return re.sub(r"\{\w?\}", lambda m: one[m[0]](), form)

    out = []
    for k in range(count):
        good, bad = (_GOOD, _BAD) if k % 2 else (_GOOD + _GOOD_NAMED, _BAD + _BAD_NAMED)
        some = lambda n: "".join(fill(str(x), "b") for x in rng.choice(bad, int(rng.integers(0, n))))  # noqa: B023, E731
        inner = fill(str(rng.choice(_INNER_BAD[: 7 if k % 2 == 0 else 0] or [""])), "b") if rng.random() < 0.4 else ""
        main = fill(str(rng.choice(good)).replace("{}", "{}" + "\0" + "{}", 1), "c").replace("\0", inner)
        out.append(f"<html><body>{some(4)}{main}{some(4)}</body></html>")
    return out


@lru_cache(1)
def weights() -> tuple[float, ...]:
    """Ridge-penalised logistic regression on the generated pages, by Newton steps."""
    rows = [(features(b), next(c for c in b.text if c in "bc") == "c") for page in training_pages() for b in blocks_of(page)]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (p - y) + 0.5 * w)
    return tuple(w.tolist())


class Flow:
    """Maximum flow by level graphs (Dinic); both directions of an edge are kept side by side."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[float] = []

    def edge(self, a: int, b: int, forward: float, backward: float = 0.0) -> None:
        for node, to, capacity in ((a, b, forward), (b, a, backward)):
            self.out[node].append(len(self.to))
            self.to.append(to)
            self.left.append(capacity)

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.left[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Which nodes the source still reaches when the flow is at its maximum."""
        while (level := self._levels(source))[sink] >= 0:
            place = [0] * len(self.out)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    least = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= least
                        self.left[e ^ 1] += least
                    cut = next(k for k, e in enumerate(path) if self.left[e] <= 1e-12)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.out[a]
                while place[a] < len(edges):
                    e = edges[place[a]]
                    if self.left[e] > 1e-12 and level[self.to[e]] == level[a] + 1:
                        break
                    place[a] += 1
                else:
                    if a == source:
                        break
                    level[a] = -1
                    e = path.pop()
                    a = self.to[e ^ 1]
                    place[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
        return [x >= 0 for x in level]


def label(blocks: list[Block], w: tuple[float, ...]) -> list[bool]:
    """True for content: the labelling of least total cost."""
    if not blocks:
        return []
    z = np.clip(np.array([features(b) for b in blocks]) @ np.array(w), -20, 20)
    n = len(blocks)
    flow = Flow(n + 2)
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        flow.edge(n, i, float(np.log1p(np.exp(z[i]))))  # paid when the block is called boilerplate
        flow.edge(i, n + 1, float(np.log1p(np.exp(-z[i]))))  # paid when it is called content
        if i:
            flow.edge(i - 1, i, SEQUENCE, SEQUENCE)
        up, near = b.node.parent, PROXIMITY
        for _ in range(2):
            if up is None:
                break
            if (j := last_of.get(id(up))) is not None and j != i - 1:
                flow.edge(j, i, near, near)
            last_of[id(up)] = i
            up, near = up.parent, near / 2
    return flow.source_side(n, n + 1)[:n]


def main_text(html: str | None, w: tuple[float, ...] | None = None) -> str:
    blocks = blocks_of(html)
    keep = label(blocks, w or weights())
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, repeated rows too.

    Null and empty pages, and pages without content, give an empty text. Whole pages are read, however long or broken; a tag
    that the end of the page cuts off is left out. An empty table gives an empty result. Only the named columns are read.
    """
    import pyarrow as pa

    w = weights()

    def run(batches):
        for batch in sliced(batches):
            texts = [main_text(h, w) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"cast(`{html_col}` AS string) AS html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
