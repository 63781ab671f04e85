"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks of text, each with the marks of the elements around it. Every block
is a node. A logistic classifier over the block's own text (length, share of links, punctuation,
kind of element) and the marks give what either label costs: that is the capacity from the source
(content) or to the sink (boilerplate). Neighbouring blocks are tied by an edge that is the weaker the more
elements begin or end between them, and blocks of one parent by another to the next of
that parent. The minimum cut is the labelling of least cost, found by maximum flow;
blocks on the source's side, in page order, are the main text.

The classifier learns from blocks whose marks say which they are (in an article, in a
menu), of the SAMPLE pages with the smallest hashes of address and id; its features
are classes, so what reaches the driver is one count for each combination of them.

Capacities are integers, so the cut is exact. Blocks that outweigh all their edges keep
their label in every minimum cut; they are set first and their edges become costs of the
neighbours, until the rest, mostly short runs of undecided blocks, goes through the flow.

Defined results: a null or empty page, and one without content, have the empty
text; every row gives a row, rows repeated too; pages of any length are read whole. Elements nested
deeper than DEPTH count as part of the one at that depth. A tag that never ends ends the page, as
browsers do it; other markup errors are passed over. Of equal cuts the one with most content is
taken. Other columns are not read.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

#: Pages that the classifier learns from, at most (rows that repeat a page's id and address come together).
SAMPLE = 2000
DEPTH = 512
#: Units of cost in one nat.
UNIT = 1000
#: What marks cost, in nats: a main element's, that of a name like one, boilerplate's, that of what is never content; and the greatest that the classifier gives.
MAIN, NAMED, BOILERPLATE, NEVER, MOST = 6.0, 3.0, -8.0, -60.0, 4.0
#: Ties between neighbours with nothing between them, and between blocks of one parent.
NEAR, KIN = 1.0, 0.5

# Names of elements, as the HTML standard has them, and words that pages name their parts with.
RAW = set("script style iframe noembed noframes textarea title xmp".split())
MUTE = set("button select datalist svg object audio video canvas noscript template".split())
BLOCKS = set(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol option "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "aside", "nav", "form", "blockquote"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NEVER_TAGS = {"nav", "footer", "aside", "dialog", "menu"}
BAD_TAGS = {"form", "fieldset", "search"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
COMMENTS = re.compile(r"comments?|commentlist|commentarea|commentsection|disqus|replies|respond|guestbook")
BAD_WORDS = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead banner topbar footer colophon sidebar aside rail widget widgets ad ads adv advert adverts advertisement adsense adslot "
    "sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login register share sharing "
    "social follow related recommended recommendations recirculation pagination pager paging search form toolbar skip copyright legal disclaimer hidden taboola outbrain".split()
)
GOOD_WORDS = set("article articlebody post postbody entry content story text main maincontent body prose".split())
STATES = {"has", "with", "no", "without", "is", "not", "js"}
_FIND = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_MARKUP = re.compile(r"<(?:!--|[!?/a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/\"']|$)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Element:
    name: str
    #: 2 inside a main element, 1 inside what is named like one, -1 inside boilerplate, -2 inside what is never content and readers' comments, 0 elsewhere.
    mark: int
    serial: int
    #: Elements of its name that began inside it and aren't on the stack.
    nested: int = 0


@dataclass
class Block:
    text: str
    name: str
    mark: int
    parent: int
    #: Elements that begin or end between the block before and this one.
    apart: int
    linked: int = 0


def _words(value: str) -> set[str]:
    """Words of names: menu-item, menuItem and menuitem; none of a name that tells a state (has-sidebar) or is a sentence."""
    out = set()
    for name in value.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if parts and parts[0] not in STATES and len(parts) <= 4:
            out.update(parts, ["".join(parts)])
    return out


def mark_of(name: str, attributes: str, around: int) -> int:
    """The mark of what stands in an element, by its name, role and names of class and id, and by the mark around it."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    words = _words(f"{found.get('class', '')} {'' if name in HEADINGS else found.get('id', '')}")
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", ""))
    if around == -2 or name in NEVER_TAGS or unseen or any(COMMENTS.fullmatch(w) for w in words):
        return -2
    role, bad = found.get("role", "").strip().lower(), words & BAD_WORDS
    if name == "main" or role == "main" or (name == "article" or role == "article" or found.get("itemprop") == "articleBody") and not bad:
        return 2
    if around == -1:
        return -1
    if around > 0 or words & GOOD_WORDS:
        bad.discard("header")
    if name in BAD_TAGS or role in BAD_ROLES or bad or name == "header" and around <= 0:
        return -1
    return max(around, 1) if words & GOOD_WORDS else around


class _Reader:
    """Blocks of a page from its tags and runs of text, in order."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack = [Element("", 0, 0)]
        self.runs: list[str] = []
        self.linked = self.apart = self.serial = 0
        #: Depth of the stack where an open link, and what is left out, began; 0 for none.
        self.link = self.mute = 0
        self.muted, self.nested = "", 0

    def say(self, raw: str) -> None:
        if not self.mute:
            run = html.unescape(raw)
            self.runs.append(run)
            if self.link:
                self.linked += len("".join(run.split()))

    def end_block(self) -> None:
        said = " ".join("".join(self.runs).split())
        if said:
            top = self.stack[-1]
            self.blocks.append(Block(said, top.name, top.mark, top.serial, self.apart, self.linked))
            self.apart = 0
        self.runs, self.linked = [], 0

    def push(self, name: str, mark: int) -> None:
        if len(self.stack) < DEPTH:
            self.serial += 1
            self.stack.append(Element(name, mark, self.serial))

    def cut(self, k: int) -> None:
        """Leave the elements from place k on, and what began in them."""
        del self.stack[k:]
        self.link = 0 if self.link > k else self.link
        self.mute = 0 if self.mute > k else self.mute

    def start(self, name: str, attributes: str) -> None:
        own = attributes.endswith("/")
        if self.mute and name == self.muted:
            self.nested += not own
        elif name in ("br", "hr", "html", "head", "body"):
            self.runs.append(" ")
            if name != "br":
                self.end_block()
        elif name in MUTE:
            if not self.mute and not (own and name == "svg"):
                self.mute, self.muted, self.nested = len(self.stack), name, 0
        elif name in BLOCKS:
            self.end_block()
            self.apart += 1
            self._imply(name)
            if name in ("article", "main"):
                self.mute = 0  # what was never closed doesn't hold the text
            self.push(name, mark_of(name, attributes, self.stack[-1].mark))
        else:
            top = self.stack[-1]
            if name == "a":
                self.link = len(self.stack)
            if attributes and not own and name not in ("img", "input", "wbr", "source", "meta", "link", "col", "area", "track", "embed", "param"):
                mark = mark_of(name, attributes, top.mark)
                if mark == -2 < top.mark or mark == -1 < top.mark and top.name not in ("p", "li", "td", "th", "dd", *HEADINGS):
                    self.end_block()  # an inline element that stands for itself
                    self.push(name, mark)
                    return
            top.nested += top.name == name

    def _imply(self, name: str) -> None:
        """Leave an open paragraph, and a like element of the same list or table, which end without a tag."""
        k = len(self.stack) - 1
        while k and self.stack[k].name not in BLOCKS:
            k -= 1
        if k and self.stack[k].name == "p":
            self.cut(k)
        ends = CLOSES.get(name, ())
        k = len(self.stack) - 1 if ends else 0
        while k and self.stack[k].name not in HOLDERS:
            if self.stack[k].name in ends:
                self.cut(k)
                break
            k -= 1

    def end(self, name: str) -> None:
        if self.mute and name == self.muted:
            self.nested -= 1
            self.mute = 0 if self.nested < 0 else self.mute
            return
        if name == "a":
            self.link = 0
        if name in BLOCKS:
            self.end_block()
            self.apart += 1
        elif self.stack[-1].name == name and self.stack[-1].nested:
            self.stack[-1].nested -= 1
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == name:
                self.end_block()
                self.cut(k)
                break
            if self.stack[k].name in BLOCKS and (name not in BLOCKS or name == "p" and self.stack[k].name in HOLDERS):
                break


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, character references decoded, white space within them one space."""
    reader, at, n = _Reader(), 0, len(page)
    while at < n:
        found = _MARKUP.search(page, at)
        begin = found.start() if found else n
        if begin > at:
            reader.say(page[at:begin])
        if not found:
            break
        if found[0] == "<!--":
            end = page.find("-->", begin + 2)
            at = n if end < 0 else end + 3
            continue
        tag = _TAG.match(page, begin)
        if not tag:
            end = page.find(">", begin)
            at = n if end < 0 else end + 1  # a declaration, or what can't be a tag
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            reader.end(name)
        elif name in RAW:
            close = _FIND[name].search(page, at)
            at = page.find(">", close.end()) + 1 if close else n
            at = at or n
        else:
            reader.start(name, tag[3].rstrip())
    reader.end_block()
    return reader.blocks


#: Bounds of a feature's classes.
_LENGTH, _LINKS, _STOPS = (3, 8, 16, 32, 64), (0.01, 0.34, 0.67), (0.5, 1.5, 3.5)
FEATURES = (len(_LENGTH) + 1, len(_LINKS) + 1, len(_STOPS) + 1, 2, 4)
_STOP = re.compile(r"[.!?,;:](?=\s|$)")


def classes(block: Block) -> tuple[int, ...]:
    """What the classifier sees of a block: words, share of linked letters, stops and commas, an end like a sentence's, kind of element."""
    words = block.text.count(" ") + 1
    letters = max(1, len(block.text) - words + 1)
    stops = len(_STOP.findall(block.text))
    kind = 0 if block.name == "p" else 1 if block.name in HEADINGS else 2 if block.name in ("li", "dd", "dt", "td", "th") else 3
    place = lambda bounds, x: sum(x >= b for b in bounds)
    return place(_LENGTH, words), place(_LINKS, block.linked / letters), place(_STOPS, stops), int(block.text[-1] in ".!?…。"), kind


def _design(rows: list[tuple[int, ...]]) -> np.ndarray:
    """One column for each class of each feature, and one of ones."""
    at = np.cumsum((0, *FEATURES))
    out = np.zeros((len(rows), at[-1] + 1))
    for k in range(len(FEATURES)):
        out[np.arange(len(rows)), [at[k] + r[k] for r in rows]] = 1
    out[:, -1] = 1
    return out


def fit_logistic(counts: list[tuple[tuple[int, ...], int, int]], ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights from (classes, label, blocks) by Newton's steps; both labels weigh the same in total."""
    x, y = _design([c for c, _, _ in counts]), np.array([k for _, k, _ in counts], float)
    n = np.array([m for _, _, m in counts], float)
    whole = min(n.sum(), 2000)
    for k in (0, 1):
        n[y == k] *= whole / 2 / n[y == k].sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, zeros where the sample's marks don't show both labels."""
    rows = pages.select(F.xxhash64("page_id", "url").alias("h"), "html")
    limit = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return np.zeros(sum(FEATURES) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for page in texts(batch, "html"):
                for b in blocks_of(page):
                    if b.mark:
                        key = (*classes(b), int(b.mark > 0))
                        seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(seen.values(), pa.int64())], ["key", "n"])

    counted = rows.where(F.col("h") <= limit).select("html").mapInArrow(run, "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    counts = [(tuple(r["key"][:-1]), r["key"][-1], r["n"]) for r in sorted(counted, key=lambda r: r["key"])]
    if {k for _, k, _ in counts} != {0, 1}:
        return np.zeros(sum(FEATURES) + 1)
    return fit_logistic(counts)


def costs(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """For each block what it costs to call it boilerplate, less what it costs to call it content."""
    seen = [classes(b) for b in blocks]
    different = sorted(set(seen))
    own = dict(zip(different, np.clip(_design(different) @ weights, -MOST, MOST).tolist()))
    extra = {2: MAIN, 1: NAMED, 0: 0.0, -1: BOILERPLATE, -2: NEVER}
    return [round(UNIT * (own[c] + extra[b.mark])) for b, c in zip(blocks, seen)]


def ties(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, later block, cost of a cut between them): the next block, and the next of one parent."""
    out, seen = [], {}
    for k, b in enumerate(blocks):
        if k:
            out.append((k - 1, k, round(UNIT * NEAR / (1 + b.apart / 2))))
        before = seen.get(b.parent)
        if before is not None:
            out.append((before, k, round(UNIT * KIN)))
        seen[b.parent] = k
    return out


def cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: a True block loses max(0, -gain), a False one max(0, gain), an edge with both labels its weight."""
    n, gain = len(gain), list(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    sure = deque(k for k in range(n) if abs(gain[k]) > sum(near[k].values()) or not near[k])
    while sure:  # a block that outweighs its edges keeps its label in every minimum cut
        k = sure.popleft()
        if label[k] is not None:
            continue
        label[k] = gain[k] >= 0
        for o, c in near[k].items():
            if label[o] is None:
                del near[o][k]
                gain[o] += c if label[k] else -c
                if abs(gain[o]) > sum(near[o].values()) or not near[o]:
                    sure.append(o)
        near[k] = {}
    open_ = [k for k in range(n) if label[k] is None]
    if open_:
        flow(open_, gain, near)
        reached = _reaching_sink(open_, gain, near)
        for k in open_:
            label[k] = k not in reached
    return [bool(x) for x in label]


def flow(open_: list[int], gain: list[int], near: list[dict[int, int]]) -> None:
    """Push all excess (gain above 0) along residual edges to deficits (below 0) by shortest ways; leaves residuals in near and gain.

    Dinic's phases: levels by distance to a deficit, then excess goes down level by level.
    """
    while True:
        level = {k: 0 for k in open_ if gain[k] < 0}
        queue = deque(level)
        while queue:
            k = queue.popleft()
            for o in near[k]:
                if o not in level and near[o][k] > 0:
                    level[o] = level[k] + 1
                    queue.append(o)
        todo = [(-level[k], k) for k in open_ if gain[k] > 0 and k in level]
        if not todo:
            return
        heapq.heapify(todo)
        held = {k for _, k in todo}
        moved = False
        while todo:  # from the highest level down, so that a block's excess is whole when it is passed on
            high, k = heapq.heappop(todo)
            held.discard(k)
            for o, c in list(near[k].items()):
                if gain[k] <= 0:
                    break
                if c > 0 and level.get(o, -1) == -high - 1:
                    # what lies beyond a block's reach waits there for the next phase
                    push = min(gain[k], c)
                    near[k][o] -= push
                    near[o][k] += push
                    gain[k] -= push
                    gain[o] += push
                    moved = True
                    if gain[o] > 0 and level[o] and o not in held:
                        heapq.heappush(todo, (-level[o], o))
                        held.add(o)
        if not moved:
            return


def _reaching_sink(open_: list[int], gain: list[int], near: list[dict[int, int]]) -> set[int]:
    """Blocks from which a deficit can still be reached: the sink's side, the smallest of all minimum cuts."""
    out = {k for k in open_ if gain[k] < 0}
    queue = deque(out)
    while queue:
        k = queue.popleft()
        for o in near[k]:
            if o not in out and near[o][k] > 0:
                out.add(o)
                queue.append(o)
    return out


def main_text(page: str, weights: np.ndarray) -> str:
    """The blocks on the side of content, joined by an empty line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = cut(costs(blocks, weights), ties(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, weights) for page in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
