"""Problem 6: the main body of a page without what surrounds it.

Method: a tree-structured graphical model over the page's DOM. Every node is content or
surroundings; its own look gives a potential, parent and child are joined by another, and
sum-product messages from the leaves to the root and back give each node's marginal. Both
potentials are trained on labelled pages: a bounded sample whose nodes are labelled by
where they stand to the page's heading.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import spread

#: Bounds of the labelled sample: files it is drawn from, pages, and nodes drawn of each page.
TRAIN_FILES = 64
TRAIN_PAGES = 1500
TRAIN_NODES = 400
#: Features are hashed to so many places.
DIMS = 1 << 17
EPOCHS = 6

# HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PLAIN = frozenset("a b strong em u s code kbd samp sub sup abbr cite q mark time var".split())
OWNERS = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd pre caption figcaption blockquote th td title".split())
CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav main pre h1 h2 h3 h4 h5 h6 blockquote form address td tr th hr figure dialog".split())
BODY_CHAIN = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 pre table tbody thead tr td th blockquote figure figcaption caption header".split())
RAW = frozenset(("script", "style", "noscript", "template", "svg"))
RAW_END = {t: re.compile(f"</{t}", re.I) for t in RAW}
TOKEN = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>|([^<]+|<)", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
PATH = re.compile(r" [»>/›] ")


@dataclass
class Page:
    """Nodes of one page in document order; text sits at the nodes that own it."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    title: str = ""

    def add(self, parent: int, tag: str, names: tuple[str, ...]) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append("")
        self.linked.append(0)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """A forgiving tree builder: implied ends of p and li, unclosed and stray tags."""
    page = Page()
    root = page.add(-1, "root", ())
    stack = [root]
    links, in_title, at, size = 0, False, 0, len(source)
    while at < size:
        m = TOKEN.match(source, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        tag = m.group(2)
        if tag is None:
            raw = m.group(4)
            if raw is None:
                continue
            if in_title:
                page.title += raw
                continue
            if raw.isspace() and not page.text[stack[-1]]:
                continue
            owner = stack[-1]
            for n in reversed(stack):
                if page.tag[n] in OWNERS:
                    owner = n
                    break
                if page.depth[owner] - page.depth[n] > 3:
                    break
            piece = entities.unescape(raw) if "&" in raw else raw
            page.text[owner] += piece
            if links:
                page.linked[owner] += len(piece)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "title":
                in_title = False
            elif tag == "a":
                links = max(0, links - 1)
            elif tag not in PLAIN:
                for k in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[k]] == tag:
                        del stack[k:]
                        links = 0
                        break
            continue
        if tag in VOID:
            if tag == "br":
                for n in reversed(stack):
                    if page.text[n]:
                        page.text[n] += "\n"
                        break
            if tag in CLOSES_P and page.tag[stack[-1]] == "p":
                stack.pop()
            continue
        if tag in RAW:
            found = RAW_END[tag].search(source, at) if m.group(3)[-1:] != "/" else None
            end = at if m.group(3)[-1:] == "/" else found.start() if found else -1
            if end >= 0:
                close = source.find(">", end)
                at = size if close < 0 else max(close + 1, at) if end > at or source.startswith("</", end) else at
            continue
        if tag == "title":
            in_title = not page.title
            continue
        if tag == "a":
            links += 1
            continue
        if tag in PLAIN:
            continue
        if tag in CLOSES_P and page.tag[stack[-1]] == "p":
            top = stack[-1]
            wrapper = tag == "p" and page.names[top] and not page.text[top].strip() and len(page.tag) - 1 == top
            if not wrapper:  # a named p that holds nothing yet is kept as the box of the next
                stack.pop()
        if tag == "li" and page.tag[stack[-1]] == "p":
            stack.pop()
        if tag in ("li", "dt", "dd") and page.tag[stack[-1]] == tag:
            stack.pop()
        names = tuple(n for g in NAMES.findall(m.group(3)) for n in (f"{g[0].lower()}={x.lower()}" for x in (g[1] or g[2] or g[3]).split())) if m.group(3) else ()
        stack.append(page.add(stack[-1], tag, names))
        if m.group(3)[-1:] == "/":
            stack.pop()
    return page


def _even(s: str) -> str:
    return SPACE.sub(" ", s).strip()


class _Place(dict):
    """Feature to its hashed place."""

    def __missing__(self, name: str) -> int:
        if len(self) > 300_000:
            self.clear()
        v = self[name] = xxhash.xxh3_64_intdigest(name) % DIMS
        return v


class _Sum(dict):
    """Key to the summed weights of the features it stands for; bounded."""

    def __init__(self, names, place: _Place, weights: np.ndarray):
        self.names, self.place, self.weights = names, place, weights

    def __missing__(self, key) -> float:
        if len(self) > 100_000:
            self.clear()
        v = self[key] = float(sum(self.weights[self.place[f]] for f in self.names(key)))
        return v


def look_of_text(key: tuple[str, bool, bool, bool, bool]) -> list[str]:
    """Features of a text: length, links, signs, its first and last words, and how it fits the title."""
    text, some_link, most_link, is_title, has_title = key
    n = len(text)
    words = WORD.findall(text.lower())
    first, last = text[0], text[-1]
    out = [
        f"len:{n.bit_length()}",
        f"link:{some_link + most_link}",
        f"end:{'.' if last in '.!?…。”“»' else 'a' if last.isalpha() else '0' if last.isdigit() else last}",
        f"start:{'a' if first.islower() else 'A' if first.isalpha() else '0' if first.isdigit() else first}",
        f"sent:{min(text.count('. '), 3)}:{n.bit_length()}",
    ]
    out += [f"sign:{c}" for c in "|·©»>/«@%:" if c in text]
    if words:
        out += [f"w1:{words[0]}", "w2:" + " ".join(words[:2]), "w3:" + " ".join(words[:3]), f"z:{words[-1]}"]
    out += [f"any:{w}" for w in set(words)]
    if is_title:
        out.append("title:is")
    elif has_title:
        out.append("title:in")
    return out


def look_of_node(key: tuple) -> list[str]:
    """Features of a node without its text: tag, names, parent and place."""
    tag, names, above, names_above, inside, after, is_box, in_box = key
    out = ["bias", f"t:{tag}", f"in:{inside}:{tag}", f"after:{after}", f"pt:{above}>{tag}", f"box:{is_box}", f"child:{in_box}:{tag}"]
    out += [f"pc:{c}" for c in names_above] + [f"c:{c}" for c in names] + [f"ct:{tag}:{c}" for c in names]
    return out


def heading(page: Page) -> int:
    """The node of the page's heading, or -1.

    Without an h1 it is the first text that an earlier, longer one (a path of links) ends
    with, else the first that is the page's title.
    """
    for i, t in enumerate(page.tag):
        if t == "h1":
            return i
    texts = [(i, _even(t)) for i, t in enumerate(page.text) if t and not t.isspace()]
    paths = [(i, t) for i, t in texts if PATH.search(t) and not page.linked[i]]
    for i, t in texts:
        if len(t) > 2 and any(j < i and len(p) > len(t) and p.endswith(t) and PATH.match(p[len(p) - len(t) - 3 :][:3]) for j, p in paths):
            return i
    title = _even(page.title)
    return next((i for i, t in texts if len(t) > 2 and t == title), -1)


def keys_of(page: Page, blind: bool = False) -> list[tuple[tuple, tuple | None]]:
    """(look_of_node key, look_of_text key or None) of every node; blind: as if there were no heading."""
    head = -1 if blind else heading(page)
    box = page.parent[head] if head >= 0 else -1
    if box >= 0 and page.tag[box] in ("header", "hgroup"):
        box = page.parent[box]
    inside = [False] * len(page.tag)
    title = _even(page.title).lower()
    part = title[: max(6, len(title) * 2 // 3)] if len(title) > 5 else None
    out = []
    for i, tag in enumerate(page.tag):
        p = page.parent[i]
        inside[i] = i == box or (p >= 0 and inside[p])
        node = (tag, page.names[i], page.tag[p] if p >= 0 else "", page.names[p] if p >= 0 else (), inside[i], head >= 0 and i > head, i == box, p == box and box >= 0)
        text = page.text[i]
        look = None
        if text and not text.isspace():
            text = _even(text)
            mine = text.lower() if title else ""
            look = (text, page.linked[i] > 0, page.linked[i] * 2 > len(text), len(mine) > 3 and title.startswith(mine), bool(part) and part in mine)
        out.append((node, look))
    return out


def features(page: Page, blind: bool = False) -> list[list[str]]:
    """All features of every node."""
    return [look_of_node(a) + (look_of_text(b) if b else []) for a, b in keys_of(page, blind)]


def silver(page: Page) -> list[int] | None:
    """Labels of all nodes by where they stand to the heading; None for a page without one.

    Inside the heading's box, text under plain body tags is content and anything in a box
    of its own is not; an inner node is content if at least half of its text is.
    """
    head = heading(page)
    if head < 0:
        return None
    box = page.parent[head]
    if page.tag[box] in ("header", "hgroup"):
        box = page.parent[box]
    n = len(page.tag)
    state = [0] * n
    good, total = [0] * n, [0] * n
    for i in range(n):
        p = page.parent[i]
        if i == box:
            state[i] = 1
        elif p >= 0 and state[p]:
            tag = page.tag[i]
            nested_cell = tag == "td" and page.tag[p] == "td"
            named = any(x.startswith(("class=", "role=")) for x in page.names[i]) and tag not in ("ul", "ol", "table", "pre")
            wrapper = tag == "p" and page.tag[p] == "p"
            state[i] = int(tag in BODY_CHAIN and not nested_cell and not named and not wrapper)
    for i in range(n):
        k = len(page.text[i].strip())
        total[i] += k
        good[i] += k * state[i]
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
        good[page.parent[i]] += good[i]
    return [state[i] if page.text[i].strip() else int(total[i] > 0 and 2 * good[i] >= total[i]) for i in range(n)]


@dataclass(frozen=True)
class Model:
    """weights of the nodes' looks; edge[k, a, b]: log potential of child state b under parent state a for tag group k."""

    weights: np.ndarray
    edge: np.ndarray


_GROUP = {"p": 1, "li": 2, "ul": 3, "ol": 3, "h1": 4, "h2": 4, "h3": 4, "td": 5, "tr": 5, "table": 5, "div": 6, "section": 6, "aside": 7, "nav": 7, "footer": 7, "header": 7, "pre": 8}
GROUPS = 9


def training_rows(pages: DataFrame, files: int = TRAIN_FILES) -> DataFrame:
    """The rows a sample is drawn from: those of at most so many files, chosen by a hash of their names, so that the others are not read.

    A frame that is no plain scan of files, or of fewer, is taken whole.
    """
    names = sorted({f.rpartition("/")[2] for f in pages.inputFiles()})
    if len(names) <= files:
        return pages
    order = sorted(names, key=lambda n: xxhash.xxh3_64_intdigest(n, 11))
    try:
        return pages.where(F.col("_metadata.file_name").isin(*order[:files]))
    except AnalysisException:
        return pages


def train(pages: DataFrame, limit: int = TRAIN_PAGES, nodes: int = TRAIN_NODES) -> Model:
    """Fit both potentials on at most limit pages, chosen by a hash of their ids, and at most so many nodes of each, drawn from the whole page.

    The sample serves training only; every page is judged by the model. Without any page
    that has a heading the model leaves every node undecided, which counts as content.
    """
    rows = training_rows(pages.where("result_id is not null"))
    n = rows.select("result_id").count()  # of the ids alone
    share = min(1.0, 1.3 * limit / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("result_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))).select("html").where("html is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = _Place()
        for b in batches:
            for h in b["html"]:
                page = parse(h)
                labels = silver(page)
                if labels is None:
                    continue
                # every third page is shown without its heading, so that pages lacking one can be judged
                keys = keys_of(page, blind=len(h) % 3 == 0)
                k = len(keys)
                pick = range(k) if k <= nodes else sorted(np.random.default_rng(k).choice(k, nodes, replace=False).tolist())
                looks = [[place[f] for f in look_of_node(keys[i][0]) + (look_of_text(keys[i][1]) if keys[i][1] else [])] for i in pick]
                yield pd.DataFrame({
                    "looks": [[v for x in looks for v in x]], "ends": [np.cumsum([len(x) for x in looks]).tolist()], "label": [[labels[i] for i in pick]],
                    "up": [[labels[page.parent[i]] if page.parent[i] >= 0 else -1 for i in pick]], "grp": [[_GROUP.get(page.tag[i], 0) for i in pick]],
                })

    got = spread(picked).mapInPandas(run, "looks array<int>, ends array<int>, label array<int>, up array<int>, grp array<int>").limit(limit).collect()
    w = np.zeros(DIMS)
    pair = np.ones((GROUPS, 2, 2))
    if not got:
        return Model(w, np.zeros((GROUPS, 2, 2)))
    flat = np.concatenate([np.asarray(r.looks, np.int64) for r in got])
    lens = np.concatenate([np.diff([0, *r.ends]) for r in got])
    y = np.concatenate([np.asarray(r.label, float) for r in got])
    start = np.concatenate([[0], np.cumsum(lens)])
    for r in got:
        lab, up, grp = np.asarray(r.label), np.asarray(r.up), np.asarray(r.grp)
        has = up >= 0
        np.add.at(pair, (grp[has], up[has], lab[has]), 1)
    scale = np.full(DIMS, 1e-6)
    order = np.random.default_rng(5).permutation(len(y))
    for _ in range(EPOCHS):  # adaptive gradient steps of a logistic regression
        for part in np.array_split(order, max(1, len(order) // 512)):
            idx = np.concatenate([np.arange(start[i], start[i + 1]) for i in part])
            own = np.repeat(np.arange(len(part)), lens[part])
            z = np.bincount(own, weights=w[flat[idx]], minlength=len(part))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            grad = np.bincount(flat[idx], weights=err[own], minlength=DIMS) / len(part)
            hit = np.flatnonzero(grad)
            g = grad[hit] + 1e-5 * w[hit]
            scale[hit] += g * g
            w[hit] -= 0.15 * g / np.sqrt(scale[hit])
    cond = pair / pair.sum(axis=2, keepdims=True)
    prior = pair.sum(axis=1, keepdims=True) / pair.sum(axis=(1, 2), keepdims=True)
    return Model(w, np.log(cond) - np.log(prior))


def marginals(parent: np.ndarray, depth: np.ndarray, group: np.ndarray, unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """P(content) of every node of a forest by sum-product, level by level; unary: log odds of content."""
    n = len(parent)
    if not n:
        return np.zeros(0)
    own = np.zeros((n, 2))
    own[:, 1] = unary
    up = np.zeros((n, 2))  # message of a node to its parent
    belief = own.copy()
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    for at in reversed(levels[1:]):
        s = edge[group[at]] + belief[at][:, None, :]
        up[at] = np.logaddexp(s[:, :, 0], s[:, :, 1])
        up[at] -= up[at].max(axis=1, keepdims=True)
        np.add.at(belief, parent[at], up[at])
    for at in levels[1:]:
        rest = belief[parent[at]] - up[at]
        s = edge[group[at]] + rest[:, :, None]
        down = np.logaddexp(s[:, 0, :], s[:, 1, :])
        belief[at] += down - down.max(axis=1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def _line_states(text: str, page: Page | None, prob: np.ndarray, texts: _Sum) -> list[bool]:
    """For each line of text whether it is content; blank lines count as content."""
    where: dict[str, list[int]] = {}
    if page is not None:
        for i, t in enumerate(page.text):
            if t:
                for part in t.split("\n") if "\n" in t else (t,):
                    k = _even(part)
                    if k:
                        where.setdefault(k, []).append(i)
                if "\n" in t:
                    where.setdefault(_even(t), []).append(i)
    out, last = [], -1
    for line in text.split("\n"):
        k = _even(line)
        if not k:
            out.append(True)
            continue
        nodes = where.get(k)
        if nodes:
            # the lines come in the order of the page: the next place at or after the last one
            i = next((x for x in nodes if x > last), None)
            i = next((x for x in nodes if x >= last), nodes[0]) if i is None else i
            last = max(last, i)
            out.append(bool(prob[i] >= 0.5))
            continue
        inner = [(len(t), i) for t, at in where.items() if t in k for i in at[:1]]
        if inner:
            mass = sum(n * (1 if prob[i] >= 0.5 else -1) for n, i in inner)
            out.append(mass >= 0)
        else:
            out.append(texts[k, False, False, False, False] >= 0)
    return out


def line_labels(pages: DataFrame, model: Model) -> DataFrame:
    """(result_id, text, content ARRAY<BOOLEAN>): the state of each line of text.

    NULL text gives NULL; text without html is judged by its own look alone.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded: DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, m = _Place(), shared.value
        nodes, looks = _Sum(look_of_node, place, m.weights), _Sum(look_of_text, place, m.weights)
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                htmls, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
                trees = [parse(h) if h and t else None for h, t in zip(htmls, texts, strict=True)]
                parent, depth, group, unary, first = [], [], [], [], []
                for p in trees:
                    first.append(len(parent))
                    if p is None:
                        continue
                    base = len(parent)
                    parent += [x + base if x >= 0 else -1 for x in p.parent]
                    depth += p.depth
                    group += [_GROUP.get(t, 0) for t in p.tag]
                    unary += [nodes[a] + (looks[b] if b else 0.0) for a, b in keys_of(p)]
                prob = marginals(np.asarray(parent, np.int64), np.asarray(depth, np.int64), np.asarray(group, np.int64), np.asarray(unary, float), m.edge)
                states = [None if t is None else _line_states(t, p, prob[f : f + len(p.tag)] if p else prob[:0], looks) for t, p, f in zip(texts, trees, first, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(states, pa.list_(pa.bool_()))], names=["result_id", "text", "content"])

    return spread(pages.where("result_id is not null").select("result_id", "html", "text")).mapInArrow(run, "result_id bigint, text string, content array<boolean>")


def surroundings(pages: DataFrame, limit: int = TRAIN_PAGES) -> DataFrame:
    """(result_id, line_no): non-blank lines of text that are not the page's own body, counted from 1."""
    states = line_labels(pages, train(pages, limit))
    off = F.filter(F.transform("content", lambda c, i: F.when(~c, (i + 1).cast("bigint"))), lambda x: x.isNotNull())
    return states.select("result_id", F.explode(off).alias("line_no")).dropDuplicates(["result_id", "line_no"])


def main_text(pages: DataFrame, limit: int = TRAIN_PAGES) -> DataFrame:
    """(result_id, body): the lines of text that are the page's own body; NULL text gives NULL."""
    states = line_labels(pages, train(pages, limit))
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.filter(F.arrays_zip(lines.alias("line"), F.col("content").alias("on")), lambda x: x["on"]), lambda x: x["line"])
    return states.select("result_id", F.array_join(kept, "\n").alias("body"))
