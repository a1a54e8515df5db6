"""HTML to title, text, markdown and links in one pass per page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is taken off a page before its article is looked for.
DROP_TAGS = frozenset(("nav", "footer", "header", "aside"))
DROP_ROLES = frozenset(("banner", "navigation"))
DROP_CLASS_OR_ID = ("cookie", "consent")
DROP_CLASS = ("modal", "popup", "newsletter", "subscribe", "advertisement", "promo")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split())
_SKIP = frozenset(("script", "style", "noscript", "template", "head", "title"))
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("attrs", "block", "kids", "linked", "parent", "size", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.size = self.linked = 0
        self.block = tag in _BLOCK

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in _SKIP:
                todo.extend(reversed(n.kids))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.hrefs: list[str] = []
        self.title: list[str] = []

    def _close(self, tags: tuple[str, ...], bound: frozenset[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in bound:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag in _BLOCK:
            self._close(("p",), frozenset(("td", "th", "button", "table")) if tag not in ("td", "tr") else frozenset())
        if tag == "li":
            self._close(("li",), frozenset(("ul", "ol")))
        elif tag in ("dt", "dd"):
            self._close(("dt", "dd"), frozenset(("dl",)))
        elif tag in ("td", "th"):
            self._close(("td", "th"), frozenset(("tr", "table")))
        elif tag == "tr":
            self._close(("tr",), frozenset(("table",)))
        node = Node(tag, a, self.at)
        self.at.kids.append(node)
        if tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag == "title" and not any(n.tag == "svg" for n in _above(self.at)):
            self.title.append(data)
        self.at.kids.append(data)


def _above(n: Node) -> Iterator[Node]:
    while n.parent is not None:
        n = n.parent
        yield n


def _dropped(n: Node) -> bool:
    if n.tag in DROP_TAGS or n.attrs.get("role") in DROP_ROLES:
        return True
    cls, id_ = n.attrs.get("class", ""), n.attrs.get("id", "")
    return any(w in cls or w in id_ for w in DROP_CLASS_OR_ID) or any(w in cls for w in DROP_CLASS)


def _strip(root: Node) -> None:
    for n in list(root.walk()):
        n.kids = [k for k in n.kids if isinstance(k, str) or not _dropped(k)]


def _measure(root: Node) -> list[Node]:
    """All nodes in document order, each with the length of its text, of the linked part of it, and whether it holds a block."""
    order = list(root.walk())
    for n in reversed(order):
        n.size = n.linked = 0
        n.block = n.tag in _BLOCK
        for k in n.kids:
            if isinstance(k, str):
                n.size += len(k)
                continue
            n.block = n.block or k.block
            if k.tag not in _SKIP:
                n.size += k.size
                n.linked += k.linked
        if n.tag == "a":
            n.linked = n.size
    return order


def _article(order: list[Node]) -> Node | None:
    """The node that holds most running text: paragraphs count for their parent and half for the one above."""
    score: dict[int, tuple[float, Node]] = {}
    for n in order:
        if n.tag not in ("p", "pre", "td", "blockquote") or n.size < 25:
            continue
        t = n.text().strip()
        if len(t) < 25:
            continue
        points = 1 + t.count(",") + min(len(t) // 100, 3)
        for up, part in zip(_above(n), (1.0, 0.5), strict=False):
            if up.tag in ("#root", "html"):
                break
            s, _ = score.get(id(up), (0.0, up))
            score[id(up)] = (s + points * part, up)
    best, top = None, 0.0
    for s, n in score.values():
        s *= 1 - min(1.0, n.linked / (n.size or 1))
        if s > top:
            best, top = n, s
    return best


def _inline(n: Node | str) -> str:
    if isinstance(n, str):
        return _SPACE.sub(" ", n)
    if n.tag in _SKIP:
        return ""
    inner = "".join(map(_inline, n.kids))
    bare = inner.strip()
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs['src']})" if n.attrs.get("src") else ""
    if not bare:
        return inner
    left, right = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if n.tag in ("b", "strong"):
        return f"{left}**{bare}**{right}"
    if n.tag in ("i", "em"):
        return f"{left}_{bare}_{right}"
    if n.tag == "code":
        return f"{left}`{bare}`{right}"
    if n.tag == "a" and n.attrs.get("href"):
        return f"{left}[{bare}]({n.attrs['href']}){right}"
    return inner


def _blocks(n: Node) -> list[str]:
    """Markdown blocks of a node, to be joined by blank lines."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = "".join(run).strip()
        if t:
            out.append(re.sub(r"[ \t]*\n[ \t]*", lambda m: "  \n" if m.group().startswith("  ") else "\n", t))
        run.clear()

    for k in n.kids:
        if isinstance(k, str) or not k.block:
            run.append(_inline(k))
            continue
        flush()
        if k.tag in _SKIP:
            continue
        if re.fullmatch("h[1-6]", k.tag):
            t = " ".join("".join(map(_inline, k.kids)).split())
            if t:
                out.append("#" * int(k.tag[1]) + " " + t)
        elif k.tag in ("ul", "ol"):
            items = [x for x in k.kids if isinstance(x, Node)]
            lines = []
            for i, item in enumerate(items):
                mark = f"{i + 1}.  " if k.tag == "ol" else "*   "
                body = "\n\n".join(_blocks(item)) if item.tag == "li" else "\n\n".join(_blocks(_wrap(item)))
                if body:
                    lines.append(mark + body.replace("\n", "\n    "))
            if lines:
                out.append("\n".join(lines))
        elif k.tag == "pre":
            out.append("```\n" + k.text().strip("\n") + "\n```")
        elif k.tag == "blockquote":
            out.append("\n".join("> " + x for x in "\n\n".join(_blocks(k)).split("\n")))
        elif k.tag == "hr":
            out.append("* * *")
        else:
            out.extend(_blocks(k))
    flush()
    return out


def _wrap(n: Node) -> Node:
    w = Node("div", {}, None)
    w.kids = [n]
    return w  # a block whatever it holds


def page_content(html: str | None) -> dict:
    """title, markdown, text and hrefs of a page; NULL and empty pages give empty strings and no title.

    An empty title is none (NULL) only on a page without an article.
    """
    b = _Builder()
    b.feed(html or "")
    b.close()
    title = _SPACE.sub(" ", "".join(b.title)).strip()
    _strip(b.root)
    order = _measure(b.root)
    best = _article(order)
    if best is None:
        home = next((n for n in order if n.tag in ("main", "article")), None) or next((n for n in order if n.tag == "body"), b.root)
        text = home.text().strip()
        return {"title": title or None, "markdown": text, "text": text, "hrefs": b.hrefs}
    heads = [n for n in order if n.tag == "h1"]
    lead = "" if not heads or any(n is heads[0] for n in best.walk()) else f"# {' '.join(heads[0].text().split())}\n\n"
    return {"title": title, "markdown": (lead + "\n\n".join(_blocks(best))).strip(), "text": best.text().strip(), "hrefs": b.hrefs}


CONTENT = T.StructType([T.StructField("title", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("text", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType()))])


@F.pandas_udf(CONTENT)
def content(html: pd.Series) -> pd.DataFrame:
    """One parse per page; take several fields of the struct without parsing again."""
    return pd.DataFrame([page_content(h) for h in html], columns=["title", "markdown", "text", "hrefs"])


class _Hrefs(HTMLParser):
    """The hrefs of a page's anchors in order, without a tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            if href:
                self.found.append(href)


def page_hrefs(html: str | None) -> list[str]:
    p = _Hrefs()
    p.feed(html or "")
    p.close()
    return p.found


def raw_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def strip_tags_native(html: Column) -> Column:
    """The four boilerplate elements taken out by pattern; for well-formed, unnested pages."""
    for tag in ("nav", "footer", "header", "aside"):
        html = F.regexp_replace(html, rf"(?s)<{tag}\b[^>]*>.*?</{tag}>", "")
    return html


def anchors_native(html: Column) -> Column:
    """Quoted hrefs of all anchors in document order, for well-formed pages."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


_LINK = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("link", T.StringType())]))


@F.pandas_udf(_LINK)
def page_links(base: pd.Series, html: pd.Series) -> pd.Series:
    """(pos, link) of the absolute links of each page: every distinct address once, at its first place."""
    from skein.functions.urls import resolve

    out = []
    for at, h in zip(base, html, strict=True):
        seen: dict[str, int] = {}
        for i, href in enumerate(page_hrefs(h)):
            link = resolve(at, href)
            if link is not None:
                seen.setdefault(link, i)
        out.append([{"pos": i, "link": link} for link, i in seen.items()])
    return pd.Series(out, dtype=object)


def links(pages: DataFrame, url: str = "final_url", html: str = "html", carry: tuple[str, ...] = ("result_id",)) -> DataFrame:
    """(carry..., pos, link): absolute http(s) links of each page in order, first occurrence of each kept.

    Repeats are dropped where the page is read, so nothing is shuffled.
    """
    from skein.sources.stores import spread

    each = spread(pages.select(*dict.fromkeys([*carry, url, html]))).select(*carry, F.explode(page_links(F.col(url), F.col(html))).alias("_l"))
    return each.select(*carry, F.col("_l.pos").alias("pos"), F.col("_l.link").alias("link"))
