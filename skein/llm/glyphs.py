"""Problem 5: visually identical text with different characters.

Method: the texts of an Arrow batch become one numpy array of code points; table gathers
give every code point its replacement (none, one or several code points), expansion
offsets place them, combining marks are ordered and composed pairwise on whole arrays, and
blank runs are evened out. No string function is called per row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import spread

# Letters of other scripts that look like Latin letters.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "к": "k", "ո": "n", "ɡ": "g", "ɑ": "a", "ı": "i",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "γ": "y",
    # Armenian
    "Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "հ": "h", "ս": "u", "ց": "g", "զ": "q",
}
#: Compatibility forms that look the same as their expansion; others (fractions, circled digits) do not.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
LIGATURES = range(0xFB00, 0xFB18)
HANGUL = range(0xAC00, 0xD7A4)
BLANK = 0x20


def _written(cp: int, case: bool, small: bool = False) -> str:
    """What one code point becomes: its common form, decomposed.

    small: letters go to lower case before look-alikes are taken, so that a letter and its
    capital end alike; otherwise a capital is taken for what it looks like as a capital.
    """
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f\x85":
        return " "
    if cat in ("Cf", "Cs") or 0xFE00 <= cp <= 0xFE0F or ch in "͏ᅟᅠㅤﾠ឴឵":
        return ""
    if unicodedata.decomposition(ch).startswith(SAME_LOOK) or cp in LIGATURES:
        ch = unicodedata.normalize("NFKC", ch)
    out = ch if cp in HANGUL else unicodedata.normalize("NFD", ch)
    if small and cp not in HANGUL:
        out = unicodedata.normalize("NFD", out.lower()).replace("ς", "σ")
    out = "".join(LOOKALIKES.get(c, c) for c in out)
    if case:
        out = unicodedata.normalize("NFD", out.lower()) if cp not in HANGUL else out
        out = "".join(LOOKALIKES.get(c, c) for c in out)
    return out


@lru_cache(maxsize=3)
def tables(case: bool, small: bool = False) -> tuple[np.ndarray, ...]:
    """(count, start, flat, ccc, pair keys, pair results) over all code points; built by rule."""
    n = sys.maxunicode + 1
    count, start, ccc = np.ones(n, np.int64), np.arange(n, dtype=np.int64), np.zeros(n, np.uint8)
    flat, extra, pairs = [np.arange(n, dtype=np.uint32)], n, {}
    for cp in range(n):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xE0200:
            continue  # ideographs, syllables, surrogates and private use stand for themselves
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[(a << 21) | b] = cp
        w = _written(cp, case, small)
        if w != ch:
            count[cp], start[cp] = len(w), extra
            flat.append(np.array([ord(c) for c in w], np.uint32))
            extra += len(w)
    keys = np.array(sorted(pairs), np.int64)
    return count, start, np.concatenate(flat), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _order_marks(cp: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Canonical order of neighbouring combining marks, by swaps on the whole array."""
    while len(cp) > 1:
        c = ccc[cp]
        swap = (c[:-1] > c[1:]) & (c[1:] > 0) & (row[:-1] == row[1:])
        at = np.flatnonzero(swap)
        if not len(at):
            break
        at = at[np.concatenate([[True], np.diff(at) > 1])]
        cp[at], cp[at + 1] = cp[at + 1].copy(), cp[at].copy()
    return cp


def _compose(cp: np.ndarray, row: np.ndarray, ccc: np.ndarray, keys: np.ndarray, res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join base and following mark where a composed character exists, until none does."""
    while len(cp) > 1:
        c = ccc[cp]
        mark = np.flatnonzero((c[1:] > 0) & (row[:-1] == row[1:])) + 1
        if not len(mark):
            break
        starter = np.flatnonzero(c == 0)
        base_of = np.searchsorted(starter, mark) - 1
        base = starter[np.maximum(base_of, 0)]
        blocked = (mark - base > 1) & (c[mark - 1] >= c[mark])
        key = (cp[base].astype(np.int64) << 21) | cp[mark]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = (base_of >= 0) & (row[base] == row[mark]) & ~blocked & (keys[at] == key)
        first = np.concatenate([[True], base[1:] != base[:-1]])
        # one mark per base and round: the first that fits
        order = np.flatnonzero(hit)
        order = order[np.concatenate([[True], base[order][1:] != base[order][:-1]])] if len(order) else order
        del first
        if not len(order):
            break
        cp[base[order]] = res[at[order]]
        keep = np.ones(len(cp), bool)
        keep[mark[order]] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def one_form(texts: pa.Array, case: bool = True, small: bool = False) -> pa.Array:
    """The common form of every text of an Arrow string array; NULL stays NULL.

    case: letters in lower case too; small: before look-alikes are taken, not after. Blank runs of any kind become one blank, outer blanks go.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    count, start, flat, ccc, keys, res = tables(case, small)
    lens = pc.utf8_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = data.to_pybytes()[offs[0] : offs[-1]] if data is not None and len(filled) else b""
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(lens)), lens)
    n = count[cp]
    ramp = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = flat[np.repeat(start[cp], n) + ramp].astype(np.uint32)
    row = np.repeat(row, n)
    out, row = _compose(_order_marks(out, row, ccc), row, ccc, keys, res)
    if len(out):
        blank = out == BLANK
        edge = np.concatenate([[True], row[1:] != row[:-1]])
        keep = ~(blank & (edge | np.concatenate([[True], blank[:-1]])))
        out, row = out[keep], row[keep]
    if len(out):
        last = np.concatenate([row[1:] != row[:-1], [True]])
        keep = ~((out == BLANK) & last)
        out, row = out[keep], row[keep]
    width = 1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000)
    ends = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.bincount(row, weights=width, minlength=len(lens)).astype(np.int64) if len(lens) else [], out=ends[1:])
    buf = out.tobytes().decode("utf-32-le").encode("utf-8")
    got = pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(ends), pa.py_buffer(buf))
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.large_string()), got).cast(pa.string())


def normalized(df: DataFrame, key: str, text: str, case: bool = False) -> DataFrame:
    """(key, form): every text in its common form; NULL and empty texts stay as they are."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), one_form(b.column(1), case)], names=[key, "form"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, form string")


def _even(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[ \t\n]+", " "))


def found_only_by_form(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """(citation_id): quotes that stand in their page only once writings that look the same are one.

    Quotes that are NULL, blank or empty in their common form are no cases, nor are
    citations without a page; a citation delivered twice comes out once. Look-alikes are
    taken before letter case (Cyrillic В in a Latin word) and, where that finds nothing, after
    it (В beside в in a Russian quote, Ν beside ν in a Greek one).
    """
    quotes = citations.where("citation_id is not null").select("citation_id", "result_id", F.regexp_replace("quote", "^[ \t\n]+|[ \t\n]+$", "").alias("quote")).where("quote != ''")
    pairs = quotes.join(pages.select("result_id", "text").where("text is not null"), "result_id").where(~F.contains(_even(F.col("text")), _even(F.col("quote"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, t = one_form(b.column(1)).to_pylist(), one_form(b.column(2)).to_pylist()
            hit = [bool(x) and x in y for x, y in zip(q, t, strict=True)]
            left = [i for i, found in enumerate(hit) if not found]
            if left:
                q, t = (one_form(b.column(k).take(pa.array(left)), small=True).to_pylist() for k in (1, 2))
                for i, x, y in zip(left, q, t, strict=True):
                    hit[i] = bool(x) and x in y
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit, pa.bool_()))], names=["citation_id"])

    return pairs.select("citation_id", "quote", "text").mapInArrow(run, "citation_id bigint").distinct()
