"""Problem 7: encoding a corpus with a public byte-level BPE tokenizer.

Method: forced-boundary splitting. A pair of adjacent bytes that occurs inside no
vocabulary entry can never be merged, so a text may be cut there; where the cut is also
a boundary of the pre-tokenizer the fragments are encoded independently and their ids
concatenated. Fragments repeat heavily in any corpus, so each worker keeps a bounded
table from fragment to ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import spread, tokenizer_path

#: Fixed value: the published pre-tokenizer pattern of the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker keeps per table; the table is emptied when it is full.
CACHE_ENTRIES = 200_000
#: Fragments longer than this are cut again between letters.
LONG = 48
#: Fragments longer than this are encoded but not kept.
KEEP = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def joined_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 booleans: the byte pairs that occur inside some vocabulary entry."""
    seen = np.zeros((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            seen[b[:-1], b[1:]] = True
    return seen


def _whole_end(b: bytes) -> bool:
    """Whether b ends with a complete UTF-8 character."""
    for n in range(1, 5):
        try:
            b[-n:].decode("utf-8")
            return True
        except UnicodeDecodeError:
            continue
    return False


class _Table(dict):
    """Fragment to ids, filled on demand, bounded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, fragment: str) -> tuple[int, ...]:
        ids = self.encode(fragment)
        if len(fragment) <= KEEP:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[fragment] = ids
        return ids


class ForcedBoundaryEncoder:
    """Encoder whose ids equal those of the whole text encoded at once.

    Cuts lie before a blank that follows a non-blank character (the pre-tokenizer always
    ends a piece there) if no vocabulary entry joins the two bytes, and, within long
    fragments, between two letters whose adjoining bytes no entry joins.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks = load_ranks(path)
        self.joined = joined_pairs(ranks)
        self.raw = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        ends = [token[:i] for token in ranks for i in range(1, len(token)) if token[i] == 0x20]
        chars = {x.decode("utf-8", "ignore")[-1:] if _whole_end(x) else "" for x in ends}
        #: some entry joins part of a character to a blank: no cut before a blank is certain then
        self.no_blank_cuts = "" in chars
        held = "".join(re.escape(c) for c in sorted(chars) if c and not c.isspace())
        self.no_cut = re.compile(rf"[\s{held}] ")
        self.cut = re.compile(rf"(?<=[^\s{held}])(?= )")
        self.after_blank = _Table(lambda p: self._encode(" " + p))
        self.whole = _Table(self._encode)

    def _encode(self, fragment: str) -> tuple[int, ...]:
        if len(fragment) <= LONG:
            return tuple(self.raw(fragment))
        return tuple(chain.from_iterable(map(self.raw, self._between_letters(fragment))))

    def _between_letters(self, s: str) -> list[str]:
        out, start = [], 0
        for i in range(1, len(s)):
            a, b = s[i - 1], s[i]
            if a.isalpha() and b.isalpha() and "'" not in s[max(start, i - 3) : i] and not self.joined[a.encode("utf-8", "replace")[-1], b.encode("utf-8", "replace")[0]]:
                out.append(s[start:i])
                start = i
        out.append(s[start:])
        return out

    def fragments(self, text: str) -> list[str]:
        """The independent pieces of a text; joined they give the text again."""
        if self.no_blank_cuts:
            return [text]
        return self.cut.split(text)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.no_blank_cuts or self.no_cut.search(text):
            return list(chain.from_iterable(map(self.whole.__getitem__, self.fragments(text))))
        first, *rest = text.split(" ")
        head = self.whole[first] if first else ()
        return [*head, *chain.from_iterable(map(self.after_blank.__getitem__, rest))]


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>) for every row of df, without special tokens.

    Empty and NULL texts give an empty list. Rows are mapped one by one: repeated rows
    come out repeated, an empty table gives an empty table, other columns are not read.
    """
    path = tokenizer_path(f"{tokenizer}.tiktoken", folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, carry: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The carried columns and n_tokens BIGINT of every row; 0 for empty and NULL texts."""
    path = tokenizer_path(f"{tokenizer}.tiktoken", folder)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [len(enc.encode(t)) if t else 0 for t in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(n, pa.int64())], names=[*carry, "n_tokens"])

    return spread(df.select(*carry, text)).mapInArrow(run, schema)
