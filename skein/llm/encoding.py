"""Problem 2: text garbled by a wrong character encoding.

Method: words of the corpus that are the same once runs of non-ASCII characters are taken out
are near-twins; of each such group the most frequent word that nothing could undo is the clean
one. Aligning a word with its clean twin character by character shows what was done to it: the
UTF-8 bytes of a character came out as so many characters. Known encodings name most such
transformations and fill in characters that no twin shows; what none of them explains is put
together to byte tables of its own, by which entries agree. Transformations with enough
evidence are applied to every record, with or without a twin.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, spread

# Single-byte encodings as which UTF-8 is commonly misread.
CODECS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "koi8-r", "cp866", "iso8859-2", "iso8859-15")
#: Distinct twin skeletons that must support a transformation before it is applied.
MIN_TWINS = 3
#: Letters a skeleton must keep to name a word.
MIN_SKELETON = 3
# Single-byte encodings of Cyrillic text, and those as which their bytes are read.
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")
READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437")
LATIN_READ = ("cp1252", "latin-1", "mac_roman", "cp437")
HIGH_WORD = re.compile(r"[^\W\d_\x00-\x7f]{4,}")
#: A line counts as misread among Cyrillic encodings if its letter pairs get likelier by this much (natural log, mean).
GAIN = 1.2
#: A text with so many restored characters is misread throughout.
CERTAIN = 4
LOST = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
ACCENTED = re.compile(r"[\u00c0-\u00ff]{4,}")
HIGH_RUN = re.compile(r"(?<![A-Za-z])[^\x00-\x7f]+(?![A-Za-z])")
WORD = re.compile(r"\S*[^\x00-\x7f]\S*")
QUOTED = re.compile(r'(["“„«‹‘`\'])([^\x00-\x7f]{1,8})(["”“»›’`\'])')
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Code points a repair may yield: letters, punctuation and signs of the languages scraped.
PLAUSIBLE = ((0xA1, 0x17F), (0x192, 0x192), (0x2C6, 0x2C6), (0x2DC, 0x2DC), (0x218, 0x21B), (0x300, 0x333), (0x370, 0x3FF), (0x400, 0x45F), (0x1E00, 0x1EFF), (0x2000, 0x2044), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF), (0x2500, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF))
#: Western encodings in which a lead byte is a rare letter: text misread twice passes through control characters.
WESTERN = ("cp1252", "latin-1", "iso8859-15")
#: In these scripts one decoded letter alone proves nothing; two in a row do.
NEED_TWO = ((0x370, 0x45F), (0x2500, 0x27BF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


#: A byte table needs so many characters of clean text.
MIN_ENTRIES = 3
#: What parts a word's ASCII pieces in its skeleton; no word holds it.
GAP = "\t"
#: An encoding's name, or a learned table as (character, byte) pairs.
Codec = str | tuple[tuple[str, int], ...]


@lru_cache(maxsize=32)
def _byte_of(codec: Codec) -> dict[str, int]:
    """Character to byte; bytes a named codec leaves undefined stand for themselves."""
    if not isinstance(codec, str):
        return dict(codec)
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    if codec != "latin-1":
        for b in range(128, 160):  # control characters left where the codec was only partly applied
            out.setdefault(chr(b), b)
    return out


def _in(cp: int, ranges: tuple) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@lru_cache(maxsize=100_000)
def undo(run: str, codec: Codec, before: str = "", lone: bool = False) -> tuple[str, int]:
    """(run with every misread sequence decoded, number of characters restored).

    lone: letters that prove nothing alone are decoded alone too, as the text is known to be misread.
    """
    table = _byte_of(codec)
    out, n, buf = [], 0, []

    def flush() -> None:
        nonlocal n
        raw, at = bytes(table[c] for c in buf), 0
        hits = [(m.start(), m.end(), m.group().decode("utf-8", "replace")) for m in SEQUENCE.finditer(raw)]
        west = codec in WESTERN
        hits = [h for h in hits if len(h[2]) == 1 and (_in(ord(h[2]), PLAUSIBLE) or (west and 0x80 <= ord(h[2]) <= 0xA0))]
        bare = [not lone and not west and _in(ord(h[2]), NEED_TWO) and not any(g is not h and (g[0] == h[1] or g[1] == h[0]) for g in hits) for h in hits]
        for (s, e, ch), skip in zip(hits, bare, strict=True):
            if skip or (isinstance(codec, str) and codec.startswith(("cp125", "latin", "iso")) and e - s == 2 and before.isupper() and s == 0 and not ch.isupper() and "".join(buf)[1] in "”’»“›"):
                continue
            out.append("".join(buf[at:s]))
            out.append(ch)
            at, n = e, n + 1
        out.append("".join(buf[at:]))
        buf.clear()

    for c in run:
        if c in table:
            buf.append(c)
        else:
            flush()
            out.append(c)
    flush()
    return "".join(out), n


def repair(text: str, codecs: tuple[Codec, ...]) -> tuple[str, int]:
    """(text with learned transformations undone, characters restored); repeats for text misread several times, as every step shortens it."""
    total = 0
    while True:
        spare = {m.start(2) for m in QUOTED.finditer(text)}
        best, most, by = text, 0, codecs[0] if codecs else ""

        def decode(codec: Codec, lone: bool, spare: set[int] = spare, text: str = text) -> tuple[str, int]:
            n = 0

            def fix(m: re.Match) -> str:
                nonlocal n
                if m.start() in spare:
                    return m.group()
                got, k = undo(m.group(), codec, m.string[m.start() - 1 : m.start()], lone)
                n += k
                return got

            return RUN.sub(fix, text), n

        for codec in codecs:
            got, n = decode(codec, False)
            if n > most:
                best, most, by = got, n, codec
        if most >= CERTAIN and by not in WESTERN:
            best, most = decode(by, True)
        if not most:
            break
        text, total = best, total + most
    return text, total


def lost(text: str) -> bool:
    """Whether characters were replaced beyond repair, outside a quoted example."""
    return LOST in text and LOST in QUOTED.sub("", text)


def _skeleton(word: str) -> str:
    return RUN.sub(GAP, word)


def aligned(clean: str, garbled: str) -> list[tuple[str, str]] | None:
    """Aligned non-ASCII runs of two words whose ASCII characters agree; None if they don't align."""
    a, b = RUN.split(clean), RUN.split(garbled)
    if a != b:
        return None
    return [(x, y) for x, y in zip(RUN.findall(clean), RUN.findall(garbled), strict=True) if x != y]


def cause(clean: str, garbled: str) -> str | None:
    """The encodings through which the clean run became the garbled one, as 'a' or 'a+b'."""
    for first in CODECS:
        once = undo(garbled, first)[0]
        if once == clean:
            return first
        if once != garbled:
            for second in CODECS:
                if undo(once, second)[0] == clean:
                    return f"{second}+{first}"
    return None


def words(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(skeleton, word, n): words with non-ASCII characters, counted over all fields; the skeleton keeps their ASCII pieces in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[str] = Counter()
            for col in b.columns:
                for t in col.to_pylist():
                    if t and not t.isascii():
                        seen.update(WORD.findall(t))
            keys = [_skeleton(w) for w in seen]
            keep = [i for i, (k, w) in enumerate(zip(keys, seen, strict=True)) if sum(map(str.isalpha, k)) >= MIN_SKELETON or HIGH_WORD.search(w)]
            ws, ns = list(seen), list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.string()), pa.array([ws[i] for i in keep], pa.string()), pa.array([ns[i] for i in keep], pa.int64())], names=["skeleton", "word", "n"])

    return spread(records.select(*fields)).mapInArrow(run, "skeleton string, word string, n bigint").groupBy("skeleton", "word").agg(F.sum("n").alias("n"))


def characters(clean: str, garbled: str) -> list[tuple[str, str]] | None:
    """The characters of a clean run with what each became, if their UTF-8 bytes came out as one character each.

    None where a character stands on beside others, or where invisible characters, blanks or
    combining marks are among what came out: such writings are other ways to the same look.
    """
    if any(unicodedata.category(c) in ("Cf", "Mn", "Zs", "Cc") for c in garbled):
        return None
    sizes = [len(c.encode()) for c in clean]
    if sum(sizes) != len(garbled):
        return None
    out, at = [], 0
    for c, k in zip(clean, sizes, strict=True):
        out.append((c, garbled[at : at + k]))
        at += k
    return None if any(c in part for c, part in out) else out


def learn(counted: DataFrame) -> DataFrame:
    """(codec, garbled, clean, twins, n): aligned runs that an encoding explains, and single characters (codec '?') of runs that none does.

    counted: see words(). The clean twin of a word is the most frequent word of its skeleton
    that no known encoding could undo something in, so a skeleton with any number of
    spellings costs one pair a spelling.
    """

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("suspect", pa.array([any(undo(r, c)[1] for r in RUN.findall(w) for c in CODECS) for w in b.column(1).to_pylist()], pa.bool_()))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for skel, good, bad, n, suspect in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for x, y in aligned(good, bad) or []:
                    if suspect and (w := cause(x, y)):
                        rows.append((w, y, x, skel, n))
                    elif pieces := characters(x, y):
                        rows += [("?", part, c, skel, n) for c, part in pieces]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 4 + (pa.int64(),), strict=True)], names=["codec", "garbled", "clean", "skeleton", "n"])

    counted = counted.where(F.length(F.regexp_replace("skeleton", r"[^\p{L}]+", "")) >= MIN_SKELETON)
    seen = materialize(counted.mapInArrow(suspects, "skeleton string, word string, n bigint, suspect boolean"), "encoding-suspects")
    good = seen.where("not suspect").groupBy("skeleton").agg(F.max(F.struct("n", "word")).alias("g")).select("skeleton", F.col("g.word").alias("good"), F.col("g.n").alias("good_n"))
    pairs = seen.join(good, "skeleton").where((F.col("word") != F.col("good")) & (F.col("suspect") | (F.col("n") < F.col("good_n")))).select("skeleton", "good", F.col("word").alias("bad"), "n", "suspect")
    return pairs.mapInArrow(explain, "codec string, garbled string, clean string, skeleton string, n bigint").groupBy("codec", "garbled", "clean").agg(F.count_distinct("skeleton").alias("twins"), F.sum("n").alias("n"))


def learned_tables(mappings: DataFrame, min_twins: int = MIN_TWINS, min_entries: int = MIN_ENTRIES) -> tuple[Codec, ...]:
    """Byte tables put together from characters that no known encoding explains.

    A character and what it became give one (character read, byte) pair per UTF-8 byte. An
    entry joins the first table that shares a pair with it and contradicts none; tables of
    fewer than min_entries clean characters are dropped. What is collected are entries with
    min_twins twins, then entries of fewer that begin as one of a table does: at most one
    per letter of the scripts and table, whatever the corpus.
    """
    found = mappings.where("codec = '?'").select("garbled", "clean", "twins")
    tables: list[tuple[dict[int, str], set[str]]] = []

    def enter(rows: list, open_: bool) -> None:
        for r in sorted(rows, key=lambda r: (-r.twins, r.clean, r.garbled)):
            pairs = list(zip(r.clean.encode(), r.garbled, strict=True))
            if len({c for _, c in pairs}) < len({b for b, _ in pairs}):
                continue
            for table, clean in tables:
                back = {c: b for b, c in table.items()}
                if any(table.get(b) == c for b, c in pairs) and all(table.get(b, c) == c and back.get(c, b) == b for b, c in pairs):
                    table.update(pairs)
                    clean.add(r.clean)
                    break
            else:
                if open_:
                    tables.append((dict(pairs), {r.clean}))

    enter(found.where(F.col("twins") >= min_twins).collect(), True)
    tables = [t for t in tables if len(t[1]) >= min_entries]
    leads = {c for table, _ in tables for b, c in table.items() if b >= 0xC2}
    if leads:
        enter(found.where((F.col("twins") < min_twins) & F.substring("garbled", 1, 1).isin(*leads)).collect(), False)
    return tuple(tuple(sorted((c, b) for b, c in table.items())) for table, _ in tables)


def learned_codecs(mappings: DataFrame, min_twins: int = MIN_TWINS) -> tuple[str, ...]:
    """The encodings with enough twins; at most len(CODECS) values, whatever the corpus."""
    steps = mappings.where("codec != '?'").select(F.explode(F.split("codec", r"\+")).alias("codec"), "twins").groupBy("codec").agg(F.sum("twins").alias("twins"))
    found = {r.codec for r in steps.where(F.col("twins") >= min_twins).collect()}
    return tuple(c for c in CODECS if c in found)


@lru_cache(maxsize=64)
def _swap(a: str, b: str) -> dict[int, str]:
    """Translation of text whose bytes are of encoding a but were read as b; ASCII stays."""
    out = {}
    for ch, byte in _byte_of(b).items():
        try:
            out[ord(ch)] = bytes([byte]).decode(a)
        except UnicodeDecodeError:
            continue
    return out


def _cyrillic(s: str) -> int:
    return sum("\u0400" <= c <= "\u045f" for c in s)


def learn_swaps(counted: DataFrame, min_twins: int = MIN_TWINS) -> tuple[tuple[str, str], ...]:
    """Pairs (encoding, read as) of single-byte misreadings with enough twins; at most len(CYRILLIC) * len(READ_AS).

    Words without ASCII letters have no skeleton to meet by, so a suspect word meets the
    clean word that it would be; the clean one must be clearly more frequent.
    """

    def guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for a in CYRILLIC:
                    for r in READ_AS:
                        if a != r:
                            g = w.translate(_swap(a, r))
                            if g != w and _cyrillic(g) >= 4 and all("\u0400" <= c <= "\u045f" for c in g):
                                rows.append((g, w, a, r, n))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 4 + (pa.int64(),), strict=True)], names=["word", "bad", "a", "r", "bad_n"])

    high = counted.where(F.col("skeleton") == GAP).select("word", "n")
    meet = high.mapInArrow(guesses, "word string, bad string, a string, r string, bad_n bigint").join(high, "word").where("n > 3 * bad_n")
    found = meet.groupBy("a", "r").agg(F.count_distinct("bad").alias("twins")).where(F.col("twins") >= min_twins)
    return tuple(sorted((x.a, x.r) for x in found.collect()))


def letter_pairs(counted: DataFrame) -> dict[str, float]:
    """Log frequency of Cyrillic letter pairs in the whole corpus; at most 33 x 33 entries."""
    w = counted.where(F.col("skeleton") == GAP).where(F.col("word").rlike("^[\u0400-\u045f]{2,}$")).select(F.lower("word").alias("w"), "n")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair")
    got = w.select(pair, "n").where(F.col("pair").rlike("^[а-яё]{2}$")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in got) or 1
    return {r.pair: math.log((r.n + 0.2) / total) for r in got}


def _likely(s: str, pairs: dict[str, float]) -> float:
    low = s.lower()
    scores = [pairs.get(low[i : i + 2], -12.0) for i in range(len(low) - 1) if "\u0400" <= low[i] <= "\u045f" and "\u0400" <= low[i + 1] <= "\u045f"]
    return sum(scores) / len(scores) if len(scores) >= 4 else -99.0


def unswap(text: str, swaps: tuple[tuple[str, str], ...], pairs: dict[str, float]) -> tuple[str, int]:
    """(text with lines decoded that single-byte misreadings garbled, letters restored)."""
    out, n = [], 0
    for line in text.split("\n"):
        best, gain = line, 0.0
        if HIGH_WORD.search(line):
            now = _likely(line, pairs)
            for a, r in swaps:
                if r in LATIN_READ:
                    # four accented letters in a row are no Latin word; look-alike letters among them are another matter
                    if not ACCENTED.search(line):
                        continue
                    got = HIGH_RUN.sub(lambda m: m.group() if _cyrillic(m.group()) else m.group().translate(_swap(a, r)), line)  # noqa: B023
                else:
                    got = line.translate(_swap(a, r))
                if got == line or _cyrillic(got) < 4:
                    continue
                score = _likely(got, pairs)
                if score - max(now, -12.0) > max(gain, GAIN):
                    best, gain = got, score - max(now, -12.0)
        if best != line:
            n += sum(x != y for x, y in zip(best, line, strict=False))
        out.append(best)
    return "\n".join(out), n


def restore(text: str, codecs: tuple[Codec, ...], swaps: tuple[tuple[str, str], ...], pairs: dict[str, float]) -> tuple[str, int]:
    """Both kinds of misreading undone, the one that explains more of the text first."""
    fixed, n = repair(text, codecs)
    if swaps and HIGH_WORD.search(text):
        other, m = unswap(text, swaps, pairs)
        if m > 3 * n:
            fixed, n = repair(other, codecs)
            return fixed, n + m
        if n and HIGH_WORD.search(fixed):
            fixed, m = unswap(fixed, swaps, pairs)
            n += m
    return fixed, n


def apply_learned(records: DataFrame, codecs: tuple[Codec, ...], swaps: tuple[tuple[str, str], ...] = (), pairs: dict[str, float] | None = None, key: str = "result_id", fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """(key, field, repaired, restored, lost): the damaged fields and what could be given back.

    Fields that are NULL or empty, and letters quoted as an example, are no cases.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            keys = b.column(0).to_pylist()
            for field, col in zip(fields, b.columns[1:], strict=True):
                for k, t in zip(keys, col.to_pylist(), strict=True):
                    if not t or t.isascii():
                        continue
                    fixed, n = restore(t, codecs, swaps, pairs or {})
                    gone = lost(t)
                    if n or gone:
                        rows.append((k, field, fixed, n, gone))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.bool_())], names=[key, "field", "repaired", "restored", "lost"])

    return spread(records.select(key, *fields)).mapInArrow(run, f"`{key}` {kind}, field string, repaired string, restored int, lost boolean")


def damaged(records: DataFrame, min_twins: int = MIN_TWINS) -> DataFrame:
    """Learn from all records, then find and repair: see apply_learned."""
    counted = materialize(words(records, ("text", "title")), "encoding-words")
    mappings = materialize(learn(counted), "encoding-mappings")
    codecs = learned_codecs(mappings, min_twins) + learned_tables(mappings, min_twins)
    swaps = learn_swaps(counted, min_twins)
    return apply_learned(records, codecs, swaps, letter_pairs(counted) if swaps else None)
