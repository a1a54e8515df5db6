"""Problem 9: long exact spans shared between records.

Method: an FM-index per shard (suffix array by prefix doubling, Burrows-Wheeler transform,
wavelet matrix with packed rank counts). Documents are streamed against the index of their
shard by backward search, all positions of a shard in lock step; the depth each reaches
while another occurrence is left is its matching statistic, and intervals above the
threshold are located, extended to the right and reported.

What is sent to a shard follows from sampling that loses nothing: of every window of
SPAN characters the K-gram with the least hash is an anchor, so a shared span of SPAN
characters holds an anchor in both documents. Anchors of one text only are dropped; the
rest name the shard, and only the text around them is indexed. Anchors of a document whose
surroundings are the same (repetitive text has one every few characters) are looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, mix64, narrowed, spread, without

#: Characters (code points) a shared span must have.
SPAN = 200
#: Length of an anchor; windows of SPAN - K + 1 anchors are sampled.
K = 80
#: Shards with more documents are split by anchor, then into blocks of this size that meet pairwise.
BLOCK = 2000
#: Characters indexed together; small shards share an index.
INDEX_CHARS = 400_000
#: Shards of more characters are split by anchor, too; an index takes about 100 bytes a character.
SHARD_CHARS = 2_000_000
SLICE_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_UNIT = 1 << 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, _UNIT)
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def anchors(cp: np.ndarray, lens: np.ndarray, k: int = K, span: int = SPAN, powers: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, hash, context) of the anchors of documents that lie one after another in cp.

    context is a hash of the text up to span - k characters beyond the anchor on either side.
    """
    none = np.zeros(0, np.int64)
    n = len(cp)
    if n < span or not (lens >= span).any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers if powers is not None and len(powers[0]) > n else _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(cp.astype(np.uint64) + np.uint64(77)) * up[:n])])
    gram = mix64((total[k:] - total[:-k]) * down[: n - k + 1])
    width = span - k + 1
    bits = np.uint64(max(1, int(n).bit_length()))
    least = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:  # running minima of doubled reach
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    starts = np.cumsum(lens) - lens
    held = np.flatnonzero(lens >= span)
    count = lens[held] - span + 1
    ramp = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = np.unique(least[np.repeat(starts[held], count) + ramp] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(starts, at, side="right") - 1
    # empty documents share their start with the next one
    wing = span - k
    left, right = np.maximum(at - wing, starts[doc]), np.minimum(at + k + wing, starts[doc] + lens[doc])
    around = mix64((total[right] - total[left]) * down[left] + mix64((at - left).astype(np.uint64) * np.uint64(1 << 20) + (right - at).astype(np.uint64)))
    return doc, at - starts[doc], gram[at], around


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of an Arrow string array and the length of each text."""
    lens = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), lens


def anchored(documents: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(h, doc_id, pos, sig, ctx): the anchors of every text of at least span characters; sig names the text, ctx what stands around the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(SLICE_CHARS + 1)
        for whole in batches:
            chars = np.cumsum(pc.utf8_length(whole.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                base = chars[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(chars, base + SLICE_CHARS, side="right")))
                b = whole.slice(at, end - at)
                at = end
                cp, lens = code_points(b.column(2))
                doc, pos, h, ctx = anchors(cp, lens, k, span, powers)
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pick), pa.array(pos.astype(np.int32)), b.column(1).take(pick), pa.array(ctx.view(np.int64))], names=["h", "doc_id", "pos", "sig", "ctx"])

    rows = documents.where((F.length("text") >= span) & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("sig"), "text")
    return spread(rows).mapInArrow(run, "h bigint, doc_id bigint, pos int, sig bigint, ctx bigint")


class FMIndex:
    """Index of a sequence of symbols for backward search of patterns of up to depth symbols.

    Symbol 0 parts the documents and ends the sequence. Suffixes are sorted by their first
    depth symbols, which is all that patterns of that length can tell apart.
    """

    def __init__(self, seq: np.ndarray, depth: int):
        self.symbols, dense = np.unique(seq, return_inverse=True)
        self.n = len(seq)
        self.sa = _suffix_order(dense.astype(np.int64), len(self.symbols), depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(dense, minlength=len(self.symbols)))])
        bwt = dense[self.sa - 1]
        self.levels = max(1, int(len(self.symbols) - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.frombuffer(np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).tobytes(), np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.base = self._descend(np.arange(len(self.symbols)), np.zeros(len(self.symbols), np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for j, (words, counts, zeros) in enumerate(zip(self.words, self.counts, self.zeros, strict=True)):
            block = i >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            bit = (symbol >> (self.levels - 1 - j)) & 1
            i = np.where(bit == 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with symbol followed by those of [lo, hi)."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) - np.concatenate([self.base[symbol], self.base[symbol]])
        m = len(symbol)
        return self.first[symbol] + both[:m], self.first[symbol] + both[m:]


def _suffix_order(dense: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Positions ordered by the next depth symbols (the end counts as symbol 0), by prefix doubling of unresolved ties."""
    n = len(dense)
    bits = max(1, int(sigma - 1).bit_length())
    reach = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(min(reach, n)):
        key[: n - j] |= dense[j:] << (bits * (reach - 1 - j))
    sa = np.argsort(key, kind="stable")
    run = key[sa]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while reach < depth:
        size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        slot = np.flatnonzero(tied)
        pos = sa[slot]
        after = pos + reach
        key = rank[pos] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        sa[slot] = pos[order]
        run = key[order]
        new[slot] = np.concatenate([[True], run[1:] != run[:-1]])
        heads = np.flatnonzero(new)
        rank[sa[slot]] = heads[np.cumsum(new)[slot] - 1]
        reach *= 2
    return sa


def matching_statistics(index: FMIndex, dense: np.ndarray, ends: np.ndarray, most: int, mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backward search from every end, in lock step.

    Returns for each the greatest depth <= most at which its text has another occurrence,
    and the interval at depth mark (empty where that is not reached).
    """
    m = len(ends)
    lo, hi = np.zeros(m, np.int64), np.full(m, index.n, np.int64)
    depth = np.zeros(m, np.int64)
    mlo, mhi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live = np.arange(m)
    for step in range(1, most + 1):
        at = ends[live] - step
        ok = at >= 0
        ok[ok] = dense[at[ok]] != 0
        live, at = live[ok], at[ok]
        if not len(live):
            break
        a, b = index.extend(dense[at], lo[live], hi[live])
        ok = b - a > 1
        live = live[ok]
        lo[live], hi[live], depth[live] = a[ok], b[ok], step
        if step == mark:
            mlo[live], mhi[live] = a[ok], b[ok]
    return depth, mlo, mhi


def _agree(seq: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, most: int) -> np.ndarray:
    """Symbols that agree from a and b on, going by step (1 or -1), at most most; separators agree with nothing."""
    off = np.arange(most) * step
    ia, ib = a[:, None] + off, b[:, None] + off
    good = (ia >= 0) & (ib >= 0) & (ia < len(seq)) & (ib < len(seq))
    x, y = seq[np.clip(ia, 0, len(seq) - 1)], seq[np.clip(ib, 0, len(seq) - 1)]
    good &= (x == y) & (x != 0)
    return np.where(good.all(axis=1), most, good.argmin(axis=1))


def shard_matches(docs: np.ndarray, blocks: np.ndarray, spread: np.ndarray, offsets: np.ndarray, texts: list[str], places: list[list[int]], k: int = K, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(a, b, start_a, start_b, length, pos_a, pos_b) of the spans shared within one shard of regions, with the anchors they lie around.

    Region i holds text texts[i] from position offsets[i] of document docs[i] on, and anchors
    at places[i] of the document. spread[i]: its shard is a meeting of two blocks, and only
    pairs of different blocks count. Spans are cut SPAN - K characters beyond the anchor on
    either side; neighbouring anchors cover what is cut.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    seq = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le"), np.uint32) + np.uint32(1)  # every character is a symbol above 0
    start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    seq[start + lens] = 0
    count = np.fromiter(map(len, places), np.int64, len(places))
    region = np.repeat(np.arange(len(texts)), count)
    ends = np.fromiter((p for x in places for p in x), np.int64, int(count.sum())) - offsets[region] + start[region] + k
    index = FMIndex(seq, span + 1)
    dense = np.searchsorted(index.symbols, seq)
    depth, lo, hi = matching_statistics(index, dense, ends, span, k)
    wing = span - k
    right = np.minimum(wing, start[region] + lens[region] - ends)
    use = (hi - lo > 1) & (depth + right >= span)
    head = np.unique(np.stack([lo[use], hi[use]]), axis=1) if use.any() else np.zeros((2, 0), np.int64)
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    may = np.zeros(len(seq), bool)
    may[ends[use] - k] = True
    for a, b in head.T.tolist():
        at = index.sa[a:b]
        at = np.sort(at[may[at]])
        own = np.searchsorted(start, at, side="right") - 1
        for i in range(len(at) - 1):  # member against the later ones of its interval
            rest, theirs = at[i + 1 :], own[i + 1 :]
            ok = (docs[theirs] != docs[own[i]]) & (~spread[theirs] | (blocks[theirs] != blocks[own[i]]))
            rest, theirs = rest[ok], theirs[ok]
            if not len(rest):
                continue
            mine = np.full(len(rest), at[i])
            left = _agree(seq, mine - 1, rest - 1, -1, wing)
            good = left + k + wing >= span
            more = _agree(seq, mine + k, rest + k, 1, wing)
            good &= left + k + more >= span
            if not good.any():
                continue
            left, more, theirs, rest = left[good], more[good], theirs[good], rest[good]
            x, y = np.full(len(theirs), docs[own[i]]), docs[theirs]
            px = np.full(len(theirs), offsets[own[i]] + at[i] - start[own[i]])
            py = offsets[theirs] + rest - start[theirs]
            turn = x > y
            pick = lambda v, w, turn=turn: np.where(turn, w, v)
            for col, v in zip(out, (pick(x, y), pick(y, x), pick(px - left, py - left), pick(py - left, px - left), left + k + more, pick(px, py), pick(py, px)), strict=True):
                col.append(v)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


_MATCH = "a bigint, b bigint, start_a bigint, start_b bigint, length bigint, pos_a bigint, pos_b bigint"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; whole shards are indexed together up to INDEX_CHARS."""
    held: list[dict] = []
    last, chars = None, 0

    def flush(group: list[list[dict]]) -> pa.RecordBatch:
        rows = [r for g in group for r in g]
        # blocks of different shards must not hide pairs of shards that are whole
        got = shard_matches(
            np.array([r["doc_id"] for r in rows], np.int64), np.array([r["own"] for r in rows], np.int64), np.array([r["lo"] != r["hi"] for r in rows], bool),
            np.array([r["off"] for r in rows], np.int64), [r["region"] for r in rows], [r["places"] for r in rows],
        )
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], names=["a", "b", "start_a", "start_b", "length", "pos_a", "pos_b"])

    whole: list[list[dict]] = []
    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["shard"], r["lo"], r["hi"])
            if key != last and held:
                if held[0]["lo"] != held[0]["hi"]:
                    yield flush([held])
                else:
                    whole.append(held)
                    size += chars
                    if size >= INDEX_CHARS:
                        yield flush(whole)
                        whole, size = [], 0
                held, chars = [], 0
            last = key
            held.append(r)
            chars += len(r["region"])
    if held:
        if held[0]["lo"] != held[0]["hi"]:
            yield flush([held])
        else:
            whole.append(held)
    if whole:
        yield flush(whole)


def text_classes(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, rep): documents of at least span characters and the least doc_id with the same text."""
    keyed = documents.where((F.length("text") >= span) & F.col("doc_id").isNotNull()).select("doc_id", F.md5("text").alias("same"))
    return keyed.join(keyed.groupBy("same").agg(F.min("doc_id").alias("rep")), "same").select("doc_id", "rep").distinct()


def class_matches(documents: DataFrame, k: int = K, span: int = SPAN, block: int = BLOCK, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches between class representatives, classes, places): see shard_matches and text_classes.

    places: (h, doc_id, ctx, pos, others): one anchor of each surroundings in a document, and
    where else in it the same stands.
    """
    classes = materialize(text_classes(documents, span), "span-classes")
    copies = classes.where("doc_id != rep").select("doc_id")
    grams = materialize(anchored(documents, k, span), "span-anchors")
    shared = materialize(grams.groupBy("h").agg(F.min("sig").alias("s0"), F.max("sig").alias("s1")).where("s0 != s1").select("h"), "span-shared")
    mine = without(narrowed(grams.select("h", "doc_id", "ctx", "pos"), "h", shared).join(shared, "h"), "doc_id", copies)
    places = mine.groupBy("h", "doc_id", "ctx").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_set("pos")).alias("others"))
    places = materialize(places, "span-places")
    # anchors of the same documents get the same shard; which shard is a matter of speed only
    least = places.groupBy("doc_id").agg(F.min("h").alias("own_least"))
    named = places.join(least, "doc_id").groupBy("h").agg(F.min("own_least").alias("name"))
    tagged = materialize(places.select("h", "doc_id", "pos").join(named, "h"), "span-tagged")
    wing = span - k
    cut_from, cut_to = F.greatest(F.min("pos") - wing, F.lit(0)), F.max("pos") + span
    size = tagged.groupBy("name", "doc_id").agg((cut_to - cut_from).cast("bigint").alias("chars")).groupBy("name").agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"))
    wide = size.where((F.col("docs") > block) | (F.col("chars") > shard_chars)).select("name", F.lit(True).alias("wide"))
    keyed = tagged.join(wide, "name", "left").select(F.when(F.col("wide"), F.col("h")).otherwise(F.col("name")).alias("shard"), F.coalesce("wide", F.lit(False)).alias("wide"), "doc_id", "pos")
    # a wide shard takes each place by itself, so that no region is longer than a span and its wings
    rows = keyed.groupBy("shard", "wide", "doc_id", F.when(F.col("wide"), F.col("pos")).alias("one")).agg(F.array_sort(F.collect_set("pos")).alias("places")).drop("one")
    crowd = rows.where("wide").groupBy("shard").agg(F.count(F.lit(1)).alias("members"))
    rows = rows.join(crowd, "shard", "left").withColumn("parts", F.coalesce(F.ceil(F.col("members") / block).cast("int"), F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    off = F.greatest(F.array_min("places") - wing, F.lit(0))
    # of the texts only those with a place are moved
    held = materialize(places.select("doc_id").distinct(), "span-held")
    texts = documents.where(F.length("text") >= span).select("doc_id", "text")
    texts = narrowed(texts, "doc_id", held).join(held, "doc_id", "left_semi")
    cut = rows.join(texts, "doc_id").select(
        "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", off.alias("off"), "places",
        F.substring(F.col("text"), off + 1, F.array_max("places") + span - off).alias("region"),
    )
    found = cut.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", "doc_id").mapInArrow(_search, _MATCH)
    return found, classes, places


def shared_pairs(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id_a, doc_id_b): two documents that share a run of at least span characters, smaller id first.

    NULL, empty and shorter texts are in no pair; equal texts of at least span characters are.
    """
    found, classes, _ = class_matches(documents, span=span)
    links = found.select("a", "b").distinct()
    many = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    x = classes.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    y = classes.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    both = links.unionByName(many).join(x, "a").join(y, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_parts(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, chars, shared_chars, share, partners): how much of each document stands elsewhere.

    Every document comes out, those without a shared span with 0; a text that another
    document repeats whole is shared whole. NULL texts have 0 characters.
    """
    found, classes, places = class_matches(documents, span=span)
    found = materialize(found, "span-matches")
    side = lambda x, y: found.select(F.col(x).alias("rep"), F.col(y).alias("with"), F.col(f"start_{x}").alias("s"), "length", F.col(f"pos_{x}").alias("pos"))
    sides = side("a", "b").unionByName(side("b", "a"))
    # what is shared around an anchor is shared wherever the document repeats its surroundings
    often = places.where(F.size("others") > 1).select(F.col("doc_id").alias("rep"), F.col("pos").cast("bigint").alias("pos"), "others")
    once = sides.join(often, ["rep", "pos"], "left_anti").select("rep", "with", "s", "length")
    more = sides.select("rep", "pos", (F.col("s") - F.col("pos")).alias("d"), "length", "with").join(often, ["rep", "pos"]).select("rep", "with", "d", "length", F.explode("others").alias("at")).select("rep", "with", (F.col("at") + F.col("d")).alias("s"), "length")
    sides = once.unionByName(more)
    spans = sides.groupBy("rep").agg(F.array_sort(F.collect_set(F.struct(F.col("s"), (F.col("s") + F.col("length")).alias("e")))).alias("spans"))
    size = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    reach = sides.select("rep", "with").distinct().join(size.withColumnRenamed("rep", "with"), "with").groupBy("rep").agg(F.sum("m").alias("others"))
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("upto"))
    sum_ = F.aggregate("spans", zero, lambda acc, x: F.struct((acc["sum"] + F.greatest(x["e"] - F.greatest(acc["upto"], x["s"]), F.lit(0))).alias("sum"), F.greatest(acc["upto"], x["e"]).alias("upto")))["sum"]
    per = size.join(spans, "rep", "left").join(reach, "rep", "left").select("rep", "m", F.coalesce(sum_, F.lit(0)).alias("part"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("partners"))
    docs = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars")).join(classes, "doc_id", "left").join(per, "rep", "left")
    shared = F.when(F.col("m") > 1, F.col("chars")).otherwise(F.coalesce("part", F.lit(0)))
    return docs.select("doc_id", "chars", shared.alias("shared_chars"), F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(0.0).alias("share"), F.coalesce("partners", F.lit(0)).alias("partners"))
