"""Problem 3: near-duplicate records with small edits.

Method: fast similarity sketching. In round after round every element of a set is hashed
to a bin and a value; a bin keeps its least value, and values of later rounds are larger,
so early placements stand. After as many rounds as there are bins, each further round
serves one bin, so every coordinate is filled whatever the size of the set, and the share
of equal coordinates concentrates around the Jaccard similarity. Bands of coordinates give
candidates; candidates are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import forget, materialize, mix64, narrowed, spread, without

MIN_WORDS = 60
SHINGLE = 3
#: Similarity as a fraction, so that the threshold is exact.
NUM, DEN = 7, 10
#: 40 bands of 5 coordinates: a pair at 0.7 is missed with probability (1 - 0.7^5)^40 < 0.001.
BANDS, ROWS = 40, 5
#: Candidates go on to the exact check from this share of equal coordinates: five standard deviations below the threshold.
LEAST_ESTIMATE = 0.7 - 5 * (0.7 * 0.3 / (BANDS * ROWS)) ** 0.5
#: Buckets with more members are split into blocks of this size, which meet pairwise.
BLOCK = 1000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_GAPS = str.maketrans("\t\r\n", "   ")


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: dict[str, int], size: int = SHINGLE, least: int = MIN_WORDS) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of size consecutive words; None below least words."""
    ws = [w for w in text.lower().translate(_GAPS).split(" ") if w]
    if len(ws) < max(least, size):
        return None
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    n = len(h) - size + 1
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(acc)


def sketch(flat: np.ndarray, row: np.ndarray, docs: int, bins: int) -> np.ndarray:
    """(docs, bins) sketches of the sets whose elements are flat, element i in set row[i]; no set is empty."""
    out = np.full(docs * bins, _EMPTY, np.uint64)
    live = np.arange(len(flat))
    for r in range(2 * bins):
        x = mix64(flat[live] + np.uint64((r + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(r) << np.uint64(53)) | (mix64(x ^ np.uint64(0x27D4EB2F165667C5)) >> np.uint64(11))
        at = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if r < bins else np.full(len(live), r - bins)
        np.minimum.at(out, row[live] * bins + at, value)
        open_ = (out.reshape(docs, bins) == _EMPTY).any(axis=1)
        if not open_.any():
            break
        live = live[open_[row[live]]]
    return out.reshape(docs, bins)


def band_keys(sk: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(docs, bands) 64-bit keys, each over rows coordinates and its band's number."""
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sk), 1))
    for j in range(rows):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sk[:, j : bands * rows : rows])
    return acc


def sketched(pages: DataFrame, text: str = "markdown", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, least: int = MIN_WORDS) -> DataFrame:
    """(result_id, sig, n, shingles, bands, sketch) of rows with enough words.

    sig names the exact set, sketch holds the low byte of every coordinate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = _WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids, sets = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if t and (s := shingles(t, words, size, least)) is not None:
                        ids.append(i)
                        sets.append(s)
                if not sets:
                    continue
                n = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                sk = sketch(flat, np.repeat(np.arange(len(sets)), n), len(sets), bands * rows)
                keys = band_keys(sk, bands, rows)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array(n, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64))),
                        pa.array([x.tobytes() for x in sk.astype(np.uint8)], pa.binary()),
                    ],
                    names=["result_id", "sig", "n", "shingles", "bands", "sketch"],
                )

    return spread(pages.where("result_id is not null").select("result_id", text)).mapInArrow(run, "result_id bigint, sig binary, n int, shingles array<bigint>, bands array<bigint>, sketch binary")


def candidates(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, that share a band and whose sizes allow the threshold.

    Bands of one member, most of them, are only counted; rows go on with the others.
    """
    buckets = reps.select("result_id", "n", F.explode("bands").alias("band"))
    crowded = materialize(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "neardup-crowded")
    parts = F.ceil(F.col("members") / block).cast("int")
    rows = narrowed(buckets, "band", crowded.select("band")).join(crowded, "band").select("band", "result_id", "n", parts.alias("parts"), F.pmod(F.xxhash64("result_id"), parts).cast("int").alias("own"))
    met = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "result_id", "n", "own"
    )
    a, b = met.alias("a"), met.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    once = (F.col("a.result_id") < F.col("b.result_id")) & ((F.col("a.own") != F.col("b.own")) | (F.col("a.lo") == F.col("a.hi")))
    sizes = F.least("a.n", "b.n") * DEN >= F.greatest("a.n", "b.n") * NUM
    return a.join(b, same & once & sizes).select(F.col("a.result_id").alias("a"), F.col("b.result_id").alias("b")).distinct()


def likely(pairs: DataFrame, sets: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """The pairs whose sketches agree on at least least of their coordinates.

    Chance candidates end here, for 2 x 200 bytes looked up instead of two whole sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least) if b.num_rows else pa.array([], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    own = narrowed(sets.select("result_id", "sketch"), "result_id", ends(pairs))
    j = pairs.join(own.select(F.col("result_id").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("result_id").alias("b"), F.col("sketch").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def ends(pairs: DataFrame) -> DataFrame:
    """(result_id): the distinct ends of pairs (a, b)."""
    return pairs.select(F.col("a").alias("result_id")).unionByName(pairs.select(F.col("b").alias("result_id"))).distinct()


def once(sets: DataFrame) -> DataFrame:
    """One row per result_id: of several the one with the least sig. Only rows of repeated ids are moved."""
    twice = materialize(sets.groupBy("result_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("result_id"), "neardup-twice")
    more = sets.join(twice, "result_id", "left_semi").groupBy("result_id").agg(F.min(F.struct("sig", "n")).alias("s")).select("result_id", "s.sig", "s.n")
    return sets.join(twice, "result_id", "left_anti").select("result_id", "sig", "n").unionByName(more)


def similar_classes(pages: DataFrame, text: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives (a, b), membership (result_id, rep)).

    A class holds the rows with the same set of shingles; its representative is its least
    result_id. Rows with fewer words than MIN_WORDS (NULL and empty texts too) are in no
    class; repeated rows of one result_id count once. Sets stay where they were written:
    ids, sizes, keys and sketches find the pairs, and the sets of rows that are in a likely
    pair are looked up at the end.
    """
    all_ = materialize(sketched(pages, text), "neardup-sets")
    ids = materialize(once(all_), "neardup-ids")
    members = materialize(ids.join(ids.groupBy("sig").agg(F.min("result_id").alias("rep")), "sig").select("result_id", "rep"), "neardup-members")
    # representatives are told by what they are not, so that few ids are looked up
    copies = members.where("result_id != rep").select("result_id")
    sets = materialize(without(all_.select("result_id", "n", "bands", "sketch"), "result_id", copies), "neardup-keys")
    met = materialize(candidates(sets), "neardup-candidates")
    pairs = materialize(likely(met, sets).distinct(), "neardup-likely")
    paired = materialize(ids.select("result_id", "sig").join(ends(pairs), "result_id", "left_semi"), "neardup-paired")
    found = narrowed(all_.select("result_id", "sig", "n", "shingles"), "result_id", paired.select("result_id"))
    own = materialize(found.join(paired, ["result_id", "sig"], "left_semi").dropDuplicates(["result_id"]), "neardup-kept")
    left = pairs.join(own.select(F.col("result_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    both = left.join(own.select(F.col("result_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    verified = both.withColumn("k", common).where(F.col("k") * DEN >= (F.col("na") + F.col("nb") - F.col("k")) * NUM).select("a", "b")
    return verified, members


def similar_pairs(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """(result_id_a, result_id_b): all rows at or above the threshold, smaller id first."""
    pairs, members = similar_classes(pages, text)
    return expanded(pairs, members)


def expanded(pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(result_id_a, result_id_b) of all members of linked classes and within each class, smaller id first.

    Large classes are split by a hash of their members; a link is looked up in each part.
    The table of such classes has at most a row per block members, so it may be broadcast.
    """
    size = materialize(members.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "neardup-sizes")
    within = size.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    large = size.where(F.col("m") > block).select("rep", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    split = members.join(F.broadcast(large), "rep", "left").select("rep", "result_id", F.pmod(F.xxhash64("result_id"), parts).cast("int").alias("part"))

    def side(links: DataFrame, key: str, name: str) -> DataFrame:
        here = links.join(F.broadcast(large.withColumnRenamed("rep", key)), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        return here.join(split.select(F.col("rep").alias(key), "part", F.col("result_id").alias(name)), [key, "part"]).drop("part")

    both = side(side(pairs.unionByName(within), "a", "x"), "b", "y")
    return both.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("result_id_a"), F.greatest("x", "y").alias("result_id_b"))


def groups(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """(result_id, group_id, links): connected groups of similar rows; one row per row with enough words.

    group_id is the least result_id of the group, links the number of other rows similar to
    this one. Labels spread over the representatives' links until none changes.
    """
    pairs, members = similar_classes(pages, text)
    pairs = materialize(pairs, "neardup-pairs")
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = members.where("result_id = rep").select("rep")
    label = nodes.select("rep", F.col("rep").alias("label"))
    while True:
        near = edges.join(label, F.col("b") == F.col("rep")).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, F.col("rep") == F.col("a"), "left").select("rep", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("rep").alias("via"), F.col("label").alias("far"))
        last, step = label, materialize(step.join(jump, F.col("label") == F.col("via")).select("rep", "old", F.least("label", "far").alias("label")), "neardup-labels")
        label = step.select("rep", "label")
        label._skein_path = step._skein_path
        forget(last)
        if step.where("old != label").isEmpty():
            break
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    reach = edges.join(size, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("m").alias("others"))
    per = label.join(size, "rep").join(reach, F.col("rep") == F.col("a"), "left").select("rep", F.col("label").alias("group_id"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(per, "rep").select("result_id", "group_id", "links")
