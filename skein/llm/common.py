"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.stores import forget, materialize, shared_dir, spread, table

__all__ = ["forget", "host_of", "join_sites", "materialize", "mix64", "narrowed", "shared_dir", "spread", "table", "tokenizer_path", "without"]


def host_of(url: Column) -> Column:
    """Host of a URL in lower case without a leading ``www.``; NULL without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokenizer_path(file: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; folder defaults to SKEIN_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers"), file)


def join_sites(rows: DataFrame, per_site: DataFrame, sizes: DataFrame, site: str, key: str, most: int) -> DataFrame:
    """rows left-joined with the one row per_site has of their site, the rows of large sites spread over parts.

    sizes: (site, rows). A site of more than `most` rows takes ceil(rows / most) parts by a
    hash of key; its row of per_site is repeated for each. The table of such sites has at most a row per
    `most` rows of the input, so it may be broadcast.
    """
    large = sizes.where((F.col("rows") > most) & F.col(site).isNotNull()).select(site, F.ceil(F.col("rows") / most).cast("int").alias("_parts"))
    split = rows.join(F.broadcast(large), site, "left").withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    each = per_site.join(F.broadcast(large), site, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return split.join(each, [site, "_part"], "left").drop("_part")


_WORD = 1 << 15
#: Bits of a bitmap of keys: with what a hashed relation adds, its 960 rows stay just below 4 MB, whatever the number of keys.
BITS = 960 * _WORD


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(26)), F.lit(BITS))


def _hits(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with _hit: false only for rows whose key is surely not among ids (one column of the same type).

    The hashes of ids set bits of a map of BITS bits in rows of 4 KB, so the map that is
    broadcast has at most 4 MB. With far more ids than bits it tells nothing apart, and
    what follows sees all rows.
    """
    place = _place(F.col(ids.columns[0]))
    map_ = ids.select(F.floor(place / _WORD).alias("_word"), F.pmod(place, F.lit(_WORD)).alias("_bit")).groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    j = df.withColumn("_place", _place(F.col(key))).withColumn("_word", F.floor(F.col("_place") / _WORD)).join(F.broadcast(map_), "_word", "left")
    bit = F.pmod(F.col("_place"), F.lit(_WORD)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(bit, F.lit(8))) == 1
    return j.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_place", "_word", "_bits")


def narrowed(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key may be among ids, to be joined with them: what cannot match is not shuffled."""
    return _hits(df, key, ids).where("_hit").drop("_hit")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df without the rows whose key is among ids (an anti join that moves only rows that may be)."""
    told = _hits(df, key, ids)
    return told.where("not _hit").drop("_hit").unionByName(told.where("_hit").drop("_hit").join(ids.withColumnRenamed(ids.columns[0], key), key, "left_anti"))
