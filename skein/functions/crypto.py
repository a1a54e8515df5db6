"""Sealing of session states with versioned keys (AES-256-GCM, 12-byte nonce).

Keys never enter a plan: they reach the workers in a broadcast, and columns hold only
sealed bytes. The cipher itself is the JVM's, called on the driver for single blobs and
through a key column for tables.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Keys:
    """Keys by version; the current one seals, any known one opens. Its text shows no key."""

    def __init__(self, keys: dict[int, bytes], current: int):
        if current not in keys:
            raise ValueError(f"no key of version {current}")
        if any(len(k) != 32 for k in keys.values()):
            raise ValueError("keys must have 32 bytes")
        self.keys, self.current = dict(keys), current

    def __repr__(self) -> str:
        return f"Keys(versions={sorted(self.keys)}, current={self.current})"


class RemoteKeys:
    """Keys by version from a key service behind a port, each asked for once.

    ask(version) returns (status, body), body holding the key in base64. A version that the
    service does not know (404) is None; other failures are raised with the first 500
    characters of the answer.
    """

    def __init__(self, ask: Callable[[int], tuple[int, str]]):
        self.ask, self._held = ask, {}

    def get(self, version: int | None) -> bytes | None:
        if version is None:
            return None
        if version not in self._held:
            status, body = self.ask(version)
            if status != 404 and not 200 <= status < 300:
                raise RuntimeError(f"key service answered {status}: {body[:500]}")
            self._held[version] = None if status == 404 else base64.b64decode(body)
        return self._held[version]

    def keys(self, versions: list[int], current: int) -> Keys:
        """The known ones of versions; the current one must be among them."""
        found = {v: k for v in dict.fromkeys([*versions, current]) if (k := self.get(v)) is not None}
        return Keys(found, current)


def _key_table(df: DataFrame, keys: Keys) -> DataFrame:
    return df.sparkSession.createDataFrame([(v, bytearray(k)) for v, k in keys.keys.items()], "key_version int, __key binary")


def seal(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """df with column replaced by struct sealed(ciphertext, iv, auth_tag, key_version); NULL stays NULL."""
    held = df.withColumn("key_version", F.lit(keys.current)).join(F.broadcast(_key_table(df, keys)), "key_version")  # a handful of keys
    raw = F.aes_encrypt(F.col(column), F.col("__key"), F.lit("GCM"))
    n = F.octet_length("__raw")
    parts = F.struct(F.expr("substring(__raw, 13, octet_length(__raw) - 28)").alias("ciphertext"), F.expr("substring(__raw, 1, 12)").alias("iv"), F.substring(F.col("__raw"), n - 15, F.lit(16)).alias("auth_tag"), F.col("key_version"))
    return held.withColumn("__raw", raw).withColumn("sealed", F.when(F.col("__raw").isNotNull(), parts)).drop("__raw", "__key", "key_version", column)


def open_sealed(df: DataFrame, keys: Keys, out: str = "opened") -> DataFrame:
    """df with the opened text, and error: unknown_key for an unknown version, tampered where the tag fails."""
    held = df.withColumn("key_version", F.col("sealed.key_version")).join(F.broadcast(_key_table(df, keys)), "key_version", "left")
    raw = F.concat(F.col("sealed.iv"), F.col("sealed.ciphertext"), F.col("sealed.auth_tag"))
    plain = F.try_aes_decrypt(raw, F.col("__key"), F.lit("GCM")).cast("string")
    err: Column = F.when(F.col("sealed").isNull(), F.lit(None)).when(F.col("__key").isNull(), "unknown_key").when(plain.isNull(), "tampered")
    return held.withColumn(out, plain).withColumn("error", err).drop("__key", "key_version", "sealed")
