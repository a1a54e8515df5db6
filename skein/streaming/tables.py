"""Structured Streaming over the event tables.

Streams read the same Parquet layout as the batch queries, so that every streaming result
can be held against its batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.operators.freshness import decide, fold_columns
from skein.sources.stores import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table's files as a stream; the table may be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into the shared folder; returns the written rows."""
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_batches(df: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """As run_available for streams in update mode: every micro-batch is written under its own number, so a repeated one replaces itself.

    In complete mode each micro-batch holds the whole result and the last one is returned.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())]) if mode == "complete" else df.schema
    out = spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.select(*df.columns)


def deduplicated_costs(events: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Cost events without second deliveries; state older than lateness is dropped."""
    return events.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])


def windowed_events(events: DataFrame, ts: str = "ts", size: str = "1 day", lateness: str | None = None) -> DataFrame:
    """Events per tumbling window and type.

    Without lateness no event is too late and the state keeps every window: for complete or
    update mode over a bounded table. With it, rows of windows that the watermark has passed
    are dropped, and append mode holds the last windows back.
    """
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    timed = timed if lateness is None else timed.withWatermark("at", lateness)
    out = timed.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


_OUT = T.StructType([T.StructField("url", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("decision", T.StringType()), T.StructField("crawled_ms", T.LongType())])
_STATE = T.StructType([T.StructField("crawled_ms", T.LongType()), T.StructField("landing", T.StringType())])


class _Freshness(StatefulProcessor):
    """The fold of operators.freshness.replay with its state kept between micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("crawled", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        all_ = pd.concat(list(rows)).sort_values(["at", "seq"])
        held = self.state.get()
        crawled = int(held[0]) if held is not None and held[0] is not None else None
        landing = [int(x) for x in held[1].split()] if held is not None and held[1] else []
        out = []
        for seq, at, limit, ok, late in zip(all_["seq"], all_["at"], all_["limit"], all_["ok"], all_["latency"], strict=True):
            kind, crawled, landing = decide(crawled, landing, int(at), None if pd.isna(limit) else int(limit), bool(ok), int(late))
            out.append((key[0], int(seq), kind, crawled))
        if crawled is not None:
            self.state.update((crawled, " ".join(map(str, landing))))
        yield pd.DataFrame(out, columns=["url", "seq", "decision", "crawled_ms"]).astype({"crawled_ms": "Int64"})

    def close(self) -> None:
        pass


def replay_stream(requests: DataFrame) -> DataFrame:
    """Serving decisions of a request stream (url, seq, ts, max_seconds, ok); needs the RocksDB state store.

    Rows of one URL must arrive in time order across micro-batches; within one they are sorted.
    """
    cols = fold_columns(requests)
    return cols.groupBy("url").transformWithStateInPandas(statefulProcessor=_Freshness(), outputStructType=_OUT, outputMode="Update", timeMode="None")
