"""Tables, object keys, content and snapshot stores, and corpora as fetch tiers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import utf16_length

THIN = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a machine-local folder serves sessions of one machine; on a
    cluster, whose executors could not read each other's files there, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_.get() if set_.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back; later work starts from there. See forget()."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/skein-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Remove the table behind a materialized frame that no later plan reads."""
    if path := getattr(df, "_skein_path", None):
        remove_folder(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables this application wrote to the shared folder; frames that read them are void afterwards."""
    remove_folder(spark, f"{shared_dir(spark).rstrip('/')}/skein-{spark.sparkContext.applicationId}")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df over at least so many partitions (by default the cores there are), for stages of heavy work per row.

    A scan of at least as many partitions stays as it lies. Plans with shuffles have their
    partitions from those and stay too.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    want = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def numbered(df: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) within its group in the given order; order must tell all rows of a group apart.

    Rows are range-partitioned over all cores, so a group that holds most rows is numbered
    in many tasks; offsets of a group's parts are added up from their counts, at most one
    row per group and partition.
    """
    lone = F.monotonically_increasing_id()
    cut = materialize(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumns({"_pid": F.spark_partition_id(), "_row": lone}), "numbered")
    part = cut.groupBy(group, "_pid").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("_before", before).drop("_n").withColumnRenamed(group, "_group")
    both = cut.join(part.withColumnRenamed("_pid", "_part"), (F.col("_pid") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn(name, (F.col("_row") - F.col("_first") + F.col("_before") + 1)).select(*df.columns, name)


def crawl_page_key(crawl_id: Column, page_id: Column) -> Column:
    return F.concat(F.lit("crawl-pages/"), crawl_id, F.lit("/"), page_id.cast("string"), F.lit(".md"))


def parse_crawl_page_key(key: Column) -> tuple[Column, Column]:
    """(crawl id, page id) of a key whose crawl id is hex and dashes; NULL for others."""
    rx = r"^crawl-pages/([0-9a-fA-F-]+)/(\d+)\.md$"
    return F.nullif(F.regexp_extract(key, rx, 1), F.lit("")), F.nullif(F.regexp_extract(key, rx, 2), F.lit("")).cast("bigint")


def snapshot_key(request_id: Column) -> Column:
    return F.concat(F.lit("request-snapshots/"), request_id, F.lit(".json"))


def freshness_key(url: Column) -> Column:
    return F.concat(F.lit("freshness/"), F.sha2(url, 256), F.lit(".json"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (key, body) rows; new must have one row per key."""
    return store.join(new.select("key"), "key", "left_anti").select("key", "body").unionByName(new.select("key", "body"))


def get(store: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with their body, NULL where there is none."""
    return keys.join(store, "key", "left")


def list_prefix(store: DataFrame, prefix: str) -> DataFrame:
    return store.where(F.col("key").startswith(prefix)).select("key")


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys, "key", "left_anti")


def latest_snapshots(captures: DataFrame, order: list[str]) -> DataFrame:
    """The last capture of every request id in the given order; captures without one are not kept."""
    cols = [c for c in captures.columns if c != "request_id"]
    last = captures.where("request_id is not null").groupBy("request_id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("s"))
    return last.select("request_id", "s.*")


class Blobs:
    """Text bodies by key under a prefix of a folder on any Hadoop file system.

    The prefix is put before every key that goes in and taken off every key that comes out;
    a key that is not there has a NULL body, other failures are raised. A later put of a key
    replaces the earlier one.
    """

    SCHEMA = "key string, body string, put bigint, gone boolean"

    def __init__(self, spark: SparkSession, folder: str, prefix: str = ""):
        self.spark, self.folder, self.prefix, self.puts = spark, folder.rstrip("/"), prefix, 0

    def ensure(self) -> None:
        """Create the folder if need be; repeating it changes nothing."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(at)

    def _append(self, rows: DataFrame) -> None:
        self.ensure()
        last = self._log().agg(F.max("put")).first()[0]
        at = F.lit((last or 0) + 1).cast("bigint")
        rows.select(F.concat(F.lit(self.prefix), "key").alias("key"), "body", at.alias("put"), "gone").write.mode("append").parquet(self.folder)

    def _log(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def _live(self) -> DataFrame:
        mine = self._log().where(F.startswith("key", F.lit(self.prefix)))
        last = mine.groupBy("key").agg(F.max("put").alias("put"))
        live = mine.join(last, ["key", "put"]).where("not gone")
        return live.select(F.substring("key", F.lit(len(self.prefix) + 1), F.length("key")).alias("key"), "body")

    def put(self, rows: DataFrame) -> None:
        """rows (key, body), one per key."""
        self._append(rows.select("key", "body", F.lit(False).alias("gone")))

    def delete(self, keys: DataFrame) -> None:
        """Keys that are not there are no error."""
        self._append(keys.select("key", F.lit(None).cast("string").alias("body"), F.lit(True).alias("gone")).distinct())

    def get(self, keys: DataFrame) -> DataFrame:
        return keys.select("key").join(self._live(), "key", "left")

    def list(self, prefix: str = "") -> DataFrame:
        return self._live().where(F.startswith("key", F.lit(prefix))).select("key")


def snapshots_of(bodies: DataFrame, schema: str) -> DataFrame:
    """(key, snapshot) of stored JSON bodies; a malformed body reads as missing."""
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json("body").isNotNull()
    return bodies.select("key", F.when(whole, parsed).alias("snapshot"))


def migrate(spark: SparkSession, scripts: dict[str, str]) -> list[str]:
    """Run the statements of all scripts in the order of their names; returns the names.

    Statements end with a semicolon and must be idempotent DDL, so that a second run changes nothing.
    """
    for name in sorted(scripts):
        for statement in filter(str.strip, scripts[name].split(";")):
            spark.sql(statement)
    return sorted(scripts)


def choose_tiers(requests: DataFrame, static: DataFrame, rendered: DataFrame | None) -> DataFrame:
    """requests (url, session BOOLEAN or none, ...) with tier, attempts and error_kind, from (url, units) of pages that were fetched.

    units: UTF-16 length of a page's text, urls must be unique. The plain page is served
    unless it is missing or thinner than 200 units; then the rendered one is looked up, and
    wins only if strictly longer. A request under a session goes to the rendered page alone.
    Without a renderer (None) requests that need it fail with error_kind internal; with an
    empty one they fall back to plain. What no tier serves is all_tiers_failed and keeps its
    attempts.
    """
    own = requests if "session" in requests.columns else requests.withColumn("session", F.lit(False))
    s = static.select("url", F.col("units").alias("s_units"), F.lit(True).alias("s_ok"))
    h = (rendered if rendered is not None else static.where(F.lit(False))).select("url", F.col("units").alias("h_units"), F.lit(True).alias("h_ok"))
    j = own.join(s, "url", "left").join(h, "url", "left").withColumns({"s_ok": F.coalesce("s_ok", F.lit(False)), "h_ok": F.coalesce("h_ok", F.lit(False)), "session": F.coalesce("session", F.lit(False))})
    want = F.col("session") | ~F.col("s_ok") | (F.coalesce("s_units", F.lit(0)) < THIN)
    longer = ~F.col("s_ok") | (F.coalesce("h_units", F.lit(0)) > F.coalesce("s_units", F.lit(0)))
    wins = want & F.col("h_ok") & (F.col("session") | longer)
    tier = F.when(wins, "headless").when(F.col("s_ok") & ~F.col("session"), "static")
    one = lambda name, ok: F.array(F.struct(F.lit(name).alias("tier"), F.col(ok).alias("success")))
    tried = F.when(F.col("session"), one("headless", "h_ok")).when(want, F.concat(one("static", "s_ok"), one("headless", "h_ok"))).otherwise(one("static", "s_ok"))
    error = F.when(tier.isNull(), F.lit("all_tiers_failed"))
    if rendered is None:
        tier, error = F.when(~want, F.lit("static")), F.when(want, F.lit("internal"))
        tried = F.when(F.col("session"), F.expr("cast(array() as array<struct<tier:string,success:boolean>>)")).otherwise(one("static", "s_ok"))
    return j.select(*requests.columns, tier.alias("tier"), tried.alias("attempts"), error.alias("error_kind"))


def fetched(corpus: DataFrame) -> DataFrame:
    """The rows of a corpus that count as a successful fetch, one per url: status 200 to 299.

    Of several rows of a url the one with the least hash of its columns is taken, wherever it lies.
    """
    ok = corpus.where(F.col("status_code").between(200, 299) & F.col("url").isNotNull())
    rest = [c for c in corpus.columns if c != "url"]
    return ok.groupBy("url").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("p")).select("url", "p.*")


def scrape_tiers(requests: DataFrame, static: DataFrame, rendered: DataFrame | None) -> DataFrame:
    """requests (url, session or none, ...) served from two corpora (url unique, text, ...): see choose_tiers().

    The winner's page comes out whole; its columns are joined once, after the choice was made
    on lengths alone.
    """
    size = lambda c: c.select("url", utf16_length(F.col("text")).alias("units"))
    chosen = choose_tiers(requests, size(static), None if rendered is None else size(rendered))
    pages = static.withColumn("tier", F.lit("static"))
    if rendered is not None:
        pages = pages.unionByName(rendered.withColumn("tier", F.lit("headless")), allowMissingColumns=True)
    return chosen.join(pages, ["url", "tier"], "left")
