"""Citations, field comparison and accuracy rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import even_spaces

LOW = 0.7


def fill_citations(fields: DataFrame, confidence: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per (request_id, field) of fields: missing confidence and score are 0, a missing quote is ''.

    Citations and confidences of fields that are not there are dropped; position is kept.
    """
    keys = ["request_id", "field"]
    c = confidence.select(*keys, "confidence").dropDuplicates(keys)
    q = citations.select(*keys, "quote", "support_score").dropDuplicates(keys)
    return fields.join(c, keys, "left").join(q, keys, "left").fillna({"confidence": 0.0, "quote": "", "support_score": 0.0})


def verify(citations: DataFrame, pages: DataFrame, key: str = "result_id", text: str = "text") -> DataFrame:
    """citations with verified recomputed against the page's text, and support_score 0 where it is false.

    A citation whose page is missing or has no text is not verified; the quote is unchanged.
    A page's text is evened out once, before its citations meet it.
    """
    src = pages.select(key, even_spaces(F.col(text)).alias("__text"))
    quote = even_spaces(F.col("quote"))
    j = citations.drop("verified").join(src, key, "left").withColumn("verified", F.coalesce((quote != "") & F.contains(F.col("__text"), quote), F.lit(False))).drop("__text")
    return j.withColumn("support_score", F.when(F.col("verified"), F.coalesce("support_score", F.lit(0.0))).otherwise(F.lit(0.0)))


def is_flagged(confidence, verified, score):
    """A field needs review if its confidence or its citation is weak."""
    weak = ~F.coalesce(verified, F.lit(False)) | (F.coalesce(score, F.lit(0.0)) < LOW)
    return (F.coalesce(confidence, F.lit(0.0)) < LOW) | weak


def flagged_fields(filled: DataFrame, position: str = "position") -> DataFrame:
    """(request_id, flagged): names of the fields to review, in their given order."""
    flag = is_flagged(F.col("confidence"), F.col("verified"), F.col("support_score"))
    picked = F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct(position, "field")))), lambda x: x["field"])
    return filled.groupBy("request_id").agg(picked.alias("flagged"))


def rates(scored: DataFrame, by: list[str]) -> DataFrame:
    """Share of matched, verified and low-confidence-or-strongly-cited rows per group.

    scored has matched, cited, verified, confidence, support_score; uncited rows count
    towards the fields but not towards the citations.
    """
    soft = (F.col("confidence") < LOW) | (F.col("verified") & (F.col("support_score") >= LOW))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    agg = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("fields"), n(F.col("matched")).alias("matched"), n(F.col("cited")).alias("cited"), n(F.col("cited") & F.col("verified")).alias("verified"), n(soft).alias("soft"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return agg.select(*by, "fields", "cited", ratio("matched", "fields").alias("field_accuracy"), ratio("verified", "cited").alias("citation_rate"), ratio("soft", "fields").alias("soft_rate"))
