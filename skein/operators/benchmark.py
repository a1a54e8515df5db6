"""Accuracy runs over labelled fixtures, by runners that are registered by name."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import strings_match
from skein.operators import verify


class Runner(Protocol):
    """Answers fixtures (fixture_id, url, text): rows (fixture_id, field, value, confidence, quote, support_score)."""

    def __call__(self, fixtures: DataFrame) -> DataFrame: ...


#: No runner comes with the engine.
RUNNERS: dict[str, Runner] = {}


def run(name: str, fixtures: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per runner with its rates (see verify.rates) over expected (fixture_id, field, value).

    A field that a runner leaves out, or a fixture it fails on, counts towards the fields and
    not towards the citations. An unknown runner is a KeyError.
    """
    answers = RUNNERS[name](fixtures).select("fixture_id", "field", F.col("value").alias("got"), "confidence", "quote", "support_score")
    checked = verify.verify(answers, fixtures.select("fixture_id", "text"), key="fixture_id")
    j = expected.select("fixture_id", "field", "value").join(checked, ["fixture_id", "field"], "left")
    there = F.col("quote").isNotNull()
    scored = j.withColumns({"matched": there & strings_match(F.col("got"), F.col("value")), "cited": there, "verified": F.coalesce("verified", F.lit(False)), "runner": F.lit(name)})
    return verify.rates(scored, ["runner"])
