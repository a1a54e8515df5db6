"""Robots rules: parsing rule texts and deciding paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "array<struct<allow:boolean,pattern:string,len:int>>"


def parse_rules(text: str | None, agent: str) -> list[dict]:
    """Rules of the groups that name agent, else of those for *; an unreadable text has none (all is allowed)."""
    own: list[dict] = []
    any_: list[dict] = []
    names: list[str] = []
    open_ = False
    for line in (text or "").splitlines():
        line = line.partition("#")[0].strip()
        key, sep, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not open_:
                names = []
            names.append(value.lower())
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if not value:
                continue
            rule = {"allow": key == "allow", "pattern": _rule_regex(value), "len": len(value)}
            if any(n != "*" and n and n in agent.lower() for n in names):
                own.append(rule)
            if "*" in names:
                any_.append(rule)
        else:
            open_ = False
    return own or any_


def _rule_regex(rule: str) -> str:
    end = rule.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in (rule[:-1] if end else rule).split("*")) + ("$" if end else "")


def rule_table(texts: DataFrame, agent: str) -> DataFrame:
    """(origin, rules) of the latest robots text of every origin."""

    @F.pandas_udf(RULES)
    def rules(text: pd.Series) -> pd.Series:
        return text.map(lambda t: parse_rules(t, agent))

    latest = texts.groupBy("origin").agg(F.max_by("text", "fetched_at").alias("text"))
    return latest.select("origin", rules("text").alias("rules"))


def decide(requests: DataFrame, rules: DataFrame, origin: str = "origin", path: str = "path") -> DataFrame:
    """requests plus robots_allowed: the longest matching rule wins, allow wins a tie, no rule allows."""
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.rlike(F.col(path), r["pattern"])), lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow"))))
    return requests.drop("rules", "robots_allowed").join(rules.withColumnRenamed("origin", origin), origin, "left").withColumn("robots_allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules")


def stale_rules(texts: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """Origins whose text is at least ttl_seconds old at now (a timestamp literal)."""
    latest = texts.groupBy("origin").agg(F.max("fetched_at").alias("fetched_at"))
    return latest.where(F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("fetched_at") >= ttl_seconds * 1000)
