"""Problem 8: mixing sources to target weights.

Method: pivotal dependent rounding. Every document of a source gets the same expected
number of copies; its whole part is certain, its fraction is a probability. Two documents
with open fractions are paired and token mass is moved between them at random, so that
one becomes integral, while the expected copies of each and the sum of tokens stay as they
were. Buckets of documents are rounded apart; each leaves at most one open document, and
a reduction tree rounds those. The last open document of a source is often one of its
longest; by so much the source may miss its share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize
from skein.llm.tokens import token_counts

#: Documents rounded together in the leaves of the tree.
LEAF_ROWS = 20_000
#: Open documents of so many buckets meet in one node of the tree.
FAN_IN = 256
EPS = 1e-9


def pivotal(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities p of items with weights w > 0; sum(p * w) is kept.

    Returns p with every entry 0 or 1 but for at most one, and the place of that one or -1.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        up = min((1 - p[held]) * w[held], p[i] * w[i])
        down = min(p[held] * w[held], (1 - p[i]) * w[i])
        move = up if draws[i] * (up + down) < down else -down
        p[held] += move / w[held]
        p[i] -= move / w[i]
        open_ = [k for k in (held, i) if EPS < p[k] < 1 - EPS]
        for k in (held, i):
            if k not in open_:
                p[k] = round(p[k])
        held = open_[0] if open_ else -1
    return p, held


def plan_sizes(sizes: DataFrame, plans: DataFrame, total_tokens: int | None = None, fit: bool = False) -> DataFrame:
    """One row per (plan, source): tokens there are, tokens wanted and copies per document.

    The total of a plan is total_tokens, by default all tokens its sources have. A source
    whose share of that is more than max_repeats copies of it is capped and falls short; the
    others stay at their share of the total. With fit the total is instead the largest at
    which no source is capped, however small that makes the plan. Shares of sources without
    tokens are spread over the others in proportion. NULL or negative shares and repeats
    count as 0.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size_tokens"), F.count(F.lit(1)).alias("n_docs"))
    clean = plans.where("plan is not null and source is not null").groupBy("plan", "source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    j = clean.join(have, "source", "left").fillna({"size_tokens": 0, "n_docs": 0})
    usable = (F.col("size_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    reach = F.min(F.when(F.col("usable"), F.col("max_repeats") * F.col("size_tokens") / F.col("goal")))
    all_ = F.sum(F.when(F.col("usable"), F.col("size_tokens"))).cast("double")
    j = j.withColumn("usable", usable)
    per = j.groupBy("plan").agg(F.sum(F.when(F.col("usable"), F.col("target_share"))).alias("mass"))
    j = j.join(per, "plan").withColumn("goal", F.when(F.col("usable"), F.col("target_share") / F.col("mass")).otherwise(0.0))
    tot = j.groupBy("plan").agg((reach if fit else all_ if total_tokens is None else F.lit(float(total_tokens))).alias("total"))
    j = j.join(tot, "plan").withColumn("target_tokens", F.coalesce(F.col("goal") * F.col("total"), F.lit(0.0)))
    need = F.col("target_tokens") / F.col("size_tokens")
    j = j.withColumn("capped", F.coalesce(F.col("usable") & (need > F.col("max_repeats") + EPS), F.lit(False)))
    copies = F.when(F.col("usable"), F.least(F.col("max_repeats").cast("double"), need)).otherwise(0.0)
    return j.withColumn("copies_each", copies).select("plan", "source", "target_share", "max_repeats", "n_docs", "size_tokens", "target_tokens", "capped", "copies_each")


def _node(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "order", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        key = [int(x) for x in np.frombuffer(f"{pdf['plan'][0]}\x00{pdf['source'][0]}\x00{pdf['bucket'][0]}".encode(), np.uint8)]
        p, held = pivotal(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(float), np.random.default_rng([seed, level, *key]))
        pdf["p"] = p
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return run


_NODE = "plan string, source string, doc_id bigint, n_tokens bigint, whole int, p double, bucket bigint, order bigint, open boolean"


def mix(documents: DataFrame, plans: DataFrame, seed: int = 7, total_tokens: int | None = None, fit: bool = False, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of every plan.

    copies: plan, source, doc_id, n_tokens, copies (> 0). shares: one row per plan and
    source with the tokens wanted (target_tokens), whether the cap on repeats keeps the source
    below them (capped), the tokens and the share of the mix reached. A source that is not
    capped is off by less than its last open document; one that would come out empty gives
    its smallest document. Documents without tokens (NULL or empty text) or without source
    are in no mix; repeated doc_ids are separate documents. For the total see plan_sizes().
    """
    sizes = materialize(token_counts(documents.where("source is not null"), ["doc_id", "source"], tokenizer=tokenizer, folder=folder).where("n_tokens > 0"), "mix-sizes")
    want = materialize(plan_sizes(sizes, plans, total_tokens, fit), "mix-plans")
    each = sizes.join(want.where("copies_each > 0").select("plan", "source", "copies_each", "n_docs"), "source").select(
        "plan", "source", "doc_id", "n_tokens",
        F.floor(F.col("copies_each") + EPS).cast("int").alias("whole"),
        F.greatest(F.col("copies_each") - F.floor(F.col("copies_each") + EPS), F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n_docs") / LEAF_ROWS)).alias("bucket"),
        F.xxhash64("doc_id", F.lit(seed + 1)).alias("order"),
    )
    buckets = want.agg(F.max(F.ceil(F.col("n_docs") / LEAF_ROWS))).first()[0] or 1
    level, done = 0, []
    while True:
        rounded = materialize(each.groupBy("plan", "source", "bucket").applyInPandas(_node(level, seed), _NODE), f"mix-level{level}")
        if buckets <= 1:
            # the last open document of a source is drawn by its own probability
            coin = F.pmod(F.xxhash64("plan", "source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
            done.append(rounded.withColumn("p", F.when(F.col("open"), (coin < F.col("p")).cast("double")).otherwise(F.col("p"))))
            break
        done.append(rounded.where("not open"))
        buckets = -(-buckets // FAN_IN)
        each = rounded.where("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level += 1
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.unionByName(more)
    copies = all_.select("plan", "source", "doc_id", "n_tokens", (F.col("whole") + F.round("p").cast("int")).alias("copies")).where("copies > 0")
    none = want.where("copies_each > 0").select("plan", "source").join(copies.select("plan", "source").distinct(), ["plan", "source"], "left_anti")
    least = sizes.groupBy("source").agg(F.min(F.struct("n_tokens", "doc_id")).alias("d"))
    copies = copies.unionByName(none.join(least, "source").select("plan", "source", "d.doc_id", "d.n_tokens", F.lit(1).alias("copies")))
    got = copies.groupBy("plan", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = got.groupBy("plan").agg(F.sum("tokens").alias("plan_tokens"))
    shares = (
        want.join(got, ["plan", "source"], "left").join(total, "plan", "left").fillna({"tokens": 0, "most_copies": 0})
        .select("plan", "source", "target_share", "max_repeats", "n_docs", "size_tokens", "target_tokens", "capped", "copies_each", "tokens", "most_copies",
                F.coalesce(F.col("tokens") / F.col("plan_tokens"), F.lit(0.0)).alias("share"))
    )
    return copies, shares
