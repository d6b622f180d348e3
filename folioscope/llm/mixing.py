"""p8: mixing sources to target shares of the size in tokens.

Documents are counted by source and exact token length. The total of a mix is the largest that no source limits: each
source gives its share of it with at most max_repeats copies. A source's budget is met by whole copies of the source
and, for the rest, by a subset whose size comes as near to the rest as a sum of document sizes can: a proportional part
of each length, then bounded-knapsack dynamic programming over the lengths left. Which documents of a length are taken
is decided by a seeded hash.

Defined results: documents without tokens (null, empty) are never taken, as they add no size; documents of a source
that no mix names, or of a null source, are left out; a source that a mix names but that has no tokens is reported with
0 and does not limit the total; repeated texts are separate documents; targets that are null or 0 get no documents.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.encoding import VOCABULARY, count_tokens
from folioscope.plans.session import cut

SEED = 17
#: Largest rest, in tokens, that the dynamic programming works on; its bit set has as many bits.
DP_CAPACITY = 1 << 16
#: Parts of the hash range, so that the documents of one length are ranked in small groups.
PARTS = 1024


def knapsack(lengths: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each length to take for the largest total up to capacity; at most counts of each.

    Reachable totals are the bits of an integer; a length's count is split into powers of two, so each part is one
    shift. The sets before each part are kept to walk back from the best total.
    """
    within, reach, parts, history = (1 << (capacity + 1)) - 1, 1, [], []
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left, size = min(count, capacity // length if length else 0), 1
        while left and not reach >> capacity & 1:
            n = min(size, left)
            parts.append((i, n))
            history.append(reach)
            reach |= reach << (n * length) & within
            left, size = left - n, size * 2
    taken, total = [0] * len(lengths), reach.bit_length() - 1
    for (i, n), before in zip(reversed(parts), reversed(history)):
        if not before >> total & 1:
            taken[i] += n
            total -= n * lengths[i]
    return taken


def fit(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many documents of each length to take for a total as near below budget as possible; budget is at most their total."""
    size = sum(a * b for a, b in zip(lengths, counts))
    if budget >= size:
        return list(counts)
    taken = [b * budget // size for b in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, taken))
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    while rest > DP_CAPACITY:
        before = rest
        for i in order:
            if taken[i] < counts[i] and lengths[i] <= rest - DP_CAPACITY // 2:
                taken[i] += 1
                rest -= lengths[i]
        if rest == before:
            break
    if rest > DP_CAPACITY:  # only documents that are longer than what may be left
        for i in sorted(order, key=lambda i: -lengths[i]):
            n = min(counts[i] - taken[i], rest // lengths[i])
            taken[i] += n
            rest -= n * lengths[i]
    # What is taken is given back as far as the last step can choose from it, one of each length first; a budget within its
    # capacity is so met by the best choice of all.
    for most in (1, size):
        for i in order:
            n = max(0, min(taken[i], most, (DP_CAPACITY - rest) // lengths[i]))
            taken[i] -= n
            rest += n * lengths[i]
    if rest <= DP_CAPACITY:
        more = knapsack([lengths[i] for i in order], [counts[i] - taken[i] for i in order], rest)
        for i, n in zip(order, more):
            taken[i] += n
    return taken


def plan(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, size, budget): budgets from sizes. histogram: (source, n_tokens, n)."""
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("size"))
    named = targets.where("target_share > 0").join(sizes, "source", "left").na.fill(0, ["size"])
    limit = F.min(F.when(F.col("size") > 0, F.col("size") * F.coalesce("max_repeats", F.lit(1)) / F.col("target_share")))
    whole = limit.over(Window.partitionBy("mix_name"))
    budget = F.least(F.floor(F.col("target_share") * whole + F.lit(1e-6)), F.col("size") * F.coalesce("max_repeats", F.lit(1)))
    return named.withColumn("budget", F.coalesce(budget, F.lit(0)).cast("long"))


def choose(lengths: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The plan of each source of each mix, and (mix_name, source, doc_id, n_tokens, copies) of the documents taken. lengths: (doc_id, source, n_tokens)."""
    placed = lengths.where("n_tokens > 0 and source is not null").withColumn("_hash", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("_part", F.pmod(F.col("_hash"), F.lit(PARTS)).cast("int"))
    by_part = cut(placed.groupBy("source", "n_tokens", "_part").agg(F.count("*").alias("n")))
    histogram = by_part.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
    budgets = cut(plan(histogram, targets))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens")
        size, budget = int(rows["size"].iloc[0]), int(rows["budget"].iloc[0])
        lengths, counts = rows["n_tokens"].astype(int).tolist(), rows["n"].astype(int).tolist()
        whole, rest = divmod(budget, size)
        extra = fit(lengths, counts, rest, seed) if rest else [0] * len(lengths)
        return pd.DataFrame({"mix_name": rows["mix_name"], "source": rows["source"], "n_tokens": rows["n_tokens"], "whole": whole, "extra": extra})

    # A group has one row per token length of a source, however many documents there are.
    counts = histogram.join(budgets.where("size > 0").select("mix_name", "source", "size", "budget"), "source").groupBy("mix_name", "source").applyInPandas(fitted, "mix_name string, source string, n_tokens long, whole long, extra long")
    before = F.sum("n").over(Window.partitionBy("mix_name", "source", "n_tokens").orderBy("_part")) - F.col("n")
    shares = cut(by_part.join(counts, ["source", "n_tokens"]).withColumn("_free", F.col("extra") - before).select("mix_name", "source", "n_tokens", "_part", "n", "whole", "_free").where("whole > 0 or _free > 0"))
    # Parts that are taken whole or not at all need no ranking; one part of each length does.
    joined = placed.select("doc_id", "source", "n_tokens", "_part", "_hash").join(shares, ["source", "n_tokens", "_part"])
    simple = joined.where("_free <= 0 or _free >= n").withColumn("_more", (F.col("_free") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("mix_name", "source", "n_tokens", "_part").orderBy("_hash", "doc_id"))
    ranked = joined.where("_free > 0 and _free < n").withColumn("_more", (rank <= F.col("_free")).cast("long"))
    chosen = simple.unionByName(ranked).select("mix_name", "source", "doc_id", "n_tokens", (F.col("whole") + F.col("_more")).alias("copies")).where("copies > 0")
    return budgets, chosen


def reached(budgets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per mix and source: target and reached share, budget, reached tokens and what they fall short of it, and the most copies of a document."""
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("n_documents"))
    rows = budgets.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "most_copies", "n_documents"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_name")), F.lit(0))
    return rows.select("mix_name", "source", "target_share", F.coalesce(share, F.lit(0.0)).alias("reached_share"), "budget", "tokens", (F.col("budget") - F.col("tokens")).alias("shortfall"), "max_repeats", "most_copies", "n_documents")


def _inputs(spark: SparkSession, sf: str, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return cut(count_tokens(docs, ["doc_id", "source"], path=path)), spark.read.parquet(f"{sf}/mix_targets.parquet")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return choose(*_inputs(spark, sf))[1]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return reached(*choose(*_inputs(spark, sf)))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per mix and source: whether the budget and the repeats allowed are kept, and whether the budget is met but for less than 2,000 tokens."""
    rows = p8_shares(spark, sf)
    return rows.select("mix_name", "source", ((F.col("tokens") <= F.col("budget")) & (F.col("most_copies") <= F.col("max_repeats"))).alias("kept"), (F.col("shortfall") < 2000).alias("met"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_invariants": p8_invariants}
ORACLES = {"p8_invariants": "SELECT mix_name, source, true AS kept, true AS met FROM mix_targets WHERE target_share > 0"}
