"""Two sequences laid side by side: what both have, and how much of it stands in the same order."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising part of values."""
    ends: list[int] = []
    tops: list[int] = []
    before: list[int | None] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before.append(ends[at - 1] if at else None)
        tops[at : at + 1] = [v]
        ends[at : at + 1] = [i]
    out, i = [], ends[-1] if ends else None
    while i is not None:
        out.append(i)
        i = before[i]
    return out[::-1]


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """(group, value, at_left, at_right): values of two tables (group, value, at) that stand once on either side of a group."""
    def once(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("value is not null").groupBy("group", "value").agg(F.count("*").alias("_n"), F.min("at").alias(f"at_{name}")).where("_n = 1").drop("_n")

    return once(left, "left").join(once(right, "right"), ["group", "value"])


def in_order(pairs: DataFrame) -> DataFrame:
    """The rows of common() that stand in the same order on both sides, as many as possible per group; a group's places alone reach one task."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at_left")
        return f.iloc[longest_rising(f["at_right"].tolist())]

    return pairs.groupBy("group").applyInPandas(run, pairs.schema)


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """(group, n_left, n_right, n_common, n_in_order) of every group of either side."""
    pairs = common(left, right)
    sizes = [rows.groupBy("group").agg(F.count("*").alias(f"n_{n}")) for rows, n in ((left, "left"), (right, "right"))]
    counts = [p.groupBy("group").agg(F.count("*").alias(f"n_{n}")) for p, n in ((pairs, "common"), (in_order(pairs), "in_order"))]
    every = sizes[0].join(sizes[1], "group", "full").join(counts[0], "group", "left").join(counts[1], "group", "left")
    return every.na.fill(0)
