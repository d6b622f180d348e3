"""Order-dependent packing and numbering.

Packing decides piece by piece, but each piece is one binary search in the running sums of its units, so the work is
per piece and not per unit. Numbering is windows alone: an item's number is its rank among the items of its level since
the last item of a higher level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T


def reach(sums: np.ndarray, start: int, limit: int, gap: int = 0) -> int:
    """The end of the longest run of units from start whose sizes, with gap between them, are at most limit; one unit at least.

    sums: running sums of (size + gap), with 0 in front.
    """
    return max(start + 1, int(np.searchsorted(sums, sums[start] + limit + gap, "right")) - 1)


def running(sizes, gap: int = 0) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) + gap)])


def batches(sizes, max_items: int, max_size: int) -> np.ndarray:
    """The batch of each item, at most max_items and max_size; a too large item is alone."""
    sums, n, starts, at = running(sizes), len(sizes), [], 0
    while at < n:
        starts.append(at)
        at = min(reach(sums, at, max_size), at + max_items)
    return np.searchsorted(starts, np.arange(n), "right") - 1


def shortened(unit: str, limit: int, mark: str) -> list[str]:
    """A unit in pieces of at most limit, each ended by the last mark in its second half if there is one."""
    ends = [0]
    while len(unit) - ends[-1] > limit:
        half, full = ends[-1] + limit // 2, ends[-1] + limit
        found = unit.rfind(mark, half, full)
        ends.append(full if found < 0 else found + len(mark.rstrip()))
    pieces = (unit[a:b].strip() for a, b in zip(ends, [*ends[1:], len(unit)]))
    return [p for p in pieces if p]


def packed(units: list[str], limit: int, glue: str, overlap: int = 0) -> list[str]:
    """Units joined by glue into pieces of at most limit; a piece repeats the longest tail of the last that is at most overlap and leaves room for a new unit."""
    sums, out, start, end = running([len(u) for u in units], len(glue)), [], 0, 0
    while end < len(units):
        end = reach(sums, start, limit, len(glue))
        out.append(glue.join(units[start:end]))
        if end == len(units):
            break
        room = min(overlap, limit - len(units[end]) - len(glue))
        start = min(end, int(np.searchsorted(sums, sums[end] - room - len(glue), "left"))) if room > 0 else end
    return out


def _pieces(units: DataFrame, key: str, limit: int, mark: str, glue: str, overlap: int = 0) -> DataFrame:
    """(key, part, parts, text) of rows (key, units)."""
    kind = units.select(key).schema[0].dataType.simpleString()

    def run(frames):
        for f in frames:
            packs = [packed([p for u in us for p in shortened(u.strip(), limit, mark)], limit, glue, overlap) for us in f["units"]]
            f = pd.DataFrame({key: f[key], "parts": [len(p) for p in packs], "text": packs, "part": [range(1, len(p) + 1) for p in packs]})
            yield f[f.parts > 0].explode(["part", "text"])[[key, "part", "parts", "text"]].astype({"part": "int32", "parts": "int32"})

    return units.mapInPandas(run, f"{key} {kind}, part int, parts int, text string")


def sentence_pieces(df: DataFrame, key: str, size: int = 2000, overlap: int = 300) -> DataFrame:
    """Whole sentences packed to size with an overlap of sentences; a longer sentence is cut at a space."""
    return _pieces(df.where("text is not null").select(key, T.sentences(F.col("text")).alias("units")), key, size, " ", " ", overlap)


def paragraph_pieces(df: DataFrame, key: str, limit: int = 2000) -> DataFrame:
    """Paragraphs (between blank lines) packed to limit; a longer one is cut after a sentence."""
    return _pieces(df.where("text is not null").select(key, F.split("text", r"\n\s*\n").alias("units")), key, limit, ". ", "\n\n")


def greedy_batches(df: DataFrame, group: str, key: str, size: str, max_items: int = 64, max_size: int = 16000) -> DataFrame:
    """(group, key, batch) in order of key within each group."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        return f[[group, key]].assign(batch=batches(f[size].fillna(0).astype(int), max_items, max_size))

    kinds = {x.name: x.dataType.simpleString() for x in df.schema}
    return df.select(group, key, size).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, batch int")


#: The digits 0 to 9 in signs of one (1), five (5) and ten (0), and these signs of each decimal place.
SHAPES = ["", "1", "11", "111", "15", "5", "51", "511", "5111", "10"]
SIGNS = {1000: "m  ", 100: "cdm", 10: "xlc", 1: "ivx"}


def numeral(n: Column) -> Column:
    """A number below 4,000 in small Roman numerals, decimal place by decimal place."""
    def place(value: int, signs: str) -> Column:
        digit = F.floor(n / value) % 10
        return F.element_at(F.array(*[F.lit(s.translate(str.maketrans("150", signs))) for s in SHAPES]), (digit + 1).cast("int"))

    return F.concat(*[place(v, s) for v, s in SIGNS.items()])


def letter(n: Column) -> Column:
    """a to z, then aa to zz and so on."""
    return F.repeat(F.char(97 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def number_text(n: Column, fmt: Column) -> Column:
    """A number as its list format shows it; bullets and unknown formats of none have no text."""
    small = F.when(fmt.isin("lowerRoman", "upperRoman"), numeral(n)).when(fmt.isin("lowerLetter", "upperLetter"), letter(n)).otherwise(n.cast("string"))
    shown = F.when(fmt.startswith("upper"), F.upper(small)).otherwise(small)
    return F.when(fmt.isNull() | fmt.isin("bullet", "none"), F.lit("")).otherwise(shown)


#: Levels of a list.
LEVELS = 9


def number_blocks(df: DataFrame, group: str, order: str, key: str, first: int = 1) -> DataFrame:
    """(key, number) of list paragraphs (ilvl, fmt) of each group, in order; a level counts on until an item of a higher level."""
    rows = df.select(group, order, key, F.least(F.coalesce("ilvl", F.lit(0)), F.lit(LEVELS - 1)).alias("_level"), "fmt")
    until = Window.partitionBy(group).orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0)
    higher = F.array(*[F.sum((F.col("_level") < level).cast("long")).over(until) for level in range(LEVELS)])
    placed = rows.withColumn("_run", F.get(higher, F.col("_level")))
    n = F.row_number().over(Window.partitionBy(group, "_level", "_run").orderBy(order, key)) + (first - 1)
    return placed.withColumn("_n", n).select(key, number_text(F.col("_n"), F.col("fmt")).alias("number"))
