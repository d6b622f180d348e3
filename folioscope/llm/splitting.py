"""p5: splitting oversized texts at natural boundaries.

A text over the limit is cut along a hierarchy of separators: sections (a line that is a heading, or a form feed),
paragraphs, lines, sentences, words, characters. A part that still exceeds the limit is cut at the next finer level;
the parts are then packed greedily, in order, into pieces of at most `limit` code points. Each piece but the first
begins with the end of the piece before, at most `overlap` code points and as many as the next whole part leaves room
for, that starts at the coarsest boundary that lies there, or at any code point if none does.

Defined results: sizes are counted in code points without white space at either end; a text within the limit stays one
piece (index 0 of 1), untouched but for its outer white space; null and blank texts have no piece; a text without any
boundary is cut at the limit, never between a code point and a combining mark, joiner or variation selector after it
unless these alone fill a piece. Pieces lie in the text one after another, overlap apart, and lose nothing but white
space at cuts. Repeated and re-delivered rows count once per key; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 300

#: Boundaries from coarse to fine: each pattern ends where a new part may begin.
LEVELS = [
    re.compile(r"\f+|\n\s*\n(?=[^\n]{1,100}\n\s*\n)|\n(?=\s*(?:#{1,6} |(?:Section|Chapter|Annex|Appendix|Chapitre|Annexe|Capítulo|Anexo|Sección)\b[^\n]{0,100}\n))"),
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile("[\r\n\u2028\u2029]+\\s*"),
    re.compile(r"(?<=[.!?;:…؟۔।])[\"'”’»)\]]*\s+|(?<=[。！？；])[”’」』）]*\s*"),
    re.compile(r"\s+|(?<=[,、，])"),
]


def _inner(text: str, at: int) -> bool:
    """Whether a cut before text[at] would part a code point from what belongs to it."""
    c = text[at]
    return unicodedata.combining(c) > 0 or c in "\u200c\u200d" or "\ufe00" <= c <= "\ufe0f" or text[at - 1] == "\u200d"


def _cuts(text: str, start: int, end: int, level: int, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(place, level) of the cuts that bring text[start:end] into parts of at most limit, without those at its ends.

    Parts between boundaries may fill a piece; parts of single characters leave room for the overlap before them.
    """
    if end - start <= limit:
        return
    if level == len(LEVELS):
        at = start
        while end - at > limit - overlap:
            to = at + limit - overlap
            back = to
            while back > at + (limit - overlap) // 2 and _inner(text, back):
                back -= 1
            at = to if _inner(text, back) else back
            yield at, level
        return
    before = start
    for m in LEVELS[level].finditer(text, start, end):
        if before < m.end() < end:
            yield from _cuts(text, before, m.end(), level + 1, limit, overlap)
            yield m.end(), level
            before = m.end()
    yield from _cuts(text, before, end, level + 1, limit, overlap)


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece: text[start:end], of which text[start:fresh] repeats the piece before."""
    if text is None or not text.strip():
        return []
    first, last = len(text) - len(text.lstrip()), len(text.rstrip())
    if last - first <= limit:
        return [(first, first, last)]
    cuts = [*_cuts(text, first, last, 0, limit, overlap), (last, 0)]
    levels = dict(cuts)
    pieces, start, fresh, at, i = [], first, first, first, 0
    places = [c for c, _ in cuts]
    while i < len(places):
        if places[i] - start <= limit or at == fresh:
            at = places[i]
            i += 1
            continue
        pieces.append((start, fresh, at))
        start = fresh = at
        start = _overlap(text, at, min(overlap, limit - (places[i] - at)), levels, pieces[-1][1])
    pieces.append((start, fresh, at))
    out = []
    for a, b, c in pieces:
        while c > a and text[c - 1].isspace():
            c -= 1
        while a < b and text[a].isspace():
            a += 1
        out.append((a, b, c))
    return out


def _overlap(text: str, at: int, most: int, levels: dict[int, int], least: int) -> int:
    """Where a piece that follows a cut at `at` begins: the coarsest boundary at most `most` before it, the farthest of equals."""
    low = max(at - most, least)
    if low >= at:
        return at
    found = [(levels[p], p) for p in range(low, at) if p in levels]
    if found:
        return min(found)[1]
    for pattern in LEVELS[2:]:
        for m in pattern.finditer(text, low, at):
            if low < m.end() < at:
                return m.end()
    while low < at and _inner(text, low):
        low += 1
    return low


def split_texts(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_key, chunk_index, chunk_total, start, fresh, text) for rows (item_table, item_key, text)."""
    once = df.select("item_table", "item_key", "text").where("item_key is not null").dropDuplicates(["item_table", "item_key"])

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for table, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split(text, limit, overlap)
                for i, (a, b, c) in enumerate(pieces):
                    for column, value in zip(columns, (table, key, i, len(pieces), a, b, text[a:c])):
                        column.append(value)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_table", "item_key", "chunk_index", "chunk_total", "start", "fresh", "text"])

    return once.mapInArrow(run, "item_table string, item_key string, chunk_index int, chunk_total int, start int, fresh int, text string")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    paras = spark.read.parquet(f"{sf}/paras.parquet").select(F.lit("paras").alias("item_table"), F.col("para_id").cast("string").alias("item_key"), "text")
    pages = spark.read.parquet(f"{sf}/pdf_documents.parquet").select(F.lit("pdf_documents").alias("item_table"), F.col("chunk_id").alias("item_key"), "text")
    return paras.unionByName(pages)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that come out in more than one piece: those over the limit."""
    return split_texts(_rows(spark, sf)).where("chunk_index = 1").select("item_table", "item_key").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(_rows(spark, sf)).select("item_table", "item_key", "chunk_index", "chunk_total", "text")


def p5_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per text, how many pieces are over the limit, how many repeat more than the overlap, and whether the pieces without what they repeat hold the whole text, white space apart."""
    rows = _rows(spark, sf).where("item_key is not null").dropDuplicates(["item_table", "item_key"])
    fresh = F.expr("substring(text, fresh - start + 1)")
    pieces = split_texts(rows).groupBy("item_table", "item_key").agg(
        F.count_if(F.length("text") > LIMIT).alias("too_long"), F.count_if(F.col("fresh") - F.col("start") > OVERLAP).alias("repeat_too_much"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", fresh.alias("own")))), lambda x: x["own"]), "").alias("_whole"),
    )
    bare = [F.regexp_replace(c, BLANK, "") for c in ("_whole", "text")]
    return pieces.join(rows, ["item_table", "item_key"]).select("item_table", "item_key", "too_long", "repeat_too_much", (bare[0] == bare[1]).alias("whole"))


#: White space as Python strips it.
BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
QUERIES = {"p5_invariants": p5_invariants, "p5_found": p5_found, "p5_pieces": p5_pieces}
_TRIM = r"length(regexp_replace(text, '^[\s\v\x1c-\x1f\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\v\x1c-\x1f\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) > 2000"
ORACLES = {
    "p5_found": f"SELECT DISTINCT 'paras' AS item_table, CAST(para_id AS VARCHAR) AS item_key FROM paras WHERE {_TRIM} UNION SELECT DISTINCT 'pdf_documents', chunk_id FROM pdf_documents WHERE {_TRIM}",
    "p5_invariants": " UNION ".join(
        f"SELECT DISTINCT '{t}' AS item_table, CAST({k} AS VARCHAR) AS item_key, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS repeat_too_much, true AS whole FROM {t} WHERE {k} IS NOT NULL AND {_TRIM.replace('> 2000', '> 0')}"
        for t, k in (("paras", "para_id"), ("pdf_documents", "chunk_id"))
    ),
}
