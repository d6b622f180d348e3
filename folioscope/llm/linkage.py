"""p4: matching works across sources without keys.

Titles become q-gram bit vectors of fixed length. Pairs of records whose vectors differ in at most RADIUS bits are found
exactly by multi-index Hamming hashing: vectors are cut into chunks, of which close vectors share so many that two of
one group are equal, so an equality join on the pairs of chunks of each group finds them all; a population count
verifies. Years that are known must be near and are part of the key. Two searches at radius 0 stand beside it: equal DOIs, and titles of one year of which one begins as the other,
by pigeonhole segments, as a cut-off end leaves q-gram vectors far apart. Field-weighted Dice scores of the pairs (title,
author, year, DOI) become confidences by isotonic calibration against the pairs whose two DOIs agree or disagree, over
all such pairs. A pair is a match from CONFIDENT on, unless an exact check shows works that resemble each other: another
part, edition, reply or erratum, another year, other authors, a title that differs by more than misprints or a missing end.

Defined results: empty, null and unreadable attributes are unknown and neither speak for nor against a pair; records
without a readable title and DOI match nothing; a source matches every item key under which its work is held;
re-delivered rows count once; extra metadata keys are not read; empty tables give an empty result. A pair of titles
alone (no year, author or DOI on one side) matches only if no second work has that title.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.plans.session import cut

#: Bits of a vector's word, words of a vector, and bits by which close vectors may differ (two misprints and a little).
WIDTH, WORDS, RADIUS = 48, 8, 11
#: Chunks of a vector and groups of them, in each of which every two chunks make a key. CHUNKS - RADIUS is more than GROUPS.
CHUNKS, GROUPS = 16, 4
#: Letters of a title's segment, of a beginning, and for each of which a beginning may have one misprint. A beginning of
#: n letters, or of one less, has (n - 1) // SEGMENT segments, always more than its (n - 1) // MISPRINT misprints.
SEGMENT, BEGINNING, MISPRINT = 8, 24, 16
#: Weights of the fields' Dice scores, and the confidence of a match.
WEIGHTS = {"title": 4.0, "author": 2.0, "year": 2.0, "doi": 3.0}
CONFIDENT = 0.3
#: Metadata keys by attribute.
KEYS = {"title": ["title", "ref_title", "name"], "authors": ["authors", "creator", "by"], "year": ["year", "date", "issued"], "doi": ["doi", "identifier", "url"], "citation": ["citation"]}
#: What makes a title another work.
TAGS = re.compile(r"\b(part\s+(?:[0-9]+|[ivx]+)|vol(?:ume)?\s+[0-9]+|(?:second|third|fourth|revised|[0-9]+(?:nd|rd|th))\s+edition|erratum|corrigendum|addendum|a\s+reply|reply\s+to|comment\s+on)\b")
_YEAR = re.compile(r"(?<![0-9])(1[5-9]|20)[0-9]{2}(?![0-9])")
_DOI = re.compile(r"10\.[0-9]{4,9}/[^\s\"<>]+")
_CITATION = re.compile(r"^(?P<who>.*?)[\s.(]+(?:c|[A-Za-z]+ |[0-9]{1,2}/)?(?P<year>(?:1[5-9]|20)[0-9]{2})[a-z]?\)?[.,:]\s+(?P<rest>.*)$", re.S)
_AFTER_TITLE = re.compile(r"\.\s+(?=In: |[^.]{2,80}, [0-9]+, [0-9]+)")


def fold(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))


def read_doi(text: str | None) -> str | None:
    m = _DOI.search(re.sub(r"\s+", "", (text or "").lower()))
    return m.group().rstrip(".,;)") if m else None


def read_title(text: str | None) -> tuple[str, str, bool]:
    """Letters and digits of a title, its tags, and whether it is cut off."""
    f = fold(text).replace("&", " and ")
    return re.sub(r"[^a-z0-9]", "", f), "|".join(re.sub(r"\s+", " ", t) for t in TAGS.findall(f)), bool(re.search(r"(?:\.\.\.|…)\W*$", f))


def read_names(text: str | None) -> list[str]:
    """Surnames: the longest word of each name."""
    names = []
    for part in re.split(r"\s*(?:;|&|\band\b|\bet al\b\.?|,(?=\s*[^\W\d_]{2,}))\s*", text or ""):
        words = re.findall(r"[a-z]{2,}", re.sub(r"[^a-z ]", " ", fold(part)))
        if words:
            names.append(max(words, key=len))
    return names


def grams(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(len(text) - 1)]


def vector(parts: list[str], chunks: int) -> list[int]:
    """The bits of the parts' hashes, as chunks of WIDTH bits."""
    bits = np.zeros(chunks * WIDTH, np.uint8)
    if parts:
        bits[pd.util.hash_array(np.array(parts, object), categorize=False) % np.uint64(len(bits))] = 1
    padded = np.zeros((chunks, 64), np.uint8)
    padded[:, 64 - WIDTH :] = bits.reshape(chunks, WIDTH)
    return np.packbits(padded, axis=1).view(">u8").astype(np.int64).ravel().tolist()


COLUMNS = "id string, title string, tags string, cut_off boolean, names array<string>, year int, doi string, by_title array<long>"


def _row(key, title, names, year, doi) -> tuple:
    letters, tags, cut_off = read_title(title)
    m = _YEAR.search(year or "")
    y = int(m.group()) if m else None
    return (str(key), letters, tags, cut_off, names, y, doi, vector(grams(letters), WORDS) if letters else None)


def items(df: DataFrame) -> DataFrame:
    """Records of library items (item_key, title, creators, item_date, doi, url)."""
    def run(frames):
        for f in frames:
            rows = [_row(r.item_key, r.title, [n for c in (r.creators if r.creators is not None else []) for n in read_names(c)[:1]], r.item_date, read_doi(r.doi) or read_doi(r.url)) for r in f.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return df.select("item_key", "title", "creators", "item_date", "doi", "url").where("item_key is not null").dropDuplicates(["item_key"]).mapInPandas(run, COLUMNS)


def cited(df: DataFrame) -> DataFrame:
    """Records of cited sources (source_id, metadata)."""
    def read(m: dict) -> tuple:
        text = m.get("citation")
        if text and (g := _CITATION.match(text)):
            rest = g["rest"]
            return _AFTER_TITLE.split(rest)[0], read_names(g["who"]), g["year"], read_doi(rest)
        return m.get("title") or text, read_names(m.get("authors")), m.get("year"), read_doi(m.get("doi"))

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                title, names, year, doi = read({k: getattr(r, k) for k in KEYS if getattr(r, k)})
                rows.append(_row(r.source_id, title, names, year, doi))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    def first(keys: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.col("metadata")[k]), F.lit("")) for k in keys])

    return df.select("source_id", *[first(v).alias(k) for k, v in KEYS.items()]).where("source_id is not null").dropDuplicates(["source_id"]).mapInPandas(run, COLUMNS)


def _meet(x: DataFrame, y: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join that never sends a side through the driver.

    Records are estimated by the size of their files; the keys and vectors exploded from them take hundreds of times as much,
    so a side that seems small enough to broadcast can be larger than the driver.
    """
    return x.join(y.hint("merge"), on)


def _bits(n: int, word) -> Column:
    """Set bits over n chunks, spelled out chunk by chunk so that the sum is compiled."""
    return sum((F.bit_count(word(i)) for i in range(1, n)), F.bit_count(word(0)))


def _keys(code: str) -> Column:
    """The keys by which vectors can meet: per pair of chunks of one group, the pair's number and its bits.

    A vector has CHUNKS chunks in GROUPS groups. Of two vectors that differ in at most RADIUS bits, at most RADIUS chunks
    differ, so more chunks are equal than there are groups, and one group has two equal chunks.
    """
    width = WORDS * WIDTH // CHUNKS
    chunks = [_bits_at(code, i * width, width) for i in range(CHUNKS)]
    pairs = [(i, j) for i in range(CHUNKS) for j in range(i + 1, CHUNKS) if i % GROUPS == j % GROUPS]
    return F.array(*[F.struct(F.lit(n).alias("n"), F.shiftleft(chunks[i], width).bitwiseOR(chunks[j]).alias("bits")) for n, (i, j) in enumerate(pairs)])


def _bits_at(code: str, at: int, width: int) -> Column:
    """width bits of a vector, which lie within one of its words."""
    word, offset = divmod(at, WIDTH)
    return F.shiftrightunsigned(F.get(code, F.lit(word)), WIDTH - offset - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def close_pairs(a: DataFrame, b: DataFrame, code: str) -> DataFrame:
    """(id_a, id_b): all pairs of records whose vectors `code` differ in at most RADIUS bits and whose years, if both are known, differ by one at most.

    Records of a known year meet by key and year; those without one meet all others by key alone.
    """
    def keyed(rows: DataFrame, side: str, when: Column) -> DataFrame:
        each = rows.where(F.col(code).isNotNull()).select(F.col("id").alias(f"id_{side}"), F.col(code).alias(f"v_{side}"), when.alias("when"), _keys(code).alias("keys"))
        return each.select(f"id_{side}", f"v_{side}", F.explode("when").alias("when"), "keys").select(f"id_{side}", f"v_{side}", "when", F.explode("keys").alias("key")).select(f"id_{side}", f"v_{side}", "when", "key.*")

    year, none = F.col("year"), F.array(F.lit(-1))
    parts = [
        (keyed(a.where("year is not null"), "a", F.array(year - 1, year, year + 1)), keyed(b.where("year is not null"), "b", F.array(year))),
        (keyed(a.where("year is null"), "a", none), keyed(b, "b", none)),
        (keyed(a.where("year is not null"), "a", none), keyed(b.where("year is null"), "b", none)),
    ]
    distance = _bits(WORDS, lambda i: F.get("v_a", F.lit(i)).bitwiseXOR(F.get("v_b", F.lit(i))))
    return reduce(DataFrame.unionByName, [_meet(x, y, ["when", "n", "bits"]).where(distance <= RADIUS).select("id_a", "id_b") for x, y in parts]).distinct()


def _misprints(n: Column) -> Column:
    return F.floor((n - 1) / MISPRINT).cast("int")


def begins(x: Column, y: Column) -> Column:
    """Whether the shorter title is the beginning of the longer but for misprints; a letter too many or too few is one."""
    n = F.least(F.length(x), F.length(y))
    short, whole = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    edits = F.least(*[F.levenshtein(short, whole.substr(F.lit(1), n + d)) for d in (-1, 0, 1)])
    return (n >= BEGINNING) & (edits <= _misprints(n))


def same_beginnings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of records of one year whose titles begin alike.

    Misprints in the beginning leave one of its segments whole, which stands in the other title, moved by at most as many letters.
    """
    def placed(rows: DataFrame, side: str, at: Column) -> DataFrame:
        each = rows.where(f"length(title) >= {BEGINNING} and year is not null").select(F.col("id").alias(f"id_{side}"), F.col("title"), F.length("title").alias(f"n_{side}"), F.col("by_title").alias(f"v_{side}"), "year", F.explode(at).alias("place"))
        return each.select(f"id_{side}", f"n_{side}", f"v_{side}", "year", F.col("place.at").alias("at"), F.col("title").substr(F.col("place.from") + 1, F.lit(SEGMENT)).alias("part"))

    starts = F.sequence(F.lit(0), F.length("title") - SEGMENT, F.lit(SEGMENT))
    most = _misprints(F.length("title"))
    own = F.transform(starts, lambda p: F.struct(p.alias("at"), p.alias("from")))
    moved = F.flatten(F.transform(starts, lambda p: F.transform(F.sequence(F.greatest(p - most, F.lit(0)), p + most), lambda q: F.struct(p.alias("at"), q.alias("from")))))
    both = _meet(placed(a, "a", own), placed(b, "b", moved), ["year", "at", "part"])
    # A misprint takes two q-grams of the shorter title from the longer; all others stand in both, so their bits do. Titles are
    # only fetched for pairs whose bits agree so far.
    shorter = F.col("n_a") <= F.col("n_b")
    missing = _bits(WORDS, lambda i: F.when(shorter, F.get("v_a", F.lit(i)).bitwiseAND(F.bitwise_not(F.get("v_b", F.lit(i))))).otherwise(F.get("v_b", F.lit(i)).bitwiseAND(F.bitwise_not(F.get("v_a", F.lit(i))))))
    near = both.where(missing <= 2 * _misprints(F.least("n_a", "n_b"))).select("id_a", "id_b").distinct()
    full = _meet(_meet(near, a.select(F.col("id").alias("id_a"), F.col("title").alias("t_a")), "id_a"), b.select(F.col("id").alias("id_b"), F.col("title").alias("t_b")), "id_b")
    return full.where(begins(F.col("t_a"), F.col("t_b"))).select("id_a", "id_b")


def _dice(x: Column, y: Column) -> Column:
    """Dice score of two title vectors."""
    n = WORDS
    both = _bits(n, lambda i: F.get(x, F.lit(i)).bitwiseAND(F.get(y, F.lit(i))))
    return 2 * both / F.nullif(_bits(n, lambda i: F.get(x, F.lit(i))) + _bits(n, lambda i: F.get(y, F.lit(i))), F.lit(0))


def _gram_dice(x: str, y: str) -> Column:
    """Dice score of the distinct pairs of neighbouring letters of two strings."""
    def pairs(c: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, 2)))

    return 2 * F.size(F.array_intersect(pairs(x), pairs(y))) / (F.size(pairs(x)) + F.size(pairs(y)))


def scored(a: DataFrame, b: DataFrame) -> DataFrame:
    """Close pairs with the Dice score of each field (null if unknown on a side) and their weighted mean."""
    same_doi = _meet(a.where("doi is not null").select(F.col("id").alias("id_a"), "doi"), b.where("doi is not null").select(F.col("id").alias("id_b"), "doi"), "doi").select("id_a", "id_b")
    found = close_pairs(a, b, "by_title").unionByName(same_beginnings(a, b)).unionByName(same_doi)
    pairs = cut(found.distinct())
    sides = [rows.select(*[F.col(c).alias("id_" + s if c == "id" else f"{c}_{s}") for c in rows.columns]) for rows, s in ((a, "a"), (b, "b"))]
    full = _meet(_meet(pairs, sides[0], "id_a"), sides[1], "id_b")
    beginning = begins(F.col("title_a"), F.col("title_b"))
    names = F.size("names_a") * F.size("names_b") > 0
    n = F.least(F.size("names_a"), F.size("names_b"))

    def near(x: Column, y: Column) -> Column:
        return F.levenshtein(x, y) <= F.ceil(F.length(x) / 5)

    alike = F.size(F.filter("names_a", lambda x: F.exists("names_b", lambda y: near(x, y))))
    gap = F.abs(F.col("year_a") - F.col("year_b"))
    fields = full.withColumns({
        "begins": beginning,
        "title": F.when((F.col("title_a") != "") & (F.col("title_b") != ""), F.greatest(_dice(F.col("by_title_a"), F.col("by_title_b")), F.when(beginning, 0.9).otherwise(0.0))),
        "author": F.when(names, F.least(alike / n, F.lit(1.0))),
        "first_author": F.when(names, F.exists("names_b", lambda y: near(F.col("names_a")[0], y)) | F.exists("names_a", lambda x: near(x, F.col("names_b")[0]))),
        "edits": F.when((F.col("title_a") != "") & (F.col("title_b") != ""), F.levenshtein("title_a", "title_b")),
        "gap": gap,
        "year": F.when(gap.isNotNull(), F.when(gap == 0, 1.0).when(gap == 1, 0.6).otherwise(0.0)),
        # Equal DOIs have exactly 1 and no others do.
        "doi": F.when(F.col("doi_a").isNotNull() & F.col("doi_b").isNotNull(), F.when(F.col("doi_a") == F.col("doi_b"), 1.0).otherwise(F.least(_gram_dice("doi_a", "doi_b"), F.lit(0.99)))),
    })

    def mean(names: list[str]) -> Column:
        top = sum((F.coalesce(F.col(x) * WEIGHTS[x], F.lit(0.0)) for x in names), F.lit(0.0))
        return top / sum((F.when(F.col(x).isNotNull(), WEIGHTS[x]).otherwise(0.0) for x in names), F.lit(0.0))

    return fields.withColumns({"score": mean(list(WEIGHTS)), "_blind": mean(["title", "author", "year"])})


def isotonic(bins: list[tuple[int, float, float]]) -> list[tuple[int, float]]:
    """Pool adjacent violators over (bin, positives, all) in order of bins."""
    pools: list[list] = []
    for at, positive, total in sorted(bins):
        pools.append([[at], positive, total])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            ats, p, t = pools.pop()
            pools[-1] = [pools[-1][0] + ats, pools[-1][1] + p, pools[-1][2] + t]
    return [(at, p / t) for ats, p, t in pools for at in ats]


def calibrated(pairs: DataFrame) -> DataFrame:
    """Pairs with a confidence: the share of agreeing DOIs at the pair's score, made to rise with the score.

    The score without DOI is read against all pairs with two DOIs; a DOI that agrees or not then moves the pair's own score.
    """
    known = pairs.where("doi is not null and _blind is not null").groupBy(F.floor(F.col("_blind") * 100).cast("int").alias("bin")).agg(F.count_if(F.col("doi") == 1.0).alias("p"), F.count("*").alias("n"))
    bins = [(r.bin, r.p + 0.5, r.n + 1.0) for r in known.collect()]  # at most 101 rows
    have = {b for b, _, _ in bins}
    bins += [(b, 0.5 * (b >= 85), 0.5) for b in range(101) if b not in have]
    table = F.create_map(*[F.lit(x) for at, c in isotonic(bins) for x in (at, float(c))])
    return pairs.withColumn("confidence", F.coalesce(table[F.floor(F.col("score") * 100).cast("int")], F.lit(0.0)))


def match(library: DataFrame, sources: DataFrame) -> DataFrame:
    """(id_a, id_b, score, confidence, same): close pairs of records, and whether they are the same work."""
    a, b = cut(items(library)), cut(cited(sources))
    pairs = calibrated(cut(scored(a, b).drop("by_title_a", "by_title_b")))
    tags = (F.col("tags_a") == F.col("tags_b")) | ((F.col("cut_off_a") | F.col("cut_off_b")) & ((F.col("tags_a") == "") | (F.col("tags_b") == "")))
    year = F.coalesce(F.col("gap") <= 1, F.lit(True))
    author = F.coalesce(F.col("first_author"), F.lit(True))
    # A DOI that disagrees in an otherwise equal record is a misprint.
    agree = F.coalesce(F.col("gap") == 0, F.lit(False)) & F.coalesce(F.col("first_author"), F.lit(False))
    doi = F.coalesce((F.col("doi") == 1.0) | agree, F.lit(True))
    misprints = F.ceil(F.greatest(F.length("title_a"), F.length("title_b")) / 16) + 1
    unnamed = (F.col("cut_off_a") | F.col("cut_off_b")) & F.col("first_author").isNull() & F.coalesce(F.col("gap") == 0, F.lit(False)) & (F.least(F.length("title_a"), F.length("title_b")) >= 40)
    short = F.col("begins") & (agree | unnamed | F.coalesce(F.col("doi") == 1.0, F.lit(False)))
    titled = F.when(F.col("edits").isNull(), F.coalesce(F.col("doi") == 1.0, F.lit(False))).otherwise((F.col("edits") <= misprints) | short)
    # Years and authors that only one side states leave several editions possible.
    bare = F.col("gap").isNull() & F.coalesce(F.col("doi") != 1.0, F.lit(True))
    fits = pairs.withColumn("_fits", F.coalesce(tags & year & author & doi & titled & (F.col("confidence") >= CONFIDENT), F.lit(False)))
    years = F.size(F.collect_set(F.when(F.col("_fits") & bare, F.col("year_a"))).over(Window.partitionBy("id_b")))
    return fits.withColumn("same", F.col("_fits") & (~bare | (years <= 1))).select("id_a", "id_b", "score", "confidence", "same", "title_a", "title_b", "names_a", "names_b", "year_a", "year_b", "doi_a", "doi_b", "tags_a", "tags_b")


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf}/zotero.parquet"), spark.read.parquet(f"{sf}/sources.parquet").select("source_id", "metadata")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return match(*_inputs(spark, sf)).where("same").select(F.col("id_a").alias("item_key"), F.col("id_b").cast("long").alias("source_id")).distinct()


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All close pairs with their confidence."""
    rows = match(*_inputs(spark, sf))
    return rows.select(F.col("id_a").alias("item_key"), F.col("id_b").cast("long").alias("source_id"), F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"), "same")


def p4_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Per tenth of confidence, the close pairs whose DOIs are both known, the share of these that agree, and the pairs taken for the same work."""
    rows = match(*_inputs(spark, sf)).withColumn("tenth", F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int"))
    known = F.col("doi_a").isNotNull() & F.col("doi_b").isNotNull()
    return rows.groupBy("tenth").agg(F.count("*").alias("pairs"), F.count_if(known).alias("with_dois"), F.round(F.avg(F.when(known, (F.col("doi_a") == F.col("doi_b")).cast("double"))), 4).alias("share_agreeing"), F.count_if("same").alias("same_work"))


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_reliability": p4_reliability}
ORACLES: dict[str, str] = {}
