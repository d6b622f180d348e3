"""p9: pages of repeated keywords, lists of links or product tags.

Each text is read in windows of consecutive words. A window is list evidence if a few content words fill it, if links
take much of its room, if its words are hash tags, if prices and article numbers or breadcrumb marks are dense, or if
its function words stand next to each other as they do in no sentence. The list density of a page is the share of its
room in such windows. Beside it, the page's phrases (its shingles: every five words in a row, across clause ends) are
exploded and the distinct hosts of each phrase counted over the whole corpus; the stitched share is the part of a page's
phrases that other hosts have too, or that the page itself repeats. A page is spam if list density, raised by up to
STITCHED for stitched phrases, reaches half of the page. Stitched phrases alone make no spam, which departs from the
method: reports share most of their phrases with other hosts, and keyword pages few (figures in the README).

The corpus statistics cover every document. Only pages with some list density look their phrases up, as no page of less
than SPAM - STITCHED can reach the mark. Everything before the count of hosts runs on arrays: words are numbered by Arrow's dictionary
encoding and windows counted with numpy.

Defined results: null, empty and wordless texts are no spam; texts are read whole; a null host is one host; repeated
rows count once; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.encoding import LETTER, NUMBER, _groups, classes
from folioscope.plans.session import cut

#: Words of a window and of a phrase.
WINDOW, PHRASE = 40, 5
#: Share of a page in list windows that makes it spam; what stitched phrases can add; list density below which a page isn't looked at.
SPAM, STITCHED, LOOKED_AT = 0.5, 0.15, 0.3
#: Shares of a window's words, room or marks that make it list evidence.
FILLED, LINKED, TAGGED, PRICED, CRUMBS, SALAD = 0.28, 0.4, 0.3, 0.06, 0.12, 0.02
#: Words that a page needs for its function words to be judged.
SALAD_WORDS = 40

LINK = r"(?i)(?:https?://|www\.)[^\s<>\"')\]]+|[\pL\pN-]+(?:\.[\pL\pN-]+)*\.(?:test|invalid|example|com|org|net|info|biz|shop|online|site|store|xyz|ru|cn|top|club)\b(?:/[^\s<>\"')\]]*)?"
#: Words that repeat in the lists and clauses of reports and are no keywords.
REPORT_WORDS = ["recalling", "noting", "also", "this", "with", "that", "from", "recordando", "también", "tomando", "observando", "rappelant", "aussi", "notant", "dans", "pour", "para", "sont", "avec", "which"]
#: Articles, prepositions and conjunctions, and the pairs of them that sentences have.
FUNCTION = ["the", "of", "in", "on", "and", "de", "la", "les", "des", "los", "las", "el", "y", "et", "le", "en", "du"]
SENTENCE_PAIRS = [("of", "the"), ("in", "the"), ("on", "the"), ("and", "the"), ("and", "of"), ("and", "in"), ("and", "on"), ("de", "la"), ("de", "las"), ("de", "los"), ("de", "les"), ("en", "la"), ("en", "las"), ("en", "los"), ("en", "el"), ("et", "les"), ("et", "la"), ("et", "le"), ("et", "des"), ("et", "de"), ("et", "du"), ("et", "en"), ("y", "las"), ("y", "los"), ("y", "la"), ("y", "el"), ("y", "de"), ("y", "en"), ("de", "le"), ("de", "el")]
#: Money and article marks.
MONEY = ["usd", "eur", "gbp", "sku"]

LINK_MARK = 0x1
_SYMBOLS = {"price": [ord(c) for c in "$€£"], "crumb": [ord(c) for c in "»>"]}


def _per_text(texts: pa.StringArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For texts without nulls: list density of each, and the hashes of its phrases (with repeats) as (counts, values)."""
    n = len(texts)
    bare = pc.replace_substring_regex(texts, LINK, " \x01 ")
    removed = pc.subtract(pc.utf8_length(texts), pc.utf8_length(bare)).to_numpy(zero_copy_only=False).astype(np.int64)
    low = pc.utf8_lower(bare)
    at = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + n + 1]
    data = low.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])) if at[-1] > at[0] else pa.py_buffer(b"")
    points = np.frombuffer(data.to_pybytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(n), [np.zeros(n, np.int64), np.zeros(0, np.int64)]
    width = np.ones(len(points), np.int8)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    byte = np.zeros(len(points) + 1, np.int32)
    np.cumsum(width, out=byte[1:])
    edges = np.searchsorted(byte, at - at[0])
    kind = classes()[points]
    inside = (kind == LETTER) | (kind == NUMBER) | (points == LINK_MARK) | ((points >= 0x300) & (points < 0x370))
    new_text = np.zeros(len(points) + 1, bool)
    new_text[edges] = True
    before = np.concatenate([[False], inside[:-1]]) & ~new_text[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~new_text[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    m = len(start)
    if not m:
        return np.zeros(n), [np.zeros(n, np.int64), np.zeros(0, np.int64)]
    # Every other slice of the text between these places is a word.
    places = np.empty(2 * m + 1, np.int32)
    places[0:-1:2], places[1:-1:2], places[-1] = byte[start], byte[end], byte[-1]
    first = places[0]
    words = pa.StringArray.from_buffers(2 * m, pa.py_buffer((places).astype(np.int32)), data).take(pa.array(np.arange(0, 2 * m, 2, dtype=np.int32))).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    names = words.dictionary.to_pylist()
    size = np.fromiter(map(len, names), np.int64, len(names))
    alpha = np.fromiter((w[0].isalpha() for w in names), bool, len(names))
    content = alpha & (size >= 4) & ~np.isin(names, REPORT_WORDS)
    is_link = np.fromiter((w == "\x01" for w in names), bool, len(names))[code]
    money = np.isin(names, MONEY)[code]
    text_of = np.searchsorted(edges, start, "right") - 1
    first_word = np.searchsorted(text_of, np.arange(n))
    place = np.arange(m) - first_word[text_of]
    window = text_of * 0
    opens = place % WINDOW == 0
    window = np.cumsum(opens) - 1
    count = window[-1] + 1

    def per_window(values: np.ndarray) -> np.ndarray:
        return np.bincount(window, weights=values, minlength=count)

    letters = per_window(alpha[code])
    links = np.bincount(text_of, weights=is_link, minlength=n)
    link_room = np.where(links > 0, (removed + 3 * links) / np.maximum(links, 1), 0)
    room_words = np.where(is_link, 0, size[code] + 1)
    room_links = np.where(is_link, link_room[text_of], 0)
    room = per_window(room_words + room_links)
    # Words of a window that occur three times or more in it.
    of_content = np.flatnonzero(content[code])
    key, times = np.unique(window[of_content] * len(names) + code[of_content], return_counts=True)
    filled = np.bincount(key // len(names), weights=np.where(times >= 3, times, 0), minlength=count)
    before_word = np.where(start > 0, points[np.maximum(start - 1, 0)], 0)
    tagged = per_window((before_word == 0x23) & ~new_text[start])

    def marks(where: np.ndarray) -> np.ndarray:
        w = np.searchsorted(start, where, "right") - 1
        return np.bincount(window[w[w >= 0]], minlength=count)

    priced = marks(np.flatnonzero(np.isin(points, _SYMBOLS["price"]))) + per_window(money)
    double = np.flatnonzero((points[:-1] == 0x3A) & (points[1:] == 0x3A)) if len(points) > 1 else np.zeros(0, np.int64)
    crumbs = marks(np.flatnonzero(np.isin(points, _SYMBOLS["crumb"]))) + marks(double)
    tokens = np.bincount(window, minlength=count)
    listed = (filled >= FILLED * np.maximum(letters, 1)) & (letters >= 8)
    listed |= per_window(room_links) > LINKED * room
    listed |= tagged > TAGGED * tokens
    listed |= priced > PRICED * tokens
    listed |= crumbs > CRUMBS * tokens
    # Function words side by side, over the whole text.
    function = {w: i for i, w in enumerate(FUNCTION)}
    number = np.fromiter((function.get(w, -1) for w in names), np.int64, len(names))[code]
    odd = np.ones((len(FUNCTION), len(FUNCTION)), bool)
    for a, b in SENTENCE_PAIRS:
        odd[function[a], function[b]] = False
    pair = (number[:-1] >= 0) & (number[1:] >= 0) & (text_of[:-1] == text_of[1:])
    pair[pair] = odd[number[:-1][pair], number[1:][pair]]
    all_letters = np.bincount(text_of, weights=alpha[code], minlength=n)
    salad = (np.bincount(text_of[1:], weights=pair, minlength=n) > SALAD * all_letters) & (all_letters >= SALAD_WORDS)
    text_of_window = text_of[opens]
    total = np.bincount(text_of_window, weights=room, minlength=n)
    density = np.bincount(text_of_window, weights=np.where(listed, room, 0), minlength=n) / np.maximum(total, 1)
    density[salad] = 1.0
    # Phrases: every five words in a row of one text.
    phrase = np.flatnonzero(text_of[PHRASE - 1 :] == text_of[: max(0, m - PHRASE + 1)])
    hashes = pd.util.hash_array(np.array(names, object), categorize=False).astype(np.uint64)[code]
    value = np.zeros(len(phrase), np.uint64)
    for k in range(PHRASE):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[phrase + k]
        value ^= value >> np.uint64(29)
    return density, [np.bincount(text_of[phrase], minlength=n).astype(np.int64), value.view(np.int64)]


def page_features(df: DataFrame) -> DataFrame:
    """(doc_id, host, density, phrases array<long>) of rows (doc_id, host, text)."""
    def run(batches):
        for batch in batches:
            for start, texts in _groups(batch.column(2)):
                density, (counts, values) = _per_text(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, pa.int64()))
                rows = slice(start, start + len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array(density, pa.float64()), lists], names=["doc_id", "host", "density", "phrases"])

    return df.select("doc_id", F.xxhash64(F.coalesce("host", F.lit(""))).alias("host"), "text").mapInArrow(run, "doc_id long, host long, density double, phrases array<long>")


def spam_pages(df: DataFrame) -> DataFrame:
    """(doc_id, density, stitched, spam) of the pages with some list density; every other page is no spam."""
    pages = page_features(df)
    phrases = pages.select("host", F.explode(F.array_distinct("phrases")).alias("phrase"))
    # The least and the largest host tell whether a phrase has two, and combine before the shuffle.
    hosts = phrases.groupBy("phrase").agg(F.min("host").alias("_least"), F.max("host").alias("_most"))
    # Few pages have list density; kept once, they need no second reading of the corpus for their phrases and a third for their density.
    suspects = cut(pages.where(F.col("density") >= LOOKED_AT))
    own = suspects.select("doc_id", "host", F.explode("phrases").alias("phrase")).groupBy("doc_id", "host", "phrase").agg(F.count("*").alias("n"))
    elsewhere = own.join(hosts.where("_least <> _most"), "phrase", "left")
    stitched = elsewhere.groupBy("doc_id").agg((F.sum(F.when(F.col("_least").isNotNull() | (F.col("n") >= 3), F.col("n")).otherwise(0)) / F.sum("n")).alias("stitched"))
    judged = suspects.select("doc_id", "density").join(stitched, "doc_id", "left").na.fill(0.0, ["stitched"])
    return judged.withColumn("spam", F.col("density") + STITCHED * F.col("stitched") >= SPAM)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("host"), "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages(_pages(spark, sf)).where("spam").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages(_pages(spark, sf)).select("doc_id", F.round("density", 4).alias("density"), F.round("stitched", 4).alias("stitched"), "spam")


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores}
ORACLES: dict[str, str] = {}
