"""p3: sentence alignment between the two languages of a report.

1. Sentences of both languages that alone in their report hold the same number or name are taken as first pairs. Over
   these, log-likelihood ratios of word co-occurrence give a lexicon per pair of languages.
2. Sentences of one report, and merged spans (a sentence and the one that follows it, on either side), are scored by the
   weight of what they share (numbers, names, lexicon pairs) over the weight of all their words (weights are inverse
   sentence frequencies), raised a little for an equal paragraph number. A report's sentences meet in stretches, in
   arrays; only what scores above staying alone leaves the task.
3. Per connected group of candidates, sentences and spans of the largest total score are chosen by Hungarian
   assignment, where a sentence may stay alone at a null cost.

Order plays no part, so moved sentences are found; omissions stay alone.

Defined results: null, empty and wordless texts have no sentences and no pair; only blocks of kind para count; null
report_id or lang are left out; reports with one language give nothing; with more than two languages, English is paired
with each other one; re-delivered and repeated rows count once; ties are broken by the smaller ids.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.lookalike import LOOK_ALIKE
from folioscope.operators.graph import components
from folioscope.plans.session import cut

#: Least log-likelihood ratio and least association of a lexicon pair.
LLR, ASSOCIATION = 12.0, 0.15
#: Score that a sentence must reach to be better paired than alone; what equal paragraph numbers add; gain asked of a merged span.
NULL_COST, SAME_NUMBER, MERGE_GAIN = 0.38, 0.04, 0.04
#: Paragraphs of a report that one task scores against as many of the other language; how far apart the paragraphs of a merged span may be.
STRETCH, NEAR = 500, 2
#: Words up to which a vocabulary is sent to every executor; candidates of a bucket of connected groups.
BROADCAST_WORDS, BUCKET = 500_000, 1_000

_SENTENCE = re.compile(r"(?<=[.!?;])[\"'”’»)]*\s+(?=[\"'“‘«(]*[A-ZÀ-ÖØ-Þ0-9])")
_TOKEN = re.compile(r"[0-9]+(?:[.,\s][0-9]+)*|[^\W\d_]+", re.UNICODE)
_PLAIN = str.maketrans(LOOK_ALIKE)


def plain(text: str) -> str:
    """Text without the differences that cannot be seen, for comparison only."""
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf" and not "\ufe00" <= c <= "\ufe0f" and c != "\u034f")
    return unicodedata.normalize("NFC", text.translate(_PLAIN))


def sentences(text: str | None) -> list[str]:
    if not text or not text.strip():
        return []
    return [s for s in _SENTENCE.split(plain(text).strip()) if s.strip()]


def tokens(sentence: str) -> tuple[list[str], list[str]]:
    """Distinct words, and distinct anchors: numbers, and capitalised words not at the start."""
    words, anchors = [], []
    for i, m in enumerate(_TOKEN.finditer(sentence)):
        t = m.group()
        if t[0].isdigit():
            anchors.append(re.sub(r"[^0-9]", "", t) if re.search(r"[,\s.]\d{3}(?!\d)", t) else re.sub(r"[^0-9]", ".", t))
        elif i and t[0].isupper() and len(t) > 2:
            anchors.append("".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))
        elif len(t) > 1:
            words.append(t.lower())
    return list(dict.fromkeys(words)), list(dict.fromkeys(anchors))


def sentence_rows(blocks: DataFrame) -> DataFrame:
    """(report_id, lang, sid, block_id, seq, idx, nums, words, anchors) of the paragraphs' sentences; sid is unique."""
    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                for i, s in enumerate(sentences(r.text)):
                    words, anchors = tokens(s)
                    if words or anchors:
                        rows.append((r.report_id, r.lang, f"{r.block_id}:{i}", r.block_id, 0 if pd.isna(r.seq) else int(r.seq), i, r.nums, words, anchors))
            yield pd.DataFrame(rows, columns=["report_id", "lang", "sid", "block_id", "seq", "idx", "nums", "words", "anchors"])

    return blocks.mapInPandas(run, "report_id string, lang string, sid string, block_id long, seq int, idx int, nums array<string>, words array<string>, anchors array<string>")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences of the first language of each report (English if there is one) and those of the others."""
    first = rows.groupBy("report_id").agg(F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("lang"))), F.min("lang")).alias("_first"), F.count_distinct("lang").alias("_n")).where("_n > 1").drop("_n")
    both = rows.join(first, "report_id")
    return both.where("lang = _first").drop("_first"), both.where("lang <> _first").drop("_first")


def lexicon(left: DataFrame, right: DataFrame) -> DataFrame:
    """(la, lb, w, v, p): words of two languages that translate each other, with weights that add up to at most 1 per word."""
    def lone(rows: DataFrame, name: str) -> DataFrame:
        exploded = rows.select("report_id", F.col("lang").alias(f"l{name}"), F.col("sid").alias(name), F.explode("anchors").alias("anchor"))
        return exploded.groupBy("report_id", f"l{name}", "anchor").agg(F.count("*").alias("_n"), F.first(name).alias(name)).where("_n = 1").drop("_n")

    pairs = cut(lone(left, "a").join(lone(right, "b"), ["report_id", "anchor"]).select("la", "lb", "a", "b").distinct())
    total = pairs.groupBy("la", "lb").agg(F.count("*").alias("n"))

    def counted(rows: DataFrame, side: str, word: str) -> DataFrame:
        words = cut(pairs.join(rows.select(F.col("sid").alias(side), F.explode("words").alias(word)), side))
        return words.join(words.groupBy("la", "lb", word).agg(F.count("*").alias(f"n_{word}")).where(f"n_{word} > 1"), ["la", "lb", word])

    # A pair of words is associated by sqrt(least / most of the two counts) at most, so most pairs with a frequent word need no count.
    may = (F.col("n_w") >= ASSOCIATION**2 * F.col("n_v")) & (F.col("n_v") >= ASSOCIATION**2 * F.col("n_w"))
    met = counted(left, "a", "w").join(counted(right, "b", "v"), ["la", "lb", "a", "b"]).where(may)
    table = met.groupBy("la", "lb", "w", "v").agg(F.count("*").alias("n_wv"), F.first("n_w").alias("n_w"), F.first("n_v").alias("n_v")).where("n_wv > 1").join(total, ["la", "lb"])
    k = [F.col("n_wv"), F.col("n_w") - F.col("n_wv"), F.col("n_v") - F.col("n_wv"), F.col("n") - F.col("n_w") - F.col("n_v") + F.col("n_wv")]
    expected = [F.col("n_w") * F.col("n_v"), F.col("n_w") * (F.col("n") - F.col("n_v")), (F.col("n") - F.col("n_w")) * F.col("n_v"), (F.col("n") - F.col("n_w")) * (F.col("n") - F.col("n_v"))]
    ratio = sum((F.when(o > 0, o * F.log(o * F.col("n") / e)).otherwise(0.0) for o, e in zip(k, expected)), F.lit(0.0)) * 2
    found = table.withColumn("_llr", ratio).withColumn("a", F.col("n_wv") / F.sqrt(F.col("n_w") * F.col("n_v"))).where((F.col("_llr") >= LLR) & (F.col("a") >= ASSOCIATION) & (F.col("n_wv") * F.col("n") > F.col("n_w") * F.col("n_v")))
    # Weak associates of a word that has a strong one come from words that stand together.
    best = F.greatest(F.max("a").over(Window.partitionBy("la", "lb", "w")), F.max("a").over(Window.partitionBy("la", "lb", "v")))
    kept = found.withColumn("_best", best).where("a >= 0.5 * _best")
    share = F.greatest(F.sum("a").over(Window.partitionBy("la", "lb", "w")), F.sum("a").over(Window.partitionBy("la", "lb", "v")), F.lit(1.0))
    return kept.withColumn("p", F.col("a") / share).select("la", "lb", "w", "v", "p")


def _small(df: DataFrame) -> DataFrame:
    """A vocabulary table, sent to every executor if it has few rows; df is written, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_WORDS else df


def weighed(left: DataFrame, right: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sentences of both sides with size (weight of all words) and the terms by which they can meet.

    Terms are three arrays (key, weight, p), the weight being p times the word's own; a left word's terms are its
    translations, an anchor's itself.
    """
    def idf_of(rows: DataFrame) -> DataFrame:
        # An anchor is marked, so that it never meets a word.
        every = rows.select("lang", F.explode(F.concat("words", F.transform("anchors", lambda x: F.concat(F.lit("\1"), x)))).alias("t"))
        n = rows.groupBy("lang").agg(F.count("*").alias("_n"))
        return every.groupBy("lang", "t").agg(F.count("*").alias("_f")).join(n, "lang").select("lang", "t", F.log((F.col("_n") + 1) / F.col("_f")).alias("idf"))

    def gathered(rows: DataFrame, words: DataFrame, terms, by: list[str]) -> DataFrame:
        each = rows.select("sid", *by, F.explode(F.concat("words", F.transform("anchors", lambda x: F.concat(F.lit("\1"), x)))).alias("t")).join(words, [*by, "t"])
        sums = each.groupBy("sid", *by).agg(F.sum("idf").alias("size"), F.flatten(F.collect_list(terms)).alias("terms"))
        return rows.select("report_id", *by, "sid", "block_id", "seq", "idx", "nums").join(sums, ["sid", *by]).select("*", *[F.col(f"terms.{x}") for x in ("key", "weight", "p")]).drop("terms")

    def term(key, weight, p):
        return F.struct(F.xxhash64(key).alias("key"), weight.alias("weight"), p.alias("p"))

    langs = right.select("report_id", F.col("lang").alias("lb")).distinct()
    to = pairs.groupBy(F.col("la").alias("lang"), "lb", F.col("w").alias("t")).agg(F.collect_list(F.struct("v", "p")).alias("to"))
    a = left.join(langs, "report_id")
    words_a = _small(cut(idf_of(left).join(a.select("lang", "lb").distinct(), "lang").join(to, ["lang", "lb", "t"], "left")))
    own = F.when(F.col("t").startswith("\1"), F.array(term(F.col("t"), F.col("idf"), F.lit(1.0))))
    translated = F.transform("to", lambda x: term(x["v"], x["p"] * F.col("idf"), x["p"]))
    one = F.array(term(F.col("t"), F.col("idf"), F.lit(1.0)))
    sides = gathered(a, words_a, F.coalesce(own, translated, F.array().cast(TERMS)), ["lang", "lb"]).drop("lang")
    return sides, gathered(right, _small(cut(idf_of(right))), one, ["lang"]).withColumnRenamed("lang", "lb")


TERMS = "array<struct<key:bigint,weight:double,p:double>>"
CANDIDATE = "report_id string, lb string, a string, b string, a2 string, b2 string, block_a long, block_b long, block_a2 long, block_b2 long, score double"
PAIR = [c.split()[0] for c in CANDIDATE.split(", ")]
TEXTS = {c.split()[0] for c in CANDIDATE.split(", ") if c.endswith("string")}


def _blocked(mine: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
    """Sentences in stretches of STRETCH paragraphs, with the few before each, once for each stretch of the other side.

    So no task gets more than a stretch of either side, however long a report is, and every two sentences meet.
    """
    at = F.floor(F.col("seq") / STRETCH).cast("int")
    next_too = F.when(F.col("seq") % STRETCH >= STRETCH - NEAR, F.array(at, at + 1)).otherwise(F.array(at))
    stretches = others.select("report_id", "lb", at.alias(other)).distinct()
    return mine.withColumn(own, F.explode(next_too)).join(stretches, ["report_id", "lb"])


def _arrays(side: pa.Table) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences in reading order by column, their sizes, and row, key, weight and p of all their terms."""
    side = side.sort_by([("seq", "ascending"), ("idx", "ascending"), ("sid", "ascending")]).combine_chunks()
    key, weight, p = (side[c].combine_chunks() for c in ("key", "weight", "p"))
    rows = np.repeat(np.arange(len(side)), pc.list_value_length(key).to_numpy(zero_copy_only=False))
    texts = {c: side[c].to_pylist() for c in ("sid", "block_id", "nums", "seq")}
    return texts, side["size"].to_numpy(), rows, *(x.flatten().to_numpy(zero_copy_only=False) for x in (key, weight, p))


def score_group(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sentence pairs and merged spans (a sentence and the next one, on one side) of two stretches that score above staying alone."""
    schema = pa.schema([(c, pa.string() if c in TEXTS else pa.float64() if c == "score" else pa.int64()) for c in PAIR])
    if not len(left) or not len(right):
        return schema.empty_table()
    report, lang = left["report_id"][0].as_py(), left["lb"][0].as_py()
    left, size_a, ra, ka, wa, pa_ = _arrays(left)
    right, size_b, rb, kb, wb, _ = _arrays(right)
    n, m = len(size_a), len(size_b)
    order = np.argsort(kb, kind="stable")
    kb, rb, wb = kb[order], rb[order], wb[order]
    first, last = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
    times = last - first
    got = np.zeros(n * m)
    # Terms meet a part at a time, so that frequent words need no more room than the result.
    for part in np.array_split(np.arange(len(ka)), max(1, int(times.sum() // 2_000_000))):
        t = times[part]
        mine = np.repeat(part, t)
        theirs = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(first[part], t)
        got += np.bincount(ra[mine] * m + rb[theirs], weights=wa[mine] + pa_[mine] * wb[theirs], minlength=n * m)
    got = got.reshape(n, m)

    def numbered(score: np.ndarray) -> np.ndarray:
        """Scores raised where a number of both paragraphs is equal; only where that can matter."""
        for i, j in zip(*np.nonzero(score > NULL_COST - SAME_NUMBER)):
            if not set(left["nums"][i]).isdisjoint(right["nums"][j]):
                score[i, j] += SAME_NUMBER
        return score

    single = numbered(got / (size_a[:, None] + size_b))
    found = [(i, j, -1, -1, single[i, j]) for i, j in zip(*np.nonzero(single > NULL_COST))]

    def spans(seq: list[int], got: np.ndarray, mine: np.ndarray, other: np.ndarray, one: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, partner, score) of merged spans that beat both their sentences."""
        if len(seq) < 2:
            return []
        near = np.diff(seq) <= NEAR
        score = (got[:-1] + got[1:]) / ((mine[:-1] + mine[1:])[:, None] + other)
        alone = np.maximum(one[:-1], one[1:])
        fits = near[:, None] & (score > NULL_COST - SAME_NUMBER) & (score >= alone + MERGE_GAIN - SAME_NUMBER)
        for i, j in zip(*np.nonzero(fits)):
            score[i, j] += SAME_NUMBER * (alone[i, j] > max(got[i, j] / (mine[i] + other[j]), got[i + 1, j] / (mine[i + 1] + other[j])) + SAME_NUMBER / 2)
        return [(i, j, score[i, j]) for i, j in zip(*np.nonzero(fits & (score > NULL_COST) & (score >= alone + MERGE_GAIN)))]

    found += [(i, j, i + 1, -1, s) if single[i, j] >= single[i + 1, j] else (i + 1, j, i, -1, s) for i, j, s in spans(left["seq"], got, size_a, size_b, single)]
    found += [(i, j, -1, j + 1, s) if single[i, j] >= single[i, j + 1] else (i, j + 1, -1, j, s) for j, i, s in spans(right["seq"], got.T, size_b, size_a, single.T)]

    def pick(side: dict[str, list], column: str, at: int) -> list:
        return [side[column][f[at]] if f[at] >= 0 else None for f in found]

    columns = {"report_id": [report] * len(found), "lb": [lang] * len(found), "score": [float(f[4]) for f in found]}
    for name, side, at in (("a", left, 0), ("b", right, 1), ("a2", left, 2), ("b2", right, 3)):
        columns |= {name: pick(side, "sid", at), f"block_{name}": pick(side, "block_id", at)}
    return pa.table(columns, schema=schema)


def candidates(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """CANDIDATE rows: sentence pairs of a report, and merged spans (a with a2, or b with b2), that score above staying alone."""
    a, b = weighed(left, right, pairs)
    keys = ["report_id", "lb", "_sa", "_sb"]
    a, b = _blocked(a, b, "_sa", "_sb"), _blocked(b, a, "_sb", "_sa")
    # Both come from one table of sentences; new names for one side tell them apart.
    b = b.toDF(*b.columns)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(score_group, CANDIDATE).distinct()


def hungarian(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total weight; a pair is only made where its weight is positive."""
    n, m = weight.shape
    if n > m:
        return [(r, c) for c, r in hungarian(weight.T)]
    # A column of its own for each row stands for staying alone.
    cost = np.hstack([-weight, np.zeros((n, n))])
    width = cost.shape[1]
    u, v, match = np.zeros(n + 1), np.zeros(width + 1), np.full(width + 1, n)
    for i in range(n):
        match[width] = i
        column, least, way, used = width, np.full(width, np.inf), np.full(width, width), np.zeros(width + 1, bool)
        while True:
            used[column] = True
            row = match[column]
            free = ~used[:width]
            now = cost[row] - u[row] - v[:width]
            better = free & (now < least)
            least[better], way[better] = now[better], column
            k = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[k]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            column = k
            if match[column] == n:
                break
        while column != width:
            match[column] = match[way[column]]
            column = way[column]
    return [(int(match[c]), c) for c in range(m) if match[c] < n and weight[match[c], c] > 0]


def solve(rows: list[tuple]) -> list[int]:
    """Which rows (a, b, a2, b2, score) of a connected group have the largest total score over staying alone, each sentence in one at most.

    A merged span stands for its pair where it scores better; if the sentence merged is better paired itself, the span
    is taken back and the assignment made again.
    """
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][4], rows[i][0], rows[i][1]))
    at_a, at_b = ({x: i for i, x in enumerate(sorted({r[side] for r in rows}))} for side in (0, 1))
    while True:
        best: dict[tuple[int, int], int] = {}
        for i in order:
            best.setdefault((at_a[rows[i][0]], at_b[rows[i][1]]), i)
        weight = np.zeros((len(at_a), len(at_b)))
        for place, i in best.items():
            weight[place] = rows[i][4] - NULL_COST
        chosen = [best[place] for place in hungarian(weight)]
        taken = {x for i in chosen for x in rows[i][:2]}
        merged = [x for i in chosen for x in rows[i][2:4] if x is not None]
        clash = [i for i in chosen if any(x is not None and (x in taken or merged.count(x) > 1) for x in rows[i][2:4])]
        if not clash:
            return chosen
        order.remove(min(clash, key=lambda i: (rows[i][4], rows[i][:2])))


def solve_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """solve() for each component of a frame."""
    frame = frame.sort_values("component", kind="stable").reset_index(drop=True)
    whole = frame[["a", "b", "a2", "b2"]].astype(object)
    rows = list(zip(whole.a, whole.b, whole.a2.where(whole.a2.notna(), None), whole.b2.where(whole.b2.notna(), None), frame.score))
    edges = np.flatnonzero(np.concatenate([[True], (frame.component.to_numpy()[1:] != frame.component.to_numpy()[:-1]), [True]])) if len(frame) else [0]
    kept = [start + i for start, end in zip(edges, edges[1:]) for i in solve(rows[start:end])]
    return frame.iloc[kept][PAIR].astype({c: object for c in PAIR if c != "score"})


def assigned(pairs: DataFrame) -> DataFrame:
    """The candidates chosen: those that share no sentence with another at once, the others per connected group."""
    ends = F.array_compact(F.array("a", "b", "a2", "b2"))
    each = pairs.select("report_id", "lb", "a", "b", F.explode(ends).alias("_s"))
    often = each.groupBy("report_id", "lb", "_s").agg(F.count("*").alias("_n")).where("_n > 1")
    tied = cut(pairs.join(each.join(often, ["report_id", "lb", "_s"]).select("report_id", "lb", "a", "b").distinct(), ["report_id", "lb", "a", "b"], "left_semi"))
    free = pairs.join(tied.select("report_id", "lb", "a", "b").distinct(), ["report_id", "lb", "a", "b"], "left_anti")
    name = lambda c: F.concat_ws("\1", "lb", c)
    links = tied.select(name("a").alias("a"), F.explode(F.array_compact(F.array("b", "a2", "b2"))).alias("_b"), "lb").select("a", name("_b").alias("b"))
    grouped = tied.join(components(links).withColumnRenamed("id", "_a"), F.col("_a") == name("a")).drop("_a")
    # Many small groups share a task; a group is never split.
    buckets = 1 + tied.count() // BUCKET
    return free.unionByName(grouped.withColumn("_bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("_bucket").applyInPandas(solve_groups, CANDIDATE))


def align(blocks: DataFrame) -> DataFrame:
    """(report_id, lb, a, b, block_a, block_b, score) of the aligned sentences of blocks (report_id, lang, block_id, seq, nums, text); a merged span gives a row per sentence."""
    rows = cut(sentence_rows(blocks.where("report_id is not null and lang is not null and block_id is not null and text is not null").dropDuplicates(["block_id"])))
    left, right = _sides(rows)
    chosen = cut(assigned(cut(candidates(left, right, cut(lexicon(left, right))))))
    span = chosen.where("a2 is not null or b2 is not null").withColumns({x: F.coalesce(x.replace("_a", "_a2").replace("_b", "_b2") if "_" in x else x + "2", x) for x in ("a", "b", "block_a", "block_b")})
    return chosen.unionByName(span).select("report_id", "lb", "a", "b", "block_a", "block_b", "score")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs with their numbers: as stored, as shown, and that of the node made from the block, letters and digits only."""
    blocks = spark.read.parquet(f"{sf}/blocks.parquet").where("kind = 'para'").select("report_id", "lang", "block_id", "seq", "num", "display", "text")
    nodes = spark.read.parquet(f"{sf}/nodes.parquet").where("block_id is not null").select("block_id", F.col("num").alias("_node")).groupBy("block_id").agg(F.max("_node").alias("_node"))
    plain = [F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) for c in ("num", "display", "_node")]
    nums = F.array_distinct(F.filter(F.array(*plain), lambda x: x.isNotNull() & (x != "")))
    return blocks.join(nodes, "block_id", "left").select("report_id", "lang", "block_id", "seq", nums.alias("nums"), "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = align(_blocks(spark, sf))
    return found.select(F.least("block_a", "block_b").alias("a_id"), F.greatest("block_a", "block_b").alias("b_id")).distinct()


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The aligned sentences (block_id:sentence) with their score."""
    return align(_blocks(spark, sf)).select("report_id", "lb", "a", "b", F.round("score", 4).alias("score"))


QUERIES = {"p3_found": p3_found, "p3_sentences": p3_sentences}
ORACLES: dict[str, str] = {}
