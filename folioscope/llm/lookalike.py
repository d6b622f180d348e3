"""p2: one form for texts that look the same.

Texts that hold a code point with a mapping, a combining mark or odd spacing are exploded to positioned code points and
joined with a broadcast table of decompositions and look-alikes; each text's code points are then put in order, its
combining marks ordered by class and recomposed with their base, and the string rebuilt. All other texts are their own
form by construction of the table and are not exploded.

What is no difference: width (full-width and half-width forms), joining (ligatures, presentation forms, Roman numeral
and ellipsis characters), kinds of space, code points without any ink, composed or decomposed accents, the order of
marks of different classes, hyphens that differ in breaking only, and letters of other scripts drawn like a Latin one.
What stays a difference: case, accents, raised and lowered characters, quotes, dashes, and other letters.

Defined results: null stays null; an empty or blank text becomes empty; runs of spaces become one space and outer
spaces go; line feeds stay. Texts are treated whole. Repeated and re-delivered rows count once.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.session import cut

#: Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J"}
GREEK = {"ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
#: Hyphens that look like the hyphen of the keyboard.
HYPHENS = {"‐": "-", "‑": "-"}
LOOK_ALIKE = CYRILLIC | GREEK | HYPHENS
#: Code points without ink besides the format characters (category Cf).
NO_INK = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0]
#: Rows of one key that a task joins with the rows of the key; larger keys are salted.
HOT = 2000


def _points(c: str) -> list[str]:
    """The code points that one code point is compared by."""
    if ord(c) in NO_INK or unicodedata.category(c) == "Cf":
        return []
    if unicodedata.category(c) == "Zs" or c in "\t\v\f\r\x85\u2028\u2029":
        return [" "]
    if c in LOOK_ALIKE:
        return [LOOK_ALIKE[c]]
    parts = unicodedata.decomposition(c)
    if not parts or parts.startswith(("<super>", "<sub>")):
        return [c]
    return [y for x in parts.split() if not x.startswith("<") for y in _points(chr(int(x, 16)))]


@cache
def mapping() -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, its points with their combining classes) of every code point that does not stand for itself."""
    rows = []
    for n in range(0x30000):
        c = chr(n)
        # Hangul syllables stand for themselves; _hangul puts letters together to them.
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        points = _points(c)
        if points != [c] or unicodedata.combining(c):
            rows.append((c, [(p, unicodedata.combining(p)) for p in points]))
    return rows + [(chr(n), []) for n in range(0xE0000, 0xE0200) if n < 0xE0080 or n >= 0xE0100]


@cache
def compositions() -> dict[str, dict[str, str]]:
    """By mark, the code points that it composes with and what they compose to."""
    pairs: dict[str, dict[str, str]] = {}
    for n in range(0x30000):
        parts = unicodedata.decomposition(chr(n)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            base, mark = (chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", base + mark) == chr(n):
                pairs.setdefault(mark, {})[base] = chr(n)
    return pairs


def _stable(rows: list, pairs: dict[str, dict[str, str]]) -> set[str]:
    """Code points of the mapping that recompose to themselves when no mark follows."""
    def whole(points: list[str]) -> str:
        out = points[0]
        for p in points[1:]:
            out = pairs.get(p, {}).get(out, "")
        return out

    return {c for c, points in rows if len(points) > 1 and whole([p for p, _ in points]) == c}


@cache
def odd_pattern() -> str:
    """A pattern that finds a spacing or a code point for which a text must be exploded.

    It names the code points below U+2070 that stand for themselves, with ASCII first, as a class is tried range by range.
    """
    made = {c for c, _ in mapping()} - _stable(mapping(), compositions())
    ranges, start = [(0x20, 0x7E)], None
    for n in range(0xA0, 0x2071):
        plain = chr(n) not in made and not 0x300 <= n < 0x2010
        if plain and start is None:
            start = n
        if not plain and start is not None:
            ranges.append((start, n - 1))
            start = None
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]|  |^ | $"


def _compose(base: Column, marks: Column, pairs: Column) -> Column:
    """A base and its ordered marks, composed where a pair composes and no mark of the same class stands between."""
    def step(state: Column, mark: Column) -> Column:
        made = F.try_element_at(F.try_element_at(pairs, mark["c"]), state["base"])
        free = (state["rest"] == "") | (state["last"] < mark["ccc"])
        done = made.isNotNull() & free
        return F.struct(F.when(done, made).otherwise(state["base"]).alias("base"), F.when(done, state["rest"]).otherwise(F.concat(state["rest"], mark["c"])).alias("rest"), F.when(done, state["last"]).otherwise(mark["ccc"]).alias("last"))

    start = F.struct(base.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    return F.aggregate(marks, start, step, lambda s: F.concat(s["base"], s["rest"]))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rebuild(points: Column, pairs: Column) -> Column:
    """The string of ordered (c, ccc) points, cut before each point that is no mark; the marks of a part are ordered by class and recomposed."""
    n = F.size(points)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(points, i)["ccc"] == 0))

    def part(own: Column) -> Column:
        bare = F.get(own, F.lit(0))["ccc"] == 0
        marks = F.filter(F.transform(own, lambda p, i: F.struct(p["ccc"].alias("ccc"), i.alias("i"), p["c"].alias("c"))), lambda p: p["ccc"] > 0)
        return F.when(F.size(own) == 1, F.get(own, F.lit(0))["c"]).otherwise(_compose(F.when(bare, F.get(own, F.lit(0))["c"]).otherwise(F.lit("")), F.array_sort(marks), pairs))

    parts = _let(starts, lambda s: F.transform(s, lambda at, k: F.slice(points, at, F.coalesce(F.get(s, k + 1), n + 1) - at)))
    letters = F.when(F.exists(points, lambda p: p["ccc"] > 0), F.transform(parts, part)).otherwise(F.transform(points, lambda p: p["c"]))
    jamo = F.exists(points, lambda p: (p["c"] >= "\u1100") & (p["c"] < "\u1200"))
    return F.array_join(F.when(jamo, _let(letters, _hangul)).otherwise(letters), "")


def _hangul(letters: Column) -> Column:
    """Leading, vowel and trailing letters put together to syllables, by the arithmetic of their code points; a syllable without a trailing letter takes one that follows."""
    def number(i: Column, first: int, count: int) -> Column:
        n = F.ascii(F.coalesce(F.get(letters, i), F.lit(""))) - first
        return F.when((n >= 0) & (n < count), n)

    def bare(i: Column) -> Column:
        """Whether no mark stands between a letter and the next."""
        return F.length(F.get(letters, i)) == 1

    def marks(i: Column) -> Column:
        return F.substring(F.get(letters, i), F.lit(2), F.length(F.get(letters, i)))

    def lead(i: Column) -> Column:
        return F.when(bare(i), number(i, 0x1100, 19))

    def vowel(i: Column) -> Column:
        return number(i, 0x1161, 21)

    def trail(i: Column) -> Column:
        return F.when(number(i, 0x11A7, 28) > 0, number(i, 0x11A7, 28))

    def open_syllable(i: Column) -> Column:
        return F.when(bare(i) & (number(i, 0xAC00, 11172) % 28 == 0), number(i, 0xAC00, 11172))

    def place(c: Column, i: Column) -> Column:
        two = (lead(i) * 21 + vowel(i + 1)) * 28
        three = F.when(bare(i + 1), two + trail(i + 2))
        number_, last = F.coalesce(open_syllable(i) + trail(i + 1), three, two), F.when(three.isNotNull(), i + 2).otherwise(i + 1)
        made = F.concat(F.decode(F.unhex(F.hex(0xAC00 + number_)), "UTF-16BE"), marks(last))
        taken = (vowel(i).isNotNull() & lead(i - 1).isNotNull()) | (trail(i).isNotNull() & (open_syllable(i - 1).isNotNull() | (vowel(i - 1).isNotNull() & bare(i - 1) & lead(i - 2).isNotNull())))
        return F.when(number_.isNotNull(), made).when(taken, F.lit("")).otherwise(c)

    return F.transform(letters, place)


def forms(df: DataFrame, text: str = "text") -> DataFrame:
    """(text, form) of the distinct texts that may not be their own form; any other text is."""
    table = df.sparkSession.createDataFrame(mapping(), "c string, points array<struct<c:string,ccc:int>>")
    pair_map = F.from_json(F.lit(json.dumps(compositions())), "map<string,map<string,string>>")
    odd = df.select(F.col(text).alias("text")).where(F.col("text").rlike(odd_pattern())).distinct()
    odd = odd.withColumn("id", _name("text"))
    # The table has one row per code point that does not stand for itself, whatever the data.
    exploded = odd.select("id", F.posexplode(F.split("text", "")).alias("pos", "c")).join(F.broadcast(table), "c", "left")
    mapped = exploded.select("id", "pos", F.coalesce("points", F.array(F.struct("c", F.lit(0).alias("ccc")))).alias("points")).where(F.size("points") > 0)
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "points"))), lambda x: x["points"]))
    built = mapped.groupBy("id").agg(ordered.alias("points")).select("id", _rebuild(F.col("points"), pair_map).alias("form"))
    squeezed = F.trim(F.regexp_replace(F.coalesce("form", F.lit("")), " +", " "))
    return odd.join(built, "id", "left").select("text", squeezed.alias("form"))


def _name(text: str) -> Column:
    """What stands for a text where only equality counts: two hashes of 64 bits and the length."""
    return F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text), F.length(text))


def same_looking(df: DataFrame) -> DataFrame:
    """(kind, a_id, b_id): rows (kind, source_file, id, text) of one file with one form and different texts, a_id below b_id.

    Only forms that some text had to be brought to can have two texts, so only their rows are joined; keys with many rows
    are salted. Null texts are left out; a null source_file is a file of its own.
    """
    rows = df.where("text is not null and id is not null").withColumn("source_file", F.coalesce("source_file", F.lit("\0")))
    # One reading finds the texts that may not be their own form; the second needs no pattern, as a text that is another's form stands for itself.
    odd = cut(rows.where(F.col("text").rlike(odd_pattern())))
    made = forms(odd).withColumnRenamed("form", "_form")
    formed = cut(odd.join(made, "text").select("kind", "source_file", _name("_form").alias("form"), "id", _name("text").alias("text")).distinct())
    active = formed.select("kind", "source_file", "form").distinct()
    own = rows.select("kind", "source_file", _name("text").alias("form"), "id")
    plain = own.join(active, ["kind", "source_file", "form"], "left_semi").select("kind", "source_file", "form", "id", F.col("form").alias("text"))
    every = cut(formed.unionByName(plain).distinct())
    key = ["kind", "source_file", "form"]
    many = every.groupBy(*key).agg(F.count("*").alias("_n"), F.count_distinct("text").alias("_texts")).where("_texts > 1").withColumn("_salts", F.ceil(F.col("_n") / HOT).cast("int")).drop("_n", "_texts")
    keyed = cut(every.join(many, key))
    a = keyed.select(*key, F.col("id").alias("a_id"), F.col("text").alias("_a"), F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int").alias("_salt"))
    b = keyed.select(*key, F.col("id").alias("b_id"), F.col("text").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return a.join(b, [*key, "_salt"]).where("a_id < b_id and _a <> _b").select("kind", "a_id", "b_id").distinct()


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    spans = spark.read.parquet(f"{sf}/spans.parquet").select(F.lit("span").alias("kind"), "source_file", F.col("span_id").alias("id"), "text")
    blocks = spark.read.parquet(f"{sf}/blocks.parquet").select(F.lit("block").alias("kind"), "source_file", F.col("block_id").alias("id"), "text")
    return spans.unionByName(blocks)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_looking(_rows(spark, sf))


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's text in its one form."""
    rows = _rows(spark, sf)
    made = forms(rows)
    return rows.join(made, "text", "left").select("kind", "id", F.coalesce("form", "text").alias("form")).distinct()


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
ORACLES: dict[str, str] = {}
