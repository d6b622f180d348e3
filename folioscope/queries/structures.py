"""Structured parts of texts: tables, lists of people, names, JSON and graph files."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import fuzzy
from folioscope.queries import documents as D
from folioscope.queries.relational import typed
from folioscope.sources import markup
from folioscope.sources.tables import first_delivery, table


def table_scan(spark, sf):
    """Cells of the pipe tables in texts."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line")).where("line like '% | %'")
    return lines.select("doc_id", "row", F.posexplode(F.split("line", r" \| ")).alias("col", "cell"))


def people_lists(spark, sf):
    """Names and roles of the participants that a text lists."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    entries = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\. [^\n,]+, [^\n(]+\([a-z-]+\))"), 1)).alias("entry"))
    return entries.select("doc_id", F.regexp_extract("entry", r"^(\p{Lu}\. [^,]+),", 1).alias("name"), F.regexp_extract("entry", r"\(([a-z-]+)\)$", 1).alias("role")).distinct()


def elected_chairs(spark, sf):
    return people_lists(spark, sf).where("role = 'co-chair'").select("name").distinct()


def split_people(spark, sf):
    """The people of an author field, whatever separates them."""
    field = F.coalesce(*[F.col("metadata")[k] for k in ("authors", "creator", "by")])
    rows = table(spark, sf, "sources", ["source_id", "metadata"]).select("source_id", field.alias("who")).where("who is not null and who <> ''").distinct()
    parts = F.split("who", r" and |; | & ")
    return rows.select("source_id", F.posexplode(parts).alias("place", "person"))


def person_fuzzy(spark, sf):
    """Surnames of six letters or more that differ by one edit, wherever it is."""
    names = table(spark, sf, "zotero", ["creators"]).select(F.explode(F.transform("creators", T.fold)).alias("name")).where("length(name) >= 6")
    return fuzzy.one_edit_apart(names, names).where("word < close").withColumnRenamed("word", "name")


def close_match(spark, sf):
    """The three labels most like each label, from three quarters on."""
    labels = table(spark, sf, "thesaurus", ["canon_id", "pref_label"])
    sizes = [labels.select(F.col("canon_id").alias(c), F.length("pref_label").alias(f"_{c}")) for c in ("id", "other")]
    pairs = fuzzy.alike(labels, 0.75).join(sizes[0], "id").join(sizes[1], "other").withColumn("_ratio", F.round(1 - F.col("edits") / F.greatest("_id", "_other"), 6))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_ratio"), "other"))
    return pairs.withColumn("place", place).where("place <= 3").select(F.col("id").alias("canon_id"), "other", "place")


def spelling_vote(spark, sf):
    """Words of titles that stand only once, with the usual word one edit away."""
    words = table(spark, sf, "zotero", ["title"]).select(F.explode(F.split(F.lower("title"), " ")).alias("w")).where("length(w) >= 8").groupBy("w").agg(F.count("*").alias("n"))
    near = fuzzy.one_edit_apart(words.where("n = 1").select("w"), words.where("n >= 5").select("w")).join(words.withColumnRenamed("w", "close"), "close")
    return near.groupBy(F.col("word").alias("rare")).agg(F.min_by("close", F.struct(-F.col("n"), F.col("close"))).alias("usual"))


def json_scan(spark, sf):
    props = table(spark, sf, "events", ["event_id", "props"])
    return props.select("event_id", F.get_json_object("props", "$.k").alias("k"))


def namespaces(spark, sf):
    """The shortest prefix that holds all URIs of the list."""
    uris = table(spark, sf, "thesaurus", ["uri"]).select(F.regexp_extract("uri", "^(.*/)[^/]+$", 1).alias("ns"))
    return uris.groupBy("ns").agg(F.count("*").alias("n")).agg(F.min_by("ns", F.length("ns")).alias("ns"))


def scalar_metadata(spark, sf):
    """How often each metadata key is set and how often it is no plain number."""
    rows = table(spark, sf, "sources", ["source_id", "metadata"]).select(F.explode("metadata").alias("key", "value")).where("value is not null")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("value").try_cast("double").isNull()).alias("not_numeric"))


def label_language(spark, sf):
    """Labels of the graph files without a language or in English."""
    t = markup.parse_triples(D._turtle(spark, sf)).where("p like '%Label' and (o_lang is null or o_lang = 'en')")
    return t.groupBy(F.regexp_extract("p", "#(.*)$", 1).alias("property")).agg(F.count("*").alias("n"))


def standalone(spark, sf):
    """Texts of documents that no paragraph, table or note holds."""
    rows = markup.parse_akn(D._akn_files(spark, sf)).where("kind = 'standalone_p'")
    return rows.groupBy("source_file").agg(F.count("*").alias("n"))


def glossary(spark, sf):
    """At most six concepts of a text, then those with a definition."""
    hits = D._mentions(spark, sf)
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("text_id").orderBy("uri"))).where("n <= 6")
    return ranked.join(table(spark, sf, "thesaurus", ["uri", "definition"]).where("definition is not null"), "uri").select("text_id", "uri", "definition")


def greedy_pairing(spark, sf):
    """Headings of a report's two languages paired greedily by matching blocks, from 0.6 on, in order."""
    rows = first_delivery(table(spark, sf, "blocks", ["block_id", "report_id", "lang", "kind", "seq", "text", "loaded_at"]), "block_id").where("kind = 'heading' and text is not null")

    def pair(f: pd.DataFrame) -> pd.DataFrame:
        left, right, out = f[f.lang == "en"].sort_values("seq"), f[f.lang != "en"].sort_values("seq"), []
        used: set[int] = set()
        for a in left.itertuples():
            scored = [(difflib.SequenceMatcher(None, a.text.lower(), b.text.lower(), False).ratio(), -b.seq, b.block_id) for b in right.itertuples() if b.block_id not in used]
            if scored and max(scored)[0] >= 0.6:
                ratio, _, other = max(scored)
                used.add(other)
                out.append((a.block_id, other, round(ratio, 6)))
        return pd.DataFrame(out, columns=["block_id", "paired", "ratio"])

    return rows.select("report_id", "lang", "seq", "block_id", "text").groupBy("report_id").applyInPandas(pair, "block_id long, paired long, ratio double")


def akn_write(spark, sf):
    """Each report written as a document."""
    return D._akn_files(spark, sf).select("source_file", F.length("content").alias("size"), F.md5("content").alias("hash"))


def turtle_write(spark, sf):
    return D._turtle(spark, sf).select("source_file", F.regexp_count("content", F.lit("skos:prefLabel")).alias("concepts"))


QUERIES = {
    "SRC24_table_scan": table_scan, "STR25_people_lists": people_lists, "AGG18_elected_chairs": elected_chairs, "STR37_split_people": split_people, "JOIN27_person_fuzzy": person_fuzzy, "JOIN32_close_match": close_match, "AGG29_spelling_vote": spelling_vote, "SRC17_json_scan": json_scan, "SRC06_namespace_discovery": namespaces,
    "FLT09_scalar_metadata": scalar_metadata, "FLT22_label_language": label_language, "FLT16_standalone_only": standalone, "RTE13_glossary": glossary, "JOIN33_greedy_pairing": greedy_pairing, "SNK08_akn_write": akn_write, "SNK07_turtle_write": turtle_write,
}
_PEOPLE = "p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\p{Lu}\\. [^\\n,]+, [^\\n(]+\\([a-z-]+\\))', 1)) AS entry FROM documents), q AS (SELECT DISTINCT doc_id, regexp_extract(entry, '^(\\p{Lu}\\. [^,]+),', 1) AS name, regexp_extract(entry, '\\(([a-z-]+)\\)$', 1) AS role FROM p)"
ORACLES = {
    "SRC24_table_scan": "SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(unnest(range(0, len(string_split(line, ' | ')))) AS INTEGER) AS col, unnest(string_split(line, ' | ')) AS cell FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS row, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line LIKE '% | %'",
    "STR25_people_lists": f"WITH {_PEOPLE} SELECT * FROM q",
    "AGG18_elected_chairs": f"WITH {_PEOPLE} SELECT DISTINCT name FROM q WHERE role = 'co-chair'",
    "STR37_split_people": "SELECT source_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS place, unnest(s) AS person FROM (SELECT DISTINCT source_id, string_split_regex(coalesce(metadata['authors'], metadata['creator'], metadata['by']), ' and |; | & ') AS s FROM sources WHERE coalesce(metadata['authors'], metadata['creator'], metadata['by']) <> '')",
    "JOIN27_person_fuzzy": "WITH n AS (SELECT DISTINCT strip_accents(lower(c)) AS name FROM (SELECT unnest(creators) AS c FROM zotero) WHERE length(c) >= 6) SELECT a.name, b.name AS close FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 1 AND levenshtein(a.name, b.name) <= 1",
    "JOIN32_close_match": "WITH p AS (SELECT a.canon_id, b.canon_id AS other, round(1 - levenshtein(a.pref_label, b.pref_label) / greatest(length(a.pref_label), length(b.pref_label)), 6) AS ratio FROM thesaurus a JOIN thesaurus b ON a.canon_id <> b.canon_id) SELECT canon_id, other, row_number() OVER (PARTITION BY canon_id ORDER BY ratio DESC, other) AS place FROM p WHERE ratio >= 0.75 QUALIFY place <= 3",
    "AGG29_spelling_vote": "WITH s AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(title), ' ')) AS w FROM zotero) WHERE length(w) >= 8 GROUP BY w) SELECT a.w AS rare, arg_min(b.w, (-b.n, b.w)) AS usual FROM s a JOIN s b ON a.n = 1 AND b.n >= 5 AND a.w <> b.w AND levenshtein(a.w, b.w) = 1 GROUP BY a.w",
    "SRC17_json_scan": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "SRC06_namespace_discovery": "SELECT arg_min(ns, length(ns)) AS ns FROM (SELECT DISTINCT regexp_extract(uri, '^(.*/)[^/]+$', 1) AS ns FROM thesaurus)",
    "FLT09_scalar_metadata": "SELECT e.key AS key, count(*) AS n, count(*) FILTER (TRY_CAST(e.value AS DOUBLE) IS NULL) AS not_numeric FROM (SELECT unnest(map_entries(metadata)) AS e FROM sources) WHERE e.value IS NOT NULL GROUP BY e.key",
    "FLT22_label_language": "SELECT 'prefLabel' AS property, count(*) AS n FROM thesaurus UNION ALL SELECT 'altLabel', sum(len(alt_labels))::BIGINT FROM thesaurus",
    "FLT16_standalone_only": "SELECT source_file, count(*) AS n FROM (SELECT block_id, any_value(source_file) AS source_file, any_value(kind) AS kind, any_value(text) AS text FROM blocks GROUP BY block_id) WHERE kind NOT IN ('para', 'table') AND trim(coalesce(text, '')) <> '' GROUP BY source_file",
    "RTE13_glossary": f"WITH {D._LAB} SELECT text_id, uri, definition FROM (SELECT text_id, uri FROM h QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY uri) <= 6) JOIN thesaurus USING (uri) WHERE definition IS NOT NULL",
    "SNK07_turtle_write": "SELECT 'part-' || (canon_id % 8) || '.ttl' AS source_file, CAST(count(*) AS INTEGER) AS concepts FROM thesaurus GROUP BY ALL",
}
ORACLES = {name: typed(s) for name, s in ORACLES.items()}
