"""The text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources.tables import table

GENERIC = ["report", "chapter", "assessment", "section", "table", "figure"]
_ACCENTS = "regexp_replace(strip_accents(lower({})), '[\\x{{300}}-\\x{{36f}}]', '', 'g')"
_SQUASH = "trim(regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def _over(name, keys, columns):
    """A query that applies column expressions (made when it runs, as they need a session) to each row of a table."""
    def query(spark, sf):
        return table(spark, sf, name).select(*([keys] if isinstance(keys, str) else keys), *[c.alias(n) for n, c in columns().items()])

    return query


def _distinct(name, columns):
    def query(spark, sf):
        return table(spark, sf, name).select(*[c.alias(n) for n, c in columns().items()]).distinct()

    return query


def str08(spark, sf):
    rows = table(spark, sf, "documents", ["source", "text"])
    terms = ["reef", "drought", "pollin", "estuar"]
    return rows.groupBy("source").agg(*[F.count_if(T.at_word_start(F.col("text"), t)).alias(f"n_{t}") for t in terms])


def str14(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"]).where("text is not null")
    return docs.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.md5(F.array_join(T.sentences(F.col("text")), "\n\n")).alias("hash"))


def str22(spark, sf):
    rows = table(spark, sf, "sources", ["source_id", "metadata"]).select("source_id", F.explode(F.map_values("metadata")).alias("value"))
    return rows.select("source_id", F.explode(T.dois(F.col("value"))).alias("doi")).distinct()


def str24(spark, sf):
    c = F.col("metadata")["citation"]
    rows = table(spark, sf, "sources", ["source_id", "metadata"]).where(c.isNotNull())
    return rows.select("source_id", F.regexp_extract(c, r"((?:19|20)[0-9][0-9])[a-z]?", 1).alias("year"), F.regexp_extract(c, r"^([^,;.(]+)", 1).alias("first_author"), F.regexp_extract(F.lower(c), r"(10\.[0-9]{4,9}/[^ ]+)", 1).alias("doi")).distinct()


def str30(spark, sf):
    """Consecutive deliveries of neighbouring blocks compared as texts."""
    from pyspark.sql import Window

    rows = table(spark, sf, "blocks", ["block_id", "source_file", "seq", "text"]).groupBy("block_id").agg(F.first("source_file").alias("source_file"), F.first("seq").alias("seq"), F.first("text").alias("text"))
    pairs = rows.withColumn("after", F.lead("text").over(Window.partitionBy("source_file").orderBy("seq", "block_id"))).where("text is not null and after is not null")
    return pairs.groupBy(T.text_kind(F.col("text"), F.col("after")).alias("kind")).agg(F.count("*").alias("n"))


def roman_numbers(spark, sf):
    num = F.regexp_extract("num", r"^[^\p{L}]*([ivxlcdmIVXLCDM]+)[^\p{L}]*$", 1)
    return table(spark, sf, "blocks", ["num"]).select("num", T.roman(num).alias("value")).where("value is not null").distinct()


def str20(spark, sf):
    """Session numbers named in titles, in words or digits."""
    numbers = F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,2}) (?:meeting|session)"), 1)
    rows = table(spark, sf, "blocks", ["block_id", "text"]).where("text is not null")
    found = rows.select("block_id", F.explode(F.array_distinct(numbers)).alias("session")).withColumn("session", F.col("session").cast("int")).distinct()
    return found.withColumn("ordinal", F.element_at(F.array(*[F.lit(x) for x in T.ORDINALS + ["later"] * 79]), F.greatest(F.col("session"), F.lit(1))))


def hashes(spark, sf):
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.substring(F.sha1(F.concat(F.lit("model\n"), "text")), 1, 16).alias("text_hash"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def colour_bits(spark, sf):
    """Red, green and blue of a span's colour, and whether it is greyish."""
    r, g, b = (F.shiftright("color", n).bitwiseAND(F.lit(255)) for n in (16, 8, 0))
    rows = table(spark, sf, "spans", ["color"]).where("color is not null").distinct()
    return rows.select("color", r.alias("red"), g.alias("green"), b.alias("blue"), ((F.greatest(r, g, b) - F.least(r, g, b)) <= 16).alias("grey"))


def check_digits(spark, sf):
    """Numbers made of each document's key, with a last sign that is right for some of them."""
    digits = F.substring(F.translate(F.md5(F.col("doc_id").cast("string")), "abcdef", "012345"), 1, 15)
    last = F.when(F.col("doc_id") % 11 == 10, F.lit("X")).otherwise((F.col("doc_id") % 11).cast("string"))
    made = F.concat_ws("-", *[F.substring(F.concat(digits, last), 4 * i + 1, 4) for i in range(4)])
    rows = table(spark, sf, "documents", ["doc_id"]).select("doc_id", made.alias("orcid"))
    return rows.select("doc_id", "orcid", T.orcid_valid(F.col("orcid")).alias("valid"))


def session_words(spark, sf):
    """Meetings named by number, spelled out in every block."""
    named = F.concat(F.coalesce("text", F.lit("")), F.lit(" (see Plenary-"), (F.col("seq") % 25).cast("string"), F.lit(")"))
    return table(spark, sf, "blocks", ["block_id", "seq", "text"]).select("block_id", F.md5(T.spell_sessions(named, "Plenary")).alias("hash")).distinct()


QUERIES = {
    "FLT21_orcid_check": check_digits, "STR19_spell_sessions": session_words,
    "STR34_names_split": _distinct("sources", lambda: dict(source_id=F.col("source_id"), names=F.array_join(T.split_names(F.coalesce(*[F.col("metadata")[k] for k in ("authors", "creator", "by")])), "|"))),
    "STR35_clean_caption": _distinct("paras", lambda: dict(para_id=F.col("para_id"), caption=F.md5(T.clean_caption(F.col("text"))))),
    "STR01_ws_squash": _over("documents", "doc_id", lambda: dict(hash=F.md5(T.squash(F.col("text"))))),
    "STR02_letters_only": _over("documents", "doc_id", lambda: dict(hash=F.md5(T.letters_only(F.col("text"))))),
    "STR03_fold_accents": _over("zotero", "item_key", lambda: dict(folded=T.loose(F.col("title")))),
    "STR04_word_set_key": _distinct("zotero", lambda: dict(item_key=F.col("item_key"), key=T.word_set(F.col("title")))),
    "STR05_term_key": _over("thesaurus", "canon_id", lambda: dict(key=T.term_key(F.col("pref_label")))),
    "STR06_definition_key": _over("thesaurus", "canon_id", lambda: dict(key=T.definition_key(F.col("definition")))),
    "STR07_stem": _over("thesaurus", "canon_id", lambda: dict(stem=T.stem(F.element_at(F.split("pref_label", " "), -1)))),
    "STR08_term_at_word_start": str08,
    "STR09_strip_corpus_words": _over("pdf_documents", ["chunk_id", "page"], lambda: dict(title=T.strip_words(F.concat(F.lit("report "), F.col("title")), GENERIC))),
    "STR12_local_name": _distinct("concepts", lambda: dict(concept_id=F.col("concept_id"), name=T.local_name(F.col("uri")))),
    "STR13_chapter_key": _distinct("sources", lambda: dict(source_file=F.col("source_file"), key=T.chapter_key(F.col("source_file")))),
    "STR14_sentence_split": str14,
    "STR16_title_case": _distinct("paras", lambda: dict(para_id=F.col("para_id"), title=F.md5(F.concat(F.upper(F.substring("text", 1, 1)), F.lower(F.expr("substring(text, 2)")))))),
    "STR17_controls": _over("documents", "doc_id", lambda: dict(n_removed=F.length("text") - F.length(F.regexp_replace("text", "[\\x{AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]", "")))),
    "STR20_session_extract": str20,
    "STR21_citation_strip": _over("documents", "doc_id", lambda: dict(hash=F.md5(T.strip_citations(F.col("text"))))),
    "STR22_doi_extract": str22,
    "STR23_reference_page": _over("documents", "doc_id", lambda: dict(reference=T.is_reference_page(F.col("text")))),
    "STR24_ref_fields": str24,
    "STR26_caption_parse": _distinct("spans", lambda: dict(kind=F.regexp_extract("text", r"^(Chapter|Annex|Section|Table|Figure) ", 1), number=F.regexp_extract("text", r"^(?:Chapter|Annex|Section|Table|Figure) ([0-9A-Z.]+)", 1), title=F.regexp_extract("text", r"^(?:Chapter|Annex|Section|Table|Figure) [0-9A-Z.]+ - (.*)$", 1))),
    "STR27_markdown_escape": _over("paras", ["para_id", "page"], lambda: dict(cell=F.md5(T.markdown_cell(F.col("text"))), html=F.md5(T.html_escape(F.col("text"))))),
    "STR28_truncate_note": _over("documents", "doc_id", lambda: dict(cell=F.md5(T.fit_cell(F.col("text"), 1000)))),
    "STR29_slug": _distinct("pdf_documents", lambda: dict(title=F.col("title"), slug=T.slug(F.col("title")))),
    "STR30_text_kind": str30,
    "STR33_decision_symbol": _distinct("spans", lambda: dict(symbol=F.regexp_replace(F.regexp_extract("text", r"decision ([\p{L}]+-[0-9]+/[0-9]+)", 1), "-", " "))),
    "MATH_roman": roman_numbers,
    "HASH_fingerprints": hashes,
    "MATH_colour_bits": colour_bits,
}
_FOLD = _ACCENTS
ORACLES = {
    "FLT21_orcid_check": "WITH d AS (SELECT doc_id, translate(md5(CAST(doc_id AS VARCHAR)), 'abcdef', '012345')[:15] || CASE doc_id % 11 WHEN 10 THEN 'X' ELSE CAST(doc_id % 11 AS VARCHAR) END AS x FROM documents), w AS (SELECT doc_id, x, sum(CAST(x[i] AS INTEGER) * (CAST(power(2, 16 - i) AS BIGINT) % 11)) AS total FROM d, (SELECT unnest(range(1, 16)) AS i) GROUP BY doc_id, x) SELECT doc_id, x[1:4] || '-' || x[5:8] || '-' || x[9:12] || '-' || x[13:16] AS orcid, (total + CASE x[16] WHEN 'X' THEN 10 ELSE CAST(x[16] AS INTEGER) END) % 11 = 1 AS valid FROM w",
    "STR19_spell_sessions": "SELECT DISTINCT block_id, md5(coalesce(text, '') || ' (see ' || CASE WHEN seq % 25 BETWEEN 1 AND 20 THEN 'the ' || [" + ", ".join(f"'{x}'" for x in T.ORDINALS) + "][seq % 25] || ' session' ELSE 'Plenary-' || (seq % 25) END || ')') AS hash FROM blocks",
    "STR34_names_split": "SELECT DISTINCT source_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(c, '\\s*(;| and | & )\\s*', '|', 'g'), '|'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names FROM (SELECT source_id, coalesce(metadata['authors'], metadata['creator'], metadata['by']) AS c FROM sources)",
    "STR35_clean_caption": f"SELECT DISTINCT para_id, md5(regexp_replace({_SQUASH.format('text')}, '^(Table|Figure|Box|Map) [0-9A-Z]+(\\.[0-9A-Z]+)*[.:]? *', '')) AS caption FROM paras",
    "STR01_ws_squash": f"SELECT doc_id, md5({_SQUASH.format('text')}) AS hash FROM documents",
    "STR02_letters_only": "SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS hash FROM documents",
    "STR03_fold_accents": "SELECT item_key, regexp_replace(strip_accents(lower(title)), '[^a-z0-9]', '', 'g') AS folded FROM zotero",
    "STR04_word_set_key": "SELECT DISTINCT item_key, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(regexp_replace(title, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'))), '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS key FROM zotero",
    "STR05_term_key": "SELECT canon_id, array_to_string(list_transform(list_filter(regexp_split_to_array(strip_accents(lower(pref_label)), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: regexp_replace(CASE WHEN w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|us|is)$') THEN w ELSE regexp_replace(w, 's$', '') END, 'isation$', 'ization')), '') AS key FROM thesaurus",
    "STR06_definition_key": "SELECT canon_id, regexp_replace(lower(regexp_replace(definition, '([ \\n]*[(\\[][^()\\[\\]]*[)\\]][ .]*)+$', '')), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM thesaurus",
    "STR07_stem": "SELECT canon_id, CASE " + " ".join(f"WHEN w LIKE '%{s}' AND length(w) - {len(s)} >= 4 THEN w[:length(w) - {len(s)}]" for s in T.SUFFIXES) + " ELSE w END AS stem FROM (SELECT canon_id, string_split(pref_label, ' ')[-1] AS w FROM thesaurus)",
    "STR08_term_at_word_start": "SELECT source, " + ", ".join(f"count(*) FILTER (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){t}')) AS n_{t}" for t in ["reef", "drought", "pollin", "estuar"]) + " FROM documents GROUP BY source",
    "STR09_strip_corpus_words": f"SELECT chunk_id, page, CASE WHEN length(s) < 3 THEN 'report ' || title ELSE s END AS title FROM (SELECT *, {_SQUASH.format(chr(39).join(['regexp_replace(', 'report ', ' || title, ', '(?i)\\b(' + '|'.join(GENERIC) + ')\\b', ', ', ' ', ', ', 'g', ')']))} AS s FROM pdf_documents)",
    "STR12_local_name": "SELECT DISTINCT concept_id, string_split(rtrim(trim(uri), '/'), '/')[-1] AS name FROM concepts",
    "STR13_chapter_key": "SELECT DISTINCT source_file, array_to_string(list_transform(regexp_extract_all(source_file, '([0-9]+)'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), '-') AS key FROM sources",
    "STR14_sentence_split": "SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, md5(array_to_string(s, chr(10) || chr(10))) AS hash FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+([A-Z])', '\\1\x01\\2', 'g'), '\x01') AS s FROM documents WHERE text IS NOT NULL)",
    "STR16_title_case": "SELECT DISTINCT para_id, md5(upper(text[1:1]) || lower(substring(text, 2))) AS title FROM paras",
    "STR17_controls": "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x{AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g')) AS INTEGER) AS n_removed FROM documents",
    "STR20_session_extract": "SELECT DISTINCT block_id, session, CASE WHEN session BETWEEN 1 AND 20 THEN [" + ", ".join(f"'{x}'" for x in T.ORDINALS) + "][session] WHEN session = 0 THEN 'first' ELSE 'later' END AS ordinal FROM (SELECT block_id, CAST(unnest(regexp_extract_all(text, '\\b([0-9]{1,2}) (?:meeting|session)', 1)) AS INTEGER) AS session FROM blocks WHERE text IS NOT NULL)",
    "STR21_citation_strip": "SELECT doc_id, md5(regexp_replace(text, ' ?\\([^()]*, (19|20)[0-9][0-9]\\)', '', 'g')) AS hash FROM documents",
    "STR22_doi_extract": "SELECT DISTINCT source_id, regexp_replace(d, '[.,;)]+$', '') AS doi FROM (SELECT source_id, unnest(regexp_extract_all(lower(v), '(10\\.[0-9]{4,9}/[^ \"<>]+)', 1)) AS d FROM (SELECT source_id, unnest(map_values(metadata)) AS v FROM sources))",
    "STR23_reference_page": "SELECT doc_id, (y >= 15 AND l >= 3) OR (y >= 8 AND e >= 8) AS reference FROM (SELECT doc_id, len(regexp_extract_all(text, '\\((19|20)[0-9][0-9][a-z]?\\)')) AS y, len(regexp_extract_all(text, 'https?://')) AS l, len(regexp_extract_all(text, '(?m)^\\p{Lu}[^\\n]{2,60}, \\p{Lu}\\.')) AS e FROM documents)",
    "STR24_ref_fields": "SELECT DISTINCT source_id, regexp_extract(c, '((?:19|20)[0-9][0-9])[a-z]?', 1) AS year, regexp_extract(c, '^([^,;.(]+)', 1) AS first_author, regexp_extract(lower(c), '(10\\.[0-9]{4,9}/[^ ]+)', 1) AS doi FROM (SELECT source_id, metadata['citation'] AS c FROM sources) WHERE c IS NOT NULL",
    "STR26_caption_parse": "SELECT DISTINCT regexp_extract(text, '^(Chapter|Annex|Section|Table|Figure) ', 1) AS kind, regexp_extract(text, '^(?:Chapter|Annex|Section|Table|Figure) ([0-9A-Z.]+)', 1) AS number, regexp_extract(text, '^(?:Chapter|Annex|Section|Table|Figure) [0-9A-Z.]+ - (.*)$', 1) AS title FROM spans",
    "STR27_markdown_escape": f"SELECT para_id, page, md5(replace({_SQUASH.format('text')}, '|', '\\|')) AS cell, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS html FROM paras",
    "STR28_truncate_note": "SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN text[:960] || ' [cut, ' || length(text) || ' characters]' ELSE text END) AS cell FROM documents",
    "STR29_slug": "SELECT DISTINCT title, regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM pdf_documents",
    "STR30_text_kind": f"SELECT CASE WHEN {_SQUASH.format('text')} = {_SQUASH.format('after')} THEN 'same' WHEN regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g') = regexp_replace(strip_accents(lower(after)), '[^a-z0-9]', '', 'g') THEN 'punctuation' ELSE 'different' END AS kind, count(*) AS n FROM (SELECT text, lead(text) OVER (PARTITION BY source_file ORDER BY seq, block_id) AS after FROM (SELECT block_id, any_value(source_file) AS source_file, any_value(seq) AS seq, any_value(text) AS text FROM blocks GROUP BY block_id)) WHERE text IS NOT NULL AND after IS NOT NULL GROUP BY 1",
    "STR33_decision_symbol": "SELECT DISTINCT replace(regexp_extract(text, 'decision ([\\p{L}]+-[0-9]+/[0-9]+)', 1), '-', ' ') AS symbol FROM spans",
    "MATH_roman": "WITH r AS (SELECT n, (['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm', 'm'])[n // 100 + 1] || (['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'])[n % 100 // 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[n % 10 + 1] AS w FROM (SELECT CAST(unnest(range(1, 1001)) AS INTEGER) AS n)) SELECT DISTINCT num, n AS value FROM (SELECT num, lower(regexp_extract(num, '^[^\\p{L}]*([ivxlcdmIVXLCDM]+)[^\\p{L}]*$', 1)) AS w FROM blocks) JOIN r USING (w)",
    "HASH_fingerprints": "SELECT doc_id, sha1('model' || chr(10) || text)[:16] AS text_hash, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
    "MATH_colour_bits": "SELECT DISTINCT color, (color >> 16) & 255 AS red, (color >> 8) & 255 AS green, color & 255 AS blue, greatest((color >> 16) & 255, (color >> 8) & 255, color & 255) - least((color >> 16) & 255, (color >> 8) & 255, color & 255) <= 16 AS grey FROM spans WHERE color IS NOT NULL",
}
