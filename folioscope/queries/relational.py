"""Relational operators of the document store, as Catalyst plans written in SQL.

A statement names its tables in braces. Two spellings differ between Spark and the engine that checks it:
[[expr ; separator ; order]] is an ordered concatenation, and names of functions are listed in SPELLINGS.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ORDERED = re.compile(r"\[\[(.+?) ; (.*?) ; (.+?)\]\]")


def run(spark: SparkSession, sf: str, statement: str) -> DataFrame:
    """The statement over the tables that it names."""
    names = set(re.findall(r"\{(\w+)\}", statement))
    return spark.sql(_ORDERED.sub(r"listagg(\1, '\2') WITHIN GROUP (ORDER BY \3)", statement), **{n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names})


def typed(statement: str) -> str:
    """The checking engine's counts and row numbers with the types that Spark gives them."""
    for start, kind in (("count_if(", "BIGINT"), ("row_number() OVER (", "INTEGER")):
        at = 0
        while (at := statement.find(start, at)) >= 0:
            end, depth = at + len(start), 1
            while depth:
                depth += {"(": 1, ")": -1}.get(statement[end], 0)
                end += 1
            inside = statement[at + len(start) : end - 1]
            statement = f"{statement[:at]}CAST({start}{inside}) AS {kind}){statement[end:]}"
            at += len("CAST(") + len(start)
    return re.sub(r"row_number\(\) OVER (\w+)", r"CAST(row_number() OVER \1 AS INTEGER)", statement)


def oracle(statement: str) -> str:
    return _ORDERED.sub(r"string_agg(\1, '\2' ORDER BY \3)", re.sub(r"\{(\w+)\}", r"\1", statement))


#: One row per id: re-delivered rows are copies.
BLOCKS = "(SELECT block_id, max(report_id) AS report_id, max(source_file) AS source_file, max(lang) AS lang, max(seq) AS seq, max(kind) AS kind, max(num) AS num, max(display) AS display, max(ilvl) AS ilvl, max(style) AS style, max(text) AS text FROM {blocks} GROUP BY block_id)"
NODES = "(SELECT node_id, max(source_file) AS source_file, max(report_id) AS report_id, max(lang) AS lang, max(tag) AS tag, max(num) AS num, max(heading) AS heading FROM {nodes} GROUP BY node_id)"
EDGES = "(SELECT DISTINCT node_id AS parent, child FROM (SELECT node_id, {explode_children} AS child FROM {nodes}))"
SPANS = "(SELECT span_id, max(source_file) AS source_file, max(page) AS page, max(block) AS block, max(line) AS line, max(seq) AS seq, max(text) AS text, max(font) AS font, max(font_size) AS font_size, max(color) AS color, bool_or(bold) AS bold, bool_or(sup) AS sup, max(x0) AS x0 FROM {spans} GROUP BY span_id)"
PARAS = "(SELECT para_id, max(source_file) AS source_file, max(role) AS role, max(page) AS page, max(x0) AS x0, max(y0) AS y0, max(label) AS label, max(text) AS text FROM {paras} GROUP BY para_id)"
PAGES = "(SELECT chunk_id, max(source_file) AS source_file, max(title) AS title, max(page) AS page, max(printed_page) AS printed_page, max(page_count) AS page_count, max(section) AS section, max(file_sha256) AS file_sha256, max(page_offset) AS page_offset, max(chunk_index) AS chunk_index, max(text) AS text FROM {pdf_documents} GROUP BY chunk_id)"

STATEMENTS = {
    # scans
    "SRC22_store_full_scan": "SELECT doc_id, lang, source, assessment, chapter FROM {documents}",
    "SRC23_store_point_read": "SELECT assessment, min(doc_id) AS first_doc, min_by(source, doc_id) AS source FROM {documents} WHERE assessment IS NOT NULL GROUP BY assessment",
    # filters
    "FLT01_where_builder": "SELECT doc_id, lang, source FROM {documents} WHERE source <> 'reference_lists' AND lang IN ('en', 'fr') AND chapter IS NOT NULL",
    "FLT02_in_list": f"SELECT block_id, num FROM {BLOCKS} b WHERE num IN ('1.', '2.', '(i)', 'I.')",
    "FLT05_skip_types": f"SELECT kind, count(*) AS n FROM {BLOCKS} b WHERE kind NOT IN ('table', 'annex_header') GROUP BY kind",
    "FLT06_empty_body_drop": "SELECT doc_id, CASE WHEN source = 'forum_posts' THEN coalesce(nullif(trim(text), ''), 'not recorded') ELSE trim(text) END AS body FROM {documents} WHERE source = 'forum_posts' OR trim(coalesce(text, '')) <> ''",
    "FLT07_numbered_chapter": "SELECT DISTINCT source_file FROM {sources} WHERE regexp_extract(source_file, '^ch([0-9]+)', 1) IN ('1', '2', '3')",
    "FLT10_length_guard": "SELECT doc_id, n_chars, n_chars > 20000 AS too_long FROM {documents} WHERE n_chars > 5000",
    "FLT11_duplicate_keys": "SELECT item_key, count(*) AS copies FROM {zotero} GROUP BY item_key HAVING count(*) > 1",
    "FLT14_short_labels": "SELECT canon_id, pref_label, length(pref_label) >= 5 OR (length(pref_label) BETWEEN 2 AND 6 AND upper(pref_label) = pref_label) AS eligible FROM {thesaurus}",
    "FLT20_question_scope": "SELECT doc_id, source FROM {documents} WHERE source = 'question_answers' AND (chapter BETWEEN 1 AND 5 OR chapter = 8)",
    "FLT23_page_bounds": f"SELECT para_id, page FROM {PARAS} p WHERE y0 BETWEEN 60 AND 780 AND x0 BETWEEN 40 AND 560",
    "FLT17_running_lines": f"WITH s AS (SELECT source_file, page, lower(regexp_replace(text, '[0-9]+', '#'{{g}})) AS line_key FROM {SPANS} x WHERE text IS NOT NULL), n AS (SELECT source_file, count(DISTINCT page) AS pages FROM s GROUP BY source_file), r AS (SELECT source_file, line_key, count(DISTINCT page) AS on_pages FROM s GROUP BY source_file, line_key) SELECT r.source_file, r.line_key, r.on_pages FROM r JOIN n ON n.source_file = r.source_file WHERE r.on_pages >= greatest(3, floor(n.pages / 50))",
    # projections
    "PRJ02_xml_metadata": f"SELECT block_id, source_file, lang, kind, num, CAST(seq AS STRING) AS position, length(text) AS size FROM {BLOCKS} b",
    "PRJ03_pdf_metadata": f"SELECT chunk_id, source_file, page, printed_page, page_count, section, file_sha256 FROM {PAGES} p",
    "PRJ04_replace_semantics": "SELECT doc_id, source, nullif(trim(assessment), '') AS assessment, CAST(NULL AS STRING) AS dropped FROM {documents}",
    "PRJ06_annotate_country": "SELECT s_suppkey, coalesce(n_name, 'unknown') AS country FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey",
    "PRJ07_context_line": "SELECT doc_id, concat_ws(' ', 'id=' || CAST(doc_id AS STRING), 'type=' || nullif(source, ''), 'assessment=' || nullif(assessment, ''), 'chapter=' || CAST(chapter AS STRING), 'lang=' || lang) AS line FROM {documents}",
    "PRJ08_location_block": f"SELECT block_id, concat('[', source_file, ' ', lang, ', ', coalesce(nullif(display, ''), nullif(num, ''), '-'), '] ', coalesce(text, '')) AS block FROM {BLOCKS} b WHERE kind = 'para'",
    "PRJ09_chunk_text": "SELECT doc_id, concat(concat_ws(chr(10), 'Assessment: ' || assessment, 'Chapter: ' || CAST(chapter AS STRING)), chr(10), chr(10), text) AS chunk FROM {documents} WHERE text IS NOT NULL",
    "PRJ11_page_label": f"SELECT chunk_id, concat(CAST(page AS STRING), ' of ', CAST(page_count AS STRING), CASE WHEN printed_page IS NOT NULL AND printed_page <> page THEN concat(' (printed page ', CAST(printed_page AS STRING), ')') ELSE '' END) AS label FROM {PAGES} p",
    "PRJ12_source_title": "SELECT DISTINCT source_id, CASE source_type WHEN 'pdf' THEN concat('Report page, ', coalesce(nullif(location, ''), 'unknown')) WHEN 'xml' THEN concat('Plenary, ', coalesce(nullif(location, ''), 'unknown')) ELSE concat('Assessment, ', source_file) END AS title FROM {sources}",
    "PRJ15_scoped_question": "SELECT mix_name, source, concat('Which gaps are named? (Answer for ', source, ' only.)') AS question FROM {mix_targets}",
    "PRJ16_short_title": "SELECT item_key, concat(upper(substring(regexp_replace(title, '^The ', ''), 1, 1)), substring(regexp_replace(title, '^The ', ''), 2, 59)) AS title FROM {zotero} WHERE title IS NOT NULL",
    # joins
    "JOIN06_incremental_diff": "WITH new AS (SELECT doc_id, md5(text) AS text_hash, md5(concat_ws('|', source, lang)) AS meta_hash FROM {documents} WHERE coalesce(source, '') <> 'forum_posts'), old AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'x' ELSE md5(text) END AS text_hash, CASE WHEN chapter IS NULL THEN 'x' ELSE md5(concat_ws('|', source, lang)) END AS meta_hash FROM {documents} WHERE coalesce(source, '') <> 'footnotes') SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, CASE WHEN new.doc_id IS NULL THEN 'delete' WHEN old.doc_id IS NULL OR coalesce(old.text_hash, '') <> coalesce(new.text_hash, '') THEN 'embed' WHEN old.meta_hash <> new.meta_hash THEN 'retag' ELSE 'keep' END AS action FROM new FULL OUTER JOIN old ON old.doc_id = new.doc_id",
    "JOIN07_stale_anti": "SELECT o.o_orderkey FROM {orders} o LEFT ANTI JOIN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') l ON l.l_orderkey = o.o_orderkey",
    "JOIN16_country_lookup": "SELECT c_custkey, n_name, r_name FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey",
    "JOIN13_region_resolve": "WITH q AS (SELECT lower(substring(n_name, 1, 3)) AS q FROM {nation}), m AS (SELECT q, n_name, CASE WHEN lower(n_name) = q THEN 0 WHEN lower(n_name) LIKE concat(q, '%') THEN 1 ELSE 2 END AS tier FROM q JOIN {nation} ON lower(n_name) LIKE concat('%', q, '%')) SELECT q, min_by(n_name, concat(CAST(tier AS STRING), CAST(1000 - length(n_name) AS STRING), n_name)) AS resolved FROM m GROUP BY q",
    "JOIN18_chapter_title": "WITH t AS (SELECT assessment, chapter, min(text) AS title FROM {documents} WHERE text IS NOT NULL GROUP BY assessment, chapter) SELECT d.doc_id, md5(coalesce(t.title, CAST(d.chapter AS STRING), '-')) AS title FROM {documents} d LEFT JOIN t ON t.assessment = d.assessment AND t.chapter = d.chapter",
    "JOIN20_list_items": f"WITH b AS (SELECT * FROM {BLOCKS} x WHERE kind = 'para') SELECT a.block_id, count(*) AS n_items, [[b.text ; / ; b.seq]] AS items FROM b a JOIN b ON b.source_file = a.source_file AND b.seq BETWEEN a.seq + 1 AND a.seq + 4 AND b.ilvl > a.ilvl WHERE a.ilvl = 0 AND b.text IS NOT NULL GROUP BY a.block_id",
    "JOIN22_parent_section": "WITH s AS (SELECT DISTINCT regexp_extract(text, 'section ([0-9]+[.][0-9]+)', 1) AS number FROM {documents} WHERE text LIKE '%section %'), k AS (SELECT number, regexp_extract(number, '^([0-9]+)', 1) AS parent FROM s WHERE number <> '') SELECT k.number, coalesce(max(p.number), k.parent) AS nearest FROM k LEFT JOIN k p ON p.parent = k.parent AND length(p.number) < length(k.number) GROUP BY k.number, k.parent",
    "JOIN26_citation_link": "WITH c AS (SELECT DISTINCT source_id, lower(regexp_extract(metadata['citation'], '^([^,;.( ]+)', 1)) AS name, regexp_extract(metadata['citation'], '((?:19|20)[0-9][0-9])', 1) AS year FROM {sources} WHERE metadata['citation'] IS NOT NULL), z AS (SELECT DISTINCT item_key, lower({first_creator}) AS name, regexp_extract(item_date, '((?:19|20)[0-9][0-9])', 1) AS year FROM {zotero} WHERE item_date IS NOT NULL) SELECT source_id, item_key FROM c JOIN z ON z.year = c.year AND z.name = c.name WHERE c.name <> ''",
    "JOIN31_glossary_anti": "WITH c AS (SELECT concept_id, lower(trim(pref_label)) AS k FROM {concepts} WHERE pref_label IS NOT NULL), t AS (SELECT lower(pref_label) AS k FROM {thesaurus}) SELECT DISTINCT c.concept_id, c.k FROM c LEFT ANTI JOIN t ON t.k = c.k",
    "JOIN35_as_of_category": f"WITH p AS (SELECT para_id, source_file, page, y0, CASE WHEN role IN ('h1', 'h2', 'h3') THEN text END AS heading FROM {PARAS} x) SELECT para_id, last_value(heading{{ignore}}){{ignored}} OVER (PARTITION BY source_file ORDER BY page, y0, para_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM p",
    "JOIN37_property_full_outer": f"WITH e AS (SELECT report_id, num, max(text) AS text FROM {BLOCKS} b WHERE lang = 'en' AND num <> '' GROUP BY report_id, num), o AS (SELECT report_id, num, max(text) AS text FROM {BLOCKS} b WHERE lang <> 'en' AND num <> '' GROUP BY report_id, num) SELECT coalesce(e.report_id, o.report_id) AS report_id, coalesce(e.num, o.num) AS num, CASE WHEN o.num IS NULL THEN 'only in the first' WHEN e.num IS NULL THEN 'only in the second' WHEN e.text = o.text THEN 'same' ELSE 'different' END AS kind FROM e FULL OUTER JOIN o ON o.report_id = e.report_id AND o.num = e.num",
    "JOIN42_ontology_diff": f"WITH expected AS (SELECT tag, kind FROM (SELECT DISTINCT tag FROM {NODES} n) CROSS JOIN (SELECT DISTINCT kind FROM {BLOCKS} b)), present AS (SELECT DISTINCT tag, kind FROM (SELECT max(tag) AS tag, max(block_id) AS block_id FROM {{nodes}} GROUP BY node_id) n JOIN (SELECT block_id, max(kind) AS kind FROM {{blocks}} GROUP BY block_id) b ON b.block_id = n.block_id) SELECT expected.tag, expected.kind FROM expected LEFT ANTI JOIN present ON present.tag = expected.tag AND present.kind = expected.kind",
    "JOIN24_gap_to_background": "WITH s AS (SELECT doc_id, source, regexp_extract(text, 'section ([0-9]+[.][0-9]+)', 1) AS section FROM {documents} WHERE source IN ('knowledge_gaps', 'policy_summaries') AND text LIKE '%section %') SELECT DISTINCT g.doc_id AS gap, m.doc_id AS message FROM s g JOIN s m ON m.section = g.section AND m.source = 'policy_summaries' WHERE g.source = 'knowledge_gaps' AND g.section <> ''",
    # aggregates
    "AGG01_counts_by_key": "SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang",
    "AGG02_file_summary": f"SELECT source_file, min(file_sha256) AS hash, min(page_offset) AS page_offset, count(*) AS chunks, count_if(section = 'references') AS reference_chunks FROM {PAGES} p GROUP BY source_file",
    "AGG03_size_stats": "WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM {documents} WHERE n_chars IS NOT NULL) SELECT source, max(n) AS n, max(CASE WHEN i = CAST(floor(n * 0.5) AS INT) THEN n_chars END) AS median, max(CASE WHEN i = CAST(floor(n * 0.95) AS INT) THEN n_chars END) AS p95, max(n_chars) AS longest FROM r GROUP BY source",
    "AGG04_page_offset_vote": f"WITH v AS (SELECT source_file, printed_page - page AS shift, count(*) AS votes FROM {PAGES} p WHERE printed_page IS NOT NULL GROUP BY source_file, printed_page - page), t AS (SELECT source_file, sum(votes) AS total, max(votes) AS most FROM v GROUP BY source_file) SELECT v.source_file, min(v.shift) AS page_offset FROM v JOIN t ON t.source_file = v.source_file AND t.most = v.votes WHERE t.total >= 5 AND t.most >= 0.6 * t.total GROUP BY v.source_file",
    "AGG05_running_lines": f"SELECT source_file, text, count(DISTINCT page) AS pages FROM {SPANS} s WHERE text IS NOT NULL GROUP BY source_file, text HAVING count(DISTINCT page) >= 3",
    "AGG07_weighted_mode": f"WITH c AS (SELECT source_file, color, sum(length(text)) AS size FROM {SPANS} s WHERE text IS NOT NULL AND color IS NOT NULL GROUP BY source_file, color) SELECT source_file, min_by(color, CAST(-size * 100000000 AS DOUBLE) + color) AS accent FROM c GROUP BY source_file",
    "AGG09_column_mode": f"WITH c AS (SELECT source_file, CAST(floor(x0) AS INT) AS x, count(*) AS n FROM {PARAS} p WHERE length(text) > 100 GROUP BY source_file, CAST(floor(x0) AS INT)) SELECT source_file, min_by(x, CAST(-n AS DOUBLE) * 100000 + x) AS column_x FROM c GROUP BY source_file",
    "AGG13_grouped_listing": "SELECT assessment, doc_id, count(*) OVER (PARTITION BY assessment) AS n, row_number() OVER (PARTITION BY assessment ORDER BY coalesce(chapter, -1), doc_id) AS place FROM {documents} WHERE source = 'knowledge_gaps' AND assessment IS NOT NULL",
    "AGG14_ordered_set": "SELECT assessment, [[source ; | ; source]] AS sources FROM (SELECT DISTINCT assessment, source FROM {documents} WHERE source IS NOT NULL AND assessment IS NOT NULL) GROUP BY assessment",
    "AGG15_first_non_empty": "SELECT source_file, min_by(title, chunk_id) AS title, min(chunk_id) AS chunk FROM {pdf_documents} WHERE trim(coalesce(title, '')) <> '' GROUP BY source_file",
    "AGG16_contiguous": "WITH y AS (SELECT DISTINCT CAST(substring(report_id, 1, 4) AS INT) AS year FROM {blocks} WHERE report_id IS NOT NULL) SELECT min(year) AS first_year, max(year) AS last_year, count(*) AS n, max(year) - min(year) + 1 = count(*) AS contiguous FROM y",
    "AGG17_decision_catalogue": f"SELECT DISTINCT source_file, lang, CASE WHEN text LIKE 'Approves%' THEN 'approved' WHEN text LIKE 'Requests%' THEN 'requested' WHEN text LIKE 'Decides%' THEN 'decided' ELSE 'welcomed' END AS stage, text AS wording FROM {BLOCKS} b WHERE lang = 'en' AND (text LIKE 'Approves%' OR text LIKE 'Requests%' OR text LIKE 'Decides%' OR text LIKE 'Welcomes%')",
    "AGG20_country_quality": "SELECT coalesce(n_name, 'unresolved') AS country, count(*) AS n FROM {customer} LEFT JOIN (SELECT * FROM {nation} WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey GROUP BY coalesce(n_name, 'unresolved')",
    "AGG21_quality_checks": "SELECT 'null text' AS finding, count(*) AS n, min(doc_id) AS example FROM {documents} WHERE text IS NULL UNION ALL SELECT 'empty text', count(*), min(doc_id) FROM {documents} WHERE trim(text) = '' UNION ALL SELECT 'null language', count(*), min(doc_id) FROM {documents} WHERE lang IS NULL UNION ALL SELECT 'wrong length', count(*), min(doc_id) FROM {documents} WHERE length(text) <> n_chars",
    "AGG22_property_coverage": "SELECT source, CAST(floor(100 * count(lang) / count(*)) AS INT) AS lang_percent, CAST(floor(100 * count(assessment) / count(*)) AS INT) AS assessment_percent, CAST(floor(100 * count(chapter) / count(*)) AS INT) AS chapter_percent FROM {documents} GROUP BY source",
    "AGG23_conflicts": "WITH d AS (SELECT DISTINCT item_key, lower(trim(doi)) AS doi FROM {zotero} WHERE trim(coalesce(doi, '')) <> '') SELECT doi, count(DISTINCT item_key) AS holders FROM d GROUP BY doi HAVING count(DISTINCT item_key) > 1",
    "AGG24_structure_counts": f"SELECT source_file, tag, count(*) AS n FROM {NODES} n GROUP BY source_file, tag",
    "AGG25_comparison_summary": f"SELECT kind, count_if(lang = 'en') AS en, count_if(lang = 'fr') AS fr, count_if(lang = 'es') AS es FROM {BLOCKS} b GROUP BY kind",
    "AGG26_report_rollup": "SELECT source, count(*) AS n, CASE WHEN count_if(lang = 'en') = 0 THEN '0 %' WHEN count_if(lang = 'en') = count(*) THEN '100 %' ELSE concat(CAST(least(99, greatest(1, CAST(floor(100 * count_if(lang = 'en') / count(*)) AS INT))) AS STRING), ' %') END AS english FROM {documents} GROUP BY source",
    "AGG27_conversion_counts": "SELECT 'blocks' AS entity, count(DISTINCT block_id) AS n FROM {blocks} UNION ALL SELECT 'nodes', count(DISTINCT node_id) FROM {nodes} UNION ALL SELECT 'concepts', count(DISTINCT concept_id) FROM {concepts} UNION ALL SELECT 'works', count(DISTINCT item_key) FROM {zotero}",
    "AGG28_glossary_rollup": "SELECT lower(trim(pref_label)) AS term, count(DISTINCT concept_id) AS concepts, [[scheme ; / ; scheme]] AS schemes FROM (SELECT DISTINCT pref_label, concept_id, scheme FROM {concepts} WHERE scheme IS NOT NULL AND trim(pref_label) <> '') GROUP BY lower(trim(pref_label))",
    "AGG31_language_matrix": f"SELECT report_id, count_if(lang = 'en') AS en, count_if(lang = 'fr') AS fr, count_if(lang = 'es') AS es FROM {BLOCKS} b WHERE kind = 'para' GROUP BY report_id",
    "AGG32_coverage_total": "SELECT coalesce(source, 'total') AS source, count(*) AS items, count_if(text LIKE '%http%') AS with_link, count_if(lang IS NULL) AS without_lang FROM (SELECT coalesce(source, '-') AS source, text, lang FROM {documents}) GROUP BY ROLLUP (source)",
    "AGG12_distinct_people": "SELECT count(*) AS name_rows, count(DISTINCT name) AS people FROM (SELECT item_key, {explode_creators} AS name FROM {zotero})",
    # windows
    "WIN07_per_page_index": f"SELECT chunk_id, row_number() OVER (PARTITION BY source_file, page ORDER BY chunk_id) - 1 AS idx, count(*) OVER (PARTITION BY source_file, page) AS on_page, count(*) OVER (PARTITION BY source_file) AS in_file FROM {PAGES} p",
    "WIN08_last_heading": f"WITH b AS (SELECT block_id, source_file, seq, CASE WHEN kind IN ('title', 'heading') THEN text END AS heading FROM {BLOCKS} x) SELECT block_id, last_value(heading{{ignore}}){{ignored}} OVER (PARTITION BY source_file ORDER BY seq, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM b",
    "WIN09_sequence_gaps": f"SELECT source_file, seq, before FROM (SELECT source_file, seq, lag(seq) OVER (PARTITION BY source_file ORDER BY seq) AS before FROM {BLOCKS} b) WHERE seq > before + 1",
    "WIN11_unique_suffix": f"SELECT block_id, CASE WHEN n = 1 THEN num ELSE concat(num, '_', CAST(n AS STRING)) END AS eid FROM (SELECT block_id, num, row_number() OVER (PARTITION BY source_file, num ORDER BY seq, block_id) AS n FROM {BLOCKS} b WHERE num <> '')",
    "WIN12_first_seen": "SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source) AS first_seen FROM {documents}",
    "WIN14_cell_clustering": f"SELECT para_id, CAST(sum(fresh) OVER (PARTITION BY source_file, page ORDER BY y0, para_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cell FROM (SELECT para_id, source_file, page, y0, CASE WHEN y0 - lag(y0) OVER (PARTITION BY source_file, page ORDER BY y0, para_id) < 60 THEN 0 ELSE 1 END AS fresh FROM {PARAS} p)",
    "WIN16_paragraph_joining": f"SELECT source_file, page, block, grp, [[text ; / ; seq]] AS joined FROM (SELECT source_file, page, block, seq, text, CAST(sum(fresh) OVER (PARTITION BY source_file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM (SELECT source_file, page, block, seq, text, CASE WHEN lag(text) OVER (PARTITION BY source_file ORDER BY seq) LIKE '%.' OR lag(block) OVER (PARTITION BY source_file ORDER BY seq) <> block THEN 1 ELSE 0 END AS fresh FROM {SPANS} s WHERE text IS NOT NULL)) GROUP BY source_file, page, block, grp",
    "WIN22_run_merge": f"SELECT source_file, line, run, [[text ; / ; seq]] AS merged, count(*) AS spans FROM (SELECT source_file, line, seq, text, CAST(sum(change) OVER (PARTITION BY source_file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT source_file, line, seq, text, CASE WHEN lag(font) OVER (PARTITION BY source_file ORDER BY seq) = font AND lag(bold) OVER (PARTITION BY source_file ORDER BY seq) = bold AND lag(line) OVER (PARTITION BY source_file ORDER BY seq) = line THEN 0 ELSE 1 END AS change FROM {SPANS} s WHERE text IS NOT NULL)) GROUP BY source_file, line, run",
    "WIN23_group_break": "SELECT doc_id, assessment, row_number() OVER (PARTITION BY assessment ORDER BY doc_id) = 1 AS new_group FROM {documents} WHERE assessment IS NOT NULL",
    "WIN24_per_kind_counter": f"SELECT block_id, row_number() OVER (PARTITION BY source_file, kind ORDER BY seq, block_id) AS component FROM {BLOCKS} b WHERE kind IN ('annex_header', 'annex_title', 'table')",
    "WIN18_last_n_events": "SELECT user_id, event_id, back FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {events}) WHERE back <= 6 AND event_type <> 'error'",
    "WIN19_recent_first_cap": "SELECT user_id, row_number() OVER (ORDER BY last_ts DESC, user_id) AS place FROM (SELECT user_id, max(ts) AS last_ts FROM {events} GROUP BY user_id ORDER BY last_ts DESC, user_id LIMIT 50) x",
    # sorts
    "SRT03_natural_path": f"SELECT block_id, row_number() OVER (PARTITION BY source_file ORDER BY lpad(regexp_extract(num, '([0-9]+)', 1), 10, '0'), num, block_id) AS place FROM {BLOCKS} b WHERE kind = 'para' AND num IS NOT NULL",
    "SRT07_expert_sort": "SELECT s_suppkey, row_number() OVER (ORDER BY debt, n_name, s_name, s_suppkey) AS place FROM (SELECT s_suppkey, s_name, n_name, CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END AS debt FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey ORDER BY debt, n_name, s_name, s_suppkey LIMIT 500) x",
    "SRT08_part_rank": f"SELECT block_id, CASE kind WHEN 'para' THEN 0 WHEN 'annex_title' THEN 1 WHEN 'annex_header' THEN 1 ELSE 2 END AS part_rank FROM {BLOCKS} b",
    "SRT12_trailing_number": "SELECT item_key, coalesce(CAST(nullif(regexp_extract({first_collection}, '([0-9]+)$', 1), '') AS INT), 1000000) AS place FROM {zotero}",
    # sets
    "SET04_intersect": f"SELECT report_id, num FROM {BLOCKS} b WHERE lang = 'en' AND num <> '' INTERSECT SELECT report_id, num FROM {BLOCKS} b WHERE lang <> 'en' AND num <> ''",
    "SET05_except": f"SELECT report_id, num FROM {BLOCKS} b WHERE lang = 'en' AND num <> '' EXCEPT SELECT report_id, num FROM {BLOCKS} b WHERE lang <> 'en' AND num <> ''",
    "SET06_union_distinct": "SELECT lower(trim(pref_label)) AS term FROM {concepts} WHERE pref_label IS NOT NULL UNION SELECT lower(pref_label) FROM {thesaurus}",
    "SET08_dedup_bytes": "SELECT source_file, md5(text) AS content, count(*) AS copies FROM {pdf_documents} WHERE text IS NOT NULL GROUP BY source_file, md5(text)",
    "SET09_log_unique": "SELECT finding, topic, min(doc_id) AS first_doc FROM (SELECT doc_id, source AS topic, CASE WHEN text IS NULL THEN 'no text' WHEN lang IS NULL THEN 'no language' ELSE 'fine' END AS finding FROM {documents}) GROUP BY finding, topic",
    # routing
    "CCH01_cache_key": "SELECT doc_id, sha2{bits}(concat_ws('|', 'v1', coalesce(source, ''), coalesce(lang, '')){bits_end}) AS cache_key FROM {documents}",
    "SNK14_rating_append": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type",
}
#: Where the two engines spell a function differently: (Spark, the checking engine).
SPELLINGS = {
    "explode_children": ("explode(children)", "unnest(children)"),
    "explode_creators": ("explode(creators)", "unnest(creators)"),
    "g": ("", ", 'g'"),
    "first_creator": ("get(creators, 0)", "creators[1]"),
    "first_collection": ("get(collections, 0)", "collections[1]"),
    "ignore": ("", " IGNORE NULLS"),
    "ignored": (" IGNORE NULLS", ""),
    "bits": ("", ""),
    "bits_end": (", 256", ""),
}


def _spell(statement: str, engine: int) -> str:
    for name, both in SPELLINGS.items():
        statement = statement.replace("{" + name + "}", both[engine])
    return statement


def _query(statement: str):
    return lambda spark, sf: run(spark, sf, _spell(statement, 0))


QUERIES = {name: _query(s) for name, s in STATEMENTS.items()}
ORACLES = {name: typed(oracle(_spell(s, 1))).replace("sha2(", "sha256(").replace("LEFT ANTI JOIN", "ANTI JOIN") for name, s in STATEMENTS.items()}
