"""Linking, listing, auditing and answering operators written in SQL; see relational.py for the spellings."""

from __future__ import annotations

from folioscope.queries.relational import BLOCKS, NODES, PAGES, PARAS, SPANS, SPELLINGS, _query, oracle, typed

SPELLINGS.update({
    "explode_alts": ("explode(alt_labels)", "unnest(alt_labels)"),
    "explode_hidden": ("explode(hidden_labels)", "unnest(hidden_labels)"),
    "explode_broader": ("explode(broader)", "unnest(broader)"),
    "explode_meta": ("explode(map_entries(map_filter(metadata, (k, v) -> v IS NOT NULL AND v <> '')))", "unnest(list_filter(map_entries(metadata), lambda x: x.value IS NOT NULL AND x.value <> ''))"),
    "explode_definitions": ("explode(definitions)", "unnest(definitions)"),
    "explode_words": ("explode(split(lower(pref_label), ' '))", "unnest(string_split(lower(pref_label), ' '))"),
    "explode_title_words": ("explode(split(lower(title), ' '))", "unnest(string_split(lower(title), ' '))"),
    "words_of_text": ("explode(split(text, ' '))", "unnest(string_split(text, ' '))"),
    "lev": ("levenshtein", "levenshtein"),
    "alts_text": ("array_join(array_sort(alt_labels), '; ')", "array_to_string(list_sort(alt_labels), '; ')"),
    "children_index": ("posexplode(children) AS (pos, child)", "unnest(range(0, len(children))) AS pos, unnest(children) AS child"),
    "strip": ("regexp_replace(lower(title), '[^a-z0-9]', '')", "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"),
    "strip_text": ("regexp_replace(lower(text), '[^a-z0-9]', '')", "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"),
    "mask_digits": ("regexp_replace(text, '[0-9]+', '#')", "regexp_replace(text, '[0-9]+', '#', 'g')"),
    "dehyphenate": ("regexp_replace(text, '([a-z])-\\\\n([a-z])', '$1$2')", "regexp_replace(text, '([a-z])-\\n([a-z])', '\\1\\2', 'g')"),
    "n_caps": ("regexp_count(text, '[A-Z]{3,}')", "len(regexp_extract_all(text, '[A-Z]{3,}'))"),
    "n_years": ("regexp_count(text, '(19|20)[0-9][0-9]')", "len(regexp_extract_all(text, '(19|20)[0-9][0-9]'))"),
})

_WORKS = "(SELECT item_key, max(title) AS title, max(item_date) AS item_date, max(doi) AS doi FROM {zotero} GROUP BY item_key)"
_DOI = "regexp_extract(lower({}), '(10[.][0-9]+/[^ ]+)', 1)"

STATEMENTS = {
    "FLT03_reference_exclusion": f"SELECT chunk_id, page FROM {PAGES} p WHERE coalesce(section, 'body') <> 'references' AND NOT (text LIKE 'References%')",
    "FLT04_named_group": "SELECT doc_id, assessment FROM {documents} WHERE lower(assessment) IN ('assessment-1', 'assessment-2') OR assessment LIKE '%global%'",
    "FLT08_expert_choice": "SELECT s_suppkey, s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) AND lower(s_name) LIKE '%1%' AND s_acctbal > 0",
    "FLT12_strict_country": "SELECT c_nationkey, count(*) AS n FROM {customer} LEFT ANTI JOIN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 4) n ON n_nationkey = c_nationkey GROUP BY c_nationkey",
    "FLT18_null_key_drop": "SELECT DISTINCT source_id, e.key AS k, e.value AS v FROM (SELECT source_id, {explode_meta} AS e FROM {sources}) x",
    "FLT19_quote_length": f"SELECT para_id, length(quote) AS size FROM (SELECT para_id, regexp_extract(text, '[“\"]([^”\"]+)[”\"]', 1) AS quote FROM {PARAS} p) x WHERE length(quote) BETWEEN 3 AND 1500",
    "PRJ01_ttl_metadata": "SELECT doc_id, assessment, chapter, lang, source, concat_ws(';', nullif(lang, ''), nullif(assessment, '')) AS codes FROM {documents}",
    "PRJ10_concept_profile": "SELECT canon_id, concat_ws(' | ', pref_label, {alts_text}, definition) AS profile FROM {thesaurus}",
    "PRJ13_document_metadata": f"SELECT report_id, lang, min(text) AS title, min(substring(report_id, 1, 4)) AS year FROM {BLOCKS} b WHERE kind = 'title' GROUP BY report_id, lang",
    "JOIN17_multi_value_split": "WITH w AS (SELECT DISTINCT item_key, {explode_creators} AS name FROM {zotero}), k AS (SELECT DISTINCT name FROM w WHERE length(name) > 4) SELECT w.item_key, count(*) AS names, count(k.name) AS resolved FROM w LEFT JOIN k ON k.name = w.name GROUP BY w.item_key",
    "JOIN19_future_sessions": f"WITH h AS (SELECT DISTINCT source_file FROM {BLOCKS} b WHERE kind = 'heading' AND (text LIKE '%session%' OR text LIKE '%venue%')) SELECT b.block_id, CASE WHEN b.kind = 'heading' THEN 0 ELSE 1 END AS part FROM {BLOCKS} b LEFT SEMI JOIN h ON h.source_file = b.source_file",
    "JOIN23_key_to_background": "WITH k AS (SELECT doc_id, assessment, chapter FROM {documents} WHERE text LIKE 'Key message%'), g AS (SELECT doc_id AS background, assessment, chapter FROM {documents} WHERE source = 'policy_summaries'), a AS (SELECT k.doc_id, g.background, 1 AS tier FROM k JOIN g ON g.assessment = k.assessment AND g.chapter = k.chapter UNION ALL SELECT k.doc_id, g.background, 2 FROM k JOIN g ON g.assessment = k.assessment) SELECT doc_id, min(tier) AS tier, count(DISTINCT CASE WHEN tier = 1 THEN background END) AS same_chapter, count(DISTINCT background) AS linked FROM a GROUP BY doc_id",
    "JOIN25_reference_cascade": f"WITH s AS (SELECT source_id, max(coalesce(metadata['title'], metadata['name'], metadata['ref_title'])) AS title, max({_DOI.format(chr(39).join(['coalesce(metadata[', 'doi', '], metadata[', 'url', '], metadata[', 'identifier', '])']))}) AS doi FROM {{sources}} GROUP BY source_id), z AS (SELECT item_key, {{strip}} AS k, {_DOI.format('doi')} AS doi FROM {_WORKS} w), t AS (SELECT source_id, {{strip}} AS k, doi FROM s), m AS (SELECT t.source_id, z.item_key, 1 AS tier FROM t JOIN z ON t.doi = z.doi AND t.doi <> '' UNION ALL SELECT t.source_id, z.item_key, 2 FROM t JOIN z ON t.k = z.k AND length(t.k) >= 8 UNION ALL SELECT t.source_id, z.item_key, 3 FROM t JOIN z ON substring(t.k, 1, 34) = substring(z.k, 1, 34) AND length(t.k) >= 34) SELECT source_id, item_key, min(tier) AS tier FROM m GROUP BY source_id, item_key",
    "JOIN29_broken_links": "WITH r AS (SELECT concept_id, u, CAST(nullif(regexp_extract(u, '/([0-9]+)/?$', 1), '') AS BIGINT) AS target FROM (SELECT concept_id, {explode_broader} AS u FROM {concepts}) x) SELECT DISTINCT r.concept_id, r.u FROM r LEFT ANTI JOIN (SELECT DISTINCT concept_id AS id FROM {concepts}) c ON c.id = r.target",
    "JOIN34_spatial": f"SELECT a.para_id, min_by(b.para_id, CAST(abs(a.y0 - b.y0) AS DOUBLE) * 1000000 + b.para_id) AS nearest FROM {PARAS} a JOIN {PARAS} b ON a.source_file = b.source_file AND a.page = b.page AND a.para_id <> b.para_id AND abs(a.y0 - b.y0) < 60 AND abs(a.x0 - b.x0) < 60 GROUP BY a.para_id",
    "JOIN36_containment_part": f"WITH b AS (SELECT * FROM {BLOCKS} x WHERE text IS NOT NULL AND lang = 'en') SELECT p.block_id AS whole, c.block_id AS part FROM b p JOIN b c ON p.report_id = c.report_id AND p.block_id <> c.block_id AND length(c.text) >= 30 AND length(p.text) > length(c.text) AND contains(p.text, c.text)",
    "JOIN38_paragraph_match": f"WITH e AS (SELECT report_id, num, min(seq) AS seq FROM {BLOCKS} b WHERE lang = 'en' AND kind = 'para' AND num <> '' GROUP BY report_id, num), o AS (SELECT report_id, num, min(seq) AS seq FROM {BLOCKS} b WHERE lang <> 'en' AND kind = 'para' AND num <> '' GROUP BY report_id, num) SELECT e.report_id, count(*) AS same_number, count_if(abs(e.seq - o.seq) <= 2) AS near_place FROM e JOIN o ON o.report_id = e.report_id AND o.num = e.num GROUP BY e.report_id",
    "JOIN43_enrichment": f"WITH p AS (SELECT para_id, source_file, page, role, label FROM {PARAS} x WHERE label IS NOT NULL AND label <> ''), c AS (SELECT source_file, page, min(para_id) AS caption FROM {PARAS} x WHERE role = 'caption' GROUP BY source_file, page) SELECT p.para_id, p.label, c.caption, c.caption IS NULL AS missing FROM p LEFT JOIN c ON c.source_file = p.source_file AND c.page = p.page",
    "JOIN46_heading_context": f"WITH e AS (SELECT DISTINCT node_id AS parent, child FROM (SELECT node_id, {{explode_children}} AS child FROM {{nodes}}) x), n AS (SELECT * FROM {NODES} y) SELECT c.node_id, max(p.heading) AS heading, max(g.heading) AS above FROM n c JOIN e ON e.child = c.node_id JOIN n p ON p.node_id = e.parent LEFT JOIN e f ON f.child = p.node_id LEFT JOIN n g ON g.node_id = f.parent GROUP BY c.node_id",
    "AGG06_hyphen_evidence": "WITH w AS (SELECT lang, lower(w) AS w FROM (SELECT coalesce(lang, '-') AS lang, {words_of_text} AS w FROM {documents}) x), h AS (SELECT lang, w, count(*) AS hyphened FROM w WHERE w LIKE '%_-_%' GROUP BY lang, w), j AS (SELECT lang, w, count(*) AS joined FROM w WHERE w NOT LIKE '%-%' GROUP BY lang, w) SELECT h.lang, h.w, h.hyphened, coalesce(j.joined, 0) AS joined FROM h LEFT JOIN j ON j.lang = h.lang AND j.w = replace(h.w, '-', '')",
    "AGG08_casing_mode": "WITH w AS (SELECT lang, w, lower(w) AS k, count(*) AS n FROM (SELECT coalesce(lang, '-') AS lang, {words_of_text} AS w FROM {documents}) x WHERE length(w) > 3 GROUP BY lang, w), r AS (SELECT *, row_number() OVER (PARTITION BY lang, k ORDER BY n DESC, w) AS place, sum(n) OVER (PARTITION BY lang, k) AS total FROM w) SELECT lang, k, w, n FROM r WHERE place = 1 AND total >= 3 AND n * 2 > total",
    "AGG19_catalogue_block": f"SELECT report_id, count(*) AS decisions, [[text ; / ; seq]] AS listing FROM {BLOCKS} b WHERE lang = 'en' AND (text LIKE 'Approves%' OR text LIKE 'Requests%' OR text LIKE 'Decides%') GROUP BY report_id",
    "WIN17_group_by_mark": f"SELECT source_file, grp, count(*) AS members FROM (SELECT source_file, CAST(sum(CASE WHEN text LIKE '%section%' THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM {BLOCKS} b WHERE kind = 'para') x GROUP BY source_file, grp",
    "WIN20_split_sections": f"WITH h AS (SELECT source_file, seq, block_id, CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section, kind FROM {BLOCKS} b) SELECT source_file, section, count(*) AS blocks, min(block_id) AS first_block FROM h GROUP BY source_file, section",
    "WIN21_table_title": f"SELECT block_id, title FROM (SELECT block_id, kind, lag(text) OVER (PARTITION BY source_file ORDER BY seq, block_id) AS title FROM {BLOCKS} b) x WHERE kind = 'table'",
    "SRT10_inferred_caps": "SELECT scheme, concept_id, place FROM (SELECT scheme, concept_id, row_number() OVER (PARTITION BY scheme ORDER BY concept_id) AS place FROM (SELECT DISTINCT scheme, concept_id FROM {concepts} WHERE scheme IS NOT NULL) x) y WHERE place <= 8",
    "SRT11_quality_max": "WITH k AS (SELECT {strip} AS k, title, concat(CASE WHEN title LIKE '%...%' THEN '0' ELSE '1' END, CASE WHEN upper(title) = title THEN '0' ELSE '1' END, lpad(CAST(length(title) AS STRING), 4, '0'), title) AS quality FROM {zotero}) SELECT k, max_by(title, quality) AS best, count(*) AS variants FROM k GROUP BY k",
    "SRT13_examples": "SELECT source, [[CAST(doc_id AS STRING) ; / ; doc_id]] AS examples FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM {documents}) x WHERE place <= 3 GROUP BY source",
    "SRT14_plan_k": "SELECT source, CASE source WHEN 'reference_lists' THEN 30 WHEN 'knowledge_gaps' THEN 100 ELSE 3 END AS k FROM (SELECT DISTINCT source FROM {documents}) x",
    "SET07_subset_test": "WITH w AS (SELECT DISTINCT canon_id, {explode_words} AS w FROM {thesaurus}), n AS (SELECT canon_id, count(*) AS n FROM w GROUP BY canon_id), b AS (SELECT a.canon_id AS part, c.canon_id AS whole, count(*) AS common FROM w a JOIN w c ON c.w = a.w AND c.canon_id <> a.canon_id GROUP BY a.canon_id, c.canon_id) SELECT b.part, b.whole FROM b JOIN n ON n.canon_id = b.part AND n.n = b.common",
    "STR15_dehyphenate": "SELECT doc_id, md5({dehyphenate}) AS hash FROM {documents} WHERE text IS NOT NULL",
    "STR18_superscripts": f"SELECT span_id, translate(text, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS lowered, sup FROM {SPANS} s WHERE sup OR text <> translate(text, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')",
    "STR25_role_parse": "SELECT DISTINCT doc_id, regexp_extract(text, '[(](co-chair|reviewer|member|observer)[)]', 1) AS first_role FROM {documents} WHERE text LIKE '%(co-chair)%' OR text LIKE '%(reviewer)%' OR text LIKE '%(member)%' OR text LIKE '%(observer)%'",
    "STR31_child_position": "SELECT DISTINCT node_id, child, pos FROM (SELECT node_id, {children_index} FROM {nodes}) x",
    "STR36_role_prefix": f"SELECT DISTINCT style, CASE WHEN style LIKE 'Normal%' THEN 'normal' WHEN 'List Paragraph' LIKE concat(style, '%') THEN 'list' ELSE 'other' END AS role FROM {BLOCKS} b WHERE style IS NOT NULL",
    "STR38_reference_boundary": f"SELECT chunk_id, text LIKE '(____)%' OR lower(substring(text, 1, 1)) = substring(text, 1, 1) AS continues FROM {PAGES} p WHERE text IS NOT NULL",
    "RTE04_chapter_question": "SELECT doc_id, lower(text) LIKE '%chapter%' AND {n_years} > 0 AS about_chapter FROM {documents} WHERE text IS NOT NULL",
    "RTE07_followup_input": "SELECT user_id, [[event_type ; > ; place]] AS earlier FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM {events}) x WHERE place <= 6 GROUP BY user_id",
    "RTE08_table_answer": "SELECT assessment, count(*) AS gaps, [[CAST(doc_id AS STRING) ; , ; doc_id]] AS ids FROM {documents} WHERE source = 'knowledge_gaps' AND assessment IS NOT NULL GROUP BY assessment",
    "RTE09_select_gaps": "SELECT d.doc_id FROM {documents} d LEFT SEMI JOIN (SELECT DISTINCT assessment FROM {documents} WHERE source = 'policy_summaries' AND assessment IS NOT NULL) c ON c.assessment = d.assessment WHERE d.source = 'knowledge_gaps'",
    "RTE11_prompt": "SELECT doc_id, concat('Task: list the facts.', chr(10), 'Context: ', text, chr(10), 'Source: ', coalesce(source, '-')) AS prompt FROM {documents} WHERE text IS NOT NULL AND doc_id IS NOT NULL",
    "RTE14_definitions_block": "SELECT canon_id, concat(pref_label, ': ', coalesce(definition, 'no definition'), CASE WHEN {alts_text} <> '' THEN concat(' (also ', {alts_text}, ')') ELSE '' END) AS entry FROM {thesaurus}",
    "RTE17_quote_report": "SELECT source, count(*) AS answers, count_if(text LIKE '%“%') AS with_quotes, count_if(text LIKE '%10.99%') AS with_dois FROM {documents} GROUP BY source",
    "SNK05_manifest": f"SELECT source_file, min(file_sha256) AS hash, count(*) AS chunks, count_if(section = 'references') AS reference_chunks, count(*) = max(page_count) AS one_per_page FROM {PAGES} p GROUP BY source_file",
    "SNK09_markdown": f"SELECT source_file, [[concat(CASE kind WHEN 'title' THEN '# ' WHEN 'heading' THEN '## ' ELSE '' END, text) ; / ; seq]] AS markdown FROM {BLOCKS} b WHERE text IS NOT NULL GROUP BY source_file",
    "SNK15_conversations": "SELECT user_id, turns, row_number() OVER (ORDER BY last_ts DESC, user_id) AS place FROM (SELECT user_id, count(*) AS turns, max(ts) AS last_ts FROM {events} GROUP BY user_id ORDER BY last_ts DESC, user_id LIMIT 50) x",
    "DOC01_line_role": f"SELECT span_id, CASE WHEN font_size >= 16 THEN 'h1' WHEN font_size >= 13 AND bold THEN 'h2' WHEN sup THEN 'mark' WHEN font_size < 8 THEN 'small' WHEN bold THEN 'strong' ELSE 'body' END AS role FROM {SPANS} s WHERE text IS NOT NULL",
    "DOC02_build_paras": f"SELECT source_file, page, block, count(*) AS spans, [[text ; / ; seq]] AS text FROM {SPANS} s WHERE text IS NOT NULL GROUP BY source_file, page, block",
    "DOC07_glossary_entries": f"SELECT source_file, block, min_by(text, seq) AS term, count(*) AS parts FROM {SPANS} s WHERE text IS NOT NULL AND bold GROUP BY source_file, block",
    "DOC11_document_info": f"SELECT source_file, min(lang) AS lang, min(regexp_extract(source_file, '^rep-([0-9]+)', 1)) AS year, min(CASE WHEN kind = 'title' THEN text END) AS title FROM {BLOCKS} b GROUP BY source_file",
    "DOC12_language_diff": f"WITH s AS (SELECT report_id, lang, [[kind ; , ; seq]] AS shape FROM {BLOCKS} b GROUP BY report_id, lang) SELECT a.report_id, b.lang, a.shape = b.shape AS same_shape FROM s a JOIN s b ON b.report_id = a.report_id WHERE a.lang = 'en' AND b.lang <> 'en'",
    "SRC02_layout_scan": f"SELECT source_file, count(*) AS spans, count(DISTINCT page) AS pages, count_if(bold) AS bold_spans, count_if(sup) AS marks FROM {SPANS} s GROUP BY source_file",
    "SRC15_csv_filter": "SELECT source_type, source_file, count(DISTINCT source_id) AS n FROM {sources} WHERE source_type = 'pdf' GROUP BY source_type, source_file",
    "SRC09_concept_enumeration": "SELECT DISTINCT uri FROM (SELECT uri FROM {thesaurus} UNION SELECT trim(uri) AS uri FROM {concepts}) x",
    "SRC08_overlay_union": "SELECT DISTINCT canon_id, label FROM (SELECT canon_id, pref_label AS label FROM {thesaurus} UNION ALL SELECT canon_id, {explode_alts} AS label FROM {thesaurus} UNION ALL SELECT canon_id, {explode_hidden} AS label FROM {thesaurus}) x",
    "SRC27_latest_version": "SELECT doc_source, max_by(doc_id, n) AS latest FROM (SELECT source AS doc_source, doc_id, CAST(doc_id AS DOUBLE) AS n FROM {documents} WHERE source IS NOT NULL) x GROUP BY doc_source",
}


def _both(statement: str) -> str:
    """Spellings may stand inside spellings' own statements, so names are put in before tables."""
    for name, both in SPELLINGS.items():
        statement = statement.replace("{" + name + "}", both[1])
    return typed(oracle(statement)).replace("sha2(", "sha256(").replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")


QUERIES = {name: _query(s) for name, s in STATEMENTS.items()}
ORACLES = {name: _both(s) for name, s in STATEMENTS.items()}
