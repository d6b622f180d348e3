"""Parsers, graphs, lexicon, packing, streams and sinks over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import graph, lexicon, outline, packing, people, routing, sequences
from folioscope.operators.hierarchy import clean_links, reached
from folioscope.plans.session import cut, shared_folder
from folioscope.queries.hierarchies import concept_graph, node_graph
from folioscope.queries.relational import typed
from folioscope.sources import folders, markup
from folioscope.sources.store import Store
from folioscope.sources.tables import first_delivery, table
from folioscope.streaming import streams


def _blocks(spark, sf) -> DataFrame:
    return first_delivery(table(spark, sf, "blocks", ["block_id", "source_file", "seq", "kind", "num", "fmt", "ilvl", "text", "loaded_at"]), "block_id")


def _akn_files(spark, sf) -> DataFrame:
    """Each report as a document with paragraphs (a note inside each) and one-row tables."""
    text = T.html_escape(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F]", ""))
    body = F.when(F.col("kind") == "para", F.concat(F.lit("<paragraph><num>"), T.html_escape(F.coalesce("num", F.lit(""))), F.lit("</num><content><p>"), text, F.lit("<authorialNote><p>A note.</p></authorialNote></p></content></paragraph>")))
    body = body.when(F.col("kind") == "table", F.concat(F.lit("<table><tr><th>Name</th></tr><tr><td>"), text, F.lit("</td></tr></table>"))).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
    files = _blocks(spark, sf).select("source_file", "seq", body.alias("part")).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "").alias("parts"))
    return files.select("source_file", F.concat(F.lit("<akomaNtoso><body>"), "parts", F.lit("</body></akomaNtoso>")).alias("content"))


def akn_scan(spark, sf):
    rows = markup.parse_akn(_akn_files(spark, sf))
    return rows.groupBy("source_file", "kind").agg(F.count("*").alias("n"), F.sum(F.length(T.letters_only(F.regexp_replace("text", "^Name: ", "")))).alias("letters"))


def element_scan(spark, sf):
    return markup.parse_elements(_akn_files(spark, sf)).groupBy("source_file", "element").agg(F.count("*").alias("n"))


def excluded_subtree(spark, sf):
    """Paragraphs of the documents, and how many still hold the text of the note inside them."""
    rows = markup.parse_akn(_akn_files(spark, sf)).where("kind = 'paragraph'")
    return rows.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("A note.")).alias("with_note"))


def _tables(spark, sf, headers: str) -> DataFrame:
    """Each report's blocks as a table whose first cell spans the rows of one kind."""
    text = F.concat(F.lit("<td>"), F.col("block_id").cast("string"), F.lit("</td></tr>"))
    kinds = _blocks(spark, sf).select("source_file", "kind", "block_id", text.alias("cell")).where("kind is not null").groupBy("source_file", "kind").agg(F.array_sort(F.collect_list(F.struct("block_id", "cell"))).alias("cells"))
    body = F.concat(F.lit("<tr><td rowspan='"), F.size("cells").cast("string"), F.lit("'>"), "kind", F.lit("</td>"), F.array_join(F.transform("cells", lambda x: x["cell"]), "<tr>"))
    files = kinds.select("source_file", "kind", body.alias("body")).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "body"))), lambda x: x["body"]), "").alias("body"))
    return files.select("source_file", F.concat(F.lit("<doc><body><table>" + headers), "body", F.lit("</table></body></doc>")).alias("content"))


def span_carry(spark, sf):
    rows = markup.parse_akn(_tables(spark, sf, "<tr><th>Kind</th><th>Block</th></tr>"))
    return rows.select("source_file", "table_row", "text")


def column_labels(spark, sf):
    """Rows labelled by two header rows, of which one cell spans both columns."""
    rows = markup.parse_akn(_tables(spark, sf, "<tr><th colspan='2'>Report</th></tr><tr><th>Kind</th><th>Block</th></tr>"))
    return rows.select("source_file", "text")


def rdfxml_scan(spark, sf):
    rows = table(spark, sf, "thesaurus", ["uri", "pref_label", "alt_labels"])
    quote = lambda name, c: F.concat(F.lit(f'<s:{name} xml:lang="en">'), T.html_escape(c), F.lit(f"</s:{name}>"))
    alts = F.array_join(F.transform(F.coalesce("alt_labels", F.array().cast("array<string>")), lambda x: quote("altLabel", x)), "")
    one = F.concat(F.lit('<s:Concept rdf:about="'), "uri", F.lit('">'), quote("prefLabel", F.col("pref_label")), alts, F.lit("</s:Concept>"))
    files = rows.select(F.concat(F.lit("part-"), F.element_at(F.split("uri", "/"), -1).cast("int") % 8, F.lit(".rdf")).alias("source_file"), one.alias("block")).groupBy("source_file").agg(F.array_join(F.collect_list("block"), "").alias("blocks"))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://www.w3.org/2004/02/skos/core#">'
    content = files.select("source_file", F.concat(F.lit(head), "blocks", F.lit("</rdf:RDF>")).alias("content"))
    triples = markup.parse_triples(content).where("o_kind = 'literal'")
    return triples.select(F.col("s").alias("uri"), F.regexp_extract("p", "#(.*)$", 1).alias("property"), F.col("o").alias("value")).distinct()


def _folder(spark, files: DataFrame) -> DataFrame:
    """The files written to a shared folder and read from there."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    folders.write_files(files, path)
    return folders.read_folder(spark, path, "*.txt").withColumn("source_file", F.regexp_extract("source_file", "file=([^/]*)/", 1))


def folder_scan(spark, sf):
    """Chunks of a folder of documents, one of which cannot be read and comes out as an error row."""
    broken = spark.createDataFrame([("broken", "<akomaNtoso><body>")], "source_file string, content string")
    rows = markup.parse_akn(_folder(spark, _akn_files(spark, sf).unionByName(broken)))
    return rows.groupBy("source_file", "kind").agg(F.count("*").alias("n"))


def turtle_folder_scan(spark, sf):
    triples = markup.parse_triples(_folder(spark, _turtle(spark, sf))).where("o_kind = 'literal' and s not like '_:%'")
    return triples.groupBy("source_file").agg(F.count_distinct("s").alias("entries"), F.count("*").alias("labels"))


def collection_expand(spark, sf):
    """The paragraphs under each division or attachment, however nested; loops do no harm."""
    rows = table(spark, sf, "nodes", ["node_id", "tag"]).distinct()
    members, links = node_graph(spark, sf)
    starts = rows.where("tag in ('division', 'attachment')").select(F.lit("node").alias("part"), F.col("node_id").alias("id"))
    below = reached(starts, cut(clean_links(members, links)))
    leaves = rows.where("tag = 'paragraph'").select(F.col("node_id").alias("id"))
    return below.join(leaves, "id", "left_semi").groupBy(F.col("top").alias("collection")).agg(F.count("*").alias("n_members"))


#: Ranks of the kinds of blocks in a report; headings go down by their level, paragraphs by theirs.
RANK = "CASE kind WHEN 'title' THEN 0 WHEN 'annex_header' THEN 1 WHEN 'annex_title' THEN 1 WHEN 'heading' THEN 2 + least(coalesce(ilvl, 0), 2) WHEN 'para' THEN 5 + least(coalesce(ilvl, 0), 2) WHEN 'table' THEN 7 END"


def block_tree(spark, sf):
    """Each block with the block that it stands under."""
    return outline.parents(_blocks(spark, sf), "source_file", ["seq"], "block_id", F.expr(RANK), 8)


def traceability(spark, sf):
    """All section numbers that a text names, with the most specific section there is."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    named = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"section ([0-9]+(?:\.[0-9]+)+)"), 1)).alias("reference"))
    places = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\n)Section ([0-9]+(?:\.[0-9]+)+)"), 1)).alias("place")).unionByName(table(spark, sf, "nodes", [F.regexp_extract("num", r"^([0-9]+(?:\.[0-9]+)+)", 1).alias("place")]))
    return outline.most_specific(named, places.where("place <> ''")).withColumnRenamed("id", "doc_id")


def language_order(spark, sf):
    """How much of each report's structure (kinds and numbers) its two languages share, and how much of that in the same order."""
    rows = first_delivery(table(spark, sf, "blocks", ["block_id", "report_id", "lang", "seq", "kind", "num", "loaded_at"]), "block_id").where("num <> ''")
    keyed = rows.select(F.col("report_id").alias("group"), "lang", F.concat_ws(" ", "kind", "num").alias("value"), F.struct("seq", "block_id").alias("place"))
    ranked = keyed.withColumn("at", F.row_number().over(Window.partitionBy("group", "lang").orderBy("place"))).drop("place")
    return sequences.agreement(ranked.where("lang = 'en'").drop("lang"), ranked.where("lang <> 'en'").drop("lang")).withColumnRenamed("group", "report_id")


def _questions(spark, sf) -> DataFrame:
    """The first line of every text as a question put."""
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("question"))


def question_route(spark, sf):
    return _questions(spark, sf).select("doc_id", routing.route(F.col("question")).alias("route"))


def question_kind(spark, sf):
    return _questions(spark, sf).select("doc_id", routing.kind(F.col("question")).alias("kind"))


def question_plan(spark, sf):
    return _questions(spark, sf).select("doc_id", routing.plan(F.col("question")).alias("p")).select("doc_id", "p.k", "p.per_group")


def relative_session(spark, sf):
    """Questions about the last or next meeting, with the number that the reports give."""
    latest = table(spark, sf, "blocks", ["report_id"]).agg(F.max(F.regexp_extract("report_id", "([0-9]+)$", 1).cast("int")).alias("latest"))
    asked = _questions(spark, sf).where("question is not null").withColumn("question", F.concat(F.col("question"), F.when(F.col("doc_id") % 3 == 0, " What of the last session?").when(F.col("doc_id") % 3 == 1, " And the next meeting?").otherwise("")))
    # One row, the highest number.
    return asked.join(F.broadcast(latest), how="cross").select("doc_id", F.md5(routing.with_latest(F.col("question"), F.col("latest"))).alias("hash"))


def _turtle(spark, sf) -> DataFrame:
    rows = table(spark, sf, "thesaurus", ["uri", "pref_label", "alt_labels", "definition"])
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"@en'))
    alts = F.array_join(F.transform(F.coalesce("alt_labels", F.array().cast("array<string>")), lambda x: F.concat(F.lit(" ;\n  skos:altLabel "), quote(x))), "")
    one = F.concat(F.lit("<"), "uri", F.lit("> a skos:Concept ;\n  skos:prefLabel "), quote(F.col("pref_label")), alts, F.coalesce(F.concat(F.lit(" ;\n  skos:definition [ rdf:value "), quote(F.col("definition")), F.lit(" ]")), F.lit("")), F.lit(" .\n"))
    files = rows.select(F.concat(F.lit("part-"), F.element_at(F.split("uri", "/"), -1).cast("int") % 8, F.lit(".ttl")).alias("source_file"), one.alias("block")).groupBy("source_file").agg(F.array_join(F.collect_list("block"), "").alias("blocks"))
    return files.select("source_file", F.concat(F.lit("@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"), "blocks").alias("content"))


def turtle_scan(spark, sf):
    triples = markup.parse_triples(_turtle(spark, sf)).where("o_kind = 'literal' and s not like '_:%'")
    return triples.select(F.col("s").alias("uri"), F.regexp_extract("p", "#(.*)$", 1).alias("property"), F.col("o").alias("value")).distinct()


def triple_star(spark, sf):
    """Concepts with their definition through the node between."""
    t = markup.parse_triples(_turtle(spark, sf))
    link = t.where("p like '%definition'").select(F.col("s").alias("uri"), F.col("o").alias("node"), "source_file")
    value = t.where("p like '%value'").select(F.col("s").alias("node"), F.col("o").alias("definition"), "source_file")
    return link.join(value, ["node", "source_file"]).select("uri", "definition")


def _node_edges(spark, sf) -> DataFrame:
    rows = table(spark, sf, "nodes", ["node_id", "children"])
    ids = rows.select("node_id").distinct()
    edges = rows.select(F.col("node_id").alias("parent"), F.explode("children").alias("child")).distinct()
    return edges.join(ids.withColumnRenamed("node_id", "child"), "child", "left_semi")


def ancestors(spark, sf):
    e = _node_edges(spark, sf)
    return graph.closure(e.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).select(F.col("src").alias("node_id"), F.col("dst").alias("ancestor"), "depth")


def descendants(spark, sf):
    e = _node_edges(spark, sf)
    return graph.closure(e.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).select(F.col("src").alias("node_id"), F.col("dst").alias("descendant"), "depth")


def siblings(spark, sf):
    e = _node_edges(spark, sf)
    other = e.select("parent", F.col("child").alias("sibling"))
    return e.join(other, "parent").where("child <> sibling").groupBy(F.col("child").alias("node_id")).agg(F.count_distinct("sibling").alias("n_siblings"))


def entity_merge(spark, sf):
    """Items joined by an equal folded title or an equal DOI, however many steps apart."""
    rows = first_delivery(table(spark, sf, "zotero", ["item_key", "title", "doi", "loaded_at"]), "item_key")
    keys = rows.select("item_key", F.explode(F.array(F.concat(F.lit("t:"), T.loose(F.col("title"))), F.concat(F.lit("d:"), F.get(T.dois(F.col("doi")), F.lit(0))))).alias("k")).where("k is not null and length(k) > 2")
    least = keys.groupBy("k").agg(F.min("item_key").alias("a"))
    edges = keys.join(least, "k").where("item_key <> a").select("a", F.col("item_key").alias("b"))
    return graph.components(edges).select(F.col("id").alias("item_key"), "component")


def _texts(spark, sf) -> DataFrame:
    """(text_id, text): all documents, labels of records, and definitions."""
    docs = table(spark, sf, "documents", [F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("text_id"), "text"])
    records = table(spark, sf, "concepts", ["concept_id", "pref_label", "alt_labels", "definitions"])
    each = F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")), F.coalesce("definitions", F.array().cast("array<string>"))))
    labels = records.select(F.col("concept_id"), each.alias("text")).where("text is not null").distinct()
    entries = table(spark, sf, "thesaurus", [F.concat(F.lit("entry-"), F.col("canon_id").cast("string")).alias("text_id"), F.col("definition").alias("text")])
    return docs.unionByName(labels.select(F.concat(F.lit("record-"), F.col("concept_id").cast("string"), F.lit("-"), F.md5("text")).alias("text_id"), "text")).unionByName(entries)


def _mentions(spark, sf):
    return lexicon.mentions(_texts(spark, sf), "text_id", lexicon.labels_of(table(spark, sf, "thesaurus")))


def dictionary_ngram(spark, sf):
    return _mentions(spark, sf).select("text_id", "uri")


def document_frequency(spark, sf):
    """In how many texts each entry is named."""
    return lexicon.document_frequency(_mentions(spark, sf), "text_id")


def generic_concepts(spark, sf, most: int = 30):
    """Entries that at most so many texts name, with how many do."""
    named = document_frequency(spark, sf)
    return table(spark, sf, "thesaurus", ["uri"]).join(named, "uri", "left").select("uri", F.coalesce("n_texts", F.lit(0)).alias("named")).where(F.col("named") <= most)


def inferred_links(spark, sf, most: int = 8):
    """For each entry, the other entries whose definition names it, the shortest definitions first."""
    entries = table(spark, sf, "thesaurus", ["uri", "definition"]).where("definition is not null")
    found = lexicon.mentions(entries.select(F.col("uri").alias("defined_by"), F.col("definition").alias("text")), "defined_by", lexicon.labels_of(table(spark, sf, "thesaurus")))
    sized = found.where("uri <> defined_by").join(entries.select(F.col("uri").alias("defined_by"), F.length("definition").alias("size")), "defined_by")
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("uri").orderBy("size", "defined_by"))).where(F.col("place") <= most).select("uri", "defined_by", "place")


def label_places(spark, sf):
    """Labels in texts with their places, those inside a longer label dropped."""
    found = lexicon.places(_texts(spark, sf), "text_id", lexicon.labels_of(table(spark, sf, "thesaurus")))
    return lexicon.longest_places(found, "text_id").select("text_id", "uri", F.col("at").alias("place"), "n")


def term_hits(spark, sf):
    return lexicon.term_score(_mentions(spark, sf), "text_id")


def expand_query(spark, sf):
    return lexicon.expand(_mentions(spark, sf), table(spark, sf, "thesaurus"), "text_id")


def graph_expansion(spark, sf):
    """The entries nearest to each query text's mentions, widened over the concept graph: parents, children and siblings of the records mapped by label."""
    rows = table(spark, sf, "concepts", ["concept_id", "broader", "narrower", "pref_label"])
    label = rows.where("pref_label is not null").select("concept_id", F.lower(F.trim("pref_label")).alias("label")).distinct()
    _, links = concept_graph(spark, sf)
    edges = links.select("parent", "child").distinct().where("parent is not null and child is not null and parent <> child")
    entry = table(spark, sf, "thesaurus", ["uri", "pref_label"]).select("uri", F.lower("pref_label").alias("label"))
    hits = label.join(entry, "label").select("uri", "concept_id").distinct()
    up = hits.join(edges, hits.concept_id == edges.child).select("uri", F.lit("above").alias("how"), F.col("parent").alias("other"))
    down = hits.join(edges, hits.concept_id == edges.parent).select("uri", F.lit("below").alias("how"), F.col("child").alias("other"))
    sides = up.select("uri", F.col("other").alias("parent")).distinct().join(edges, "parent").select("uri", F.lit("beside").alias("how"), F.col("child").alias("other"))
    return up.unionByName(down).unionByName(sides.join(hits.select("uri", F.col("concept_id").alias("other")), ["uri", "other"], "left_anti")).groupBy("uri", "how").agg(F.count_distinct("other").alias("n"))


def containment(spark, sf):
    """Sentences of stored pages that other tables hold word for word, by letters only."""
    def keyed(df):
        return df.select("*", F.explode(T.sentences(F.col("text"))).alias("sentence")).withColumn("k", T.letters_only(F.col("sentence"))).where("length(k) >= 30")

    pages = keyed(table(spark, sf, "pdf_documents", ["chunk_id", "text"])).select("chunk_id", "k").distinct()
    corpus = keyed(table(spark, sf, "documents", ["text"])).select("k").distinct()
    return pages.join(corpus, "k", "left_semi").groupBy("chunk_id").agg(F.count("*").alias("n_found"))


def fidelity(spark, sf):
    """Share of each page's sentences that the corpus holds."""
    def keyed(df):
        return df.select("*", F.explode(T.sentences(F.col("text"))).alias("sentence")).withColumn("k", T.letters_only(F.col("sentence"))).where("length(k) >= 30")

    pages = keyed(table(spark, sf, "pdf_documents", ["chunk_id", "text"])).select("chunk_id", "k").distinct()
    corpus = keyed(table(spark, sf, "documents", ["text"])).select("k").distinct().withColumn("found", F.lit(1))
    return pages.join(corpus, "k", "left").groupBy("chunk_id").agg(F.round(F.count("found") / F.count("*"), 6).alias("share"))


def batches(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "source", "n_chars"])
    return packing.greedy_batches(docs, "source", "doc_id", "n_chars")


def heaviest_batch(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "source", "n_chars"])
    joined = packing.greedy_batches(docs, "source", "doc_id", "n_chars").join(docs.select("doc_id", "n_chars"), "doc_id")
    return joined.groupBy("source", "batch").agg(F.sum("n_chars").alias("size")).groupBy("source").agg(F.max("size").alias("heaviest"))


def sentence_pieces(spark, sf):
    return packing.sentence_pieces(table(spark, sf, "documents", ["doc_id", "text"]), "doc_id")


def paragraph_pieces(spark, sf):
    return packing.paragraph_pieces(table(spark, sf, "documents", ["doc_id", "text"]), "doc_id")


def list_numbering(spark, sf):
    return packing.number_blocks(_blocks(spark, sf).where("kind = 'para'"), "source_file", "seq", "block_id")


def reading_order(spark, sf):
    """Columns of a page by gaps of more than 60 between left edges, then top to bottom."""
    paras = first_delivery(table(spark, sf, "paras", ["para_id", "source_file", "page", "x0", "y0", "loaded_at"]), "para_id").where("x0 is not null and y0 is not null")
    by_x = Window.partitionBy("source_file", "page").orderBy("x0", "para_id")
    columns = paras.withColumn("_new", F.when(F.col("x0") - F.lag("x0").over(by_x) > 60, 1).otherwise(0)).withColumn("col", F.sum("_new").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    return columns.select("para_id", "col", F.row_number().over(Window.partitionBy("source_file", "page").orderBy("col", "y0", "para_id")).alias("place"))


def window_counts(spark, sf):
    """Events per hour and type, run as a stream over what is there."""
    stream = streams.read_parquet_stream(spark, f"{sf}/events.parquet")
    rows = streams.run_to_table(streams.window_counts(stream), shared_folder(spark))
    return rows.select(F.col("window.start").cast("string").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def csv_round_trip(spark, sf):
    """Written with all fields quoted and read back."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = first_delivery(table(spark, sf, "zotero", ["item_key", "title", "item_date", "loaded_at"]), "item_key").select("item_key", "title", "item_date")
    rows.write.csv(path, header=True, quoteAll=True, escape='"', nullValue="\\N", emptyValue="")
    return spark.read.csv(path, header=True, escape='"', multiLine=True, nullValue="\\N", emptyValue="", schema="item_key string, title string, item_date string")


def _store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "doc_id")


def _hashed(spark, sf) -> DataFrame:
    return table(spark, sf, "documents", ["doc_id", "text", "source"]).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "source")


def upsert(spark, sf):
    """A store made from old rows, brought up to date by a second delivery; the same delivery again changes nothing."""
    docs, store = _hashed(spark, sf), _store(spark)
    store.upsert(docs.where("coalesce(source, '') <> 'web_crawl_b'").withColumn("hash", F.when(F.col("source") == "glossaries", F.lit("old")).otherwise(F.col("hash"))))
    store.upsert(docs)
    store.upsert(docs)
    return store.read().select("doc_id", "hash")


def retag(spark, sf):
    """New metadata for part of a store; fingerprints stay."""
    docs, store = _hashed(spark, sf), _store(spark)
    store.upsert(docs)
    store.retag(docs.where("source like 'web%'").select("doc_id", F.lit("web").alias("source")))
    return store.read().select("doc_id", "hash", "source")


def delete_stale(spark, sf):
    """A store without the rows whose source is gone."""
    docs, store = _hashed(spark, sf), _store(spark)
    store.upsert(docs)
    store.delete_stale(docs.where("source <> 'web_crawl_a'"))
    return store.read().select("doc_id", "hash")


def drop_and_create(spark, sf):
    """A store dropped and made anew holds the new rows alone."""
    docs, store = _hashed(spark, sf), _store(spark)
    store.upsert(docs)
    store.drop()
    store.upsert(docs.where("source = 'glossaries'"))
    return store.read().select("doc_id", "hash")


def failed_rows(spark, sf):
    """Rows that cannot be indexed, written aside with the reason and read back."""
    path = f"{shared_folder(spark)}/failed-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents", ["doc_id", "text", "n_chars"])
    reason = F.when(F.col("text").isNull(), "no text").when(F.trim("text") == "", "blank").when(F.col("n_chars") > 20000, "too long")
    rows.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("size"), reason.alias("reason")).where("reason is not null").write.json(path)
    return spark.read.schema("doc_id long, size long, reason string").json(path)


def people_reconcile(spark, sf):
    """Surnames of library items, cited sources and lists of participants: the first source's spelling, and where they differ."""
    items = table(spark, sf, "zotero", ["creators"]).select(F.explode("creators").alias("name"))
    field = F.coalesce(*[F.col("metadata")[k] for k in ("authors", "creator", "by")])
    cited = table(spark, sf, "sources", ["metadata"]).select(F.explode(T.split_names(field)).alias("name"))
    entry = F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\. [^\n,]+), [^\n(]+\([a-z-]+\)"), 1))
    listed = table(spark, sf, "documents", ["text"]).select(entry.alias("name"))
    return people.reconciled([df.select(people.surname(F.col("name")).alias("key"), "name") for df in (listed, items, cited)], ["name"])


QUERIES = {
    "SRC11_folder_scan": folder_scan, "SRC04_turtle_folder_scan": turtle_folder_scan, "JOIN12_collection_expand": collection_expand, "DOC09_block_tree": block_tree, "JOIN39_sequence_align": language_order, "JOIN21_traceability": traceability,
    "RTE01_route": question_route, "RTE03_chunk_type": question_kind, "RTE06_plan_query": question_plan, "RTE05_relative_session": relative_session,
    "SRC10_akn_scan": akn_scan, "SRC12_element_scan": element_scan, "SRC07_rdfxml_scan": rdfxml_scan, "FLT15_excluded_subtree": excluded_subtree, "WIN15_span_carry": span_carry, "STR32_column_labels": column_labels,
    "FLT13_generic_concept": generic_concepts, "JOIN45_inferred_links": inferred_links, "JOIN14_label_places": label_places, "JOIN15_label_mention": dictionary_ngram, "JOIN44_graph_expansion": graph_expansion, "SRC05_turtle_scan": turtle_scan, "JOIN05_triple_star": triple_star,
    "JOIN09_ancestors": ancestors, "JOIN10_descendants": descendants, "JOIN11_siblings": siblings, "JOIN30_entity_merge": entity_merge,
    "JOIN08_dictionary_ngram": dictionary_ngram, "AGG10_document_frequency": document_frequency, "AGG11_term_hits": term_hits, "STR10_expand_query": expand_query,
    "JOIN40_containment": containment, "JOIN41_sentence_fidelity": fidelity,
    "WIN04_greedy_batching": batches, "AGG30_heaviest_batch": heaviest_batch, "WIN05_sentence_packing": sentence_pieces, "WIN06_paragraph_packing": paragraph_pieces, "WIN10_list_numbering": list_numbering, "WIN13_reading_order": reading_order,
    "STREAM_window_counts": window_counts, "SNK10_csv_round_trip": csv_round_trip, "SNK01_upsert": upsert, "SNK02_metadata_retag": retag, "SNK03_delete_stale": delete_stale, "SNK04_drop_create": drop_and_create, "SNK06_failed_rows": failed_rows, "JOIN28_people_reconcile": people_reconcile,
}
_B = "(SELECT block_id, any_value(source_file) AS source_file, any_value(seq) AS seq, any_value(kind) AS kind, any_value(text) AS text FROM blocks GROUP BY block_id)"
_NE = "WITH RECURSIVE e AS (SELECT DISTINCT parent, child FROM (SELECT node_id AS parent, unnest(children) AS child FROM nodes) WHERE child IN (SELECT node_id FROM nodes))"
_WORDS = "regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '^ +| +$', '', 'g')"
_L = f"l AS (SELECT uri, key, label, regexp_full_match(label, '[A-Z]{{2,6}}') AS code FROM (SELECT uri, {_WORDS.format('lower(label)')} AS key, label FROM (SELECT uri, pref_label AS label FROM thesaurus UNION ALL SELECT uri, unnest(alt_labels) FROM thesaurus) WHERE length(label) >= 5 OR regexp_full_match(label, '[A-Z]{{2,6}}')) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY uri, label) = 1)"


def _named(texts: str, key: str) -> str:
    """SQL of l, the labels, and h: which of them are named in texts (key, text); a text is a string of words between blanks."""
    words = _WORDS.format("text")
    return f"{_L}, t AS (SELECT {key}, ' ' || {words} || ' ' AS w, ' ' || lower({words}) || ' ' AS low FROM {texts} WHERE text IS NOT NULL), h AS (SELECT DISTINCT {key}, uri FROM t JOIN l ON CASE WHEN code THEN contains(w, ' ' || label || ' ') ELSE contains(low, ' ' || key || ' ') END)"


_TEXTS = "(SELECT 'document-' || doc_id AS text_id, text FROM documents UNION ALL SELECT DISTINCT 'record-' || concept_id || '-' || md5(text), text FROM (SELECT concept_id, pref_label AS text FROM concepts UNION ALL SELECT concept_id, unnest(alt_labels) FROM concepts UNION ALL SELECT concept_id, unnest(definitions) FROM concepts) WHERE text IS NOT NULL UNION ALL SELECT 'entry-' || canon_id, definition FROM thesaurus)"
_LAB = _named(_TEXTS, "text_id")
_SENT = "SELECT {0} regexp_replace(lower(unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+([A-Z])', '\\1\x01\\2', 'g'), '\x01'))), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM {1}"
_PG = f"p AS (SELECT DISTINCT * FROM ({_SENT.format('chunk_id,', 'pdf_documents')}) WHERE length(k) >= 30), d AS (SELECT DISTINCT * FROM ({_SENT.format('', 'documents')}) WHERE length(k) >= 30)"
ORACLES = {
    "SRC10_akn_scan": f"SELECT source_file, CASE kind WHEN 'para' THEN 'paragraph' WHEN 'table' THEN 'table_row' ELSE 'standalone_p' END AS kind, count(*) AS n, CAST(sum(length(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS BIGINT) AS letters FROM {_B} WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL",
    "SRC05_turtle_scan": "SELECT DISTINCT uri, 'prefLabel' AS property, pref_label AS value FROM thesaurus UNION SELECT uri, 'altLabel', unnest(alt_labels) FROM thesaurus",
    "JOIN05_triple_star": "SELECT uri, definition FROM thesaurus WHERE definition IS NOT NULL",
    "JOIN09_ancestors": f"{_NE}, r AS (SELECT child AS node_id, parent AS ancestor, 1 AS depth FROM e UNION SELECT r.node_id, e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.ancestor WHERE r.depth < 10) SELECT node_id, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node_id <> ancestor GROUP BY ALL",
    "JOIN10_descendants": f"{_NE}, r AS (SELECT parent AS node_id, child AS descendant, 1 AS depth FROM e UNION SELECT r.node_id, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.descendant WHERE r.depth < 10) SELECT node_id, descendant, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node_id <> descendant GROUP BY ALL",
    "JOIN11_siblings": f"{_NE} SELECT a.child AS node_id, count(DISTINCT b.child) AS n_siblings FROM e a JOIN e b ON a.parent = b.parent AND a.child <> b.child GROUP BY a.child",
    "JOIN30_entity_merge": "WITH RECURSIVE z AS (SELECT item_key, any_value(title) AS title, any_value(doi) AS doi FROM zotero GROUP BY item_key), k AS (SELECT item_key, 't:' || regexp_replace(strip_accents(lower(title)), '[^a-z0-9]', '', 'g') AS k FROM z UNION ALL SELECT item_key, 'd:' || regexp_replace(nullif(regexp_extract(lower(doi), '(10\\.[0-9]{4,9}/[^ \"<>]+)', 1), ''), '[.,;)]+$', '') FROM z), f AS (SELECT * FROM k WHERE length(k) > 2), e AS (SELECT DISTINCT a.item_key AS a, b.item_key AS b FROM f a JOIN f b ON a.k = b.k AND a.item_key <> b.item_key), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS item_key, least(a, min(b)) AS component FROM r GROUP BY a",
    "JOIN08_dictionary_ngram": f"WITH {_LAB} SELECT text_id, uri FROM h",
    "JOIN15_label_mention": f"WITH {_LAB} SELECT text_id, uri FROM h",
    "AGG10_document_frequency": f"WITH {_LAB} SELECT uri, count(*) AS n_texts FROM h GROUP BY uri",
    "FLT13_generic_concept": f"WITH {_LAB} SELECT t.uri, count(h.uri) AS named FROM thesaurus t LEFT JOIN h ON h.uri = t.uri GROUP BY t.uri HAVING count(h.uri) <= 30",
    "JOIN45_inferred_links": f"WITH {_named('(SELECT uri AS defined_by, definition AS text FROM thesaurus)', 'defined_by')} SELECT h.uri, h.defined_by, row_number() OVER (PARTITION BY h.uri ORDER BY length(t.definition), h.defined_by) AS place FROM h JOIN thesaurus t ON t.uri = h.defined_by WHERE h.uri <> h.defined_by QUALIFY place <= 8",
    "JOIN14_label_places": f"WITH {_LAB}, w AS (SELECT text_id, string_split({_WORDS.format('text')}, ' ') AS w FROM {_TEXTS} WHERE text IS NOT NULL), p AS (SELECT text_id, w, unnest(range(1, len(w) + 1)) AS spot FROM w), m AS (SELECT p.text_id, l.uri, p.spot, len(string_split(l.key, ' ')) AS n FROM p JOIN l ON lower(w[spot]) = string_split(l.key, ' ')[1] AND lower(array_to_string(list_slice(w, spot, spot + len(string_split(l.key, ' ')) - 1), ' ')) = l.key AND (NOT l.code OR w[spot] = l.label)) SELECT text_id, uri, CAST(spot AS INTEGER) AS place, CAST(n AS INTEGER) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.text_id = m.text_id AND o.n > m.n AND o.spot <= m.spot AND o.spot + o.n >= m.spot + m.n)",
    "JOIN44_graph_expansion": "WITH g AS (SELECT DISTINCT p, c FROM (SELECT TRY_CAST(regexp_extract(u, '(?:^|/)0*([0-9]{1,18})/?\\s*$', 1) AS BIGINT) AS p, concept_id AS c FROM (SELECT concept_id, unnest(broader) AS u FROM concepts) UNION ALL SELECT concept_id, TRY_CAST(regexp_extract(u, '(?:^|/)0*([0-9]{1,18})/?\\s*$', 1) AS BIGINT) FROM (SELECT concept_id, unnest(narrower) AS u FROM concepts)) WHERE p <> c), h AS (SELECT DISTINCT t.uri, c.concept_id AS x FROM concepts c JOIN thesaurus t ON lower(trim(c.pref_label)) = lower(t.pref_label)), u AS (SELECT h.uri, g.p AS o FROM h JOIN g ON g.c = h.x), r AS (SELECT uri, 'above' AS how, o FROM u UNION SELECT h.uri, 'below', g.c FROM h JOIN g ON g.p = h.x UNION SELECT u.uri, 'beside', g.c FROM u JOIN g ON g.p = u.o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.uri = u.uri AND h.x = g.c)) SELECT uri, how, count(*) AS n FROM r GROUP BY uri, how",
    "SRC07_rdfxml_scan": "SELECT DISTINCT uri, 'prefLabel' AS property, pref_label AS value FROM thesaurus UNION SELECT uri, 'altLabel', unnest(alt_labels) FROM thesaurus",
    "FLT15_excluded_subtree": f"SELECT source_file, count(*) AS n, CAST(0 AS BIGINT) AS with_note FROM {_B} WHERE kind = 'para' AND trim(coalesce(text, '')) <> '' GROUP BY source_file",
    "WIN15_span_carry": f"SELECT source_file, CAST(1 + row_number() OVER (PARTITION BY source_file ORDER BY kind, block_id) AS INTEGER) AS table_row, 'Kind: ' || kind || '; Block: ' || block_id AS text FROM {_B} WHERE kind IS NOT NULL",
    "STR32_column_labels": f"SELECT source_file, 'Report – Kind: ' || kind || '; Report – Block: ' || block_id AS text FROM {_B} WHERE kind IS NOT NULL",
    "AGG11_term_hits": f"WITH {_LAB} SELECT text_id, least(count(DISTINCT uri), 4) / 4.0 AS score FROM h GROUP BY text_id",
    "STR10_expand_query": f"WITH {_LAB}, m AS (SELECT h.text_id, h.uri, unnest(list_concat([pref_label], coalesce(alt_labels, [])[:2])) AS term, generate_subscripts(list_concat([pref_label], coalesce(alt_labels, [])[:2]), 1) AS i FROM h JOIN thesaurus USING (uri)) SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY uri, i) AS n, term FROM m QUALIFY n <= 6",
    "JOIN40_containment": f"WITH {_PG} SELECT chunk_id, count(*) AS n_found FROM p SEMI JOIN d USING (k) GROUP BY chunk_id",
    "JOIN41_sentence_fidelity": f"WITH {_PG} SELECT chunk_id, round(count(d.k) / count(*), 6) AS share FROM p LEFT JOIN d ON d.k = p.k GROUP BY chunk_id",
    "WIN13_reading_order": "WITH p AS (SELECT para_id, any_value(source_file) AS source_file, any_value(page) AS page, any_value(x0) AS x0, any_value(y0) AS y0 FROM paras GROUP BY para_id), c AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY source_file, page ORDER BY x0, para_id) > 60 THEN 1 ELSE 0 END AS fresh FROM p WHERE x0 IS NOT NULL AND y0 IS NOT NULL), d AS (SELECT *, sum(fresh) OVER (PARTITION BY source_file, page ORDER BY x0, para_id ROWS UNBOUNDED PRECEDING) AS col FROM c) SELECT para_id, CAST(col AS BIGINT) AS col, row_number() OVER (PARTITION BY source_file, page ORDER BY col, y0, para_id) AS place FROM d",
    "STREAM_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "SNK10_csv_round_trip": "SELECT item_key, any_value(title) AS title, any_value(item_date) AS item_date FROM zotero GROUP BY item_key",
    "SNK01_upsert": "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents",
    "SNK02_metadata_retag": "SELECT doc_id, md5(coalesce(text, '')) AS hash, CASE WHEN source LIKE 'web%' THEN 'web' ELSE source END AS source FROM documents",
    "SNK03_delete_stale": "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents WHERE source <> 'web_crawl_a'",
    "SNK04_drop_create": "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents WHERE source = 'glossaries'",
    "SNK06_failed_rows": "SELECT doc_id, coalesce(n_chars, 0) AS size, CASE WHEN text IS NULL THEN 'no text' WHEN trim(text, ' ') = '' THEN 'blank' ELSE 'too long' END AS reason FROM documents WHERE text IS NULL OR trim(text, ' ') = '' OR n_chars > 20000",
}
_PLACES = [["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]]
ORACLES["WIN10_list_numbering"] = (
    "WITH b AS (SELECT block_id, any_value(source_file) AS f, any_value(seq) AS s, coalesce(any_value(ilvl), 0) AS l, any_value(fmt) AS fmt FROM blocks WHERE kind = 'para' GROUP BY block_id),"
    " h AS (SELECT a.*, (SELECT max(struct_pack(s := o.s, k := o.block_id)) FROM b o WHERE o.f = a.f AND (o.s, o.block_id) < (a.s, a.block_id) AND o.l < a.l) AS up FROM b a),"
    " c AS (SELECT block_id, fmt, (SELECT count(*) FROM b o WHERE o.f = h.f AND o.l = h.l AND (o.s, o.block_id) <= (h.s, h.block_id) AND (h.up IS NULL OR (o.s, o.block_id) > (h.up.s, h.up.k))) AS n FROM h),"
    f" t AS (SELECT *, repeat(chr(CAST(97 + (n - 1) % 26 AS INTEGER)), CAST((n - 1) // 26 + 1 AS BIGINT)) AS letter, repeat('m', n // 1000) || {_PLACES[0]}[n // 100 % 10 + 1] || {_PLACES[1]}[n // 10 % 10 + 1] || {_PLACES[2]}[n % 10 + 1] AS roman FROM c)"
    " SELECT block_id, CASE WHEN fmt IS NULL OR fmt IN ('bullet', 'none') THEN '' WHEN fmt = 'lowerRoman' THEN roman WHEN fmt = 'upperRoman' THEN upper(roman) WHEN fmt = 'lowerLetter' THEN letter WHEN fmt = 'upperLetter' THEN upper(letter) ELSE CAST(n AS VARCHAR) END AS number FROM t"
)
_Q = "q AS (SELECT doc_id, string_split(text, chr(10))[1] AS question, lower(string_split(text, chr(10))[1]) AS low FROM documents)"
_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in routing.KINDS) + " END"
ORACLES |= {
    "SRC11_folder_scan": f"SELECT source_file, CASE kind WHEN 'para' THEN 'paragraph' WHEN 'table' THEN 'table_row' ELSE 'standalone_p' END AS kind, count(*) AS n FROM {_B} WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL UNION ALL SELECT 'broken', 'error', 1",
    "SRC04_turtle_folder_scan": "SELECT 'part-' || (canon_id % 8) || '.ttl' AS source_file, count(*) AS entries, CAST(sum(1 + coalesce(len(alt_labels), 0)) AS BIGINT) AS labels FROM thesaurus GROUP BY ALL",
    "JOIN12_collection_expand": "WITH RECURSIVE n AS (SELECT DISTINCT node_id, tag FROM nodes), e AS (SELECT DISTINCT p, c FROM (SELECT node_id AS p, unnest(children) AS c FROM nodes) WHERE c IN (SELECT node_id FROM n)), r AS (SELECT node_id AS top, node_id AS x FROM n WHERE tag IN ('division', 'attachment') UNION SELECT r.top, e.c FROM r JOIN e ON e.p = r.x) SELECT top AS collection, count(*) AS n_members FROM r JOIN n ON n.node_id = r.x WHERE n.tag = 'paragraph' GROUP BY top",
    "DOC09_block_tree": f"WITH b AS (SELECT block_id, source_file AS f, seq AS s, {RANK} AS r FROM (SELECT block_id, any_value(source_file) AS source_file, any_value(seq) AS seq, any_value(kind) AS kind, any_value(ilvl) AS ilvl FROM blocks GROUP BY block_id)) SELECT a.block_id, (SELECT arg_max(o.block_id, (o.s, o.block_id)) FROM b o WHERE o.f = a.f AND o.r < a.r AND (o.s, o.block_id) < (a.s, a.block_id)) AS parent FROM b a",
    "JOIN21_traceability": "WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'section ([0-9]+(?:\\.[0-9]+)+)', 1)) AS reference FROM documents), p AS (SELECT DISTINCT place FROM (SELECT unnest(regexp_extract_all(text, '(?:^|\\n)Section ([0-9]+(?:\\.[0-9]+)+)', 1)) AS place FROM documents UNION ALL SELECT regexp_extract(num, '^([0-9]+(?:\\.[0-9]+)+)', 1) FROM nodes) WHERE place <> '') SELECT doc_id, reference, arg_max(place, length(place)) AS place FROM n LEFT JOIN p ON reference = place OR starts_with(reference, place || '.') GROUP BY doc_id, reference",
    "RTE01_route": f"WITH {_Q} SELECT doc_id, CASE WHEN question IS NULL THEN NULL WHEN {' OR '.join(f'contains(low, {chr(39)}{m}{chr(39)})' for m in routing.MEETINGS)} THEN 'plenary' WHEN {_KIND} IS NOT NULL THEN 'assessments' ELSE 'both' END AS route FROM q",
    "RTE03_chunk_type": f"WITH {_Q} SELECT doc_id, {_KIND} AS kind FROM q",
    "RTE06_plan_query": f"WITH {_Q}, k AS (SELECT doc_id, {_KIND} AS kind FROM q) SELECT doc_id, CAST(CASE kind WHEN 'ref' THEN 30 WHEN 'key' THEN 100 WHEN 'kg' THEN 100 WHEN 'person' THEN 200 ELSE 3 END AS INTEGER) AS k, coalesce(kind NOT IN ('key', 'ref'), true) AS per_group FROM k",
    "RTE05_relative_session": f"WITH {_Q}, l AS (SELECT max(CAST(nullif(regexp_extract(report_id, '([0-9]+)$', 1), '') AS INTEGER)) AS latest FROM blocks), a AS (SELECT doc_id, question || CASE doc_id % 3 WHEN 0 THEN ' What of the last session?' WHEN 1 THEN ' And the next meeting?' ELSE '' END AS x FROM q WHERE question IS NOT NULL) SELECT doc_id, md5(CASE WHEN regexp_matches(lower(x), '\\b(last|latest|most recent) (session|meeting)\\b') THEN x || ' (session ' || latest || ')' WHEN regexp_matches(lower(x), '\\b(next|coming) (session|meeting)\\b') THEN x || ' (session ' || (latest + 1) || ')' ELSE x END) AS hash FROM a, l",
}
ORACLES = {name: typed(s) for name, s in ORACLES.items()}
