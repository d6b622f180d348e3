"""Retrieval: filtered and per-group neighbours, merging, re-ranking, neighbours in reading order and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import context, vectors
from folioscope.operators.ranking import global_rank
from folioscope.queries.relational import typed
from folioscope.sources.tables import first_delivery, table

_E = "embeddings"


def _query_set(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All embeddings, and those of them that are the queries: every row whose id is divisible by 50."""
    rows = table(spark, sf, _E, ["vec_id", "embedding", "label"])
    return rows, rows.where("vec_id % 50 = 0")


def _blend(near: DataFrame, *group: str) -> DataFrame:
    """The re-ranking of rerank() within each query, in decimals: the blend of a rounded distance often ends in a half."""
    def exact(x: str) -> Column:
        return F.lit(x).cast("decimal(5,4)")

    similar = F.greatest(exact("0"), exact("1") - F.col("distance").cast("decimal(9,6)"))
    combined = F.round(exact("0.75") * similar + exact("0.0625") * F.least(F.col("vec_id") % 7, F.lit(4)).cast("decimal(5,4)"), 6).cast("double")
    w = Window.partitionBy("query_id", *group).orderBy(F.desc("combined"), "rank", "vec_id")
    return near.withColumn("combined", combined).withColumn("new_rank", F.row_number().over(w))


def knn_topk(spark, sf):
    return vectors.knn_set(*_query_set(spark, sf), 25, "vec_id").select("query_id", "vec_id", "label", "distance", "rank")


def typed_knn(spark, sf):
    rows, queries = _query_set(spark, sf)
    return vectors.knn_set(rows.where(F.col("label").isin(1, 2)), queries, 10, "vec_id").select("query_id", "vec_id", "label", "distance", "rank")


def knn_per_group(spark, sf):
    near = vectors.knn_set(*_query_set(spark, sf), 3, "vec_id", "label")
    merged = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "label", "vec_id"))
    return near.select("query_id", "vec_id", "label", F.col("rank").alias("rank_in_group"), merged.alias("merged_rank"), "distance")


def knn_overfetch(spark, sf):
    again = _blend(vectors.knn_set(*_query_set(spark, sf), 9, "vec_id", "label"), "label")
    return again.where("new_rank <= 3").select("query_id", "vec_id", "label", "distance", "combined", "new_rank")


def rerank(spark, sf):
    return _blend(vectors.knn_set(*_query_set(spark, sf), 40, "vec_id")).select("query_id", "vec_id", "rank", "combined", "new_rank")


def concat_results(spark, sf):
    rows, queries = _query_set(spark, sf)
    both = vectors.knn_set(rows.where(F.col("label").isin(0, 1)), queries, 5, "vec_id", "label")
    return both.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "rank")).alias("position"), "vec_id", F.col("label").alias("branch"))


def keep_first(spark, sf):
    """Repeated rows of one id keep their first position."""
    docs = table(spark, sf, "documents", ["doc_id", "text", "source"]).where("text is not null")
    return vectors.keep_first(docs, "text", "doc_id").select("doc_id", "source")


def unit_vectors(spark, sf):
    rows = table(spark, sf, _E, ["vec_id", "embedding"])
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 4).alias("length"), F.round(vectors.norm(vectors.unit(F.col("embedding"))), 6).alias("unit_length"))


def _ranked_docs(spark, sf):
    return table(spark, sf, "documents", ["doc_id", "source", "n_chars"]).where("n_chars > 0")


def budget_prefix(spark, sf):
    return context.budget_prefix(_ranked_docs(spark, sf), "source", ["doc_id"], F.col("n_chars") + 2, 20000).select("source", "doc_id", "position", "running")


def used_prefix(spark, sf):
    """How many rows of each source fit, as the used part of a result."""
    return context.budget_prefix(_ranked_docs(spark, sf), "source", ["doc_id"], F.col("n_chars") + 2, 60000).groupBy("source").agg(F.count("*").alias("used"))


def budget_share(spark, sf):
    docs = _ranked_docs(spark, sf).where(F.col("source").isin("plenary_reports", "web_crawl_a")).withColumn("side", F.when(F.col("source") == "plenary_reports", "a").otherwise("b"))
    return context.budget_share(docs, "side", ["doc_id"], F.col("n_chars") + 2, 60000).select("doc_id", "side", "kept", "place")


def neighbour_offset(spark, sf):
    blocks = first_delivery(table(spark, sf, "blocks", ["block_id", "source_file", "seq", "kind", "text", "loaded_at"]), "block_id").where("kind = 'para'")
    hits = blocks.where(F.coalesce("text", F.lit("")).contains("households") | F.coalesce("text", F.lit("")).contains("ménages"))
    return context.neighbours(hits.withColumn("hit_order", F.col("block_id")), blocks, "source_file", "seq", "block_id", "hit_order").select("block_id", "source_file", "seq", "hit_order", "neighbour_of")


def longest_label(spark, sf):
    rows = table(spark, sf, "thesaurus", ["canon_id", "pref_label"])
    return global_rank(rows, [F.desc(F.length("pref_label")), F.col("pref_label")], "place").select("canon_id", "place")


def offset_paging(spark, sf):
    rows = global_rank(table(spark, sf, "documents", ["doc_id"]), [F.col("doc_id")], "place")
    return rows.select("doc_id", F.floor((F.col("place") - 1) / 250).cast("int").alias("page"))


def interleave_sources(spark, sf):
    """The first four documents of each source, best of each first."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents", ["doc_id", "source"]).where("source is not null")
    top = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rank <= 4")
    return vectors.interleave(top, "source", "doc_id").select("position", "source", "doc_id")


def gather(spark, sf, places=(5, 3, 8, 1)):
    """The rows at given places of an ordered table, in the order of the places."""
    ranked = global_rank(table(spark, sf, "documents", ["doc_id"]), [F.col("doc_id")], "place")
    wanted = spark.createDataFrame([(n, p) for n, p in enumerate(places)], "n int, place long")
    return ranked.join(F.broadcast(wanted), "place").select("n", "place", "doc_id")


def gap_sort(spark, sf):
    rows = table(spark, sf, "documents", ["doc_id", "source", "chapter", "assessment"]).where("source = 'knowledge_gaps'")
    return global_rank(rows, [F.desc(F.coalesce("chapter", F.lit(-1))), F.coalesce("assessment", F.lit("")), F.col("doc_id")], "place").select("doc_id", "place")


def guidance_sort(spark, sf):
    rows = table(spark, sf, "documents", ["doc_id", "source", "assessment", "text"]).where("source = 'guidance_notes'")
    return global_rank(rows, [F.coalesce("assessment", F.lit("")), F.when(F.col("text").contains("platform"), 0).otherwise(1), F.col("doc_id")], "place").select("doc_id", "place")


def identifier_sort(spark, sf):
    rows = table(spark, sf, "supplier", ["s_suppkey", "s_name"])
    return global_rank(rows, [F.regexp_extract("s_name", "^([A-Za-z]+)", 1), F.regexp_extract("s_name", "([0-9]+)$", 1).cast("bigint"), F.col("s_suppkey")], "place").select("s_suppkey", "place")


def comparison_run(spark, sf):
    """Each question in each scope by two pipelines, side by side: the nearest row, and the first after re-ranking."""
    near = vectors.knn_set(*_query_set(spark, sf), 9, "vec_id", "label")
    plain = near.where("rank = 1").select("query_id", "label", F.lit("vector").alias("pipeline"), "vec_id")
    again = _blend(near, "label").where("new_rank = 1").select("query_id", "label", F.lit("reranked").alias("pipeline"), "vec_id")
    side = plain.unionByName(again).groupBy("query_id", "label").pivot("pipeline", ["vector", "reranked"]).agg(F.first("vec_id"))
    return side.withColumn("agree", F.col("vector") == F.col("reranked"))


QUERIES = {
    "PRJ05_gather": gather, "SRT05_gap_sort": gap_sort, "SRT06_guidance_sort": guidance_sort, "SRT04_identifier": identifier_sort, "RTE18_comparison_run": comparison_run, "WIN01_rank_interleave": interleave_sources,
    "JOIN01_knn": knn_topk, "JOIN02_knn_per_group": knn_per_group, "JOIN03_knn_overfetch": knn_overfetch, "JOIN04_neighbour_offset": neighbour_offset, "SRT01_topk_distance": typed_knn, "SRT02_rerank": rerank,
    "SET01_concat_results": concat_results, "SET03_keep_first": keep_first, "MATH_unit_vectors": unit_vectors, "WIN02_budget_prefix": budget_prefix, "WIN03_budget_share": budget_share, "PRJ14_used_prefix": used_prefix,
    "SRT09_longest_label": longest_label, "SRT15_offset_paging": offset_paging, "SET02_interleave": interleave_sources,
}
_S = "WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"
_SCORE = "least(vec_id % 7, 4) / 4.0"
_PARAS = "b AS (SELECT block_id, any_value(source_file) AS source_file, any_value(seq) AS seq, any_value(text) AS text FROM blocks WHERE kind = 'para' GROUP BY block_id)"
ORACLES = {
    "SRT09_longest_label": "SELECT canon_id, CAST(rank() OVER (ORDER BY length(pref_label) DESC, pref_label) AS BIGINT) AS place FROM thesaurus",
    "SRT15_offset_paging": "SELECT doc_id, CAST((rank() OVER (ORDER BY doc_id) - 1) // 250 AS INTEGER) AS page FROM documents",
    "SET02_interleave": "SELECT CAST(rank() OVER (ORDER BY place, source, doc_id) AS BIGINT) AS position, source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE source IS NOT NULL) WHERE place <= 4",
    "SET03_keep_first": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY text",
    "MATH_unit_vectors": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS length, CAST(1.0 AS DOUBLE) AS unit_length FROM embeddings",
    "WIN02_budget_prefix": "SELECT source, doc_id, row_number() OVER w AS position, CAST(sum(n_chars + 2) OVER w AS BIGINT) AS running FROM documents WHERE n_chars > 0 WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) QUALIFY running <= 20000 OR position = 1",
    "PRJ14_used_prefix": "SELECT source, count(*) AS used FROM (SELECT source, row_number() OVER w AS position, sum(n_chars + 2) OVER w AS running FROM documents WHERE n_chars > 0 WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) QUALIFY running <= 60000 OR position = 1) GROUP BY source",
    "WIN03_budget_share": "WITH d AS (SELECT doc_id, CASE source WHEN 'plenary_reports' THEN 'a' ELSE 'b' END AS side, n_chars + 2 AS size FROM documents WHERE n_chars > 0 AND source IN ('plenary_reports', 'web_crawl_a')), r AS (SELECT *, sum(size) OVER (PARTITION BY side ORDER BY doc_id) AS running FROM d), n AS (SELECT least(coalesce(max(running) FILTER (side = 'b'), 0), 20000) AS reserved FROM r), u AS (SELECT coalesce(max(running), 0) AS used FROM r, n WHERE side = 'a' AND running <= 60000 - reserved), k AS (SELECT doc_id, side, CASE side WHEN 'a' THEN running <= 60000 - reserved ELSE running <= 60000 - used END AS kept FROM r, n, u) SELECT doc_id, side, kept, row_number() OVER (ORDER BY NOT kept, side, doc_id) AS place FROM k",
    "JOIN04_neighbour_offset": f"WITH {_PARAS}, h AS (SELECT * FROM b WHERE contains(text, 'households') OR contains(text, 'ménages')), w AS (SELECT h.block_id AS hit, h.source_file, h.seq + o AS seq, o FROM h, (SELECT unnest([-1, 0, 1]) AS o)), f AS (SELECT b.block_id, b.source_file, b.seq, w.hit AS hit_order, CASE WHEN o <> 0 THEN w.hit END AS neighbour_of, row_number() OVER (PARTITION BY b.block_id ORDER BY w.hit, o) AS n FROM w JOIN b USING (source_file, seq)) SELECT block_id, source_file, seq, hit_order, neighbour_of FROM f WHERE n = 1",
}
_BLEND = "s AS (SELECT *, CAST(round(0.75 * greatest(0, 1 - CAST(distance AS DECIMAL(9, 6))) + 0.0625 * least(vec_id % 7, 4), 6) AS DOUBLE) AS combined FROM r)"
ORACLES |= {
    "JOIN01_knn": f"{_S} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 25",
    "SRT01_topk_distance": f"{_S} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d WHERE label IN (1, 2) QUALIFY rank <= 10",
    "JOIN02_knn_per_group": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank_in_group FROM d QUALIFY rank_in_group <= 3) SELECT query_id, vec_id, label, rank_in_group, row_number() OVER (PARTITION BY query_id ORDER BY rank_in_group, label, vec_id) AS merged_rank, distance FROM r",
    "JOIN03_knn_overfetch": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 9), {_BLEND} SELECT query_id, vec_id, label, distance, combined, row_number() OVER (PARTITION BY query_id, label ORDER BY combined DESC, rank, vec_id) AS new_rank FROM s QUALIFY new_rank <= 3",
    "SRT02_rerank": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 40), {_BLEND} SELECT query_id, vec_id, rank, combined, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rank, vec_id) AS new_rank FROM s",
    "SET01_concat_results": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM d WHERE label IN (0, 1) QUALIFY rank <= 5) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY label, rank) AS position, vec_id, label AS branch FROM r",
}
ORACLES |= {
    "PRJ05_gather": "WITH r AS (SELECT doc_id, rank() OVER (ORDER BY doc_id) AS place FROM documents) SELECT CAST(n - 1 AS INTEGER) AS n, CAST(place AS BIGINT) AS place, doc_id FROM (SELECT unnest([5, 3, 8, 1]) AS place, generate_subscripts([5, 3, 8, 1], 1) AS n) JOIN r USING (place)",
    "SRT05_gap_sort": "SELECT doc_id, CAST(rank() OVER (ORDER BY coalesce(chapter, -1) DESC, coalesce(assessment, ''), doc_id) AS BIGINT) AS place FROM documents WHERE source = 'knowledge_gaps'",
    "SRT06_guidance_sort": "SELECT doc_id, CAST(rank() OVER (ORDER BY coalesce(assessment, ''), CASE WHEN text LIKE '%platform%' THEN 0 ELSE 1 END, doc_id) AS BIGINT) AS place FROM documents WHERE source = 'guidance_notes'",
    "SRT04_identifier": "SELECT s_suppkey, CAST(rank() OVER (ORDER BY regexp_extract(s_name, '^([A-Za-z]+)', 1), CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT), s_suppkey) AS BIGINT) AS place FROM supplier",
    "WIN01_rank_interleave": ORACLES["SET02_interleave"],
    "RTE18_comparison_run": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 9), {_BLEND}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY combined DESC, rank, vec_id) AS new_rank FROM s) SELECT query_id, label, max(vec_id) FILTER (rank = 1) AS vector, max(vec_id) FILTER (new_rank = 1) AS reranked, max(vec_id) FILTER (rank = 1) = max(vec_id) FILTER (new_rank = 1) AS agree FROM t GROUP BY query_id, label",
}
ORACLES = {name: typed(s) for name, s in ORACLES.items()}
