"""p6_: paths, depths, tops, descendants and loops of concepts and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.hierarchy import clean_links, descendants, hierarchy, hierarchy_and_loops, paths
from folioscope.plans.session import cut
from folioscope.sources.tables import table

#: The record that a URI means: the number that is its whole last segment, however the rest is written.
URI_ID = r"(?:^|/)0*([0-9]{1,18})/?\s*$"


def uri_id(uri):
    return F.regexp_extract(uri, URI_ID, 1).try_cast("bigint")


def concept_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "concepts", ["concept_id", "broader", "narrower"])
    members = rows.select(F.lit("concept").alias("part"), F.col("concept_id").alias("id"))
    up = rows.select(F.lit("concept").alias("part"), F.explode(F.transform("broader", uri_id)).alias("parent"), F.col("concept_id").alias("child"))
    down = rows.select(F.lit("concept").alias("part"), F.col("concept_id").alias("parent"), F.explode(F.transform("narrower", uri_id)).alias("child"))
    return members, up.unionByName(down)


def node_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "nodes", ["node_id", "children"])
    members = rows.select(F.lit("node").alias("part"), F.col("node_id").alias("id"))
    return members, rows.select(F.lit("node").alias("part"), F.col("node_id").alias("parent"), F.explode("children").alias("child"))


def graphs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    (m1, l1), (m2, l2) = concept_graph(spark, sf), node_graph(spark, sf)
    return m1.unionByName(m2), l1.unionByName(l2)


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    members, links = graphs(spark, sf)
    return members, cut(clean_links(members, links))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    done, rings = hierarchy_and_loops(*_edges(spark, sf))
    found = done.select(F.col("part").alias("kind"), F.col("id").alias("member_id"), F.col("top").alias("top_id"), "depth")
    looped = rings.select(F.col("part").alias("kind"), F.col("id").alias("member_id"), F.col("loop").alias("top_id"), F.lit(-1).alias("depth"))
    return found.unionByName(looped)


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Each record's path from each of its tops, by the smallest parent on a shortest way at each step up."""
    members, edges = _edges(spark, sf)
    rows = paths(hierarchy(members, edges), edges)
    return rows.select(F.col("part").alias("kind"), F.col("id").alias("member_id"), F.col("top").alias("top_id"), "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All records below each record, also below and on loops, with the fewest steps."""
    return descendants(*_edges(spark, sf)).select(F.col("part").alias("kind"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), "steps")


QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}

_LINKS = """
WITH RECURSIVE m AS (
  SELECT DISTINCT 'concept' AS kind, concept_id AS id FROM concepts UNION ALL SELECT DISTINCT 'node', node_id FROM nodes),
raw AS (
  SELECT 'concept' AS kind, TRY_CAST(regexp_extract(u, '(?:^|/)0*([0-9]{1,18})/?\\s*$', 1) AS BIGINT) AS p, concept_id AS c FROM (SELECT concept_id, unnest(broader) AS u FROM concepts)
  UNION ALL SELECT 'concept', concept_id, TRY_CAST(regexp_extract(u, '(?:^|/)0*([0-9]{1,18})/?\\s*$', 1) AS BIGINT) FROM (SELECT concept_id, unnest(narrower) AS u FROM concepts)
  UNION ALL SELECT 'node', node_id, unnest(children) FROM nodes),
e AS (SELECT DISTINCT raw.* FROM raw JOIN m a ON a.kind = raw.kind AND a.id = raw.p JOIN m b ON b.kind = raw.kind AND b.id = raw.c),
tops AS (SELECT m.* FROM m ANTI JOIN e ON e.kind = m.kind AND e.c = m.id),
"""

#: Walks of more steps than there are records repeat one.
_DOWN = _LINKS + """
down AS (SELECT kind, id AS member_id, id AS top_id, 0 AS depth FROM tops
  UNION SELECT e.kind, e.c, d.top_id, d.depth + 1 FROM down d JOIN e ON e.kind = d.kind AND e.p = d.member_id WHERE d.depth < (SELECT count(*) FROM m)),
shortest AS (SELECT kind, member_id, top_id, CAST(min(depth) AS INTEGER) AS depth FROM down GROUP BY ALL)
"""

ORACLES = {
    "p6_found": _DOWN
    + """,
reach AS (SELECT kind, p AS a, c AS b FROM e UNION SELECT r.kind, r.a, e.c FROM reach r JOIN e ON e.kind = r.kind AND e.p = r.b)
SELECT * FROM shortest
UNION ALL
SELECT x.kind, x.a AS member_id, min(x.b) AS top_id, CAST(-1 AS INTEGER) AS depth FROM reach x JOIN reach y ON x.kind = y.kind AND x.a = y.b AND x.b = y.a GROUP BY x.kind, x.a
""",
    "p6_paths": _DOWN
    + """,
step AS (SELECT s.kind, s.member_id, s.top_id, s.depth, min(e.p) AS up FROM shortest s JOIN e ON e.kind = s.kind AND e.c = s.member_id
  JOIN shortest q ON q.kind = s.kind AND q.member_id = e.p AND q.top_id = s.top_id AND q.depth = s.depth - 1 GROUP BY ALL),
walk AS (SELECT kind, member_id, top_id, depth, CAST(member_id AS VARCHAR) AS path FROM shortest WHERE depth = 0
  UNION ALL SELECT s.kind, s.member_id, s.top_id, s.depth, w.path || '/' || s.member_id FROM walk w JOIN step s ON s.kind = w.kind AND s.top_id = w.top_id AND s.up = w.member_id)
SELECT kind, member_id, top_id, depth, path FROM walk
""",
    "p6_descendants": _LINKS
    + """
below AS (SELECT kind, id AS ancestor_id, id AS descendant_id, 0 AS steps FROM m
  UNION SELECT b.kind, b.ancestor_id, e.c, b.steps + 1 FROM below b JOIN e ON e.kind = b.kind AND e.p = b.descendant_id WHERE b.steps < (SELECT count(*) FROM m))
SELECT kind, ancestor_id, descendant_id, CAST(min(steps) AS INTEGER) AS steps FROM below GROUP BY ALL
""",
}
