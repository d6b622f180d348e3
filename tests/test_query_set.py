"""Searches of a whole query set against brute force."""

import random

from folioscope.operators import vectors
from folioscope.queries import retrieval


def test_each_query_meets_each_row(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(230)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    kept = {r.vec_id: r.embedding for r in df.collect()}

    def distance(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return round(1 - dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 6)

    near = {q: sorted((distance(kept[q], v), i) for i, v in kept.items()) for q in range(0, 230, 50)}
    got = {}
    for r in retrieval.knn_topk(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x[:25]] for q, x in near.items()}
    pairs = vectors.distances_to_set(df, df.where("vec_id % 50 = 0"), "vec_id")
    assert pairs.count() == pairs.select("query_id", "vec_id").distinct().count() == 5 * 230
    grouped = {(r.query_id, r.label, r.rank_in_group): r.vec_id for r in retrieval.knn_per_group(spark, str(tmp_path)).collect()}
    assert grouped == {(q, g, n): i for q, x in near.items() for g in range(3) for n, i in enumerate([i for _, i in x if i % 3 == g][:3], 1)}
