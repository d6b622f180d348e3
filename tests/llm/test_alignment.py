import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import alignment

WORDS = {"river": "rivière", "forest": "forêt", "meadow": "prairie", "harbour": "port", "feeds": "nourrit", "protects": "protège", "crosses": "traverse", "weakens": "affaiblit"}


def test_hungarian_against_all_pairings():
    rng = np.random.RandomState(1)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = np.round(rng.rand(n, m) - 0.4, 2)
        best = max(sum(w[i, j] for i, j in zip(r, c)) for k in range(min(n, m) + 1) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k))
        assert abs(sum(w[i, j] for i, j in alignment.hungarian(w)) - best) < 1e-9


def test_sentences_and_tokens():
    assert alignment.sentences("See 4.2 here. Then go; It ends? Yes.") == ["See 4.2 here.", "Then go;", "It ends?", "Yes."]
    assert alignment.sentences(None) == alignment.sentences("  ") == []
    assert alignment.tokens("The Loire rose by 45,025 m in 1999.")[1] == ["loire", "45025", "1999"]


def blocks(spark, reports=60):
    rng = np.random.RandomState(2)
    nouns, verbs = list(WORDS)[:4], list(WORDS)[4:]
    rows, true, i = [], set(), 0
    for r in range(reports):
        said = [(nouns[rng.randint(4)], verbs[rng.randint(4)], nouns[rng.randint(4)], 1000 + 17 * r + k) for k in range(4)]
        said = list({s[:3]: s for s in said}.values())
        order = rng.permutation(len(said))
        for k, (a, v, b, n) in enumerate(said):
            rows.append((f"r{r}", "en", i + k, k, "", f"The {a} {v} the {b}" + (f" since {n}." if k % 2 else ".")))
        for at, k in enumerate(order):
            a, v, b, n = said[k]
            rows.append((f"r{r}", "fr", i + 50 + at, at, "", f"La {WORDS[a]} {WORDS[v]} la {WORDS[b]}" + (f" depuis {n}." if k % 2 else ".")))
            true.add((i + k, i + 50 + at))
        rows.append((f"r{r}", "en", i + 40, 40, "", "Nothing of this kind was said elsewhere."))
        i += 100
    return rows, true


def test_finds_moved_sentences(spark):
    rows, true = blocks(spark)
    rows += [("r0", "en", 9001, 90, "", None), ("r0", None, 9002, 91, "", "Stray."), (None, "en", 9003, 1, "", "Stray."), ("alone", "en", 9004, 1, "", "Only one language."), rows[0]]
    df = spark.createDataFrame(rows, "report_id string, lang string, block_id long, seq int, num string, text string").withColumn("nums", F.array("num")).selectExpr("*", "0 AS score")
    got = {(r.block_a, r.block_b) for r in alignment.align(df).collect()}
    assert len(got & true) >= 0.9 * len(true) and len(got - true) <= 0.1 * len(got)
    assert alignment.align(df.limit(0)).count() == 0


def test_long_reports_meet_in_stretches(spark, monkeypatch):
    rows, true = blocks(spark)
    df = spark.createDataFrame(rows, "report_id string, lang string, block_id long, seq int, num string, text string").withColumn("nums", F.array("num"))
    whole = {(r.a, r.b) for r in alignment.align(df).collect()}
    monkeypatch.setattr(alignment, "STRETCH", 3)
    monkeypatch.setattr(alignment, "BROADCAST_WORDS", 0)
    assert {(r.a, r.b) for r in alignment.align(df).collect()} == whole


def candidate(a, b, score, a2=None, b2=None):
    return ("r", "fr", a, b, a2, b2, 1, 2, None, None, score)


def test_spans_compete_in_the_assignment():
    def chosen(*rows):
        out = alignment.solve_groups(pd.DataFrame(rows, columns=alignment.PAIR).assign(component="c"))
        return {(r.a, r.b, r.a2, r.b2) for r in out.itertuples()}

    # A span that beats its pair wins, unless the sentence merged is worth more in a pair of its own.
    assert chosen(candidate("a1", "b1", 0.5), candidate("a1", "b1", 0.6, a2="a2")) == {("a1", "b1", "a2", None)}
    assert chosen(candidate("a1", "b1", 0.5), candidate("a1", "b1", 0.6, a2="a2"), candidate("a2", "b2", 0.9)) == {("a1", "b1", None, None), ("a2", "b2", None, None)}
    assert chosen(candidate("a1", "b1", 0.6, b2="b2"), candidate("a3", "b3", 0.5, b2="b2")) in [{("a1", "b1", None, "b2")}, {("a1", "b1", None, "b2"), ("a3", "b3", None, None)}]


def test_scores_of_pairs_and_spans():
    def side(rows):
        return pd.DataFrame([("r", "fr", f"{k}:0", k, k, 0, nums, float(sum(w for _, w in terms)), [k for k, _ in terms], [w for _, w in terms], [1.0] * len(terms)) for k, nums, terms in rows], columns=["report_id", "lb", "sid", "block_id", "seq", "idx", "nums", "size", "key", "weight", "p"])

    left = side([(1, [], [(1, 2.0), (2, 2.0)]), (2, [], [(3, 2.0), (4, 2.0)]), (3, ["7"], [(9, 1.0), (8, 1.8)])])
    right = side([(11, [], [(1, 2.0), (2, 2.0), (3, 2.0), (4, 2.0)]), (12, ["7"], [(9, 1.0), (5, 1.8)])])
    got = {(r.a, r.b, r.a2 if isinstance(r.a2, str) else None): round(r.score, 4) for r in alignment.score_group(pa.Table.from_pandas(left), pa.Table.from_pandas(right)).to_pandas().itertuples()}
    assert got == {("1:0", "11:0", None): round(8 / 12, 4), ("2:0", "11:0", None): round(8 / 12, 4), ("1:0", "11:0", "2:0"): 1.0, ("3:0", "12:0", None): round(2 / 5.6 + 0.04, 4)}
