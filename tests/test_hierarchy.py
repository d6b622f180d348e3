"""Hierarchies against a breadth-first search, and the defined results of odd input."""

import os
import random
from collections import defaultdict

import pytest

from folioscope.operators.hierarchy import clean_links, descendants, hierarchy, hierarchy_and_loops, loops, paths
from folioscope.plans.session import shared_folder
from folioscope.queries.hierarchies import uri_id


def frames(spark, members, links):
    return spark.createDataFrame([("g", i) for i in members], "part string, id long"), spark.createDataFrame([("g", p, c) for p, c in links], "part string, parent long, child long")


def brute(members, links):
    ids = {i for i in members if i is not None}
    down = defaultdict(set)
    for p, c in links:
        if p in ids and c in ids:
            down[p].add(c)
    has_parent = {c for x in down.values() for c in x}
    rows = set()
    for top in ids - has_parent:
        seen, level, depth = {top: 0}, [top], 0
        while level:
            depth += 1
            level = [c for c in {c for x in level for c in down[x]} if c not in seen]
            seen.update(dict.fromkeys(level, depth))
        rows |= {(i, top, d) for i, d in seen.items()}

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for c in down[todo.pop()]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    reached = {i: reach(i) for i in ids}
    rings = {(i, min(j for j in reached[i] if i in reached[j])) for i in ids if i in reached[i]}
    return rows, rings


def solve(spark, members, links):
    m, raw = frames(spark, members, links)
    done, rings = hierarchy_and_loops(m, clean_links(m, raw))
    return {(r.id, r.top, r.depth) for r in done.collect()}, {(r.id, r.loop) for r in rings.collect()}


CASES = {
    "chain": ([*range(20)], [(i, i + 1) for i in range(19)]),
    "nulls, strangers and repeats": ([1, 2, 2, None, 3], [(1, 2), (1, 2), (None, 3), (3, None), (99, 2), (1, 98)]),
    "self link below a top": ([1, 2], [(1, 2), (2, 2)]),
    "two loops, one feeding the other": ([1, 2, 3, 4, 5, 6], [(2, 3), (3, 2), (3, 4), (4, 5), (5, 4), (5, 6), (1, 2)]),
    "loop with a tail and no top": ([5, 6, 7, 8], [(6, 5), (5, 6), (6, 7), (7, 8)]),
    "diamond": ([1, 2, 3, 4], [(1, 2), (1, 3), (2, 4), (3, 4)]),
}


@pytest.mark.parametrize("name", CASES)
def test_against_search(spark, name):
    assert solve(spark, *CASES[name]) == brute(*CASES[name])


def test_random_graph(spark):
    rng = random.Random(5)
    members = [*range(60)]
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(55)]
    assert solve(spark, members, links) == brute(members, links)


def test_paths(spark):
    m, raw = frames(spark, [1, 2, 3, 4, 5, 6], [(1, 2), (2, 4), (1, 3), (3, 4), (4, 5), (6, 6)])
    edges = clean_links(m, raw)
    found = {(r.id, r.depth, tuple(r.path)) for r in paths(hierarchy(m, edges), edges).collect()}
    assert found == {(1, 0, (1,)), (2, 1, (1, 2)), (3, 1, (1, 3)), (4, 2, (1, 2, 4)), (5, 3, (1, 2, 4, 5))}


def test_long_chain_has_whole_path(spark):
    n = 70
    m, raw = frames(spark, [*range(n)], [(i, i + 1) for i in range(n - 1)])
    edges = clean_links(m, raw)
    assert {r.id: tuple(r.path) for r in paths(hierarchy(m, edges), edges).collect()} == {i: tuple(range(i + 1)) for i in range(n)}


def test_descendants_of_all_parents_and_of_loops(spark):
    # 4 hangs below 2 and, a level lower, below 3 through 5; 7 and 8 form a loop with 9 below it.
    m, raw = frames(spark, [1, 2, 3, 4, 5, 7, 8, 9], [(1, 2), (2, 4), (1, 3), (3, 5), (5, 4), (7, 8), (8, 7), (8, 9)])
    pairs = {(r.ancestor, r.descendant, r.steps) for r in descendants(m, clean_links(m, raw)).collect()}
    own = {(i, i, 0) for i in (1, 2, 3, 4, 5, 7, 8, 9)}
    assert pairs == own | {(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (2, 4, 1), (3, 5, 1), (3, 4, 2), (5, 4, 1), (7, 8, 1), (7, 9, 2), (8, 7, 1), (8, 9, 1)}


def test_loops_alone(spark):
    m, raw = frames(spark, [1, 2, 3, 4], [(1, 2), (2, 3), (3, 2), (3, 4)])
    assert {(r.id, r.loop) for r in loops(clean_links(m, raw)).collect()} == {(2, 2), (3, 2)}


def test_rounds_are_deleted(spark):
    m, raw = frames(spark, [1, 2], [(1, 2)])
    rows = hierarchy(m, clean_links(m, raw))
    assert rows.count() == 2
    folder = shared_folder(spark).removeprefix("file:")
    assert not [d for d in os.listdir(folder) if d.startswith("rounds-")]


def test_empty(spark):
    assert solve(spark, [], []) == (set(), set())


def test_uri_forms(spark):
    uris = ["http://t.example/c/12", "https://t.example/c/012/", " c/12", "c/retired-12", "", None, "12"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in uris], "u string").select(uri_id("u")).collect()]
    assert got == [12, 12, 12, None, None, None, 12]
