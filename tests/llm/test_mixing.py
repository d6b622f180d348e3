import itertools
import random

from folioscope.llm import mixing


def test_knapsack_against_all_choices():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randrange(4) for _ in lengths]
        capacity = rng.randrange(60)
        best = max(t for c in itertools.product(*[range(n + 1) for n in counts]) if (t := sum(a * b for a, b in zip(c, lengths))) <= capacity)
        taken = mixing.knapsack(lengths, counts, capacity)
        assert sum(a * b for a, b in zip(taken, lengths)) == best and all(0 <= a <= b for a, b in zip(taken, counts))


def test_fit_comes_near_large_budgets():
    rng = random.Random(5)
    lengths = sorted(rng.sample(range(5, 3000), 400))
    counts = [rng.randrange(1, 50) for _ in lengths]
    size = sum(a * b for a, b in zip(lengths, counts))
    for budget in (0, 1, 1000, size // 3, size - 1, size):
        taken = mixing.fit(lengths, counts, budget, 1)
        got = sum(a * b for a, b in zip(taken, lengths))
        assert got <= budget and all(0 <= a <= b for a, b in zip(taken, counts))
        assert budget - got <= lengths[0]
    assert mixing.fit([100_000, 70_000], [3, 3], 250_000, 1) == [1, 2] or sum(a * b for a, b in zip(mixing.fit([100_000, 70_000], [3, 3], 250_000, 1), [100_000, 70_000])) >= 240_000


def test_fit_against_all_choices():
    rng = random.Random(7)
    for _ in range(100):
        lengths = sorted(rng.sample(range(1, 40), 4))
        counts = [rng.randrange(1, 4) for _ in lengths]
        budget = rng.randrange(sum(a * b for a, b in zip(lengths, counts)) + 1)
        best = max(t for c in itertools.product(*[range(n + 1) for n in counts]) if (t := sum(a * b for a, b in zip(c, lengths))) <= budget)
        assert sum(a * b for a, b in zip(mixing.fit(lengths, counts, budget, 3), lengths)) == best


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("aab"), rng.randrange(0, 50)) for i in range(600)] + [(1000 + i, None, 5) for i in range(5)] + [(2000 + i, "unused", 5) for i in range(5)]
    lengths = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 3), ("m", "b", 0.4, 2), ("m", "missing", 0.1, 2), ("n", "b", 1.0, 1), ("n", "a", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    budgets, chosen = mixing.choose(lengths, targets)
    size = {s: sum(n for _, x, n in rows if x == s) for s in "ab"}
    got = chosen.collect()
    assert {r.source for r in got} == {"a", "b"} and all(r.n_tokens > 0 and r.copies >= 1 for r in got)
    assert len({(r.mix_name, r.doc_id) for r in got}) == len(got)
    report = {(r.mix_name, r.source): r for r in mixing.reached(budgets, chosen).collect()}
    total = min(3 * size["a"] / 0.5, 2 * size["b"] / 0.4)
    assert abs(report["m", "a"].tokens - 0.5 * total) <= 2 and abs(report["m", "b"].tokens - 0.4 * total) <= 2
    assert report["m", "a"].most_copies <= 3 and report["m", "b"].most_copies <= 2 and report["n", "b"].most_copies == 1
    assert all(r.shortfall == r.budget - r.tokens >= 0 for r in report.values())
    assert report["m", "missing"].tokens == 0 and report["n", "b"].tokens == size["b"]
    again = mixing.choose(lengths, targets)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert mixing.choose(lengths.limit(0), targets)[1].count() == 0
