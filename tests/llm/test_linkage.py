import random

from folioscope.llm import linkage

TITLE = "Mapping water prices across Norland: implications for grazing agreements"
ITEMS = [
    ("A", TITLE, ["Berg", "Olsen"], "1994-05", "10.9999/abc.1", None),
    ("A", TITLE, ["Berg", "Olsen"], "1994-05", "10.9999/abc.1", None),
    ("A2", TITLE.replace("across", "acros"), ["Berg", "Olsen"], "1994", None, ""),
    ("B", TITLE + ": part II", ["Berg", "Olsen"], "1996", "10.9999/abc.2", None),
    ("C", TITLE, ["Berg", "Olsen"], "2003", None, None),
    ("D", "A record of sacred groves near Vimor", [], "2001", None, "https://doi.example/10.9999/xyz.9"),
    ("E", None, None, None, None, None),
    ("F", "", [], "", "", ""),
]
SOURCES = [
    (1, {"citation": "Berg, A. & Olsen, T. (1994). Mapping water prices across Norland: implications for grazing agreements. Journal of Water, 4, 10-20."}),
    (2, {"title": TITLE.upper(), "authors": "Berg A and Olsen T", "year": "1994a"}),
    (3, {"name": TITLE + ": part II", "by": "Berg et al.", "issued": "1996"}),
    (4, {"ref_title": TITLE, "creator": "Berg", "date": "2003"}),
    (5, {"title": "A record of sacred groves near Vimor", "doi": "DOI 10.9999/ XYZ.9."}),
    (6, {"title": TITLE[:50] + "...", "authors": "Berg et al.", "year": "1994"}),
    (7, {"title": TITLE.replace("Norland", "Sudmark"), "authors": "Berg", "year": "1994"}),
    (8, {"page": "4"}), (9, None), (10, {}), (11, {"title": None, "doi": ""}),
    (12, {"title": "x" * 3000, "authors": "y" * 3000}),
]
TRUE = {("A", 1), ("A2", 1), ("A", 2), ("A2", 2), ("B", 3), ("C", 4), ("D", 5), ("A", 6), ("A2", 6)}


def frames(spark):
    items = spark.createDataFrame(ITEMS, "item_key string, title string, creators array<string>, item_date string, doi string, url string").selectExpr("*", "1 AS score")
    return items, spark.createDataFrame(SOURCES, "source_id long, metadata map<string,string>").selectExpr("*", "'q' AS title")


def test_works(spark):
    got = {(r.id_a, int(r.id_b)) for r in linkage.match(*frames(spark)).where("same").collect()}
    assert got == TRUE


def test_empty(spark):
    items, sources = frames(spark)
    assert linkage.match(items.limit(0), sources).count() == 0
    assert linkage.match(items, sources.limit(0)).count() == 0


def test_close_pairs_are_exact(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(384) for _ in range(10)]
    vectors = [b ^ sum(1 << i for i in rng.sample(range(384), rng.randrange(20))) for b in base for _ in range(12)]
    years = [rng.choice([None, 1999, 2000, 2001, 2002]) for _ in vectors]
    rows = [(str(i), [(v >> (48 * k)) & 0xFFFFFFFFFFFF for k in range(8)], y) for (i, v), y in zip(enumerate(vectors), years)]
    df = spark.createDataFrame(rows, "id string, by_title array<long>, year int")
    want = {(str(i), str(j)) for i, a in enumerate(vectors) for j, b in enumerate(vectors) if (a ^ b).bit_count() <= linkage.RADIUS and (years[i] is None or years[j] is None or abs(years[i] - years[j]) <= 1)}
    assert {tuple(r) for r in linkage.close_pairs(df, df, "by_title").collect()} == want


def test_isotonic_rises():
    pooled = dict(linkage.isotonic([(1, 1, 2), (2, 0, 2), (3, 3, 3), (4, 2, 3)]))
    assert [pooled[i] for i in (1, 2, 3, 4)] == sorted(pooled.values())


def test_cut_off_and_misprinted_titles_are_reached(spark):
    long = "The decline of seagrass meadows and what fishers in the northern bays make of it"
    swapped = TITLE.replace("water", "wader").replace("grazing", "grasing")  # two substituted letters
    items = [("L", long, [], "1970", None, None), ("T", TITLE, ["Berg"], "1994", None, None)]
    sources = [(1, {"title": long[:54] + "...", "year": "1970"}), (2, {"title": "x" + long[:54] + "...", "year": "1970"}), (3, {"title": long[:54] + "...", "year": "1971"}), (4, {"title": swapped, "by": "Borg", "issued": "1994"})]
    a = spark.createDataFrame(items, "item_key string, title string, creators array<string>, item_date string, doi string, url string")
    b = spark.createDataFrame(sources, "source_id long, metadata map<string,string>")
    got = {(r.id_a, int(r.id_b)) for r in linkage.match(a, b).where("same").collect()}
    assert got == {("L", 1), ("L", 2), ("T", 4)}


def test_beginnings_are_exact(spark):
    rng = random.Random(5)
    whole = "thedeclineofseagrassmeadowsandwhatfishersinthenorthernbaysmakeofit"

    def misprinted(n, times):
        t = list(whole[:n])
        for _ in range(times):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["q"], [t[at], "q"]])
        return "".join(t)

    titles = [misprinted(rng.randrange(24, len(whole)), rng.randrange(7)) for _ in range(60)]
    df = spark.createDataFrame([(str(i), t, 1990 + i % 2, linkage.vector(linkage.grams(t), linkage.WORDS)) for i, t in enumerate(titles)], "id string, title string, year int, by_title array<long>")
    pairs = df.selectExpr("id AS id_a", "title AS x", "year").join(df.selectExpr("id AS id_b", "title AS y", "year"), "year")
    want = {tuple(r) for r in pairs.where(linkage.begins(pairs.x, pairs.y)).select("id_a", "id_b").collect()}
    assert {tuple(r) for r in linkage.same_beginnings(df, df).collect()} == want


def test_no_side_of_a_join_goes_through_the_driver(spark, tmp_path):
    # Read from files, as only their sizes make the planner take a side for small.
    read = []
    for name, df in zip(("items", "sources"), frames(spark)):
        df.write.parquet(f"{tmp_path}/{name}")
        read.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert {(r.id_a, int(r.id_b)) for r in linkage.match(*read).where("same").collect()} == TRUE
    a, b = linkage.items(read[0]), linkage.cited(read[1])
    for df in (linkage.close_pairs(a, b, "by_title"), linkage.same_beginnings(a, b), linkage.scored(a, b)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
