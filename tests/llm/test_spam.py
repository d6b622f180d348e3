import random

from folioscope.llm.spam import page_features, spam_pages

PROSE = "The committee reviewed the survey of river basins. It found that wetlands store water in dry years and that farmers depend on them. Several members asked for a second round of field work before the rains. "
SPAM = {
    1: "cheap lodge, cheap lodge online, cheap lodge best, cheap lodge review, cheap lodge top, " * 6,
    2: "\n".join(f"[lodge {i}](http://a{i}.example/p)" for i in range(20)),
    3: "#CheapLodge #BestLodge #LodgeOnline #LodgeTop #LodgeSale " * 6,
    4: "\n".join(f"Boat hire USD {i}.99 SKU-{i} add to cart" for i in range(20)),
    5: "Home » Boats » Sale\n" * 12,
    6: "http://a.example/x www.b.example/y " * 10,
    7: " ".join(random.Random(1).choices(["the", "of", "reef", "honey", "online", "seeds", "the", "cabin", "best", "tours", "pump"], k=200)),
}
FINE = {
    11: PROSE * 3,
    12: "References\n" + "\n".join(f"Arlen, B., & Moss, K. (19{i}). A record of dry woods near lake {i}. Journal of Water, {i}. https://doi.example/10.99/{i}" for i in range(60, 80)),
    13: "Index\n" + "\n".join(f"{w}, {i}, {i + 40}" for i, w in enumerate("ferns mosses lichens herons otters beetles sedges reeds willows alders poplars oaks".split())),
    14: PROSE * 4 + " cheap lodge online http://a.example/x",
    15: None, 16: "", 17: "   ", 18: "7",
}


def test_pages(spark):
    rows = [(i, f"h{i % 3}", t) for i, t in (SPAM | FINE).items()] + [(1, "h1", SPAM[1]), (19, None, SPAM[2])]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string").selectExpr("*", "1 AS density")
    assert {r.doc_id for r in spam_pages(df).where("spam").collect()} == set(SPAM) | {19}
    assert spam_pages(df.limit(0)).count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([(1, "h", PROSE * 2000), (2, "h", SPAM[1] * 2000), (3, "h", "x" * 200000)], "doc_id long, host string, text string")
    assert {r.doc_id for r in spam_pages(df).where("spam").collect()} == {2}


def test_every_shingle_counts(spark):
    words = [f"{a}{b}" for a in ("brood", "clear", "drift") for b in "abcdefghijklmnopqrstuvwxyzabcdefghijklmn"][:120]
    keywords = [w for i in range(27) for w in ("cheaper", "lodging", f"resort{'abcdefghijklmnopqrstuvwxyzz'[i]}")]
    texts = {1: " ".join(words), 2: " ".join(keywords + words), 3: "one two. three, four\nfive six", 4: "one two three four", 5: None}
    df = spark.createDataFrame([(i, f"h{i}", t) for i, t in texts.items()], "doc_id long, host string, text string")
    found = {r.doc_id: list(r.phrases) for r in page_features(df).collect()}
    assert {i: len(x) for i, x in found.items()} == {1: 116, 2: 197, 3: 2, 4: 0, 5: 0}
    assert set(found[1]) < set(found[2])
    page = spam_pages(df).where("doc_id = 2").first()
    assert 0.35 < page.density < 0.5 and page.stitched > 0.5 and page.spam
