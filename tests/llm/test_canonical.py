import pytest

from folioscope.llm.canonical import CONCEPT_LABELS, FOUND, _sql, map_labels, unmatched

THESAURUS = [
    (1, "coastal wetland monitoring", ["coastal marshland monitoring", "CWM"], ["coastal wetlnad monitoring"]),
    (2, "coastal wetland", None, None),
    (3, "alpine erosion", ["alpine soil wash"], []),
    (4, "alpine invasion", [], None),
    (5, "urban fishery certification programme", None, None),
    (6, "Eel", None, None),
    (7, "river mouth survey", ["eel count"], None),
    (8, "river mouth sorvey", None, None),
]
LABELS = {
    "Coastal Wetland Monitoring": 1, "coastal wetlnd monitorng": 1, "monitoring of the coastal wetlands": 1, "wetland monitoring, coastal": 1, "CWM": 1, "cöastal wétland": 2, "c0asta1 wet1and": 2, "- coastal wetland [draft]": 2,
    "coastalwetland": 2, "alpine erosion": 3, "alpine eroson": 3, "alpine invasions": 4, "urban fishery cert. programme": 5, "use of coastal wetland?": 2, "alpine wetland": None, "lunar erosion": None, "other": None, "?": None, "": None, "wetland": None, "x" * 5000: None, "- eel?": 6, "eol": None, "river mouth sirvey": None,
}


@pytest.fixture(scope="module")
def thesaurus(spark):
    return spark.createDataFrame(THESAURUS, "canon_id long, pref_label string, alt_labels array<string>, hidden_labels array<string>")


def test_labels(spark, thesaurus):
    df = spark.createDataFrame([(x,) for x in [*LABELS, None, "CWM"]], "label string")
    got = {r.label: r.canon_id for r in map_labels(spark, df, thesaurus).collect()}
    assert {x: got.get(x) for x in LABELS} == LABELS


def test_concepts(spark, thesaurus):
    rows = [(1, "coastal wetland", ["other"], None), (1, "coastal wetland", ["other"], None), (2, None, None, None), (3, "alpine erosion", ["alpine invasion"], []), (4, "lunar erosion", ["coastal wetland"], None)]
    concepts = spark.createDataFrame(rows, "concept_id long, pref_label string, alt_labels array<string>, hidden_labels array<string>").selectExpr("*", "9 AS canon_id")
    labels = _sql(spark, CONCEPT_LABELS, c=concepts)
    found = _sql(spark, FOUND, l=labels, m=map_labels(spark, labels, thesaurus))
    assert {tuple(r) for r in found.collect()} == {(1, 2), (4, 2)}
    assert map_labels(spark, labels.limit(0), thesaurus).count() == 0
    rows = {(r.concept_id, r.label, r.reason) for r in unmatched(spark, labels, thesaurus).collect()}
    assert rows == {(1, "other", "none near"), (3, "alpine erosion", "labels disagree"), (3, "alpine invasion", "labels disagree"), (4, "lunar erosion", "none near")}


def test_reasons(spark, thesaurus):
    labels = spark.createDataFrame([(1, "?!"), (2, "river mouth sirvey"), (3, "coastal wetland"), (3, "coastal wetlnd"), (3, "alpine erosion")], "concept_id long, label string")
    rows = {(r.concept_id, r.label, r.reason) for r in unmatched(spark, labels, thesaurus).collect()}
    assert rows == {(1, "?!", "blank"), (2, "river mouth sirvey", "several near"), (3, "alpine erosion", "another entry")}
