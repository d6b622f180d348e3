import re
import unicodedata

from folioscope.llm.lookalike import compositions, forms, mapping, odd_pattern, same_looking

TEXTS = ["plain text", "ｆｕｌｌ wіdth", "ﬁne\u00a0print", "e\u0323\u0301x", "e\u0301\u0323x", "é", "e\u0301", "zero\u200bwidth", "x²", "x2", " outer  space ", "", "K", "Ⅱ", "II", "on\u2010line", "a–b", "“q”", "Ñandú", "co\u00adop", "\u0301", "가각", "\u1100\u1161\u1100\u1161\u11a8", "\u1161가\u1100", "가\u11a8", "각\u11a8", "\u1100\u1161\u0301\u11a8", "e\u0301" * 3000, "line\nfeed", "вы", "x" * 5000 + "ｘ"]


def form(text):
    table = dict(mapping())
    mapped = "".join(p for c in text for p, _ in table.get(c, [(c, 0)]))
    return re.sub(" +", " ", unicodedata.normalize("NFC", mapped)).strip(" ")


def test_forms(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None, TEXTS[1]]], "text string")
    got = {r.text: r.form for r in forms(df).collect()}
    for t in TEXTS:
        assert got.get(t, t) == form(t), ascii(t[:20])
    assert got["가각"] == got["\u1100\u1161\u1100\u1161\u11a8"] == "가각"


def test_what_counts_as_equal():
    assert form("ｆｕｌｌ wіdth") == form("full width") and form("Ⅱ") == form("II") and form("ﬁn") == form("fin")
    assert len({form(t) for t in ("x²", "x2", "X2", "é2", "“a”", '"a"', "a–b", "a-b")}) == 8


def test_pattern_spares_only_stable_texts():
    plain = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), odd_pattern()))
    for t in TEXTS:
        if not plain.search(t):
            assert form(t) == t
    assert not plain.search("L'été à Ñuble, 5 °C") and compositions()["\u0301"]["e"] == "é"


def test_pairs(spark):
    rows = [("span", "f", 1, "a b"), ("span", "f", 2, "a\u00a0b"), ("span", "f", 2, "a\u00a0b"), ("span", "f", 3, "a b"), ("span", "g", 4, "a\u00a0b"), ("block", "f", 5, "a\u2009b"), ("span", "f", 6, None), ("span", None, 7, "ｘ"), ("span", None, 8, "x"), ("span", "f", None, "x")]
    df = spark.createDataFrame(rows, "kind string, source_file string, id long, text string").selectExpr("*", "'clash' AS form")
    assert {tuple(r) for r in same_looking(df).collect()} == {("span", 1, 2), ("span", 2, 3), ("span", 7, 8)}
    assert same_looking(df.limit(0)).count() == 0


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr("folioscope.llm.lookalike.HOT", 3)
    df = spark.createDataFrame([("span", "f", i, "a b" if i % 2 else "a\u00a0b") for i in range(20)], "kind string, source_file string, id long, text string")
    assert same_looking(df).count() == 100
