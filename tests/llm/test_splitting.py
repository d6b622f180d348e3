import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.splitting import split, split_texts


def check(text, limit, overlap):
    pieces = split(text, limit, overlap)
    if not text.strip():
        assert pieces == []
        return
    assert pieces[0][0] == len(text) - len(text.lstrip()) and pieces[-1][2] == len(text.rstrip())
    for i, (a, b, c) in enumerate(pieces):
        assert a <= b < c and c - a <= limit and b - a <= overlap
        if i:
            assert a >= pieces[i - 1][0] and not text[pieces[i - 1][2] : b].strip()
    assert (len(pieces) == 1) == (len(text.strip()) <= limit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n\f;é\u0301,")), st.integers(10, 60))
def test_any_text(text, limit):
    check(text * 4, limit, limit // 5)


@pytest.mark.parametrize("text", ["x" * 7001, "a b " * 3000, " " * 50, ("word " * 500).strip() + "\n\n" + "y" * 4100, "A sentence here. " * 400, "é" * 2000, "é" * 2001])
def test_shapes(text):
    check(text, 2000, 300)


def test_prefers_coarse_boundaries():
    text = "First part. " * 100 + "\n\n" + "Second part. " * 100
    (_, _, end), (_, fresh, _) = split(text, 1500, 100)[:2]
    assert text[end:fresh].strip() == "" and "\n\n" in text[end:fresh]


def test_whole_paragraphs_stay_whole():
    short, long_ = "Short sentence here. " * 17, "Another sentence now. " * 83
    text = short + "\n\n" + long_
    pieces = split(text, 2000, 300)
    assert [text[b:c] for _, b, c in pieces] == [short.strip(), long_.strip()]
    assert 0 < pieces[1][1] - pieces[1][0] <= 2000 - len(long_.strip())


def test_table(spark):
    rows = [("paras", "1", "x" * 2500), ("paras", "1", "x" * 2500), ("paras", "2", None), ("paras", "3", "  "), ("paras", None, "x"), ("pdf", "1", "short")]
    df = spark.createDataFrame(rows, "item_table string, item_key string, text string").selectExpr("*", "7 AS chunk_index")
    got = split_texts(df).collect()
    assert {(r.item_table, r.item_key, r.chunk_index, r.chunk_total) for r in got} == {("paras", "1", 0, 2), ("paras", "1", 1, 2), ("pdf", "1", 0, 1)}
    assert split_texts(df.limit(0)).count() == 0
