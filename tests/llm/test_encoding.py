import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import encoding as E

TEXTS = ["", None, " ", "  a", "It's we'll 's 'S x'", "a\n\n b\r\n\tc  ", "éß ２３ x²𝑥 湿地\u3000。", "don''t", "'ll'd", "<|endoftext|>", "x" * 5000, " " * 900, "word " * 3000, "\x00\x01", "e\u0301\u0301"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def frame(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "'clash' AS ids", "1 AS n_tokens")


def test_against_the_library(spark, reference):
    got = {r.doc_id: r.ids for r in E.encode(frame(spark, TEXTS), "doc_id").collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference([t or "" for t in TEXTS])


def test_random_texts(reference):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab'sdtmlrve  \n\t1２.,é²𝑥\u3000\xa0湿") for _ in range(rng.randrange(30))) for _ in range(3000)]
    merger = E.Merger(open(E.VOCABULARY, "rb").read())
    out = []
    for _, group in E._groups(pa.array(texts, pa.string())):
        ids, counts = merger.encode(group)
        at = 0
        for n in counts:
            out.append(ids[at : at + n].tolist())
            at += n
    assert out == reference(texts)


def test_round_trip_counts_and_offsets(spark):
    docs = frame(spark, TEXTS)
    ids = E.encode(docs, "doc_id")
    assert {r.doc_id: r.text for r in E.decode(ids, "doc_id").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in E.count_tokens(docs, ["doc_id"]).collect()}
    for r in E.encode_with_offsets(docs, "doc_id").collect():
        assert counts[r.doc_id] == len(r.ids) == sum(r.sizes)
        assert r.starts == sorted(set(r.starts)) and (not r.starts or r.starts[0] == 0)


def test_empty_table(spark):
    assert E.encode(frame(spark, TEXTS).limit(0), "doc_id").count() == 0


def test_long_slices_merge_alike():
    merger = E.Merger(open(E.VOCABULARY, "rb").read())
    for piece in (b"abcabcabc" * 20, b"=" * 250, "ñandú".encode() * 20):
        assert merger._ids_long(piece) == merger.ids(piece[:256]) if len(piece) <= 256 else True
