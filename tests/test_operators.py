"""Operators of the core on small fixtures."""

import ast
import itertools
import random
import subprocess
import sys
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import context, fuzzy, graph, lexicon, outline, packing, people, routing, sequences, vectors
from folioscope.operators.ranking import global_rank
from folioscope.sources import folders, markup
from folioscope.sources.store import Store
from folioscope.streaming import streams

ROOT = Path(__file__).resolve().parent.parent


CASES = [
    ("<paragraph><content><p>Rivers<authorialNote><p>a note</p></authorialNote> carry silt.</p></content></paragraph>", [("paragraph", None, "Rivers carry silt.")]),
    ("<paragraph><content><p>We <i>note<authorialNote><p>x</p></authorialNote> this</i> well</p></content></paragraph>", [("paragraph", None, "We note this well")]),
    ("<paragraph><intro><p>Agrees:</p></intro><paragraph><content><p>first</p></content></paragraph></paragraph>", [("paragraph", None, "Agrees: first")]),
    ("<table><tr><td><p>cell</p></td></tr></table>", [("table_row", 1, "cell")]),
    ("<paragraph><content><p>Before</p><table><tr><td>in</td></tr></table></content></paragraph>", [("paragraph", None, "Before"), ("table_row", 1, "in")]),
    ("<p>Alone</p><p><authorialNote><p>only a note</p></authorialNote></p>", [("standalone_p", None, "Alone")]),
    ("<table><tr><th>Name</th><th>Role</th></tr><tr><td>A</td><td>chair</td></tr><tr><td>B</td><td></td></tr></table>", [("table_row", 2, "Name: A; Role: chair"), ("table_row", 3, "Name: B")]),
    ("<table><tr><th rowspan='2'>Area</th><th colspan='2'>Year</th></tr><tr><th>1</th><th>2</th></tr><tr><td>x</td><td>y</td><td>z</td></tr></table>", [("table_row", 3, "Area: x; Year – 1: y; Year – 2: z")]),
    ("<table><tr><th>K</th><th>V</th></tr><tr><td rowspan='2'>k</td><td>1</td></tr><tr><td>2</td></tr></table>", [("table_row", 2, "K: k; V: 1"), ("table_row", 3, "K: k; V: 2")]),
    ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", [("table_row", 1, "a"), ("table_row", 2, "Header: a\nb")]),
    ("<table><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table>", [("table_row", 1, "out"), ("table_row", 1, "in")]),
]


def test_document_chunks(spark):
    files = spark.createDataFrame([(str(i), f"<doc><body>{xml}</body></doc>") for i, (xml, _) in enumerate(CASES)], "source_file string, content string")
    got = [[] for _ in CASES]
    for r in sorted(markup.parse_akn(files).collect(), key=lambda r: int(r.chunk_id.rpartition("-")[2])):
        got[int(r.source_file)].append((r.kind, r.table_row, r.text))
    assert got == [expected for _, expected in CASES]


def test_path_has_positions_only_among_equals():
    root = ET.fromstring("<a><b/><b/><c/></a>")
    parents = {c: p for p in root.iter() for c in p}
    assert [markup.xpath(e, parents) for e in root] == ["/a/b[1]", "/a/b[2]", "/a/c"]


def test_triples():
    turtle = '@prefix s: <http://s/> .\n<http://x/1> a s:Concept ; s:label "one"@en, "un"@fr ; s:def [ s:value "text \\"quoted\\"" ] .\n'
    rows = [*markup.turtle_triples(turtle)]
    assert ("http://x/1", "http://s/label", "un", "literal", "fr", None) in rows
    assert ("_:b1", "http://s/value", 'text "quoted"', "literal", None, None) in rows
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://s/"><s:Concept rdf:about="http://x/1"><s:label xml:lang="en">one</s:label><s:broader rdf:resource="http://x/2"/></s:Concept></rdf:RDF>'
    assert {r[1:3] for r in markup.rdfxml_triples(rdf)} == {("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://s/Concept"), ("http://s/label", "one"), ("http://s/broader", "http://x/2")}


def test_bad_and_null_files(spark):
    rows = markup.parse_akn(spark.createDataFrame([("a", "<x"), ("b", None)], "source_file string, content string")).collect()
    assert [(r.source_file, r.kind) for r in rows] == [("a", "error")]


def test_packing(spark):
    assert packing.batches([5, 5, 5, 50, 1], 2, 12).tolist() == [0, 0, 1, 2, 3]
    assert packing.batches([], 2, 12).tolist() == []
    assert packing.packed(["a" * 10, "b" * 10, "c" * 25, "c" * 5], 25, "\n\n") == ["a" * 10 + "\n\n" + "b" * 10, "c" * 25, "c" * 5]
    assert packing.packed(["one.", "two.", "six.", "ten."], 14, " ", 9) == ["one. two. six.", "two. six. ten."]
    assert packing.shortened("aaaa bbbb cccc", 8, " ") == ["aaaa", "bbbb", "cccc"]
    df = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine. " * 5), (2, None), (3, " "), (4, "x" * 130)], "id long, text string")
    rows = packing.sentence_pieces(df, "id", 60, 20).collect()
    assert {r.id for r in rows} == {1, 4} and all(len(r.text) <= 60 for r in rows)
    assert [r.text for r in packing.paragraph_pieces(df.where("id = 4"), "id", 60).orderBy("part").collect()] == ["x" * 60, "x" * 60, "x" * 10]


def test_numbering(spark):
    rows = [(i, level, fmt) for i, (level, fmt) in enumerate([(0, "decimal"), (1, "lowerLetter"), (1, "lowerLetter"), (0, "decimal"), (1, "upperRoman"), (None, "decimal"), (2, "bullet"), (1, "lowerLetter")])]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, seq long, ilvl int, fmt string").withColumn("id", F.col("seq"))
    assert [r.number for r in packing.number_blocks(df, "f", "seq", "id").orderBy("id").collect()] == ["1", "a", "b", "2", "I", "3", "", "a"]
    n = spark.range(1, 3000).select(F.col("id"), packing.numeral(F.col("id")).alias("r"), packing.letter(F.col("id")).alias("l"))
    got = {r.id: (r.r, r.l) for r in n.where("id in (4, 9, 27, 40, 53, 90, 444, 1999, 2026)").collect()}
    assert {k: v[0] for k, v in got.items()} == {4: "iv", 9: "ix", 27: "xxvii", 40: "xl", 53: "liii", 90: "xc", 444: "cdxliv", 1999: "mcmxcix", 2026: "mmxxvi"}
    assert (got[4][1], got[27][1], got[53][1]) == ("d", "aa", "aaa")
    assert n.where(T.roman(F.col("r")) != F.col("id")).isEmpty()


def test_components_and_closure(spark):
    rng = random.Random(3)
    edges = [(f"{rng.randrange(40):02}", f"{rng.randrange(40):02}") for _ in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a string, b string")
    assert {(r.id, r.component) for r in graph.components(df).collect()} == {(x, root(x)) for x in parent}
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert graph.closure(chain, 5).count() == 5 * 8 + 4 + 3 + 2 + 1


def test_text_functions(spark):
    df = spark.createDataFrame([("Élan  vital", "xiv", "0000-0002-1825-0097", "forests")], "a string, r string, o string, s string")
    row = df.select(T.loose(F.col("a")), T.roman(F.col("r")), T.orcid_valid(F.col("o")), T.stem(F.col("s")), T.repair_encoding(F.lit("cafÃ©")), T.squash(F.col("a"))).first()
    assert tuple(row) == ("elanvital", 14, True, "forest", "café", "Élan vital")


def test_ranking_and_budget(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(6)], "id long, g string, distance double").withColumn("rank", F.floor(F.col("id") / 2) + 1)
    assert [r.id for r in vectors.interleave(df, "g", "id").orderBy("position").collect()] == [0, 1, 2, 3, 4, 5]
    kept = context.budget_prefix(df, "g", ["id"], F.lit(10), 20).collect()
    assert {r.id for r in kept} == {0, 1, 2, 3}
    big = context.budget_prefix(df, "g", ["id"], F.lit(99), 20).collect()
    assert {r.id for r in big} == {0, 1}


def test_global_rank(spark):
    rng = random.Random(9)
    values = [(rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(values, "v long, i long").repartition(7)
    got = sorted((r["rank"], r.v, r.i) for r in global_rank(df, [F.col("v"), F.col("i")], partitions=5).collect())
    assert got == [(n, v, i) for n, (v, i) in enumerate(sorted(values), 1)]
    assert global_rank(df.limit(0), [F.col("v")]).count() == 0


def test_mentions(spark):
    thesaurus = spark.createDataFrame([("u1", "Coral Reef", ["CRX"]), ("u2", "reef", None)], "uri string, pref_label string, alt_labels array<string>")
    texts = spark.createDataFrame([(1, "The coral reef, and CRX."), (2, "reefs"), (3, None)], "id long, text string")
    assert {tuple(r) for r in lexicon.mentions(texts, "id", lexicon.labels_of(thesaurus)).collect()} == {(1, "u1", "Coral Reef")}


def test_places_keep_the_longest(spark):
    thesaurus = spark.createDataFrame([("u1", "coral reef care", ["CRX"]), ("u2", "reefs", ["coral reef"]), ("u3", "a b c d e f g", None)], "uri string, pref_label string, alt_labels array<string>")
    texts = spark.createDataFrame([(1, "Coral-Reef care of a coral reef; crx. A b c d e f g"), (2, None)], "id long, text string")
    labels = lexicon.labels_of(thesaurus)
    found = lexicon.longest_places(lexicon.places(texts, "id", labels), "id")
    assert {(r.uri, r["at"], r.n) for r in found.collect()} == {("u1", 1, 3), ("u2", 6, 2), ("u3", 9, 7)}
    assert lexicon.places(texts, "id", labels.limit(0)).count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_near_strings_against_all_pairs(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("abc", k=rng.randrange(0, 8))) for _ in range(120)}
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    assert {tuple(r) for r in fuzzy.one_edit_apart(df, df).collect()} == {(a, b) for a in words for b in words if lev(a, b) == 1}
    rows = [(i, "".join(rng.choices("abcd", k=rng.randrange(1, 16)))) for i in range(90)] + [(90, None), (91, ""), (92, "abcabcabc"), (93, "abcabcabc")]
    real = [(i, x) for i, x in rows if x]
    for ratio in (0.6, 0.75):
        got = {tuple(r) for r in fuzzy.alike(spark.createDataFrame(rows, "id long, label string"), ratio).collect()}
        assert got == {(i, j, lev(x, y)) for i, x in real for j, y in real if i != j and lev(x, y) <= int(max(len(x), len(y)) * (1 - ratio) + 1e-9)}


def test_merge_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id long, h string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, h string")
    once = streams.merge(now, new, "id", "h")
    twice = streams.merge(once, new, "id", "h")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_outline(spark):
    ranks = [0, 2, 3, 5, 5, 2, None, 5, 0, 5]
    rows = spark.createDataFrame([("f", i, r) for i, r in enumerate(ranks)], "f string, i int, r int")
    got = {r.i: r.parent for r in outline.parents(rows, "f", ["i"], "i", F.col("r"), 6).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 2, 4: 2, 5: 0, 6: None, 7: 5, 8: None, 9: 8}
    references = spark.createDataFrame([(1, "3.3.4.1"), (1, "3.9"), (2, "3.3.4.1"), (3, "7.1")], "id int, reference string")
    places = spark.createDataFrame([("3.3",), ("3.3.4",), ("3",), ("7.1",), ("7.1",)], "place string")
    assert {tuple(r) for r in outline.most_specific(references, places).collect()} == {(1, "3.3.4.1", "3.3.4"), (2, "3.3.4.1", "3.3.4"), (1, "3.9", None), (3, "7.1", "7.1")}


def test_sequences(spark):
    rng = random.Random(11)
    for _ in range(200):
        values = rng.sample(range(30), rng.randrange(9))
        best = max(len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c))
        places = sequences.longest_rising(values)
        assert len(places) == best and [values[i] for i in places] == sorted(values[i] for i in places) and places == sorted(places)
    left = spark.createDataFrame([("r", v, i) for i, v in enumerate(["a", "b", "c", "d", "d", None])] + [("s", "a", 0)], "group string, value string, at int")
    right = spark.createDataFrame([("r", v, i) for i, v in enumerate(["b", "a", "c", "d", "e"])], "group string, value string, at int")
    assert {tuple(r) for r in sequences.agreement(left, right).collect()} == {("r", 6, 5, 3, 2), ("s", 1, 0, 0, 0)}
    assert sequences.agreement(left.limit(0), right.limit(0)).count() == 0


def test_questions(spark):
    asked = {"List the key messages of chapter 2": ("assessments", "key", 100, False), "What did the Chair say?": ("plenary", None, 3, True), "Which authority decides?": ("assessments", "person", 200, True), "Where do eels go?": ("both", None, 3, True), None: (None, None, 3, True)}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = {r.q: (r.r, r.p.kind, r.p.k, r.p.per_group) for r in df.select("q", routing.route(F.col("q")).alias("r"), routing.plan(F.col("q")).alias("p")).collect()}
    assert got == asked
    assert spark.range(1).select(routing.with_latest(F.lit("And the next session?"), F.lit(11))).first()[0] == "And the next session? (session 12)"


def test_folder(spark, tmp_path):
    for name, text in {"a/one.txt": "\ufeffone\ntwo", "b/two.txt": "", "b/three.xml": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {tuple(r) for r in folders.read_folder(spark, f"file:{tmp_path}", "*.txt").collect()} - {("b/two.txt", "")} == {("a/one.txt", "one\ntwo")}


def test_store_keeps_whole_versions(spark, tmp_path):
    store = Store(spark, f"file:{tmp_path}/s", "id", "h")

    def rows(*values):
        return spark.createDataFrame(values, "id long, h string, tag string")

    assert store.versions() == []
    store.upsert(rows((1, "a", "x"), (2, "b", "x"), (2, "b", "x")))
    store.upsert(rows((2, "c", "y"), (3, "d", "y")))
    store.upsert(rows((2, "c", "y"), (3, "d", "y")))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "y")]
    store.retag(spark.createDataFrame([(1, None), (9, "z")], "id long, tag string"))
    store.delete_stale(rows((1, "", ""), (3, "", "")))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a", None), (3, "d", "y")]
    # A version that was cut off is not read, and the next change takes its place.
    (tmp_path / "s" / "v6").mkdir()
    assert store.versions()[-1] == 5
    store.prune()
    assert store.versions() == [5]
    store.drop()
    assert store.versions() == []


def test_people_by_precedence(spark):
    def names(*values):
        return spark.createDataFrame([(v,) for v in values], "name string").select(people.surname(F.col("name")).alias("key"), "name")

    got = {(r.key, r.name, r.n_sources, r.disagree) for r in people.reconciled([names("A. Kalin", None), names("KALIN", "de Mörane, G."), names("Kalin")], ["name"]).collect()}
    assert got == {("kalin", "A. Kalin", 3, "name"), ("morane", "de Mörane, G.", 1, "")}


def test_small_text_functions(spark):
    df = spark.createDataFrame([("See IPX-3 and ipx 12, not IPX-30 or IPX-3.1", "Figure SPM.2. Water\n use", "Berg, A. and Olsen, T.; Moss")], "a string, b string, c string")
    row = df.select(T.spell_sessions(F.col("a"), "IPX"), T.clean_caption(F.col("b")), T.split_names(F.col("c"))).first()
    assert row[0] == "See the third session and the twelfth session, not IPX-30 or IPX-3.1"
    assert row[1] == "Water use" and row[2] == ["Berg, A.", "Olsen, T.", "Moss"]


def test_core_does_not_import_llm():
    for path in (ROOT / "folioscope").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_queries_can_be_listed_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "True"], said.stderr
