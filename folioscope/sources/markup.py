"""Parsers of XML, HTML-like tables, Turtle and RDF/XML, as Arrow-batched row generators.

A file is one row (source_file, content); its chunks are many rows. Files that cannot be parsed give one row of kind
'error' with the reason and never stop the job. Null content gives no rows.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import takewhile, zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text does not belong to the text around them.
NOTES = {"authorialNote", "note"}
CHUNK = "source_file string, chunk_id string, kind string, path string, num string, heading string, table_row int, text string, cells array<string>, labels array<string>"
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
TRIPLE = "source_file string, s string, p string, o string, o_kind string, o_lang string, o_datatype string"


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def text_of(e: ET.Element, skip: set[str] = NOTES) -> str:
    """The text of an element without that of skipped elements; the text after a skipped element stays."""
    parts: list[str] = []
    todo: list[ET.Element | str] = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        after = [y for child in x for y in ([] if name(child) in skip else [child]) + [child.tail or ""]]
        todo += reversed([x.text or "", *after])
    return " ".join("".join(parts).split())


def rows_of(table: ET.Element) -> list[ET.Element]:
    """The rows of a table without those of tables in it."""
    inner = {row for t in table.iter() if t is not table and name(t) == "table" for row in t.iter()}
    return [x for x in table.iter() if name(x) == "tr" and x not in inner]


def grid(table: ET.Element) -> list[tuple[list[str], bool]]:
    """Cell texts by place, and whether a row has header cells only; rows without text are left out.

    A cell takes the first free place of its row and stands at every place that it spans.
    """
    taken: dict[tuple[int, int], str] = {}
    rows = rows_of(table)
    heads = []
    for r, row in enumerate(rows):
        cells = [c for c in row if name(c) in ("td", "th")]
        heads.append(bool(cells) and {name(c) for c in cells} == {"th"})
        at = 0
        for cell in cells:
            while (r, at) in taken:
                at += 1
            down, across = (int(v) if (v := cell.get(a, "1")).isdigit() and int(v) else 1 for a in ("rowspan", "colspan"))
            taken |= dict.fromkeys(((r + i, at + j) for i in range(min(down, len(rows) - r)) for j in range(across)), text_of(cell, NOTES | {"table"}))
    widths = [max((c for q, c in taken if q == r), default=-1) + 1 for r in range(len(rows))]
    lines = [([taken.get((r, c), "") for c in range(w)], head) for (r, w), head in zip(enumerate(widths), heads)]
    return [line for line in lines if any(line[0])]


def row_text(cells: Column, labels: Column) -> Column:
    """Values with their labels where there are as many labels as cells; empty values are left out."""
    with_label = F.zip_with(cells, labels, lambda c, x: F.when(c != "", F.concat(F.when(x != "", F.concat(x, F.lit(": "))).otherwise(""), c)).otherwise(""))
    return F.array_join(F.filter(F.when(F.size(cells) == F.size(labels), with_label).otherwise(cells), lambda c: c != ""), "; ")


def xpath(e: ET.Element, parents: dict[ET.Element, ET.Element]) -> str:
    """A path of tags with a position only where siblings share the tag."""
    parts = []
    while e is not None:
        parent = parents.get(e)
        same = [c for c in parent if c.tag == e.tag] if parent is not None else [e]
        parts.append(name(e) + (f"[{same.index(e) + 1}]" if len(same) > 1 else ""))
        e = parent
    return "/" + "/".join(reversed(parts))


def akn_chunks(content: str) -> Iterator[tuple]:
    """(kind, path, num, heading, table_row, text, cells, labels): paragraphs whole, table rows one by one, and text outside both.

    A table row has no text but its cells, and the labels of its columns: the distinct texts of the header rows above.
    In a table without header rows, each row but the first has the first row as text.
    """
    root = ET.fromstring(content)
    parents = {c: p for p in root.iter() for c in p}

    def above(e: ET.Element, tags: set[str]) -> ET.Element | None:
        while (e := parents.get(e)) is not None:
            if name(e) in tags:
                return e
        return None

    def heading(e: ET.Element) -> str:
        found = []
        while (e := parents.get(e)) is not None:
            found += [text_of(c) for c in e if name(c) == "heading"][:1]
        return " > ".join(reversed(found))

    for e in root.iter():
        tag = name(e)
        if above(e, NOTES) is not None:
            continue
        if tag == "paragraph" and above(e, {"paragraph", "table"}) is None:
            num = next((text_of(c) for c in e if name(c) == "num"), "")
            text = " ".join(t for t in (text_of(c, NOTES | {"table"}) for c in e if name(c) not in ("num", "heading")) if t)
            if text:
                yield "paragraph", xpath(e, parents), num, heading(e), None, text, None, None
        elif tag == "p" and above(e, {"paragraph", "table"}) is None:
            if text := text_of(e):
                yield "standalone_p", xpath(e, parents), "", heading(e), None, text, None, None
        elif tag == "table":
            rows = grid(e)
            headers = [cells for cells, _ in takewhile(lambda row: row[1], rows)]
            labels = [" – ".join(filter(None, dict.fromkeys(column))) for column in zip_longest(*headers, fillvalue="")]
            for i, (cells, _) in enumerate(rows[len(headers) :], len(headers)):
                shown = "; ".join(filter(None, rows[0][0])) if i and not headers else None
                yield "table_row", xpath(e, parents), "", heading(e), i + 1, shown, cells, labels


def parse_akn(files: DataFrame) -> DataFrame:
    """Chunks of documents with paragraphs and tables; chunk ids are the file and a running number per kind."""
    def run(frames):
        for f in frames:
            rows = []
            for file, content in zip(f.source_file, f.content):
                if content is None:
                    continue
                try:
                    for i, (kind, *rest) in enumerate(akn_chunks(content)):
                        rows.append((file, f"{file}-{kind}-{i}", kind, *rest))
                except ET.ParseError as x:
                    rows.append((file, f"{file}-error-0", "error", None, None, None, None, str(x), None, None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])
            yield out.astype({"table_row": "Int32"})

    chunks = files.select("source_file", "content").mapInPandas(run, CHUNK)
    header = F.coalesce(F.concat(F.lit("Header: "), "text", F.lit("\n")), F.lit(""))
    text = F.when(F.col("kind") == "table_row", F.concat(header, row_text(F.col("cells"), F.col("labels")))).otherwise(F.col("text"))
    return chunks.withColumn("text", text).drop("cells", "labels")


def parse_elements(files: DataFrame) -> DataFrame:
    """Every element with text: (source_file, path, element, attributes, text)."""
    def run(frames):
        for f in frames:
            rows = []
            for file, content in zip(f.source_file, f.content):
                if content is None:
                    continue
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue
                parents = {c: p for p in root.iter() for c in p}
                for e in root.iter():
                    if (e.text or "").strip():
                        rows.append((file, xpath(e, parents), name(e), dict(e.attrib), text_of(e)))
            yield pd.DataFrame(rows, columns=["source_file", "path", "element", "attributes", "text"])

    return files.select("source_file", "content").mapInPandas(run, "source_file string, path string, element string, attributes map<string,string>, text string")


_TERM = re.compile(r"\"\"\"(?P<long>.*?)\"\"\"|\"(?P<short>(?:[^\"\\]|\\.)*)\"|<(?P<iri>[^>]*)>|(?P<mark>[;,.\[\]])(?=\s|$|[\[\]<\"])|@(?P<lang>[A-Za-z-]+)|\^\^|(?P<word>[^\s;,\[\]<>\"]+?)(?=[;,]?(?:\s|$|\.\s|\.$)|[\[\]])|#[^\n]*", re.S)


def turtle_triples(content: str) -> Iterator[tuple]:
    """(s, p, o, kind, lang, datatype) of Turtle with prefixes, literals, lists by ; and , and blank nodes."""
    prefixes: dict[str, str] = {}
    tokens: list[tuple[str, str]] = []
    for line in re.sub(r"(?m)^\s*#.*$", "", content).splitlines(keepends=True):
        m = re.match(r"\s*@prefix\s+([\w-]*):\s*<([^>]*)>\s*\.", line)
        if m:
            prefixes[m[1]] = m[2]
        else:
            tokens.append(("line", line))
    text = "".join(t for _, t in tokens)
    stream: list[list] = []
    at = 0
    for m in _TERM.finditer(text):
        at = m.end()
        if m["long"] is not None or m["short"] is not None:
            raw = m["long"] if m["long"] is not None else m["short"]
            stream.append(["literal", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), raw), None, None])
        elif m["lang"]:
            if stream and stream[-1][0] == "literal":
                stream[-1][2] = m["lang"]
        elif m.group() == "^^":
            stream.append(["type", "", None, None])
        elif m["iri"] is not None:
            stream.append(["iri", m["iri"], None, None])
        elif m["mark"]:
            stream.append(["mark", m["mark"], None, None])
        elif m["word"]:
            w = m["word"]
            if w == "a":
                stream.append(["iri", RDF[1:-1] + "type", None, None])
            elif ":" in w:
                p, _, local = w.partition(":")
                stream.append(["iri", prefixes.get(p, p + ":") + local, None, None])
            else:
                stream.append(["literal", w, None, None])
    # A datatype belongs to the literal before it.
    joined: list[list] = []
    skip = False
    for i, t in enumerate(stream):
        if skip:
            skip = False
        elif t[0] == "type" and joined and i + 1 < len(stream):
            joined[-1][3] = stream[i + 1][1]
            skip = True
        else:
            joined.append(t)
    blanks = 0
    stack: list[tuple] = []
    s = p = None
    for kind, value, lang, datatype in joined:
        if kind == "mark":
            if value == "[":
                blanks += 1
                node = f"_:b{blanks}"
                if s is not None and p is not None:
                    yield s, p, node, "blank", None, None
                stack.append((s, p))
                s, p = node, None
            elif value == "]":
                s, p = stack.pop() if stack else (None, None)
            elif value == ";":
                p = None
            elif value == "." and not stack:
                s = p = None
        elif s is None:
            s = value
        elif p is None:
            p = value
        else:
            yield s, p, value, kind, lang, datatype


def rdfxml_triples(content: str) -> Iterator[tuple]:
    """The same of RDF/XML with typed nodes, resources and literals."""
    root = ET.fromstring(content)

    def iri(tag: str) -> str:
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    count = [0]

    def node(e: ET.Element) -> Iterator[tuple]:
        s = e.get(RDF + "about") or e.get(RDF + "nodeID")
        if s is None:
            count[0] += 1
            s = f"_:b{count[0]}"
        if e.tag != RDF + "Description":
            yield s, RDF[1:-1] + "type", iri(e.tag), "iri", None, None
        for c in e:
            target = c.get(RDF + "resource")
            if target is not None:
                yield s, iri(c.tag), target, "iri", None, None
            elif len(c):
                for inner in c:
                    o = inner.get(RDF + "about")
                    rows = [*node(inner)]
                    yield s, iri(c.tag), o or (rows[0][0] if rows else "_:b0"), "iri" if o else "blank", None, None
                    yield from rows
            else:
                yield s, iri(c.tag), (c.text or "").strip(), "literal", c.get("{http://www.w3.org/XML/1998/namespace}lang"), c.get(RDF + "datatype")

    for e in root:
        yield from node(e)


def parse_triples(files: DataFrame) -> DataFrame:
    """Triples of Turtle or RDF/XML files, told apart by their first sign."""
    def run(frames):
        for f in frames:
            rows = []
            for file, content in zip(f.source_file, f.content):
                if content is None or not content.strip():
                    continue
                try:
                    parse = rdfxml_triples if content.lstrip().startswith("<?xml") or content.lstrip().startswith("<rdf") else turtle_triples
                    rows += [(file, *t) for t in parse(content)]
                except ET.ParseError as x:
                    rows.append((file, "", "error", str(x), "error", None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRIPLE.split(", ")])

    return files.select("source_file", "content").mapInPandas(run, TRIPLE)
