"""p7: encoding a corpus with a public byte-level BPE tokenizer.

Code points become an array of classes (letter, number, white space, other), token boundaries are found by comparing
that array with itself shifted, and the slices between boundaries are merged once per distinct slice and cached.

Why shifted comparisons are enough: read as an automaton, the pre-tokeniser's transition at a code point is a constant
function except inside a run of one class, so the associative scan over composed transitions resets at each change of
class; its value at a position depends on two code points before and three after it. `boundaries` evaluates that scan
in closed form for all positions of all texts of a batch at once; no regular expression is used.

Defined results: a null text and an empty text have no ids (an empty list); white space alone is encoded like any text.
Texts are encoded whole, whatever their length; special-token strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the rank file of the tokenizer lies; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are worked on at a time, to bound the memory of a Python worker.
CHUNK = 1 << 21
#: Distinct slices kept in a worker's cache before it is emptied.
CACHED = 400_000

OTHER, LETTER, NUMBER, SPACE, EDGE = 0, 1, 2, 3, 4
#: Code points with the property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point."""
    global _CLASSES
    if _CLASSES is None:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x40000):  # there is no letter or number beyond
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUMBER
        table[WHITE_SPACE] = SPACE
        _CLASSES = table
    return _CLASSES


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each code point, whether a slice begins there. first: positions at which a text begins."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    before = np.empty(n, np.uint8)
    before[0] = EDGE
    before[1:] = kind[:-1]
    before[begins[:n]] = EDGE
    after = np.empty(n, np.uint8)
    after[-1] = EDGE
    after[:-1] = kind[1:]
    after[begins[1:]] = EDGE
    blank = points == 0x20
    joined = np.zeros(n, bool)  # the code point before is a plain space, which the slice of this one takes in
    joined[1:] = blank[:-1]
    joined[begins[:n]] = False
    space = kind == SPACE
    start = np.where(space, (before != SPACE) | (after < SPACE), (before != kind) & ~joined)
    # A white-space run that ends its text is one slice; one that precedes other text leaves its last code point to itself or to the next slice.
    lone = np.flatnonzero((points == 0x27) & start & (after == LETTER))
    if len(lone):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[lone + 1], padded[lone + 2]
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        inside = (lone + 2 < n) & ~begins[np.minimum(lone + 2, n)]
        long = inside & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        for at, size in ((lone[short], 2), (lone[long & ~short], 3)):
            start[at + 1] = False
            ends = at + size
            start[ends[ends < n]] = True
    return start


class Merger:
    """Ids of slices by byte-pair merging, each distinct slice once."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = _Index(self)
        self.lists: list[list[int]] = []
        self.flat: np.ndarray | None = None

    def ids(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of the lowest rank until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 256:
            return self._ids_long(piece)
        none, rank = 1 << 60, ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _ids_long(self, piece: bytes) -> list[int]:
        """The same for a long slice, with a heap over a linked list: n log n instead of n squared."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, last, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != to:
                continue
            j = end[i]
            gone[j], end[i] = True, end[j]
            if end[i] < n:
                last[end[i]] = i
                if (r := ranks.get(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[end[i]]))
            if last[i] >= 0 and (r := ranks.get(piece[last[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, last[i], end[i]))
        return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]

    def encode(self, texts: pa.StringArray, counts_only: bool = False, offsets: bool = False):
        """For texts without nulls: ids in one array and the number of each text; with offsets, also the code points at which slices begin, the ids of each slice and the slices of each text."""
        if len(self.lists) > CACHED:
            self.reset()
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])) if at[-1] > at[0] else pa.py_buffer(b"")
        points = np.frombuffer(data.to_pybytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = np.ones(len(points), np.int8)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        byte = np.zeros(len(points) + 1, np.int32)
        np.cumsum(width, out=byte[1:])
        edges = np.searchsorted(byte, at - at[0])  # code points at which texts begin, and the end
        begin = np.flatnonzero(boundaries(points, edges[:-1][edges[:-1] < edges[1:]]))
        slices = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(byte[begin], byte[-1]).astype(np.int32)), data).dictionary_encode()
        known = np.fromiter(map(self.index.__getitem__, slices.dictionary.to_pylist()), np.int32, len(slices.dictionary))
        if self.flat is None or len(self.sizes) != len(self.lists):
            self.sizes = np.fromiter(map(len, self.lists), np.int32, len(self.lists))
            self.at = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
            self.flat = np.fromiter((i for x in self.lists for i in x), np.int32, int(self.sizes.sum()))
        which = known[slices.indices.to_numpy()]
        sizes = self.sizes[which]
        total = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=total[1:])
        edge = np.searchsorted(begin, edges)
        counts = np.diff(total[edge])
        if counts_only:
            return counts
        position = np.arange(total[-1], dtype=np.int32)
        position += np.repeat(self.at[which] - total[:-1], sizes)
        ids = self.flat[position]
        return (ids, counts, begin - np.repeat(edges[:-1], np.diff(edge)), sizes, np.diff(edge)) if offsets else (ids, counts)


class _Index(dict):
    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        lists = self.merger.lists
        self[piece] = at = len(lists)
        lists.append(self.merger.ids(piece.encode("utf-8")))
        return at


_MERGERS: dict[bytes, Merger] = {}


def _merger(shared) -> Merger:
    """One merger per Python worker, that of the last vocabulary used there; a vocabulary is known by its content."""
    file = shared.value
    name = hashlib.sha256(file).digest()
    if name not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[name] = Merger(file)
    return _MERGERS[name]


def _groups(texts: pa.StringArray) -> Iterator[tuple[int, pa.StringArray]]:
    """Consecutive texts of at most CHUNK bytes together, or one longer text, and where they begin."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + CHUNK, "right")) - 1)
        yield start, texts.slice(start, end - start)
        start = end


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, pa.int32()))


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The rank file, read by the driver and sent once to each executor; its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(df: DataFrame, key: str, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row."""
    shared = vocabulary(df.sparkSession, path)

    def run(batches):
        merger = _merger(shared)
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                ids, counts = merger.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), _lists(counts, ids)], names=[key, "ids"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(keys, n_tokens long) of every row; no ids leave the Python workers."""
    shared = vocabulary(df.sparkSession, path)
    fields = df.select(*keys).schema

    def run(batches):
        merger = _merger(shared)
        for batch in batches:
            counts = [merger.encode(texts, counts_only=True) for _, texts in _groups(batch.column(batch.num_columns - 1))]
            n = pa.array(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keys, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def encode_with_offsets(df: DataFrame, key: str, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids, starts, sizes): besides the ids, the code point at which each slice begins and how many ids it has."""
    shared = vocabulary(df.sparkSession, path)

    def run(batches):
        merger = _merger(shared)
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                ids, counts, starts, sizes, slices = merger.encode(texts, offsets=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), _lists(counts, ids), _lists(slices, starts), _lists(slices, sizes)], names=[key, "ids", "starts", "sizes"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<int>, sizes array<int>")


def decode(df: DataFrame, key: str, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(key, text): the text that a row's ids stand for."""
    shared = vocabulary(df.sparkSession, path)

    def run(batches):
        pieces = {i: p for p, i in _merger(shared).ranks.items()}
        for batch in batches:
            texts = [b"".join(pieces[i] for i in x or []).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")


def p7_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return encode_with_offsets(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether decoding gives back each text; null comes back as empty."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs, "doc_id"), "doc_id").withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


QUERIES = {"p7_ids": p7_ids, "p7_offsets": p7_offsets, "p7_round_trip": p7_round_trip}
ORACLES = {"p7_round_trip": "SELECT doc_id, true AS same FROM documents"}
