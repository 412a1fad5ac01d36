"""Byte-level BPE encoding and decoding with every distinct word encoded once.

Texts are cut into pre-tokens. A bounded head of common words is encoded first and sent to every task; which words are in it
changes the traffic, never the result. All other pre-tokens are exploded with their positions and go through one global
shuffle by word, where equal words meet and are encoded once; their ids return to the documents in a second shuffle. There
they fill, by position, the places that they left in the document's sequence of head words, which travels as the words'
numbers by frequency. Decoding looks ids up in the
vocabulary's fixed table of token bytes, which every task holds: a broadcast join with a table of known size.

Without the head every pre-token would travel twice with its document and position: on the 0.5 GB of test documents 83 million
pairs of document and word, over three times the input, where half as much again is allowed.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_batches, stage

#: Bounds on the head: documents that are sampled for it, words that are sent to every task, and their bytes.
HEAD_DOCS = 60_000
HEAD_WORDS = 400_000  # below 1 << 24, the numbers that three bytes hold
HEAD_BYTES = 16 << 20
ROWS = 500  # documents put together at a time

#: Fixed value: the one pattern that FAST stands for.
FAST_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: That pattern's alternatives for the standard library's engine, where letters are word characters but
#: digits and the underscore. Texts with a character that the two engines class differently take the full pattern.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Fixed value: Unicode's White_Space characters.
WHITE = r"\t-\r \x85\xa0  -     　"

_made: dict = {}


def _splitter(pattern: str):
    """The function that cuts a text into pre-tokens, made once in a worker."""
    if pattern not in _made:
        import regex

        odd = {c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isdecimal()} | set("\x1c\x1d\x1e\x1f")
        full = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]"))
        _made[pattern] = lambda text: FAST.findall(text) if pattern == FAST_FOR and odd.isdisjoint(text) else full.findall(text)
    return _made[pattern]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file (base64 bytes and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(vocabulary):
    if vocabulary.id not in _made:
        import tiktoken

        v = vocabulary.value
        _made[vocabulary.id] = tiktoken.Encoding("own", pat_str=v["pattern"], mergeable_ranks=v["ranks"], special_tokens={})
    return _made[vocabulary.id]


class _Vocabulary:
    """A broadcast of pattern and ranks with a name that workers can keep made objects under.

    Between tasks ids travel in ``kind``, the narrowest that holds them.
    """

    def __init__(self, spark, path: str, pattern: str):
        ranks = load_ranks(path)
        self.id, self.shared = (path, pattern), spark.sparkContext.broadcast({"pattern": pattern, "ranks": ranks})
        self.kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"

    @property
    def value(self) -> dict:
        return self.shared.value

    def ids(self, word: str) -> bytes:
        return np.array(_encoder(self).encode_ordinary(word), self.kind).tobytes()


class _Head:
    """Common words by number, and their ids one after the other; the number after the last one stands for a hole."""

    def __init__(self, words: list[str], ids: list[bytes], kind: str):
        self.numbers = {w: i for i, w in enumerate(words)}
        self.hole, self.flat = len(words), np.frombuffer(b"".join(ids), kind)
        self.sizes = np.array([*(len(x) // np.dtype(kind).itemsize for x in ids), 0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pack(self, words: list[str]) -> bytes:
        """The words' numbers by lower, middle and upper bytes, which compress better apart."""
        numbers = np.fromiter(map(self.numbers.get, words, repeat(self.hole)), "<u4", len(words))
        return numbers.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()

    def fill(self, packed: bytes, own: list[bytes] | None) -> np.ndarray:
        """The ids of a document: those of its head words, and in each hole those of the word that belongs there."""
        three = np.frombuffer(packed, np.uint8).reshape(3, -1).astype(np.uint32)
        numbers = three[0] | three[1] << 8 | three[2] << 16
        holes = numbers == self.hole
        counts = self.sizes[numbers]
        words: list = [None] * int(holes.sum())
        for x in own or ():
            width = x[0]
            n = int.from_bytes(x[1 : 1 + width], "little")
            end = 1 + width * (n + 1)
            ids = np.frombuffer(x[end:], self.flat.dtype)
            for at in np.frombuffer(x[1 + width : end], f"<u{width}").tolist():
                words[at] = ids
        if words:
            counts[holes] = [len(x) for x in words]
        size = counts[~holes]
        take = np.repeat(self.starts[numbers[~holes]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out, common = np.empty(int(counts.sum()), self.flat.dtype), np.repeat(~holes, counts)
        out[common] = self.flat[take]
        if words:
            out[~common] = np.concatenate(words)
        return out


def _head(docs: DataFrame, vocabulary: _Vocabulary, head_docs: int, head_words: int, head_bytes: int) -> _Head:
    """The most frequent words of the documents with the smallest hashes."""
    pattern = vocabulary.id[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(pattern), Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(split(t.as_py() or ""))
        words = sorted(w for w in seen)  # sorted words shuffle in fewer bytes
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([vocabulary.ids(w) for w in b.column(0).to_pylist()], pa.binary())], ["word", "n", "ids"])

    total = docs.count()
    share = F.xxhash64("doc_id", "text", F.lit("head")).cast("double") / F.lit(2.0**64) + 0.5
    words = stage(docs.filter(share * total < head_docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "head")
    least, n_words, n_bytes = None, 0, 0
    for r in words.groupBy("n").agg(F.count("*").alias("words"), F.sum(F.octet_length("word") + 16).alias("bytes")).orderBy(F.desc("n")).toLocalIterator():
        n_words, n_bytes = n_words + r["words"], n_bytes + r["bytes"]
        if n_words > head_words or n_bytes > head_bytes:
            break
        least = r["n"]
    if least is None:
        return _Head([], [], vocabulary.kind)
    rows = words.filter(F.col("n") >= least).select("word", "n").repartition(12).mapInArrow(encode, "word string, n long, ids binary").toArrow()
    rows = rows.sort_by([("n", "descending"), ("word", "ascending")])
    return _Head(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), vocabulary.kind)


def _places(at: list[int]) -> bytes:
    """Ascending places among a document's holes as bytes: their width (2 or 4), their number, themselves."""
    kind, width = ("<u2", b"\x02") if at[-1] < 1 << 16 else ("<u4", b"\x04")
    return width + np.array([len(at), *at], kind).tobytes()


def encode(docs: DataFrame, path: str, pattern: str, head_docs: int = HEAD_DOCS, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers as binary) of every row of ``docs`` (doc_id, text).

    Equals encoding each pre-token of the whole text by itself with the vocabulary at ``path`` and no special tokens. Null
    and empty texts have no ids. Null doc_ids and repeated rows are encoded like any other; further columns are ignored; an
    empty table gives an empty result. With ``decoded`` the ids' bytes follow (see ``decode``), looked up by the same workers:
    a second Python step behind the first would keep a second worker busy, and in memory, for every core.
    """
    spark = docs.sparkSession
    look_up = _looking_up(spark, path) if decoded else None
    vocabulary = _Vocabulary(spark, path, pattern)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = spark.sparkContext.broadcast(_head(docs, vocabulary, head_docs, head_words, head_bytes))
    # Equal keys have equal texts and so the same holes; null ids are told apart by their texts alone.
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text").alias("h"), "text")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = _splitter(pattern), head.value.numbers
        for b in batches:
            rows, words, places = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                found: dict[str, list[int]] = {}
                for place, w in enumerate(w for w in split(t or "") if w not in known):
                    found.setdefault(w, []).append(place)
                rows += [i] * len(found)
                words += found
                places += map(_places, found.values())
            at = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(words, pa.string()), pa.array(places, pa.binary())], ["k", "h", "word", "places"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, b""
        for b in batches:
            out = []
            for w, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if w != last:
                    last, ids = w, vocabulary.ids(w)
                out.append(places + ids)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.binary())], ["k", "h", "filling"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pack, press = _splitter(pattern), head.value.pack, zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [press.compress(pack(split(t or ""))) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], ["doc_id", "k", "h", "z"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, fill_in = zstandard.ZstdDecompressor(), head.value.fill
        for b in batches:
            out = [fill_in(press.decompress(z), own).astype("<u4").tobytes() for z, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = {"doc_id": b.column(0), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())}
            if look_up:
                columns["decoded"] = pa.array(map(look_up, out), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    tail = in_batches(keyed.select("k", "h", "text"), rare, "k long, h long, word string, places binary", ROWS).repartition("word").sortWithinPartitions("word")
    own = tail.mapInArrow(once, "k long, h long, filling binary").groupBy("k", "h").agg(F.collect_set("filling").alias("own"))
    met = in_batches(keyed, common, "doc_id long, k long, h long, z binary", ROWS).join(own, ["k", "h"], "left").select("doc_id", "z", "own")
    return in_batches(met, fill, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded, ROWS)


def _looking_up(spark, path: str):
    """The function from ids (or null) to their bytes; the token-byte table is the vocabulary, of fixed size, and goes to every task."""
    ranks = load_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)
    return lambda ids: None if ids is None else b"".join(map(shared.value.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (any columns, and ids as binary) with the decoded bytes as a further column ``decoded``; null ids give null.

    An id that the vocabulary lacks fails the job.
    """
    look_up, at = _looking_up(encoded.sparkSession, path), encoded.drop("decoded").columns.index("ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [look_up(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return in_batches(kept, each, ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), "decoded binary"]), ROWS)
