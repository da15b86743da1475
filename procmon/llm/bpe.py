"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` turns each whole text into its ids.  Long texts are first cut at safe
boundaries (a space between a non-space and a letter, where the pattern always
begins a new match), so that no single call sees a very long text.  A single
match of thousands of bytes, which the library merges in quadratic time, is
merged here with a heap.  ``decode`` joins the raw bytes of the ids; the bytes
need not be valid UTF-8 piece by piece.

Null and empty texts have no ids.  Repeated rows give repeated results; extra
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import slices, texts

LONG_TEXT = 1 << 15  # characters; longer texts are cut at safe boundaries
LONG_MATCH = 2000  # characters; longer single matches are merged with a heap
_SAFE = regex.compile(r"(?<=\S) (?=\p{L})")
_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


class Coder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.long_match = regex.compile(rf"\S{{{LONG_MATCH},}}|\s{{{LONG_MATCH},}}")

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_MATCH:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text):
            if self.long_match.search(part):
                for m in self.pattern.finditer(part):
                    piece = m.group()
                    ids += merge(piece.encode(), self.ranks) if len(piece) >= LONG_MATCH else self.encoding.encode_ordinary(piece)
            else:
                ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def safe_parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cut a text into parts of about ``size`` characters that can be encoded one by one."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one long match, lowest rank first and leftmost among equals, in n log n."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed meanwhile
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: (id, ids array<int>)."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file, pattern)
        for b in slices(batches, "t"):
            ids = [own.encode(t) for t in texts(b, "t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    out = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {id_type}, ids array<int>")
    return out.select(F.col("k").alias(id_col), "ids")


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Raw bytes of every id list: (id, raw binary); null lists give empty bytes."""
    id_type = encoded.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file, pattern)
        for b in batches:
            raw = [own.decode(ids or []) for ids in b.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(raw, pa.binary())], ["k", "raw"])

    out = encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("i")).mapInArrow(run, f"k {id_type}, raw binary")
    return out.select(F.col("k").alias(id_col), "raw")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256).

    The digests are taken beside the codec, so that ids and bytes do not travel
    through Spark only to be hashed.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file, pattern)
        for b in slices(batches, "t"):
            n, ids_sha, raw_sha = [], [], []
            for t in texts(b, "t").to_pylist():
                ids = own.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                raw_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", id_col)
