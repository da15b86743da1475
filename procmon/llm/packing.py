"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (plus an end id) are cut into full windows of ``window``
ids and a rest of parts of at most ``grain`` ids.  Full windows are sequences of
their own.  The parts are dealt into blocks of bounded size by a hash of their
row, and each block is packed on its own: every part starts as a partial
partition with one non-empty window, the two partitions of the largest spread
are merged with opposite order (largest with smallest), until one partition into
near-equal windows is left.  If a window exceeds the capacity the number of
windows rises and the block is packed again.

Null and empty texts give a piece that holds the end id alone.  Repeated rows
are packed as often as they occur.  An empty table gives no rows.  Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.chunks import encoder
from procmon.llm.common import slices, texts, written

WINDOW = 4096
BLOCK_WINDOWS = 256  # windows' worth of rests that one block packs
GRAIN = 1024  # the longest part of a rest; shorter parts leave less padding, longer ones cut fewer documents


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Deal ``sizes`` into ``k`` windows of near-equal sums; returns each item's window.

    A partial partition keeps its k sums in ascending order; leaves are single
    items.  The merges form a tree, from whose root the windows are handed down.
    """
    if k == 1:
        return np.zeros(len(sizes), np.int64)
    heap: list[tuple[int, int]] = []
    sums: dict[int, np.ndarray] = {}
    for i, s in enumerate(sizes.tolist()):
        one = np.zeros(k, np.int64)
        one[-1] = s
        sums[i] = one
        heap.append((-s, i))
    heapq.heapify(heap)
    tree: dict[int, tuple[int, int, np.ndarray]] = {}
    node = len(sizes)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        both -= both[0]
        sums[node], tree[node] = both, (a, b, order)
        heapq.heappush(heap, (-int(both[-1]), node))
        node += 1
    out = np.zeros(len(sizes), np.int64)
    stack = [(heap[0][1], np.arange(k))]
    while stack:
        at, windows = stack.pop()
        if at < len(sizes):
            out[at] = windows[-1]
            continue
        a, b, order = tree.pop(at)
        of_a = np.empty(k, np.int64)
        of_a[order] = windows
        stack += [(a, of_a), (b, of_a[::-1])]
    return out


def pack_sizes(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Windows of items (each at most ``window``), none above the capacity."""
    if len(sizes) == 0:
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // window), int((2 * sizes > window).sum()))
    while True:
        dealt = difference(sizes, k)
        if np.bincount(dealt, weights=sizes, minlength=k).max() <= window:
            return dealt
        k += 1 if k < 1024 else k // 512


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens[, ids]).

    ``ids`` holds the piece as little-endian unsigned 32-bit integers.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file, "word")
        for b in slices(batches, "t"):
            ids, off = own.encode(texts(b, "t"))
            row, start, length, crc, total, payload = [], [], [], [], [], []
            for i in range(b.num_rows):
                doc = np.append(ids[off[i] : off[i + 1]], end_id).astype("<u4")
                whole = len(doc) // window * window
                marks = [*range(0, whole, window), *range(whole, len(doc), grain), len(doc)]
                for s, e in zip(marks, marks[1:], strict=False):
                    part = doc[s:e].tobytes()
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(doc))
                    if with_ids:
                        payload.append(part)
            cols = [b.column("k").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["k", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(payload, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"k {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", id_col)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN, block_windows: int = BLOCK_WINDOWS, with_ids: bool = False) -> DataFrame:
    """Every id of every document in exactly one piece: ``pieces`` plus sequence_id and offset.

    Full windows have odd sequence ids, packed ones even ids; ids are unique,
    not gapless.
    """
    cut = pieces(docs, tokenizer_file, end_id, id_col, text_col, window, grain, with_ids)
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == window).withColumns({"sequence_id": F.col("row") * 2 + 1, "offset": F.lit(0).cast("long")}).drop("row")
    rest = cut.where(F.col("length") < window)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(tokens / (window * block_windows)))

    kinds = {f.name: f.dataType.simpleString() for f in rest.drop("row").schema} | {"sequence_id": "bigint", "offset": "bigint"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        pdf["w"] = pack_sizes(pdf["length"].to_numpy(np.int64), window)
        pdf = pdf.sort_values(["w", "row"], kind="stable")
        pdf["offset"] = pdf.groupby("w")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = (pdf["block"] * (1 << 20) + pdf["w"]) * 2
        return pdf[list(kinds)]

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks).cast("long")))
    packed = dealt.groupBy("block").applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in kinds.items()))
    return full.unionByName(packed)
