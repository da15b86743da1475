"""Approximate nearest neighbours (largest inner product) by a permutation index.

A bounded sample of the vectors serves as pivots.  Each vector is described by
the order of its nearest pivots (its permutation, cut to a prefix) and posted in
the inverted files of its ``POSTED`` nearest ones.  A query reads the files of its own
nearest pivots until they hold ``SHARE`` of all vectors, ranks their entries by
the footrule distance of the permutations (pivots outside a prefix count as
standing just behind it), and reranks the best ``RERANK`` of each file, and all that are
as far as the last of them, by the exact inner product in double precision.

Equal vectors are indexed once, with their k + 1 smallest ids, which the ranking takes
in their place: copies crowd nothing out, and the order of rows decides nothing.

So that near means a large inner product for vectors of any length, vectors are
lifted to equal length by one more coordinate, which queries hold at zero.

Large files are dealt into blocks, as are their queries, and a task handles one
block of each.  Every vector is indexed.  A query that finds too few vectors in its files
is compared with all rows, in rounds of ``ROUND`` queries.

Vectors that are null, empty, zero, or hold null or non-finite components take no part;
neither do rows without an id, nor vectors of another dimension than the most
frequent one.  Rows with the query's id are its own.  Ties go to the smaller id.  An empty table
gives no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmon.llm.common import written

ROWS_PER_PIVOT, MAX_PIVOTS = 100, 4096
SMALL_ROWS_PER_PIVOT, SMALL_PIVOTS = 16, 512  # smaller tables get up to this many pivots
PREFIX = 96
POSTED = 4
SHARE = 0.75
RERANK = 0.4
LEAST_RERANK = 64
BLOCK = 4096
ROUND = 2048
ROWS_AT_ONCE = 64  # rows of weights that are compared at a time


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, e array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where("id is not null and size(e) > 0")
    rows = rows.withColumn("e", F.expr("transform(e, x -> x + 0D)"))  # no negative zeros
    rows = rows.where("forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x != 0)")
    wide = rows.groupBy(F.size("e").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    return rows.where(F.size("e") == (wide["w"] if wide else 0))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(id, e): each distinct vector with its smallest ids, in order, at most so many."""
    nth = F.dense_rank().over(Window.partitionBy("e").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= ids)  # cut before the exchange too
    return few.groupBy("e").agg(F.sort_array(F.collect_set("id")).alias("id")).select("id", "e")


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes them as long as the longest."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])


def describe(rows: DataFrame, pivots: np.ndarray, longest: float, prefix: int) -> DataFrame:
    """(id, v, perm, qperm): the vector's doubles, and its permutation as an entry and as a query."""
    anchors = lift(pivots, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                perms = [np.argsort(-y, axis=1, kind="stable")[:, :prefix].astype(np.int16) for y in (lift(x, longest) @ anchors.T, x @ anchors[:, :-1].T)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary()) for m in (x, *perms))], ["id", "v", "perm", "qperm"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v binary, perm binary, qperm binary")


def _spread(described: DataFrame, perm: str, lists, own_blocks: np.ndarray, other_blocks: np.ndarray, own: str, other: str) -> DataFrame:
    """A row (p, d, q, id, v, perm) for each list that ``lists`` gives, in its own block and every block of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = lists(b.column(perm))
            row = np.repeat(np.arange(b.num_rows), [len(f) for f in files])
            p = np.concatenate(files).astype(np.int64) if files else np.zeros(0, np.int64)
            block = (b.column("hash").to_numpy()[row] % own_blocks[p]).astype(np.int32)
            times = other_blocks[p]
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, p, block = (np.repeat(x, times) for x in (row, p, block))
            for at in range(0, len(row), BLOCK):
                s = slice(at, at + BLOCK)
                take = pa.array(row[s])
                place = {own: pa.array(block[s]), other: pa.array(nth[s].astype(np.int32))}
                yield pa.RecordBatch.from_arrays([pa.array(p[s].astype(np.int32)), place["d"], place["q"], *(b.column(c).take(take) for c in ("id", "v", perm))], ["p", "d", "q", "id", "v", "perm"])

    kind = described.schema["id"].dataType.simpleString()
    hashed = described.withColumn("hash", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)))
    return hashed.mapInArrow(run, f"p int, d int, q int, id {kind}, v binary, perm binary")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of the k best: larger score, then smaller id."""
    if len(scores) > k:
        least = np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(~(-scores > least))
        scores, ids = scores[some], ids[some]
    order = np.lexsort([ids, -scores])[:k]
    return ids[order], scores[order]


def best(query_id, scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """``top`` as rows of a query."""
    return [(query_id, i, s) for i, s in zip(*(x.tolist() for x in top(scores, ids, k)), strict=True)]


def shared_weights(by_pivot: np.ndarray, pivots: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each column, the sum over some pivots (rows) of the smaller of its weight and ``own``, which are at most ``len(own)``.

    Some rows at a time, as many as sum up within their type and stay near the processor."""
    step, out = max(1, min(ROWS_AT_ONCE, np.iinfo(by_pivot.dtype).max // len(own))), np.zeros(by_pivot.shape[1], np.int64)
    room = np.empty((step, by_pivot.shape[1]), by_pivot.dtype)
    for at in range(0, len(pivots), step):
        some = pivots[at : at + step]
        rows = np.take(by_pivot, some, axis=0, out=room[: len(some)], mode="clip")
        out += np.minimum(rows, own[at : at + step, None], out=rows).sum(0, dtype=rows.dtype)
    return out


def expand(ids: list, scores: np.ndarray, query_id) -> tuple[np.ndarray, np.ndarray]:
    """The scores and ids of all that lists of ids stand for, but for the query's own."""
    flat = np.concatenate(ids) if len(ids) else np.zeros(0)
    repeated = np.repeat(scores, [len(i) for i in ids])
    other = flat != query_id
    return repeated[other], flat[other]


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row for which ``is_query`` (of the column ``id``) holds."""
    rows = usable(vectors, id_col, vector_col)
    single = written(distinct_vectors(rows, k + 1), "vectors")
    n, longest = single.agg(F.count("*"), F.max(F.expr("aggregate(e, 0D, (a, x) -> a + x * x)"))).first()
    kind = rows.schema["id"].dataType.simpleString()
    result = f"query_id {kind}, id {kind}, score double"
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    count = min(n, MAX_PIVOTS, max(PREFIX, n // ROWS_PER_PIVOT, min(SMALL_PIVOTS, n // SMALL_ROWS_PER_PIVOT)))
    pivots = np.array([r[0] for r in single.orderBy(F.xxhash64(F.lit("pivot"), F.col("id")[0]), F.col("id")[0], "e").limit(count).select("e").collect()])
    prefix = min(count, max(PREFIX, count // 8))
    width, posted = pivots.shape[1], min(POSTED, count)
    described = written(describe(single, pivots, longest, prefix), "permutations")

    def entries(column: pa.Array) -> list[np.ndarray]:
        return list(_matrix(column, np.int16, prefix)[:, :posted]) if len(column) else []

    ones = np.ones(count, np.int64)
    sizes = np.zeros(count, np.int64)
    for r in _spread(described, "perm", entries, ones, ones, "d", "q").groupBy("p").count().collect():
        sizes[r[0]] = r[1]

    def probed(column: pa.Array) -> list[np.ndarray]:
        """The files a query reads: nearest first, until they hold enough entries."""
        out = []
        for perm in _matrix(column, np.int16, prefix):
            held = np.cumsum(sizes[perm])
            out.append(perm[: int(np.searchsorted(held, max(SHARE * n, BLOCK))) + 1])
        return out

    asked = written(describe(rows.where(is_query(F.col("id"))), pivots, longest, prefix), "queries")
    readers = np.zeros(count, np.int64)
    for r in _spread(asked, "qperm", probed, ones, ones, "q", "d").groupBy("p").count().collect():
        readers[r[0]] = r[1]
    data_blocks, query_blocks = np.maximum(1, -(-sizes // BLOCK)), np.maximum(1, -(-readers // BLOCK))

    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asking, found, scores = [], [], []
        if len(data) and len(queries):
            p = int(data["p"].iloc[0])
            v, ids = np.frombuffer(b"".join(data["v"]), np.float64).reshape(-1, width), data["id"].to_numpy()
            copies, first = np.array([len(i) for i in ids]), np.array([i[0] for i in ids])
            single, no_copies = copies == 1, bool((copies == 1).all())
            perm = np.frombuffer(b"".join(data["perm"]), np.int16).reshape(-1, prefix).astype(np.int64)
            files = np.ascontiguousarray(perm[:, :posted].T)
            # a pivot's weight falls from ``prefix`` at the first place to 0 outside the prefix
            own = np.arange(prefix, 0, -1, dtype=np.int16)
            weights = np.zeros((len(v), count), np.int16)
            np.put_along_axis(weights, perm, own[None, :], 1)
            by_pivot = np.ascontiguousarray(weights.T)
            of_query = np.empty(count, np.int16)
            for qid, qv, qp in zip(queries["id"].tolist(), queries["v"], queries["perm"], strict=True):
                qperm = np.frombuffer(qp, np.int16)
                of_query[:] = 0
                of_query[qperm] = own
                # entries that a nearer file of the query holds too are handled there
                here = np.flatnonzero((of_query[files].max(0) == of_query[p]) & ~(single & (first == qid)))
                if len(here) == 0:
                    continue
                keep = max(LEAST_RERANK, int(RERANK * len(here)))
                if keep < len(here):
                    # the footrule distance of two prefixes, absent pivots at ``prefix``, is a constant of the query less twice the sum of
                    # their pivots' smaller weights
                    near = shared_weights(by_pivot, qperm, own)[here]
                    here = here[near >= np.partition(near, len(here) - keep)[len(here) - keep]]
                score = (v[here] * np.frombuffer(qv, np.float64)).sum(1)
                i, score = top(*((score, first[here]) if no_copies else expand(ids[here].tolist(), score, qid)), k)
                asking += [qid] * len(i)
                found.append(i)
                scores.append(score)
        if not asking:
            return pd.DataFrame([], columns=["query_id", "id", "score"])
        return pd.DataFrame({"query_id": asking, "id": np.concatenate(found), "score": np.concatenate(scores)})

    data = _spread(described, "perm", entries, data_blocks, query_blocks, "d", "q")
    queries = _spread(asked, "qperm", probed, query_blocks, data_blocks, "q", "d")
    found = data.groupBy("p", "d", "q").cogroup(queries.groupBy("p", "d", "q")).applyInPandas(run, result)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = written(found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")

    others = rows.select("id").distinct().count() - 1
    short = asked.select("id", "v").dropDuplicates(["id"]).join(ranked.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("have")), "id", "left").where(F.coalesce("have", F.lit(0)) < min(k, others))
    few = written(short.select("id", "v", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")).alias("nth")), "short")
    rounds = few.agg(F.max("nth")).first()[0] or 0
    step = ROUND // 64
    for lo in range(0, rounds, step):
        some = few.where((F.col("nth") > lo) & (F.col("nth") <= lo + step)).collect()  # at most ROUND queries
        ranked = ranked.join(few.where((F.col("nth") > lo) & (F.col("nth") <= lo + step)).select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_scan(described, some, width, k, result, order))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _scan(described: DataFrame, queries: list, width: int, k: int, result: str, order) -> DataFrame:
    """The k nearest of a bounded list of queries among all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "id", "score"]
        for b in batches:
            v, ids = _matrix(b.column("v"), np.float64, width), [np.array(i) for i in b.column("id").to_pylist()]
            out: list[tuple] = []
            for q in queries:
                out += best(q["id"], *expand(ids, (v * np.frombuffer(bytes(q["v"]), np.float64)).sum(1), q["id"]), k)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"score": "float64"}), preserve_index=False) if out else pa.RecordBatch.from_arrays([ids_[:0] for ids_ in (b.column("id").flatten(), b.column("id").flatten(), pa.array([], pa.float64()))], names)

    found = described.select("id", "v").mapInArrow(run, result).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
