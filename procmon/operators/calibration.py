"""Calibration of class probabilities at scale.

``points`` are validation rows in long form: grouping keys (label, bucket, class), a predicted probability
``x`` and whether the class came about, ``y`` (0 or 1).  Every group gets its own map:

* sigmoid (Platt) below ``sigmoid_below`` points, fitted within a group of so many rows at most;
* isotonic from there on, by pool-adjacent-violators in rounds: equal ``x`` are first summed to one row,
  then the rows, sorted by group and ``x``, are cut into ranges and pooled within each.  The ranges of the
  next round lie elsewhere; when no two neighbours across a cut violate the order, the blocks are the
  isotonic regression, whatever the cuts were.  No task holds more than a range, however large a group is.

Points without ``x`` or ``y`` don't count.  A group whose points are all of one class, or that has none,
stays as it is (identity).  Between blocks a map is linear, outside of them constant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from procmon.functions import bounded_collect
from procmon.session import scratch_path
from procmon.spec import col

SIGMOID_BELOW = 5_000  # points of a group; the reference's bound
CHUNK = 200_000  # blocks that one task pools
PASS_BLOCKS = 2_000_000  # blocks that one pass of ``apply`` broadcasts
MAX_GROUPS = 1_000_000  # labels x buckets x classes: each belongs to a model that the driver holds


# -- isotonic regression -------------------------------------------------------------


def _pool(keys):
    """Pool adjacent violators of rows sorted by ``keys`` and ``lo``; a partition is one range."""

    def pooled(batches):
        blocks: list = []  # [key, lo, hi, w, s]: of this range so far
        floor = 0  # where the blocks of the current key begin
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "lo", "hi", "w", "s")]
            for *key, lo, hi, w, s in zip(*cols):
                if blocks and blocks[-1][0] != key:
                    floor = len(blocks)
                while len(blocks) > floor and blocks[-1][4] * w >= s * blocks[-1][3]:
                    _, lo, _, w0, s0 = blocks.pop()
                    w, s = w + w0, s + s0
                blocks.append([key, lo, hi, w, s])
        if blocks:
            values = [*zip(*(b[0] for b in blocks)), *zip(*(b[1:] for b in blocks))]
            fields = [batch.schema.field(c) for c in (*keys, "lo", "hi", "w", "s")]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields)], schema=pa.schema(fields))

    return pooled


def isotonic(points: DataFrame, keys, x: str = "x", y: str = "y", chunk: int = CHUNK) -> DataFrame:
    """The blocks of the isotonic regression of ``y`` on ``x`` in each group.

    Returns ``keys``, ``lo``, ``hi`` (the block's range of ``x``), ``w`` (points), ``s`` (sum of ``y``),
    ``value`` and ``part`` (the range that holds the block; ranges follow the order of keys and ``lo``)."""
    spark, keys = points.sparkSession, list(keys)
    path = scratch_path(spark, "isotonic")
    known = points.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(y).isNotNull())
    rows = known.groupBy(*[col(k).alias(k) for k in keys], F.col(x).cast("double").alias("lo")).agg(
        F.count(F.lit(1)).alias("w"), F.sum(F.col(y).cast("double")).alias("s")
    )
    rows.select(*keys, "lo", F.col("lo").alias("hi"), "w", "s").write.parquet(f"{path}/0")
    number = 0
    while True:
        rows = spark.read.parquet(f"{path}/{number}").drop("part")
        n = rows.count()
        order = [*(col(k) for k in keys), F.col("lo")]
        # one range more in every other round: its cuts lie elsewhere
        ranges = rows.coalesce(1) if n <= chunk else rows.repartitionByRange(math.ceil(n / chunk) + number % 2, *order)
        ranges = ranges.sortWithinPartitions(*order)
        number += 1
        pooled = ranges.mapInArrow(_pool(keys), rows.schema)
        pooled.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/{number}")
        out = spark.read.parquet(f"{path}/{number}").withColumn("value", F.col("s") / F.col("w"))
        if n <= chunk or not _violations(out, keys):
            return out


def _violations(blocks: DataFrame, keys) -> bool:
    """Whether a range begins with a block that belongs to the last one of the range before."""
    key, edge = F.struct(*[col(k) for k in keys]), F.struct(*[col(k) for k in keys], F.col("lo"))
    end = F.struct(key.alias("key"), "w", "s")
    edges = blocks.groupBy("part").agg(F.min_by(end, edge).alias("first"), F.max_by(end, edge).alias("last"))
    rows = sorted(edges.collect())  # one row a range
    return any(a["last"]["key"] == b["first"]["key"] and a["last"]["s"] * b["first"]["w"] >= b["first"]["s"] * a["last"]["w"] for a, b in zip(rows, rows[1:]))


# -- sigmoid -------------------------------------------------------------------------------


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """``a`` and ``b`` of 1 / (1 + exp(-(a x + b))) by Newton steps, halved until the loss falls.

    Targets are drawn in by one point of either class (Platt), so separable points have a finite fit."""
    n1 = float(y.sum())
    n0 = len(y) - n1
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.column_stack([x, np.ones_like(x)])

    def loss(v):
        z = design @ v
        return float(np.sum(np.logaddexp(0, z) - t * z))

    v = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(design @ v)))
        gradient = design.T @ (p - t)
        if np.abs(gradient).max() < 1e-9 * len(y):
            break
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-12 * np.eye(2), gradient)
        size, here = 1.0, loss(v)
        while loss(v - size * step) > here and size > 1e-10:
            size /= 2
        v = v - size * step
    return float(v[0]), float(v[1])


# -- fitted maps ---------------------------------------------------------------------------


@dataclass
class Calibration:
    """Maps by group key: sigmoids as numbers, isotonic ones as a table of blocks."""

    keys: list
    sigmoid: dict = field(default_factory=dict)  # key -> (a, b)
    blocks: DataFrame | None = None


def fit(points: DataFrame, keys, sigmoid_below: int = SIGMOID_BELOW, chunk: int = CHUNK) -> Calibration:
    """A map for every group of ``points`` (``keys``, ``x``, ``y``)."""
    keys = list(keys)
    spark = points.sparkSession
    path = scratch_path(spark, "points")
    known = points.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull()).dropna(subset=keys)
    known.select(*[col(k) for k in keys], F.col("x").cast("double").alias("x"), F.col("y").cast("int").alias("y")).write.parquet(path)
    rows = spark.read.parquet(path)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).where("n1 > 0 and n1 < n")
    if (found := bounded_collect(stats, MAX_GROUPS)) is None:
        raise ValueError(f"more than {MAX_GROUPS} groups of {keys}")
    out = Calibration(keys)
    small, large = stats.where(F.col("n") < sigmoid_below), stats.where(F.col("n") >= sigmoid_below)
    types = [rows.schema[k] for k in keys]

    def fit_group(g: pd.DataFrame) -> pd.DataFrame:  # fewer than ``sigmoid_below`` rows
        a, b = platt(g["x"].to_numpy(), g["y"].to_numpy())
        return g[keys].head(1).assign(a=a, b=b)

    if any(r["n"] < sigmoid_below for r in found):
        own = rows.join(F.broadcast(small.select(*keys)), keys, "left_semi")  # at most MAX_GROUPS keys
        schema = StructType([*types, StructField("a", DoubleType()), StructField("b", DoubleType())])
        for r in own.groupBy(*keys).applyInPandas(fit_group, schema).collect():  # a row a group
            out.sigmoid[tuple(r[k] for k in keys)] = (r["a"], r["b"])
    if any(r["n"] >= sigmoid_below for r in found):
        own = rows.join(F.broadcast(large.select(*keys)), keys, "left_semi")
        out.blocks = isotonic(own, keys, chunk=chunk)
    return out


def _slices(blocks: DataFrame, keys, limit: int):
    """The block table in order, in slices of whole ranges with at most ``limit`` blocks (or one range),
    each with the first ``lo`` that comes after it for the key of its last block."""
    counts = sorted(blocks.groupBy("part").count().collect())  # one row a range
    groups: list[list[int]] = []
    room = 0
    for part, n in counts:
        if not groups or n > room:
            groups.append([])
            room = limit
        groups[-1].append(part)
        room -= n
    for i, parts in enumerate(groups):
        rows = blocks.where(F.col("part").between(parts[0], parts[-1])).select(*keys, "lo", "hi", "value").toPandas().sort_values([*keys, "lo"])
        after = None
        if i + 1 < len(groups):
            first = blocks.where(F.col("part") == groups[i + 1][0]).agg(F.min(F.struct(*[col(k) for k in keys], "lo", "value")).alias("f")).first()["f"]
            after = (tuple(first[k] for k in keys), first["lo"], first["value"])
        yield rows, after


def _maps(rows: pd.DataFrame, after, keys, begun) -> dict:
    """key -> (where its values begin and end, and the points between which the map is linear)."""
    out = {}
    for key, g in rows.groupby(keys, sort=False):
        xs, ys = g[["lo", "hi"]].to_numpy().ravel(), np.repeat(g["value"].to_numpy(), 2)
        end = np.inf
        if after is not None and after[0] == key:
            end, xs, ys = after[1], np.r_[xs, after[1]], np.r_[ys, after[2]]
        out[key] = (xs[0] if key in begun else -np.inf, end, xs, ys)
        begun.add(key)
    return out


def apply(rows: DataFrame, calibration: Calibration, columns: dict, by: str = "bucket", limit: int = PASS_BLOCKS) -> DataFrame:
    """Replace probabilities by calibrated ones.

    ``columns`` maps a column of ``rows`` to its key without the bucket, ``(label, class)``; the groups are
    keyed (label, bucket, class).  The maps are broadcast; tables beyond ``limit`` blocks are applied slice by slice,
    each to the values that lie in its ranges, without a shuffle."""
    names = list(columns)
    out = rows.withColumns({f"_q_{i}": F.lit(None).cast("double") for i in range(len(names))})
    if calibration.sigmoid:
        out = _apply_pass(out, {k: ("sigmoid", *v) for k, v in calibration.sigmoid.items()}, columns, by)
    if calibration.blocks is not None:
        begun: set = set()
        for part, after in _slices(calibration.blocks, calibration.keys, limit):
            maps = _maps(part, after, calibration.keys, begun)
            out = _apply_pass(out, {k: ("isotonic", *v) for k, v in maps.items()}, columns, by)
    done = {c: F.coalesce(F.col(f"_q_{i}"), col(c)) for i, c in enumerate(names)}
    return out.withColumns(done).drop(*[f"_q_{i}" for i in range(len(names))])


def _apply_pass(rows: DataFrame, maps: dict, columns: dict, by: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(maps)
    wanted = [(i, c, *key) for i, (c, key) in enumerate(columns.items())]

    def calibrated(batches):
        maps = sent.value
        for batch in batches:
            where = {n: j for j, n in enumerate(batch.schema.names)}
            buckets = batch.column(where[by]).to_pylist()
            at = {b: np.flatnonzero([v == b for v in buckets]) for b in set(buckets) if b is not None}
            arrays = list(batch.columns)
            for i, name, label, cls in wanted:
                x = batch.column(where[name]).to_numpy(zero_copy_only=False).astype(float)
                q = batch.column(where[f"_q_{i}"]).to_numpy(zero_copy_only=False).astype(float).copy()
                for b, own in at.items():
                    kind, *m = maps.get((label, b, cls), (None,))
                    if kind == "sigmoid":
                        q[own] = 1 / (1 + np.exp(-(m[0] * x[own] + m[1])))
                    elif kind == "isotonic":
                        begin, end, xs, ys = m
                        inside = own[(x[own] >= begin) & (x[own] < end)]
                        q[inside] = np.interp(x[inside], xs, ys)
                arrays[where[f"_q_{i}"]] = pa.array(q, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return rows.mapInArrow(calibrated, rows.schema)


def normalise(rows: DataFrame, groups) -> DataFrame:
    """Each list of probability columns divided by its sum; a uniform row where all are 0."""
    out = {}
    for names in groups:
        total = sum((F.col(n) for n in names), F.lit(0.0))
        out |= {n: F.when(total > 0, F.col(n) / total).when(total == 0, F.lit(1.0 / len(names))) for n in names}
    return rows.withColumns(out) if out else rows
