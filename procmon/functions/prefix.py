"""Running sums over a global order without a single-partition window.

The rows are cut into ranges of the first order key at approximate quantiles;
each range is summed by a window inside its own partition, and the totals of
the ranges before it (a table with one row per range, so its size is bounded
by the number of ranges) are added.  A value of the first key that holds many
rows becomes a range of its own and is cut further by equal-width ranges of
the second key, so a hot timestamp does not land in one task.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmon.session import shuffle_partitions


def _bucketize(df: DataFrame, key: str, splits: list[float], out: str) -> DataFrame:
    from pyspark.ml.feature import Bucketizer

    full = [-math.inf, *splits, math.inf]
    tmp = f"{out}__d"
    b = Bucketizer(splits=full, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn(tmp, F.col(key).cast("double"))).drop(tmp).withColumn(out, F.col(out).cast("int"))


def ordered_running_sum(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str,
    inclusive: bool = True,
    n_buckets: int | None = None,
) -> DataFrame:
    """``out`` = sum of ``value`` over the rows whose ``keys`` tuple is <= (``inclusive``)
    or < this row's.  ``keys`` are integral columns and unique per row."""
    spark = df.sparkSession
    nb = n_buckets or max(8, 2 * shuffle_partitions(spark))
    k0 = keys[0]
    base = df.persist()

    fractions = [i / nb for i in range(1, nb)]
    quant = base.agg(F.percentile_approx(F.col(k0), fractions, max(10_000, 4 * nb)).alias("q")).first()["q"] or []
    seen = Counter(quant)
    splits = set()
    for v, c in seen.items():
        splits.add(float(v))
        if c > 1:  # a value spanning several quantiles: give it a range of its own
            splits.add(float(v) + 1.0)
    b = _bucketize(base, k0, sorted(splits), "_b")

    sub = F.lit(0)
    integral = ("bigint", "int", "smallint", "tinyint")
    if len(keys) > 1 and dict(base.dtypes)[keys[1]] in integral:
        k1 = keys[1]
        stats = b.groupBy("_b").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(k0).alias("lo0"),
            F.max(k0).alias("hi0"),
            F.min(k1).alias("lo1"),
            F.max(k1).alias("hi1"),
        ).collect()  # one row per range: bounded by nb + the repeated quantiles
        total = sum(r["n"] for r in stats)
        target = max(1, 2 * total // nb)
        hot = {r["_b"]: r for r in stats if r["n"] > target and r["lo0"] == r["hi0"]}
        if hot:
            # sub-ranges are computed in double precision: monotone in the key (so the order
            # inside a range stays exact) and free of 64-bit overflow for hash-like keys
            parts = {bb: int(math.ceil(r["n"] / target)) for bb, r in hot.items()}
            nsub = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("_b"))
            lo1 = F.element_at(F.create_map(*[F.lit(x) for bb, r in hot.items() for x in (bb, float(r["lo1"]))]), F.col("_b"))
            span = F.element_at(
                F.create_map(*[F.lit(x) for bb, r in hot.items() for x in (bb, float(r["hi1"]) - float(r["lo1"]) + 1.0)]), F.col("_b")
            )
            pos = F.floor((F.col(k1).cast("double") - lo1) * nsub / span).cast("int")
            sub = F.when(F.col("_b").isin(list(hot)), F.least(F.greatest(pos, F.lit(0)), nsub - 1)).otherwise(F.lit(0))
    b = b.withColumn("_s", sub)

    totals = b.groupBy("_b", "_s").agg(F.sum(value).cast("long").alias("_t"))
    w_all = Window.orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", "_s", F.coalesce(F.sum("_t").over(w_all), F.lit(0)).cast("long").alias("_off"))
    # offsets has one row per range (bounded by the number of ranges)
    b = b.join(F.broadcast(offsets), on=["_b", "_s"], how="inner")

    w = Window.partitionBy("_b", "_s").orderBy(*[F.col(k) for k in keys]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum(F.col(value)).over(w).cast("long") + F.col("_off")
    if not inclusive:
        run = run - F.col(value).cast("long")
    return b.withColumn(out, run).drop("_b", "_s", "_off")

