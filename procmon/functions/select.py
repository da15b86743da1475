"""Exact order statistics without a global sort.

``kth_smallest`` narrows a key range with two sampled pivots about the wanted rank and one
counting pass per round (each round cuts the range by about the root of the sample); only the
final range, at most ``small`` rows, is collected.  Keys may repeat.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cmp(keys: list[str], vals: tuple, strict: bool) -> Column:
    """Lexicographic ``keys < vals`` (strict) or ``keys <= vals``."""
    out = None
    for i in range(len(keys) - 1, -1, -1):
        c, v = F.col(keys[i]), F.lit(vals[i])
        if out is None:
            out = (c < v) if strict else (c <= v)
        else:
            out = (c < v) | ((c == v) & out)
    return out


def kth_smallest(
    df: DataFrame, keys: list[str], k: int, small: int = 100_000, n_pivots: int = 128, seed: int = 17, n: int | None = None
) -> tuple:
    """The ``k``-th smallest (1-based) key tuple of ``df`` in lexicographic order of ``keys``.
    ``n`` (the number of non-null keys, when known) saves a counting pass; a round samples about ``400 * n_pivots`` rows."""
    notnull = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    if n is not None and n <= small:
        vals = sorted(tuple(r) for r in df.select(*keys).where(notnull).collect())
        return vals[k - 1]
    base = df.select(*keys).where(notnull).persist()
    lo = hi = None  # exclusive bounds of the candidate range
    below = 0  # rows <= lo
    try:
        for attempt in range(200):
            cand = base
            if lo is not None:
                cand = cand.where(~_cmp(keys, lo, strict=False))
            if hi is not None:
                cand = cand.where(_cmp(keys, hi, strict=True))
            n = cand.count()
            if n == 0:
                raise ValueError("k out of range")
            if n <= small:
                vals = sorted(tuple(r) for r in cand.collect())
                return vals[k - below - 1]
            frac = min(1.0, 20.0 * n_pivots * 20 / n)
            sample = sorted(tuple(r) for r in cand.sample(False, frac, seed + attempt).collect())
            if not sample:
                continue
            pivots = _around(sample, (k - below) / n)
            aggs = []
            for p in pivots:
                aggs.append(F.sum(F.when(_cmp(keys, p, strict=False), 1).otherwise(0)).alias(f"le{len(aggs)}"))
                aggs.append(F.sum(F.when(_cmp(keys, p, strict=True), 1).otherwise(0)).alias(f"lt{len(aggs)}"))
            row = cand.agg(*aggs).first()
            le = [row[2 * i] for i in range(len(pivots))]
            lt = [row[2 * i + 1] for i in range(len(pivots))]
            for i, p in enumerate(pivots):
                if below + le[i] >= k:
                    if below + lt[i] < k:
                        return p
                    hi = p
                    if i > 0:
                        lo, below = pivots[i - 1], below + le[i - 1]
                    break
            else:
                lo, below = pivots[-1], below + le[-1]
        raise RuntimeError("selection did not converge")
    finally:
        base.unpersist()


def _around(sample: list[tuple], share: float) -> list[tuple]:
    """One or two pivots of a sorted sample that enclose the row at ``share`` but for a deviation of four sigma."""
    m = len(sample)
    margin = 2 * math.sqrt(m) + 1
    at = [math.floor(share * m - margin), math.ceil(share * m + margin)]
    return sorted({sample[i] for i in at if 0 <= i < m}) or [sample[m // 2]]


def exact_quantile(df: DataFrame, name: str, q: float) -> float:
    """Quantile with linear interpolation between order statistics (``quantile_cont``)."""
    values = df.select(name).where(F.col(name).isNotNull()).persist()
    try:
        n = values.count()
        if n == 0:
            return None
        pos = q * (n - 1)
        lo_i, hi_i = math.floor(pos), math.ceil(pos)
        lo = kth_smallest(values, [name], lo_i + 1, n=n)[0]
        if hi_i == lo_i:
            return lo
        x = F.col(name)
        after = values.agg(F.count(F.when(x <= F.lit(lo), F.lit(1))).alias("n"), F.min(F.when(x > F.lit(lo), x)).alias("x")).first()
        hi = lo if after["n"] > hi_i else after["x"]
        return lo + (hi - lo) * (pos - lo_i)
    finally:
        values.unpersist()


# Largest group whose values one task may hold for an exact percentile.
MAX_GROUP_VALUES = 100_000
# A rank of ``percentile_approx`` is off by at most the group's size over this.
ACCURACY = 10_000


def grouped_median(df: DataFrame, by: str, name: str, out: str = "median") -> DataFrame:
    """Exact interpolated median of ``name`` per ``by`` group.

    Groups up to ``MAX_GROUP_VALUES`` rows use Spark's exact ``percentile`` (it
    holds a group's values in one task, so their number is checked first);
    the medians of larger groups come from two passes over all of them.  The number of groups must be
    small (a row for each of the large ones is collected)."""
    counts = df.where(F.col(name).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    big = {r[by]: r["_n"] for r in counts.where(F.col("_n") > MAX_GROUP_VALUES).collect()}
    small = df.where(~F.col(by).isin(list(big))) if big else df
    # each of these groups has at most MAX_GROUP_VALUES values (checked above)
    res = small.groupBy(by).agg(F.percentile(F.col(name), 0.5).alias(out))
    if big:
        spark = df.sparkSession
        rows = _large_medians(df.where(F.col(by).isin(list(big)) & F.col(name).isNotNull()).select(by, name), by, name, big)
        res = res.unionByName(spark.createDataFrame(rows, res.schema))
    return res


def _large_medians(df: DataFrame, by: str, name: str, sizes: dict) -> list[tuple]:
    """(group, median) of groups of known sizes.

    An approximate quantile on either side encloses each median, within a share of some 1/1,000 of its group; the second pass
    counts the values below and each value inside, among which the middle ranks are found."""
    x, margin = F.col(name), 3 / ACCURACY
    near = df.groupBy(by).agg(F.percentile_approx(x, [0.5 - margin, 0.5 + margin], ACCURACY).alias("q")).collect()  # a row per group
    kind = df.schema[name].dataType.simpleString()
    schema = f"_g {df.schema[by].dataType.simpleString()}, _lo {kind}, _hi {kind}, _n long"
    bounds = df.sparkSession.createDataFrame([(r[by], r["q"][0], r["q"][1], sizes[r[by]]) for r in near], schema)
    inside = df.join(F.broadcast(bounds), F.col(by) == F.col("_g")).where(x <= F.col("_hi"))
    counted = inside.groupBy("_g", "_n", F.when(x >= F.col("_lo"), x).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # the values below come first, as null
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first()))
    ranked = counted.withColumn("_upto", upto)
    first, second = F.floor((F.col("_n") - 1) / 2) + 1, F.ceil((F.col("_n") - 1) / 2) + 1
    reached = lambda k: F.min(F.when((F.col("_upto") >= k) & F.col("_v").isNotNull(), F.col("_v")))
    enclosed = F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_upto"))), F.lit(0)) < F.min(first)
    found = ranked.groupBy("_g").agg(reached(first).alias("a"), reached(second).alias("b"), enclosed.alias("ok")).collect()  # a row per group
    at = {r["_g"]: r for r in found}
    out = []
    for g in sizes:
        r = at.get(g)
        if r is None or not r["ok"] or r["a"] is None or r["b"] is None:  # not enclosed: beyond the error of the approximation
            out.append((g, exact_quantile(df.where(F.col(by) == g), name, 0.5)))
        else:
            out.append((g, float(r["a"] + (r["b"] - r["a"]) * ((sizes[g] - 1) / 2 % 1))))
    return out
