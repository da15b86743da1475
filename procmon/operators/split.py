"""Splits, prefixes and selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.functions.select import kth_smallest
from procmon.functions.time import epoch_micros
from procmon.spec import LogSpec, col


def case_starts(df: DataFrame, spec: LogSpec) -> DataFrame:
    """``(case, _start)``: start of each case in microseconds."""
    return df.groupBy(col(spec.case).alias(spec.case)).agg(epoch_micros(F.min(col(spec.ts))).alias("_start"))


def first_part(keyed: DataFrame, keys: list[str], ratio: float):
    """A condition on ``keys`` that the first ``ceil(ratio * N)`` rows of ``keyed`` meet, in the order of ``keys``."""
    n = keyed.count()
    k = int(math.ceil(ratio * n))
    if k <= 0 or k >= n:
        return F.lit(k > 0)
    cut = kth_smallest(keyed, keys, k, n=n)
    cond = None
    for i in range(len(keys) - 1, -1, -1):
        c, v = F.col(keys[i]), F.lit(cut[i])
        cond = (c <= v) if cond is None else (c < v) | ((c == v) & cond)
    return cond


def _split_by_key(df: DataFrame, spec: LogSpec, keyed: DataFrame, keys: list[str], ratio: float, hot=None):
    keyed = keyed.persist()  # counted, searched and filtered: one row per case
    train_cases = keyed.where(first_part(keyed, keys, ratio)).select(spec.case)
    from procmon.operators.segmented import case_join

    return case_join(df, spec, train_cases, "left_semi", hot), case_join(df, spec, train_cases, "left_anti", hot)


def temporal_split(df: DataFrame, spec: LogSpec, ratio: float = 0.8, hot=None):
    """The first ``ceil(ratio * N)`` cases by ``(start, case)`` are train, the rest test.

    The cutoff case is found by distributed selection; the log is then split by
    a literal predicate and a semi/anti join, without a global sort."""
    keyed = case_starts(df, spec)
    return _split_by_key(df, spec, keyed, ["_start", spec.case], ratio, hot)


def case_hash(spec: LogSpec, seed: int):
    """A seeded 60-bit hash of the case id that any SQL engine can compute (MD5)."""
    digest = F.md5(F.concat(col(spec.case).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def random_split(df: DataFrame, spec: LogSpec, ratio: float = 0.8, seed: int = 22, hot=None):
    """Seeded random split of cases (ordered by ``case_hash``; deterministic under any
    partitioning and engine)."""
    keyed = df.select(col(spec.case).alias(spec.case)).distinct().withColumn("_h", F.coalesce(case_hash(spec, seed), F.lit(-1)))
    return _split_by_key(df, spec, keyed, ["_h", spec.case], ratio, hot)


def three_way_split(df: DataFrame, spec: LogSpec, r1: float = 0.8, r2: float = 0.8, hot=None):
    """D3: train+validation / test by ``r1``, then train / validation by ``r2`` (both temporal)."""
    train_val, test = temporal_split(df, spec, r1, hot)
    train, val = temporal_split(train_val, spec, r2, hot)
    return train, val, test


# strata of a stratified k-fold are told apart by a hash below this; two classes that share one are cut as one
STRATA = 1 << 50


def kfold(df: DataFrame, spec: LogSpec, k: int = 5, label: str | None = None, seed: int = 22, hot=None) -> DataFrame:
    """Fold number per event, assigned per case (shuffled k-fold, or stratified by the
    case's ``label``).

    Cases are ordered by a seeded hash (inside their class when stratified) and
    cut into ``k`` contiguous blocks of sizes ``n // k`` or ``n // k + 1``, the
    first ``n % k`` blocks being the larger ones.  The rank of a case comes from
    a global running count (functions/prefix.py), so no class is ranked by a
    single task, and any number of classes stays out of the driver.  Fold ``i``'s
    test part is ``fold == i``; ``hot`` cases are salted."""
    from procmon.functions.prefix import ordered_running_sum
    from procmon.operators.segmented import case_join

    case = col(spec.case).alias(spec.case)
    if label is None:
        cases = df.select(case).distinct().withColumn("_c", F.lit(0).cast("long"))
    else:
        cases = df.groupBy(case).agg(F.first(col(label), ignorenulls=True).cast("string").alias("_cls"))
        cases = cases.withColumn("_c", F.pmod(F.xxhash64("_cls"), F.lit(STRATA)))
    keyed = cases.select(spec.case, "_c", F.coalesce(case_hash(spec, seed), F.lit(-1)).alias("_h"), F.lit(1).alias("_one"))
    ranked = ordered_running_sum(keyed, ["_c", "_h"], "_one", "_r", inclusive=True)
    strata = ranked.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_start"))  # a row a class
    ranked = ranked.join(strata, "_c")
    n, r = F.col("_n"), F.col("_r") - F.col("_start")  # 0-based rank inside the class
    q, m = F.floor(n / k), n % k
    fold = F.when(r < (q + 1) * m, F.floor(r / (q + 1))).otherwise(m + F.floor((r - (q + 1) * m) / q))
    return case_join(df, spec, ranked.select(spec.case, fold.cast("int").alias("fold")), "inner", hot)


def prefix_log(df: DataFrame, spec: LogSpec, min_len: int = 1, max_len: int | None = None, key: str = "prefix_len", hot=None) -> DataFrame:
    """Every prefix of ``n`` events (``min_len <= n <= max_len``, ``n < case length``) as its
    own trace, keyed by ``(case, prefix_len)``; one pass, no loop over lengths."""
    if hot is not None:  # large cases: positions segment by segment
        from procmon.operators.segmented import case_context

        x = case_context(df, spec, hot).withColumnRenamed("_pos", "_nr")
    else:
        w, wc = spec.window(), spec.whole_case()
        x = df.withColumns({"_nr": F.row_number().over(w), "_len": F.count(F.lit(1)).over(wc)})
    hi = F.col("_len") - 1 if max_len is None else F.least(F.lit(max_len), F.col("_len") - 1)
    lo = F.greatest(F.lit(min_len), F.col("_nr"))
    x = x.where(lo <= hi)  # sequence() would count down otherwise
    out = x.withColumn(key, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    return out.withColumn("case_length", F.col(key)).drop("_nr", "_len")


def partial_traces(df: DataFrame, spec: LogSpec, ratio: float = 0.8, min_len: int = 2, max_len: int = 20, hot=None) -> DataFrame:
    """Prefixes of the test cases of a temporal split."""
    _, test = temporal_split(df, spec, ratio, hot)
    return prefix_log(test, spec, min_len, max_len, hot=hot)


def length_quantile(df: DataFrame, spec: LogSpec, q: float = 0.9) -> int:
    """``ceil`` of the interpolated ``q``-quantile of case lengths, from the length histogram
    (one row per distinct length, size-checked); beyond that, by distributed selection."""
    from procmon.functions import bounded_collect
    from procmon.functions.select import exact_quantile

    hist = bounded_collect(length_histogram(df, spec), 1_000_000)
    if hist is None:
        per_case = df.groupBy(col(spec.case)).agg(F.count(F.lit(1)).cast("double").alias("n"))
        return int(math.ceil(exact_quantile(per_case, "n", q)))
    counts = sorted((r["case_length"], r["n_cases"]) for r in hist)
    n = sum(c for _, c in counts)
    pos = q * (n - 1)

    def at(i):
        seen = 0
        for v, c in counts:
            seen += c
            if i < seen:
                return v
        return counts[-1][0]

    lo, hi = at(math.floor(pos)), at(math.ceil(pos))
    return int(math.ceil(lo + (hi - lo) * (pos - math.floor(pos))))


def restrict(df: DataFrame, spec: LogSpec, cases: DataFrame, anti: bool = False, hot=None) -> DataFrame:
    """Events of (or not of) the given cases (salted for ``hot`` cases)."""
    from procmon.operators.segmented import case_join

    return case_join(df, spec, cases, "left_anti" if anti else "left_semi", hot)


def case_index(df: DataFrame, spec: LogSpec) -> DataFrame:
    """The distinct case ids."""
    return df.select(col(spec.case).alias(spec.case)).distinct()


def prefixes_of(prefixes: DataFrame, n: int, key: str = "prefix_len") -> DataFrame:
    """The prefixes of exactly ``n`` events."""
    return prefixes.where(F.col(key) == n)


def prefix_sizes(prefixes: DataFrame, spec: LogSpec, key: str = "prefix_len") -> DataFrame:
    """Number of prefixes per length (all lengths in one aggregation)."""
    return prefixes.groupBy(key).agg(F.count_distinct(col(spec.case)).alias("n_prefixes"))


def length_histogram(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Number of cases per case length."""
    per_case = df.groupBy(col(spec.case)).agg(F.count(F.lit(1)).alias("case_length"))
    return per_case.groupBy("case_length").agg(F.count(F.lit(1)).alias("n_cases"))
