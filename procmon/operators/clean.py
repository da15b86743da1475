"""Projection, filtering and cleaning of event logs.

Case-level filters aggregate per case first (partial aggregation on the map
side) and return to the events through a semi/anti join, which AQE can split
when one case is very large.  Level vocabularies are collected to the driver
only below a checked size; larger ones are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.functions import bounded_collect
from procmon.functions.time import in_unit, micros_between
from procmon.session import scratch_path
from procmon.spec import LogSpec, col

# Largest vocabulary that is shipped to the executors as a literal set.
MAX_LITERAL_LEVELS = 10_000


def strip_prefix(df: DataFrame, prefix: str = "(case) ") -> DataFrame:
    """Remove ``prefix`` from column names."""
    return df.toDF(*[c.replace(prefix, "") for c in df.columns])


def project(df: DataFrame, spec: LogSpec, extra: tuple[str, ...] = ()) -> DataFrame:
    """Keep the spec's columns (and ``extra``)."""
    names = [spec.case, spec.activity, spec.ts, spec.tiebreak, *spec.cat_cols, *spec.num_cols, *extra]
    return df.select(*[col(c) for c in dict.fromkeys(names)])


def where_attr(df: DataFrame, name: str, value) -> DataFrame:
    """Events whose attribute equals ``value``."""
    return df.where(col(name) == F.lit(value))


def swap_values(df: DataFrame, name: str, a, b) -> DataFrame:
    """Exchange two values of a column."""
    c = col(name)
    return df.withColumn(name, F.when(c == a, F.lit(b)).when(c == b, F.lit(a)).otherwise(c))


def fill_case_id(df: DataFrame, spec: LogSpec, value: str = "missing_caseid") -> DataFrame:
    """P5: missing case ids become one placeholder case."""
    return df.withColumn(spec.case, F.coalesce(col(spec.case), F.lit(value)))


def drop_cols(df: DataFrame, cols) -> DataFrame:
    """P6."""
    return df.drop(*cols)


def _last_activity(spec: LogSpec) -> Column:
    """Activity of the last event with a non-null activity (order ``ts, tiebreak``)."""
    a = col(spec.activity)
    return F.max_by(a, F.when(a.isNotNull(), F.struct(col(spec.ts), col(spec.tiebreak))))


def _by_case(df: DataFrame, spec: LogSpec, cases: DataFrame, keep: bool, hot=None) -> DataFrame:
    """Events of (or not of) ``cases``; ``hot`` cases (``segmented.hot_cases``) are salted."""
    from procmon.operators.segmented import case_join

    return case_join(df, spec, cases, "left_semi" if keep else "left_anti", hot)


def filter_last_activity(df: DataFrame, spec: LogSpec, acts, keep: bool = False, hot=None) -> DataFrame:
    """Drop (``keep=False``) or keep the cases whose last activity is in ``acts``."""
    last = df.groupBy(col(spec.case)).agg(_last_activity(spec).alias("_last"))
    cases = last.where(F.col("_last").isin(list(acts))).select(spec.case)
    return _by_case(df, spec, cases, keep, hot)


def filter_any_activity(df: DataFrame, spec: LogSpec, acts, hot=None) -> DataFrame:
    """Keep cases in which any of ``acts`` occurs."""
    hit = df.where(col(spec.activity).isin(list(acts))).select(spec.case).distinct()
    return _by_case(df, spec, hit, True, hot)


def filter_min_length(df: DataFrame, spec: LogSpec, k: int, hot=None) -> DataFrame:
    """Keep cases with more than ``k`` events."""
    long_cases = df.groupBy(col(spec.case)).count().where(F.col("count") > k).select(spec.case)
    return _by_case(df, spec, long_cases, True, hot)


def ffill(df: DataFrame, spec: LogSpec, cols, hot=None) -> DataFrame:
    """P10: forward fill inside the case, column by column (segment-wise for ``hot`` cases)."""
    if hot is not None:
        from procmon.operators.segmented import case_context

        cols = list(cols)
        x = case_context(df, spec, hot, ffill=cols)
        return x.withColumns({c: col(f"_ffill_{c}") for c in cols}).drop("_pos", "_len", *[f"_ffill_{c}" for c in cols])
    w = spec.running()
    return df.withColumns({c: F.last(col(c), ignorenulls=True).over(w) for c in cols})


def impute(df: DataFrame, spec: LogSpec, cat_value: str = "missing", num_value: float = 0.0) -> DataFrame:
    """Categorical nulls -> ``missing``; numeric nulls -> 0."""
    cats = [c for c in spec.cat_cols if c in df.columns]
    nums = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    fills = {c: F.coalesce(col(c), F.lit(cat_value)) for c in cats}
    fills.update({c: F.coalesce(col(c), F.lit(num_value).cast(df.schema[c].dataType)) for c in nums if c not in fills})
    return df.withColumns(fills)


def level_counts(df: DataFrame, cols) -> DataFrame:
    """Event counts per ``(column, level)`` in one pass (unpivot, then aggregate)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("level")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.column", "p.level").groupBy("column", "level").count()


def _replace_outside(df: DataFrame, name: str, kept: DataFrame, other: str) -> DataFrame:
    """Values of ``name`` not in ``kept.level`` become ``other`` (size-checked broadcast)."""
    rows = bounded_collect(kept, MAX_LITERAL_LEVELS)  # size-checked literal set
    if rows is not None:
        levels = [r[0] for r in rows]
        return df.withColumn(name, F.when(col(name).cast("string").isin(levels), col(name).cast("string")).otherwise(F.lit(other)))
    k = kept.select(F.col("level").alias("_lvl"), F.lit(True).alias("_kept"))
    out = df.join(k, col(name).cast("string") == F.col("_lvl"), "left")
    return out.withColumn(name, F.when(F.col("_kept"), col(name).cast("string")).otherwise(F.lit(other))).drop("_lvl", "_kept")


def _written_counts(df: DataFrame, cols) -> DataFrame:
    """``level_counts`` as a table in the shared folder: counted once, with no cache to release."""
    path = scratch_path(df.sparkSession, "levels")
    level_counts(df, cols).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rare_to_other(df: DataFrame, cols, min_count: int = 10, other: str = "other") -> DataFrame:
    """Levels with fewer than ``min_count`` events become ``other``.  The input is read
    twice: its ``cols`` for the counts, a written table, then whole."""
    cols = list(cols)
    if not cols:
        return df
    counts = _written_counts(df, cols).where(F.col("count") >= min_count)
    for c in cols:
        df = _replace_outside(df, c, counts.where(F.col("column") == c).select("level"), other)
    return df


def topk_to_other(df: DataFrame, cols, k: int = 10, other: str = "other") -> DataFrame:
    """Keep the ``k`` most frequent levels (ties by level ascending), the rest -> ``other``."""
    cols = list(cols)
    if not cols:
        return df
    counts = _written_counts(df, cols)
    for c in cols:
        top = counts.where(F.col("column") == c).orderBy(F.col("count").desc(), F.col("level").asc_nulls_last()).limit(k)
        df = _replace_outside(df, c, top.select("level"), other)
    return df


def fit_multi_hot(df: DataFrame, name: str, sep: str = ",", max_levels: int = MAX_LITERAL_LEVELS) -> list[str]:
    """Frozen level list of a separated multi-valued attribute (sorted)."""
    levels = df.select(F.explode(F.split(col(name), sep)).alias("v")).where(F.col("v") != "").distinct()
    rows = bounded_collect(levels, max_levels)
    if rows is None:
        raise ValueError(f"{name}: more than {max_levels} levels; use a sparse encoding")
    return sorted(r[0] for r in rows)


def multi_hot(df: DataFrame, name: str, levels, sep: str = ",") -> DataFrame:
    """One 0/1 column ``{name}_{level}`` per frozen level."""
    parts = F.split(F.coalesce(col(name), F.lit("")), sep)
    return df.withColumns({f"{name}_{v}": F.array_contains(parts, v).cast("int") for v in levels})


def normalise_activity(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Whitespace runs in activity names -> ``_``."""
    return df.withColumn(spec.activity, F.regexp_replace(col(spec.activity), r"\s+", "_"))


def sort_log(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Global order by ``(ts, tiebreak)`` (range partitioned; use at sinks only)."""
    return df.orderBy(*spec.order())


def last_matching(df: DataFrame, spec: LogSpec, cond: Column, outcomes, name: str = "last_match", hot=None) -> DataFrame:
    """Per case, the activity of the last event matching ``cond``; cases whose value is
    not in ``outcomes`` (or that have no match) are removed."""
    a = col(spec.activity)
    per_case = df.groupBy(col(spec.case)).agg(F.max_by(a, F.when(cond, F.struct(col(spec.ts), col(spec.tiebreak)))).alias(name))
    per_case = per_case.where(F.col(name).isin(list(outcomes)))
    from procmon.operators.segmented import case_join

    return case_join(df, spec, per_case, "inner", hot)


def one_vs_rest(df: DataFrame, name: str, outcomes, label: str = "label", pos: str = "deviant", neg: str = "regular") -> DataFrame:
    """One labelled copy of the log per outcome, told apart by an ``outcome`` column."""
    out = df.withColumn("outcome", F.explode(F.array(*[F.lit(o) for o in outcomes])))
    return out.withColumn(label, F.when(col(name) == F.col("outcome"), F.lit(pos)).otherwise(F.lit(neg)))


def delta(df: DataFrame, start: str, end: str, unit: str = "m", name: str = "delta") -> DataFrame:
    """``end - start`` as a double in ``unit``; undefined -> 0."""
    return df.withColumn(name, F.coalesce(in_unit(micros_between(col(start), col(end)), unit), F.lit(0.0)))


@dataclass
class CleanConfig:
    """Steps of one cleaning job (P20); empty / None steps are skipped."""

    strip: str | None = None
    fill_case: str | None = None
    where: tuple | None = None  # (column, value)
    drop_last: tuple = ()  # P7 drop
    keep_last: tuple = ()  # P7 keep
    require_any: tuple = ()  # P8
    min_length: int | None = None  # P9
    normalise: bool = False  # P15
    features_unit: str | None = "m"  # T1-T7
    open_cases: bool = False  # O1
    ffill: bool = True  # P10
    impute: bool = True  # P11
    rare_cols: tuple = ()  # P12
    rare_min: int = 10
    topk_cols: tuple = ()  # P13
    topk: int = 10
    min_length_last: bool = False  # notebook variant: P9 after the features
    extra: tuple = field(default=())
    hot_case_rows: int | None = 5_000_000  # cases above this size are processed in segments


def clean_log(df: DataFrame, spec: LogSpec, cfg: CleanConfig) -> DataFrame:
    """P20: the cleaning job of one log as a chain of DataFrame transforms."""
    from procmon.operators import features as T
    from procmon.operators.intercase import open_cases

    if cfg.strip:
        df = strip_prefix(df, cfg.strip)
    if cfg.fill_case:
        df = fill_case_id(df, spec, cfg.fill_case)
    if cfg.where:
        df = where_attr(df, *cfg.where)
    hot = None
    if cfg.hot_case_rows is not None:
        from procmon.operators.segmented import hot_cases

        # cases too large for one task: salted in the case filters, segmented in the windows
        hot = hot_cases(df, spec, cfg.hot_case_rows)
    if cfg.drop_last:
        df = filter_last_activity(df, spec, cfg.drop_last, keep=False, hot=hot)
    if cfg.keep_last:
        df = filter_last_activity(df, spec, cfg.keep_last, keep=True, hot=hot)
    if cfg.require_any:
        df = filter_any_activity(df, spec, cfg.require_any, hot=hot)
    if cfg.min_length is not None and not cfg.min_length_last:
        df = filter_min_length(df, spec, cfg.min_length, hot=hot)
    df = project(df, spec, cfg.extra)
    if cfg.normalise:
        df = normalise_activity(df, spec)
    if cfg.features_unit:
        df = T.standard_features(df, spec, cfg.features_unit, hot=hot)
    if cfg.open_cases:
        df = open_cases(df, spec)
    if cfg.ffill:
        df = ffill(df, spec, [c for c in (*spec.cat_cols, *spec.num_cols) if c != spec.activity], hot=hot)
    if cfg.impute:
        df = impute(df, spec)
    if cfg.rare_cols:
        df = rare_to_other(df, cfg.rare_cols, cfg.rare_min)
    if cfg.topk_cols:
        df = topk_to_other(df, cfg.topk_cols, cfg.topk)
    if cfg.min_length is not None and cfg.min_length_last:
        df = filter_min_length(df, spec, cfg.min_length, hot=hot)
    return df
