"""Targets and labels.

The whole target table of a log is one aggregation per case (L6) over one
window pass (previous timestamp, next activity, position), so its cost is a
single exchange on the case column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.functions.rules import RuleSet, cycle_time_col, gateway_col
from procmon.functions.time import micros_between
from procmon.spec import LogSpec, col


def _event_context(df: DataFrame, spec: LogSpec, hot=None) -> DataFrame:
    if hot is not None:
        from procmon.operators.segmented import case_context

        x = case_context(df, spec, hot, lag=(spec.ts,), lead=(spec.activity,))
        return x.select(
            col(spec.case).alias(spec.case),
            col(spec.activity).alias("_act"),
            micros_between(col(f"_lag_{spec.ts}"), col(spec.ts)).alias("_dt"),
            col(f"_lead_{spec.activity}").alias("_next"),
            F.col("_pos").cast("int").alias("_nr"),
        )
    w = spec.window()
    return df.select(
        col(spec.case).alias(spec.case),
        col(spec.activity).alias("_act"),
        micros_between(F.lag(col(spec.ts)).over(w), col(spec.ts)).alias("_dt"),
        F.lead(col(spec.activity)).over(w).alias("_next"),
        F.row_number().over(w).alias("_nr"),
    )


def cycle_times(df: DataFrame, spec: LogSpec, activities, hot=None) -> DataFrame:
    """L1: per case, the mean cycle time (seconds) of each activity; NULL if it never occurs
    after another event.  ``hot`` (``segmented.hot_cases``): large cases segment by segment, here and in L2-L4."""
    ev = _event_context(df, spec, hot)
    return ev.groupBy(spec.case).agg(*[cycle_time_col(a, F.col("_act"), F.col("_dt")).alias(a) for a in activities])


def _gateways(df: DataFrame, spec: LogSpec, rs: RuleSet, gateways, hot=None) -> DataFrame:
    ev = _event_context(df, spec, hot)
    a, n, nr = F.col("_act"), F.col("_next"), F.col("_nr")
    return ev.groupBy(spec.case).agg(*[gateway_col(rs, g, a, n, nr).alias(g) for g in gateways])


def gateway_follows(df: DataFrame, spec: LogSpec, rs: RuleSet, hot=None) -> DataFrame:
    """L2: gateways decided by directly-follows rules (last match wins)."""
    from procmon.functions.rules import Follows

    gws = list(dict.fromkeys(r.gateway for r in rs.rules if isinstance(r, Follows)))
    return _gateways(df, spec, rs, gws, hot)


def gateway_presence(df: DataFrame, spec: LogSpec, rs: RuleSet, hot=None) -> DataFrame:
    """L3: gateways decided by presence/absence of activities."""
    from procmon.functions.rules import Present

    gws = list(dict.fromkeys(r.gateway for r in rs.rules if isinstance(r, Present)))
    return _gateways(df, spec, rs, gws, hot)


def gateway_count(df: DataFrame, spec: LogSpec, rs: RuleSet, hot=None) -> DataFrame:
    """L4: gateways decided by occurrence counts, of one activity or of several together."""
    from procmon.functions.rules import Count, Counts

    gws = list(dict.fromkeys(r.gateway for r in rs.rules if isinstance(r, (Count, Counts))))
    return _gateways(df, spec, rs, gws, hot)


def label_defaults(targets: DataFrame, rs: RuleSet, undefined: int = -1) -> DataFrame:
    """Sink form of a target table: undefined -> ``-1``; gateways with an always-taken
    branch start at their default (e.g. 0)."""
    fills = {a: F.coalesce(F.col(a), F.lit(float(undefined))) for a in rs.activities if a in targets.columns}
    for g in rs.gateways:
        if g in targets.columns:
            d = rs.default(g)
            fills[g] = F.coalesce(F.col(g), F.lit(undefined if d is None else d)).cast("int")
    return targets.withColumns(fills)


def build_targets(df: DataFrame, spec: LogSpec, rs: RuleSet, sink: bool = False, hot=None) -> DataFrame:
    """One row per case with every cycle time and gateway class (one aggregation).
    Internally undefined values are NULL; ``sink=True`` applies L5.  ``hot`` cases
    (``segmented.hot_cases``) get their event context segment by segment."""
    ev = _event_context(df, spec, hot)
    a, n, nr, dt = F.col("_act"), F.col("_next"), F.col("_nr"), F.col("_dt")
    aggs = [cycle_time_col(x, a, dt).alias(x) for x in rs.activities]
    aggs += [gateway_col(rs, g, a, n, nr).alias(g) for g in rs.gateways]
    t = ev.groupBy(spec.case).agg(*aggs)
    if not sink:
        # gateways with a default are defined for every case
        t = t.withColumns({g: F.coalesce(F.col(g), F.lit(rs.default(g))) for g in rs.gateways if rs.default(g) is not None})
        return t
    return label_defaults(t, rs)


def read_sink_targets(targets: DataFrame, rs: RuleSet, undefined: int = -1) -> DataFrame:
    """Sink form (``-1``) back to NULL for undefined values."""
    cols = {c: F.when(F.col(c) != undefined, F.col(c)) for c in (*rs.activities, *rs.gateways) if c in targets.columns}
    return targets.withColumns(cols)


def add_target(df: DataFrame, spec: LogSpec, targets: DataFrame, labels, hot=None) -> DataFrame:
    """Attach case labels to the events (equi-join on the case; salted for ``hot`` cases)."""
    from procmon.operators.segmented import case_join

    return case_join(df, spec, targets.select(spec.case, *labels), "inner", hot)


def defined_only(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is defined."""
    return df.where(F.col(label).isNotNull())


def prefix_label(prefixes: DataFrame, spec: LogSpec, label: str, mode: str = "regr", key: str = "prefix_len") -> DataFrame:
    """Label of each prefix: regression -> min over its events; class -> value at its first event."""
    g = prefixes.groupBy(spec.case, key)
    if mode == "regr":
        return g.agg(F.min(label).alias(label))
    return g.agg(F.min_by(label, F.struct(col(spec.ts), col(spec.tiebreak))).alias(label))


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Share of each class (rows with a defined label)."""
    from pyspark.sql import Window

    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("ratio"))


def gateway_exits(targets: DataFrame, gateways) -> DataFrame:
    """Number of distinct defined classes per gateway (one pass, long format)."""
    gateways = list(gateways)
    if not gateways:
        return targets.sparkSession.createDataFrame([], "gateway string, exits bigint")
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gateway"), F.col(g).cast("int").alias("cls")) for g in gateways]))
    long = targets.select(pairs.alias("p")).select("p.gateway", "p.cls")
    return long.groupBy("gateway").agg(F.count_distinct("cls").alias("exits"))


def case_durations(df: DataFrame, spec: LogSpec, name: str = "duration") -> DataFrame:
    """Seconds from the first to the last event of each case."""
    g = df.groupBy(spec.case).agg(F.min(col(spec.ts)).alias("_s"), F.max(col(spec.ts)).alias("_e"))
    return g.select(spec.case, (micros_between(F.col("_s"), F.col("_e")) / F.lit(1_000_000.0)).alias(name))


def median_case_duration(df: DataFrame, spec: LogSpec) -> float:
    """Exact median (interpolated) of the case durations, seconds."""
    from procmon.functions.select import exact_quantile

    return exact_quantile(case_durations(df, spec), "duration", 0.5)


def assign_label(df: DataFrame, spec: LogSpec, threshold: float, label: str = "label", hot=None) -> DataFrame:
    """``"true"`` for cases lasting at least ``threshold`` seconds, else ``"false"`` (salted for ``hot`` cases)."""
    from procmon.operators.segmented import case_join

    out = case_join(df, spec, case_durations(df, spec, "_dur"), "inner", hot)
    return out.withColumn(label, F.when(F.col("_dur") < threshold, F.lit("false")).otherwise(F.lit("true"))).drop("_dur")
