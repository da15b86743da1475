"""Prefix encoding for logs with very large cases (hot keys of the case window).

A window ``partitionBy(case)`` puts every event of a case into one task.  When a
case holds a large share of the log, it is cut into consecutive *segments* at
quantiles of its own timestamps; a timestamp that holds a segment's worth of
events is cut further at quantiles of the (numeric) tiebreak.  Each segment is
its own window partition.  Every running value is then computed inside the
segment and combined with a carry-in from the earlier segments of the case:

* counts, sums, level counts: added;
* mean and sum of squared deviations: merged pairwise, without sums of squares;
* minimum / maximum / presence: combined with least / greatest;
* first non-null: the earliest segment's value wins; last non-null: the latest;
* previous event (lag): the last row of the preceding segment;
* value of event ``i`` (index encoding): taken from the events at positions ``<= max_events``.

The carry-in comes from a table with one row per (case, segment) - small, and
split the same way - joined back on (case, segment).  Cases below the threshold
form a single segment, so the result equals ``encode`` up to the last digits of
sums, means and standard deviations of cases that are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.functions import bounded_collect
from procmon.functions.time import epoch_micros
from procmon.operators.encode import index_positions, METHODS, Vocab, one_hot
from procmon.session import checkpoint_dir
from procmon.spec import LogSpec, col

# cases above this many events are split into segments
HOT_CASE_ROWS = 5_000_000
# up to this many hot cases are a local table, and broadcast; more are joined by shuffles
MAX_HOT_CASES = 100_000

# quantiles asked for per segment of the largest hot case: segments stay near the limit
FINENESS = 4
MAX_QUANTILES = 10_000
_NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")


def _cuts(rows: DataFrame, keys: list[str], value: str, steps: int, max_rows: int) -> DataFrame:
    """``keys`` with ``_b``: about ``FINENESS`` quantiles of ``value`` per ``max_rows`` rows, without repeats.

    All groups share ``steps`` quantiles; smaller groups keep one in each stride."""
    share = [i / steps for i in range(1, steps)]
    per_group = rows.groupBy(*keys).agg(F.percentile_approx(value, share, MAX_QUANTILES * FINENESS).alias("_q"), F.count(F.lit(1)).alias("_m"))
    stride = F.greatest(F.lit(1), F.floor(F.lit(steps) / (FINENESS * F.ceil(F.col("_m") / max_rows)))).cast("int")
    return per_group.select(*keys, F.array_distinct(F.filter("_q", lambda v, i: (i + 1) % stride == 0)).alias("_b"))


def hot_cases(df: DataFrame, spec: LogSpec, max_rows: int = HOT_CASE_ROWS) -> DataFrame | None:
    """``(case, _nseg, _bounds, _ties)`` for cases with more than ``max_rows`` events, or None.

    Reads the log once to count; only if there are hot cases, their events are
    read again for the cuts.  ``_bounds`` are cut timestamps in microseconds;
    ``_ties`` maps a cut timestamp that alone exceeds ``max_rows`` to cuts of its
    tiebreak.  Both grow with the case's events over ``max_rows``.  Up to ``MAX_HOT_CASES``
    cases are a local table that joins by broadcast; more stay in the shared folder and join by shuffles.
    """
    kind = df.select(col(spec.case)).schema[0].dataType.simpleString()
    sizes = df.groupBy(col(spec.case).alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    sizes = sizes.select("_c", F.ceil(F.col("_n") / max_rows).cast("long").alias("_nseg")).persist()
    try:
        most = sizes.agg(F.max("_nseg")).first()[0]
        if most is None:
            return None
        steps = min(MAX_QUANTILES, FINENESS * most)
        numeric = dict(df.dtypes).get(spec.tiebreak) in _NUMERIC
        tie = col(spec.tiebreak).cast("double") if numeric else F.lit(0.0)
        events = df.select(col(spec.case).alias("_k"), epoch_micros(col(spec.ts)).alias("_t"), tie.alias("_tie"))
        events = events.join(_hinted(sizes), F.col("_k").eqNullSafe(F.col("_c"))).drop("_k")
        bounds = _cuts(events, ["_c"], "_t", steps, max_rows).withColumnRenamed("_b", "_bounds")
        hot = sizes.join(bounds.withColumnRenamed("_c", "_k"), F.col("_c").eqNullSafe(F.col("_k")), "left").drop("_k")
        none = F.expr("cast(map() as map<bigint,array<double>>)")
        ties = _tie_cuts(events, steps, max_rows) if numeric else None
        if ties is None:
            hot = hot.withColumn("_ties", none)
        else:
            hot = hot.join(ties.withColumnRenamed("_c", "_k"), F.col("_c").eqNullSafe(F.col("_k")), "left").withColumn("_ties", F.coalesce("_ties", none))
        # a heavy timestamp is a bound of its own, whatever the quantiles say
        all_bounds = F.concat(F.coalesce("_bounds", F.array().cast("array<bigint>")), F.map_keys("_ties"))
        hot = hot.select(F.col("_c").alias(spec.case), "_nseg", F.array_sort(F.array_distinct(all_bounds)).alias("_bounds"), "_ties")
        rows = bounded_collect(hot, MAX_HOT_CASES)
        if rows is None:
            checkpoint_dir(df.sparkSession)
            return hot.checkpoint(eager=True)
        return df.sparkSession.createDataFrame(rows, f"`{spec.case}` {kind}, _nseg long, _bounds array<bigint>, _ties map<bigint,array<double>>")
    finally:
        sizes.unpersist()


def _tie_cuts(events: DataFrame, steps: int, max_rows: int) -> DataFrame | None:
    """``(_c, _ties)``: cuts of the tiebreak in each timestamp of a case that alone holds more than ``max_rows`` events (None: there is none)."""
    heavy = events.groupBy("_c", "_t").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > max_rows) & F.col("_t").isNotNull())
    heavy = heavy.select(F.col("_c").alias("_hc"), F.col("_t").alias("_ht")).persist()
    if heavy.isEmpty():
        heavy.unpersist()
        return None
    tied = events.join(_hinted(heavy), F.col("_c").eqNullSafe(F.col("_hc")) & (F.col("_t") == F.col("_ht")))
    cuts = _cuts(tied, ["_c", "_t"], "_tie", steps, max_rows).where(F.size("_b") > 0)
    return cuts.groupBy("_c").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_b"))).alias("_ties"))


def _hinted(table: DataFrame) -> DataFrame:
    """A table of hot cases or timestamps, broadcast if it has at most ``MAX_HOT_CASES`` rows."""
    return F.broadcast(table) if table.limit(MAX_HOT_CASES + 1).count() <= MAX_HOT_CASES else table


def with_segments(df: DataFrame, spec: LogSpec, hot: DataFrame | None) -> DataFrame:
    """``_seg``: segment of each event, in the order of the case (0 for cases that are not hot)."""
    if hot is None:
        return df.withColumn("_seg", F.lit(0).cast("long"))
    # the hot-case table has bounds in proportion to the events over the limit
    h = _hinted(hot.withColumnRenamed(spec.case, "_hcase"))
    x = df.join(h, col(spec.case).eqNullSafe(F.col("_hcase")), "left")
    at = epoch_micros(col(spec.ts))
    below = lambda cuts, v: F.coalesce(F.size(F.filter(cuts, lambda b: b < v)), F.lit(0))
    # timestamps between two bounds share a segment; a bound itself is the next one
    seg = (2 * below(F.col("_bounds"), at) + F.coalesce(F.array_contains("_bounds", at), F.lit(False)).cast("int")).cast("long") * MAX_QUANTILES * FINENESS
    if dict(df.dtypes).get(spec.tiebreak) in _NUMERIC:
        cuts = F.try_element_at(F.col("_ties"), at)
        seg = seg + F.when(cuts.isNotNull(), below(cuts, col(spec.tiebreak).cast("double"))).otherwise(F.lit(0))
    return x.withColumn("_seg", F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(seg).cast("long")).drop("_hcase", "_nseg", "_bounds", "_ties")


def _merged(parts: Column) -> Column:
    """(n, mean, m2) of several such parts, merged pairwise."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, zero, _merge)


def _merge(a: Column, b: Column) -> Column:
    n, delta = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(
        n.cast("long").alias("n"),
        (a["mean"] + delta * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"),
    )
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def _moments(n: Column, mean: Column, var: Column) -> Column:
    """(n, mean, m2) from a count, a mean and a population variance; null parts count as empty."""
    return F.struct(n.cast("long").alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(var * n, F.lit(0.0)).alias("m2"))


def _num(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def encode_segmented(
    df: DataFrame,
    spec: LogSpec,
    vocab: Vocab,
    method: str = "combined",
    min_len: int = 1,
    max_len: int | None = None,
    max_events: int | None = None,
    keep=(),
    key: str = "prefix_len",
    strict: bool = True,
    max_rows: int = HOT_CASE_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Same rows and columns as ``encode.encode``, with hot cases split into segments."""
    parts = METHODS[method]
    max_events = index_positions(method, max_events, max_len)
    if hot is None:
        hot = hot_cases(df, spec, max_rows)
    # read by the segment windows and by the per-segment table: computed once
    x = with_segments(df, spec, hot).persist()
    case, order = col(spec.case), F.struct(col(spec.ts), col(spec.tiebreak))
    ws = Window.partitionBy(case, F.col("_seg")).orderBy(*spec.order())
    wsr = ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dyn_num, dyn_cat, st_num, st_cat = spec.dynamic_num, spec.dynamic_cat, spec.static_num, spec.static_cat
    agg_like = [p for p in parts if p in ("agg", "bool")]

    # 1. running values inside each segment
    local = {"_rn": F.row_number().over(ws)}
    part_aggs = [F.count(F.lit(1)).alias("_pn")]
    if "static" in parts:
        for c in (*st_num, *st_cat):
            local[f"_f_{c}"] = F.first(col(c), ignorenulls=True).over(wsr)
            part_aggs.append(F.min_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_pf_{c}"))
    if "last" in parts:
        for c in (*dyn_num, *dyn_cat):
            local[f"_l_{c}"] = F.last(col(c), ignorenulls=True).over(wsr)
            part_aggs.append(F.max_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_pl_{c}"))
    if agg_like:
        for c in dyn_num:
            v = col(c).cast("double")
            local.update({f"_s_{c}": F.sum(v).over(wsr), f"_q_{c}": _moments(F.count(v).over(wsr), F.avg(v).over(wsr), F.var_pop(v).over(wsr)),
                          f"_mn_{c}": F.min(v).over(wsr), f"_mx_{c}": F.max(v).over(wsr)})
            part_aggs += [F.sum(v).alias(f"_ps_{c}"), _moments(F.count(v), F.avg(v), F.var_pop(v)).alias(f"_pq_{c}"),
                          F.min(v).alias(f"_pmn_{c}"), F.max(v).alias(f"_pmx_{c}")]
        for c in dyn_cat:
            for lv in vocab[c]:
                hit = F.when(col(c) == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0))
                local[f"_c_{c}_{lv}"] = F.sum(hit).over(wsr)
                part_aggs.append(F.sum(hit).alias(f"_pc_{c}_{lv}"))
    if "previous" in parts:
        for c in (*dyn_num, *dyn_cat):
            local[f"_p_{c}"] = F.lag(col(c), 1).over(ws)
            part_aggs.append(F.max_by(col(c), order).alias(f"_pr_{c}"))
    x = x.withColumns(local)

    # 2. carry-in from the earlier segments of the case (one row per case and segment)
    seg_tab = x.groupBy(col(spec.case).alias(spec.case), "_seg").agg(*part_aggs)
    wp = Window.partitionBy(col(spec.case)).orderBy("_seg")
    before = wp.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_cn": F.coalesce(F.sum("_pn").over(before), F.lit(0)), "_tot": F.sum("_pn").over(Window.partitionBy(col(spec.case)))}
    for name in seg_tab.columns:
        if name.startswith("_pf_"):
            carry[f"_cf_{name[4:]}"] = F.first(col(name), ignorenulls=True).over(before)
        elif name.startswith("_pl_"):
            carry[f"_cl_{name[4:]}"] = F.last(col(name), ignorenulls=True).over(before)
        elif name.startswith("_pq_"):  # at most one part per segment of the case
            carry["_c" + name[2:]] = _merged(F.collect_list(col(name)).over(before))
        elif name.startswith(("_ps_", "_pc_")):
            carry["_c" + name[2:]] = F.sum(col(name)).over(before)
        elif name.startswith("_pmn_"):
            carry[f"_cmn_{name[5:]}"] = F.min(col(name)).over(before)
        elif name.startswith("_pmx_"):
            carry[f"_cmx_{name[5:]}"] = F.max(col(name)).over(before)
        elif name.startswith("_pr_"):
            carry[f"_cr_{name[4:]}"] = F.lag(col(name), 1).over(wp)
    carry_tab = seg_tab.select(col(spec.case), "_seg", *[v.alias(k) for k, v in carry.items()])
    x = _join_carry(x, spec, carry_tab)
    if "index" in parts and max_events:
        # values of the first events of the case, by their position in the case
        pos = F.col("_cn") + F.col("_rn")
        first = x.where(pos <= max_events).groupBy(col(spec.case).alias(spec.case)).agg(
            *[F.max_by(col(c), F.when(pos == i + 1, pos)).alias(f"_i_{c}_{i}") for i in range(max_events) for c in (*dyn_num, *dyn_cat)]
        )
        first = first.withColumnRenamed(spec.case, "_fcase")
        x = x.join(first, col(spec.case).eqNullSafe(F.col("_fcase")), "left").drop("_fcase")

    # 3. combine
    nr = F.col("_cn") + F.col("_rn")
    feats: dict[str, Column] = {}
    for p in parts:
        if p == "static":
            for c in st_num:
                feats[f"static__{c}"] = _num(F.coalesce(col(f"_cf_{c}"), col(f"_f_{c}")))
            for c in st_cat:
                feats.update(one_hot(F.coalesce(col(f"_cf_{c}"), col(f"_f_{c}")), vocab[c], f"static__{c}"))
        elif p == "last":
            for c in dyn_num:
                feats[f"last__{c}"] = _num(F.coalesce(col(f"_l_{c}"), col(f"_cl_{c}")))
            for c in dyn_cat:
                feats.update(one_hot(F.coalesce(col(f"_l_{c}"), col(f"_cl_{c}")), vocab[c], f"last__{c}"))
        elif p in ("agg", "bool"):
            for c in dyn_num:
                s = F.coalesce(col(f"_s_{c}"), F.lit(0.0)) + F.coalesce(col(f"_cs_{c}"), F.lit(0.0))
                whole = _merge(col(f"_cq_{c}"), col(f"_q_{c}"))
                n = whole["n"]
                feats[f"{p}__mean_{c}"] = _num(F.when(n > 0, s / n))
                feats[f"{p}__max_{c}"] = _num(F.greatest(col(f"_mx_{c}"), col(f"_cmx_{c}")))
                feats[f"{p}__min_{c}"] = _num(F.least(col(f"_mn_{c}"), col(f"_cmn_{c}")))
                feats[f"{p}__sum_{c}"] = _num(F.when(n > 0, s))
                feats[f"{p}__std_{c}"] = _num(F.when(n > 1, F.sqrt(whole["m2"] / (n - 1))))
            for c in dyn_cat:
                for lv in vocab[c]:
                    total = col(f"_c_{c}_{lv}") + F.coalesce(col(f"_cc_{c}_{lv}"), F.lit(0.0))
                    feats[f"{p}__{c}_{lv}"] = F.least(total, F.lit(1.0)) if p == "bool" else total
        elif p == "index":
            for i in range(max_events):
                for c in dyn_num:
                    feats[f"index__{c}_{i}"] = _num(F.when(nr >= i + 1, col(f"_i_{c}_{i}")))
                for c in dyn_cat:
                    feats.update(one_hot(F.when(nr >= i + 1, col(f"_i_{c}_{i}")), vocab[c], f"index__{c}_{i}"))
        elif p == "previous":
            for c in dyn_num:
                feats[f"previous__{c}"] = _num(F.when(F.col("_rn") == 1, col(f"_cr_{c}")).otherwise(col(f"_p_{c}")))
            for c in dyn_cat:
                prev = F.when(F.col("_rn") == 1, col(f"_cr_{c}")).otherwise(col(f"_p_{c}"))
                feats.update(one_hot(prev, vocab[c], f"previous__{c}"))
    out = x.select(case.alias(spec.case), nr.cast("int").alias(key), F.col("_tot").alias("_len"), *[col(k).alias(k) for k in keep],
                   *[c.alias(n) for n, c in feats.items()])
    cond = (F.col(key) >= min_len) & ((F.col(key) < F.col("_len")) if strict else (F.col(key) <= F.col("_len")))
    if max_len is not None:
        cond = cond & (F.col(key) <= max_len)
    out = out.where(cond)
    return out.drop("_len") if strict else out.withColumnRenamed("_len", "_case_len")


def case_context(df: DataFrame, spec: LogSpec, hot: DataFrame | None, lag=(), lead=(), ffill=(), first=(), case_max=()) -> DataFrame:
    """Case-window values computed segment by segment (for logs with hot cases).

    Adds ``_pos`` (1-based position in the case), ``_len`` (case length) and, per
    named column ``c``: ``_lag_c`` (previous event's value), ``_lead_c`` (next
    event's value), ``_ffill_c`` (last non-null value so far), ``_first_c`` (first
    non-null value so far) and ``_max_c`` (maximum over the whole case)."""
    x = with_segments(df, spec, hot)
    if hot is not None:
        x = x.persist()  # read by the segment windows and by the per-segment table
    case, order = col(spec.case), F.struct(col(spec.ts), col(spec.tiebreak))
    ws = Window.partitionBy(case, F.col("_seg")).orderBy(*spec.order())
    wsr = ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"_rn": F.row_number().over(ws)}
    aggs = [F.count(F.lit(1)).alias("_pn")]
    for c in lag:
        local[f"_lg_{c}"] = F.lag(col(c)).over(ws)
        aggs.append(F.max_by(col(c), order).alias(f"_plast_{c}"))
    for c in lead:
        local[f"_ld_{c}"] = F.lead(col(c)).over(ws)
        aggs.append(F.min_by(col(c), order).alias(f"_pfirst_{c}"))
    for c in ffill:
        local[f"_ff_{c}"] = F.last(col(c), ignorenulls=True).over(wsr)
        aggs.append(F.max_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_pl_{c}"))
    for c in first:
        local[f"_fs_{c}"] = F.first(col(c), ignorenulls=True).over(wsr)
        aggs.append(F.min_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_pf_{c}"))
    for c in case_max:
        aggs.append(F.max(col(c)).alias(f"_pmax_{c}"))
    x = x.withColumns(local)
    seg_tab = x.groupBy(col(spec.case).alias(spec.case), "_seg").agg(*aggs)
    wp = Window.partitionBy(col(spec.case)).orderBy("_seg")
    before = wp.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(col(spec.case))
    carry = {"_cn": F.coalesce(F.sum("_pn").over(before), F.lit(0)), "_len": F.sum("_pn").over(whole), "_segn": F.col("_pn")}
    carry.update({f"_cprev_{c}": F.lag(col(f"_plast_{c}")).over(wp) for c in lag})
    carry.update({f"_cnext_{c}": F.lead(col(f"_pfirst_{c}")).over(wp) for c in lead})
    carry.update({f"_cff_{c}": F.last(col(f"_pl_{c}"), ignorenulls=True).over(before) for c in ffill})
    carry.update({f"_cfs_{c}": F.first(col(f"_pf_{c}"), ignorenulls=True).over(before) for c in first})
    carry.update({f"_max_{c}": F.max(col(f"_pmax_{c}")).over(whole) for c in case_max})
    carry_tab = seg_tab.select(col(spec.case), "_seg", *[v.alias(k) for k, v in carry.items()])
    x = _join_carry(x, spec, carry_tab)
    out = {"_pos": F.col("_cn") + F.col("_rn")}
    out.update({f"_lag_{c}": F.when(F.col("_rn") == 1, col(f"_cprev_{c}")).otherwise(col(f"_lg_{c}")) for c in lag})
    out.update({f"_lead_{c}": F.when(F.col("_rn") == F.col("_segn"), col(f"_cnext_{c}")).otherwise(col(f"_ld_{c}")) for c in lead})
    out.update({f"_ffill_{c}": F.coalesce(col(f"_ff_{c}"), col(f"_cff_{c}")) for c in ffill})
    out.update({f"_first_{c}": F.coalesce(col(f"_cfs_{c}"), col(f"_fs_{c}")) for c in first})
    x = x.withColumns(out)
    helper = [c for c in x.columns if c.startswith(("_rn", "_lg_", "_ld_", "_ff_", "_fs_", "_cn", "_segn", "_cprev_", "_cnext_", "_cff_", "_cfs_"))]
    return x.drop("_seg", *helper)


def _join_carry(x: DataFrame, spec: LogSpec, carry_tab: DataFrame) -> DataFrame:
    """Attach each segment's carry-in to its events; the events without a case id form a case of their own."""
    carry = carry_tab.withColumnRenamed(spec.case, "_ccase").withColumnRenamed("_seg", "_cseg")
    return x.join(carry, col(spec.case).eqNullSafe(F.col("_ccase")) & (F.col("_seg") == F.col("_cseg")), "inner").drop("_ccase", "_cseg")


def case_join(df: DataFrame, spec: LogSpec, cases: DataFrame, how: str, hot: DataFrame | None) -> DataFrame:
    """Join of the events with a table keyed by case (semi, anti, inner or left), salted for
    hot cases.

    Events of a hot case carry a salt (hash of the tiebreak modulo its number of
    segments) and that case's row on the case side is repeated once per salt, so
    the hot case is spread over as many join partitions; other cases use salt 0.
    Every event matches at most one (case, salt) row, so no row is duplicated."""
    if how in ("left_semi", "left_anti"):
        cases = cases.select(spec.case)
    if hot is None:
        return df.join(cases, on=spec.case, how=how)
    h = _hinted(hot.select(spec.case, "_nseg"))
    left = df.join(h, on=spec.case, how="left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(col(spec.tiebreak), col(spec.ts)), F.col("_nseg")), F.lit(0)).cast("long")
    ).drop("_nseg")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_nseg") - 1, F.lit(0).cast("long"))))
    right = cases.join(h, on=spec.case, how="left").select(*[col(c) for c in cases.columns], salts.alias("_salt"))
    return left.join(right, on=[spec.case, "_salt"], how=how).drop("_salt")
