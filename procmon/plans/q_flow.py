"""Queries M5/M6/M8/M9/M13 and F1–F6 on EL1 (exact oracle with the mean model)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.operators import flow as FL
from procmon.operators import models as M
from procmon.operators import targets as L
from procmon.plans.fixtures import EL1, EL1_SQL, el1, with_
from procmon.plans.formulas import EL1_FORMULAS_SQL, el1_formulas
from procmon.plans.registry import register, sql_unit
from procmon.plans.rulesets import EL1_ACTIVITIES, EL1_GATEWAYS, EL1_RULES, EL1_TARGETS_SQL

EXITS = {"x1": 2, "x2": 4, "x3": 2, "x4": 2}


def pcols(k0: int):
    out, k = [], k0
    for g in EL1_GATEWAYS:
        for c in range(EXITS[g]):
            out.append((f"p{k}", g, c))
            k += 1
    return out


def mean_cols(k0: int) -> str:
    cols = [f"avg({a}) AS {a}" for a in EL1_ACTIVITIES]
    cols += [f"CAST(count(CASE WHEN {g} = {c} THEN 1 END) AS DOUBLE) / nullif(count({g}), 0) AS {p}" for p, g, c in pcols(k0)]
    return ", ".join(cols)


def fa_sql(bucket: str = "zero", lo: int = 2, hi: int | None = None, ratio: float = 0.8, k0: int = 1) -> str:
    """CTEs up to ``terms``: one row per test prefix with its terms (mean model)."""
    by = bucket == "prefix"
    term_cols = [f"CASE WHEN coalesce(mt.{a}, fb.{a}) < 0 THEN 0 ELSE coalesce(mt.{a}, fb.{a}) END AS {a}" for a in EL1_ACTIVITIES]
    term_cols += [f"coalesce(mt.{p}, fb.{p}) AS {p}" for p, _, _ in pcols(k0)]
    term_cols += [f"CAST(1.0 AS DOUBLE) AS p{k}" for k in range(1, k0)]
    return with_(
        EL1_SQL,
        EL1_TARGETS_SQL,
        f"tg2 AS (SELECT case_id, {', '.join(EL1_ACTIVITIES)}, x1, x2, x3, coalesce(x4, 0) AS x4 FROM tg)",
        "lg AS (SELECT case_id, event_id, activity, CAST(row_number() OVER w AS INTEGER) AS prefix_len, "
        "count(*) OVER (PARTITION BY case_id) AS len, "
        + sql_unit("epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)", "s")
        + " AS remtime FROM el1 WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))",
        "cs AS (SELECT case_id, min(ts) AS s FROM el1 GROUP BY case_id)",
        "rk AS (SELECT case_id, row_number() OVER (ORDER BY s, case_id) AS rn, count(*) OVER () AS n FROM cs)",
        f"pf AS (SELECT lg.*, rk.rn <= ceil({ratio} * rk.n) AS is_train FROM lg JOIN rk ON lg.case_id = rk.case_id "
        f"WHERE prefix_len >= {lo} AND {'TRUE' if hi is None else f'prefix_len <= {hi}'} AND prefix_len < len)",
        "trp AS (SELECT pf.prefix_len, tg2.* FROM pf JOIN tg2 ON pf.case_id = tg2.case_id WHERE pf.is_train)",
        f"mt AS (SELECT {'prefix_len, ' if by else ''}{mean_cols(k0)} FROM trp{' GROUP BY prefix_len' if by else ''})",
        f"fb AS (SELECT {mean_cols(k0)} FROM tg2)",
        f"terms AS (SELECT pf.case_id, pf.prefix_len, pf.activity, pf.remtime, {', '.join(term_cols)} FROM pf "
        f"LEFT JOIN mt ON {'pf.prefix_len = mt.prefix_len' if by else 'TRUE'} CROSS JOIN fb WHERE NOT pf.is_train)",
    )


_FORMULA_CASE = "CASE activity " + " ".join(f"WHEN '{a}' THEN {f}" for a, f in EL1_FORMULAS_SQL.items()) + " END"
_PRED_SQL = f", ev2 AS (SELECT *, {_FORMULA_CASE} AS predicted FROM terms)"
_DETAIL_SQL = (
    "SELECT case_id, prefix_len AS nr_events, round(CASE WHEN predicted < 0 THEN 0 ELSE predicted END, 3) AS predicted, "
    "remtime AS actual, '{method}' AS method, 'mean' AS cls FROM ev2"
)


def _terms(spark, d, bucket="zero", k0=1):
    cfg = FL.FlowConfig(bucket=bucket, k0=k0)
    log, train_p, test_p = FL.prepare(el1(spark, d), EL1, cfg)
    targets = L.build_targets(log, EL1, EL1_RULES)
    exits = {r["gateway"]: r["exits"] for r in L.gateway_exits(targets, EL1_GATEWAYS).collect()}
    preds = FL.predict_labels(train_p, test_p, targets, EL1_RULES, exits, cfg, EL1)
    terms = FL.phantom_branches(FL.term_table(test_p, preds, EL1_RULES, exits, k0), k0)
    return test_p, terms


def _round_terms(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in df.columns if c.startswith("t_")})


_T_SQL = lambda k0: ", ".join(
    [f"round({a}, 6) AS t_{a}" for a in EL1_ACTIVITIES] + [f"round({p}, 6) AS t_{p}" for p, _, _ in pcols(k0)] + [f"round(p{k}, 6) AS t_p{k}" for k in range(1, k0)]
)


@register(
    "m13_mean_predictor",
    fa_sql()
    + " SELECT 1 AS bucket, count(*) AS n_prefixes, "
    + ", ".join(f"round(avg({a}), 6) AS {a}" for a in EL1_ACTIVITIES)
    + ", "
    + ", ".join(f"round(CAST(count(CASE WHEN {g} = {c} THEN 1 END) AS DOUBLE) / nullif(count({g}), 0), 6) AS p_{g}_{c}" for _, g, c in pcols(1))
    + " FROM trp",
)
def m13(spark, d):
    cfg = FL.FlowConfig()
    log, train_p, _ = FL.prepare(el1(spark, d), EL1, cfg)
    tr = train_p.join(L.build_targets(log, EL1, EL1_RULES), "case_id")
    mt = M.mean_predictor(tr, EL1_ACTIVITIES, EXITS)
    keep = ["bucket", "n_prefixes", *EL1_ACTIVITIES, *[f"p_{g}_{c}" for g in EL1_GATEWAYS for c in range(EXITS[g])]]
    return mt.select(*[F.round(c, 6).alias(c) if c not in ("bucket", "n_prefixes") else F.col(c) for c in keep])


@register(
    "m5_small_data_fallback",
    fa_sql("prefix")
    + " SELECT prefix_len AS bucket, count(*) AS n, round(avg(CAST(x3 AS DOUBLE)), 6) AS mean, count(*) < 30 AS use_fallback "
    "FROM trp WHERE x3 IS NOT NULL GROUP BY prefix_len",
)
def m5(spark, d):
    cfg = FL.FlowConfig(bucket="prefix")
    log, train_p, _ = FL.prepare(el1(spark, d), EL1, cfg)
    tr = train_p.join(L.build_targets(log, EL1, EL1_RULES), "case_id")
    out = M.small_data_fallback(tr, "x3", 30)
    return out.withColumn("mean", F.round("mean", 6))


@register(
    "m6_single_class_fallback",
    fa_sql()
    + " SELECT split_part(case_id, '-', 1) || ':' || prefix_len AS bucket, "
    + ", ".join(f"CAST(min(x2) = {c} AS DOUBLE) AS p_x2_{c}" for c in range(4))
    + " FROM trp WHERE x2 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT x2) = 1",
)
def m6(spark, d):
    # a bucket per user and prefix length: in many of them all cases take the same branch
    log, train_p, _ = FL.prepare(el1(spark, d), EL1, FL.FlowConfig())
    tr = train_p.join(L.build_targets(log, EL1, EL1_RULES), "case_id")
    return M.single_class_fallback(tr.withColumn("bucket", F.concat_ws(":", F.substring_index("case_id", "-", 1), "prefix_len")), "x2", 4)


@register(
    "m8_clip_negative",
    fa_sql()
    + " SELECT case_id, prefix_len, round(CASE WHEN remtime - click * 10 < 0 THEN 0 ELSE remtime - click * 10 END, 3) AS margin FROM terms",
)
def m8(spark, d):
    test_p, terms = _terms(spark, d)
    x = terms.join(test_p.select("case_id", "prefix_len", "remtime"), ["case_id", "prefix_len"])
    x = x.withColumn("margin", F.col("remtime") - F.col("t_click") * 10)
    return M.clip_negative(x, "margin").select("case_id", "prefix_len", F.round("margin", 3).alias("margin"))


@register(
    "m9_pad_classes",
    fa_sql("prefix")
    + " SELECT prefix_len AS bucket, "
    + ", ".join(f"round(CAST(count(CASE WHEN x2 = {c} THEN 1 END) AS DOUBLE) / count(x2), 6) AS p_x2_{c}" for c in range(4))
    + " FROM trp WHERE x2 IS NOT NULL GROUP BY prefix_len",
)
def m9(spark, d):
    # class frequencies per bucket as probability vectors over the classes present, padded to 4 exits
    from pyspark.ml.functions import array_to_vector

    cfg = FL.FlowConfig(bucket="prefix")
    log, train_p, _ = FL.prepare(el1(spark, d), EL1, cfg)
    tr = train_p.join(L.build_targets(log, EL1, EL1_RULES), "case_id").where(F.col("x2").isNotNull())
    n = tr.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("x2").alias("top"))
    freq = tr.groupBy("bucket", "x2").agg(F.count(F.lit(1)).alias("k")).join(n, "bucket")
    vec = freq.groupBy("bucket", "top").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("x2"), F.col("k") / F.col("n")))).alias("m")
    )
    vec = vec.select("bucket", array_to_vector(F.transform(F.sequence(F.lit(0), F.col("top")), lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0)))).alias("probability"))
    out = M.pad_classes(vec, "x2", 4)
    return out.select("bucket", *[F.round(f"p_x2_{c}", 6).alias(f"p_x2_{c}") for c in range(4)])


@register("f1_term_table", fa_sql() + f" SELECT case_id, prefix_len, {_T_SQL(1)} FROM terms")
def f1(spark, d):
    _, terms = _terms(spark, d)
    return _round_terms(terms)


@register("f1b_term_table_prefix_buckets", fa_sql("prefix") + f" SELECT case_id, prefix_len, {_T_SQL(1)} FROM terms")
def f1b(spark, d):
    _, terms = _terms(spark, d, "prefix")
    return _round_terms(terms)


@register("f2_phantom_branches", fa_sql(k0=3) + f" SELECT case_id, prefix_len, {_T_SQL(3)} FROM terms")
def f2(spark, d):
    _, terms = _terms(spark, d, k0=3)
    return _round_terms(terms)


@register(
    "f3_evaluate_formulas",
    fa_sql() + _PRED_SQL + " SELECT case_id, prefix_len, round(predicted, 3) AS predicted FROM ev2",
)
def f3(spark, d):
    test_p, terms = _terms(spark, d)
    out = FL.evaluate_formulas(terms, el1_formulas(test_p))
    return out.select("case_id", "prefix_len", F.round("predicted", 3).alias("predicted"))


@register("f3d_evaluate_formulas_as_data", fa_sql() + _PRED_SQL + " SELECT case_id, prefix_len, round(predicted, 3) AS predicted FROM ev2")
def f3d(spark, d):
    """The formulas as postfix tokens instead of compiled expressions."""
    test_p, terms = _terms(spark, d)
    out = FL.evaluate_formula_table(terms, el1_formulas(test_p))
    return out.select("case_id", "prefix_len", F.round("predicted", 3).alias("predicted"))


@register("f4_attach_actual", fa_sql() + _PRED_SQL + " " + _DETAIL_SQL.format(method="FA"))
def f4(spark, d):
    test_p, terms = _terms(spark, d)
    out = FL.attach_actual(FL.evaluate_formulas(terms, el1_formulas(test_p)), test_p, "FA", "mean")
    return out.withColumn("predicted", F.round("predicted", 3))


@register("f5_predict_flow", fa_sql() + _PRED_SQL + " " + _DETAIL_SQL.format(method="FA"))
def f5(spark, d):
    out = FL.predict_flow(el1(spark, d), EL1, EL1_RULES, el1_formulas, FL.FlowConfig())
    return out.withColumn("predicted", F.round("predicted", 3))


@register("f5b_predict_flow_prefix_buckets", fa_sql("prefix") + _PRED_SQL + " " + _DETAIL_SQL.format(method="FA"))
def f5b(spark, d):
    out = FL.predict_flow(el1(spark, d), EL1, EL1_RULES, el1_formulas, FL.FlowConfig(bucket="prefix"))
    return out.withColumn("predicted", F.round("predicted", 3))


_DIRECT_SQL = fa_sql("prefix") + (
    ", dm AS (SELECT prefix_len, avg(remtime) AS m FROM pf WHERE is_train GROUP BY prefix_len) "
    "SELECT pf.case_id, pf.prefix_len AS nr_events, round(coalesce(dm.m, (SELECT avg(remtime) FROM pf WHERE is_train)), 3) AS predicted, "
    "pf.remtime AS actual, 'direct' AS method, 'mean' AS cls FROM pf LEFT JOIN dm ON pf.prefix_len = dm.prefix_len WHERE NOT pf.is_train"
)


@register("f6_predict_direct_mean", _DIRECT_SQL)
def f6(spark, d):
    out = FL.predict_direct(el1(spark, d), EL1, FL.FlowConfig(bucket="prefix"))
    return out.withColumn("predicted", F.round("predicted", 3))
