"""Queries V1–V19 on the score fixtures (mean / median / zero predictors on EL1 and EL2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.operators import features as T
from procmon.operators import report as V
from procmon.plans.fixtures import EL1, EL1N_SQL, EL1_SQL, EL2, EL2_SQL, el1, el2, with_
from procmon.plans.q_flow import mean_cols, pcols, _terms, fa_sql
from procmon.plans.registry import register
from procmon.plans.rulesets import EL1_ACTIVITIES, EL1_RULES
from procmon.plans.scores import DETAILS_SQL, details

_SC_SQL = DETAILS_SQL + """, sc AS (
  SELECT dataset, method, cls, nr_events, count(*) AS nr_cases, avg(abs(predicted - actual)) AS mae,
         sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse
  FROM details GROUP BY dataset, method, cls, nr_events),
scores AS (
  SELECT dataset, method, cls, nr_events, 'mae' AS metric, CASE WHEN nr_cases >= 2 THEN mae END AS score, nr_cases FROM sc
  UNION ALL
  SELECT dataset, method, cls, nr_events, 'rmse' AS metric, CASE WHEN nr_cases >= 2 THEN rmse END AS score, nr_cases FROM sc)"""
_MAE_SQL = "mr AS (SELECT * FROM scores WHERE metric = 'mae' AND score IS NOT NULL AND nr_events < 11)"
_AGG_SQL = (
    _SC_SQL
    + ", "
    + _MAE_SQL
    + ", agg AS (SELECT dataset, method, sum(score * nr_cases) / sum(nr_cases) / 86400.0 AS weighted_mae_days, "
    "stddev_samp(score) / 86400.0 AS std_days FROM mr GROUP BY dataset, method)"
)


def _scores(spark, d):
    return V.score_table(details(spark, d))


def _r(df, digits=6, skip=()):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in skip})


@register(
    "v1_mae",
    DETAILS_SQL + " SELECT dataset, method, cls, nr_events, round(avg(abs(predicted - actual)), 4) AS mae FROM details GROUP BY ALL",
)
def v1(spark, d):
    return _r(V.mae(details(spark, d)), 4)


@register(
    "v2_rmse",
    DETAILS_SQL + " SELECT dataset, method, cls, nr_events, round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse FROM details GROUP BY ALL",
)
def v2(spark, d):
    return _r(V.rmse(details(spark, d)), 4)


_P_X2 = [p for p, g, _ in pcols(1) if g == "x2"]


@register(
    "v3_log_loss",
    fa_sql("prefix")
    + ", lt AS (SELECT terms.*, tg2.x2 FROM terms JOIN tg2 ON terms.case_id = tg2.case_id WHERE tg2.x2 IS NOT NULL) "
    "SELECT prefix_len AS nr_events, round(-avg(ln(least(greatest([" + ", ".join(_P_X2) + "][x2 + 1], 1e-15), 1 - 1e-15))), 6) AS log_loss, "
    "count(*) AS nr_cases FROM lt GROUP BY prefix_len",
)
def v3(spark, d):
    from procmon.operators import targets as L

    test_p, terms = _terms(spark, d, "prefix")
    tg = L.build_targets(T.remaining_time(el1(spark, d), EL1), EL1, EL1_RULES).select("case_id", "x2")
    x = terms.join(tg, "case_id").select(
        F.col("prefix_len").alias("nr_events"), "x2", *[F.col(f"t_{p}").alias(f"p_x2_{i}") for i, p in enumerate(_P_X2)]
    )
    return _r(V.log_loss(x, "x2", 4))


@register(
    "v4_guard_small",
    DETAILS_SQL
    + " SELECT dataset, method, nr_events, round(CASE WHEN count(*) >= 50 THEN avg(abs(predicted - actual)) END, 4) AS mae, count(*) AS nr_cases "
    "FROM details GROUP BY dataset, method, nr_events",
)
def v4(spark, d):
    g = details(spark, d).groupBy("dataset", "method", "nr_events")
    n = F.count(F.lit(1))
    return g.agg(F.round(V.guard_small(F.avg(F.abs(F.col("predicted") - F.col("actual"))), n, 50), 4).alias("mae"), n.alias("nr_cases"))


@register("v5_score_table", _SC_SQL + " SELECT dataset, method, cls, nr_events, metric, round(score, 4) AS score, nr_cases FROM scores")
def v5(spark, d):
    return _r(_scores(spark, d), 4)


@register("v6_weighted_mae", _AGG_SQL + " SELECT dataset, method, round(weighted_mae_days, 6) AS weighted_mae_days FROM agg")
def v6(spark, d):
    return _r(V.weighted_mae(_scores(spark, d)))


@register(
    "v6b_weighted_mae_all_lengths",
    _SC_SQL + " SELECT dataset, method, round(sum(score * nr_cases) / sum(nr_cases) / 86400.0, 6) AS weighted_mae_days "
    "FROM scores WHERE metric = 'mae' AND score IS NOT NULL GROUP BY dataset, method",
)
def v6b(spark, d):
    return _r(V.weighted_mae(_scores(spark, d), max_n=None))


@register(
    "v7_unweighted_mae",
    _SC_SQL + ", " + _MAE_SQL + " SELECT dataset, method, round(avg(score) / 86400.0, 6) AS unweighted_mae_days FROM mr GROUP BY dataset, method",
)
def v7(spark, d):
    return _r(V.unweighted_mae(_scores(spark, d)))


@register("v8_mae_std", _AGG_SQL + " SELECT dataset, method, round(weighted_mae_days, 6) AS weighted_mae_days, round(std_days, 6) AS std_days FROM agg")
def v8(spark, d):
    return _r(V.mae_std(_scores(spark, d)))


@register(
    "v9_rank_methods",
    _AGG_SQL + " SELECT dataset, method, CAST(rank() OVER (PARTITION BY dataset ORDER BY weighted_mae_days) AS INTEGER) AS rank FROM agg",
)
def v9(spark, d):
    return V.rank_methods(V.mae_std(_scores(spark, d))).select("dataset", "method", "rank")


@register(
    "v10_mean_rank",
    _AGG_SQL + ", rnk AS (SELECT method, rank() OVER (PARTITION BY dataset ORDER BY weighted_mae_days) AS rank FROM agg) "
    "SELECT method, round(avg(rank), 6) AS mean_rank, round(stddev_samp(rank), 6) AS std_rank FROM rnk GROUP BY method",
)
def v10(spark, d):
    return _r(V.mean_rank(V.rank_methods(V.mae_std(_scores(spark, d)))))


_DUR_SQL = (
    "dur AS (SELECT 'EL1' AS dataset, CAST(sum(us) AS DOUBLE) / count(*) / CAST(86400000000 AS DOUBLE) AS case_duration_days FROM "
    "(SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM el1 GROUP BY case_id) UNION ALL "
    "SELECT 'EL2', CAST(sum(us) AS DOUBLE) / count(*) / CAST(86400000000 AS DOUBLE) FROM "
    "(SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM el2 GROUP BY case_id))"
)


@register(
    "v11_normalised_mae",
    _AGG_SQL + ", " + _DUR_SQL + ", nm AS (SELECT agg.method, weighted_mae_days / case_duration_days AS norm_mae, "
    "std_days / case_duration_days AS norm_std FROM agg JOIN dur ON agg.dataset = dur.dataset) "
    "SELECT method, round(avg(norm_mae), 6) AS mean_norm_mae, round(stddev_samp(norm_mae), 6) AS std_norm_mae, "
    "round(avg(norm_std), 6) AS mean_norm_std FROM nm GROUP BY method",
)
def v11(spark, d):
    durs = V.case_duration_days(el1(spark, d), EL1, "EL1").unionByName(V.case_duration_days(el2(spark, d), EL2, "EL2"))
    return _r(V.normalised_mae(V.mae_std(_scores(spark, d)), durs))


@register(
    "v12_stability",
    DETAILS_SQL + ", st AS (SELECT dataset, method, cls, case_id, nr_events, (predicted - actual) / 86400.0 AS e FROM details), "
    "df AS (SELECT *, abs(e - lag(e) OVER (PARTITION BY dataset, method, cls, case_id ORDER BY nr_events)) * nr_events AS dd FROM st), "
    "pc AS (SELECT dataset, method, cls, case_id, avg(dd) AS inst FROM df GROUP BY ALL HAVING avg(dd) IS NOT NULL) "
    "SELECT dataset, method, cls, round(avg(inst), 6) AS mean_std, round(stddev_samp(inst), 6) AS std_std FROM pc GROUP BY ALL",
)
def v12(spark, d):
    return _r(V.stability(details(spark, d)))


@register(
    "v13_strip_suffix",
    DETAILS_SQL + ", ids AS (SELECT DISTINCT CASE WHEN nr_events > 2 THEN case_id || '_' || nr_events ELSE case_id END AS prefix_id "
    "FROM details) SELECT prefix_id, regexp_replace(prefix_id, '_\\d+$', '') AS case_id FROM ids",
)
def v13(spark, d):
    ids = details(spark, d).select(
        F.when(F.col("nr_events") > 2, F.concat_ws("_", "case_id", F.col("nr_events").cast("string"))).otherwise(F.col("case_id")).alias("prefix_id")
    ).distinct()
    return ids.select("prefix_id", V.strip_suffix(F.col("prefix_id")).alias("case_id"))


# fixed values: file-name token -> method family (the report's relabelling rules); '*' = any method
METHOD_LABELS = [
    ("*", "3000000", "mean"),
    ("FA", "30", "predictive"),
    ("regression", "30", "simple"),
    ("*", "5", "adaptive"),
    ("*", "10", "adaptive"),
    ("*", "20", "adaptive"),
    ("*", "sqrt", "adaptive"),
]
# the fixture's predictors dressed as result files: method -> (method2, token)
_FILE_PARTS = {"mean": ("FA", "3000000"), "median": ("FA", "30"), "zero": ("regression", "30")}


@register(
    "v14_label_methods",
    _SC_SQL + ", fp AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{a}', '{b}')" for m, (a, b) in _FILE_PARTS.items()) + ") t(method, method2, token)), "
    "lk AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in METHOD_LABELS) + ") t(lm2, ltoken, label)) "
    "SELECT DISTINCT s.dataset, s.method, fp.method2, fp.token, coalesce(lk.label, fp.token) || '_' || fp.method2 AS method_label "
    "FROM scores s JOIN fp ON s.method = fp.method LEFT JOIN lk ON lk.ltoken = fp.token AND (lk.lm2 = fp.method2 OR lk.lm2 = '*')",
)
def v14(spark, d):
    parts = spark.createDataFrame([(m, a, b) for m, (a, b) in _FILE_PARTS.items()], "method string, method2 string, token string")
    lookup = spark.createDataFrame(METHOD_LABELS, "lm2 string, ltoken string, label string")
    s = _scores(spark, d).join(F.broadcast(parts), "method")
    out = V.label_methods(s, lookup)
    return out.select(
        "dataset", "method", "method2", "token", F.concat_ws("_", "method_label", "method2").alias("method_label")
    ).distinct()


@register(
    "v15_unpivot_errors",
    DETAILS_SQL + ", e AS (SELECT dataset, method, nr_events, abs(predicted - actual) * 1000 AS err FROM details), "
    "g AS (SELECT DISTINCT dataset, method FROM e), t AS (SELECT unnest(range(2, (SELECT max(nr_events) + 1 FROM e))) AS n) "
    "SELECT g.dataset, g.method, CAST(t.n AS INTEGER) AS nr_events, round(avg(e.err) / 1000.0, 4) AS score, count(e.err) AS nr_cases "
    "FROM g CROSS JOIN t LEFT JOIN e ON e.dataset = g.dataset AND e.method = g.method AND e.nr_events = t.n GROUP BY ALL",
)
def v15(spark, d):
    det, by = details(spark, d), ["dataset", "method"]
    top = det.agg(F.max("nr_events")).first()[0]
    lengths = list(range(2, (top or 1) + 1))
    # wide per-case error file: a column for each prefix length of the table, milliseconds
    wide = det.groupBy(*by, "case_id").pivot("nr_events", lengths).agg(F.first(F.abs(F.col("predicted") - F.col("actual")) * 1000))
    wide = wide.toDF(*by, "case_id", *[f"Error{n}" for n in lengths])
    return _r(V.unpivot_errors(wide, "Error", lengths, by=by), 4)


_V16_SQL = (
    fa_sql("prefix")
    + f", mt0 AS (SELECT {mean_cols(1)} FROM trp), "
    "t0 AS (SELECT pf.case_id, pf.prefix_len, "
    + ", ".join(f"coalesce(mt0.{a}, fb.{a}) AS {a}" for a in EL1_ACTIVITIES)
    + " FROM pf CROSS JOIN mt0 CROSS JOIN fb WHERE NOT pf.is_train), "
    "m AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS activity, terms.prefix_len, terms.{a} AS pred, t0.{a} AS mean, tg2.{a} AS actual FROM terms "
        f"JOIN t0 ON terms.case_id = t0.case_id AND terms.prefix_len = t0.prefix_len JOIN tg2 ON terms.case_id = tg2.case_id"
        for a in EL1_ACTIVITIES
    )
    + "), ag AS (SELECT activity, prefix_len, avg(abs(pred - actual)) AS pred_MAE, avg(abs(mean - actual)) AS pred_mean, "
    "avg(actual) AS mean_CT FROM m WHERE actual IS NOT NULL GROUP BY activity, prefix_len) "
    "SELECT activity, prefix_len AS prefix_length, 'pred_MAE' AS var, round(pred_MAE, 6) AS value FROM ag UNION ALL "
    "SELECT activity, prefix_len, 'pred_mean', round(pred_mean, 6) FROM ag UNION ALL "
    "SELECT activity, prefix_len, 'mean_CT', round(mean_CT, 6) FROM ag"
)


@register("v16_activity_diagnostics", _V16_SQL)
def v16(spark, d):
    from procmon.operators import targets as L

    _, pred = _terms(spark, d, "prefix")
    _, mean = _terms(spark, d, "zero")
    tg = L.build_targets(el1(spark, d), EL1, EL1_RULES)
    return _r(V.activity_diagnostics(pred, mean, tg, EL1_ACTIVITIES))


_V17_SQL = (
    "x AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, {tb}) AS nr, "
    "epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id)) AS tsc FROM {src}), "
    "pc AS (SELECT case_id, count(DISTINCT ts) / count(*) AS utr, "
    "max(CASE WHEN nr = 5 THEN 1 END) AS r5, max(CASE WHEN nr = 20 THEN 1 END) AS r20, "
    "max(CASE WHEN nr = 5 AND tsc = 0 THEN 1 END) AS z5, max(CASE WHEN nr = 20 AND tsc = 0 THEN 1 END) AS z20 FROM x GROUP BY case_id) "
    "SELECT '{name}' AS log, round(avg(utr), 6) AS avg_unique_timestamp_per_trace, count(r5) AS cases_longer_5, count(r20) AS cases_longer_20, "
    "count(z5) AS timestamp_0_after_5, count(z20) AS timestamp_0_after_20, "
    "round((SELECT count(DISTINCT ts) / count(ts) FROM {src}), 6) AS avg_unique_timestamp_global FROM pc"
)


@register("v17_log_quality", with_(EL2_SQL) + ", " + _V17_SQL.format(src="el2", tb="order_key", name="EL2"))
def v17(spark, d):
    return _r(V.log_quality(T.time_since_start(el2(spark, d), EL2), EL2, "EL2"))


@register("v17b_log_quality_events", with_(EL1_SQL) + ", " + _V17_SQL.format(src="el1", tb="event_id", name="EL1"))
def v17b(spark, d):
    return _r(V.log_quality(T.time_since_start(el1(spark, d), EL1), EL1, "EL1"))


_V18_ONE = (
    "SELECT '{name}' AS log, count(*) AS nr_cases, (SELECT count(DISTINCT activity) FROM {src}) AS nr_activities, sum(n) AS nr_events, "
    "round(sum(n) / count(*), 6) AS mean_events_per_case, max(n) AS max_events_per_case, "
    "round(quantile_cont(days, 0.5), 6) AS median_case_duration_days, "
    "round(CAST(sum(us) AS DOUBLE) / count(*) / CAST(86400000000 AS DOUBLE), 6) AS mean_case_duration_days FROM "
    "(SELECT count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, "
    "CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS days FROM {src} GROUP BY case_id)"
)


@register(
    "v18_log_statistics",
    with_(EL1_SQL, EL2_SQL)
    + "SELECT log, nr_cases, nr_activities, CAST(nr_events AS BIGINT) AS nr_events, mean_events_per_case, max_events_per_case, "
    "median_case_duration_days, mean_case_duration_days FROM ("
    + _V18_ONE.format(name="EL1", src="el1")
    + " UNION ALL "
    + _V18_ONE.format(name="EL2", src="el2")
    + ")",
)
def v18(spark, d):
    out = V.log_statistics(el1(spark, d), EL1, "EL1").unionByName(V.log_statistics(el2(spark, d), EL2, "EL2"))
    return _r(out)


@register(
    "v19_drop_incomplete",
    with_(EL1N_SQL)
    + ", c AS (SELECT count(*) AS n_all, count(CASE WHEN value_n IS NOT NULL AND segment_n IS NOT NULL THEN 1 END) AS n_ok FROM el1n) "
    "SELECT case_id, event_id, value_n, segment_n, (n_all - n_ok) / n_ok > 0.01 AS warning FROM el1n, c "
    "WHERE value_n IS NOT NULL AND segment_n IS NOT NULL",
)
def v19(spark, d):
    df = el1(spark, d, nulls=True).select("case_id", "event_id", "value_n", "segment_n")
    kept, warning = V.drop_incomplete(df)
    return kept.withColumn("warning", F.lit(bool(warning)))
