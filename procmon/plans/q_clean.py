"""Queries P1–P20 on the fixture logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.operators import clean as P
from procmon.plans.fixtures import EL1, EL1_SQL, EL1N, EL1N_SQL, EL2, EL2_SQL, el1, el2, table, with_
from procmon.plans.registry import register, sql_unit

_KEY = ["case_id", "event_id"]
_LAST_SQL = """last_act AS (
  SELECT case_id, activity FROM (
    SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) AS r
    FROM {src} WHERE activity IS NOT NULL) WHERE r = 1)"""
_WR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_TAG_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "click", "error", "purchase", "signup", "view"]


@register("p1_strip_prefix", with_(EL1_SQL) + "SELECT case_id, event_id, segment, nation FROM el1")
def p1(spark, d):
    df = el1(spark, d).select(*_KEY, F.col("segment").alias("(case) segment"), F.col("nation").alias("(case) nation"))
    return P.strip_prefix(df, "(case) ")


@register(
    "p2_project",
    with_(EL1_SQL) + "SELECT case_id, activity, ts, event_id, k, segment, nation, value, acctbal FROM el1",
)
def p2(spark, d):
    return P.project(el1(spark, d), EL1)


@register("p3_where_attr", with_(EL1_SQL) + "SELECT case_id, event_id, segment FROM el1 WHERE segment = 'BUILDING'")
def p3(spark, d):
    return P.where_attr(el1(spark, d), "segment", "BUILDING").select(*_KEY, "segment")


@register(
    "p4_swap_values",
    with_(EL1_SQL)
    + "SELECT case_id, event_id, CASE WHEN activity = 'click' THEN 'view' WHEN activity = 'view' THEN 'click' ELSE activity END AS activity FROM el1",
)
def p4(spark, d):
    return P.swap_values(el1(spark, d), "activity", "click", "view").select(*_KEY, "activity")


@register(
    "p5_fill_case_id",
    with_(EL1_SQL)
    + "SELECT coalesce(CASE WHEN activity <> 'signup' THEN case_id END, 'missing_caseid') AS case_id, event_id FROM el1",
)
def p5(spark, d):
    # fixture rule: the case id is blank on signup events
    df = el1(spark, d).withColumn("case_id", F.when(F.col("activity") != "signup", F.col("case_id")))
    return P.fill_case_id(df, EL1).select(*_KEY)


@register(
    "p6_drop_cols",
    with_(EL1_SQL) + "SELECT case_id, user_case, activity, ts, event_id, segment, nation, acctbal FROM el1",
)
def p6(spark, d):
    return P.drop_cols(el1(spark, d), ["k", "value"])


@register(
    "p7_drop_last_activity",
    with_(EL1_SQL, _LAST_SQL.format(src="el1"))
    + "SELECT case_id, event_id FROM el1 WHERE case_id NOT IN (SELECT case_id FROM last_act WHERE activity IN ('error'))",
)
def p7(spark, d):
    return P.filter_last_activity(el1(spark, d), EL1, ["error"], keep=False).select(*_KEY)


@register(
    "p7b_keep_last_activity",
    with_(EL2_SQL, _LAST_SQL.format(src="el2").replace("event_id", "order_key"))
    + "SELECT case_id, order_key FROM el2 WHERE case_id IN (SELECT case_id FROM last_act WHERE activity IN ('1-URGENT', '2-HIGH'))",
)
def p7b(spark, d):
    return P.filter_last_activity(el2(spark, d), EL2, ["1-URGENT", "2-HIGH"], keep=True).select("case_id", "order_key")


@register(
    "p8_filter_any_activity",
    with_(EL1_SQL)
    + "SELECT case_id, event_id FROM el1 WHERE case_id IN (SELECT case_id FROM el1 WHERE activity IN ('purchase', 'signup'))",
)
def p8(spark, d):
    return P.filter_any_activity(el1(spark, d), EL1, ["purchase", "signup"]).select(*_KEY)


@register(
    "p9_filter_min_length",
    with_(EL1_SQL)
    + "SELECT case_id, event_id FROM el1 WHERE case_id IN (SELECT case_id FROM el1 GROUP BY case_id HAVING count(*) > 2)",
)
def p9(spark, d):
    return P.filter_min_length(el1(spark, d), EL1, 2).select(*_KEY)


@register(
    "p10_ffill",
    with_(EL1N_SQL)
    + f"SELECT case_id, event_id, last_value(value_n IGNORE NULLS) OVER wr AS value_n, "
    f"last_value(segment_n IGNORE NULLS) OVER wr AS segment_n FROM el1n "
    f"WINDOW wr AS (PARTITION BY case_id ORDER BY ts, event_id {_WR})",
)
def p10(spark, d):
    return P.ffill(el1(spark, d, nulls=True), EL1N, ["value_n", "segment_n"]).select(*_KEY, "value_n", "segment_n")


@register(
    "p11_impute",
    with_(EL1N_SQL) + "SELECT case_id, event_id, coalesce(segment_n, 'missing') AS segment_n, coalesce(value_n, 0.0) AS value_n FROM el1n",
)
def p11(spark, d):
    return P.impute(el1(spark, d, nulls=True), EL1N).select(*_KEY, "segment_n", "value_n")


@register(
    "p12_rare_to_other",
    with_(
        EL1_SQL,
        "kept_k AS (SELECT k FROM el1 GROUP BY k HAVING count(*) >= 100)",
        "kept_n AS (SELECT nation FROM el1 GROUP BY nation HAVING count(*) >= 100)",
    )
    + "SELECT case_id, event_id, CASE WHEN k IN (SELECT k FROM kept_k) THEN k ELSE 'other' END AS k, "
    "CASE WHEN nation IN (SELECT nation FROM kept_n) THEN nation ELSE 'other' END AS nation FROM el1",
)
def p12(spark, d):
    return P.rare_to_other(el1(spark, d), ["k", "nation"], min_count=100).select(*_KEY, "k", "nation")


@register(
    "p13_topk_to_other",
    with_(
        EL1_SQL,
        "top_k AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY count(*) DESC, k ASC) AS r FROM el1 GROUP BY k) WHERE r <= 10)",
        "top_n AS (SELECT nation FROM (SELECT nation, row_number() OVER (ORDER BY count(*) DESC, nation ASC) AS r FROM el1 GROUP BY nation) WHERE r <= 10)",
    )
    + "SELECT case_id, event_id, CASE WHEN k IN (SELECT k FROM top_k) THEN k ELSE 'other' END AS k, "
    "CASE WHEN nation IN (SELECT nation FROM top_n) THEN nation ELSE 'other' END AS nation FROM el1",
)
def p13(spark, d):
    return P.topk_to_other(el1(spark, d), ["k", "nation"], k=10).select(*_KEY, "k", "nation")


@register(
    "p14_multi_hot",
    with_(EL1_SQL)
    + "SELECT case_id, event_id, "
    + ", ".join(
        f"CAST(list_contains(string_split(activity || ',' || segment, ','), '{v}') AS INTEGER) AS tags_{v}" for v in _TAG_LEVELS
    )
    + " FROM el1",
)
def p14(spark, d):
    df = el1(spark, d).withColumn("tags", F.concat_ws(",", "activity", "segment"))
    levels = P.fit_multi_hot(df, "tags")
    return P.multi_hot(df, "tags", levels).select(*_KEY, *[f"tags_{v}" for v in levels])


@register(
    "p15_normalise_activity",
    "SELECT o_orderkey AS order_key, regexp_replace(o_orderpriority, '\\s+', '_', 'g') AS activity FROM orders",
)
def p15(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("activity"))
    return P.normalise_activity(o, EL2).select("order_key", "activity")


@register("p16_sort_log", with_(EL1_SQL) + "SELECT case_id, event_id, ts FROM el1 ORDER BY ts, event_id")
def p16(spark, d):
    return P.sort_log(el1(spark, d), EL1).select(*_KEY, "ts")


_LAST_MATCH_SQL = """lm AS (
  SELECT case_id, activity AS last_match FROM (
    SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) AS r
    FROM el1 WHERE activity IN ('purchase', 'signup', 'error')) WHERE r = 1 AND activity IN ('purchase', 'signup'))"""


def _last_match(spark, d):
    cond = F.col("activity").isin("purchase", "signup", "error")
    return P.last_matching(el1(spark, d), EL1, cond, ["purchase", "signup"])


@register(
    "p17_last_matching",
    with_(EL1_SQL, _LAST_MATCH_SQL) + "SELECT e.case_id, e.event_id, lm.last_match FROM el1 e JOIN lm ON e.case_id = lm.case_id",
)
def p17(spark, d):
    return _last_match(spark, d).select(*_KEY, "last_match")


@register(
    "p18_one_vs_rest",
    with_(EL1_SQL, _LAST_MATCH_SQL)
    + "SELECT e.case_id, e.event_id, o.outcome, CASE WHEN lm.last_match = o.outcome THEN 'deviant' ELSE 'regular' END AS label "
    "FROM el1 e JOIN lm ON e.case_id = lm.case_id, (VALUES ('purchase'), ('signup')) o(outcome)",
)
def p18(spark, d):
    return P.one_vs_rest(_last_match(spark, d), "last_match", ["purchase", "signup"]).select(*_KEY, "outcome", "label")


@register(
    "p19_delta",
    with_(EL2_SQL)
    + "SELECT case_id, order_key, coalesce("
    + sql_unit("epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY case_id ORDER BY ts, order_key))", "d")
    + ", 0.0) AS delta FROM el2",
)
def p19(spark, d):
    df = el2(spark, d).withColumn("prev_ts", F.lag("ts").over(EL2.window()))
    return P.delta(df, "prev_ts", "ts", "d").select("case_id", "order_key", "delta")


_P20_SQL = with_(
    EL1N_SQL,
    _LAST_SQL.format(src="el1n"),
    "f1 AS (SELECT * FROM el1n WHERE case_id NOT IN (SELECT case_id FROM last_act WHERE activity IN ('error')))",
    "f2 AS (SELECT * FROM f1 WHERE case_id IN (SELECT case_id FROM f1 GROUP BY case_id HAVING count(*) > 2))",
    "f3 AS (SELECT case_id, event_id, activity, "
    "coalesce(last_value(k IGNORE NULLS) OVER wr, 'missing') AS k, "
    "coalesce(last_value(segment_n IGNORE NULLS) OVER wr, 'missing') AS segment_n, "
    "coalesce(last_value(value_n IGNORE NULLS) OVER wr, 0.0) AS value_n, "
    + sql_unit("coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0)", "m")
    + " AS timesincelastevent, "
    + sql_unit("epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)", "s")
    + " AS remtime, CAST(row_number() OVER w AS INTEGER) AS event_nr, count(*) OVER (PARTITION BY case_id) AS case_length "
    f"FROM f2 WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id), wr AS (PARTITION BY case_id ORDER BY ts, event_id {_WR}))",
    "kept AS (SELECT k FROM f3 GROUP BY k HAVING count(*) >= 100)",
) + (
    "SELECT case_id, event_id, activity, CASE WHEN k IN (SELECT k FROM kept) THEN k ELSE 'other' END AS k, "
    "segment_n, value_n, timesincelastevent, remtime, event_nr, case_length FROM f3"
)


@register("p20_clean_log", _P20_SQL)
def p20(spark, d):
    cfg = P.CleanConfig(drop_last=("error",), min_length=2, features_unit="m", rare_cols=("k",), rare_min=100)
    out = P.clean_log(el1(spark, d, nulls=True), EL1N, cfg)
    return out.select(*_KEY, "activity", "k", "segment_n", "value_n", "timesincelastevent", "remtime", "event_nr", "case_length")
