"""Queries L1–L14 on EL1 with the fixture rule set."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.functions.rules import Count, Counts, Follows, RuleSet, rules_from_dict
from procmon.operators import features as T
from procmon.operators import prefixes as P
from procmon.operators import split as D
from procmon.operators import targets as L
from procmon.plans.fixtures import EL1, EL1_SQL, el1, with_
from procmon.plans.registry import register, sql_unit
from procmon.plans.rulesets import EL1_ACTIVITIES, EL1_RULES, EL1_RULES_DICT, EL1_TARGETS_SQL

_TG = with_(EL1_SQL, EL1_TARGETS_SQL)
_ACTS = ", ".join(EL1_ACTIVITIES)


@register("l1_cycle_times", _TG + f"SELECT case_id, {_ACTS} FROM tg")
def l1(spark, d):
    return L.cycle_times(el1(spark, d), EL1, EL1_ACTIVITIES)


@register("l2_gateway_follows", _TG + "SELECT case_id, x1, x4 FROM tg")
def l2(spark, d):
    return L.gateway_follows(el1(spark, d), EL1, EL1_RULES)


@register("l3_gateway_presence", _TG + "SELECT case_id, x2 FROM tg")
def l3(spark, d):
    return L.gateway_presence(el1(spark, d), EL1, EL1_RULES)


@register("l4_gateway_count", _TG + "SELECT case_id, x3 FROM tg")
def l4(spark, d):
    return L.gateway_count(el1(spark, d), EL1, EL1_RULES)


# counts of two activities in one condition; in x6 the later count rule overrides the follows rule
_JOINT_RULES = RuleSet(
    gateways=("x5", "x6"),
    rules=(
        Counts("x5", (((("purchase", ">", 0), ("view", "<=", 1)), 0), ((("purchase", "==", 0), ("click", ">=", 2)), 2))),
        Follows("x6", "view", "purchase", taken=1, not_taken=0),
        Count("x6", "purchase", ((">", 1, 2),)),
    ),
)


@register(
    "l4b_joint_counts",
    _TG + ", n AS (SELECT case_id, count_if(activity = 'purchase') AS p, count_if(activity = 'view') AS v, count_if(activity = 'click') AS c "
    "FROM el1 GROUP BY case_id) SELECT tg.case_id, CAST(CASE WHEN p > 0 AND v <= 1 THEN 0 WHEN p = 0 AND c >= 2 THEN 2 END AS INTEGER) AS x5, "
    "CASE WHEN p > 1 THEN 2 ELSE x1 END AS x6 FROM tg JOIN n ON tg.case_id = n.case_id",
)
def l4b(spark, d):
    return L.build_targets(el1(spark, d), EL1, _JOINT_RULES)


@register("l5_label_defaults", _TG + "SELECT case_id, coalesce(x1, -1) AS x1, coalesce(x4, 0) AS x4 FROM tg")
def l5(spark, d):
    return L.label_defaults(L.gateway_follows(el1(spark, d), EL1, EL1_RULES), EL1_RULES)


_SINK_SQL = (
    "SELECT case_id, "
    + ", ".join(f"coalesce({a}, -1.0) AS {a}" for a in EL1_ACTIVITIES)
    + ", coalesce(x1, -1) AS x1, coalesce(x2, -1) AS x2, coalesce(x3, -1) AS x3, coalesce(x4, 0) AS x4 FROM tg"
)


@register("l6_build_targets", _TG + _SINK_SQL)
def l6(spark, d):
    return L.build_targets(el1(spark, d), EL1, EL1_RULES, sink=True)


@register(
    "l7_compile_rules",
    _TG + f"SELECT case_id, {_ACTS}, x1, x2, x3, CAST(coalesce(x4, 0) AS INTEGER) AS x4 FROM tg",
)
def l7(spark, d):
    return L.build_targets(el1(spark, d), EL1, rules_from_dict(EL1_RULES_DICT))


def _targets(spark, d):
    return L.build_targets(el1(spark, d), EL1, EL1_RULES)


@register(
    "l8_add_target",
    _TG + "SELECT e.case_id, e.event_id, tg.x1, tg.x3 FROM el1 e JOIN tg ON e.case_id = tg.case_id",
)
def l8(spark, d):
    return L.add_target(el1(spark, d), EL1, _targets(spark, d), ["x1", "x3"]).select("case_id", "event_id", "x1", "x3")


@register(
    "l9_defined_only",
    _TG + "SELECT e.case_id, e.event_id, tg.x1 FROM el1 e JOIN tg ON e.case_id = tg.case_id WHERE tg.x1 IS NOT NULL",
)
def l9(spark, d):
    ev = L.add_target(el1(spark, d), EL1, _targets(spark, d), ["x1"])
    return L.defined_only(ev, "x1").select("case_id", "event_id", "x1")


_PREFIX_SQL = """pf AS (
  SELECT e.case_id, e.event_id, e.remtime, CAST(p AS INTEGER) AS prefix_len
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS nr,
               count(*) OVER (PARTITION BY case_id) AS len,
               """ + sql_unit("epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)", "s") + """ AS remtime
        FROM el1) e, range(2, (SELECT max(n) FROM (SELECT count(*) AS n FROM el1 GROUP BY case_id))) t(p)
  WHERE p >= nr AND p < len)"""


@register(
    "l10_prefix_label_regr",
    with_(EL1_SQL, _PREFIX_SQL) + "SELECT case_id, prefix_len, min(remtime) AS remtime FROM pf GROUP BY case_id, prefix_len",
)
def l10(spark, d):
    ev = T.remaining_time(el1(spark, d), EL1)
    return L.prefix_label(D.prefix_log(ev, EL1, 2), EL1, "remtime", "regr")


@register("l10c_prefix_label_ranges", with_(EL1_SQL, _PREFIX_SQL) + "SELECT case_id, prefix_len, min(remtime) AS remtime FROM pf GROUP BY case_id, prefix_len")
def l10c(spark, d):
    return P.labels(P.ranges(T.remaining_time(el1(spark, d), EL1), EL1, 2), EL1, "remtime", "regr")


@register(
    "l10b_prefix_label_class",
    with_(EL1_SQL, "seg AS (SELECT *, activity AS first_label FROM el1)")
    + ", pf AS (SELECT e.*, CAST(p AS INTEGER) AS prefix_len FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS nr, "
    "count(*) OVER (PARTITION BY case_id) AS len FROM seg) e, range(2, (SELECT max(n) FROM (SELECT count(*) AS n FROM el1 GROUP BY case_id))) t(p) WHERE p >= nr AND p < len) "
    "SELECT case_id, prefix_len, arg_min(first_label, (ts, event_id)) AS first_label FROM pf GROUP BY case_id, prefix_len",
)
def l10b(spark, d):
    ev = el1(spark, d).withColumn("first_label", F.col("activity"))
    return L.prefix_label(D.prefix_log(ev, EL1, 2), EL1, "first_label", "class")


@register(
    "l11_class_ratio",
    _TG + ", c AS (SELECT x2, count(*) AS n FROM tg WHERE x2 IS NOT NULL GROUP BY x2) "
    "SELECT x2, n / CAST(sum(n) OVER () AS BIGINT) AS ratio FROM c",
)
def l11(spark, d):
    return L.class_ratio(_targets(spark, d), "x2")


@register(
    "l12_gateway_exits",
    _TG + ", g AS (SELECT 'x1' AS gateway, x1 AS cls FROM tg UNION ALL SELECT 'x2', x2 FROM tg UNION ALL "
    "SELECT 'x3', x3 FROM tg UNION ALL SELECT 'x4', coalesce(x4, 0) FROM tg) "
    "SELECT gateway, count(DISTINCT cls) AS exits FROM g GROUP BY gateway",
)
def l12(spark, d):
    return L.gateway_exits(_targets(spark, d), ["x1", "x2", "x3", "x4"])


_DUR_SQL = "dur AS (SELECT case_id, " + sql_unit("epoch_us(max(ts)) - epoch_us(min(ts))", "s") + " AS duration FROM el1 GROUP BY case_id)"


@register("l13_median_case_duration", with_(EL1_SQL, _DUR_SQL) + "SELECT quantile_cont(duration, 0.5) AS median_duration FROM dur")
def l13(spark, d):
    m = L.median_case_duration(el1(spark, d), EL1)
    return spark.createDataFrame([(m,)], "median_duration double")


@register(
    "l14_assign_label",
    with_(EL1_SQL, _DUR_SQL, "m AS (SELECT quantile_cont(duration, 0.5) AS thr FROM dur)")
    + "SELECT e.case_id, e.event_id, CASE WHEN dur.duration < m.thr THEN 'false' ELSE 'true' END AS label "
    "FROM el1 e JOIN dur ON e.case_id = dur.case_id, m",
)
def l14(spark, d):
    df = el1(spark, d)
    thr = L.median_case_duration(df, EL1)
    return L.assign_label(df, EL1, thr).select("case_id", "event_id", "label")
