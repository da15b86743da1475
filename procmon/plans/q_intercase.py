"""Queries O1–O2 (open cases) on EL1 and on EL2 (timestamp ties)."""

from __future__ import annotations

from procmon.operators.intercase import open_cases, open_cases_sequential
from procmon.plans.fixtures import EL1, EL1_SQL, EL2, EL2_SQL, el1, el2, with_
from procmon.plans.registry import register


def _o1_sql(src: str, tb: str) -> str:
    return (
        f"bounds AS (SELECT case_id, min(ts) AS s, max(ts) AS e FROM {src} GROUP BY case_id) "
        f"SELECT x.case_id, x.{tb}, (SELECT count(*) FROM bounds b WHERE b.s <= x.ts AND b.e > x.ts) AS open_cases FROM {src} x"
    )


def _o2_sql(src: str, tb: str) -> str:
    return (
        f"f AS (SELECT case_id, {tb}, ts, min(ts) OVER c AS s, max(ts) OVER c AS e, row_number() OVER w AS rn, lag(ts) OVER w AS prev "
        f"FROM {src} WINDOW c AS (PARTITION BY case_id), w AS (PARTITION BY case_id ORDER BY ts, {tb})), "
        f"d AS (SELECT case_id, {tb}, ts, CASE WHEN s < e THEN (CASE WHEN rn = 1 THEN 1 ELSE 0 END) "
        f"- (CASE WHEN ts = e AND (prev IS NULL OR prev < e) THEN 1 ELSE 0 END) ELSE 0 END AS d FROM f) "
        f"SELECT case_id, {tb}, CAST(coalesce(sum(d) OVER (ORDER BY ts, {tb} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "
        f"AS open_cases FROM d"
    )


@register("o1_open_cases", with_(EL1_SQL) + ", " + _o1_sql("el1", "event_id"))
def o1(spark, d):
    return open_cases(el1(spark, d), EL1).select("case_id", "event_id", "open_cases")


@register("o1b_open_cases_ties", with_(EL2_SQL) + ", " + _o1_sql("el2", "order_key"))
def o1b(spark, d):
    return open_cases(el2(spark, d), EL2).select("case_id", "order_key", "open_cases")


@register("o2_open_cases_sequential", with_(EL1_SQL) + ", " + _o2_sql("el1", "event_id"))
def o2(spark, d):
    return open_cases_sequential(el1(spark, d), EL1).select("case_id", "event_id", "open_cases")


@register("o2b_open_cases_sequential_ties", with_(EL2_SQL) + ", " + _o2_sql("el2", "order_key"))
def o2b(spark, d):
    return open_cases_sequential(el2(spark, d), EL2).select("case_id", "order_key", "open_cases")
