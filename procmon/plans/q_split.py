"""Queries D1–D11 and bucketing B1–B4."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.operators import prefixes as P
from procmon.operators import split as D
from procmon.operators import targets as L
from procmon.plans.fixtures import EL1, EL1_SQL, EL2, EL2_SQL, el1, el2, with_
from procmon.plans.registry import ORACLE, register
from procmon.plans.rulesets import EL1_RULES, EL1_TARGETS_SQL

_RANK_SQL = """cs AS (SELECT case_id, min(ts) AS s FROM {src} GROUP BY case_id),
rk AS (SELECT case_id, row_number() OVER (ORDER BY s, case_id) AS rn, count(*) OVER () AS n FROM cs)"""


def _parts(train, test, tb):
    return train.select("case_id", tb, F.lit("train").alias("part")).unionByName(
        test.select("case_id", tb, F.lit("test").alias("part"))
    )


@register(
    "d1_temporal_split",
    with_(EL1_SQL, _RANK_SQL.format(src="el1"))
    + "SELECT e.case_id, e.event_id, CASE WHEN rk.rn <= ceil(0.8 * rk.n) THEN 'train' ELSE 'test' END AS part "
    "FROM el1 e JOIN rk ON e.case_id = rk.case_id",
)
def d1(spark, d):
    train, test = D.temporal_split(el1(spark, d), EL1, 0.8)
    return _parts(train, test, "event_id")


@register(
    "d1b_temporal_split_ties",
    with_(EL2_SQL, _RANK_SQL.format(src="el2"))
    + "SELECT e.case_id, e.order_key, CASE WHEN rk.rn <= ceil(0.7 * rk.n) THEN 'train' ELSE 'test' END AS part "
    "FROM el2 e JOIN rk ON e.case_id = rk.case_id",
)
def d1b(spark, d):
    train, test = D.temporal_split(el2(spark, d), EL2, 0.7)
    return _parts(train, test, "order_key")


# the seeded hash of a case in SQL: the first 60 bits of an MD5
_HASH_SQL = "h AS (SELECT case_id, CAST('0x' || substr(md5(case_id || '|22'), 1, 15) AS BIGINT) AS h FROM el1 GROUP BY case_id)"


@register(
    "d2_random_split",
    with_(EL1_SQL, _HASH_SQL, "hr AS (SELECT case_id, row_number() OVER (ORDER BY h, case_id) AS rn, count(*) OVER () AS n FROM h)")
    + "SELECT e.case_id, e.event_id, CASE WHEN hr.rn <= ceil(0.8 * hr.n) THEN 'train' ELSE 'test' END AS part "
    "FROM el1 e JOIN hr ON e.case_id = hr.case_id",
)
def d2(spark, d):
    train, test = D.random_split(el1(spark, d), EL1, 0.8, seed=22)
    return _parts(train, test, "event_id")


@register(
    "d3_three_way_split",
    with_(
        EL1_SQL,
        _RANK_SQL.format(src="el1"),
        "tv AS (SELECT e.* FROM el1 e JOIN rk ON e.case_id = rk.case_id WHERE rk.rn <= ceil(0.8 * rk.n))",
        _RANK_SQL.format(src="tv").replace("cs AS", "cs2 AS").replace("rk AS", "rk2 AS").replace("FROM cs)", "FROM cs2)"),
    )
    + "SELECT e.case_id, e.event_id, CASE WHEN rk2.rn IS NULL THEN 'test' WHEN rk2.rn <= ceil(0.8 * rk2.n) THEN 'train' "
    "ELSE 'validation' END AS part FROM el1 e LEFT JOIN rk2 ON e.case_id = rk2.case_id",
)
def d3(spark, d):
    train, val, test = D.three_way_split(el1(spark, d), EL1, 0.8, 0.8)
    return _parts(train, test, "event_id").unionByName(val.select("case_id", "event_id", F.lit("validation").alias("part")))


# k contiguous blocks of each class in hash order, the first n % k one case larger
_FOLD_SQL = """fo AS (SELECT case_id, CAST(CASE WHEN r < (n // 5 + 1) * (n % 5) THEN r // (n // 5 + 1)
    ELSE n % 5 + (r - (n // 5 + 1) * (n % 5)) // greatest(n // 5, 1) END AS INTEGER) AS fold FROM hr)"""


@register(
    "d4_kfold",
    with_(EL1_SQL, _HASH_SQL, "hr AS (SELECT case_id, row_number() OVER (ORDER BY h) - 1 AS r, count(*) OVER () AS n FROM h)", _FOLD_SQL)
    + "SELECT e.case_id, e.event_id, fo.fold FROM el1 e JOIN fo ON e.case_id = fo.case_id",
)
def d4(spark, d):
    return D.kfold(el1(spark, d), EL1, k=5, seed=22).select("case_id", "event_id", "fold")


@register(
    "d4b_stratified_kfold",
    with_(
        EL1_SQL,
        EL1_TARGETS_SQL,
        _HASH_SQL,
        "hr AS (SELECT h.case_id, row_number() OVER (PARTITION BY x2 ORDER BY h) - 1 AS r, count(*) OVER (PARTITION BY x2) AS n "
        "FROM h JOIN tg ON h.case_id = tg.case_id)",
        _FOLD_SQL,
    )
    + "SELECT e.case_id, e.event_id, tg.x2, fo.fold FROM el1 e JOIN fo ON e.case_id = fo.case_id JOIN tg ON e.case_id = tg.case_id",
)
def d4b(spark, d):
    t = L.build_targets(el1(spark, d), EL1, EL1_RULES).select("case_id", "x2")
    ev = el1(spark, d).join(t, "case_id")
    return D.kfold(ev, EL1, k=5, label="x2", seed=22).select("case_id", "event_id", "x2", "fold")


_NR_SQL = "nl AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS nr, count(*) OVER (PARTITION BY case_id) AS len FROM {src})"


@register(
    "d5_prefix_log",
    with_(EL1_SQL, _NR_SQL.format(src="el1"))
    + "SELECT case_id, event_id, CAST(p AS INTEGER) AS prefix_len FROM nl, range(2, (SELECT max(len) FROM nl)) t(p) WHERE p >= nr AND p < len",
)
def d5(spark, d):
    return D.prefix_log(el1(spark, d), EL1, 2).select("case_id", "event_id", "prefix_len")


@register(
    "d6_partial_traces",
    with_(
        EL1_SQL,
        _RANK_SQL.format(src="el1"),
        "te AS (SELECT e.* FROM el1 e JOIN rk ON e.case_id = rk.case_id WHERE rk.rn > ceil(0.8 * rk.n))",
        _NR_SQL.format(src="te"),
    )
    + "SELECT case_id, event_id, CAST(p AS INTEGER) AS prefix_len FROM nl, range(2, 21) t(p) WHERE p >= nr AND p < len",
)
def d6(spark, d):
    return D.partial_traces(el1(spark, d), EL1, 0.8, 2, 20).select("case_id", "event_id", "prefix_len")


@register(
    "d7_length_quantile",
    with_(EL1_SQL, "cl AS (SELECT case_id, count(*) AS len FROM el1 GROUP BY case_id)")
    + "SELECT CAST(ceil(quantile_cont(len, 0.9)) AS INTEGER) AS q90_length FROM cl",
)
def d7(spark, d):
    return spark.createDataFrame([(D.length_quantile(el1(spark, d), EL1, 0.9),)], "q90_length int")


@register(
    "d8_restrict",
    with_(EL1_SQL, EL1_TARGETS_SQL) + "SELECT case_id, event_id FROM el1 WHERE case_id IN (SELECT case_id FROM tg WHERE x3 IS NOT NULL)",
)
def d8(spark, d):
    df = el1(spark, d)
    cases = L.build_targets(df, EL1, EL1_RULES).where(F.col("x3").isNotNull())
    return D.restrict(df, EL1, cases).select("case_id", "event_id")


@register(
    "d8b_exclude",
    with_(EL1_SQL, EL1_TARGETS_SQL)
    + "SELECT case_id, event_id FROM el1 WHERE case_id NOT IN (SELECT case_id FROM tg WHERE x3 IS NOT NULL)",
)
def d8b(spark, d):
    df = el1(spark, d)
    cases = L.build_targets(df, EL1, EL1_RULES).where(F.col("x3").isNotNull())
    return D.restrict(df, EL1, cases, anti=True).select("case_id", "event_id")


@register("d9_case_index", with_(EL1_SQL) + "SELECT DISTINCT case_id FROM el1")
def d9(spark, d):
    return D.case_index(el1(spark, d), EL1)


@register(
    "d10_prefixes_of",
    with_(EL1_SQL, _NR_SQL.format(src="el1"))
    + "SELECT case_id, event_id, CAST(p AS INTEGER) AS prefix_len FROM nl, range(3, 4) t(p) WHERE p >= nr AND p < len",
)
def d10(spark, d):
    return D.prefixes_of(D.prefix_log(el1(spark, d), EL1, 2), 3).select("case_id", "event_id", "prefix_len")


@register(
    "d10b_prefix_sizes",
    with_(EL1_SQL, _NR_SQL.format(src="el1"))
    + "SELECT CAST(p AS INTEGER) AS prefix_len, count(DISTINCT case_id) AS n_prefixes FROM nl, range(2, (SELECT max(len) FROM nl)) t(p) "
    "WHERE p >= nr AND p < len GROUP BY p",
)
def d10b(spark, d):
    return D.prefix_sizes(D.prefix_log(el1(spark, d), EL1, 2), EL1)


@register("d6b_partial_traces_ranges", ORACLE["d6_partial_traces"])
def d6b(spark, d):
    return P.expand(P.partial_traces(el1(spark, d), EL1, 0.8, 2, 20)).select("case_id", "event_id", "prefix_len")


@register("d10c_prefix_sizes_ranges", ORACLE["d10b_prefix_sizes"])
def d10c(spark, d):
    return P.sizes(P.ranges(el1(spark, d), EL1, 2), EL1)


@register(
    "d11_length_histogram",
    with_(EL1_SQL, "cl AS (SELECT case_id, count(*) AS case_length FROM el1 GROUP BY case_id)")
    + "SELECT case_length, count(*) AS n_cases FROM cl GROUP BY case_length",
)
def d11(spark, d):
    return D.length_histogram(el1(spark, d), EL1)
