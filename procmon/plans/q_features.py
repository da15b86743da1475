"""Queries T1–T9 on EL1 / EL2."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.operators import features as T
from procmon.plans.fixtures import EL1, EL1_SQL, EL2, EL2_SQL, el1, el2, with_
from procmon.plans.registry import W1, register, sql_unit

_KEY = ["case_id", "event_id"]


@register(
    "t1_time_since_last",
    with_(EL1_SQL)
    + f"SELECT case_id, event_id, {sql_unit('coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0)', 'm')} AS timesincelastevent FROM el1 {W1}",
)
def t1(spark, d):
    return T.time_since_last(el1(spark, d), EL1, "m").select(*_KEY, "timesincelastevent")


@register(
    "t2_time_since_start",
    with_(EL1_SQL)
    + f"SELECT case_id, event_id, {sql_unit('epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id))', 'm')} AS timesincecasestart FROM el1",
)
def t2(spark, d):
    return T.time_since_start(el1(spark, d), EL1, "m").select(*_KEY, "timesincecasestart")


@register(
    "t3_remaining_time",
    with_(EL1_SQL)
    + f"SELECT case_id, event_id, {sql_unit('epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)', 's')} AS remtime FROM el1",
)
def t3(spark, d):
    return T.remaining_time(el1(spark, d), EL1).select(*_KEY, "remtime")


@register(
    "t4_duration",
    with_(EL2_SQL)
    + f"SELECT case_id, order_key, {sql_unit('coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY case_id ORDER BY ts, order_key)), 0)', 'm')} AS duration FROM el2",
)
def t4(spark, d):
    return T.duration(el2(spark, d), EL2).select("case_id", "order_key", "duration")


@register(
    "t5_event_nr",
    with_(EL2_SQL)
    + "SELECT case_id, order_key, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, order_key) AS INTEGER) AS event_nr FROM el2",
)
def t5(spark, d):
    return T.event_nr(el2(spark, d), EL2).select("case_id", "order_key", "event_nr")


@register(
    "t6_case_length",
    with_(EL1_SQL) + "SELECT case_id, event_id, count(*) OVER (PARTITION BY case_id) AS case_length FROM el1",
)
def t6(spark, d):
    return T.case_length(el1(spark, d), EL1).select(*_KEY, "case_length")


@register(
    "t7_calendar",
    with_(EL1_SQL)
    + "SELECT case_id, event_id, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, "
    "CAST(hour(ts) AS INTEGER) AS hour FROM el1",
)
def t7(spark, d):
    return T.calendar(el1(spark, d), EL1).select(*_KEY, "month", "weekday", "hour")


@register(
    "t8_since_midnight",
    with_(EL1_SQL) + "SELECT case_id, event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS timesincemidnight FROM el1",
)
def t8(spark, d):
    return T.since_midnight(el1(spark, d), EL1).select(*_KEY, "timesincemidnight")


@register(
    "t9_activity_duration",
    with_(EL1_SQL)
    + f"SELECT case_id, event_id, {sql_unit('epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER w, ts))', 'm')} AS activity_duration FROM el1 {W1}",
)
def t9(spark, d):
    # the start of an activity is the completion of the previous event of the case
    df = el1(spark, d).withColumn("start_ts", F.coalesce(F.lag("ts").over(EL1.window()), F.col("ts")))
    return T.activity_duration(df, "start_ts", "ts", "m").select(*_KEY, "activity_duration")


@register(
    "t10_standard_features",
    with_(EL1_SQL)
    + "SELECT case_id, event_id, "
    + sql_unit("coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0)", "m")
    + " AS timesincelastevent, "
    + sql_unit("epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id))", "m")
    + " AS timesincecasestart, "
    + sql_unit("epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)", "s")
    + " AS remtime, CAST(row_number() OVER w AS INTEGER) AS event_nr, count(*) OVER (PARTITION BY case_id) AS case_length, "
    "CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour "
    f"FROM el1 {W1}",
)
def t10(spark, d):
    return T.standard_features(el1(spark, d), EL1).select(
        *_KEY, "timesincelastevent", "timesincecasestart", "remtime", "event_nr", "case_length", "month", "weekday", "hour"
    )
