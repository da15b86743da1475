"""Per-case time and position features.

All window features of a log use the one case window of its spec, so that a
chain of them costs a single hash exchange on the case column followed by one
sort on ``(case, ts, tiebreak)``.  With ``hot`` (``segmented.hot_cases``) large cases
are windowed segment by segment, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.functions.time import in_unit, micros_between
from procmon.spec import LogSpec, col


def _context(df: DataFrame, spec: LogSpec, hot: DataFrame, **values) -> DataFrame:
    """The case's values joined from the states of its segments (``segmented.case_context``)."""
    from procmon.operators.segmented import case_context

    return case_context(df, spec, hot, **values)


def time_since_last(df: DataFrame, spec: LogSpec, unit: str = "m", name: str = "timesincelastevent", hot=None) -> DataFrame:
    """Time since the previous event of the case; 0 on the first event."""
    if hot is not None:
        prev = f"_lag_{spec.ts}"
        x = _context(df, spec, hot, lag=(spec.ts,))
        return x.withColumn(name, in_unit(F.coalesce(micros_between(col(prev), col(spec.ts)), F.lit(0)), unit)).drop("_pos", "_len", prev)
    prev = F.lag(col(spec.ts)).over(spec.window())
    return df.withColumn(name, in_unit(F.coalesce(micros_between(prev, col(spec.ts)), F.lit(0)), unit))


def time_since_start(df: DataFrame, spec: LogSpec, unit: str = "m", name: str = "timesincecasestart", hot=None) -> DataFrame:
    """Time since the first event of the case."""
    if hot is not None:
        start = f"_first_{spec.ts}"
        x = _context(df, spec, hot, first=(spec.ts,))
        return x.withColumn(name, in_unit(micros_between(col(start), col(spec.ts)), unit)).drop("_pos", "_len", start)
    start = F.min(col(spec.ts)).over(spec.whole_case())
    return df.withColumn(name, in_unit(micros_between(start, col(spec.ts)), unit))


def remaining_time(df: DataFrame, spec: LogSpec, unit: str = "s", name: str = "remtime", hot=None) -> DataFrame:
    """Time from the event to the last event of its case (seconds by default).
    ``hot`` (``segmented.hot_cases``): the case end comes from per-segment maxima."""
    if hot is not None:
        x = _context(df, spec, hot, case_max=(spec.ts,))
        return x.withColumn(name, in_unit(micros_between(col(spec.ts), col(f"_max_{spec.ts}")), unit)).drop("_pos", "_len", f"_max_{spec.ts}")
    end = F.max(col(spec.ts)).over(spec.whole_case())
    return df.withColumn(name, in_unit(micros_between(col(spec.ts), end), unit))


def duration(df: DataFrame, spec: LogSpec, unit: str = "m", hot=None) -> DataFrame:
    """T4: minutes since the previous event, named ``duration``."""
    return time_since_last(df, spec, unit, name="duration", hot=hot)


def event_nr(df: DataFrame, spec: LogSpec, name: str = "event_nr", hot=None) -> DataFrame:
    """T5: 1-based position of the event in its case."""
    if hot is not None:
        return _context(df, spec, hot).withColumn(name, F.col("_pos").cast("int")).drop("_pos", "_len")
    return df.withColumn(name, F.row_number().over(spec.window()))


def case_length(df: DataFrame, spec: LogSpec, name: str = "case_length", hot=None) -> DataFrame:
    """Number of events of the case."""
    if hot is not None:
        return _context(df, spec, hot).withColumn(name, F.col("_len")).drop("_pos", "_len")
    return df.withColumn(name, F.count(F.lit(1)).over(spec.whole_case()))


def calendar(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Month, weekday (0 = Monday) and hour of the event."""
    ts = col(spec.ts)
    return df.withColumns({"month": F.month(ts), "weekday": F.weekday(ts), "hour": F.hour(ts)})


def since_midnight(df: DataFrame, spec: LogSpec, name: str = "timesincemidnight") -> DataFrame:
    """Minutes since midnight."""
    ts = col(spec.ts)
    return df.withColumn(name, F.hour(ts) * 60 + F.minute(ts))


def activity_duration(df: DataFrame, start: str, end: str, unit: str = "m", name: str = "activity_duration") -> DataFrame:
    """``end - start`` of the same event in ``unit``; 0 when a bound is missing."""
    return df.withColumn(name, in_unit(F.coalesce(micros_between(col(start), col(end)), F.lit(0)), unit))


def standard_features(df: DataFrame, spec: LogSpec, unit: str = "m", hot=None) -> DataFrame:
    """T1, T2, T3, T5, T6, T7 in one pass (one exchange, one sort).  With ``hot``
    (``segmented.hot_cases``) large cases are processed in segments."""
    if hot is not None:
        from procmon.operators.segmented import case_context

        ts = col(spec.ts)
        x = case_context(df, spec, hot, lag=(spec.ts,), first=(spec.ts,), case_max=(spec.ts,))
        x = x.withColumns(
            {
                "timesincelastevent": in_unit(F.coalesce(micros_between(col(f"_lag_{spec.ts}"), ts), F.lit(0)), unit),
                "timesincecasestart": in_unit(micros_between(col(f"_first_{spec.ts}"), ts), unit),
                "remtime": in_unit(micros_between(ts, col(f"_max_{spec.ts}")), "s"),
                "event_nr": F.col("_pos").cast("int"),
                "case_length": F.col("_len"),
            }
        )
        x = x.drop("_pos", "_len", f"_lag_{spec.ts}", f"_first_{spec.ts}", f"_max_{spec.ts}")
        return calendar(x, spec)
    df = time_since_last(df, spec, unit)
    df = time_since_start(df, spec, unit)
    df = remaining_time(df, spec)
    df = event_nr(df, spec)
    df = case_length(df, spec)
    return calendar(df, spec)
