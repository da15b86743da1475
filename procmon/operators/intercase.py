"""Inter-case features: the number of cases open at an event.

Both are delta sweeps: +1 where a case opens, -1 where it closes, and a running
sum over the global time order (functions/prefix.py).  No event is compared
with every case, so the cost is a few passes instead of events x cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.functions.prefix import ordered_running_sum
from procmon.functions.time import epoch_micros
from procmon.spec import LogSpec, col


def open_cases(df: DataFrame, spec: LogSpec, name: str = "open_cases") -> DataFrame:
    """O1: cases with ``start <= ts < end`` at each event (ties at ``ts`` included).

    The +1 / -1 deltas are summed per distinct timestamp and placed before every
    event of their timestamp; one global running sum over the deltas and the
    events then gives each event its count, with no join back on the timestamp.
    Events of one timestamp are ordered by a hash of (case, tiebreak): their
    order does not change the count, and the uniform hash lets a timestamp
    shared by many events be split into even sub-ranges."""
    ts = col(spec.ts)
    bounds = df.groupBy(col(spec.case)).agg(F.min(ts).alias("_s"), F.max(ts).alias("_e"))
    edges = bounds.select(epoch_micros(F.col("_s")).alias("_k"), F.lit(1).alias("_d")).unionByName(
        bounds.select(epoch_micros(F.col("_e")).alias("_k"), F.lit(-1).alias("_d"))
    )
    # one row per distinct timestamp, ordered before all events of that timestamp
    first = -(2**63)
    per_ts = edges.groupBy("_k").agg(F.sum("_d").cast("long").alias("_d")).withColumn("_t", F.lit(first).cast("long"))
    order = F.shiftright(F.xxhash64(col(spec.case), col(spec.tiebreak)), 1)  # in [-2^62, 2^62): after the deltas
    events = df.withColumns({"_k": epoch_micros(ts), "_d": F.lit(0).cast("long"), "_t": order, "_ev": F.lit(True)})
    both = events.unionByName(per_ts, allowMissingColumns=True)
    run = ordered_running_sum(both, ["_k", "_t"], "_d", name, inclusive=True)
    return run.where(F.col("_ev")).drop("_k", "_d", "_t", "_ev")


def open_cases_sequential(df: DataFrame, spec: LogSpec, name: str = "open_cases", hot=None) -> DataFrame:
    """O2: open cases just before the event in log order ``(ts, tiebreak)``.

    A case opens at its first event and closes at its first event with
    ``ts = end``; cases whose events share one timestamp never open.
    """
    ts = col(spec.ts)
    if hot is not None:  # large cases: case window values segment by segment
        from procmon.operators.segmented import case_context

        df = case_context(df, spec, hot, lag=(spec.ts,), first=(spec.ts,), case_max=(spec.ts,))
        start, end = col(f"_first_{spec.ts}"), col(f"_max_{spec.ts}")
        first, prev = F.col("_pos") == 1, col(f"_lag_{spec.ts}")
    else:
        w, wc = spec.window(), spec.whole_case()
        start, end = F.min(ts).over(wc), F.max(ts).over(wc)
        first = F.row_number().over(w) == 1
        prev = F.lag(ts).over(w)
    closes = (ts == end) & (prev.isNull() | (prev < end))
    d = F.when(start < end, first.cast("int") - closes.cast("int")).otherwise(F.lit(0))
    x = df.withColumns({"_k0": epoch_micros(ts), "_d": d})
    out = ordered_running_sum(x, ["_k0", spec.tiebreak], "_d", name, inclusive=False)
    return out.drop("_k0", "_d", "_pos", "_len", f"_lag_{spec.ts}", f"_first_{spec.ts}", f"_max_{spec.ts}")
