"""Implicit prefix logs (D5, D6, D10, L10, S8): every event with the range of prefixes that hold it.

The prefix of length ``n`` of a case is its first ``n`` events, so event ``_nr`` lies in the prefixes
``_from .. _to`` with ``_from = max(min_len, _nr)`` and ``_to = min(max_len, case length - 1)``.  A log of ranges has a row an
event, not one for each event of each prefix, and it alone is shuffled (once, by case).  Lengths, sizes and labels
of prefixes are read from it as it is; ``expand`` writes the prefixes out at the sink, after the last shuffle.

Cases without a prefix have no rows.  Events without a case id form one case, as elsewhere.
With ``hot`` (``segmented.hot_cases``) large cases are numbered and labelled segment by segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmon.operators.segmented import _join_carry, case_context, with_segments
from procmon.operators.split import temporal_split
from procmon.spec import LogSpec, col


def ranges(df: DataFrame, spec: LogSpec, min_len: int = 1, max_len: int | None = None, hot=None) -> DataFrame:
    """D5, implicit: the events with ``_nr`` (position in the case) and ``_from``, ``_to`` (prefixes that hold it)."""
    if hot is not None:
        x = case_context(df, spec, hot).withColumnRenamed("_pos", "_nr")
    else:
        x = df.withColumns({"_nr": F.row_number().over(spec.window()), "_len": F.count(F.lit(1)).over(spec.whole_case())})
    to = F.col("_len") - 1 if max_len is None else F.least(F.lit(max_len), F.col("_len") - 1)
    x = x.withColumns({"_nr": F.col("_nr").cast("int"), "_from": F.greatest(F.lit(min_len), F.col("_nr")).cast("int"), "_to": to.cast("int")})
    return x.where("_from <= _to").drop("_len")


def expand(log: DataFrame, key: str = "prefix_len") -> DataFrame:
    """The explicit prefix log, without a shuffle: as ``split.prefix_log``."""
    out = log.withColumn(key, F.explode(F.sequence("_from", "_to")))
    return out.withColumn("case_length", F.col(key)).drop("_nr", "_from", "_to")


def of_length(log: DataFrame, n: int, key: str = "prefix_len") -> DataFrame:
    """The prefixes of exactly ``n`` events, by a filter on the ranges."""
    return log.where((F.col("_from") <= n) & (F.col("_to") >= n)).withColumn(key, F.lit(n)).drop("_nr", "_from", "_to")


def ends(log: DataFrame) -> DataFrame:
    """The last event of every prefix: one row a prefix, whose length is ``_nr``."""
    return log.where("_from = _nr")


def sizes(log: DataFrame, spec: LogSpec, key: str = "prefix_len") -> DataFrame:
    """The number of prefixes of each length (of cases with an id), counted at their last events."""
    return ends(log).groupBy(F.col("_nr").alias(key)).agg(F.count(col(spec.case)).alias("n_prefixes")).where("n_prefixes > 0")


def labels(log: DataFrame, spec: LogSpec, label: str, mode: str = "regr", key: str = "prefix_len", hot=None) -> DataFrame:
    """The label of each prefix as a running value: the minimum so far (regression), or the first event's value."""
    if hot is None:
        running = (F.min(col(label)) if mode == "regr" else F.first(col(label))).over(spec.running())
        return ends(log.withColumn("_label", running)).select(col(spec.case), F.col("_nr").alias(key), F.col("_label").alias(label))
    x = with_segments(log, spec, hot)
    order = F.struct(col(spec.ts), col(spec.tiebreak))
    parts = x.groupBy(col(spec.case).alias(spec.case), "_seg").agg(F.min(col(label)).alias("_low"), F.min_by(F.struct(col(label).alias("v")), order).alias("_head"))
    segments = Window.partitionBy(col(spec.case)).orderBy("_seg")  # a row a segment
    carry = parts.select(
        col(spec.case).alias(spec.case),
        "_seg",
        F.min("_low").over(segments.rowsBetween(Window.unboundedPreceding, -1)).alias("_low"),
        F.first("_head").over(segments).alias("_head"),
    )
    y = _join_carry(x, spec, carry)
    within = Window.partitionBy(col(spec.case), "_seg").orderBy(col(spec.ts), col(spec.tiebreak)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.least(F.min(col(label)).over(within), F.col("_low")) if mode == "regr" else F.col("_head.v")
    return ends(y.withColumn("_label", value)).select(col(spec.case), F.col("_nr").alias(key), F.col("_label").alias(label))


def partial_traces(df: DataFrame, spec: LogSpec, ratio: float = 0.8, min_len: int = 2, max_len: int | None = 20, hot=None) -> DataFrame:
    """D6, implicit: the ranges of the test cases of a temporal split."""
    _, test = temporal_split(df, spec, ratio, hot=hot)
    return ranges(test, spec, min_len, max_len, hot)
