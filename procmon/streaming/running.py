"""Running-case scoring.

R1 encodes every running case up to its latest event and scores that row.
R2 keeps per-case running aggregates in a Structured Streaming aggregation:
counts, sums, sums of squares, extremes and level counts are algebraic, and
first / last values are ``min_by`` / ``max_by`` on ``(ts, tiebreak)`` so an
event that arrives late or out of order never overwrites a later one.  Each micro-batch's
updated rows go through ``foreachBatch`` to a table in the shared checkpoint
folder; the latest row per case is the current state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.operators import encode as E
from procmon.operators import models as M
from procmon.spec import LogSpec, col


def score_running(events: DataFrame, spec: LogSpec, vocab: E.Vocab, method: str, predict, bucket: str = "prefix", max_len: int | None = None) -> DataFrame:
    """One row per running case with its remaining-time prediction (rounded to 3 digits,
    never negative).  ``predict(prefixes) -> (case_id, prefix_len, predicted)``; cases in a
    bucket without a model get no score (NULL)."""
    enc = E.encode(events, spec, vocab, method, 1, None, max_events=max_len, strict=False)
    last = enc.where(F.col("prefix_len") == F.col("_case_len")).drop("_case_len")
    last = E.bucket_zero(last) if bucket == "zero" else E.bucket_prefix(last)
    pred = predict(last)
    pred = M.clip_negative(pred, "predicted")
    return pred.select(F.col("case_id"), F.col("prefix_len").alias("nr_events"), F.round("predicted", 3).alias("predicted"))


def state_aggregates(spec: LogSpec, vocab: E.Vocab) -> list[Column]:
    """Per-case running state; every aggregate is order-insensitive."""
    order = F.struct(col(spec.ts), col(spec.tiebreak))
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("n_events"),
        F.min_by(col(spec.activity), order).alias("first_activity"),
        F.max_by(col(spec.activity), order).alias("last_activity"),
        F.min(col(spec.ts)).alias("start_ts"),
        F.max(col(spec.ts)).alias("last_ts"),
    ]
    for c in spec.dynamic_num:
        x = col(c).cast("double")
        aggs += [
            F.count(x).alias(f"n_{c}"),
            F.sum(x).alias(f"sum_{c}"),
            F.sum(x * x).alias(f"sumsq_{c}"),
            F.avg(x).alias(f"mean_{c}"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"std_{c}"),
            F.min(x).alias(f"min_{c}"),
            F.max(x).alias(f"max_{c}"),
            F.max_by(x, F.when(x.isNotNull(), order)).alias(f"last_{c}"),
        ]
    for c in spec.dynamic_cat:
        for lv in vocab[c]:
            aggs.append(F.count(F.when(col(c) == F.lit(lv), F.lit(1))).alias(f"count_{c}_{lv}"))
    return aggs


def run_state_stream(spark: SparkSession, source: DataFrame, spec: LogSpec, vocab: E.Vocab, sink_path: str, checkpoint: str):
    """R2: start the per-case state aggregation over a streaming source; updated rows of every
    micro-batch are appended (with the batch id) to ``sink_path``.

    The state store keeps one row per case for the life of the query (the
    grouping key has no event-time column, so Spark does not evict it); it is
    checkpointed in ``checkpoint`` and recovered after a failure."""
    agg = source.groupBy(col(spec.case).alias(spec.case)).agg(*state_aggregates(spec, vocab))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_path)

    return (
        agg.writeStream.outputMode("update")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_state(spark: SparkSession, sink_path: str, spec: LogSpec) -> DataFrame:
    """Latest state row of every case in the sink table."""
    df = spark.read.parquet(sink_path)
    cols = [c for c in df.columns if c not in (spec.case, "batch_id")]
    best = df.groupBy(spec.case).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("batch_id")).alias("s"))
    return best.select(spec.case, *[F.col(f"s.{c}").alias(c) for c in cols])
