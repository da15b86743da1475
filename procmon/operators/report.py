"""Metrics and reporting.

Inputs are the detail table ``(dataset, method, cls, case_id, nr_events,
predicted, actual)`` and the score table ``(dataset, method, cls, nr_events,
metric, score, nr_cases)``.  Everything is grouped aggregation and windows
over small per-method tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.functions.time import micros_between
from procmon.spec import LogSpec, col

DAY = 86_400.0
GROUP = ("dataset", "method", "cls")


def mae(details: DataFrame, by=(*GROUP, "nr_events")) -> DataFrame:
    """V1."""
    return details.groupBy(*by).agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))


def rmse(details: DataFrame, by=(*GROUP, "nr_events")) -> DataFrame:
    """V2."""
    err = F.col("predicted") - F.col("actual")
    return details.groupBy(*by).agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def log_loss(df: DataFrame, label: str, exits, by=("nr_events",), eps: float = 1e-15) -> DataFrame:
    """V3: multi-class log loss of ``p_{label}_{c}`` columns against the true class."""
    classes = range(exits) if isinstance(exits, int) else exits
    p_true = F.coalesce(*[F.when(F.col(label).cast("int") == c, F.col(f"p_{label}_{c}")) for c in classes], F.lit(0.0))
    p = F.least(F.greatest(p_true, F.lit(eps)), F.lit(1 - eps))
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        (-F.avg(F.log(p))).alias("log_loss"), F.count(F.lit(1)).alias("nr_cases")
    )


def guard_small(score: Column, n: Column, min_rows: int = 2) -> Column:
    """V4: a score over fewer than ``min_rows`` rows is undefined (Q17)."""
    return F.when(n >= min_rows, score)


def score_table(details: DataFrame, by=GROUP) -> DataFrame:
    """V5: MAE and RMSE per prefix length in long format with ``nr_cases``."""
    err = F.col("predicted") - F.col("actual")
    wide = details.groupBy(*by, "nr_events").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("nr_cases")
    )
    long = wide.select(
        *by, "nr_events", "nr_cases", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in ("mae", "rmse")])).alias("m")
    )
    return long.select(*by, "nr_events", "m.metric", guard_small(F.col("m.score"), F.col("nr_cases")).alias("score"), "nr_cases")


def _mae_rows(scores: DataFrame, max_n: int | None) -> DataFrame:
    s = scores.where((F.col("metric") == "mae") & F.col("score").isNotNull())
    return s.where(F.col("nr_events") < max_n) if max_n is not None else s


def weighted_mae(scores: DataFrame, max_n: int | None = 11, by=("dataset", "method")) -> DataFrame:
    """V6: MAE weighted by ``nr_cases`` over prefix lengths ``< max_n``, in days."""
    s = _mae_rows(scores, max_n)
    return s.groupBy(*by).agg((F.sum(F.col("score") * F.col("nr_cases")) / F.sum("nr_cases") / DAY).alias("weighted_mae_days"))


def unweighted_mae(scores: DataFrame, max_n: int | None = 11, by=("dataset", "method")) -> DataFrame:
    """V7: plain mean of the per-length MAE, in days."""
    return _mae_rows(scores, max_n).groupBy(*by).agg((F.avg("score") / DAY).alias("unweighted_mae_days"))


def mae_std(scores: DataFrame, max_n: int | None = 11, by=("dataset", "method")) -> DataFrame:
    """V8: standard deviation of the per-length MAE (days), next to V6."""
    sd = _mae_rows(scores, max_n).groupBy(*by).agg((F.stddev_samp("score") / DAY).alias("std_days"))
    return weighted_mae(scores, max_n, by).join(sd, list(by))


def rank_methods(agg: DataFrame, value: str = "weighted_mae_days") -> DataFrame:
    """V9: rank of each method inside its dataset (ties share the lowest rank)."""
    return agg.withColumn("rank", F.rank().over(Window.partitionBy("dataset").orderBy(F.col(value).asc())))


def mean_rank(ranked: DataFrame) -> DataFrame:
    """Mean and standard deviation of the rank of each method."""
    return ranked.groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank"))


def _total(micros: str) -> Column:
    """The sum of a column of microseconds, exact and without the limit of a long (100,000 cases of three years pass it)."""
    return F.sum(F.col(micros).cast("decimal(19,0)")).cast("double")


def case_duration_days(df: DataFrame, spec: LogSpec, dataset: str) -> DataFrame:
    """Mean case duration of a log in days (input of V11)."""
    d = df.groupBy(col(spec.case)).agg(micros_between(F.min(col(spec.ts)), F.max(col(spec.ts))).alias("_us"))
    return d.agg((_total("_us") / F.count(F.lit(1)) / F.lit(DAY * 1e6)).alias("case_duration_days")).withColumn(
        "dataset", F.lit(dataset)
    )


def normalised_mae(agg: DataFrame, durations: DataFrame) -> DataFrame:
    """Weighted MAE and its sd divided by the dataset's mean case duration, then mean and
    sd per method.  ``durations`` has one row per dataset."""
    x = agg.join(durations, "dataset")
    x = x.withColumns({"norm_mae": F.col("weighted_mae_days") / F.col("case_duration_days"), "norm_std": F.col("std_days") / F.col("case_duration_days")})
    return x.groupBy("method").agg(
        F.avg("norm_mae").alias("mean_norm_mae"), F.stddev_samp("norm_mae").alias("std_norm_mae"), F.avg("norm_std").alias("mean_norm_std")
    )


def stability(details: DataFrame, by=GROUP) -> DataFrame:
    """Per case the mean of ``|error_n - error_{n-1}| * n`` over consecutive prefixes (days),
    then its mean and sd per method (Q16: each difference weighted by the later length)."""
    w = Window.partitionBy(*by, "case_id").orderBy("nr_events")
    e = (F.col("predicted") - F.col("actual")) / DAY
    x = details.withColumn("_e", e).withColumn("_d", F.abs(F.col("_e") - F.lag("_e").over(w)) * F.col("nr_events"))
    per_case = x.groupBy(*by, "case_id").agg(F.avg("_d").alias("instability")).where(F.col("instability").isNotNull())
    return per_case.groupBy(*by).agg(F.avg("instability").alias("mean_std"), F.stddev_samp("instability").alias("std_std"))


def strip_suffix(c: Column) -> Column:
    """``case_7`` -> ``case`` (prefix ids of the reference's files)."""
    return F.regexp_replace(c, r"_\d+$", "")


def label_methods(scores: DataFrame, lookup: DataFrame) -> DataFrame:
    """Readable method names from file-name tokens through a lookup table
    ``(lm2, ltoken, label)``; ``lm2 = '*'`` matches any ``method2``, joined on the token."""
    cond = (F.col("ltoken") == F.col("token")) & ((F.col("lm2") == F.col("method2")) | (F.col("lm2") == "*"))
    x = scores.join(lookup, cond, how="left")
    return x.withColumn("method_label", F.coalesce(F.col("label"), F.col("token"))).drop("label", "lm2", "ltoken")


def unpivot_errors(wide: DataFrame, prefix: str, lengths, ms: bool = True, by=()) -> DataFrame:
    """Per-length error columns ``{prefix}{n}`` of a wide table -> score rows: mean error
    ignoring nulls (ms -> s) and the number of non-negative errors, for each length and ``by`` group."""
    names = [f"{prefix}{n}" for n in lengths]
    long = wide.select(
        *by, F.explode(F.array(*[F.struct(F.lit(n).alias("nr_events"), F.col(c).alias("err")) for n, c in zip(lengths, names)])).alias("x")
    ).select(*by, "x.nr_events", "x.err")
    scale = 1000.0 if ms else 1.0
    return long.groupBy(*by, "nr_events").agg(
        (F.avg("err") / scale).alias("score"), F.count(F.when(F.col("err") >= 0, F.lit(1))).alias("nr_cases")
    )


def activity_diagnostics(pred: DataFrame, mean_pred: DataFrame, targets: DataFrame, activities, id_cols=("case_id", "prefix_len")) -> DataFrame:
    """Per activity and prefix length, MAE of the predicted cycle time, MAE of the mean model
    and the mean actual cycle time, over prefixes whose target is defined; long format."""

    def melt(df, tag):
        arr = F.array(*[F.struct(F.lit(a).alias("activity"), F.col(f"t_{a}").alias(tag)) for a in activities])
        return df.select(*id_cols, F.explode(arr).alias("x")).select(*id_cols, "x.activity", f"x.{tag}")

    tgt = targets.select(
        "case_id", F.explode(F.array(*[F.struct(F.lit(a).alias("activity"), F.col(a).alias("actual")) for a in activities])).alias("x")
    ).select("case_id", "x.activity", "x.actual")
    x = melt(pred, "pred").join(melt(mean_pred, "mean"), [*id_cols, "activity"]).join(tgt, ["case_id", "activity"])
    x = x.where(F.col("actual").isNotNull())
    agg = x.groupBy("activity", id_cols[1]).agg(
        F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("pred_MAE"),
        F.avg(F.abs(F.col("mean") - F.col("actual"))).alias("pred_mean"),
        F.avg("actual").alias("mean_CT"),
    )
    arr = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).alias("value")) for v in ("pred_MAE", "pred_mean", "mean_CT")])
    return agg.select("activity", F.col(id_cols[1]).alias("prefix_length"), F.explode(arr).alias("x")).select(
        "activity", "prefix_length", "x.var", "x.value"
    )


def log_quality(df: DataFrame, spec: LogSpec, name: str, cutoffs=(5, 20), since_start: str = "timesincecasestart", hot=None) -> DataFrame:
    """Mean per-case share of unique timestamps, global share, and for each cutoff the cases
    reaching it and those of them whose elapsed time is still 0.  ``hot`` cases
    (``segmented.hot_cases``) are numbered segment by segment."""
    if hot is not None:
        from procmon.operators.segmented import case_context

        x = case_context(df, spec, hot).withColumnRenamed("_pos", "_nr").drop("_len")
    else:
        x = df.withColumn("_nr", F.row_number().over(spec.window()))
    per_case = x.groupBy(col(spec.case)).agg(
        (F.count_distinct(col(spec.ts)) / F.count(F.lit(1))).alias("_utr"),
        *[F.max(F.when(F.col("_nr") == c, F.lit(1))).alias(f"_r{c}") for c in cutoffs],
        *[F.max(F.when((F.col("_nr") == c) & (F.col(since_start) == 0), F.lit(1))).alias(f"_z{c}") for c in cutoffs],
    )
    share = df.agg((F.count_distinct(col(spec.ts)) / F.count(col(spec.ts))).alias("s")).first()["s"]
    out = per_case.agg(
        F.avg("_utr").alias("avg_unique_timestamp_per_trace"),
        *[F.count(F.col(f"_r{c}")).alias(f"cases_longer_{c}") for c in cutoffs],
        *[F.count(F.col(f"_z{c}")).alias(f"timestamp_0_after_{c}") for c in cutoffs],
    )
    return out.select(F.lit(name).alias("log"), "*", F.lit(share).cast("double").alias("avg_unique_timestamp_global"))


def log_statistics(df: DataFrame, spec: LogSpec, name: str) -> DataFrame:
    """Cases, activities, events, mean / max events per case, median / mean duration (days)."""
    from procmon.functions.select import exact_quantile

    per_case = df.groupBy(col(spec.case)).agg(
        F.count(F.lit(1)).alias("n"), micros_between(F.min(col(spec.ts)), F.max(col(spec.ts))).alias("us")
    )
    per_case = per_case.withColumn("days", F.col("us") / F.lit(DAY * 1e6))
    median = exact_quantile(per_case, "days", 0.5)
    stats = per_case.agg(
        F.count(F.lit(1)).alias("nr_cases"),
        F.sum("n").alias("nr_events"),
        (F.sum("n") / F.count(F.lit(1))).alias("mean_events_per_case"),
        F.max("n").alias("max_events_per_case"),
        (_total("us") / F.count(F.lit(1)) / F.lit(DAY * 1e6)).alias("mean_case_duration_days"),
    )
    n_acts = df.agg(F.count_distinct(col(spec.activity))).first()[0]
    return stats.withColumn("nr_activities", F.lit(n_acts).cast("long")).select(
        F.lit(name).alias("log"), "nr_cases", "nr_activities", "nr_events", "mean_events_per_case", "max_events_per_case",
        F.lit(median).cast("double").alias("median_case_duration_days"), "mean_case_duration_days",
    )


def drop_incomplete(df: DataFrame, warn: float = 0.01):
    """Rows without nulls, and whether more than ``warn`` of the rows were dropped."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(f"`{c}`").isNotNull()
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(complete, F.lit(1))).alias("k")).first()
    dropped = counts["n"] - counts["k"]
    warning = counts["k"] > 0 and dropped / counts["k"] > warn
    return df.where(complete), warning
