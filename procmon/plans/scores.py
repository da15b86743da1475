"""Score fixtures: detail tables of three simple predictors (mean, median, zero) on EL1 and
EL2, in the schema of the reference's validation outputs (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.functions.select import grouped_median
from procmon.operators import flow as FL
from procmon.plans.fixtures import EL1, EL1_SQL, EL2, EL2_SQL, el1, el2, with_
from procmon.plans.registry import sql_unit

METHODS = ("mean", "median", "zero")


def _details(log: DataFrame, spec, dataset: str) -> DataFrame:
    cfg = FL.FlowConfig(bucket="prefix")
    log = log.select(spec.case, spec.activity, spec.ts, spec.tiebreak)  # the log is kept in memory: no other column is read
    _, train_p, test_p = FL.prepare(log, spec, cfg)
    train_p = train_p.select("bucket", "remtime").persist()
    means = train_p.groupBy("bucket").agg(F.avg("remtime").alias("mean"))
    medians = grouped_median(train_p, "bucket", "remtime", "median")
    whole = train_p.withColumn("bucket", F.lit(0))
    overall = {
        "m": whole.agg(F.avg("remtime")).first()[0],
        "md": grouped_median(whole, "bucket", "remtime", "median").first()["median"],
    }
    per_bucket = means.join(medians, "bucket")
    x = test_p.join(per_bucket, "bucket", "left")
    x = x.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    pred = (
        F.when(F.col("method") == "mean", F.coalesce("mean", F.lit(overall["m"])))
        .when(F.col("method") == "median", F.coalesce("median", F.lit(overall["md"])))
        .otherwise(F.lit(0.0))
    )
    return x.select(
        F.lit(dataset).alias("dataset"),
        "method",
        F.lit("none").alias("cls"),
        "case_id",
        F.col("prefix_len").alias("nr_events"),
        F.round(pred, 3).alias("predicted"),
        F.col("remtime").alias("actual"),
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(el1(spark, sf_dir), EL1, "EL1").unionByName(_details(el2(spark, sf_dir), EL2, "EL2"))


def _lg_sql(src: str, tb: str, dataset: str) -> str:
    return (
        f"SELECT '{dataset}' AS dataset, case_id, ts, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, {tb}) AS INTEGER) AS prefix_len, "
        f"count(*) OVER (PARTITION BY case_id) AS len, "
        + sql_unit("epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)", "s")
        + f" AS remtime FROM {src}"
    )


DETAILS_SQL = with_(
    EL1_SQL,
    EL2_SQL,
    f"lg AS ({_lg_sql('el1', 'event_id', 'EL1')} UNION ALL {_lg_sql('el2', 'order_key', 'EL2')})",
    "cs AS (SELECT dataset, case_id, min(ts) AS s FROM lg GROUP BY dataset, case_id)",
    "rk AS (SELECT dataset, case_id, row_number() OVER (PARTITION BY dataset ORDER BY s, case_id) AS rn, "
    "count(*) OVER (PARTITION BY dataset) AS n FROM cs)",
    f"pf AS (SELECT lg.*, rk.rn <= ceil(0.8 * rk.n) AS is_train FROM lg JOIN rk ON lg.dataset = rk.dataset AND lg.case_id = rk.case_id "
    f"WHERE prefix_len >= 2 AND prefix_len < len)",
    "bm AS (SELECT dataset, prefix_len, avg(remtime) AS mean_p, quantile_cont(remtime, 0.5) AS median_p FROM pf WHERE is_train GROUP BY dataset, prefix_len)",
    "ov AS (SELECT dataset, avg(remtime) AS mean_all, quantile_cont(remtime, 0.5) AS median_all FROM pf WHERE is_train GROUP BY dataset)",
    "details AS (SELECT pf.dataset, m.method, 'none' AS cls, pf.case_id, pf.prefix_len AS nr_events, "
    "round(CASE m.method WHEN 'mean' THEN coalesce(bm.mean_p, ov.mean_all) WHEN 'median' THEN coalesce(bm.median_p, ov.median_all) ELSE 0.0 END, 3) AS predicted, "
    "pf.remtime AS actual FROM pf JOIN ov ON pf.dataset = ov.dataset LEFT JOIN bm ON pf.dataset = bm.dataset AND pf.prefix_len = bm.prefix_len, "
    "(VALUES ('mean'), ('median'), ('zero')) m(method) WHERE NOT pf.is_train)",
)
