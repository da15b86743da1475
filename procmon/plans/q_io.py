"""Round trips through the readers and writers (S1–S11), in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.operators import prefixes as P
from procmon.operators import split as D
from procmon.operators import targets as L
from procmon.operators import report as V
from procmon.plans.fixtures import EL1, EL1_SQL, EL2, EL2_SQL, el1, el2, with_
from procmon.plans.formulas import EL1_FORMULAS
from procmon.plans.registry import ORACLE, register
from procmon.plans.rulesets import EL1_RULES, EL1_TARGETS_SQL
from procmon.plans.scores import DETAILS_SQL, details
from procmon.session import scratch_path
from procmon.sources import io as S
from procmon.sources import results as RES
from procmon.spec import LogSpec

_EL1_COLS = "case_id, activity, ts, event_id, k, segment, nation, value, acctbal"


@register("s1_read_log", with_(EL1_SQL) + f"SELECT {_EL1_COLS} FROM el1")
def s1(spark, d):
    path = scratch_path(spark, "s1")
    S.write_log(el1(spark, d).select(*[f.name for f in EL1.to_struct().fields]), path)
    return S.read_log(spark, path, EL1)


_RAW = LogSpec(case="user_id", activity="event_type", ts="ts", tiebreak="event_id", dynamic_cat=("props",), dynamic_num=("value",))


@register(
    "s1b_read_log_parquet",
    "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, ts, event_id, props, value FROM events",
)
def s1b(spark, d):
    return S.read_log(spark, f"{d}/events.parquet", _RAW, fmt="parquet")


@register("s3_write_log", with_(EL2_SQL) + "SELECT case_id, activity, ts, order_key, status, segment, nation, price, acctbal FROM el2")
def s3(spark, d):
    path = scratch_path(spark, "s3")
    S.write_log(el2(spark, d).select(*[f.name for f in EL2.to_struct().fields]), path, sep=";")
    return S.read_log(spark, path, EL2, sep=";")


@register("s4_targets_roundtrip", with_(EL1_SQL, EL1_TARGETS_SQL) + "SELECT case_id, click, view, purchase, signup, error, x1, x2, x3, coalesce(x4, 0) AS x4 FROM tg")
def s4(spark, d):
    path = scratch_path(spark, "s4")
    S.write_targets(L.build_targets(el1(spark, d), EL1, EL1_RULES), path, EL1_RULES)
    return S.read_targets(spark, path, EL1, EL1_RULES)


_FORMULA_SQL = (
    "pf AS (SELECT case_id, activity, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS INTEGER) AS prefix_len, "
    "count(*) OVER (PARTITION BY case_id) AS len FROM el1)"
)
_FCASE = "CASE activity " + " ".join(f"WHEN '{a}' THEN '{f}'" for a, f in EL1_FORMULAS.items()) + " END"


@register(
    "s5_read_formulas",
    with_(EL1_SQL, _FORMULA_SQL) + f"SELECT case_id, prefix_len, {_FCASE} AS formula FROM pf WHERE prefix_len >= 2 AND prefix_len < len",
)
def s5(spark, d):
    from procmon.operators import encode as E
    from procmon.plans.formulas import el1_formulas

    pref = E.encode(el1(spark, d), EL1, E.Vocab({}), "none", 2, None, keep=("activity",))
    path = scratch_path(spark, "s5")
    S.write_formulas(el1_formulas(pref), path)
    return S.read_formulas(spark, f"{path}/*/*.csv")


_SC = DETAILS_SQL + """, sc AS (
  SELECT dataset, method, cls, nr_events, count(*) AS nr_cases, avg(abs(predicted - actual)) AS mae,
         sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse
  FROM details GROUP BY dataset, method, cls, nr_events),
scores AS (
  SELECT dataset, method, cls, nr_events, 'mae' AS metric, CASE WHEN nr_cases >= 2 THEN mae END AS score, nr_cases FROM sc
  UNION ALL
  SELECT dataset, method, cls, nr_events, 'rmse' AS metric, CASE WHEN nr_cases >= 2 THEN rmse END AS score, nr_cases FROM sc)"""
_TOKENS = {"mean": "3000000", "median": "30", "zero": "sqrt"}


@register(
    "s6_read_scores",
    _SC
    + " SELECT dataset, method, cls, nr_events, metric, round(score, 4) AS score, nr_cases, "
    "'validation_FA_' || dataset || '_prefix_' || method || '_' || CASE method "
    + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in _TOKENS.items())
    + " END || '.csv' AS file, 'FA' AS method2, CASE method "
    + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in _TOKENS.items())
    + " END AS token FROM scores",
)
def s6(spark, d):
    scores = V.score_table(details(spark, d)).withColumn("score", F.round("score", 4)).persist()
    base = scratch_path(spark, "s6")
    groups = scores.select("dataset", "method").distinct().collect()  # result files: datasets x methods
    for g in groups:
        part = scores.where((F.col("dataset") == g["dataset"]) & (F.col("method") == g["method"]))
        name = f"validation_FA_{g['dataset']}_prefix_{g['method']}_{_TOKENS[g['method']]}.csv"
        part.coalesce(1).write.mode("overwrite").options(header="true").csv(f"{base}/{name}")
    # an empty result file contributes no rows
    scores.limit(0).write.mode("overwrite").options(header="true").csv(f"{base}/validation_FA_empty_prefix_none_30.csv")
    out = S.read_scores(spark, f"{base}/validation_*/*.csv")
    return out.drop("_metadata") if "_metadata" in out.columns else out


@register("s7_write_scores", DETAILS_SQL + " SELECT dataset, method, cls, case_id, nr_events, predicted, actual FROM details")
def s7(spark, d):
    path = scratch_path(spark, "s7")
    S.write_scores(details(spark, d), path)
    back = spark.read.parquet(path)
    return back.select("dataset", "method", "cls", "case_id", F.col("nr_events").cast("int"), "predicted", "actual")


@register("s7b_result_table", DETAILS_SQL + " SELECT dataset, method, cls, case_id, nr_events, predicted, actual, dataset || '/' || method AS run FROM details")
def s7b(spark, d):
    """Details as committed runs, one for each dataset and method, among a writer that died, a retry and a second attempt."""
    rows, path = details(spark, d).withColumn("nr_events", F.col("nr_events").cast("int")), scratch_path(spark, "s7b")
    rows.write.parquet(f"{path}/all")
    rows = spark.read.parquet(f"{path}/all").select("dataset", "method", "cls", "case_id", "nr_events", "predicted", "actual")
    table = f"{path}/table"
    for g in rows.select("dataset", "method").distinct().collect():  # datasets x methods
        part, run = rows.where((F.col("dataset") == g["dataset"]) & (F.col("method") == g["method"])), f"{g['dataset']}/{g['method']}"
        RES.stage(part, table, ["method"])
        attempt = RES.stage(part, table)
        RES.write(part, table, run, partition_by=["dataset", "method"])
        RES.commit(spark, table, run, attempt)
        RES.write(part, table, run)
    return RES.read(spark, table, "run")


@register(
    "s8_write_prefix_logs",
    with_(EL1_SQL, _FORMULA_SQL.replace("SELECT case_id, activity,", "SELECT case_id, event_id,"))
    + ", x AS (SELECT case_id, event_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS INTEGER) AS nr, "
    "count(*) OVER (PARTITION BY case_id) AS len FROM el1) "
    "SELECT case_id, event_id, CAST(p AS INTEGER) AS prefix_len FROM x, range(2, (SELECT max(len) FROM x)) t(p) WHERE p >= nr AND p < len",
)
def s8(spark, d):
    path = scratch_path(spark, "s8")
    S.write_prefix_logs(D.prefix_log(el1(spark, d), EL1, 2).select("case_id", "event_id", "prefix_len"), path)
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("event_id", T.LongType())])
    back = spark.read.options(sep=";", header="true").schema(schema).csv(path)
    return back.select("case_id", "event_id", F.col("prefix_len").cast("int"))


@register("s8b_write_prefix_ranges", ORACLE["s8_write_prefix_logs"])
def s8b(spark, d):
    path = scratch_path(spark, "s8b")
    S.write_prefix_logs(P.expand(P.ranges(el1(spark, d), EL1, 2)).select("case_id", "event_id", "prefix_len"), path)
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("event_id", T.LongType())])
    back = spark.read.options(sep=";", header="true").schema(schema).csv(path)
    return back.select("case_id", "event_id", F.col("prefix_len").cast("int"))


@register("s9_read_running", with_(EL1_SQL) + f"SELECT {_EL1_COLS} FROM el1")
def s9(spark, d):
    path = scratch_path(spark, "s9")
    S.write_running(el1(spark, d).select(*[f.name for f in EL1.to_struct().fields]), path)
    return S.read_running(spark, path, EL1)


_CV_SQL = _SC + (
    ", cv AS (SELECT 'remtime' AS label_col, 'prefix_index' AS method, 'xgb' AS cls, method AS predictor, "
    "CASE method WHEN 'mean' THEN 1 WHEN 'median' THEN 2 ELSE 3 END AS param_id, nr_events, metric, score "
    "FROM scores WHERE metric = 'mae')"
)


def cv_table(spark, d):
    """A deterministic CV table: the fixture predictors as parameter sets, the two logs as folds."""
    s = V.score_table(details(spark, d)).where(F.col("metric") == "mae")
    pid = F.when(F.col("method") == "mean", 1).when(F.col("method") == "median", 2).otherwise(3)
    return s.select(
        F.lit("remtime").alias("label_col"), F.lit("prefix_index").alias("method"), F.lit("xgb").alias("cls"),
        F.col("method").alias("predictor"), pid.alias("param_id"), "nr_events", "metric", "score",
    )


@register(
    "s10_write_cv",
    _CV_SQL + " SELECT label_col, method, cls, predictor, param_id, nr_events, metric, round(score, 4) AS score FROM cv "
    "UNION ALL SELECT label_col, method, cls, predictor, param_id, nr_events, metric, round(score, 4) FROM cv",
)
def s10(spark, d):
    path = scratch_path(spark, "s10")
    cv = cv_table(spark, d).withColumn("score", F.round("score", 4))
    S.write_cv(cv, path)
    S.write_cv(cv, path)  # a second search run appends
    return spark.read.parquet(path)


_BEST_SQL = _CV_SQL + (
    ", ag AS (SELECT cls, label_col, method, metric, nr_events, predictor, param_id, avg(score) AS score FROM cv WHERE score IS NOT NULL "
    "GROUP BY ALL), bt AS (SELECT *, row_number() OVER (PARTITION BY cls, label_col, method, metric, nr_events "
    "ORDER BY score, predictor, param_id) AS r FROM ag)"
)


@register(
    "s11_export_params",
    _BEST_SQL + " SELECT label_col, method, cls, CAST(nr_events AS VARCHAR) AS nr_events, predictor, param_id FROM bt WHERE r = 1",
)
def s11(spark, d):
    from procmon.operators.search import best_params

    best = best_params(cv_table(spark, d), per_length=True).drop("score", "metric")
    doc = S.export_params(best, per_length=True)
    # read the nested document back into rows
    t = "map<string,map<string,map<string,struct<predictor:string,param_id:int>>>>"
    m = doc.select("label_col", F.from_json("params", t).alias("m"))
    m = m.select("label_col", F.explode("m").alias("method", "m2")).select("label_col", "method", F.explode("m2").alias("cls", "m3"))
    m = m.select("label_col", "method", "cls", F.explode("m3").alias("nr_events", "p"))
    return m.select("label_col", "method", "cls", "nr_events", "p.predictor", "p.param_id")
