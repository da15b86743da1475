"""Typed readers and writers of event logs, targets, formulas, scores and parameters.

Schemas are always given (never inferred on the main path).  Timestamps are
``timestamp_ntz`` written and read with one explicit pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.functions.rules import RuleSet
from procmon.spec import LogSpec, col

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _csv_options(sep: str, header: bool = True) -> dict:
    return {"sep": sep, "header": str(header).lower(), "timestampNTZFormat": TS_FORMAT, "nullValue": "", "emptyValue": ""}


def read_log(spark: SparkSession, path: str, spec: LogSpec, sep: str = ";", fmt: str = "csv", ts_format: str | None = None, tiebreak_type=T.LongType()) -> DataFrame:
    """Event log with the spec's types (ids/categories string, numbers double, ts timestamp_ntz)."""
    schema = spec.to_struct(tiebreak_type)
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if ts_format is None:
        opts = _csv_options(sep)
        return spark.read.options(**opts).schema(schema).csv(path)
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name == spec.ts else f.dataType) for f in schema.fields])
    df = spark.read.options(**_csv_options(sep)).schema(raw).csv(path)
    return df.withColumn(spec.ts, F.to_timestamp_ntz(col(spec.ts), F.lit(ts_format)))


def write_log(df: DataFrame, path: str, sep: str = ";", fmt: str = "csv", mode: str = "overwrite") -> None:
    """S3: event log sink (``;``-separated CSV with header, or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.options(**_csv_options(sep)).csv(path)


def target_schema(spec: LogSpec, rs: RuleSet) -> T.StructType:
    fields = [T.StructField(spec.case, T.StringType())]
    fields += [T.StructField(a, T.DoubleType()) for a in rs.activities]
    fields += [T.StructField(g, T.IntegerType()) for g in rs.gateways]
    return T.StructType(fields)


def write_targets(targets: DataFrame, path: str, rs: RuleSet) -> None:
    """Target table in sink form (undefined = -1), comma-separated with header."""
    from procmon.operators.targets import label_defaults

    label_defaults(targets, rs).write.mode("overwrite").options(**_csv_options(",")).csv(path)


def read_targets(spark: SparkSession, path: str, spec: LogSpec, rs: RuleSet) -> DataFrame:
    """Target table back with NULL for undefined values."""
    from procmon.operators.targets import read_sink_targets

    df = spark.read.options(**_csv_options(",")).schema(target_schema(spec, rs)).csv(path)
    return read_sink_targets(df, rs)


def write_formulas(df: DataFrame, path: str) -> None:
    """Formula files as the external generator writes them: one headerless ``;`` file per prefix
    length, named ``test_len_<n>.xes_formula.csv`` (here: one folder per length)."""
    for_files = df.select("prefix_len", "case_id", "formula")
    for_files.write.mode("overwrite").partitionBy("prefix_len").options(**_csv_options(";", header=False)).csv(path)


def read_formulas(spark: SparkSession, pattern: str) -> DataFrame:
    """Headerless ``;`` formula files; the first two columns are case id and formula; the
    prefix length is taken from the path (``test_len_<n>`` or ``prefix_len=<n>``)."""
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("formula", T.StringType())])
    df = spark.read.options(**_csv_options(";", header=False)).schema(schema).csv(pattern)
    path = F.col("_metadata.file_path")
    n = F.coalesce(
        F.nullif(F.regexp_extract(path, r"test_len_(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"prefix_len=(\d+)", 1), F.lit("")),
    )
    return df.select("case_id", n.cast("int").alias("prefix_len"), "formula")


SCORE_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("cls", T.StringType()),
        T.StructField("nr_events", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("nr_cases", T.LongType()),
    ]
)


def read_scores(spark: SparkSession, pattern: str, sep: str = ",") -> DataFrame:
    """Many score CSVs at once (empty files contribute no rows); the file name
    ``validation_<method2>_<...>_<token>.csv`` adds ``file``, ``method2`` and ``token``."""
    df = spark.read.options(**_csv_options(sep)).schema(SCORE_SCHEMA).csv(pattern)
    # the result file's name (a folder of part files when written by Spark)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(validation_[^/]*)", 1)
    parts = F.split(F.regexp_replace(name, r"\.csv$", ""), "_")
    return df.select("*", name.alias("file"), F.element_at(parts, 2).alias("method2"), F.element_at(parts, -1).alias("token"))


def write_scores(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Score or detail tables partitioned by dataset and method."""
    w = df.write.mode("overwrite").partitionBy("dataset", "method")
    (w.parquet(path) if fmt == "parquet" else w.options(**_csv_options(";")).csv(path))


def write_prefix_logs(prefixes: DataFrame, path: str, sep: str = ";") -> None:
    """One folder per prefix length."""
    prefixes.write.mode("overwrite").partitionBy("prefix_len").options(**_csv_options(sep)).csv(path)


def read_running(spark: SparkSession, path: str, spec: LogSpec, stream: bool = False, tiebreak_type=T.LongType()):
    """Running-case events as JSON lines with the spec's schema (batch or stream)."""
    schema = spec.to_struct(tiebreak_type)
    opts = {"timestampNTZFormat": TS_FORMAT}
    if stream:
        return spark.readStream.options(**opts).schema(schema).json(path)
    return spark.read.options(**opts).schema(schema).json(path)


def write_running(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT).json(path)


def write_cv(df: DataFrame, path: str) -> None:
    """Search results are appended (one row per sample x prefix length x metric)."""
    df.write.mode("append").parquet(path)


def _by_key(entries, key: str):
    """Map entries sorted by their key field (stable document layout)."""
    return F.array_sort(entries, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def export_params(best: DataFrame, per_length: bool) -> DataFrame:
    """Nested parameter document ``label -> method -> cls -> [nr_events ->] params`` as one
    JSON string per label (``best``: label_col, method, cls, nr_events, and parameter columns)."""
    keys = {"label_col", "method", "cls", "nr_events"}
    pcols = [c for c in best.columns if c not in keys]
    params = F.struct(*[F.col(c) for c in pcols])
    if per_length:
        inner = best.groupBy("label_col", "method", "cls").agg(
            F.map_from_entries(_by_key(F.collect_list(F.struct(F.col("nr_events").cast("string").alias("k"), params.alias("p"))), "k")).alias("v")
        )
    else:
        inner = best.select("label_col", "method", "cls", params.alias("v"))
    leaf = F.col("v")
    # groups are parameter tables (methods x classifiers x prefix lengths): small by construction
    by_cls = inner.groupBy("label_col", "method").agg(F.map_from_entries(_by_key(F.collect_list(F.struct("cls", leaf.alias("v"))), "cls")).alias("v"))
    by_method = by_cls.groupBy("label_col").agg(F.map_from_entries(_by_key(F.collect_list(F.struct("method", "v")), "method")).alias("v"))
    return by_method.select("label_col", F.to_json("v").alias("params"))
