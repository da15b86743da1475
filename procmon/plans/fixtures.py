"""Event logs derived from the driver tables (FIXTURES.md part B).

Each fixture exists twice: as a Spark DataFrame and as a SQL common table
expression that DuckDB evaluates on the same Parquet files.  The fixtures only
give rows the schema of an event log; every query then runs the library's
operators on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.spec import LogSpec

# EL1: `events` by user and day, static attributes from `customer`.
EL1 = LogSpec(
    case="case_id",
    activity="activity",
    ts="ts",
    tiebreak="event_id",
    static_cat=("segment", "nation"),
    static_num=("acctbal",),
    dynamic_cat=("activity", "k"),
    dynamic_num=("value",),
)
# EL1 with blanked values (null handling): value_n null on `error`, segment_n null on the first event.
EL1N = EL1.with_(static_cat=("segment_n", "nation"), dynamic_num=("value_n",))
# EL1u: `events` by user only (long cases).
EL1U = EL1.with_(case="user_case")
# EL2: `orders` by customer (timestamp ties inside cases).
EL2 = LogSpec(
    case="case_id",
    activity="activity",
    ts="ts",
    tiebreak="order_key",
    static_cat=("segment", "nation"),
    static_num=("acctbal",),
    dynamic_cat=("activity", "status"),
    dynamic_num=("price",),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def el1(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    df = ev.join(cu, ev.user_id == cu.c_custkey).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("case_id"),
        F.col("user_id").cast("string").alias("user_case"),
        F.col("event_type").alias("activity"),
        "ts",
        "event_id",
        "value",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_acctbal").alias("acctbal"),
    )
    if nulls:
        df = df.select(
            "*",
            F.when(F.col("activity") != "error", F.col("value")).alias("value_n"),
            F.when(F.row_number().over(EL1.window()) > 1, F.col("segment")).alias("segment_n"),
        )
    return df


def el2(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return o.join(cu, o.o_custkey == cu.c_custkey).select(
        F.col("o_custkey").cast("string").alias("case_id"),
        F.regexp_replace("o_orderpriority", r"\s+", "_").alias("activity"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_acctbal").alias("acctbal"),
    )


# --- the same fixtures as DuckDB SQL ---------------------------------------

EL1_SQL = """el1 AS (
  SELECT CAST(e.user_id AS VARCHAR) || '-' || strftime(e.ts, '%Y%m%d') AS case_id,
         CAST(e.user_id AS VARCHAR) AS user_case,
         e.event_type AS activity, e.ts, e.event_id, e.value,
         json_extract_string(e.props, '$.k') AS k,
         c.c_mktsegment AS segment, CAST(c.c_nationkey AS VARCHAR) AS nation, c.c_acctbal AS acctbal
  FROM events e JOIN customer c ON e.user_id = c.c_custkey)"""

EL1N_SQL = EL1_SQL + """,
el1n AS (
  SELECT *, CASE WHEN activity <> 'error' THEN value END AS value_n,
         CASE WHEN row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) > 1 THEN segment END AS segment_n
  FROM el1)"""

EL2_SQL = """el2 AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS case_id,
         regexp_replace(o.o_orderpriority, '\\s+', '_', 'g') AS activity,
         o.o_orderdate AS ts, o.o_orderkey AS order_key, o.o_totalprice AS price, o.o_orderstatus AS status,
         c.c_mktsegment AS segment, CAST(c.c_nationkey AS VARCHAR) AS nation, c.c_acctbal AS acctbal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def with_(*ctes: str) -> str:
    """``WITH`` clause from CTE bodies (the fixture CTEs plus query-specific ones)."""
    return "WITH " + ",\n".join(ctes) + "\n"
