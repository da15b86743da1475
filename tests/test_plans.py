"""Physical plan checks."""

from conftest import SF_SMALL
from procmon.operators import encode as E
from procmon.operators import features as T
from procmon.operators import intercase as O
from procmon.plans.fixtures import EL1, el1


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _count(p: str, op: str) -> int:
    return p.count(op)


def test_time_feature_chain_shares_one_exchange(spark):
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumnRenamed("user_id", "case_id")
    spec = EL1.with_(case="case_id")
    p = plan(T.standard_features(df, spec))
    assert _count(p, "Exchange hashpartitioning(case_id") == 1, p
    assert "SinglePartition" not in p


def test_encoder_is_one_window_pass(spark):
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumnRenamed("user_id", "case_id").withColumnRenamed("event_type", "activity")
    spec = EL1.with_(case="case_id", static_cat=(), static_num=(), dynamic_cat=("activity",))
    vocab = E.Vocab({"activity": ("click", "error", "purchase", "signup", "view")})
    p = plan(E.encode(df, spec, vocab, "combined", 2, 5))
    assert _count(p, "Exchange") == 1, p


def test_open_cases_has_no_nested_loop_or_single_partition_window(spark):
    p = plan(O.open_cases(el1(spark, SF_SMALL), EL1))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    # the only window without a partition key runs over range totals, not over events
    p2 = plan(O.open_cases_sequential(el1(spark, SF_SMALL), EL1))
    assert "BroadcastNestedLoopJoin" not in p2 and "CartesianProduct" not in p2


def test_parquet_scan_prunes_columns(spark):
    df = T.time_since_last(el1(spark, SF_SMALL), EL1).select("case_id", "timesincelastevent")
    p = plan(df)
    scan = [line for line in p.splitlines() if "FileScan parquet" in line and "events" in line][0]
    assert "props" not in scan and "value" not in scan


def test_segmented_encoder_partitions_by_case_and_segment(spark):
    from procmon.operators.segmented import encode_segmented

    df = el1(spark, SF_SMALL)
    spec = EL1.with_(dynamic_cat=("activity",), static_cat=())
    vocab = E.Vocab({"activity": ("click", "error", "purchase", "signup", "view")})
    p = plan(encode_segmented(df, spec, vocab, "combined", 2, 5, max_rows=3))
    assert "hashpartitioning(case_id" in p and ", _seg" in p, p
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
