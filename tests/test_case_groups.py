"""Case states in groups: what a stream gives out does not depend on how its cases are dealt."""

import pytest
from pyspark.sql import functions as F

from procmon.operators import encode as E
from procmon.session import scratch_path
from procmon.spec import LogSpec
from procmon.streaming import cases as C

SPEC = LogSpec(case="c", activity="a", ts="t", tiebreak="e", dynamic_cat=("a",), dynamic_num=("x",), static_cat=("w",))
DAY = 86_400_000
FIELDS = "c string, a string, e long, x double, w string, t string"


def event(c, day, e, hour=10):
    return (c, "uv"[e % 2], e, None if e % 3 == 0 else e / 7, f"{c}\t\n\"é", f"2024-01-{day:02d} {hour:02d}:00:00")


# "a" expires while its group gets other events, "b" and None go on, "d" expires by its group's timer, "late" comes too late
BATCHES = [
    [event("a", 1, 1), event("b", 1, 2), event("b", 1, 3, 9), event(None, 1, 4), *(event(f"x{i}", 2, 10 + i) for i in range(40))],
    [event("b", 4, 50), event(None, 4, 51), event("d", 5, 52)],
    [event("late", 1, 60), event("b", 6, 61), event("a", 7, 62)],
    [event("z", 25, 70)],
]


def streamed(spark, name):
    """Every state that the stream gives out, and the rows in the state store after each batch."""
    src, ckpt = (scratch_path(spark, f"{name}-{n}") for n in ("src", "ckpt"))
    out, kept = [], []
    for rows in BATCHES:
        spark.createDataFrame(rows, FIELDS).withColumn("t", F.col("t").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(FIELDS.replace("t string", "t timestamp_ntz")).parquet(src)
        states = C.case_states(stream, SPEC, E.Vocab({"a": ("u", "v")}), 2 * DAY, "0 seconds")
        q = states.writeStream.outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True)
        q = q.foreachBatch(lambda df, i: out.extend((i, *r) for r in df.collect())).start()
        q.awaitTermination()
        kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return out, kept


@pytest.mark.parametrize("groups", [1, 3])
def test_groups_give_what_single_cases_give(spark, monkeypatch, groups):
    order = lambda rows: sorted(rows, key=repr)
    monkeypatch.setattr(C, "GROUPS", 1 << 30)  # a group for each case
    alone, kept_alone = streamed(spark, "alone")
    monkeypatch.setattr(C, "GROUPS", groups)
    got, kept = streamed(spark, "grouped")
    assert order(got) == order(alone)
    assert max(kept) <= groups < max(kept_alone) and kept[-1] == kept_alone[-1] == 1  # before, a row for each case
    last = {r[1]: (r[2], r[3]) for r in sorted(got, key=lambda r: r[0])}
    assert last["z"] == ("open", 1) and last["b"] == ("expired", 4) and last[None] == ("expired", 2) and last["a"] == ("expired", 1)
    assert "late" not in last and sum(r[1] == "a" and r[2] == "expired" for r in got) == 2
    assert all(last[f"x{i}"] == ("expired", 1) for i in range(40))


def test_packed_states_are_read_back(spark):
    held = {'"a\\tb"': (5, '{"n": 1}'), "null": (1 << 62, '{"s": "\\n"}')}
    assert C._held(C._packed(held)) == held
