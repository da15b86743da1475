"""Standalone operators with a case of 99 % of the events: plain form against segments."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procmon.functions import rules as R
from procmon.operators import features as T
from procmon.operators import segmented as G
from procmon.operators import split as D
from procmon.operators import targets as L
from procmon.spec import LogSpec

SPEC = LogSpec(case="case id", activity="act", ts="t.s", tiebreak="nr")


@pytest.fixture(scope="module")
def events(spark):
    rnd, rows = random.Random(9), []
    start = datetime(2024, 1, 1)
    for c, n in [("hot", 990), ("a", 1), ("b", 3), (None, 4), ("", 2)]:
        for _ in range(n):
            ts = None if rnd.random() < 0.01 else start + timedelta(minutes=rnd.randrange(300))
            rows.append((c, rnd.choice("uvwx"), ts, len(rows), "big" if c == "hot" else c))
    return spark.createDataFrame(rows, "`case id` string, act string, `t.s` timestamp_ntz, nr long, kind string").repartition(4).persist()


@pytest.fixture(scope="module")
def hot(events):
    return G.hot_cases(events, SPEC, 100)


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    rows = lambda df: sorted(map(repr, df.select(*[F.col(f"`{n}`") for n in names]).collect()))
    got, want = rows(b), rows(a)
    assert got == want


@pytest.mark.parametrize("op", [T.time_since_last, T.time_since_start, T.remaining_time, T.duration, T.event_nr, T.case_length])
def test_features(events, hot, op):
    same(op(events, SPEC), op(events, SPEC, hot=hot))


def test_targets(events, hot):
    rules = (
        R.Follows("follows", "u", "v", 1, 0),
        R.Present("present", (((("x", True), ("w", False)), 1), ((("x", True),), 2))),
        R.Count("count", "u", (("==", 1, 1), (">", 1, 2))),
    )
    rs = R.RuleSet(("u", "v"), ("follows", "present", "count"), rules)
    same(L.cycle_times(events, SPEC, ["u", "v"]), L.cycle_times(events, SPEC, ["u", "v"], hot=hot))
    for op in (L.gateway_follows, L.gateway_presence, L.gateway_count):
        same(op(events, SPEC, rs), op(events, SPEC, rs, hot=hot))
    same(L.assign_label(events, SPEC, 3600.0), L.assign_label(events, SPEC, 3600.0, hot=hot))


def test_splits(events, hot):
    for op in (D.temporal_split, D.random_split, D.three_way_split):
        for plain, cut in zip(op(events, SPEC), op(events, SPEC, hot=hot)):
            same(plain, cut)
    for label in (None, "kind"):
        same(D.kfold(events, SPEC, 2, label), D.kfold(events, SPEC, 2, label, hot=hot))
    same(D.partial_traces(events, SPEC, 0.5), D.partial_traces(events, SPEC, 0.5, hot=hot))


def test_stratified_folds_of_many_classes_are_balanced(spark):
    log = spark.range(3000).select(
        F.col("id").cast("string").alias("case id"), F.lit("u").alias("act"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("t.s"),
        F.col("id").alias("nr"), F.when(F.col("id") < 1000, "most").otherwise((F.col("id") % 400).cast("string")).alias("kind"),
    )
    sizes = D.kfold(log, SPEC, 5, "kind").groupBy("kind", "fold").count().groupBy("kind").agg(F.sum("count").alias("n"), F.max("count").alias("hi"))
    rows = sizes.collect()
    assert sum(r["n"] for r in rows) == 3000 and len(rows) == 401
    assert all(r["hi"] == -(-r["n"] // 5) for r in rows)
