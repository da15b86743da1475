"""Implicit prefix logs against explicit ones, plain and in segments."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procmon.operators import prefixes as P
from procmon.operators import segmented as G
from procmon.operators import split as D
from procmon.operators import targets as L
from procmon.session import scratch_path
from procmon.sources import io as S
from procmon.spec import LogSpec

SPEC = LogSpec(case="case id", activity="act", ts="ts", tiebreak="nr")


@pytest.fixture(scope="module")
def events(spark):
    rnd, rows = random.Random(2), []
    start = datetime(2024, 1, 1)
    for c, n in [("hot", 60), ("a", 1), ("b", 2), ("c", 9), ("d", 3), (None, 4), ("", 5)]:
        for i in range(n):
            value = None if rnd.random() < 0.2 else rnd.randrange(50)
            rows.append((c, "x", start + timedelta(hours=rnd.randrange(30)), len(rows), value, rnd.choice("uvw")))
    schema = "`case id` string, act string, ts timestamp_ntz, nr long, `va.lue` int, kind string"
    return spark.createDataFrame(rows, schema).repartition(4).persist()


def same(a, b, names):
    pick = lambda df: df.select(*[F.col(f"`{n}`") for n in names])
    a, b = pick(a), pick(b)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("lo,hi,cut", [(1, None, None), (2, 6, None), (2, None, 7), (3, 40, 7)])
def test_implicit_equals_explicit(events, lo, hi, cut):
    hot = G.hot_cases(events, SPEC, cut) if cut else None
    assert cut is None or hot is not None
    log = P.ranges(events, SPEC, lo, hi, hot)
    full = D.prefix_log(events, SPEC, lo, hi).persist()
    same(P.expand(log), full, ["case id", "nr", "prefix_len", "case_length", "kind"])
    same(P.of_length(log, 4), D.prefixes_of(full, 4), ["case id", "nr", "prefix_len"])
    same(P.sizes(log, SPEC), D.prefix_sizes(full, SPEC).where("n_prefixes > 0"), ["prefix_len", "n_prefixes"])
    for label, mode in [("kind", "class"), ("value", "regr")]:
        own = lambda df: df.withColumnRenamed("va.lue", "value")
        same(P.labels(own(log), SPEC, label, mode, hot=hot), L.prefix_label(own(full), SPEC, label, mode), ["case id", "prefix_len", label])
    full.unpersist()


def test_empty_and_short_logs(events):
    empty = P.ranges(events.limit(0), SPEC)
    assert P.expand(empty).count() == P.sizes(empty, SPEC).count() == P.labels(empty, SPEC, "kind", "class").count() == 0
    assert P.ranges(events.where("`case id` = 'a'"), SPEC).count() == 0
    none = P.ranges(events, SPEC, 5, 4)
    assert none.count() == 0


def test_prefixes_are_written_after_one_shuffle_of_the_events(spark, events):
    path = scratch_path(spark, "events")
    events.write.parquet(path)
    log = P.ranges(spark.read.parquet(path), SPEC, 2)
    for df in (P.expand(log), P.labels(log, SPEC, "kind", "class"), P.of_length(log, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
    out = scratch_path(spark, "prefixes")
    S.write_prefix_logs(P.expand(log).select("case id", "nr", "prefix_len"), out)
    back = spark.read.options(sep=";", header="true").csv(out)
    assert back.count() == D.prefix_log(events, SPEC, 2).count()
