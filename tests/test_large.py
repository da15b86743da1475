"""Operators on values and counts past what one long, one pivot table or one collected list holds."""

import random
import statistics
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from procmon.functions import select as Q
from procmon.functions.rules import RuleSet
from procmon.operators import encode as E
from procmon.operators import flow as FL
from procmon.operators import models as M
from procmon.operators import report as V
from procmon.operators import search as H
from procmon.operators import segmented as G
from procmon.plans.fixtures import EL1, el1
from procmon.session import scratch_path
from procmon.spec import LogSpec
from procmon.streaming import cases as C

SPEC = LogSpec(case="c", activity="a", ts="t", tiebreak="e")


def test_durations_past_a_long(spark):
    ends = (F.expr("timestamp_ntz'0001-01-01'"), F.expr("timestamp_ntz'9999-01-01'"))
    cases = spark.range(40).select(F.col("id").cast("string").alias("c"), F.explode(F.array(*ends)).alias("t")).withColumns({"a": F.lit("x"), "e": F.lit(1)})
    days = 9998 * 365 + 9998 // 4 - 9998 // 100 + 9998 // 400
    assert V.case_duration_days(cases, SPEC, "L").first().case_duration_days == days  # 40 of 3.2e17 microseconds
    stats = V.log_statistics(cases, SPEC, "L").first()
    assert (stats.nr_cases, stats.mean_case_duration_days, stats.median_case_duration_days) == (40, days, days)


def test_medians_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_GROUP_VALUES", 50)
    monkeypatch.setattr(Q, "exact_quantile", None)  # no selection per group
    rng = random.Random(3)
    groups = {0: [rng.random() for _ in range(20_001)], 1: [float(rng.randint(0, 3)) for _ in range(5_000)], 2: [rng.gauss(0, 1e6) for _ in range(4_000)], 3: [1.0, 2.0], 4: [7.0] * 100}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(1, None), (3, None)], "g int, v double").repartition(5)
    got = {r.g: r.median for r in Q.grouped_median(df, "g", "v").collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}


def test_scores_keep_no_unread_columns(spark, monkeypatch):
    from procmon.plans import scores

    logs, prepare = [], FL.prepare
    monkeypatch.setattr(FL, "prepare", lambda log, *a: logs.append(log.columns) or prepare(log, *a))
    log = el1(spark, SF_SMALL)
    assert scores._details(log, EL1, "EL1").count() > 0
    assert logs == [["case_id", "activity", "ts", "event_id"]]  # the log is kept in memory


def test_quantile_by_few_pivots(spark, monkeypatch):
    calls = []
    kth = Q.kth_smallest
    monkeypatch.setattr(Q, "kth_smallest", lambda *a, **k: calls.append(1) or kth(*a, **{**k, "small": 50}))
    values = [float(i // 2) for i in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    assert Q.exact_quantile(df, "v", 0.5) == 7499.5 and len(calls) == 1
    assert len(Q._around([(i,) for i in range(1000)], 0.5)) == 2


def test_more_hot_cases_than_a_broadcast_holds(spark, monkeypatch):
    events = [(c, "uvw"[i % 3], i, 1_000_000 * (i if c != "tied" else 1), float(i)) for c in ("a", "b", "c", "d", "tied", None) for i in range(40)]
    df = spark.createDataFrame(events + [("one", "u", 0, 0, 1.0)], "c string, a string, e long, us long, x double")
    df = df.withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, us / 1e6)"))
    spec = SPEC.with_(dynamic_cat=("a",), dynamic_num=("x",))
    few = G.hot_cases(df, spec, 10)
    monkeypatch.setattr(G, "MAX_HOT_CASES", 3)  # an error before
    many = G.hot_cases(df, spec, 10)
    rows = lambda x: sorted((str(r.c), r._nseg, r._bounds, sorted(r._ties.items())) for r in x.collect())
    assert rows(many) == rows(few) and len(rows(many)) == 6 and any(r[3] for r in rows(many))
    vocab = E.fit_vocab(df, ("a",))
    cells = lambda x: sorted((str(r.c), r.prefix_len, tuple(round(v, 9) for v in r[2:])) for r in x.collect())
    assert cells(G.encode_segmented(df, spec, vocab, max_rows=10)) == cells(E.encode(df, spec, vocab))
    cases = df.where("c in ('a', 'one')").select("c").distinct()
    assert G.case_join(df, spec, cases, "left_semi", many).count() == 41 and G.case_join(df, spec, cases, "left_anti", many).count() == 200


def test_states_pass_python_as_one_text(spark):
    spec = SPEC.with_(dynamic_cat=("a",), dynamic_num=("x.y",), static_num=("s",), static_cat=("w",))
    vocab = E.Vocab({"a": ("u", 'q"é')})
    fields = "c string, a string, e long, `x.y` double, s double, w string, t timestamp_ntz"
    at = lambda us: datetime(2024, 1, 1, 10, 0, 0, us)
    events = [("k", "u", 1, 0.1, None, None, at(2)), ("k", 'q"é', 2, float("nan"), 1e300, "z", at(1)), ("k", None, 3, float("inf"), 2.0, "y", at(3)), (None, "u", 4, None, None, None, at(7)), ("l", "v", 5, -1 / 3, 5.0, "中", at(999_999))]
    src, sink, ckpt = (scratch_path(spark, f"text-{n}") for n in ("src", "sink", "ckpt"))
    spark.createDataFrame(events, fields).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(fields).parquet(src)
    states = C.case_states(stream, spec, vocab, 1 << 40, "0 seconds")
    assert states.schema == C.state_schema(spec, vocab)
    node = next(line for line in states._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInPandasWithState" in line)
    assert "row#" in node and "n_events#" not in node  # one column, where there were as many as a state has
    C.run_cases(stream, spec, vocab, sink, ckpt, 1 << 40, "0 seconds").awaitTermination()
    want = {}
    for key in ("k", None, "l"):
        s = C.new_state()
        for c, a, e, x, num, w, t in events:
            if c == key:
                C.add_event(s, {"a": a, "x.y": x, "s": num, "w": w}, [round((t - datetime(1970, 1, 1)).total_seconds() * 1e6), e], spec, vocab)
        values = C.state_row(s, key, "open", spec, vocab).items()
        want[key] = {k: None if v != v else v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for k, v in values}
    got = {r["c"]: r.asDict() for r in C.current(spark, sink, spec).collect()}
    assert got == want


@pytest.fixture(scope="module")
def prefixes(spark):
    rows = [(str(i), i % 5 + 1, i % 5, float(i % 7), float(i % 3), float(i % 7), i % 4) for i in range(400)]
    return spark.createDataFrame(rows, "case_id string, prefix_len int, bucket int, f__a double, `f__b.c` double, y double, k int").persist()


FEATURES = ["f__a", "f__b.c"]


def together(monkeypatch, owner, name, n=2):
    """Let calls of a function go on only when ``n`` of them have begun."""
    gate, own = threading.Barrier(n), getattr(owner, name)

    def call(*a, **k):
        gate.wait(60)
        return own(*a, **k)

    monkeypatch.setattr(owner, name, call)


def test_buckets_and_classes_are_fitted_together(spark, prefixes, monkeypatch):
    plain = M.fit_buckets(prefixes, "y", "regr", FEATURES, "dt", {"max_depth": 3})
    want = sorted(M.predict_buckets(prefixes, plain).collect())
    with monkeypatch.context() as m:
        together(m, M, "model", 4)
        some = prefixes.where("bucket < 4")
        lm = M.fit_buckets(some, "y", "regr", FEATURES, "dt", {"max_depth": 3})
        assert sorted(r for r in M.predict_buckets(some, lm).collect()) == [r for r in want if int(r.case_id) % 5 < 4]
    with monkeypatch.context() as m:
        together(m, M, "model", 4)
        lm = M.fit_buckets(prefixes.where("bucket = 1"), "k", "class", FEATURES, "gbt", {"n_estimators": 2}, exits=4)
    assert lm.buckets[1].kind == "ovr" and all(lm.buckets[1].per_class)
    ready = M.assembled(prefixes, FEATURES)
    assert set(ready.columns) == {"case_id", "prefix_len", "bucket", "y", "k", M.VECTOR}
    for x in (prefixes, ready):
        again = M.fit_buckets(x, "y", "regr", FEATURES, "dt", {"max_depth": 3})
        assert sorted(M.predict_buckets(ready, again).collect()) == sorted(M.predict_buckets(prefixes, again).collect()) == want
    own = [sorted(M.predict_buckets(x.where("bucket = 1"), lm).collect()) for x in (prefixes, ready)]
    assert own[0] == own[1] and len(own[0]) == 80


def test_parameter_sets_and_labels_are_tried_together(spark, monkeypatch):
    log, cfg = el1(spark, SF_SMALL), FL.FlowConfig(model="dt")
    spec = EL1.with_(dynamic_cat=("activity",))
    alone = {(r.sample, r.nr_events, r.metric): r.score for r in H.search_trials(log, spec, cfg, H.sample_params(spark, 2), scratch_path(spark, "alone")).collect()}
    together(monkeypatch, H, "_direct_scores")
    trials = H.search_trials(log, spec, cfg, H.sample_params(spark, 2), scratch_path(spark, "both"))
    assert {(r.sample, r.nr_events, r.metric): r.score for r in trials.collect()} == alone and alone
    assert H.search_direct(log, spec, cfg, H.sample_params(spark, 2)).count() == len(alone)


def test_labels_are_fitted_together(spark, prefixes, monkeypatch):
    together(monkeypatch, M, "fit_buckets")
    models = FL.fit_labels(prefixes.withColumn("bucket", F.lit(1)), RuleSet(("y",), ("k",), (), {}), {"k": [0, 1, 2, 3]}, FL.FlowConfig(model="dt"), FEATURES)
    assert [(lm.label, lm.mode) for lm in models] == [("y", "regr"), ("k", "class")]


def test_wide_rows_are_spread_and_narrow_ones_gathered(spark, monkeypatch):
    rows = spark.range(1000, numPartitions=8)
    parts = lambda *a: M._sized(rows, 1000, *a).rdd.getNumPartitions()
    assert parts(10, False) == 1 and parts(10, True) == 8
    monkeypatch.setattr(M, "MOST_VALUES", 1000)
    assert parts(50, True) == parts(50, False) == 50 and parts(5, True) == 8


def test_constant_buckets_are_one_pass(spark, prefixes):
    lm = M.fit_buckets(prefixes.where("bucket < 4"), "y", "regr", FEATURES, "dt", {"max_depth": 3}, min_cases=1 << 40)
    got = M.predict_buckets(prefixes.unionByName(prefixes.limit(1).withColumn("bucket", F.lit(None).cast("int"))), lm)
    assert "Union" not in M.predict_buckets(prefixes, lm)._jdf.queryExecution().optimizedPlan().toString()  # a branch per bucket
    means = {b: statistics.mean(float(i % 7) for i in range(400) if i % 5 == b) for b in range(4)}
    overall = statistics.mean(float(i % 7) for i in range(400) if i % 5 < 4)
    rows = got.collect()
    assert len(rows) == 400 and all(abs(r.pred_y - means.get(int(r.case_id) % 5, overall)) < 1e-9 for r in rows)


def test_large_forests_grow_in_small_groups(spark, prefixes, monkeypatch):
    """Groups change neither the trees nor their bags: without random features, forests grown node by node are equal."""
    params = {"n_estimators": 5, "max_depth": 3, "max_features": "all"}
    rows = prefixes.where("bucket = 1")  # 80 rows
    fits = []
    for least, mb in ((80 * 5, 0), (80 * 5 - 1, 4), (80 * 5 - 1, 0)):
        monkeypatch.setattr(M, "LARGE_FOREST", least)
        monkeypatch.setattr(M, "GROUP_MB", mb)
        fits.append(M.fit_buckets(rows, "y", "regr", FEATURES, "rf", params))
    forests = [lm.buckets[1].model.stages[-1] for lm in fits]
    assert [f.getMaxMemoryInMB() for f in forests] == [256, 4, 0]
    assert len({f.totalNumNodes for f in forests}) == 1 and {f.getNumTrees for f in forests} == {5}
    want, *others = (sorted(M.predict_buckets(rows, lm).collect()) for lm in fits)
    assert all(x == want for x in others) and len(want) == 80
