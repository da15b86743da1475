"""Scoring bundles, running cases with timers, the idempotent sink, resumable search."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from procmon.operators import bundle as B
from procmon.operators import encode as E
from procmon.operators import features as T
from procmon.operators import flow as FL
from procmon.operators import search as H
from procmon.plans.fixtures import EL1, el1
from procmon.session import scratch_path
from procmon.sources import io as S
from procmon.streaming import cases as C

SPEC = EL1.with_(dynamic_cat=("activity",))
ACTS = ("click", "error", "purchase", "signup", "view")


def scores(rows):
    return sorted((r.case_id, r.nr_events, r.predicted) for r in rows.collect())


def test_bundle_versions(spark):
    log = T.remaining_time(el1(spark, SF_SMALL), SPEC).persist()
    path = scratch_path(spark, "bundle")
    with pytest.raises(ValueError):
        B.load(spark, path)
    one = B.fit(log, SPEC, FL.FlowConfig(model="mean", bucket="prefix"))
    two = B.fit(log, SPEC, FL.FlowConfig(model="dt", encoding="indexbased", params={"max_depth": 3}))
    assert (B.save(one, path), B.save(two, path)) == (1, 2)
    spark.range(1).write.parquet(f"{path}/v=3/label=0/half")  # a version that was not finished
    newest, first = B.load(spark, path), B.load(spark, path, 1)
    assert newest.spec == SPEC and newest.vocab == two.vocab and newest.max_events == two.max_events > 0
    assert scores(B.score_cases(newest, log)) == scores(B.score_cases(two, log))
    assert scores(B.score_cases(first, log)) == scores(B.score_cases(one, log)) != scores(B.score_cases(two, log))
    longest = max(one.models["remtime"].buckets)
    unseen = B.score_cases(one, log).where(F.col("nr_events") > longest).select("predicted").distinct().collect()
    assert all(r.predicted is None for r in unseen)  # no model was trained for such a bucket
    with pytest.raises(ValueError):
        B.load(spark, path, 3)


def test_events_in_any_order_give_one_state():
    rng = random.Random(1)
    spec = SPEC.with_(static_cat=("segment",), static_num=())
    vocab = E.Vocab({"activity": ACTS})
    events = [({"case_id": "c", "activity": rng.choice([*ACTS, "other", None]), "value": rng.choice([None, float("nan"), rng.random()]), "segment": rng.choice([None, "a", "b"])}, [rng.randint(0, 5), i]) for i in range(40)]
    rows = []
    for _ in range(5):
        rng.shuffle(events)
        s = C.new_state()
        for e, at in events:
            C.add_event(s, e, at, spec, vocab)
        rows.append(C.state_row(s, "c", "open", spec, vocab))
    for r in rows[1:]:
        assert all(v == pytest.approx(rows[0][k], rel=1e-9) if isinstance(v, float) else v == rows[0][k] for k, v in r.items())
    ordered = sorted(events, key=lambda x: x[1])
    assert rows[0]["first_activity"] == ordered[0][0]["activity"] and rows[0]["n_events"] == 40
    assert rows[0]["first_segment"] == next(e["segment"] for e, _ in ordered if e["segment"])


def test_expired_cases_leave_the_state_store(spark):
    src, sink, ckpt = (scratch_path(spark, f"expiry-{n}") for n in ("src", "sink", "ckpt"))
    day = lambda d: f"2024-01-{d:02d} 10:00:00"
    batches = [[("a", 1, 1), ("b", 1, 2)], [("b", 3, 3), ("c", 3, 4)], [("a", 2, 5), ("c", 9, 6)], [("d", 20, 7)]]
    kept = []
    for part in batches:
        rows = [(c, "view", day(d), i, None, None, None, 1.0 * i) for c, d, i in part]
        df = spark.createDataFrame(rows, "case_id string, activity string, ts string, event_id long, segment string, nation string, acctbal double, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").option("timestampNTZFormat", S.TS_FORMAT).json(src)
        q = C.run_cases(S.read_running(spark, src, SPEC, stream=True), SPEC, E.Vocab({"activity": ACTS}), sink, ckpt, idle=4 * 86_400_000, delay="0 seconds")
        q.awaitTermination()
        kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.case_id: (r.status, r.n_events, r.last_value) for r in C.current(spark, sink, SPEC).collect()}
    # a's event of the third batch is late; a, b and c are finished when d arrives
    assert got == {"a": ("expired", 1, 1.0), "b": ("expired", 2, 3.0), "c": ("expired", 2, 6.0), "d": ("open", 1, 7.0)}
    assert kept[-1] == 1 < max(kept)


def test_sink_replaces_and_compacts(spark):
    path = scratch_path(spark, "sink")
    rows = lambda *r: spark.createDataFrame(r, "case_id string, n_events long")
    C.upsert(rows(("a", 1), ("b", 1)), 0, path)
    C.upsert(rows(("a", 2)), 1, path)
    C.upsert(rows(("a", 2), ("c", 1)), 1, path)  # the same batch once more
    want = {("a", 2), ("b", 1), ("c", 1)}
    state = lambda: {tuple(r) for r in C.current(spark, path, EL1).collect()}
    assert state() == want
    C.compact(spark, path, EL1)
    C.compact(spark, path, EL1)
    assert state() == want and C._listed(spark, path) == (1, [])
    C.upsert(rows(("b", 5)), 2, path)
    assert state() == want - {("b", 1)} | {("b", 5)}


def test_search_has_all_index_columns_and_goes_on(spark, monkeypatch):
    log = el1(spark, SF_SMALL)
    cfg = FL.FlowConfig(model="dt", encoding="index")
    _, train_p, _ = FL.prepare(log, SPEC, cfg)
    longest = train_p.agg(F.max("prefix_len")).first()[0]
    seen = []
    scores_ = H._direct_scores
    monkeypatch.setattr(H, "_direct_scores", lambda tr, va, feats, *a: seen.append(feats) or scores_(tr, va, feats, *a))
    path = scratch_path(spark, "trials")
    H.search_trials(log, SPEC, cfg, H.sample_params(spark, 1, 22), path)
    assert {f for f in seen[0] if f.startswith("index__value_")} == {f"index__value_{i}" for i in range(longest)}
    rows = H.search_trials(log, SPEC, cfg, H.sample_params(spark, 2, 22), path)
    assert len(seen) == 2 and rows.select("sample").distinct().count() == 2  # the first set was not fitted again
    best = H.best_params(rows.drop("sample"), per_length=False)
    means = rows.where("metric = 'mae'").groupBy("sample").agg(F.avg("score").alias("s")).agg(F.min("s")).first()[0]
    assert best.first().score == pytest.approx(means)
    with pytest.raises(ValueError):
        E.encode(log, SPEC, E.Vocab({}), "index")
