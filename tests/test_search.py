"""Parameter searches whose sets share a forest: every set has its own trees and depth, and its own rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procmon.operators import ensemble as EN
from procmon.operators import flow as FL
from procmon.operators import models as M
from procmon.operators import search as H
from procmon.plans import q_models
from procmon.plans.fixtures import EL1
from procmon.plans.formulas import el1_formulas
from procmon.plans.rulesets import EL1_RULES

SPEC = EL1.with_(dynamic_cat=("activity",))
FEATS = ["f__a", "f__b", "f__c"]
FIELDS = "case_id string, activity string, ts string, event_id long, segment string, nation string, acctbal double, value double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(600):
        a, b, c = rng.random(), float(rng.randrange(5)), rng.gauss(0, 1)
        out.append((f"c{i}", i % 5, 1, a, b, None if i % 50 == 0 else c, 8 * a - b + c + rng.random(), (int(3 * a) + int(b > 2 and rng.random() < 0.7)) % 4))
    return spark.createDataFrame(out, "case_id string, prefix_len int, bucket int, f__a double, f__b double, f__c double, y double, k int").persist()


@pytest.fixture(scope="module")
def log(spark):
    rng, out = random.Random(7), []
    for case in range(160):
        for i in range(rng.randint(3, 7)):
            ts = f"2024-01-{1 + case // 8:02d} {8 + i:02d}:{rng.randrange(60):02d}:00"
            out.append((f"c{case}", rng.choice(("click", "error", "purchase", "signup", "view")), ts, case * 10 + i, rng.choice("ab"), "n", float(case % 9), rng.random()))
    return spark.createDataFrame(out, FIELDS).withColumn("ts", F.col("ts").cast("timestamp_ntz")).persist()


@pytest.mark.parametrize(("label", "mode"), [("y", "regr"), ("k", "class")])
def test_cut_forests_are_the_forests_of_that_depth(spark, rows, label, mode):
    """Without random features MLlib's own forests of fewer levels hold the same trees."""
    known, fit = rows.where("f__c is not null"), lambda depth: M.fit_buckets(known, label, mode, FEATS, "rf", {"n_estimators": 7, "max_depth": depth, "max_features": "all"}, exits=4)
    depths, large = (0, 1, 3, 6), fit(6)
    names = [f"pred_{label}"] if mode == "regr" else [f"p_{label}_{c}" for c in range(4)]
    for test in (rows, M.assembled(rows, FEATS)):
        got = {(r["_set"], r["case_id"]): [r[n] for n in names] for r in EN.score_within(test, [large], [(7, d) for d in depths]).collect()}
        assert len(got) == 600 * len(depths)
        for i, depth in enumerate(depths):
            for r in M.predict_buckets(rows, fit(depth)).collect():
                assert got[i, r["case_id"]] == pytest.approx([r[n] for n in names], rel=1e-9, abs=1e-9)


def test_forests_of_fewer_trees_are_the_first_ones(spark, rows):
    lm = M.fit_buckets(rows.where("f__c is not null"), "y", "regr", FEATS, "rf", {"n_estimators": 9, "max_depth": 4})
    trees = lm.buckets[1].model.stages[-1].trees
    got = {(r["_set"], r["case_id"]): r["pred_y"] for r in EN.score_within(rows, [lm], [(2, 4), (9, 4), (5, 4)]).collect()}
    some = M.assembled(rows.where("prefix_len = 2 and f__c is not null"), FEATS).collect()
    for r in some:
        own = [t.predict(r[M.VECTOR]) for t in trees]
        assert [got[i, r["case_id"]] for i in range(3)] == pytest.approx([max(0.0, np.mean(own[:n])) for n in (2, 9, 5)])


def _sets(spark):
    return spark.createDataFrame([(i, n, 0.05, 0.9, d, 0.8, 1) for i, (n, d) in enumerate([(3, 2), (8, 4), (8, 4), (5, 3)])], f"sample int, {', '.join(f'{p} {t}' for p, t in zip(H.PARAMS, ('int', 'double', 'double', 'int', 'double', 'int')))}")


@pytest.mark.parametrize("search", [H.search_direct, H.search_labels, lambda log, spec, cfg, sets: H.search_joint(log, spec, EL1_RULES, el1_formulas, cfg, sets)])
def test_sets_that_share_a_forest_have_all_rows(spark, log, search, monkeypatch):
    """The rows, names and types are those of one fit for each set."""
    cfg, sets = FL.FlowConfig(model="rf", min_cases=5), _sets(spark)
    call = (lambda: search(log, SPEC, EL1_RULES, cfg, sets)) if search is H.search_labels else (lambda: search(log, SPEC, cfg, sets))
    fits, fit = [], M.fit_buckets
    monkeypatch.setattr(M, "fit_buckets", lambda *a, **k: fits.append((a[1], (a[5] if not callable(a[5]) else a[5](1))["n_estimators"])) or fit(*a, **k))
    shared = call().persist()
    assert len(fits) == len({a for a, _ in fits}) and {n for _, n in fits} == {8}
    monkeypatch.setattr(H, "_forest", lambda *a: None)
    alone = call().persist()
    assert shared.dtypes == alone.dtypes
    key = lambda r: tuple(v for v in r.asDict().items() if v[0] != "score")
    assert sorted(map(key, shared.collect())) == sorted(map(key, alone.collect()))
    # the set of the most trees and levels is the forest itself
    top = lambda df: {(r.label_col, r.nr_events, r.metric): r.score for r in df.where("n_estimators = 8").collect()}
    got, want = top(shared), top(alone)
    assert got.keys() == want.keys() and got
    assert all(v == pytest.approx(want[k], rel=1e-6) for k, v in got.items())


@pytest.mark.parametrize("name", ["h2", "h3", "h4"])
def test_searches_try_as_many_sets_as_the_reference(spark, monkeypatch, name):
    tried = []
    for f in ("search_direct", "search_labels", "search_joint"):
        monkeypatch.setattr(H, f, lambda *a: tried.append(next(x for x in a if hasattr(x, "columns") and "n_estimators" in x.columns).count()))
    monkeypatch.setattr(q_models, "el1", lambda *a: None)
    getattr(q_models, name)(spark, "")
    assert tried == [50]
