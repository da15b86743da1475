"""One pass over all labels and buckets (operators/ensemble.py) against MLlib's own predictions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from procmon.operators import encode as E
from procmon.operators import ensemble as EN
from procmon.operators import flow as FL
from procmon.operators import models as M
from procmon.operators import targets as L
from procmon.plans.fixtures import EL1, el1
from procmon.plans.rulesets import EL1_RULES

SPEC = EL1.with_(dynamic_cat=("activity",))
IDS = ["case_id", "prefix_len"]
SMALL = {"n_estimators": 5, "max_depth": 4}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(900):
        a, b = rnd.random(), float(rnd.randrange(6))
        bucket = rnd.choice([1, 2, 3])
        num = 10 * a + b * bucket + rnd.random() - 4
        # bucket 3 has one class of three, bucket 4 (below) few rows, and some labels are undefined
        cls = 0 if bucket == 3 else (int(b) + bucket) % 3
        data.append((f"c{i}", i % 7, bucket, a, b, None if i % 11 == 0 else num, None if i % 13 == 0 else cls, int(a > 0.4)))
    data += [(f"d{i}", 1, 4, 0.5, 1.0, float(i), i % 2, 1) for i in range(6)]
    schema = "case_id string, prefix_len int, bucket int, `x.1__a` double, x__b double, num double, cls int, two int"
    return spark.createDataFrame(data, schema).persist()


FEATS = ["x.1__a", "x__b"]


def fitted(rows, name, mode, label, exits=0, params=SMALL):
    return M.fit_buckets(rows, label, mode, FEATS, name, params, 30, exits)


def close(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def same(spark, test, labels, **options):
    """One pass over ``test`` equals ``predict_buckets`` of each label; returns the columns seen."""
    got = {(r["case_id"], r["prefix_len"]): r for r in EN.score(test, labels, **options).collect()}
    assert len(got) == test.count()
    seen = set()
    for lm in labels:
        want = M.predict_buckets(test, lm).collect()
        assert len(want) == len(got)
        for r in want:
            for c in set(r.asDict()) - set(IDS):
                seen.add(c)
                assert close(r[c], got[(r["case_id"], r["prefix_len"])][c]), (lm.label, c, r, got[(r["case_id"], r["prefix_len"])])
    return seen


def test_every_model_and_fallback_in_one_pass(spark, rows):
    unseen = rows.limit(0).unionByName(spark.createDataFrame([("u", 1, 9, 0.2, 3.0, None, None, None)], rows.schema))
    gaps = rows.where("cast(substr(case_id, 2) as int) % 50 = 0").withColumn("case_id", F.concat("case_id", F.lit("n"))).withColumn("x__b", F.lit(None).cast("double"))
    test = rows.unionByName(unseen).unionByName(gaps)  # MLlib trains on no nulls, but scores them
    labels = [fitted(rows, n, "regr", "num") for n in ("rf",)]
    for i, (name, mode, label, exits) in enumerate([("gbt", "regr", "num", 0), ("dt", "regr", "num", 0), ("rf", "class", "cls", 3), ("dt", "class", "cls", [0, 1, 2]), ("gbt", "class", "cls", 3), ("gbt", "class", "two", 2)]):
        lm = fitted(rows.withColumn(f"l{i}", F.col(label)), name, mode, f"l{i}", exits)
        labels.append(lm)
    kinds = {bm.kind for lm in labels for bm in lm.buckets.values()}
    assert kinds == {"model", "ovr", "mean", "onehot"}
    seen = same(spark, test, labels)
    assert {"pred_num", "pred_l0", "p_l2_2", "p_l4_1", "p_l5_1"} <= seen


def test_logistic_regression(spark, rows):
    same(spark, rows, [fitted(rows, "logit", "class", "cls", 3)])


def test_passes_and_labels_too_large_for_one(spark, rows):
    a = fitted(rows, "rf", "regr", "num")
    b = fitted(rows, "dt", "class", "cls", 3)
    c = fitted(rows, "dt", "class", "two", 2)
    n = EN.label_size(b) + EN.label_size(c)
    assert EN.label_size(a) > n
    assert EN._passes([b, c, a], n) == ([[b, c]], [a])
    assert EN._passes([b, c], max(EN.label_size(b), EN.label_size(c))) == ([[b], [c]], [])
    same(spark, rows, [b, c, a], max_nodes=n)


def test_odd_rows(spark, rows):
    lm = fitted(rows, "dt", "regr", "num")
    assert EN.score(rows.limit(0), [lm]).collect() == []
    twice = rows.limit(20).unionByName(rows.limit(20)).withColumn("prediction", F.lit("x")).withColumn("features", F.lit(1))
    assert EN.score(twice, [lm], keep=("prediction",)).count() == 40
    lost = EN.score(rows.limit(3).withColumn("bucket", F.lit(None).cast("int")), [lm]).collect()
    assert all(close(r.pred_num, max(0.0, lm.fallback)) for r in lost)
    none = M.fit_buckets(rows.where("false"), "num", "regr", FEATS, "dt")
    assert {r.pred_num for r in EN.score(rows, [none]).collect()} == {None}


def test_scoring_encodes_once_and_joins_nothing(spark):
    cfg = FL.FlowConfig(model="dt", bucket="prefix", params={"max_depth": 2})
    log, train, test = FL.prepare(el1(spark, SF_SMALL), SPEC, cfg)
    targets = L.build_targets(log, SPEC, EL1_RULES)
    exits = FL.gateway_classes(targets, EL1_RULES.gateways)
    plain = test._jdf.queryExecution().executedPlan().toString()
    (scored,) = FL.predict_labels(train, test, targets, EL1_RULES, exits, cfg, SPEC)
    plan = FL.term_columns(scored, EL1_RULES, exits)._jdf.queryExecution().executedPlan().toString()
    for op in ("Window [", "Join", "Exchange", "Union"):
        assert plan.count(op) == plain.count(op), op
    assert plan.count("MapInArrow") == 1
    assert scored.count() == test.count()
    assert len(E.feature_names(train)) > 3
