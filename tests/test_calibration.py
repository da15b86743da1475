"""Pool-adjacent-violators in rounds, Platt's sigmoid, and calibrated flow analysis."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from procmon.operators import calibration as K
from procmon.operators import flow as FL
from procmon.plans.fixtures import EL1, el1
from procmon.plans.formulas import el1_formulas
from procmon.plans.rulesets import EL1_RULES

SPEC = EL1.with_(dynamic_cat=("activity",))
KEYS = ["label", "bucket", "class"]
SCHEMA = "label string, bucket int, class int, x double, y int"


def brute(points):
    """x -> value by the max-min formula over all blocks of neighbouring x."""
    xs = sorted({x for x, _ in points})
    w = [sum(1 for x, _ in points if x == v) for v in xs]
    s = [sum(y for x, y in points if x == v) for v in xs]
    mean = lambda j, k: sum(s[j : k + 1]) / sum(w[j : k + 1])
    return {v: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, v in enumerate(xs)}


def made(seed=3):
    rnd = random.Random(seed)
    rows = [("a", 1, 0, round(rnd.random(), 2), int(rnd.random() < 0.4)) for _ in range(400)]
    rows += [("a", 1, 1, x := rnd.random(), int(rnd.random() < x)) for _ in range(90)]
    rows += [("a", 2, 0, x := rnd.random(), int(rnd.random() > x)) for _ in range(90)]  # falling: one block
    rows += [("b", 1, 0, 0.5, int(i % 3 == 0)) for i in range(300)]  # one hot value
    rows += [("b", 2, 0, i / 60, int(i >= 30)) for i in range(60)]  # no violation
    return rows


@pytest.mark.parametrize("chunk", [7, 40, 10_000])
def test_isotonic_equals_the_max_min_formula(spark, chunk):
    rows = made()
    blocks = K.isotonic(spark.createDataFrame(rows, SCHEMA).repartition(5), KEYS, chunk=chunk).collect()
    if chunk == 7:
        assert len({b["part"] for b in blocks}) > 1  # the last round still had several ranges
    for key in {r[:3] for r in rows}:
        own = sorted((b["lo"], b["hi"], b["value"]) for b in blocks if (b["label"], b["bucket"], b["class"]) == key)
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(own, own[1:]))
        for x, value in brute([r[3:] for r in rows if r[:3] == key]).items():
            (got,) = [v for lo, hi, v in own if lo <= x <= hi]
            assert math.isclose(got, value, abs_tol=1e-12)


def test_isotonic_of_nothing_and_of_gaps(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert K.isotonic(empty, KEYS).count() == 0
    odd = spark.createDataFrame([("a", 1, 0, None, 1), ("a", 1, 0, float("nan"), 1), ("a", 1, 0, 0.5, None), ("a", 1, 0, 0.5, 1)], SCHEMA)
    (row,) = K.isotonic(odd, KEYS).collect()
    assert (row["lo"], row["hi"], row["w"], row["value"]) == (0.5, 0.5, 1, 1.0)
    none = K.fit(empty, KEYS)
    assert none.sigmoid == {} and none.blocks is None


def test_platt_is_a_minimum():
    rnd = np.random.default_rng(1)
    x = rnd.random(500)
    y = (rnd.random(500) < x**2).astype(int)
    a, b = K.platt(x, y)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a * x + b) - t * (a * x + b)))
    assert a > 0 and all(loss(a, b) <= loss(a + i, b + j) for i in (-1e-3, 0, 1e-3) for j in (-1e-3, 0, 1e-3))
    a, b = K.platt(np.array([0.0, 0.0, 1.0, 1.0]), np.array([0, 0, 1, 1]))  # separable
    assert math.isfinite(a) and math.isfinite(b)


@pytest.mark.parametrize("limit", [9, 1_000_000])
def test_apply_interpolates_clips_and_leaves_the_rest(spark, limit):
    rows = made() + [("c", 1, 0, 0.3, 1)] * 400  # one class only: identity
    cal = K.fit(spark.createDataFrame(rows, SCHEMA), KEYS, sigmoid_below=100, chunk=12)
    assert set(cal.sigmoid) == {("a", 1, 1), ("a", 2, 0), ("b", 2, 0)}
    xs = [-1.0, 0.0, 0.123, 0.505, 0.77, 1.0, 2.0, None]
    data = [(i, b, x, x, x, x) for i, (b, x) in enumerate((b, x) for b in (1, 2, None) for x in xs)]
    test = spark.createDataFrame(data, "i int, bucket int, p_a_0 double, p_a_1 double, p_b_0 double, p_c_0 double")
    columns = {"p_a_0": ("a", 0), "p_a_1": ("a", 1), "p_b_0": ("b", 0), "p_c_0": ("c", 0)}
    got = {r["i"]: r for r in K.apply(test, cal, columns, limit=limit).collect()}
    assert len(got) == len(data)
    fitted = {k: brute([r[3:] for r in rows if r[:3] == k]) for k in [("a", 1, 0), ("b", 1, 0)]}
    for i, b, x, *_ in data:
        for name, (label, cls) in columns.items():
            key = (label, b, cls)
            if x is None:
                want = None
            elif key in cal.sigmoid:
                s, t = cal.sigmoid[key]
                want = 1 / (1 + math.exp(-(s * x + t)))
            elif key in fitted:
                want = float(np.interp(x, sorted(fitted[key]), [fitted[key][v] for v in sorted(fitted[key])]))
            else:
                want = x
            have = got[i][name]
            assert (want is None and have is None) or math.isclose(want, have, abs_tol=1e-9), (key, x, want, have)


def test_normalise(spark):
    df = spark.createDataFrame([(0.2, 0.6), (0.0, 0.0), (None, 0.1)], "a double, b double")
    rows = [tuple(r) for r in K.normalise(df, [["a", "b"]]).collect()]
    assert rows[0] == pytest.approx((0.25, 0.75)) and rows[1] == (0.5, 0.5) and rows[2] == (None, None)


def test_calibrated_flow(spark):
    cfg = FL.FlowConfig(model="dt", bucket="prefix", params={"max_depth": 2}, calibrate=0.8)
    plain = FL.FlowConfig(model="dt", bucket="prefix", params={"max_depth": 2})
    a = FL.predict_flow(el1(spark, SF_SMALL), SPEC, EL1_RULES, el1_formulas, cfg)
    b = FL.predict_flow(el1(spark, SF_SMALL), SPEC, EL1_RULES, el1_formulas, plain)
    assert a.columns == b.columns and a.count() == b.count()
    assert a.where("predicted < 0").count() == 0
    assert a.select("case_id", "nr_events").exceptAll(b.select("case_id", "nr_events")).count() == 0
