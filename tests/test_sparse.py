"""Sparse encodings against the dense encoders, plain and with hot cases, and as input of MLlib models."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procmon.operators import encode as E
from procmon.operators import models as M
from procmon.operators import segmented as G
from procmon.operators import sparse as S
from procmon.spec import LogSpec

SPEC = LogSpec(case="case id", activity="act", ts="ts", tiebreak="nr", static_cat=("reg.ion",), static_num=("age",), dynamic_cat=("act", "a=b"), dynamic_num=("cost",))


@pytest.fixture(scope="module")
def events(spark):
    rnd, rows = random.Random(5), []
    start = datetime(2024, 1, 1)
    maybe = lambda v: None if rnd.random() < 0.3 else v
    for c, n in [("hot", 150), ("a", 1), ("b", 2), ("c", 9), ("d", 70), (None, 4), ("", 5)]:
        for _ in range(n):
            rows.append((c, rnd.choice("uvw"), start + timedelta(hours=rnd.randrange(60)), len(rows), maybe(rnd.choice(["N", "S"])), maybe(float(rnd.randrange(3))),
                         maybe(rnd.choice(["", "x[1]=", "y"])), maybe(float(rnd.randrange(-2, 3))), 1))
    schema = "`case id` string, act string, ts timestamp_ntz, nr long, `reg.ion` string, age double, `a=b` string, cost double, _case int"
    return spark.createDataFrame(rows, schema).repartition(4).persist()


def sparse_name(dense, vocab, method):
    """Dense column name -> name of the sparse feature."""
    names = {}
    for part in E.METHODS[method]:
        for c in SPEC.static_num if part == "static" else SPEC.dynamic_num:
            for stat in ("mean_", "max_", "min_", "sum_", "std_") if part in ("agg", "bool") else ("",):
                names[f"{part}__{stat}{c}"] = f"{part}__{stat}{c}"
            names.update({f"{part}__{c}_{i}": f"{part}__{c}[{i}]" for i in range(200)})
        for c in SPEC.static_cat if part == "static" else SPEC.dynamic_cat:
            own = c.replace("=", "%3D")
            for lv in vocab[c]:
                names[f"{part}__{c}_{lv}"] = f"{part}__{own}={lv}"
                names.update({f"{part}__{c}_{i}_{lv}": f"{part}__{own}[{i}]={lv}" for i in range(200)})
    return names[dense]


def dense_cells(events, method, lo, hi, positions):
    vocab = E.fit_vocab(events, SPEC.cat_cols)
    rows = E.encode(events, SPEC, vocab, method, lo, hi, max_events=positions).collect()
    out = {}
    for r in rows:
        for name, value in r.asDict().items():
            if "__" in name and value:
                out[r["case id"], r["prefix_len"], sparse_name(name, vocab, method)] = round(value, 9)
    return out


def cells(df):
    rows = df.collect()
    out = {(r["case id"], r["prefix_len"], r["feature"]): round(r["value"], 9) for r in rows}
    assert len(out) == len(rows)
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("method", ["static", "last", "agg", "bool", "previous", "combined"])
@pytest.mark.parametrize("cut", [None, 40])
def test_equals_dense(events, method, cut):
    hot = G.hot_cases(events, SPEC, cut) if cut else None
    assert cut is None or hot is not None
    got = cells(S.expand(S.spans(events, SPEC, method, 2, hot=hot, block=16)))
    assert got == dense_cells(events, method, 2, None, 0)


def test_index_of_all_positions_equals_dense(events):
    short = events.where("`case id` is null or `case id` not in ('hot', 'd')")
    store = S.spans(short, SPEC, "indexbased", 1, 7)
    want = dense_cells(short, "indexbased", 1, 7, 9)
    assert cells(S.expand(store)) == want
    few = {k: v for k, v in want.items() if "[" not in k[2] or int(k[2].split("__")[1].split("[")[1].split("]")[0]) < 3}
    assert cells(S.expand(S.below(store, 3))) == few


def test_vectors_hold_known_features_only(events):
    train, test = events.where("`case id` <> 'd'"), events.where("`case id` = 'd'")
    vocab = S.fit_features(S.spans(train, SPEC, "indexbased"))
    ids = [r["idx"] for r in vocab.orderBy("idx").collect()]
    assert ids == list(range(len(ids)))
    names = {r["idx"]: r["feature"] for r in vocab.collect()}
    store = S.spans(test, SPEC, "indexbased")
    base = S.prefixes(test, SPEC, keep=("nr",))
    out = S.vectors(base, store, vocab, SPEC).collect()
    assert len(out) == 69 and set(out[0].asDict()) == {"case id", "prefix_len", "nr", S.VECTOR}
    got = {(r["case id"], r["prefix_len"], names[int(i)]): v for r in out for i, v in zip(r[S.VECTOR].indices, r[S.VECTOR].values)}
    known = set(names.values())
    want = {k: v for k, v in cells(S.expand(store)).items() if k[2] in known}
    assert got == want and cells(S.entries(base, store, vocab, SPEC)) == want


def test_mllib_models_take_the_vectors(events):
    log = events.withColumn("y", F.col("nr").cast("double"))
    vocab = S.fit_features(S.spans(log, SPEC, "indexbased"))
    data = S.vectors(S.prefixes(log, SPEC, keep=("y",)), S.spans(log, SPEC, "indexbased"), vocab, SPEC).withColumn("bucket", F.lit(1))
    assert E.feature_names(data) == [S.VECTOR]
    fitted = M.fit_buckets(data, "y", "regr", E.feature_names(data), "dt", {"max_depth": 3})
    scored = M.predict_buckets(data, fitted, id_cols=("case id", "prefix_len"))
    assert scored.where("pred_y is null").count() == 0


def test_broadcast_and_shuffled_vocabulary_agree(events, monkeypatch):
    store = S.spans(events, SPEC, "combined")
    vocab = S.fit_features(store)
    want = cells(S.expand(S.coded(store, vocab)))
    monkeypatch.setattr(S, "BROADCAST_FEATURES", 0)
    assert cells(S.expand(S.coded(store, vocab))) == want


def test_empty_logs_and_logs_without_features(events):
    for log in (events.limit(0), events.where("`case id` = 'a'")):
        store = S.spans(log, SPEC, "combined")
        vocab = S.fit_features(store)
        assert store.count() == vocab.count() == S.vectors(S.prefixes(log, SPEC), store, vocab, SPEC).count() == 0
    bare = SPEC.with_(static_cat=(), static_num=(), dynamic_cat=(), dynamic_num=())
    store = S.spans(events, bare, "combined")
    assert store.count() == 0 and S.spans(events, bare, "none").count() == 0
    out = S.vectors(S.prefixes(events, bare), store, S.fit_features(store), bare).collect()
    assert len(out) == 234 and all(r[S.VECTOR].size == 0 for r in out)
    whole = S.spans(events.where("`case id` = 'a'"), SPEC, "index", strict=False)
    assert whole.where("feature like 'index__act[0]=%'").count() == 1
