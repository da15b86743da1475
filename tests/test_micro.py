"""Hand-made micro logs with expected values (FIXTURES.md part C)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from procmon.functions.formula import FormulaError, compile_formula, parse
from procmon.functions.rules import Count, Follows, Present, RuleSet
from procmon.operators import clean as P
from procmon.operators import encode as E
from procmon.operators import features as T
from procmon.operators import flow as FL
from procmon.operators import intercase as O
from procmon.operators import models as M
from procmon.operators import split as D
from procmon.operators import targets as L
from procmon.spec import LogSpec

SPEC = LogSpec("case_id", "activity", "ts", "event_id", static_cat=("seg",), static_num=(), dynamic_cat=("activity",), dynamic_num=("v",))
SCHEMA = "case_id string, activity string, ts timestamp_ntz, event_id long, v double, seg string"


def t(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_single_event_case(spark):
    df = log(spark, [("s", "a", t(0), 1, 5.0, "x")])
    out = T.standard_features(df, SPEC).first()
    assert (out.timesincelastevent, out.timesincecasestart, out.remtime, out.event_nr, out.case_length) == (0.0, 0.0, 0.0, 1, 1)
    # a full trace is never a prefix (strict length rule)
    assert D.prefix_log(df, SPEC, 1, 5).count() == 0
    # never open in the sequential count
    assert O.open_cases_sequential(df, SPEC).first().open_cases == 0
    # sample std of one value -> 0 after filling
    enc = E.encode(df, SPEC, E.Vocab({"activity": ("a",)}), "agg", 1, 5, strict=False).first()
    assert enc["agg__std_v"] == 0.0 and enc["agg__mean_v"] == 5.0


def test_strict_prefix_lengths(spark):
    df = log(spark, [("c", "a", t(i), i, 1.0, "x") for i in range(3)])
    lens = sorted(r.prefix_len for r in D.prefix_log(df, SPEC, 1, 5).select("prefix_len").distinct().collect())
    assert lens == [1, 2]
    enc = E.encode(df, SPEC, E.Vocab({}), "none", 1, 5)
    assert sorted(r.prefix_len for r in enc.collect()) == [1, 2]


def test_ties_use_tiebreak(spark):
    # equal timestamps inside the case and at its end
    rows = [("c", "b", t(0), 2, 1.0, "x"), ("c", "a", t(0), 1, 2.0, "x"), ("c", "z", t(5), 4, 3.0, "x"), ("c", "y", t(5), 3, 4.0, "x")]
    out = T.event_nr(log(spark, rows), SPEC).orderBy("event_nr").collect()
    assert [r.activity for r in out] == ["a", "b", "y", "z"]


def test_nulls_first_last_previous(spark):
    rows = [("c", "a", t(0), 1, None, None), ("c", "b", t(1), 2, 2.0, "x"), ("c", "c", t(2), 3, None, "y"), ("c", "d", t(3), 4, 4.0, None)]
    df = log(spark, rows)
    vocab = E.Vocab({"activity": ("a", "b", "c", "d"), "seg": ("x", "y")})
    enc = {r.prefix_len: r for r in E.encode(df, SPEC, vocab, "static", 1, 4, strict=False).collect()}
    # first non-null static value: x from event 2 on
    assert enc[1]["static__seg_x"] == 0.0 and enc[2]["static__seg_x"] == 1.0 and enc[4]["static__seg_x"] == 1.0
    last = {r.prefix_len: r for r in E.encode(df, SPEC, vocab, "last", 1, 4, strict=False).collect()}
    assert last[3]["last__v"] == 2.0  # last non-null skips the null at event 3
    prev = {r.prefix_len: r for r in E.encode(df, SPEC, vocab, "previous", 1, 4, strict=False).collect()}
    assert prev[4]["previous__v"] == 0.0  # previous keeps the null of event 3 (-> 0)
    assert prev[1]["previous__v"] == 0.0 and prev[1]["previous__activity_a"] == 0.0
    ff = {r.event_id: r for r in P.ffill(df, SPEC, ["v", "seg"]).collect()}
    assert ff[3].v == 2.0 and ff[4].seg == "y" and ff[1].v is None


def test_ids_with_underscore_and_case(spark):
    rows = [("A_1", "a", t(0), 1, 1.0, "x"), ("A_1", "b", t(1), 2, 1.0, "x"), ("A_1", "c", t(2), 3, 1.0, "x"),
            ("a_1", "a", t(0), 4, 1.0, "x"), ("a_1", "b", t(1), 5, 1.0, "x")]
    p = D.prefix_log(log(spark, rows), SPEC, 1, 5)
    keys = sorted({(r.case_id, r.prefix_len) for r in p.collect()})
    assert keys == [("A_1", 1), ("A_1", 2), ("a_1", 1)]


def test_cycle_time_ignores_first_position(spark):
    rows = [("c", "x", t(0), 1, 1.0, "s"), ("c", "y", t(2), 2, 1.0, "s"), ("c", "x", t(6), 3, 1.0, "s")]
    ct = L.cycle_times(log(spark, rows), SPEC, ["x", "y", "z"]).first()
    assert ct.x == 240.0  # only the occurrence with a predecessor: 4 minutes
    assert ct.y == 120.0 and ct.z is None


def test_gateway_rules(spark):
    rs = RuleSet(
        activities=(),
        gateways=("g1", "g2", "g3", "loop"),
        rules=(
            Follows("g1", "a", "b", 1, 0),
            Present("g2", (((("b", True), ("z", False)), 0), ((("b", False), ("z", True)), 1))),
            Count("g3", "a", (("==", 1, 0), (">", 1, 1))),
            Follows("loop", "a", "a", 1),
        ),
        defaults={"loop": 0},
    )
    # a b a c : first pair a->b gives 1, the later a->c gives 0; the last match wins
    rows = [("c", "a", t(0), 1, 1.0, "s"), ("c", "b", t(1), 2, 1.0, "s"), ("c", "a", t(2), 3, 1.0, "s"), ("c", "c", t(3), 4, 1.0, "s")]
    out = L.build_targets(log(spark, rows), SPEC, rs).first()
    assert (out.g1, out.g2, out.g3, out.loop) == (0, 0, 1, 0)
    sink = L.build_targets(log(spark, [("d", "q", t(0), 9, 1.0, "s")]), SPEC, rs, sink=True).first()
    assert (sink.g1, sink.g2, sink.g3, sink.loop) == (-1, -1, -1, 0)


def test_unseen_levels_and_padding(spark):
    train = log(spark, [("c", "a", t(0), 1, 1.0, "x"), ("c", "b", t(1), 2, 1.0, "x")])
    test = log(spark, [("d", "a", t(0), 3, 1.0, "new"), ("d", "zzz", t(1), 4, 1.0, "new"), ("d", "b", t(2), 5, 1.0, "x")])
    vocab = E.fit_vocab(train, SPEC.cat_cols)
    assert vocab["activity"] == ("a", "b") and vocab["seg"] == ("x",)
    enc = {r.prefix_len: r for r in E.encode(test, SPEC, vocab, "laststate", 1, 3).collect()}
    assert enc[2]["last__activity_a"] == 0.0 and enc[2]["last__activity_b"] == 0.0  # unseen level -> zeros
    assert "last__activity_zzz" not in enc[2].asDict()


def test_single_class_and_small_data_fallbacks(spark):
    rows = [(f"c{i}", i, float(i % 2), 1, 0) for i in range(10)]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, f__x double, bucket int, g int")
    lm = M.fit_buckets(df, "g", "class", ["f__x"], "rf", {"n_estimators": 5}, min_cases=30, exits=3)
    assert lm.buckets[1].kind == "onehot" and lm.buckets[1].probs == [1.0, 0.0, 0.0]
    df2 = df.withColumn("y", F.col("prefix_len").cast("double"))
    lm2 = M.fit_buckets(df2, "y", "regr", ["f__x"], "rf", {"n_estimators": 5}, min_cases=30)
    assert lm2.buckets[1].kind == "mean" and lm2.buckets[1].value == 4.5
    pred = M.predict_buckets(df2.withColumn("bucket", F.when(F.col("prefix_len") < 5, 1).otherwise(7)), lm2)
    assert {r.pred_y for r in pred.collect()} == {4.5}  # unseen bucket 7 -> overall mean


def test_formulas(spark):
    df = spark.createDataFrame([(2.0, 3.0, 1.0)], "t_C double, t_c double, t_p double")
    with pytest.raises(Exception):
        # Spark resolves names case-insensitively: terms C and c cannot both be columns
        df.select(compile_formula("C + c")).collect()
    df = spark.createDataFrame([(2.0, 1.0)], "t_A double, t_p double")
    row = df.select(
        compile_formula("A * (1 + 2) - -A").alias("x"), compile_formula("A/(1 - p)").alias("z"), compile_formula("0").alias("o")
    ).first()
    assert row.x == 8.0 and row.z is None and row.o == 0.0
    for bad in ("__import__('os')", "A; B", "A ** 2", "A +", "A.b"):
        with pytest.raises(FormulaError):
            parse(bad)


def test_rare_and_topk(spark):
    rows = [("c", "a", t(i), i, 1.0, "nine") for i in range(9)] + [("d", "a", t(i), 100 + i, 1.0, "ten") for i in range(10)]
    df = log(spark, rows)
    out = {r.seg for r in P.rare_to_other(df, ["seg"], 10).collect()}
    assert out == {"other", "ten"}
    rows = [("c", "a", t(0), 1, 1.0, lv) for lv in ("b", "a", "c")]
    top = {r.seg for r in P.topk_to_other(log(spark, rows), ["seg"], 2).collect()}
    assert top == {"a", "b", "other"}  # equal counts: the smaller levels are kept


def test_flow_mean_model_end_to_end(spark, tmp_path):
    """A two-activity log where the mean model is exact: every case is a -> b, 60 s apart."""
    rows = []
    for i in range(40):
        rows += [(f"c{i}", "a", t(i), 2 * i, 1.0, "x"), (f"c{i}", "b", t(i + 1), 2 * i + 1, 1.0, "x"), (f"c{i}", "c", t(i + 3), 2 * i + 1000, 1.0, "x")]
    df = log(spark, rows)
    rs = RuleSet(activities=("b", "c"), gateways=(), rules=())

    def formulas(prefixes):
        return prefixes.select("case_id", "prefix_len", F.lit("c").alias("formula"))

    det = FL.predict_flow(df, SPEC, rs, formulas, FL.FlowConfig(min_len=2, max_len=2))
    rows = det.collect()
    assert rows and all(r.predicted == 120.0 and r.actual == 120.0 for r in rows)
