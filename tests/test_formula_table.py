"""F3 with formulas as data: equal to compiled formulas and to plain evaluation, for tens of thousands of formulas."""

import random

import pytest
from pyspark.sql import functions as F

from procmon.functions import formula as FM
from procmon.operators import flow as FL

TERMS = ("A", "b", "c", "p1")


def random_formula(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return rng.choice([*TERMS, f"{rng.randint(0, 99)}", f"{rng.random():.3f}"])
    a, b = random_formula(rng, depth + 1), random_formula(rng, depth + 1)
    return rng.choice([f"({a} {rng.choice('+-*/')} {b})", f"-({a})", f"{a}+{b}", f"{a}*{b}"])


def plain(text, values):
    try:
        return eval(text, {}, dict(values))  # noqa: S307 - made above
    except (ZeroDivisionError, TypeError):
        return None


@pytest.mark.parametrize("n", [300, 50_000])
def test_formulas_as_data(spark, n):
    rng = random.Random(n)
    texts = [random_formula(rng) for _ in range(n)] + ["1/0", "A", None, "-(-c)*2-b/p1"]
    rows = [(f"c{i}", 2, t, *[rng.choice([None, 0.0, 1.5, rng.random()]) for _ in TERMS]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, formula string, " + ", ".join(f"t_{t} double" for t in TERMS)).repartition(8).cache()
    terms, formulas = df.drop("formula"), df.select("case_id", "prefix_len", "formula")
    got = {r.case_id: r.predicted for r in FL.evaluate_formulas(terms, formulas).select("case_id", "predicted").collect()}
    assert len(got) == len(rows)
    for case, _, text, *values in rows:
        want = None if text is None else plain(text, zip(TERMS, values, strict=True))
        assert got[case] == want if want is None else got[case] == pytest.approx(want, rel=1e-12, abs=1e-300), (text, values)
    if n < 1000:  # few formulas are compiled; as data they give the same
        table = {r.case_id: r.predicted for r in FL.evaluate_formula_table(terms, formulas).select("case_id", "predicted").collect()}
        assert table == got
    with pytest.raises(Exception, match="unknown terms"):
        FL.evaluate_formula_table(terms, formulas.withColumn("formula", F.lit("A + zz"))).collect()


def test_postfix_order():
    assert [t[0] if t[0] != "id" else t[2] for t in FM.postfix(FM.parse("a - b * -(c / 2)"))] == ["a", "b", "c", "num", "/", "neg", "*", "-"]
