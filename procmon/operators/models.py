"""Models on MLlib.

A *prefix table* has one row per prefix ``(case, prefix_len)``, a ``bucket``
column, feature columns (``enc__...``) and label columns.  Fitting goes over
the buckets on the driver (their number is small: 1 or the maximum prefix
length), some at a time; every fit and every prediction is a distributed MLlib job.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.spec import col

BOOSTED = ("gbt", "xgb", "gbm")
REGRESSORS = ("rf", *BOOSTED, "dt")
CLASSIFIERS = (*REGRESSORS, "logit")
VECTOR = "_vector"  # the features of a prefix table that ``assembled`` has made ready
# Fits that run at the same time, as long as they hold at most so many values (MLlib caches 4 bytes for
# each binned feature of a row, and for each tree of a forest).
FITS = 4
MAX_VALUES = 2_000_000_000
# Values in a partition that a fit caches: more are spread, and fewer (but for forests, whose bags follow the partitions) gathered.
MOST_VALUES, FEWEST_VALUES = 16_000_000, 1_000_000
# A forest of more rows times trees than that is grown in groups of nodes whose statistics take so many MB, and so stay near the
# processor, not in MLlib's 256.  Trees, depth, rows and bags stay; a node's random features follow the order of the groups.
LARGE_FOREST, GROUP_MB = 100_000_000, 4


def model(name: str, mode: str, params: dict | None = None, seed: int = 22):
    """M1–M4: an MLlib estimator for ``name`` in ``mode`` ('regr' or 'class').

    Parameters use the reference's names (n_estimators, learning_rate, subsample,
    max_depth, max_features, min_child_weight) and are mapped to MLlib's."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    p = dict(params or {})
    kw: dict = {"featuresCol": "features", "labelCol": "label", "seed": seed}
    depth = int(p.get("max_depth", 5))
    trees = int(p.get("n_estimators", 50))
    if name == "rf":
        kw.update(numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(p.get("max_features", "auto")))
        return (R.RandomForestRegressor if mode == "regr" else C.RandomForestClassifier)(**kw)
    if name in BOOSTED:
        kw.update(
            maxIter=trees,
            maxDepth=depth,
            stepSize=float(p.get("learning_rate", 0.1)),
            subsamplingRate=float(p.get("subsample", 1.0)),
            minInstancesPerNode=int(p.get("min_child_weight", 1)),
        )
        if "colsample_bytree" in p:
            kw["featureSubsetStrategy"] = str(float(p["colsample_bytree"]))
        elif "max_features" in p:
            kw["featureSubsetStrategy"] = str(p["max_features"])
        return (R.GBTRegressor if mode == "regr" else C.GBTClassifier)(**kw)
    if name == "dt":
        kw.update(maxDepth=depth)
        return (R.DecisionTreeRegressor if mode == "regr" else C.DecisionTreeClassifier)(**kw)
    if name == "logit" and mode == "class":
        kw.pop("seed")
        return C.LogisticRegression(family="multinomial", maxIter=int(p.get("max_iter", 100)), **kw)
    raise ValueError(f"no model {name!r} for mode {mode!r}")


def class_list(exits) -> list:
    """The classes of a gateway: a list of them, or ``0 .. n-1`` for a number ``n``."""
    return list(range(exits)) if isinstance(exits, int) else list(exits)


# -- small fallbacks (pure aggregation) -------------------------------------------


def mean_predictor(prefixes: DataFrame, regr_labels, class_labels: dict, by: str = "bucket") -> DataFrame:
    """Per ``by`` group, the mean of each regression label and the frequency of each
    class of each gateway (``class_labels``: gateway -> its classes, or their number).  Rows with an undefined
    label do not count (Q8).  Classes never seen get probability 0 (M9)."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_prefixes")]
    for a in regr_labels:
        aggs.append(F.avg(F.col(a)).alias(a))
        aggs.append(F.count(F.col(a)).alias(f"n_{a}"))
    for g, exits in class_labels.items():
        n = F.count(F.col(g))
        aggs.append(n.alias(f"n_{g}"))
        for c in class_list(exits):
            aggs.append((F.count(F.when(F.col(g) == c, F.lit(1))) / F.when(n > 0, n)).alias(f"p_{g}_{c}"))
    return prefixes.groupBy(by).agg(*aggs)


def small_data_fallback(prefixes: DataFrame, label: str, min_cases: int = 30, by: str = "bucket") -> DataFrame:
    """M5: per group, whether fewer than ``min_cases`` labelled prefixes exist (then the mean or the
    class frequencies replace the model) and that mean."""
    g = prefixes.where(F.col(label).isNotNull()).groupBy(by)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("mean"))
    return out.withColumn("use_fallback", F.col("n") < min_cases)


def single_class_fallback(prefixes: DataFrame, label: str, exits, by: str = "bucket") -> DataFrame:
    """M6 / Q18: groups whose labelled prefixes hold one class get that class with probability 1."""
    g = prefixes.where(F.col(label).isNotNull()).groupBy(by)
    one = g.agg(F.count_distinct(label).alias("n_classes"), F.min(label).alias("cls")).where(F.col("n_classes") == 1)
    return one.select(by, *[(F.col("cls") == c).cast("double").alias(f"p_{label}_{c}") for c in class_list(exits)])


def clip_negative(df: DataFrame, name: str) -> DataFrame:
    """M8: negative predictions -> 0 (an undefined prediction stays NULL)."""
    c = F.col(name)
    return df.withColumn(name, F.when(c < 0, F.lit(0.0)).otherwise(c.cast("double")))


def pad_classes(df: DataFrame, label: str, exits, prob_col: str = "probability") -> DataFrame:
    """M9: a probability vector over the classes seen in training -> ``p_{label}_{c}`` for every
    exit ``c`` (missing classes 0)."""
    arr = vector_to_array(F.col(prob_col))
    return df.withColumns(
        {f"p_{label}_{c}": F.coalesce(F.try_element_at(arr, F.lit(c + 1)), F.lit(0.0)) for c in class_list(exits)}
    )


# -- per-bucket fit / predict ------------------------------------------------------


@dataclass
class BucketModel:
    kind: str  # "model" | "ovr" | "mean" | "onehot"
    model: PipelineModel | None = None
    value: float | None = None
    probs: list | None = None
    per_class: list | None = None  # "ovr": one binary pipeline per class (None: class unseen)


@dataclass
class LabelModels:
    label: str
    mode: str
    exits: list = field(default_factory=list)  # the classes
    buckets: dict = field(default_factory=dict)
    features: list = field(default_factory=list)
    fallback: float | list | None = None  # for buckets unseen in training (B4)


def _opaque(df: DataFrame, features) -> DataFrame:
    """The features again under plain names ``_f0``, ``_f1``, ...: MLlib can't read names with dots."""
    return df.withColumns({f"_f{i}": col(f) for i, f in enumerate(features)})


def _assembler(features) -> VectorAssembler:
    """Of the columns that ``_opaque`` adds."""
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features", handleInvalid="keep")


def assembled(prefixes: DataFrame, features) -> DataFrame:
    """The prefix table with one vector (``VECTOR``) in place of its feature columns, for tables that many fits read."""
    names = set(features)
    kept = [c for c in prefixes.columns if c not in names]
    rows = _assembler(features).transform(_opaque(prefixes, features))
    return rows.select(*[col(c).alias(c) for c in kept], F.col("features").alias(VECTOR))


def at_once(fits: list, values: int) -> list:
    """The results of some fits (functions without arguments), each of which caches so many ``values``."""
    with ThreadPoolExecutor(max(1, min(FITS, len(fits), MAX_VALUES // max(1, values)))) as pool:
        return list(pool.map(lambda fit: fit(), fits))


def values_of(n: int, width: int, params) -> int:
    """The values that a fit on ``n`` rows of ``width`` features caches."""
    return n * (width + int((params or {}).get("n_estimators", 0)))


def _grouped(estimator, n: int):
    """The estimator of a forest on ``n`` rows, with the groups of nodes that suit their number."""
    return estimator.setMaxMemoryInMB(GROUP_MB) if n * estimator.getNumTrees() > LARGE_FOREST else estimator


def _sized(rows: DataFrame, n: int, width: int, forest: bool) -> DataFrame:
    """The ``n`` rows of a fit in partitions that one task can hold and that are worth a task."""
    values = n * max(1, width)
    if values > MOST_VALUES:
        parts = math.ceil(values / MOST_VALUES)
        if rows.rdd.getNumPartitions() < parts:
            return rows.repartition(parts)
    return rows if forest else rows.coalesce(max(1, math.ceil(values / FEWEST_VALUES)))


def fit_buckets(
    prefixes: DataFrame,
    label: str,
    mode: str,
    features,
    name: str = "rf",
    params=None,
    min_cases: int = 30,
    exits=0,
    by: str = "bucket",
    seed: int = 22,
) -> LabelModels:
    """M7 with M5/M6: one model per bucket on the prefixes whose ``label`` is defined.

    ``params``: the parameters of all buckets, or a function that gives those of a
    bucket; a ``min_cases`` among them replaces the argument."""
    of_bucket = params if callable(params) else lambda b: params
    exits, features = class_list(exits), list(features)
    data = prefixes.where(F.col(label).isNotNull())
    if features and VECTOR not in data.columns:
        data = assembled(data.select(by, label, *[col(f) for f in features if f not in (by, label)]), features)
    vector = [F.col(VECTOR).alias("features")] if features else []
    data = data.select(by, F.col(label).cast("double").alias("label"), *vector).persist()
    width = data.schema["features"].metadata.get("ml_attr", {}).get("num_attrs", len(features)) if features else 0
    out = LabelModels(label, mode, exits, features=list(features))
    try:
        stats = data.groupBy(by).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("label").alias("mean"),
            F.min("label").alias("lo"),
            F.max("label").alias("hi"),
            *[F.count(F.when(F.col("label") == c, F.lit(1))).alias(f"c{c}") for c in exits],
        ).collect()  # one row per bucket
        total = sum(r["n"] for r in stats)
        if mode == "regr":
            out.fallback = sum((r["mean"] or 0.0) * r["n"] for r in stats) / total if total else None
        else:
            out.fallback = [sum(r[f"c{c}"] for r in stats) / total if total else 0.0 for c in exits]
        todo, large = [], 0

        def fit(b, n, own, c=None):
            rows = data.where(F.col(by) == b)
            if c is not None:
                rows = rows.withColumn("label", (F.col("label") == c).cast("double"))
            estimator = model(name, mode, own, seed)
            if name == "rf":
                estimator = _grouped(estimator, n)
            fitted = estimator.fit(_sized(rows, n, width, name == "rf"))
            return PipelineModel([_assembler(features), fitted])

        for r in stats:
            b = r[by]
            own = dict(of_bucket(b) or {})
            if mode == "class" and r["lo"] == r["hi"]:
                probs = [1.0 if c == int(r["lo"]) else 0.0 for c in exits]
                out.buckets[b] = BucketModel("onehot", probs=probs)
            elif r["n"] < own.get("min_cases", min_cases):
                if mode == "regr":
                    out.buckets[b] = BucketModel("mean", value=r["mean"])
                else:
                    out.buckets[b] = BucketModel("mean", probs=[r[f"c{c}"] / r["n"] for c in exits])
            elif mode == "class" and name in BOOSTED and (len(exits) > 2 or max(exits) > 1):
                # MLlib boosting is binary: one model per exit (one-vs-rest), normalised at prediction
                out.buckets[b] = BucketModel("ovr", per_class=[None] * len(exits))
                todo += [(b, r["n"], own, c) for c in exits if r[f"c{c}"] > 0]
                large = max(large, values_of(r["n"], width, {}))
            else:
                out.buckets[b] = BucketModel("model")
                todo.append((b, r["n"], own, None))
                large = max(large, values_of(r["n"], width, own if name == "rf" else {}))
        fitted = at_once([lambda t=t: fit(*t) for t in todo], large)
        for (b, _, _, c), m in zip(todo, fitted):
            if c is None:
                out.buckets[b].model = m
            else:
                out.buckets[b].per_class[exits.index(c)] = m
    finally:
        data.unpersist()
    return out


def _const_cols(lm: LabelModels, by: str, constants: dict) -> dict:
    """The outputs of buckets with a constant, by a literal map; those of others are the fallback."""
    names = [f"pred_{lm.label}"] if lm.mode == "regr" else [f"p_{lm.label}_{c}" for c in lm.exits]
    out = {}
    for i, name in enumerate(names):
        fallback = lm.fallback if lm.mode == "regr" or lm.fallback is None else lm.fallback[i]
        value = F.lit(None if fallback is None else float(fallback)).cast("double")
        pairs = [x for b, v in constants.items() for x in (F.lit(b), F.lit(float(v if lm.mode == "regr" else v[i])))]
        out[name] = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(by)), value) if pairs else value
    return out


def predict_buckets(prefixes: DataFrame, lm: LabelModels, id_cols=("case_id", "prefix_len"), by: str = "bucket") -> DataFrame:
    """M7 (predict) with B4: per bucket the model, the fallback mean / frequencies, or - for
    buckets unseen in training - the label's overall training mean / class ratio."""
    ready = VECTOR in prefixes.columns
    if ready:
        prefixes = prefixes.withColumnRenamed(VECTOR, "features")
    elif lm.features:
        prefixes = _opaque(prefixes, lm.features)
    score = lambda pm, rows: (pm.stages[-1] if ready else pm).transform(rows)
    inputs = ["features"] if ready else [f"_f{i}" for i in range(len(lm.features))]
    parts, constants = [], {}
    known = list(lm.buckets)
    for b, bm in lm.buckets.items():
        sub = prefixes.where(F.col(by) == b)
        if bm.kind == "ovr":
            scored = sub.select(*id_cols, *inputs)
            raw = []
            for c, pm in zip(lm.exits, bm.per_class):
                if pm is None:
                    scored = scored.withColumn(f"_s{c}", F.lit(0.0))
                else:
                    t = score(pm, scored).withColumn(f"_s{c}", vector_to_array("probability")[1])
                    scored = t.drop("rawPrediction", "probability", "prediction", *([] if ready else ["features"]))
                raw.append(F.col(f"_s{c}"))
            total = sum(raw, F.lit(0.0))
            cols = {f"p_{lm.label}_{c}": F.when(total > 0, r / total).otherwise(F.lit(1.0 / len(raw))) for c, r in zip(lm.exits, raw)}
            parts.append(scored.withColumns(cols).select(*id_cols, *cols))
        elif bm.kind == "model":
            pred = score(bm.model, sub)
            if lm.mode == "regr":
                pred = pred.withColumn(f"pred_{lm.label}", F.col("prediction"))
                cols = [f"pred_{lm.label}"]
            else:
                pred = pad_classes(pred, lm.label, lm.exits)
                cols = [f"p_{lm.label}_{c}" for c in lm.exits]
            parts.append(pred.select(*id_cols, *cols))
        else:
            constants[b] = bm.value if lm.mode == "regr" else bm.probs
    # one pass for all buckets without a model
    chosen = F.col(by).isin(list(constants)) if constants else F.lit(False)
    if lm.fallback is not None or not lm.buckets:
        chosen = chosen | ~F.col(by).isin(known) if known else F.lit(True)
    if constants or lm.fallback is not None or not lm.buckets:
        parts.append(prefixes.where(chosen).select(*id_cols, *[c.alias(n) for n, c in _const_cols(lm, by, constants).items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if lm.mode == "regr":
        out = clip_negative(out, f"pred_{lm.label}")
    return out


def calibrate(val_pred: DataFrame, test_pred: DataFrame, label: str, exits, sigmoid_below: int = 5000) -> DataFrame:
    """Per class, map the predicted probability to the observed frequency on a validation
    set - sigmoid (logistic) below ``sigmoid_below`` rows, isotonic above - then renormalise."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import IsotonicRegression

    n, exits = val_pred.count(), class_list(exits)
    out = test_pred
    for c in exits:
        p = f"p_{label}_{c}"
        train = VectorAssembler(inputCols=[p], outputCol="features").transform(
            val_pred.select(p, (F.col(label) == c).cast("double").alias("y"))
        )
        test_v = VectorAssembler(inputCols=[p], outputCol="features").transform(out)
        if n < sigmoid_below:
            m = LogisticRegression(featuresCol="features", labelCol="y", maxIter=50).fit(train)
            out = m.transform(test_v).withColumn(p, vector_to_array("probability")[1])
        else:
            m = IsotonicRegression(featuresCol="features", labelCol="y").fit(train)
            out = m.transform(test_v).withColumn(p, F.col("prediction"))
        out = out.drop("features", "rawPrediction", "probability", "prediction")
    total = sum((F.col(f"p_{label}_{c}") for c in exits), F.lit(0.0))
    return out.withColumns({f"p_{label}_{c}": F.when(total > 0, F.col(f"p_{label}_{c}") / total).when(total == 0, F.lit(1.0 / len(exits))) for c in exits})


def save_models(lm: LabelModels, path: str) -> None:
    """Each bucket's pipeline under ``path``; fallbacks and metadata as JSON."""
    import json

    from pyspark.sql import SparkSession

    meta = {"label": lm.label, "mode": lm.mode, "exits": lm.exits, "features": lm.features, "fallback": lm.fallback, "buckets": {}}
    for b, bm in lm.buckets.items():
        entry = {"kind": bm.kind, "value": bm.value, "probs": bm.probs}
        if bm.kind == "model":
            bm.model.write().overwrite().save(f"{path}/bucket={b}")
        if bm.kind == "ovr":
            entry["classes"] = [pm is not None for pm in bm.per_class]
            for c, pm in enumerate(bm.per_class):
                if pm is not None:
                    pm.write().overwrite().save(f"{path}/bucket={b}/class={c}")
        meta["buckets"][str(b)] = entry
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_models(path: str) -> LabelModels:
    """Inverse of ``save_models``."""
    import json

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    lm = LabelModels(meta["label"], meta["mode"], meta["exits"], features=meta["features"], fallback=meta["fallback"])
    for b, e in meta["buckets"].items():
        bm = BucketModel(e["kind"], value=e["value"], probs=e["probs"])
        if bm.kind == "model":
            bm.model = PipelineModel.load(f"{path}/bucket={b}")
        if bm.kind == "ovr":
            bm.per_class = [PipelineModel.load(f"{path}/bucket={b}/class={c}") if ok else None for c, ok in enumerate(e["classes"])]
        lm.buckets[int(b)] = bm
    return lm


def feature_importance(lm: LabelModels, bucket) -> DataFrame:
    """Importance of each feature in a tree model (one row per feature)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    est = lm.buckets[bucket].model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(lm.features, [float(x) for x in imp])), "feature string, importance double")
