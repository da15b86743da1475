"""Ensembles as data (M7, F1): the models of all labels and buckets scored in one pass.

A fitted tree, forest or boosted ensemble becomes rows of a node table::

    (model, tree, node, feature, threshold, left, right, value)

``feature`` is -1 at a leaf, ``left`` / ``right`` are node numbers of the same tree, and ``value``
holds the prediction (regression, boosting) or the class frequencies of a leaf.  ``score`` sends
the tables of every label and bucket to the executors and evaluates them on Arrow batches of one
encoded frame: no filter, union or join per bucket or label, and one encoding whatever their number.

The nodes of one pass are counted first and broadcast only up to ``max_nodes``; labels beyond that
are scored in further passes over the written frame, and a label too large for a pass of its own by
``models.predict_buckets``.  An empty frame gives an empty result; null features count as NaN,
which goes right at every split as in MLlib; a null or unseen bucket gets the label's fallback.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from procmon.operators import models as M
from procmon.session import scratch_path
from procmon.spec import col

# Nodes that one pass broadcasts: about 56 bytes each, and 8 more for every class.
MAX_NODES = 4_000_000
# Jobs that write models at the same time.
WRITERS = 8
NODES = "model int, tree int, node int, feature int, threshold double, left int, right int, value array<double>"


def estimators(lm: M.LabelModels) -> list:
    """The fitted estimators of a label: ``(bucket, class or None, estimator)``."""
    out = []
    for b, bm in lm.buckets.items():
        if bm.kind == "model":
            out.append((b, None, bm.model.stages[-1]))
        elif bm.kind == "ovr":
            out += [(b, c, pm.stages[-1]) for c, pm in zip(lm.exits, bm.per_class) if pm is not None]
    return out


def _is_linear(est) -> bool:
    return hasattr(est, "coefficientMatrix")


def _nodes(est) -> int:
    if _is_linear(est):
        return int(est.coefficientMatrix.numRows * est.coefficientMatrix.numCols)
    return int(est.totalNumNodes if hasattr(est, "totalNumNodes") else est.numNodes)


def label_size(lm: M.LabelModels) -> int:
    """The nodes (or coefficients) of a label's models."""
    return sum(_nodes(est) for _, _, est in estimators(lm))


def _votes(est) -> bool:
    """Whether leaves give class frequencies (trees and forests of classes), not a number."""
    return type(est).__name__ in ("DecisionTreeClassificationModel", "RandomForestClassificationModel")


def node_table(spark: SparkSession, ests: list) -> DataFrame:
    """The nodes of tree models, from the folders that they are saved to; ``model`` is the position in ``ests``."""
    base = scratch_path(spark, "nodes")

    def write(i):
        ests[i].write().overwrite().save(f"{base}/m{i}")

    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(write, range(len(ests))))
    votes = [i for i, e in enumerate(ests) if _votes(e)]
    parts = []
    for single in (True, False):
        own = [i for i, e in enumerate(ests) if (not hasattr(e, "treeWeights")) == single]
        if not own:
            continue
        rows = spark.read.parquet(*[f"{base}/m{i}/data" for i in own])
        node = (lambda c: F.col(c)) if single else (lambda c: F.col(f"nodeData.{c}"))
        number = F.regexp_extract(F.input_file_name(), r"/m(\d+)/data/", 1).cast("int")
        leaf = node("leftChild") < 0
        value = F.when(number.isin(votes), node("impurityStats")).otherwise(F.array(node("prediction"))) if votes else F.array(node("prediction"))
        parts.append(
            rows.select(
                number.alias("model"),
                (F.lit(0) if single else F.col("treeID")).cast("int").alias("tree"),
                node("id").alias("node"),
                F.when(leaf, F.lit(-1)).otherwise(node("split.featureIndex")).alias("feature"),
                F.when(~leaf, F.try_element_at(node("split.leftCategoriesOrThreshold"), F.lit(1))).alias("threshold"),
                node("leftChild").alias("left"),
                node("rightChild").alias("right"),
                value.alias("value"),
            )
        )
    if not parts:
        return spark.createDataFrame([], NODES)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass
class Trees:
    """Trees of one model as arrays: the root of each, and per node its split and its value."""

    kind: str  # mean | sum | votes
    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of values: the mean of the trees, their weighted sum, or class probabilities."""
        rows = np.arange(len(x))
        total = np.zeros((len(x), self.value.shape[1]))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            total += weight * self.value[at]
        if self.kind == "mean":
            return total / len(self.roots)
        return _normalised(total) if self.kind == "votes" else total

    def within(self, x: np.ndarray, sizes: list) -> np.ndarray:
        """(size, row, value): what the forests within this one give, each of the first ``trees`` cut at a depth.

        A cut tree is the one that MLlib grows to that depth on the same bag with the same draws of features: its last
        leaves are merged as MLlib merges them."""
        depths = sorted({d for _, d in sizes})
        ends = {d: self._cut(d) for d in depths}
        rows = np.arange(len(x))
        total = {d: np.zeros((len(x), self.value.shape[1])) for d in depths}
        out = np.empty((len(sizes), len(x), self.value.shape[1]))
        for t, (root, weight) in enumerate(zip(self.roots, self.weights), 1):
            at = np.full(len(x), root)
            for d in range(depths[-1] + 1):
                if d in ends:
                    total[d] += weight * self.value[ends[d][at]]
                f = self.feature[at]
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f >= 0, np.where(goes_left, self.left[at], self.right[at]), at)
            for i, (trees, d) in enumerate(sizes):
                if trees == t:
                    out[i] = _normalised(total[d]) if self.kind == "votes" else total[d] / t
        return out

    def _cut(self, depth: int) -> np.ndarray:
        """For each node down to a depth, the node that ends its way in the trees cut there."""
        level = [self.roots]
        while len(level) <= depth:
            inner = level[-1][self.feature[level[-1]] >= 0]
            level.append(np.concatenate([self.left[inner], self.right[inner]]))
        end = np.arange(len(self.feature))
        if self.kind != "votes":  # leaves are merged if they predict the same, which a number shows as before
            return end
        best = self.value.argmax(axis=1)
        leaf = self.feature < 0
        leaf[level[depth]] = True
        for nodes in level[depth - 1 :: -1] if depth else []:
            inner = nodes[~leaf[nodes]]
            left, right = self.left[inner], self.right[inner]
            leaf[inner[leaf[left] & leaf[right] & (best[left] == best[right])]] = True
        for nodes in level[:depth]:
            merged = nodes[leaf[nodes] & (self.feature[nodes] >= 0)]
            for child in (self.left[merged], self.right[merged]):
                end[child] = end[merged]
                leaf[child] = True
        return end


@dataclass
class Linear:
    """A multinomial logistic model."""

    weights: np.ndarray
    intercept: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m = x @ self.weights.T + self.intercept
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _normalised(v: np.ndarray) -> np.ndarray:
    total = v.sum(axis=1, keepdims=True)
    return np.divide(v, total, out=v.copy(), where=total != 0)


@dataclass
class Scorer:
    """One label in all buckets: constants, or models with the class that each speaks for."""

    label: str
    mode: str
    exits: list
    features: list
    fallback: list | None
    constants: dict = field(default_factory=dict)  # bucket -> a value per output
    models: dict = field(default_factory=dict)  # bucket -> [(class or None, Trees or Linear)]

    @property
    def names(self) -> list[str]:
        return [f"pred_{self.label}"] if self.mode == "regr" else [f"p_{self.label}_{c}" for c in self.exits]

    def within(self, b, x: np.ndarray, sizes: list) -> np.ndarray:
        """(output, row, size): ``bucket`` for the forests within the one of a bucket."""
        if b not in self.models:
            return np.repeat(self.bucket(b, x).T[:, :, None], len(sizes), axis=2)
        v = self.models[b][0][1].within(x, sizes)
        own = range(1) if self.mode == "regr" else self.exits
        return np.stack([v[:, :, c].T if c < v.shape[2] else np.zeros((len(x), len(sizes))) for c in own])

    def bucket(self, b, x: np.ndarray) -> np.ndarray:
        """A column per output for the rows of one bucket (NaN: no prediction)."""
        if b not in self.models:
            value = self.constants.get(b, self.fallback)
            return np.tile(np.array([np.nan if v is None else v for v in value or [None] * len(self.names)], dtype=float), (len(x), 1))
        parts = self.models[b]
        if self.mode == "regr":
            return parts[0][1](x)
        if parts[0][0] is None:
            p = parts[0][1](x)
            if p.shape[1] == 1:  # the margin of two boosted classes
                p = _boosted(p)
            return np.column_stack([p[:, c] if c < p.shape[1] else np.zeros(len(x)) for c in self.exits])
        raw = np.zeros((len(x), len(self.exits)))
        for c, trees in parts:
            raw[:, self.exits.index(c)] = _boosted(trees(x))[:, 1]
        return np.where(raw.sum(axis=1, keepdims=True) > 0, _normalised(raw), 1.0 / len(self.exits))


def _boosted(margin: np.ndarray) -> np.ndarray:
    """Probabilities of two boosted classes: logistic loss on labels of -1 and 1."""
    zero = 1.0 / (1.0 + np.exp(2.0 * margin))
    return np.column_stack([zero, 1.0 - zero])


def compile_models(spark: SparkSession, labels: list) -> list[Scorer]:
    """Scorers of several labels; the nodes of all their trees are read in one go."""
    found = [(k, b, c, est) for k, lm in enumerate(labels) for b, c, est in estimators(lm)]
    trees = [f for f in found if not _is_linear(f[3])]
    out = []
    for lm in labels:
        fallback = lm.fallback if lm.mode == "class" else [lm.fallback]
        s = Scorer(lm.label, lm.mode, list(lm.exits), list(lm.features), fallback)
        for b, bm in lm.buckets.items():
            if bm.kind not in ("model", "ovr"):
                s.constants[b] = [bm.value] if lm.mode == "regr" else list(bm.probs)
            elif bm.kind == "ovr" and not any(bm.per_class):
                s.constants[b] = [1.0 / len(lm.exits)] * len(lm.exits)
        out.append(s)
    nodes = node_table(spark, [f[3] for f in trees]).toPandas().sort_values(["model", "tree", "node"]) if trees else None  # at most max_nodes
    by_model = dict(tuple(nodes.groupby("model"))) if trees else {}
    for i, (k, b, c, est) in enumerate(trees):
        out[k].models.setdefault(b, []).append((c, _arrays(by_model[i], est)))
    for k, b, c, est in found:
        if _is_linear(est):
            out[k].models[b] = [(c, Linear(est.coefficientMatrix.toArray(), est.interceptVector.toArray()))]
    return out


def _arrays(nodes, est) -> Trees:
    """The arrays of one model from its nodes, in order of tree and node."""
    tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    start = np.repeat(first, np.diff(np.r_[first, len(tree)]))
    value = np.array(nodes["value"].tolist(), dtype=float)
    kind, weights = "mean", np.ones(len(first))
    if _votes(est):
        kind, value = "votes", _normalised(value)
    elif "GBT" in type(est).__name__:
        kind, weights = "sum", np.array(est.treeWeights, dtype=float)
    # nodes of a tree are numbered from 0 without gaps, so a child's row is its tree's start and its number
    return Trees(
        kind, first, weights, nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(dtype=float),
        start + nodes["left"].to_numpy(), start + nodes["right"].to_numpy(), value,
    )


def _passes(labels: list, max_nodes: int) -> tuple[list[list], list]:
    """Labels in passes of at most ``max_nodes`` nodes, and those too large for any."""
    passes, large, room = [], [], 0
    for lm in labels:
        n = label_size(lm)
        if n > max_nodes:
            large.append(lm)
            continue
        if not passes or n > room:
            passes.append([])
            room = max_nodes
        passes[-1].append(lm)
        room -= n
    return passes, large


def score(prefixes: DataFrame, labels: list, id_cols=("case_id", "prefix_len"), by: str = "bucket", keep=(), max_nodes: int = MAX_NODES) -> DataFrame:
    """M7 / F1: ``id_cols``, ``keep`` and the ``pred_<label>`` / ``p_<label>_<class>`` columns of all labels, a row per prefix.

    Equal to joining ``models.predict_buckets`` of each label, negative predictions set to 0 (M8)."""
    spark = prefixes.sparkSession
    passes, large = _passes(labels, max_nodes)
    features = list(dict.fromkeys(f for lm in labels for f in lm.features))
    out = _numbers(prefixes, features, id_cols, by, keep)
    if large:  # several readers: the encoding is written once
        path = scratch_path(spark, "scored")
        out.write.parquet(path)
        out = spark.read.parquet(path)
    rows = out
    for group in passes:  # one after the other over the same rows, without a shuffle
        out = _score_pass(out, compile_models(spark, group), features)
    for lm in large:
        own = [F.col("_x")[features.index(f)].alias(f) for f in lm.features]
        part = rows.select(*[col(c) for c in id_cols], F.col("_bucket").alias(by), *own)
        out = out.join(M.predict_buckets(part, lm, id_cols, by), list(id_cols), "left")
    return out.drop("_bucket", "_x")


def score_within(prefixes: DataFrame, labels: list, sizes: list, id_cols=("case_id", "prefix_len"), by: str = "bucket", keep=(), max_nodes: int = MAX_NODES) -> DataFrame:
    """``score`` for the forests within the ones of ``labels``, a row per prefix and pair (trees, depth) of ``sizes``, whose place is ``_set``.

    The trees of a forest are independent, and one that is cut at a depth is the tree of that depth; so a forest holds
    all that have fewer trees or levels, and one pass over its nodes scores them all.
    ``prefixes`` may hold the features as one vector.  No label may have more than ``max_nodes`` nodes."""
    passes, large = _passes(labels, max_nodes)
    if large:
        raise ValueError(f"more than {max_nodes} nodes: {[lm.label for lm in large]}")
    features = list(dict.fromkeys(f for lm in labels for f in lm.features))
    rows = _numbers(prefixes, features, id_cols, by, keep)
    first, names = [c for c in rows.columns if c not in ("_bucket", "_x")], []
    for group in passes:
        scorers = compile_models(prefixes.sparkSession, group)
        names += [n for s in scorers for n in s.names]
        rows = _score_pass(rows, scorers, features, sizes)
    rows = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(sizes))])).alias("_set"))
    return rows.select(*[col(c) for c in first], "_set", *[col(n)[F.col("_set")].alias(n) for n in names])


def _numbers(prefixes: DataFrame, features: list, id_cols, by: str, keep) -> DataFrame:
    """The ids and kept columns of prefixes, their buckets as ``_bucket`` and their features as ``_x``."""
    ids = list(dict.fromkeys([*id_cols, *keep]))
    x = vector_to_array(F.col(M.VECTOR)) if M.VECTOR in prefixes.columns else F.array(*[col(f).cast("double") for f in features]).cast("array<double>")
    return prefixes.select(*[col(c).alias(c) for c in ids], col(by).alias("_bucket"), x.alias("_x"))


def _score_pass(rows: DataFrame, scorers: list[Scorer], features: list, sizes: list | None = None) -> DataFrame:
    """Append the outputs of some labels to every row of a frame with ``_bucket`` and ``_x``; with ``sizes``, one array of each output."""
    kind = DoubleType() if sizes is None else ArrayType(DoubleType())
    schema = StructType([*rows.schema.fields, *[StructField(n, kind) for s in scorers for n in s.names]])
    place = {f: i for i, f in enumerate(features)}
    columns = [[place[f] for f in s.features] for s in scorers]
    sent = rows.sparkSession.sparkContext.broadcast((scorers, columns))

    def scored(batches):
        scorers, columns = sent.value
        for batch in batches:
            n = batch.num_rows
            x = batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy(zero_copy_only=False).reshape(n, len(place))
            buckets = np.array(batch.column(batch.schema.get_field_index("_bucket")).to_pylist(), dtype=object)
            at = {b: np.flatnonzero(buckets == b) if b is not None else np.flatnonzero([v is None for v in buckets]) for b in set(buckets)}
            arrays = list(batch.columns)
            for s, own in zip(scorers, columns):
                if sizes is not None:
                    values = np.full((len(s.names), n, len(sizes)), np.nan)
                    for b, rows_of in at.items():
                        values[:, rows_of] = s.within(b, x[np.ix_(rows_of, own)], sizes)
                    if s.mode == "regr":
                        values = np.where(values < 0, 0.0, values)
                    starts = pa.array(np.arange(n + 1, dtype=np.int32) * len(sizes))
                    arrays += [pa.ListArray.from_arrays(starts, pa.array(v.ravel(), pa.float64(), from_pandas=True)) for v in values]
                    continue
                values = np.full((n, len(s.names)), np.nan)
                for b, rows_of in at.items():
                    values[rows_of] = s.bucket(b, x[np.ix_(rows_of, own)])
                if s.mode == "regr":
                    values = np.where(values < 0, 0.0, values)
                arrays += [pa.array(v, pa.float64(), from_pandas=True) for v in values.T]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(scored, schema)
