"""Scoring bundles (R1, R2, M11): everything that scoring a running case needs, in one versioned folder.

A bundle holds the column roles (``LogSpec``), the frozen vocabulary, the encoding with its
number of event positions, the bucketing, and the models of one or more labels with
their fallbacks.  ``save`` writes version after version into a folder::

    <path>/v=<n>/label=<i>/...   the models of a label
    <path>/v=<n>/meta            JSON; written last, so a version without it does not count

``load`` reads the newest complete version, or the one asked for.  Loaded bundles give the
predictions of the fitted ones, in batch (``score_cases``) and on a stream
(``score_prefixes`` inside ``foreachBatch``).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.operators import encode as E
from procmon.operators import flow as FL
from procmon.operators import models as M
from procmon.spec import LogSpec

DIRECT = "remtime"


@dataclass
class Bundle:
    spec: LogSpec
    vocab: E.Vocab
    method: str
    bucket: str = "prefix"
    max_events: int = 0
    models: dict = field(default_factory=dict)  # label -> LabelModels

    def encode(self, events: DataFrame, **options) -> DataFrame:
        """The prefixes of a log as the models were trained on them, with their buckets."""
        rows = E.encode(events, self.spec, self.vocab, self.method, max_events=self.max_events, **options)
        return self.with_bucket(rows)

    def with_bucket(self, prefixes: DataFrame) -> DataFrame:
        return E.bucket_zero(prefixes) if self.bucket == "zero" else E.bucket_prefix(prefixes)


def fit(log: DataFrame, spec: LogSpec, cfg: FL.FlowConfig) -> Bundle:
    """A bundle of direct remaining-time models on all prefixes of a log (which has ``remtime``)."""
    vocab, method = (E.Vocab({}), "none") if cfg.model == "mean" else (E.fit_vocab(log, spec.cat_cols), cfg.encoding)
    out = Bundle(spec, vocab, method, cfg.bucket, FL.index_events(log, spec, cfg) if "index" in E.METHODS[method] else 0)
    train = out.encode(log, min_len=cfg.min_len, max_len=cfg.max_len, keep=(DIRECT,))
    # a mean model is one whose every bucket has too few cases for another
    name, least = ("dt", 1 << 62) if cfg.model == "mean" else (cfg.model, cfg.min_cases)
    out.models[DIRECT] = M.fit_buckets(train, DIRECT, "regr", E.feature_names(train), name, FL.params_of(cfg, DIRECT), least)
    return out


# -- persistence ------------------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a folder, oldest first."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(v for v in found if fs.exists(jvm.Path(f"{path}/v={v}/meta/_SUCCESS")))


def save(bundle: Bundle, path: str) -> int:
    """Write the bundle as the next version of a folder; returns its number."""
    spark = SparkSession.getActiveSession()
    version = (_versions(spark, path) or [0])[-1] + 1
    base = f"{path}/v={version}"
    labels = list(bundle.models)
    for i, label in enumerate(labels):
        M.save_models(bundle.models[label], f"{base}/label={i}")
    meta = {"labels": labels, "spec": asdict(bundle.spec), "vocab": {c: list(v) for c, v in bundle.vocab.levels.items()}}
    meta |= {k: getattr(bundle, k) for k in ("method", "bucket", "max_events")}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{base}/meta")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Bundle:
    """The newest complete version of a folder, or the one asked for."""
    known = _versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"{path} has no complete version {version if version is not None else ''}")
    base = f"{path}/v={known[-1] if version is None else version}"
    meta = json.loads(spark.read.text(f"{base}/meta").first()[0])
    spec = LogSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["spec"].items()})
    vocab = E.Vocab({c: tuple(v) for c, v in meta["vocab"].items()})
    models = {label: M.load_models(f"{base}/label={i}") for i, label in enumerate(meta["labels"])}
    return Bundle(spec, vocab, meta["method"], meta["bucket"], meta["max_events"], models)


# -- scoring ------------------------------------------------------------------------


def score_prefixes(bundle: Bundle, prefixes: DataFrame, label: str = DIRECT) -> DataFrame:
    """(case_id, nr_events, predicted) of encoded prefixes: rounded to 3 digits, never
    negative; NULL for prefixes in a bucket that no model was trained for."""
    lm = bundle.models[label]
    rows = bundle.with_bucket(prefixes) if "bucket" not in prefixes.columns else prefixes
    seen = F.col("bucket").isin(list(lm.buckets)) if lm.buckets else F.lit(False)
    known = rows.select(F.col(f"`{bundle.spec.case}`").alias("case_id"), "prefix_len", "bucket", *(F.col(f"`{f}`") for f in lm.features))
    scored = M.predict_buckets(known.where(seen), lm).select("case_id", "prefix_len", F.round(f"pred_{label}", 3).alias("predicted"))
    other = known.where(~seen).select("case_id", "prefix_len", F.lit(None).cast("double").alias("predicted"))
    return scored.unionByName(other).withColumnRenamed("prefix_len", "nr_events")


def score_cases(bundle: Bundle, events: DataFrame, label: str = DIRECT) -> DataFrame:
    """The prediction of every running case from all its events so far."""
    rows = bundle.encode(events, min_len=1, max_len=None, strict=False)
    return score_prefixes(bundle, rows.where(F.col("prefix_len") == F.col("_case_len")).drop("_case_len"), label)
