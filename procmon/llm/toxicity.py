"""Toxicity by compression distance with two zstandard dictionaries.

Training takes a bounded sample of labelled documents (about ``toxic_docs`` and
``ordinary_docs``, picked by a hash of the id; whole texts).  Two thirds of it
give the dictionaries: the ordinary one holds the words that most ordinary
documents use; the toxic one holds the same ordinary base, preceded by the word
beginnings that are far more common in toxic documents than in ordinary ones.  So
the two differ only by what marks toxic text, and a window that compresses
better with the toxic dictionary holds some of it.  The remaining third
calibrates: a logistic curve over a document's mean and largest gain in bytes and
its share and number of clear windows.

Scoring cuts the whole text into windows of about ``WINDOW`` bytes at spaces,
compresses each with both dictionaries and turns the gains into a probability.

Null and empty texts get the score of a text without gains.  If one of the two
labels is missing from the training rows, every score is the share of toxic rows.
Repeated rows give repeated results; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import crc_bucket, slices, texts

WINDOW = 96
TOXIC_DOCS = 2400
ORDINARY_DOCS = 4800
BASE_BYTES = 110_000
TOXIC_BYTES = 16_000
CONTRAST = 20.0  # how many times as common a word beginning is in toxic documents
MIN_TOXIC = 3  # documents
CLEAR = 4  # bytes of gain
BEGINNINGS = (4, 5, 6, 8, 12)  # bytes
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The lower-cased text in windows that end at the first space after ``size`` bytes."""
    raw = b" " + text.lower().encode()
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        out.append(raw[at:end])
        at = end
    return out


def segments(text: str) -> tuple[set[bytes], set[bytes]]:
    """The distinct words of a text and their beginnings."""
    words = set(_WORD.findall(text.lower().encode()))
    return words, {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def compressors(self) -> tuple:
        import zstandard as zs

        # a deep search over long matches only: what counts is whether a marked beginning is found
        params = zs.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=32, strategy=zs.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for content in (self.ordinary, self.toxic):
            dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            out.append(zs.ZstdCompressor(dict_data=dictionary, compression_params=params))
        return tuple(out)

    def features(self, docs: list[str], compressors: tuple) -> np.ndarray:
        """Mean gain, largest gain, share and number (log) of clear windows, and 1 for each text."""
        ordinary, toxic = (c.compress for c in compressors)
        out = np.zeros((len(docs), 5))
        out[:, 4] = 1
        for i, t in enumerate(docs):
            if t:
                gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(t)])
                clear = gain >= CLEAR
                out[i, :4] = gain.mean(), gain.max(), clear.mean(), np.log1p(clear.sum())
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([*[ridge] * (x.shape[1] - 1), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> Model:
    """Learn from the documents that ``labels`` (id, 0/1) names; give only rows that may be learned from."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return Model(weights=np.array([0, 0, 0, 0, np.log((share + 1e-6) / (1 - share + 1e-6))]))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "k"), F.lit(1_000_000)) / 1_000_000
    limit = F.when(F.col("y") == 1, toxic_docs / counts[1]).otherwise(ordinary_docs / counts[0])
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "k"), F.lit(3))
    sample = F.broadcast(known.where(draw < limit).withColumn("part", part))  # about toxic_docs + ordinary_docs rows
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null").join(sample, "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(y, whole): Counter() for y in (0, 1) for whole in (False, True)}
        n = Counter()
        for b in slices(batches, "t"):
            for t, y in zip(texts(b, "t").to_pylist(), b.column("y").to_pylist(), strict=True):
                words, starts = segments(t)
                n[y] += 1
                found[y, False].update(starts)
                if y == 0:
                    found[y, True].update(words)
        for (y, whole), c in found.items():
            c = c | {b"": n[y]} if not whole else c  # the empty beginning counts the documents
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([whole] * len(c), pa.bool_()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["s", "whole", "y", "n"])

    counted = rows.where("part > 0").select("t", "y").mapInArrow(count, "s binary, whole boolean, y int, n long").groupBy("s", "whole").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("tox"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("ord"))
    total = counted.where("not whole and length(s) = 0").first()
    n_tox, n_ord = (total["tox"], total["ord"]) if total else (0, 0)
    marked = counted.where(f"not whole and length(s) > 0 and tox >= {MIN_TOXIC}").where((F.col("tox") / max(1, n_tox) > CONTRAST * (F.col("ord") + 0.5) / max(1, n_ord)) & (F.col("tox") > 0.004 * n_tox)).orderBy(F.col("tox").desc(), "s").limit(TOXIC_BYTES // 4)
    common = counted.where("whole").orderBy(F.col("ord").desc(), "s").limit(BASE_BYTES // 4)
    chosen = {bytes(r[0]): r[1] for r in marked.select("s", "tox").collect()}
    longest = [s for s in chosen if not any(len(o) > len(s) and o.startswith(s) for o in chosen)]
    base = b"".join(b" " + bytes(r[0]) for r in reversed(common.select("s").collect()))[-BASE_BYTES:]
    marks = b"".join(b" " + s for s in sorted(longest, key=lambda s: (chosen[s], s)))[-TOXIC_BYTES:]
    model = Model(ordinary=base or b" " * 8, toxic=marks + base or b" " * 8)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for b in slices(batches, "t"):
            f = model.features(texts(b, "t").to_pylist(), pair)
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(c) for c in f[:, :4].T)], ["y", "a", "b", "c", "d"])

    measured = rows.where("part = 0").select("t", "y").mapInArrow(measure, "y int, a double, b double, c double, d double").toPandas()
    x = np.column_stack([measured[["a", "b", "c", "d"]].to_numpy(float), np.ones(len(measured))])
    y = measured["y"].to_numpy(float)
    if len(set(y.tolist())) == 2:
        model.weights = logistic(x, y)
    else:  # too few rows to calibrate: one clear window decides
        model.weights = np.array([0.0, 2.0, 0.0, 0.0, -2.0 * CLEAR + 1])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, predicted) of every row, and the columns in ``carry`` as ``carry_<name>``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BASE_BYTES and TOXIC_BYTES
    rows = docs.select(F.col(id_col).alias("k"), *(F.col(c).alias(f"carry_{c}") for c in carry), F.col(text_col).alias("t"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pair = own.compressors() if own.toxic else None
        for b in slices(batches, "t"):
            docs_ = texts(b, "t").to_pylist()
            f = own.features(docs_, pair) if pair else np.tile([0.0, 0, 0, 0, 1], (len(docs_), 1))
            p = own.probability(f)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", score double, predicted int"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", id_col)


def learned_from(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: crc32 of the id modulo 5 is not 0."""
    return labels.where(crc_bucket(id_col, 5) != 0)
