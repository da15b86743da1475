"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of a bounded sample of labelled documents (at most
about ``per_language`` documents of each language, picked by a hash of the id;
whole texts).  An n-gram belongs to every language in which it is at least
``ratio`` times as frequent as in the language where it is most frequent.  All
languages share one Bloom filter whose cells hold a bit for each language: the
bitwise and of an n-gram's cells gives all languages that hold it.  Beyond 64
languages the filter has a further slice, with cells of its own, for each 64.

Prediction counts, for each language, the n-grams of the whole text whose mask
has the language's bit, takes off the hits that the filter's false-positive rate
explains, and picks the largest count (ties: the first language in order).  The
score is the share of the text's n-grams that the language holds.

A text is lower-cased, and each run of other characters than letters becomes one
space; n-grams take in the spaces at word ends.  Texts that are null or hold no
letter give ``und`` with score 0, as does every text if nothing was learned.
Texts in a script that no language has get the first language with score 0.
Null labels and null ids are not learned from.  Repeated rows give repeated
results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import crc_bucket, slices, texts

N = 3
HASHES = 3
CELLS_PER_GRAM = 16
PER_LANGUAGE = 4000
MAX_GRAMS = 400_000
UND = "und"
SLICE = 64  # languages whose bits share a cell

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters (made once in a worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the text that each is from, and whether each text has a letter."""
    # each text is led by a line feed, which stands for the space before its first word
    lowered = [d.lower() for d in docs]
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(docs))
    code = np.frombuffer("".join("\n" + t for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(docs)), lengths)
    letter = _letters()[code]
    has = np.bincount(owner[letter], minlength=len(docs)) > 0
    code = np.where(letter, code, 32)
    head = np.zeros(len(code), bool)
    head[np.cumsum(lengths) - lengths] = True
    keep = letter | head
    keep[1:] |= letter[:-1]  # the first space after a word
    code, owner, head = code[keep].astype(np.uint64), owner[keep], head[keep]
    n = len(code) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(N):
            h = h * np.uint64(0x100000001B3) + code[i : i + n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    same = owner[:n] == owner[N - 1 :]
    return h[same], owner[:n][same], has


@dataclass
class Model:
    languages: list[str]
    cells: np.ndarray  # one bit of a cell for each of the first 64 languages
    false_positive: np.ndarray
    further: tuple[np.ndarray, ...] = ()  # the same for each 64 languages beyond

    def masks(self, hashes: np.ndarray, part: int = 0) -> np.ndarray:
        """The languages of a slice that hold each n-gram, as bits."""
        cells = self.further[part - 1] if part else self.cells
        at = places(hashes, len(cells))
        out = cells[at[0]]
        for a in at[1:]:
            out = out & cells[a]
        return out

    def hits(self, hashes: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
        """For each document and language, the n-grams that the filter says the language holds."""
        out = np.zeros((docs, len(self.languages)))
        for part in range(1 + len(self.further)):
            mask = self.masks(hashes, part)
            kind = mask.dtype.type
            for i in range(part * SLICE, min(len(self.languages), (part + 1) * SLICE)):
                out[:, i] = np.bincount(owner, weights=(mask >> kind(i % SLICE)) & kind(1), minlength=docs)
        return out

    def predict(self, docs: list[str]) -> tuple[list[str], np.ndarray]:
        lang, score = [UND] * len(docs), np.zeros(len(docs))
        hashes, owner, has = grams(docs)
        if not self.languages or not has.any():
            return lang, score
        total = np.bincount(owner, minlength=len(docs))
        hits = self.hits(hashes, owner, len(docs))
        fp = self.false_positive
        true = np.clip((hits - total[:, None] * fp) / (1 - fp), 0, None)
        best = true.argmax(1)
        score = np.clip(true.max(1) / np.maximum(total, 1), 0, 1) * has
        return [self.languages[b] if h else UND for b, h in zip(best.tolist(), has.tolist(), strict=True)], score


def places(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of each n-gram: double hashing on the two halves of its hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(cells - 1)).astype(np.int64) for i in range(HASHES)]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, ratio: float = 0.2, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from the rows of ``labelled`` that have a text and a language.

    ``per_language`` bounds the sample and ``max_grams`` the model (the most
    frequent n-grams stay); both are parameters of the fit, no limit on what is
    predicted.
    """
    rows = labelled.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("t is not null and lang is not null")
    counts = {r[0]: r[1] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col)).count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(1, np.uint8), np.zeros(0))
    number = F.element_at(F.create_map(*(x for i, n in enumerate(languages) for x in (F.lit(n), F.lit(i)))), F.col("lang"))
    rate = F.element_at(F.create_map(*(x for n in languages for x in (F.lit(n), F.lit(per_language / counts[n])))), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1_000_000)) < rate * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            hashes, owner, _ = grams(texts(b, "t").to_pylist())
            of = b.column("lang").to_numpy(zero_copy_only=False)[owner]
            for i in np.unique(of):
                g, n = np.unique(hashes[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i), pa.int32()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    found = picked.select("t", number.cast("int").alias("lang")).mapInArrow(count, "lang int, gram long, n long").groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == i, F.col("n"))).alias(f"n{i}") for i in range(len(languages))), F.sum("n").alias("n"))
    most = found.where("n >= 2").orderBy(F.col("n").desc(), "gram").limit(max_grams)
    # only the languages that have an n-gram come with it: the rows stay short however many languages there are
    own = F.filter(F.array(*(F.struct(F.lit(i).alias("lang"), F.col(f"n{i}").alias("n")) for i in range(len(languages)))), lambda x: x["n"].isNotNull())
    rows = most.select("gram", own.alias("own")).select("gram", "own.lang", "own.n").toArrow().combine_chunks()
    gram = np.array(rows["gram"].to_numpy(), np.int64).view(np.uint64)
    lang, n = (pa.chunked_array([pc.list_flatten(c) for c in rows[name].chunks], t).to_numpy() for name, t in (("lang", pa.int32()), ("n", pa.int64())))
    of = np.repeat(np.arange(len(gram)), pc.list_value_length(rows["lang"]).to_numpy())
    share = n / np.maximum(np.bincount(lang, weights=n, minlength=len(languages)), 1)[lang]
    top = np.zeros(len(gram))
    np.maximum.at(top, of, share)
    holds = share >= ratio * top[of]
    size = 1 << max(10, int(CELLS_PER_GRAM * max(1, len(gram)) - 1).bit_length())
    parts, fill = [], []
    for first in range(0, len(languages), SLICE):
        bits = min(SLICE, len(languages) - first)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= bits)
        mask, cells = np.zeros(len(gram), kind), np.zeros(size, kind)
        for i in range(bits):
            mask[of[holds & (lang == first + i)]] |= kind(1) << kind(i)
        for at in places(gram, size):
            np.bitwise_or.at(cells, at, mask)
        parts.append(cells)
        fill += [((cells >> kind(i)) & kind(1)).mean() for i in range(bits)]
    return Model(languages, parts[0], np.array(fill) ** HASHES, tuple(parts[1:]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) of every row, and the columns in ``carry`` as ``carry_<name>``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: max_grams
    rows = docs.select(F.col(id_col).alias("k"), *(F.col(c).alias(f"carry_{c}") for c in carry), F.col(text_col).alias("t"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "t", 4 << 20):
            lang, score = own.predict(texts(b, "t").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", id_col)


def learned_from(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that may be learned from: crc32 of the id modulo 4 is not 2."""
    return docs.where(crc_bucket(id_col, 4) != 2)
