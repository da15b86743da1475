"""Near-duplicate components by MinHash bands and sequential Bayesian verification.

1. Each whole text becomes its set of distinct five-word shingles (hashed), with a
   signature of 256 min-hashes of one byte.  Equal sets form a class; all that
   follows works on classes, so copies cost nothing.
2. The signature is cut into bands, as wide as ``MISS_BANDS`` allows at the least
   similarity that links.  Classes that share a band value are candidates.  At a
   threshold of 0.85 there are 32 bands of 8, and a pair just there shares none with a
   chance of (1 - 0.85^8)^32 = 4e-5; at 0.8 there are 42 of 6, with 3e-6.
3. First, each class is compared with the first class of its buckets that it
   meets most often, which joins most copies.  Then the buckets that still hold
   classes of different components are compared across components.
4. A comparison reads the signatures batch after batch (32, 64, 128, 256 hashes).
   After each, it stops unless the posterior chance (uniform prior) that the
   similarity reaches the threshold is at least ``MISS``.  Survivors are confirmed
   on the full sets: 100 * intersection >= percent * union.
5. Confirmed links are joined into components; a component is named after its
   smallest document id.

A bucket gives at most a forest of links, and no link between different
components is left out.  Buckets of more than ``BLOCK`` classes are worked on in
pairs of blocks; no task ever holds more than two blocks.

Words are maximal runs without ``\\x20 \\x09-\\x0D``, A-Z lower-cased.  With fewer
than five words the whole sequence is the only shingle; null texts and texts
without words have an empty set and stay alone.  Null ids take part; a component
is named after its smallest id that is not null.  Rows that repeat an id are
separate documents.  An empty table gives no rows.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import drop_written, flat_bytes, slices, texts, written

SHINGLE = 5
HASHES, WIDEST = 256, 8
PERCENT = 85  # of op3; other callers name their own
MISS, MISS_BANDS = 1e-6, 1e-4
BATCHES = (32, 64, 128, 256)
BLOCK = 768
ROWS = 2048  # documents hashed at a time
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_MULTIPLY = _RNG.integers(0, 2**31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, HASHES, np.uint64).astype(np.uint32)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + U(salt)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64 (kept in the worker)."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_ODD, _INVERSE)):
                factors = np.full(n + 1, base, np.uint64)
                factors[0] = 1
                _POWERS[i] = np.cumprod(factors)
    return _POWERS


def shingles(arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes (48 bits, ascending in a document) and the document of each."""
    raw, offsets = flat_bytes(arr)
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    black = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a text begins here
    begin = black.copy()
    begin[1:] &= ~black[:-1] | first[1:-1]
    end = black.copy()
    end[:-1] &= ~black[1:] | first[1:-1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if len(a) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])])
        word = _mix((run[b] - run[a]) * down[a], 1)
        doc = np.searchsorted(offsets, a, side="right") - 1
        count = np.bincount(doc, minlength=len(arr))
        n = len(word) - SHINGLE + 1
        h = np.zeros(max(n, 0), np.uint64)
        for i in range(SHINGLE if n > 0 else 0):
            h = h * U(_ODD) + word[i : i + n]
        same = doc[:n] == doc[SHINGLE - 1 :] if n > 0 else np.zeros(0, bool)
        found, owner = _mix(h[same], 2), doc[: max(n, 0)][same]
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            at = np.cumsum(count) - count
            whole = np.zeros(len(short), np.uint64)
            for i in range(SHINGLE - 1):
                more = i < count[short]
                whole[more] = whole[more] * U(_ODD) + word[at[short[more]] + i]
            found, owner = np.concatenate([found, _mix(whole, 3)]), np.concatenate([owner, short])
    key = np.unique((owner.astype(np.uint64) << U(48)) | (found & U((1 << 48) - 1)))
    return key & U((1 << 48) - 1), (key >> U(48)).astype(np.int64)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One byte for each of the min-hashes of each set; ``starts``: where the sets begin in ``values``."""
    out = np.empty((len(starts), HASHES), np.uint8)
    x = (_mix(values, 4) >> U(32)).astype(np.uint32)
    ends = np.append(starts[1:], len(values))
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 16), side="right")))
        part, cuts = x[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at]
        buffer = np.empty_like(part)
        for i in range(HASHES):
            np.multiply(part, _MULTIPLY[i], out=buffer)
            np.add(buffer, _ADD[i], out=buffer)
            out[at:stop, i] = (np.minimum.reduceat(buffer, cuts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        at = stop
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with: shingles, rows that have any, where theirs begin, and two hashes of each set."""
    for b in slices(batches, "t", 1 << 20):
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            values, owner = shingles(texts(part, "t"))
            rows, starts = np.unique(owner, return_index=True)
            h = [np.add.reduceat(_mix(values, s), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64) for s in (5, 6)]
            yield part, values, rows, starts, h[0], h[1]


def describe(docs: DataFrame) -> DataFrame:
    """(k, n, h1, h2, sig) of (k, t), and all columns beyond; documents with empty sets have n = 0 and nulls."""
    more = [c for c in docs.columns if c not in ("k", "t")]
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("k", *more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values, rows, starts, h1, h2 in _sets(batches):
            n = np.zeros(b.num_rows, np.int64)
            n[rows] = np.diff(np.append(starts, len(values)))
            place = np.full(b.num_rows, -1)
            place[rows] = np.arange(len(rows))
            take = pa.array(place, pa.int64(), mask=place < 0)
            sig = [s.tobytes() for s in signatures(values, starts)]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n), pa.array(h1, pa.int64()).take(take), pa.array(h2, pa.int64()).take(take), pa.array(sig, pa.binary()).take(take), *(b.column(c) for c in more)], ["k", "n", "h1", "h2", "sig", *more])

    return docs.mapInArrow(run, ", ".join([kinds[0], "n long, h1 long, h2 long, sig binary", *kinds[1:]]))


def full_sets(docs: DataFrame) -> DataFrame:
    """(n, h1, h2, shingles) of (t): the sorted shingle hashes, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, rows, starts, h1, h2 in _sets(batches):
            six = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            cuts = np.append(starts, len(values))
            sets = [six[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(cuts)), pa.array(h1), pa.array(h2), pa.array(sets, pa.binary())], ["n", "h1", "h2", "shingles"])

    return docs.mapInArrow(run, "n long, h1 long, h2 long, shingles binary")


def unpack(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def band_width(percent: int) -> int:
    """The most hashes a band may have for a pair at the threshold to share no band with a chance of at most MISS_BANDS."""
    t = percent / 100
    return next((w for w in range(WIDEST, 1, -1) if (1 - t**w) ** (HASHES // w) <= MISS_BANDS), 1)


def band_values(sig: np.ndarray, width: int) -> np.ndarray:
    """Each signature row's bands, as one number a band."""
    count = HASHES // width
    out = np.zeros((len(sig), count, 8), np.uint8)
    out[:, :, :width] = sig[:, : count * width].reshape(len(sig), count, width)
    return out.view(np.uint64)[:, :, 0]


def bands(classes: DataFrame, percent: int) -> DataFrame:
    """(key, band, c): a row for each band of each class."""
    width = band_width(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = HASHES // width
        salt = _mix(np.arange(count, dtype=np.uint64), 7)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            key = _mix(band_values(sig, width) ^ salt, 8).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(np.arange(count, dtype=np.int32), len(sig))), pa.array(np.repeat(b.column("c").to_numpy(), count))], ["key", "band", "c"])

    return classes.select("c", "sig").mapInArrow(run, "key long, band int, c long")


@cache
def least_matches(percent: int) -> dict[int, int]:
    """For each batch size k the fewest equal hashes m with P(similarity >= t | m of k equal) >= MISS, t the threshold.

    With a uniform prior that posterior is P(Binomial(k + 1, t) <= m).
    """
    out, t = {}, percent / 100
    for k in BATCHES:
        total = 0.0
        for m in range(k + 2):
            total += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if total >= MISS:
                out[k] = m
                break
    return out


def likely(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signature rows stay, and their numbers of equal hashes, batch after batch."""
    left, equal, done, least = np.arange(len(a)), np.zeros(len(a), np.int64), 0, least_matches(percent)
    for k in BATCHES:
        equal[left] += (a[left, done:k] == b[left, done:k]).sum(1)
        left, done = left[equal[left] >= least[k]], k
    return left, equal[left]


def prune(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that survive the sequential test."""
    sig = classes.select("c", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).take(pa.array(likely(x, y, percent)[0]))

    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets are at least ``percent`` alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                keep.append(linked(unpack(x), unpack(y), percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def connect(links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of the links (a, b) can reach.

    Each round takes the smallest label among the neighbours and then the label's
    own label, until nothing changes; the rounds are written tables.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.toDF("b", "lb"), "b").groupBy(F.col("a").alias("v")).agg(F.min("lb").alias("near"))
        step = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("low"))
        jump = step.alias("s").join(labels.toDF("u", "up").alias("u"), F.col("s.low") == F.col("u.u"))
        new = written(jump.select("v", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop_written(labels)
        labels = new.select("v", "label")
        if not moved:
            drop_written(edges)
            return labels


def across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components in the buckets' members (key, band, c, size, comp, n, sig, shingles).

    ``size`` is the bucket's number of classes; large buckets are dealt into
    blocks, and each pair of blocks is a group of its own.  A pair that meets in
    several bands is compared in the first of them.  A group confirms its likely
    pairs itself, the likeliest of a class first, skips those that its links join
    already, and so returns at most a forest.
    """
    width = band_width(percent)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    spread = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c", kind="stable")
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, HASHES)
        values = band_values(sig, width)
        c, n, block = (pdf[x].to_numpy() for x in ("c", "n", "own"))
        band, mixed = int(pdf["band"].iloc[0]), pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        sets = [unpack(x) for x in pdf["shingles"]]
        comp = pd.factorize(pdf["comp"])[0]
        out = []
        for i in range(len(c) - 1):
            j = np.arange(i + 1, len(c))
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            j = j[(comp[j] != comp[i]) & (100 * small >= percent * large) & ((block[j] != block[i]) | (not mixed))]
            kept, equal = likely(np.broadcast_to(sig[i], (len(j), HASHES)), sig[j], percent)
            j = j[kept]
            first = (values[j] == values[i]).argmax(1) == band if len(j) else np.zeros(0, bool)
            for x in j[first][np.argsort(-equal[first], kind="stable")].tolist():
                if comp[x] != comp[i] and linked(sets[i], sets[x], percent):
                    comp[comp == comp[x]] = comp[i]
                    out.append((c[i], c[x]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return spread.select("key", "band", "c", "comp", "n", "sig", "shingles", "own", "lo", "hi").groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


IDENTITY = ["n", "h1", "h2"]


def _joined(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The described rows, numbered, and the classes (identity, low, first, comp): ``first`` has the row that stands for the class."""
    identity = IDENTITY
    described = written(describe(rows).withColumn("row", F.monotonically_increasing_id()), "described")
    first_row = F.min(F.struct(F.col("k").isNull().alias("unnamed"), "k", "row")).alias("first")
    grouped = described.where("n > 0").groupBy(*identity).agg(F.min("row").alias("c"), F.min("k").alias("low"), F.min_by("k", "row").alias("of"), first_row)
    classes = written(grouped.join(described.select(F.col("row").alias("c"), "sig"), "c"), "classes")

    every = bands(classes, percent)
    buckets = every.groupBy("key", "band").agg(F.count("*").alias("size"), F.min("c").alias("lead")).where("size > 1")
    members = written(every.join(buckets, ["key", "band"]), "members")
    asked = written(members.select("c").distinct(), "asked")
    wanted = classes.join(asked, "c").select(*identity, "c", "of")
    sets = rows.join(wanted.select(F.col("of")).distinct(), F.col("k").eqNullSafe(F.col("of")), "left_semi").select("t")
    sets = written(full_sets(sets).join(wanted, identity).select("c", "shingles").dropDuplicates(["c"]), "sets")

    met = members.where("c != lead").groupBy("lead", "c").agg(F.count("*").alias("times"))
    first = met.groupBy("c").agg(F.max(F.struct("times", (-F.col("lead")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("a"), F.col("c").alias("b"))
    first = written(first, "first")
    links = written(confirm(prune(first, classes, percent), sets, percent), "links")
    settled = members.where("size = 2 and c != lead").join(first.toDF("lead", "c"), ["lead", "c"], "left_semi").select("key", "band")
    rest = members.join(settled, ["key", "band"], "left_anti")
    comps = written(asked.join(connect(links).toDF("c", "label"), "c", "left").select("c", F.coalesce("label", "c").alias("comp")), "components")

    open_ = rest.join(comps, "c")
    split = open_.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "band")
    open_ = open_.join(split, ["key", "band"]).join(classes.select("c", "n", "sig"), "c").join(sets, "c")
    links = written(across(open_.drop("lead"), percent), "links")
    if links.limit(1).count():
        of = links.join(comps.toDF("a", "ca"), "a").join(comps.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = connect(of).toDF("comp", "label")
        comps = comps.join(joined, "comp", "left").select("c", F.coalesce("label", "comp").alias("comp"))

    return described, classes.join(comps, "c", "left").select(*identity, "low", "first", F.coalesce("comp", "c").alias("comp"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component, of the smallest id that is not null if any has one, and all rows with empty sets."""
    columns = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(docs.columns)]
    described, named = _joined(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), *columns), percent)
    stand = named.groupBy("comp").agg(F.min("first").alias("first")).select("first.row")
    kept = described.where("n > 0").join(stand, "row", "left_semi").unionByName(described.where("n = 0"))
    return kept.select(*(F.col(f"x{i}").alias(c) for i, c in enumerate(docs.columns)))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; documents at least ``percent`` alike are linked."""
    identity = IDENTITY
    described, named = _joined(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), percent)
    names = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    final = written(named.join(names, "comp").select(*identity, "component_id"), "named")
    out = described.select("k", *identity).join(final, identity, "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("k"), own.isNull()).alias("kept"))
