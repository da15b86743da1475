"""Phrase collocations by ERA-style vertical partitioning of a depth-truncated suffix tree.

Texts are cut into pieces and those into words; the suffixes of the pieces, cut to
``DEPTH`` words, are the paths of a suffix tree for each language.

1. Words are counted.  A word is known by a 64-bit hash of language and word; it is an
   error if two words share one (the seed can be changed).
2. Vertical partitioning: the suffixes are dealt into groups by their prefix, such that
   a group holds about half of ``BUDGET`` suffixes and fits the memory of a task.  The prefix is
   the first word; words with more than an eighth of the budget are extended to two
   words, and word pairs with more than that to the whole suffix (sums of their inner nodes
   are added up afterwards).
3. Elastic range: the tree is grown in two rounds, first to pairs, then to ``DEPTH`` words where the
   pairs occur at least ``LEAST`` times, as no phrase is more frequent than its parts.
4. Each batch of texts sends a group its suffixes sorted and counted.  A group's
   subtree is built on its own: the sorted leaves and their totals, of which the runs with equal
   first words give the counts of all inner nodes.
5. Candidates meet the counts of their parts in one join on the part.

What a task must know of other words' counts (frequent, heavy) are Bloom filters of ``MOST_BITS``
bits at most.  A false hit costs work and changes no result: counts below ``LEAST`` are dropped
when the subtree is read.

Null texts count as empty; a null language is ``und``.  Rows with null or repeated ids are rows like others (ids
are not read).  Texts longer than ``LONG_TEXT`` are cut after one of the marks that end pieces, so
memory is bounded unless a single piece is longer.  An empty table gives no rows.  Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import partitions, slices, texts, written

DEPTH = 4
LEAST = 30  # occurrences of a candidate
SHARE = 80  # per cent of a candidate's occurrences in a longer one that drop it
TOP = 2000  # of each language
BUDGET = 1 << 20  # suffixes of a group
BATCH = 8 << 20  # bytes of texts counted at once
LONG_TEXT = 16 << 20
MOST_BITS = 1 << 26
UND = "und"
ENDS = r"[.,;:!?\n-\r]"
WORD_COLUMNS = tuple(f"h{i + 1}" for i in range(DEPTH))
NODE = ", ".join(f"{h} long" for h in WORD_COLUMNS)
U = np.uint64


# -- words ---------------------------------------------------------------------


def _cut(arr: pa.Array) -> pa.Array:
    """The texts, very long ones cut after a mark that ends a piece."""
    if pc.max(pc.binary_length(arr)).as_py() <= LONG_TEXT:
        return arr
    out, ends = [], re.compile(ENDS)
    for t in arr.to_pylist():
        at = 0
        while at < len(t):
            end = ends.search(t, at + LONG_TEXT // 4)
            to = end.end() if end else len(t)
            out.append(t[at:to])
            at = to
    return pa.array(out, pa.string())


def coded(arr: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words of texts and the texts as numbers of words, -1 where a piece ends."""
    arr = pc.replace_substring_regex(pc.ascii_lower(_cut(arr)), ENDS + "+", " \n ")
    lists = pc.split_pattern(pc.binary_join_element_wise(pc.replace_substring(arr, "\t", " "), "\n", " "), " ")
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    number = np.cumsum([w not in ("", "\n") for w in words]) - 1
    number = np.where([w == "\n" for w in words], -1, np.where([w == "" for w in words], -2, number))
    codes = number[flat.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    return [w for w in words if w not in ("", "\n")], codes[codes != -2]


def hashed(lang: str, words: list[str], seed: int) -> np.ndarray:
    """The 64-bit names of a language's words."""
    own = xxhash.xxh64_intdigest(lang, seed)
    return np.fromiter((xxhash.xxh64_intdigest(w, own) for w in words), U, len(words))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    for b in slices(batches, "t", BATCH):
        langs = b.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, texts(b.filter(pc.equal(langs.indices, i)), "t")


def prepared(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").alias("t"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UND)).alias("lang")).where(F.length("t") > 0)


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, f) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, arr in _by_language(batches):
            words, codes = coded(arr)
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(hashed(lang, words, seed).view(np.int64)), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["h", "lang", "word", "f"])

    found = rows.mapInArrow(run, "h long, lang string, word string, f long")
    return found.repartition(partitions(rows.sparkSession), "h").groupBy("h", "lang", "word").agg(F.sum("f").alias("f"))


# -- filters ---------------------------------------------------------------------


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number for two (for filters and groups alone, never for counts)."""
    with np.errstate(over="ignore"):
        x = (a ^ U(0x9E3779B97F4A7C15)) * U(0xBF58476D1CE4E5B9) + (b << U(29) | b >> U(35))
        x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(29))


class Bloom:
    """Bits that tell (with few false hits) whether a 64-bit number is in a set; two bits a number."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, U(len(words) * 64 - 1)

    @staticmethod
    def places(x: np.ndarray, mask: int) -> np.ndarray:
        return np.concatenate([x & U(mask), (x >> U(32)) & U(mask)])

    def has(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for at in np.split(self.places(x, self.mask), 2):
            hit &= (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
        return hit


def bloom(rows: DataFrame, columns: list[str]) -> Bloom:
    """The filter of a table's words (one column) or pairs (two), gathered as at most ``MOST_BITS`` / 64 numbers."""
    n = rows.count()
    bits = min(MOST_BITS, max(1 << 10, 1 << (12 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(c).to_numpy().view(U) for c in columns]
            at = Bloom.places(x[0] if len(x) == 1 else paired(*x), bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int32)), pa.array((U(1) << (at & U(63))).view(np.int64))], ["at", "bits"])

    found = rows.select(*columns).mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(U)
    return Bloom(words)


# -- suffixes and subtrees ---------------------------------------------------------


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, numbers and counts of the distinct keys."""
    _, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, number, counts


def suffixes(codes: np.ndarray, h: np.ndarray, frequent: np.ndarray, pairs: Bloom | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of a batch, as a row of word names each (0: none), and their counts.

    Without ``pairs`` they have two words; with it three or four, of which all neighbours are frequent pairs.
    """
    ok = np.append(np.where(codes >= 0, frequent[codes], False), [False] * (DEPTH - 1))
    codes = np.append(codes, [-1] * (DEPTH - 1))
    at = np.flatnonzero(ok[:-1] & ok[1:])
    if not len(at):
        return np.zeros((0, DEPTH), U), np.zeros(0, np.int64)
    first, number, counts = _unique(codes[at] * len(h) + codes[at + 1])
    if pairs is None:
        path = np.zeros((len(first), DEPTH), U)
        path[:, 0], path[:, 1] = h[codes[at[first]]], h[codes[at[first] + 1]]
        return path, counts
    known = pairs.has(paired(h[codes[at[first]]], h[codes[at[first] + 1]]))
    pair = np.full(len(codes), -1)
    pair[at] = np.where(known[number], number, -1)
    at = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0))
    if not len(at):
        return np.zeros((0, DEPTH), U), np.zeros(0, np.int64)
    _, three, _ = _unique(pair[at] * len(first) + pair[at + 1])
    leaf, _, counts = _unique(three * (len(first) + 1) + pair[at + 2] + 1)
    path = h[codes[at[leaf][:, None] + np.arange(DEPTH)]]
    path[pair[at[leaf] + 2] < 0, 3] = 0
    return path, counts


def send(rows: DataFrame, seed: int, groups: int, words: Bloom, heavy: Bloom, pairs: Bloom | None = None, heavy_pairs: Bloom | None = None) -> DataFrame:
    """(g, lang, h1, h2, h3, h4, c): for each batch and group, its sorted suffixes and their counts as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, arr in _by_language(batches):
            names, codes = coded(arr)
            h = hashed(lang, names, seed)
            if not len(h):
                continue
            path, counts = suffixes(codes, h, words.has(h), pairs)
            if not len(path):
                continue
            prefix = path[:, 0]
            two = paired(prefix, path[:, 1])
            wide = heavy.has(prefix)
            prefix = np.where(wide, two, prefix)
            if heavy_pairs is not None:
                prefix = np.where(wide & heavy_pairs.has(two), paired(two, paired(path[:, 2], path[:, 3])), prefix)
            group = (paired(prefix, prefix) % U(groups)).astype(np.int64)
            order = np.lexsort([*path.T[::-1], group])
            group, path, counts = group[order], path[order], counts[order]
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            packed = [[np.ascontiguousarray(x[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (*path.T, counts)]
            if pairs is None:
                packed[2:DEPTH] = [[b""] * (len(edges) - 1)] * (DEPTH - 2)
            yield pa.RecordBatch.from_arrays([pa.array(group[edges[:-1]]), pa.array([lang] * (len(edges) - 1), pa.string()), *(pa.array(p, pa.binary()) for p in packed)], ["g", "lang", *WORD_COLUMNS, "c"])

    return rows.mapInArrow(run, f"g long, lang string, {', '.join(f'{h} binary' for h in WORD_COLUMNS)}, c binary")


def subtree(path: np.ndarray, counts: np.ndarray, depths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, nodes, counts) of a group's subtree: counts of inner nodes are the totals of the leaves below them."""
    order = np.lexsort(path.T[::-1])
    path, counts = path[order], counts[order]
    fresh = np.zeros(len(path), bool)
    fresh[0] = True
    begins = []
    for d in range(path.shape[1]):
        fresh[1:] |= path[1:, d] != path[:-1, d]
        begins.append(np.flatnonzero(fresh))
    for d in depths:
        at = begins[d - 1]
        totals = np.add.reduceat(counts, at)
        real = path[at, d - 1] != 0
        nodes = path[at[real]].copy()
        nodes[:, d:] = 0
        yield d, nodes, totals[real]


def count_phrases(sent: DataFrame, depths: range, least: int, heavy_pairs: Bloom | None = None) -> DataFrame:
    """(lang, d, h1 .. h4, f) of the phrases that occur at least ``least`` times, from a subtree for each group."""
    result = f"lang string, d int, {NODE}, f long, part boolean"

    def run(group: pa.Table) -> pa.Table:
        column = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
        lang, counts = group.column("lang")[0].as_py(), column("c", np.int64)
        path = np.zeros((len(counts), DEPTH), U)
        for i, c in enumerate(WORD_COLUMNS[: depths[-1]]):
            path[:, i] = column(c, U)
        out = []
        for d, nodes, totals in subtree(path, counts, depths):
            part = np.zeros(len(nodes), bool)
            if heavy_pairs is not None and d < DEPTH:  # such a node's leaves may lie in several groups
                part = heavy_pairs.has(paired(nodes[:, 0], nodes[:, 1]))
            keep = part | (totals >= least)
            nodes, totals, part = nodes[keep], totals[keep], part[keep]
            out.append(pa.table([pa.array([lang] * len(nodes), pa.string()), pa.array(np.full(len(nodes), d, np.int32)), *(pa.array(np.ascontiguousarray(n).view(np.int64)) for n in nodes.T), pa.array(totals), pa.array(part)], ["lang", "d", *WORD_COLUMNS, "f", "part"]))
        return pa.concat_tables(out)

    found = sent.groupBy("g", "lang").applyInArrow(run, result)
    if heavy_pairs is None:
        return found.drop("part")
    found = written(found, "nodes")
    added = found.where("part").groupBy("lang", "d", *WORD_COLUMNS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return found.where("not part").drop("part").unionByName(added)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, budget: int = BUDGET, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(all words: h, lang, word, f) and (the phrases of two words or more that occur at least ``least`` times)."""
    rows = prepared(docs, text_col, lang_col)
    words = written(count_words(rows, seed), "words")
    if clash := words.groupBy("h").count().where("count > 1").first():
        raise ValueError(f"two words share the name {clash['h']}: choose another seed than {seed}")
    total = words.agg(F.sum("f")).first()[0] or 0
    groups = max(1, -(-2 * total // budget))
    often = words.where(F.col("f") >= least)
    known, heavy = bloom(often, ["h"]), bloom(often.where(F.col("f") > budget // 8), ["h"])
    two = written(count_phrases(send(rows, seed, groups, known, heavy), range(2, 3), least), "pairs")
    pairs, heavy_pairs = bloom(two, ["h1", "h2"]), bloom(two.where(F.col("f") > budget // 8), ["h1", "h2"])
    deep = count_phrases(send(rows, seed, groups, known, heavy, pairs, heavy_pairs), range(3, DEPTH + 1), least, heavy_pairs)
    return words, two.unionByName(written(deep, "phrases"))


# -- collocations ------------------------------------------------------------------


def _part(first: int, last: int) -> list[Column]:
    """The names of the words ``first`` to ``last`` (from 1) of a phrase as columns h1 .. h4."""
    own = [F.col(f"h{i}") for i in range(first, last + 1)]
    return [c.alias(h) for c, h in zip([*own, *[F.lit(0).cast("long")] * (DEPTH - len(own))], WORD_COLUMNS, strict=True)]


def scored(words: DataFrame, phrases: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """The candidates that no longer one covers: (lang, d, h1 .. h4, a, l, r, score)."""
    lone = F.lit(0).cast("long")
    counts = phrases.select(*WORD_COLUMNS, "f").unionByName(words.where(F.col("f") >= least).select(F.col("h").alias("h1"), *(lone.alias(h) for h in WORD_COLUMNS[1:]), "f"))
    cuts, inner = [], []
    own = F.struct(*WORD_COLUMNS)
    for d in range(2, DEPTH + 1):
        for k in range(1, d):
            cuts += [(d, F.struct(F.lit(f"l{k}").alias("side"), F.struct(*_part(1, k)).alias("p"))), (d, F.struct(F.lit(f"r{k}").alias("side"), F.struct(*_part(k + 1, d)).alias("p")))]
        for n in range(2, d):
            inner += [(d, F.struct(*_part(i, i + n - 1))) for i in range(1, d - n + 2)]
    of = lambda items: F.explode(F.filter(F.array(*(F.when(F.col("d") == d, x) for d, x in items)), lambda x: x.isNotNull()))
    asked = phrases.select(own.alias("whole"), of(cuts).alias("cut")).select("whole", "cut.side", *(F.col(f"cut.p.{h}").alias(h) for h in WORD_COLUMNS))
    met = asked.join(counts, list(WORD_COLUMNS)).select("whole", "side", "f")
    longer = phrases.select(of(inner).alias("whole"), F.lit("longer").alias("side"), "f")
    self_ = phrases.select(own.alias("whole"), F.lit("a").alias("side"), "f")
    sides = ["a", "longer", *(f"{s}{k}" for k in range(1, DEPTH) for s in "lr")]
    # each candidate is met by at most 2 (DEPTH - 1) parts, and longer ones are maximised before the exchange
    wide = met.unionByName(longer).unionByName(self_).groupBy("whole").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in sides))
    big = lambda c: f"cast({c} as decimal(20,0))"
    cut = lambda k: f"if(l{k} is null, null, named_struct('score', cast(2000000 * {big('a')} as decimal(38,0)) div cast({big(f'l{k}')} + {big(f'r{k}')} as decimal(38,0)), 'k', {k}, 'l', l{k}, 'r', r{k}))"
    wide = wide.withColumn("best", F.expr(f"array_min(filter(array({', '.join(cut(k) for k in range(1, DEPTH))}), x -> x is not null))"))
    wide = wide.where(F.expr(f"longer is null or 100 * {big('longer')} < {share} * {big('a')}"))
    return wide.select(*(F.col(f"whole.{h}").alias(h) for h in WORD_COLUMNS), "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, budget: int = BUDGET, seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    words, phrases = frequent_phrases(docs, text_col, lang_col, least, budget, seed)
    rows = scored(words, phrases, least, share)
    place = F.posexplode(F.filter(F.array(*WORD_COLUMNS), lambda h: h != 0)).alias("i", "h")
    spelled = rows.select("*", place).join(words.where(F.col("f") >= least).select("h", "lang", "word"), "h")
    key = [*WORD_COLUMNS, "lang", "a", "l", "r", "score"]
    spelled = spelled.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelled = spelled.withColumn("phrase", F.array_join("w.word", " "))
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # each task keeps its first ``top`` before the exchange
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
