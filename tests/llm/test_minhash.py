"""Operator 3 against brute force."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from procmon.llm import minhash, queries

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs):
    """doc_id -> (set size, component); ids are distinct."""
    sets = {i: shingle_set(t) for i, t in docs}
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    done = set()
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            if (i, j) not in done and 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(got, docs):
    want = brute(docs)
    assert {r[0]: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r[0] == r.component_id) for r in got)
    assert len(got) == len(docs)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.QUERIES["op3_near_duplicates"](spark, sf).collect(), docs)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**9)}"
    return " ".join(out)


def test_groups_around_the_threshold(spark, monkeypatch):
    """Large groups of copies with few and many edits, chains, and blocks smaller than the buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(11)
    docs = []
    for _ in range(3):
        base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
        docs += [edited(rng, base, rng.randrange(0, 12)) for _ in range(120)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):  # neighbours are alike, the ends are not
        chain = chain[: 10 * i] + [f"x{i}_{k}" for k in range(5)] + chain[10 * i + 5 :]
        docs.append(" ".join(chain))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n long")
    check(minhash.components(df).collect(), docs)


def test_odd_rows(spark):
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "a b c d e"), (7, "A\tb\x0bc\x0cd\re"), (8, "É b c d e"), (9, "é b c d e"), (10, "z " * 50_000), (11, "z " * 60_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, c string")
    check(minhash.components(df).collect(), docs)
    assert minhash.components(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "one two"), (7, "one two"), (7, "one two"), (None, "alone here"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.components(nulls).collect())
    assert got == sorted([("None", 1, "7", False), ("7", 1, "7", True), ("7", 1, "7", True), ("None", 1, "None", True), ("None", 0, "None", True)])


def brute_at(docs, percent):
    """doc_id -> component, all pairs compared."""
    sets, up = {i: shingle_set(t) for i, t in docs}, {i: i for i, _ in docs}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    return up


def test_pipeline_stage_links_from_080(spark):
    """Pairs between 0.80 and 0.85 are one document to the stage and two to op3."""
    rng = random.Random(3)
    docs = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(150)]
        other = list(base)
        for at in rng.sample(range(10, 140, 10), 3):  # 15 of 146 shingles: 131 / 161 = 0.814
            other[at] = f"g{g}x{at}"
        docs += [" ".join(base), " ".join(other)]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near, far = brute_at(docs, 80), brute_at(docs, 85)
    assert len(set(near.values())) == 60 and len(set(far.values())) == 120
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(near.values())
    assert {r.doc_id: r.component_id for r in minhash.components(df).collect()} == far


def test_bands_meet_at_the_threshold():
    for percent in (85, 80):
        width = minhash.band_width(percent)
        assert (1 - (percent / 100) ** width) ** (minhash.HASHES // width) <= minhash.MISS_BANDS
    assert minhash.band_width(85) == 8


def test_pipeline_stage_keeps_one_row_of_each_group(spark):
    """Ids that repeat with other texts, and copies under one id or without any."""
    clean, copied = "a clean text under a repeated id", "some copied words and a few more of them"
    rows = [(1, copied, "a"), (7, copied, "b"), (7, clean, "c"), (8, "only twice here under one id", "d"), (8, "only twice here under one id", "d"), (None, "copies of rows without any id", "e"), (None, "copies of rows without any id", "e"), (None, None, "f"), (None, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter([rows[0], rows[2], rows[3], rows[5], rows[7], rows[8]])
