"""Operator 12: counts, cuts and coverage against brute force; subtrees of extended prefixes; odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from oracle import compare, duck
from procmon.llm import phrases, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


def brute(docs, least, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        rows = []
        for p, a in some.items():
            if covered[p] and 100 * covered[p] >= share * a:
                continue
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_op12_matches_sql(spark):
    res = compare(queries.QUERIES["op12_collocations"](spark, SF).toArrow(), duck(SF, queries.ORACLE["op12_collocations"]))
    assert res["exact"], res


@pytest.mark.parametrize("budget", [8, 200, 1 << 20])
def test_op12_brute_force_with_extended_prefixes(spark, budget):
    """With a budget of 8 nearly all words and pairs are extended, so inner nodes are added up from several groups."""
    rng = random.Random(5)
    words = ["the", "The", "ein", "É", "é", "a-b", "x", "ß", "日本", "of"]
    docs = []
    for i in range(120):
        text = "".join(rng.choices(words, [9, 3, 5, 1, 1, 2, 2, 1, 1, 4])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\x0b", "!? "]) for _ in range(rng.randint(0, 60)))
        docs.append((i, text, rng.choice(["en", "de", None])))
    docs += [(i, "one two three four five " * 3, "en") for i in range(7)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert found(df, least=3, budget=budget) == brute(docs, 3)
    assert found(df, least=5, budget=budget, share=50, top=7) == brute(docs, 5, 50, 7)


def test_op12_odd_rows(spark):
    docs = [(1, None, "en"), (None, "", None), (2, " \t ..\n", "en"), (3, "solo", "und"), (3, "a b a b a b", None), (4, "A B a b", "und"), (5, "x" * 50_000 + " y " + "x" * 50_000 + " y", "en")]
    df = spark.createDataFrame([(*d, 1, "c", 2) for d in docs], DOCS + ", h int, word string, f int").repartition(3)
    assert found(df, least=2) == brute(docs, 2)
    assert found(df.limit(0), least=2) == []
    swapped = df.selectExpr("text as body", "lang as text", "doc_id as lang")
    assert found(swapped, text_col="body", lang_col="text", least=2) == brute(docs, 2)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = "".join(f"w{i % 13} v{i % 7}{'.' if i % 5 == 0 else ''} " for i in range(2000))
    whole = phrases.coded(pa.array([text, "end of it"]))
    monkeypatch.setattr(phrases, "LONG_TEXT", 64)
    assert len(phrases._cut(pa.array([text]))) > 20 and "".join(phrases._cut(pa.array([text])).to_pylist()) == text

    def spelled(got):
        words, codes = got
        pieces = "".join(words[c] + " " if c >= 0 else "|" for c in codes.tolist())
        return re.sub(r"\|+", "|", pieces)

    assert spelled(phrases.coded(pa.array([text, "end of it"]))) == spelled(whole)


def test_subtree_counts_are_leaf_totals():
    rng = np.random.default_rng(1)
    path = rng.integers(1, 4, (500, 4)).astype(np.uint64)
    path[rng.random(500) < 0.3, 3] = 0
    counts = rng.integers(1, 9, 500)
    for d, nodes, totals in phrases.subtree(path, counts, range(2, 5)):
        want = Counter()
        for p, c in zip(path.tolist(), counts.tolist(), strict=True):
            if p[d - 1]:
                want[tuple(p[:d])] += c
        assert {tuple(n[:d]): t for n, t in zip(nodes.tolist(), totals.tolist(), strict=True)} == want


def test_bloom_has_no_misses(spark):
    x = np.random.default_rng(2).integers(0, 2**63, (3000, 2))
    df = spark.createDataFrame(x.tolist(), "a long, b long")
    one, two = phrases.bloom(df, ["a"]), phrases.bloom(df, ["a", "b"])
    u = x.view(np.uint64)
    assert one.has(u[:, 0]).all() and two.has(phrases.paired(u[:, 0], u[:, 1])).all()
    assert one.has(u[:, 1]).mean() < 0.2 and not phrases.bloom(df.limit(0), ["a"]).has(u[:, 0]).any()
