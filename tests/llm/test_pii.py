"""Operator 1 against a plain reading of its patterns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from procmon.llm import pii, queries

SF = "/root/testdata/sf0.01"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, r in RULES.items() for m in re.finditer(r, text or "") if valid(k, m.group())]


def check(got, text):
    spans = brute(text)
    for k in RULES:
        assert got[f"n_{k}"] == sum(s.startswith(k) for s in spans)
    assert got["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert got["spans"].split(",")[: len(spans)] == (spans or got["spans"].split(",")[:0])


def test_query_equals_plain_patterns(spark):
    text = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.QUERIES["op1_personal_data"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        check(r, text[r.doc_id])


ODD = [
    None, "", "a@b.c_d@e.f", "x..y@z..w a@b.c. q@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3.99999999999999", "4111 1111-1111 1111", "4111  1111 1111 1111",
    "4111111111111111 4111111111111112 0000000000000", "+1 (375) 555-4393, +49-()-1 +123 +1234567890123456", "日本 é x@y.zz 🙂 +1 234 567 890", "1 " * 40000, "a." * 30000 + "@" + "b." * 30000 + "c", "9" * 60000, "+" * 5000 + "1", "(" * 3000 + "+1" + "(" * 3000,
]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_ip int, row string")
    got = pii.report(df).collect()
    assert len(got) == len(ODD)
    for r in got:
        check(r, ODD[r.doc_id])
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert out[0].text is None and out[1].text == "" and out[5].text == "[CARD]" and out[9].text == "日本 é [EMAIL] 🙂 [PHONE]"
    assert out[2].row == "x" and pii.report(df.limit(0)).count() == 0


def test_terms_that_give_an_entity_away(spark):
    other = ["alpha beta gamma delta epsilon", "common words of every text", "nothing to see here at all"]
    docs = [f"{o} common number {i}" for i, o in enumerate(other * 20)]
    docs += [f"the zorblax common {w} mail to jane@corp.example {w} again" for w in ("one", "two", "three", "four")]
    docs += ["copied quux common 10.0.0.1 line"] * 9  # one context only: no evidence
    docs += ["Zorblax stands alone, no entity near"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i in range(60, 64):
        assert "zorblax" not in out[i] and "common" in out[i] and "[EMAIL]" in out[i]
    assert "quux" in out[64] and "[IP]" in out[64]
    assert out[73] == docs[73]
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert ":4:11" in spans[60] and spans[0] == ""


def test_rare_entities_are_protected(spark):
    """Entities seen once or twice, each near a word of its own and a word of many texts."""
    docs = [f"common words number {i} and nothing else to see" for i in range(120)]
    docs += ["the flumph common mail jane@corp.example today"]
    docs += [f"the grimblor common {w} mail bob@corp.example {w} again" for w in ("one", "two")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "flumph" not in out[120] and "grimblor" not in out[121] + out[122]
    assert all("common" in out[i] and "[EMAIL]" in out[i] for i in (120, 121, 122))
    assert all(out[i] == docs[i] for i in range(120))


def masked(docs):
    """Terms masked in each document by a plain reading of the rule: {row: {term: removed}}."""
    term = regex.compile(r"[\p{L}\p{N}]{3,}")
    words = [set(term.findall(t.lower())) for t in docs]
    df = Counter(w for own in words for w in own)
    holders, near, contexts, held = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for row, t in enumerate(docs):
        for kind, rule in RULES.items():
            for m in re.finditer(rule, t):
                if valid(kind, m.group()):
                    value = re.sub("[^0-9]", "", m.group()) if kind in ("card", "phone") else m.group().lower()
                    context = t[max(0, m.start() - 48) : m.start()] + " " + t[m.end() : m.end() + 48]
                    holders[kind, value].add(row)
                    held[row].add((kind, value))
                    for w in set(term.findall(context.lower())):
                        near[kind, value, w].add(row)
                        contexts[kind, value, w].add(context)
    out = defaultdict(dict)
    for row, entities in held.items():
        for w in words[row]:
            shares = []
            for e in entities:
                if rows := near.get((*e, w)):
                    if not df[w]:
                        continue
                    bits = math.log2(max(len(docs), 2) / len(holders[e]))
                    seen = min(len(rows), len(contexts[(*e, w)]))
                    n = seen + max(df[w] - len(rows), 0)
                    p, z2 = seen / n, pii.Z**2
                    low = (p + z2 / (2 * n) - pii.Z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
                    shares.append((bits + math.log2(low)) / max(bits, 1e-9))
            if shares and max(shares) >= pii.GENERALISE:
                out[row][w] = max(shares) >= pii.REMOVE
    return out


def test_masked_terms_equal_brute_force(spark):
    rng = random.Random(8)
    common, rare = [f"common{i}" for i in range(12)], [f"rare{i}x" for i in range(400)]
    entities = ["help@corp.example", "a.b@c.de", "10.1.2.3", "4111 1111 1111 1111", "+1 234 567 8901"]
    docs = []
    for i in range(400):
        words = rng.choices(common, k=12) + rng.sample(rare, 2) + [f"{rng.randint(100, 10**6)}"]
        rng.shuffle(words)
        if i % 3 == 0:  # a third of all documents hold one address
            words.insert(rng.randint(0, 12), entities[0])
        if i % 17 == 0:
            words.insert(rng.randint(0, 12), rng.choice(entities[1:]))
        docs.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    want = masked(docs)
    found = defaultdict(dict)
    for r in pii.report(df).collect():
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            if kind in ("generalise", "remove"):
                found[r.doc_id][docs[r.doc_id][int(a) : int(b)].lower()] = kind == "remove"
    base = {i: [tuple(map(int, s.split(":")[1:])) for s in brute(t)] for i, t in enumerate(docs)}
    outside = lambda i, w: any(not any(a < m.end() and m.start() < b for a, b in base[i]) for m in re.finditer(rf"\b{w}\b", docs[i].lower()))
    want = {i: {w: gone for w, gone in own.items() if outside(i, w)} for i, own in want.items()}
    assert {i: own for i, own in found.items() if own} == {i: own for i, own in want.items() if own} and len(found) > 5


def test_shared_entity_meets_own_terms_only(spark):
    """One address in all documents, each beside rare words: a row for each of a document's own terms, not of the entity's."""
    docs = [f"filler{i} filler words" for i in range(900)] + [f"write help@corp.example about unique{i} thing" for i in range(100)]
    marked = pii._marked(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "text").withColumn(pii._ROW, F.col("doc_id"))
    rows = pii.disclosing(marked.where(F.size(pii._SPANS) > 0), marked).collect()
    assert len({(r.row, r.term) for r in rows}) == len(rows) <= 5 * 100
    assert all(r.term in docs[r.row] for r in rows)


def test_classes_of_generalised_terms(spark):
    docs = [f"plain text {i} of many" for i in range(60)]
    docs += [f"see 90210 and Zork and q7x and blip at jane@corp.example {w}" for w in ("one", "two")] + ["90210 Zork q7x blip"]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert out[62] == docs[62] and not {"90210", "Zork", "q7x", "blip"} & set(out[60].split())
    spans = pii.report(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).where("doc_id = 60").first().spans
    if "generalise" in spans:
        assert re.search(r"\[(NUMBER|NAME|CODE|WORD)\]", out[60])
