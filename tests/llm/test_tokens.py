"""Operators 6, 7 and 9 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from procmon.llm import bpe, packing, queries, tokenstore
from procmon.llm.chunks import ChunkEncoder
from procmon.llm.common import scratch

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", "a b", "a  b", " a\n\nb ", "x  y", "don't we'll I'M", "1234 56.78,9", "<|endoftext|> x <|startoftext|>", "nul \x00 in text, twice \x00.",
    "éte ́x ý.", "Ünïcode ÀÉ ß İstanbul ŒUVRE", "日本語 の テキスト。次", "tab\tand\r\nnewline \t mix", "...!!! ?! (a) [b] {c} \"d\"", "a" * 5000, " " * 3000 + "b", "ab " * 30000, "🙂 🙂🙂", "x y   z",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, f"x{i}") for i, t in enumerate(texts)], "doc_id long, text string, start string")


def documents(spark):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunks_equal_whole_texts(name, kind):
    whole = Tokenizer.from_file(P.path(name))
    own = ChunkEncoder(P.path(name), kind)
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", " ", "́", "日", "-", "!", "|", "(", ")", "the", " ", "<|endoftext|>", "\x00", "\r"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from the cache
        ids, off = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_op6_equals_library(spark):
    own = bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = {i: own.encoding.encode_ordinary(t) for i, t in documents(spark)}
    text = dict(documents(spark))
    got = {r.doc_id: r for r in queries.QUERIES["op6_byte_bpe"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.n_tokens == len(want[i])
        assert r.ids_sha256 == hashlib.sha256(np.array(want[i], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()


def test_op6_odd_texts(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Coder(path, P.PATTERN)
    enc = bpe.encode(rows(spark, ODD), path, P.PATTERN)
    got = {r.doc_id: r.ids for r in enc.collect()}
    raw = {r.doc_id: bytes(r.raw) for r in bpe.decode(enc, path, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == own.encoding.encode_ordinary(t or "")
        assert raw[i] == (t or "").encode()
    assert bpe.encode(rows(spark, ODD).limit(0), path, P.PATTERN).count() == 0


def test_long_match_merges_like_the_library():
    own = bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choices("abcdeéñthe", k=rng.randint(1, 400)))
        assert bpe.merge(t.encode(), own.ranks) == own.encoding.encode_ordinary(t)


def check_packing(pieces, ids):
    """Every id once, offsets gapless, capacity kept."""
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.length == len(part) > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return len(by_seq)


def test_op7_packs_every_id(spark):
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 2] for i, t in documents(spark)}
    sequences = check_packing(queries.QUERIES["op7_packing"](spark, SF).collect(), ids)
    assert sequences <= 1.02 * sum(map(len, ids.values())) / 4096 + 1


def test_op7_odd_texts_and_payload(spark):
    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(ODD)}
    got = packing.pack(rows(spark, ODD), path, 2, with_ids=True, block_windows=2).collect()
    check_packing(got, ids)
    for r in got:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
    assert packing.pack(rows(spark, ODD).limit(0), path, 2).count() == 0


def test_differencing_beats_first_come():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1024, 2000)
    dealt = packing.pack_sizes(sizes)
    sums = np.bincount(dealt, weights=sizes)
    assert sums.max() <= 4096 and len(sums) <= 1.01 * sizes.sum() / 4096 + 1
    assert packing.pack_sizes(np.full(50, 2049)).max() == 49  # none fit together: the count rises to the number of items


def store_rows(docs):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out, at = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op9_files_hold_every_document(spark):
    got = queries.QUERIES["op9_token_store"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(store_rows(documents(spark)))


def test_op9_repeated_null_and_absent_keys(spark):
    docs = [(5, "five"), (None, "none"), (5, "five"), (5, ""), (7, ""), (None, ""), (-3, "minus"), (2**62, "big, " * 2000)]
    df = spark.createDataFrame([(k, t or None, 1) for k, t in docs], "doc_id long, text string, n_tokens int")
    folder = scratch(spark, "test-store")
    manifest = tokenstore.write(df, folder, P.path("byte_bpe_50k.json"), 0, 50_257, shards=3)
    got = [tuple(r) for r in tokenstore.read(spark, folder, manifest).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == store_rows(docs)
    asked = spark.createDataFrame([(5,), (6,), (2**62,), (None,)], "key long")
    found = tokenstore.lookup(folder, manifest, asked, "key").collect()
    assert sorted((r["key"], r["copy"], len(r["ids"])) for r in found) == [(5, 0, 1), (5, 1, 2), (5, 2, 2), (2**62, 0, store_rows(docs)[-1][2])]
    empty = tokenstore.write(df.limit(0), scratch(spark, "empty"), P.path("byte_bpe_50k.json"), 0, 50_257)
    assert tokenstore.read(spark, folder, empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).choice(2**40, 20_000, replace=False).astype(np.uint64)
    h = tokenstore.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.slots(keys + np.uint64(1 << 50)) == -1).mean() > 0.999


STRANGE = [*"aZéß .,;:!?|)]}\"\n\t'-09", "\u0130", "\u0958", "\u09dc", "\ufb2a", "\ufb1d", "\u0301", "\u0307", "\u093c", "\u05c1", "\u0915", "\u05e9", "\u00a0", "\u3000", "\u200d", "中", "🙂", "\u1100", "\u1161", "I", "EV", "the ", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_chunks_equal_the_plain_call(name, kind):
    """Random strings of characters that normalisation changes, marks and special tokens, against an unmodified tokenizer."""
    rng = random.Random(11)
    own, whole = ChunkEncoder(P.path(name), kind), Tokenizer.from_file(P.path(name))
    for _ in range(20):
        strings = ["".join(rng.choices(STRANGE, k=rng.randint(1, 12))) for _ in range(2500)]
        ids, off = own.encode(pa.array(strings))
        want = [e.ids for e in whole.encode_batch(strings, add_special_tokens=False)]
        got = [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
        wrong = [(t, w, g) for t, w, g in zip(strings, want, got, strict=True) if w != g]
        assert not wrong, (len(wrong), wrong[:3])
