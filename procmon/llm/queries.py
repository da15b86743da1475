"""The registered queries of the operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.llm import ann, bpe, iblt, langid, minhash, packing, phrases, pii, sharding, tokenstore, toxicity, warc, whitening
from procmon.llm.common import crc_bucket, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


@_query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in every document."""
    return pii.report(_documents(spark, sf_dir))


@_query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike they are."""
    return iblt.fingerprints(_documents(spark, sf_dir))


@_query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return minhash.components(_documents(spark, sf_dir))


@_query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = _documents(spark, sf_dir, "lang")
    model = langid.train(langid.learned_from(docs))
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, toxicity.learned_from(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text with the multilingual rank file."""
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 4096 ids."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@_query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, among all rows."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@_query
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the store of all documents' ids and read every document back from its files."""
    folder = scratch(spark, "store")
    manifest = tokenstore.write(_documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, vocabulary=50_257)
    return tokenstore.read(spark, folder, manifest)



@_query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    out = sharding.shard(_documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, repeated payloads as revisits, and read the archives back."""
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read_pages(spark, folder)


ORACLE["op11_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS latest FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < latest THEN latest END AS refers_to
FROM q"""


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to four words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \t]+') IF x <> ''] AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, unnest([list_slice(w, i, i + k - 1) FOR i IN range(1, greatest(len(w) - k + 2, 1))]) AS g
      FROM p, (SELECT unnest(range(1, 5)) AS k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT c.*, x.f AS l, y.f AS r, j, CAST((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
        FROM (SELECT c.*, unnest(range(1, k)) AS j FROM c) c
        JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, j)
        JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, j + 1, c.k)),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
sub AS (SELECT lang, list_slice(g, i, i + m - 1) AS g, max(a) AS longer
        FROM (SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN sub ON best.lang = sub.lang AND best.g = sub.g
         WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000"""


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened along their first 32 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 32)
