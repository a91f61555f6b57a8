"""The queries of this package: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


#: The end-of-document id that the contracts of packing and token files append.
END_ID = 2


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "embedding", "vec_id % 100 = 0", 10)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, scan_secrets

    out = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), "embedding", "vec_id % 50 = 0", 5)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    out = read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID))
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_OP3 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
r AS (SELECT t.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""

_OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * cast(e AS DOUBLE))) AS x FROM embeddings)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, v.vec_id, cast(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express in reasonable time; tests/llm holds the others against brute force."""
    return {"op3_substring_dedup": _OP3, "op9_top_k": _OP9}
