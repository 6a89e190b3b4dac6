"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

from beaconry.llm import cuckoo, minhash, mips, packing, pii, quality, secrets, sharding, toxicity, wfst
from beaconry.llm.common import table


def op1_pii(spark, sf_dir):
    return pii.extract(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark, sf_dir):
    return minhash.dedup(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark, sf_dir):
    return wfst.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_packing(spark, sf_dir):
    return packing.pack(packing.tokenise(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_exact_dedup(spark, sf_dir):
    return cuckoo.dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_top_k(spark, sf_dir):
    rows = mips.integers(table(spark, sf_dir, "embeddings"))
    return mips.top(rows, rows.filter("vec_id % 50 = 0"))


def op10_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_minhash_dedup, op4_sentencepiece, op5_packing, op6_exact_dedup, op7_toxicity, op8_secrets, op9_top_k, op10_sharding)}
ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
