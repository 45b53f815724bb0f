"""Queries of the operators and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced_topk, bpe_automaton, chat_format, embedding_dedup, language_id, minhash_dedup, mixing, pii, repeated_bytes, secrets, spelling_variants, substring_dedup, token_alignment


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary of the installed package; it stays outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    """The sentencepiece model of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(_table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return bitsliced_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.classify(docs, model).withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).drop("text_key", "all_spans")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = tokenizer_path()
    return chat_format.read_back(chat_format.assemble(conversations.select("conv_id", "turn", "role", "text").unionByName(extra), path), path)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, similarity_pct=80)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes.remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_topk_search, op3_secret_scan, op4_language_id, op5_pii, op6_chat_format, op7_embedding_dedup, op8_mixing, op9_bpe, op10_minhash_dedup, op11_spelling_variants, op12_suffix_dedup, op13_token_alignment)
}

ORACLES = {
    "op12_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (SELECT doc_id, unnest(range(CAST(length(h) / 2 AS BIGINT) - 99)) AS i, h FROM d WHERE length(h) >= 200),
        strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM starts),
        repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM strings) WHERE n > 1),
        marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM repeats),
        numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
        runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, run),
        totals AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS tail FROM runs GROUP BY doc_id),
        pieces AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM runs),
        heads AS (SELECT p.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN totals ON totals.doc_id = d.doc_id LEFT JOIN heads ON heads.doc_id = d.doc_id
    """,
    "op2_topk_search": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
            FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op6_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), written AS (
            SELECT *, replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:') AS role_out,
                   replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS text_out FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role_out, text_out)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role_out, text_out)) AS loss_sha256,
               CAST(sum(length(role_out) + length(text_out) + 15) AS BIGINT) AS formatted_chars
        FROM written GROUP BY conv_id
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach(node, root) AS (
            SELECT vec_id, vec_id FROM good
            UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node
        ), component AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
        n AS (SELECT u, count(*) AS c FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n.c, 0) AS n_links, coalesce(c.root, e.vec_id) AS component_id,
               coalesce(c.root, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN component c ON c.node = e.vec_id
    """,
}
