"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgetrail.llm import (
    bagminhash,
    brown,
    fill_middle,
    hard_negatives,
    hnsw,
    mixing,
    order_minhash,
    packing,
    pu_quality,
    rans,
    substrings,
    token_counts,
    warc,
)
from nudgetrail.llm.common import Stages, shared_folder

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op1_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    mixed, x = mixing.mix(docs, F.array("source"), whole=False)
    quota = F.col(f"{x}quotas")[0]
    return mixed.select(
        "doc_id",
        F.col(f"{x}size").alias("size"),
        quota["source_size"].alias("source_size"),
        quota["target"].alias("target"),
        (F.size(f"{x}routed") * F.col(f"{x}size")).cast("long").alias("taken"),
    )


def op2_rans_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "token-shards")
    docs = _read(spark, sf_dir, "documents")
    rans.write_shards(docs, public_tokenizers.path(WORD_BPE), folder)
    return rans.read_documents(spark, folder)


def op3_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "substrings")
    return substrings.repeated_paragraphs(_read(spark, sf_dir, "documents"), stages)


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = pu_quality.train(docs, _read(spark, sf_dir, "labels"))
    return pu_quality.score(docs, model).select(
        "doc_id",
        (pu_quality.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= pu_quality.KEEP).cast("int").alias("predicted"),
    )


def op5_hnsw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.linked_vectors(_read(spark, sf_dir, "embeddings"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_read(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("url")


def op8_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_rank_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path(BYTE_BPE))


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = (F.col("vec_id") % 7 == 0) & F.col("label").isNotNull()
    label = F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), F.col("embedding").alias("vector")
    )
    anchor = F.col("vec_id") % 100 == 0
    return hard_negatives.hard_negatives(rows, anchor, Stages(spark, "negatives"))


def op12_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    train = pu_quality.fold(F.col("doc_id")) != 1
    return brown.class_scores(docs, train, Stages(spark, "brown")).select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op13_frame_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "frames")
    fill_middle.write_frames(_read(spark, sf_dir, "documents"), folder)
    return fill_middle.read_digests(spark, folder)


QUERIES = {
    "op1_flow_mixing": op1_flow_mixing,
    "op2_rans_shards": op2_rans_shards,
    "op3_paragraph_minhash": op3_paragraph_minhash,
    "op4_pu_quality": op4_pu_quality,
    "op5_hnsw_links": op5_hnsw_links,
    "op6_order_minhash": op6_order_minhash,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_concat_and_cut": op8_concat_and_cut,
    "op9_bagminhash": op9_bagminhash,
    "op10_rank_merge_counts": op10_rank_merge_counts,
    "op11_angular_negatives": op11_angular_negatives,
    "op12_brown_classes": op12_brown_classes,
    "op13_frame_fill_middle": op13_frame_fill_middle,
}

SQL = {
    "op7_warc_revisits": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, payload, octet_length(payload) AS n,
                   min(page_id) OVER (PARTITION BY payload) AS first
            FROM p
        ), h AS (
            SELECT *, sha1(payload) AS x FROM d
        ), b AS (
            SELECT *, [('0x' || substr(x, 1 + 10 * i, 10))::BIGINT FOR i IN range(4)] AS g FROM h
        )
        SELECT page_id, n AS payload_bytes,
               list_aggregate([
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          1 + ((g[1 + k // 8] >> (35 - 5 * (k % 8))) & 31)::INT, 1)
                   FOR k IN range(32)], 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b
    """,
    "op11_angular_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
                   list_inner_product(a.q, r.q)::BIGINT AS score
            FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                                  ORDER BY s.score DESC, s.vec_id)::INT AS rank,
               s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
         AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        QUALIFY rank <= 10
    """,
    "op13_frame_fill_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x
            FROM documents
        ), h AS (
            SELECT *, len(u) AS n,
                   [('0x' || substr(x, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS h
            FROM t
        ), c AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a,
                   greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>')
                          OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), p AS (
            SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p,
                   coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
                   coalesce(array_to_string(u[b + 1:], ''), '') AS s
            FROM c
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                                WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
