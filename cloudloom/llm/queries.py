"""Queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import anchors, divergence, exact_dedup, html_text, mixing, packing, quality, sharding, sketch_join, toxicity, turn_repair, warc, wavelet
from cloudloom.llm._common import Workspace


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(Workspace(spark), documents(spark, sf_dir)).drop("text_group")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join.similar(Workspace(spark), documents(spark, sf_dir)).drop("rid", "root")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(Workspace(spark), documents(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(Workspace(spark), pages(spark, sf_dir)).drop("rid")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    return warc.read(warc.write(ws, pages(spark, sf_dir), f"{ws.path}/warc")).drop("html")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(Workspace(spark), documents(spark, sf_dir))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    return wavelet.read(wavelet.write(ws, documents(spark, sf_dir), f"{ws.path}/shards"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(Workspace(spark), documents(spark, sf_dir)).drop("rid")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turn_repair.repair(rows).withColumn("repaired_sha256", turn_repair.digest(F.col("repaired"))).drop("turns", "repaired")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(Workspace(spark), documents(spark, sf_dir))


def op13_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = anchors.dedup(Workspace(spark), documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_sketch_join": op3_sketch_join,
    "op4_quality": op4_quality,
    "op5_html_text": op5_html_text,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_wavelet": op9_wavelet,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_divergence": op12_divergence,
    "op13_anchors": op13_anchors,
}

ORACLES = {
    "op13_anchors": anchors.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op6_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, sha256(coalesce(html, '')) as g from pages),
        k as (select *, max(page_id) over (partition by g) as keep from p)
        select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
               case when n >= 1000 and page_id <> keep then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> keep then keep end as refers_to
        from k""",
    "op10_exact_dedup": """
        with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
        select doc_id, max(doc_id) over w as keep_id, cast(count(*) over w as bigint) as group_size,
               doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from n window w as (partition by t)""",
}
