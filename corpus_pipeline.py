"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing of sources, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's result in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import exact_dedup, mixing, packing, quality, sketch_join
from cloudloom.llm._common import Workspace, maybe_broadcast, numbered

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(ws: Workspace, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered ``rows`` without those that ``gone(rid)`` lists; rejected rows are the few, so they are what is joined."""
    gone = ws.table(gone)
    ws.keep(rows, gone)
    return rows.join(maybe_broadcast(gone), "rid", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(Workspace(spark), docs, *COLUMNS).where("kept").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    rows = numbered(ws, docs, *COLUMNS)
    return without(ws, rows, exact_dedup.exact_dedup(ws, rows, rid="rid").where("not kept").select("rid"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with five-word shingles at 0.8 or more, the one with the smallest doc_id stays."""
    ws = Workspace(spark)
    rows = numbered(ws, docs, *COLUMNS)
    found = ws.table(sketch_join.similar(ws, rows, width=5, percent=80, rid="rid").select("rid", "doc_id", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    stay = ws.table(found.groupBy("root").agg(first).select("root", F.col("first.rid").alias("stay")))
    return without(ws, rows, found.join(stay, "root").where("rid <> stay").select("rid"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(Workspace(spark), docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mixed_sources),
    ("best_fit_packing", packed),
]

#: SQL can't express the packing plan; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.table(docs)
    return docs
