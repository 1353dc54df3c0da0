"""A corpus pipeline: toxicity filter, near-duplicates, decontamination, redaction, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents;
the last returns packed pieces. run() writes each stage as Parquet into the cluster's shared folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, packing, pii, queries, simhash, toxicity
from quillspark.llm.common import cut, read, shared_folder, without

#: No SQL for the result: the stages hold trained models and hashes that SQL lacks. See tests/llm/test_pipeline.py.
ORACLE_SQL = None
#: Documents are near-duplicates from this similarity of their five-word shingles on.
SIMILAR = 0.8


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row, rest): row is a 64-bit hash of doc_id and text, rest the whole row, so no name can clash.

    A null doc_id is a value beyond 2^62 from the text.
    """
    text = F.col("text").cast("string")
    none = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    key = F.coalesce(F.col("doc_id").cast("long"), none)
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(key.alias("doc_id"), text.alias("text"), F.xxhash64(key, F.coalesce(text, F.lit(""))).alias("row"), rest.alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, docs, sf_dir), queries.TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are similar the row with the smallest id stays; of rows with the
    same id and text, one.

    Rows that repeat an id with another text are judged by their own text.
    """
    own = _packed(docs)
    near = simhash.near_duplicates(own.select(F.col("row").alias("doc_id"), "text"), similarity=SIMILAR)
    found = cut(near.select(F.col("doc_id").alias("row"), F.col("component_id").alias("c")))
    rows = cut(found.groupBy("row").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("n")).join(own.groupBy("row").agg(F.min("doc_id").alias("doc_id")), "row"))
    first = rows.groupBy("c").agg(F.min(F.struct("doc_id", "row"))["row"].alias("first"))
    rows = cut(rows.join(first, "c").select("row", "n", (F.col("row") == F.col("first")).alias("stays")))
    once = without(own, rows.filter("not stays or n > 1"), "row")
    repeated = own.join(rows.filter("stays and n > 1").select("row"), "row", "left_semi").dropDuplicates(["row"])
    return _unpacked(once, docs).unionByName(_unpacked(repeated, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go. Rows that repeat an id are judged by their own text."""
    own = _packed(docs)
    found = decontaminate.contaminated(own.select("row", "doc_id", "text"), read(spark, sf_dir, "benchmark"), row="row")
    return _unpacked(without(own, found.select(F.col("doc_row").alias("row")), "row"), docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to their kind in brackets; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{own}/{name}")
        docs = spark.read.parquet(f"{own}/{name}")
    return docs
