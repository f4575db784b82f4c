"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import capdedup, jaccard, langid, licenses, linehtml, mixing, packing, pii, quality, warc
from loomspark.session import open_table as table


def tokenizer_path() -> str:
    """The vocabulary that the contract names; packing takes any tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90).drop("key", "component")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = licenses.scan_documents(table(spark, sf_dir, "documents"))
    line = F.transform("notices", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], x["different"]))
    return notices.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(line, ",").alias("notices"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linehtml.extract_pages(table(spark, sf_dir, "pages"))


def op10_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capdedup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_langid": op6_langid,
    "op7_packing": op7_packing,
    "op8_license": op8_license,
    "op9_html": op9_html,
    "op10_caps": op10_caps,
}

#: Of these, only queries whose whole method SQL can express have an oracle; the others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {}
