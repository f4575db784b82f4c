"""From raw documents to packed training sequences, in five stages.

STAGES lists (name, function); each takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns a DataFrame, which is written and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import jaccard, langid, mixing, packing, pii
from loomspark.llm.queries import tokenizer_path
from loomspark.scratch import materialize
from loomspark.session import open_table, small_batches


def _aside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs`` whose columns of these names, which the stage's operator uses itself, bear others meanwhile."""
    held = {c: f"_aside_{i}_{c}" for i, c in enumerate(docs.columns) if c in names}
    out = stage(docs.withColumnsRenamed(held))
    return out.withColumnsRenamed({v: k for k, v in held.items()})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang becomes the predicted language.

    Null texts and those without a letter go, and so do all if no row has a lang to learn from. A null lang or
    doc_id is no matter. Very long texts are parsed whole. Repeated rows all stay; equal costs go to the language
    that sorts first. An empty table stays empty. Other columns are kept, whatever their names.
    """
    small_batches(spark)

    def stage(docs: DataFrame) -> DataFrame:
        model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out())
        named = langid.assign(docs, model).where("lang_pred <> 'und'")
        return named.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])

    return _aside(docs, ("lang_pred", "score"), stage)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    A null doc_id comes last; of rows with the same id and text one stays. Rows without words are copies of
    nothing and all stay. Very long texts are compared whole. An empty table stays empty. Other columns are kept,
    whatever their names.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets masked; n_chars follows.

    Null and empty texts stay. Very long texts are searched whole. Repeated rows are masked alike, rows without
    an id like others. An empty table stays empty. Other columns are kept, whatever their names.
    """
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a shard's quota in part, with its n_chars.

    Texts that are null or have no words are never taken. A null source is a source of its own, the last one. A
    null doc_id and repeated rows are taken like others. Very long texts may be cut between words at a quota's end. An
    empty table stays empty. Other columns are kept, whatever their names.
    """

    def stage(docs: DataFrame) -> DataFrame:
        out = mixing.taken_texts(mixing.mix(docs))
        return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out

    return _aside(docs, mixing.OWN, stage)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids.

    Null and empty texts are one piece of one id. Repeated rows and rows without an id are packed each. Very long
    texts are cut into pieces. An empty table gives no rows. Other columns are not read.
    """
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packed", packed)]

#: Language models, components and packing have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = open_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
