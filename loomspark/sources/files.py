"""Files in and out: JSON lines, CSV indexes, cards, fingerprints, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.operators.ingest import last_by


#: Files of an adapter's folder, and what its card must tell.
CARD, CONFIG, WEIGHTS = "adapter_card.json", "adapter_config.json", ("adapter_model.safetensors", "adapter_model.bin")
CARD_FIELDS = ("base_model", "dataset_version", "lora", "training")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines as records; blank lines are skipped. ``_line`` holds the line, ``_bad`` whether it is no JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("_line"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("_r"))
    return parsed.select("_r.*", "_line", F.expr("try_parse_json(_line)").isNull().alias("_bad"))


def read_csv_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV with a header, all strings, the last line of a key replacing earlier ones."""
    rows = spark.read.csv(path, header=True, inferSchema=False).withColumn("_n", F.monotonically_increasing_id())
    return last_by(rows.where(F.col(key).isNotNull()), [key], [F.col("_n")]).drop("_n")


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def find_sources(spark: SparkSession, folder: str) -> tuple[str, str]:
    """``listings.jsonl`` and the last ``source_listing_*.csv`` by name, in any store that Spark reads."""
    names = _names(spark, folder)
    csv = [n for n in names if re.fullmatch(r"source_listing_.*\.csv", n)]
    if "listings.jsonl" not in names or not csv:
        raise FileNotFoundError(f"{folder} needs listings.jsonl and source_listing_*.csv")
    return f"{folder}/listings.jsonl", f"{folder}/{csv[-1]}"


def read_card(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object; no row where the file is missing or broken."""
    folder, _, name = path.rpartition("/")
    if name not in _names(spark, folder):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    return text.where(F.expr("try_parse_json(value)").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")


def fingerprints(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, folder, length, fingerprint): 16 hex digits of each file's SHA-256."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "length", F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"))


def adapters(spark: SparkSession, root: str) -> DataFrame:
    """(name, base_model, fingerprint, size_mb, has_card, loadable, problems) of each folder in ``root``, in any store that Spark reads.

    An adapter can be loaded if it has weights, a configuration, and a base model, named by its card or else its
    configuration; what else is missing is listed. A root without folders, or none, gives no rows.
    """
    kinds = "name string, base_model string, fingerprint string, size_mb double, has_card boolean, loadable boolean, problems array<string>"
    if not any(_names(spark, f"{root}/{n}") for n in _names(spark, root)):
        return spark.createDataFrame([], kinds)
    files = spark.read.format("binaryFile").load(f"{root}/*/*").select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "content")
    # Of a folder's two kinds of weights the first counts; only its digest leaves the task.
    at = F.array_position(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("file"))
    json = lambda file: F.max(F.when((F.col("file") == file) & F.expr("try_parse_json(cast(content as string))").isNotNull(), F.col("content").cast("string")))
    found = files.where(F.col("file").isin(CARD, CONFIG, *WEIGHTS)).groupBy("name").agg(
        json(CARD).alias("card"), json(CONFIG).alias("config"), F.min_by(F.struct(F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"), F.col("length")), F.when(at > 0, at)).alias("w"),
    )
    field = lambda c, name: F.nullif(F.get_json_object(c, f"$.{name}"), F.lit(""))
    base = F.coalesce(field("card", "base_model"), field("config", "base_model_name_or_path"))
    missing = F.array_compact(F.array(*[F.when(field("card", f).isNull(), F.lit(f)) for f in CARD_FIELDS]))
    problems = F.array_compact(F.array(
        F.when(F.col("config").isNull(), F.lit(f"no {CONFIG}")), F.when(F.col("w").isNull(), F.lit("no weights")), F.when(F.col("card").isNull(), F.lit(f"no {CARD}")),
        F.when(F.col("card").isNotNull() & (F.size(missing) > 0), F.concat(F.lit(f"{CARD} lacks "), F.array_join(missing, ", "))), F.when(field("card", "smoke") == "true", F.lit("made from trial data")), F.when(base.isNull(), F.lit("no base model")),
    ))
    loadable = F.col("w").isNotNull() & F.col("config").isNotNull() & base.isNotNull()
    return found.select("name", base.alias("base_model"), F.coalesce("w.fingerprint", F.lit("")).alias("fingerprint"), F.coalesce(F.bround(F.col("w.length") / 1e6, 1), F.lit(0.0)).alias("size_mb"), F.col("card").isNotNull().alias("has_card"), loadable.alias("loadable"), problems.alias("problems"))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """(messages, n_messages, answer) of lines of chat samples; blank lines, and lines that are no samples, are left out. answer is the last message's text."""
    rows = read_jsonl(spark, path, "messages array<struct<role: string, content: string>>").where(~F.col("_bad") & (F.size("messages") > 0))
    return rows.select("messages", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("answer"))


def write_jsonl(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A JSON object a line, letters as they are."""
    columns = [c for c in df.columns if c != partition]
    lines = df.select(*([partition] if partition else []), F.to_json(F.struct(*columns)).alias("value"))
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).text(path)


def write_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``df`` has, as a version or a kind of job."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def markdown(title: str, df: DataFrame, limit: int = 200) -> str:
    """A report table of a small result, in its own order."""
    rows = df.limit(limit).collect()
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", r"\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
