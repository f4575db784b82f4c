"""Contracts, quarantine, change classes and reconciliation of snapshots.

Parquet has no upsert: a change frame says what happens to each key, and the next snapshot is written from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_error(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "error_code") -> DataFrame:
    """The first rule that holds names the error; null if none does."""
    code = F.lit(None).cast("string")
    for error, broken in reversed(rules):
        code = F.when(F.coalesce(broken, F.lit(False)), error).otherwise(code)
    return df.withColumn(name, code)


def accepted(df: DataFrame, name: str = "error_code") -> DataFrame:
    return df.where(F.col(name).isNull()).drop(name)


def quarantined(df: DataFrame, source_ref: Column, raw: Column, name: str = "error_code") -> DataFrame:
    """(error_code, source_ref, raw); raw is held to its first 500 characters."""
    return df.where(F.col(name).isNotNull()).select(F.col(name).alias("error_code"), source_ref.alias("source_ref"), F.substring(raw, 1, 500).alias("raw"))


def error_summary(df: DataFrame, name: str = "error_code") -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("error_code")).agg(F.count("*").alias("n"))


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key, as a later line of a file replaces an earlier one."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """(keys, change): insert, unchanged, update or delete, by null-safe comparison of ``compared``."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in compared], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in compared], F.lit(True).alias("_n"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    change = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(same, "unchanged").otherwise("update")
    return o.join(n, list(keys), "full_outer").select(*keys, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], compared: Sequence[str], replaced: Sequence[str]) -> DataFrame:
    """The next snapshot: new rows, and old ones whose ``compared`` differ take ``replaced`` from the new; nothing is deleted."""
    o, n = old.alias("o"), new.alias("n")
    on, same = F.lit(True), F.lit(True)
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    for c in compared:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    fresh, gone = F.col(f"o.{keys[0]}").isNull(), F.col(f"n.{keys[0]}").isNull()
    out = []
    for c in old.columns:
        take_new = fresh if c not in replaced else fresh | (~gone & ~same)
        out.append(F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, on, "full_outer").select(*out)


def reconcile(old: DataFrame, wanted: DataFrame, keys: Sequence[str], scope: DataFrame, scope_keys: Sequence[str]) -> DataFrame:
    """(keys, action): insert what is missing and delete what is stale, the latter only for rows processed in this run."""
    stale = old.join(scope, list(scope_keys), "left_semi").join(wanted, list(keys), "left_anti").select(*keys, F.lit("delete").alias("action"))
    return wanted.join(old, list(keys), "left_anti").select(*keys, F.lit("insert").alias("action")).unionByName(stale)


def fill_missing(df: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``source`` where it is null or empty."""
    other = source.select(F.col(key), F.col(column).alias("_given"))
    given = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.coalesce("_given", column)).otherwise(F.col(column))
    return df.join(other, key, "left").withColumn(column, given).drop("_given")


def replace_version(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """All versions but those in ``new``, and ``new``."""
    return old.join(new.select(version).distinct(), version, "left_anti").unionByName(new)


def review_overlay(facts: DataFrame, reviews: DataFrame, key: str = "fact_key") -> DataFrame:
    """Facts with their last review: the machine's value is kept once, a changed value has no number, a confirmed one confidence 1."""
    last = last_by(reviews, [key], [F.col("reviewed_at"), F.col("review_id")]).select(key, F.col("value_text").alias("_v"), F.lit(True).alias("_r"))
    changed = F.col("_r") & F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(F.col("value_text"))
    joined = facts.join(last, key, "left").withColumn("_c", F.coalesce(changed, F.lit(False)))
    return joined.select(
        *[c for c in facts.columns if c not in ("value_text", "value_num", "confidence")],
        F.when(F.col("_c"), F.col("value_text")).alias("original_value_text"),
        F.when(F.col("_c"), F.col("_v")).otherwise(F.col("value_text")).alias("value_text"),
        F.when(~F.col("_c"), F.col("value_num")).alias("value_num"),
        F.when(F.col("_r"), 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )
