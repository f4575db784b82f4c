"""Facts with provenance from wide records, and text chunks for the index."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import BLANKS, SENTENCE, sha_key, token_estimate

#: Sizes in characters.
CHUNK, OVERLAP, LEAST = 700, 120, 60
#: In Python ``\s`` is more than Java's six characters.
_SENTENCE = re.compile(SENTENCE.replace(r"\s", r"[ \t\n\x0b\f\r]"))


def unpivot(df: DataFrame, id_: str, columns: dict[str, str], arrays: dict[str, str] | None = None) -> DataFrame:
    """(id, predicate, value_text, value_num): a fact for each column that has a true value, and for each element of the arrays.

    Zero, '' and null are no values.
    """
    kinds = dict(df.dtypes)

    def fact(predicate: str, column: str) -> Column:
        c = F.col(column)
        numeric = kinds[column] not in ("string", "boolean")
        there = c.isNotNull() & ((c != 0) if numeric else (c != ""))
        return F.when(there, F.struct(F.lit(predicate).alias("predicate"), c.cast("string").alias("value_text"), (c.cast("double") if numeric else F.lit(None).cast("double")).alias("value_num")))

    wide = F.array_compact(F.array(*[fact(p, c) for p, c in columns.items()]))
    for predicate, column in (arrays or {}).items():
        named = F.lit(predicate).alias("predicate")
        wide = F.concat(wide, F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v: F.struct(named, v.alias("value_text"), F.lit(None).cast("double").alias("value_num"))))  # noqa: B023
    return df.select(F.col(id_).alias("id"), F.explode(wide).alias("f")).select("id", "f.*")


def keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("fact_key", sha_key(F.col("id").cast("string"), "predicate", "value_text"))


def _packed(t: str, size: int, overlap: int, least: int) -> list[str]:
    """The chunks of a text without white space at its ends."""
    if len(t) <= size:
        return [t] if t else []
    out, now = [], ""
    for part in _SENTENCE.split(t):
        s = part.strip(BLANKS)
        if not s:
            continue
        if now and len(now) + len(s) + 1 > size:
            out.append(now.strip(BLANKS))
            now = f"{now[max(len(now) - overlap, 0) :]} {s}"
        else:
            now = f"{now} {s}".strip(BLANKS)
    if now := now.strip(BLANKS):
        out.append(now)
    return [c for c in out if len(c) >= least] or [t[:size]]


def pack_sentences(text: Column, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunks of whole sentences up to ``size`` characters, each begun with the tail of the last; short chunks go, if any other stays.

    What is packed next depends on what was packed before, so it is a loop over the text's sentences in Arrow
    batches; a fold of expressions copies its state and compiles nothing, which took ten times as long.
    """

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([_packed((t or "").strip(BLANKS), size, overlap, least) for t in texts.to_pylist()], pa.list_(pa.string()))

    return pack(text)


def chunks(df: DataFrame, id_: str, header: Column, fact_card: Column, title: Column, body: Column) -> DataFrame:
    """(id, chunk_type, seq, text, token_count, content_hash): a card of facts, the title, and the body by sentences, each under the header."""
    headed = lambda t: F.when(F.coalesce(header, F.lit("")) == "", t).otherwise(F.concat(header, F.lit("\n"), t))
    one = lambda kind, seq, t: F.struct(F.lit(kind).alias("chunk_type"), seq.alias("seq"), t.alias("text"))
    rows = F.concat(
        F.when(F.trim(fact_card) != "", F.array(one("facts", F.lit(0), fact_card))).otherwise(F.array().cast("array<struct<chunk_type: string, seq: int, text: string>>")),
        F.when(F.trim(title) != "", F.array(one("title", F.lit(0), headed(title)))).otherwise(F.array().cast("array<struct<chunk_type: string, seq: int, text: string>>")),
        F.transform(pack_sentences(body), lambda t, i: one("description", i, headed(t))),
    )
    out = df.select(F.col(id_).alias("id"), F.explode(rows).alias("c")).select("id", "c.*")
    return out.withColumns({"token_count": token_estimate(F.col("text")), "content_hash": F.sha2("text", 256)})


def fact_card(facts: DataFrame, labels: dict[str, str], order: str = "fact_no") -> DataFrame:
    """(id, card): a line 'Label: v1, v2' for each label, in order of first appearance, values once."""
    named = facts.join(facts.sparkSession.createDataFrame(list(labels.items()), "predicate string, label string"), "predicate")
    values = named.groupBy("id", "label").agg(F.min(order).alias("n"), F.array_sort(F.collect_list(F.struct(order, "value_text"))).alias("v"))
    line = F.concat_ws(": ", "label", F.array_join(F.array_distinct(F.transform("v", lambda x: x["value_text"])), ", "))
    return values.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("card"))
