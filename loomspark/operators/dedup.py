"""Exact and near-duplicate clusters of records by content hash and SimHash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import deaccent, flat_tokens, let, syllables
from loomspark.operators.components import connected_components
from loomspark.scratch import materialize

#: Bits that may differ, words of a shingle.
MAX_BITS, SHINGLE = 6, 3


def shingles(tokens: Column, width: int = SHINGLE) -> Column:
    """Joined neighbours; the tokens themselves where there are fewer than ``width``."""

    def join(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - width + 1, F.lit(1)))
        return F.when(F.size(t) < width, t).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(t, i, width), " ")))

    return let(tokens, join)


def _signature(flat: str | None, digest: Callable[[bytes], bytes]) -> bytes | None:
    """The majority of each bit of the shingles' digests, a tie being 0; none without words."""
    words = flat_tokens(flat)
    if not words:
        return None
    grams = words if len(words) < SHINGLE else [" ".join(g) for g in zip(*[words[i:] for i in range(SHINGLE)])]
    held = np.frombuffer(b"".join(digest(g.encode()) for g in grams), np.uint8).reshape(len(grams), -1)
    votes = np.unpackbits(held, axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(grams)).tobytes()


def _signatures(flat: DataFrame, digest: Callable[[bytes], bytes], shown: Callable[[bytes | None], object], kind: str) -> DataFrame:
    """(id, simhash) of (id, flat), a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shown(_signature(x, digest)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string() if kind == "string" else pa.int64())], ["id", "simhash"])

    return flat.mapInArrow(run, f"id {flat.schema['id'].dataType.simpleString()}, simhash {kind}")


def simhash_exact(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, simhash) with 16 hex digits: the majority of each bit of the shingles' BLAKE2b-64 digests, a tie being 0; '' without words.

    Spark has no BLAKE2b, so the digests are taken in Python, a batch at a time.
    """
    flat = docs.select(F.col(id_).alias("id"), deaccent(F.col(text)).alias("flat"))
    return _signatures(flat, lambda g: hashlib.blake2b(g, digest_size=8).digest(), lambda x: "" if x is None else x.hex(), "string")


def simhash_md5(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """What :func:`simhash_native` gives for 32 bits, by rows in Python instead of a row a shingle; that itself where ids repeat, as it counts their texts together."""
    if not docs.groupBy(id_).count().where("count > 1").isEmpty():
        return simhash_native(docs, id_, text)
    flat = docs.select(F.col(id_).alias("id"), deaccent(F.col(text)).alias("flat"))
    return _signatures(flat, lambda g: hashlib.md5(g).digest()[:4], lambda x: None if x is None else int.from_bytes(x, "big"), "long").where("simhash is not null")


def simhash_native(docs: DataFrame, id_: str, text: str, bits: int = 32) -> DataFrame:
    """(id, simhash): the same vote over ``bits`` bits of each shingle's MD5, in DataFrame functions alone."""
    grams = docs.select(F.col(id_).alias("id"), F.explode(shingles(syllables(F.col(text)))).alias("g")).where("g is not null")
    h = grams.select("id", F.conv(F.substring(F.md5("g"), 1, bits // 4), 16, 10).cast("long").alias("h"))
    votes = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{i}") for i in range(bits)]
    total = F.lit(0).cast("long")
    for i in range(bits):
        total = total + F.when(F.col(f"b{i}") > 0, F.lit(1 << i)).otherwise(0)
    return h.groupBy("id").agg(*votes).select("id", total.alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ; 64 where either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def tables(bits: int, most: int, n: int, load: int = 4, blocks: int = 10) -> list[list[tuple[int, int]]]:
    """Sets of blocks (from, width) of a signature, of which two signatures within ``most`` bits share one whole.

    Cut into m blocks, they differ in ``most`` at most, so some m - ``most`` are equal. More blocks make wider keys
    and more sets; as few are taken as let a key of ``n`` signatures hold ``load`` unrelated ones, at most ``blocks``.
    """
    for m in range(most + 1, max(most + 1, min(blocks, bits)) + 1):
        cuts = [bits * i // m for i in range(m + 1)]
        own = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        sets = [list(x) for x in combinations(own, m - most)]
        if n <= load << min(sum(w for _, w in x) for x in sets):
            break
    return sets


def band_keys(simhash: Column, sets: list[list[tuple[int, int]]]) -> Column:
    part = lambda a, w: F.shiftrightunsigned(simhash, a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1))
    return F.array(*[F.xxhash64(F.lit(i), *[part(a, w) for a, w in own]) for i, own in enumerate(sets)])


def near_pairs(signatures: DataFrame, bits: int = 32, most: int = MAX_BITS) -> DataFrame:
    """(a, b, distance) of all (id, simhash) within ``most`` bits.

    Equal signatures are one representative in the join, and the others are tied to it: a large group of copies
    adds a row for each copy, not for each pair. Representatives meet by sets of blocks that are equal, as wide
    as their number asks for. That join is never broadcast: Spark sees a small table and not that each of its
    rows becomes one for every set.
    """
    signatures = materialize(signatures, "signatures")
    rep = materialize(signatures.groupBy("simhash").agg(F.min("id").alias("id")), "hamming")
    star = signatures.join(rep.withColumnRenamed("id", "a"), "simhash").where("id != a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    banded = rep.withColumn("band", F.explode(band_keys(F.col("simhash"), tables(bits, most, rep.count()))))
    x, y = banded.select("band", F.col("id").alias("a"), F.col("simhash").alias("ha")), banded.select("band", F.col("id").alias("b"), F.col("simhash").alias("hb"))
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    near = x.join(y.hint("merge"), "band").where((F.col("a") < F.col("b")) & (d <= most)).select("a", "b", d.alias("distance")).distinct()
    return near.unionByName(star)


def clusters(records: DataFrame, pairs: DataFrame, id_: str = "id", length: str = "length") -> DataFrame:
    """(id, cluster_id, representative, size): the smallest id names a cluster, its longest record, smallest id first, stands for it."""
    found = connected_components(pairs.select("a", "b"))
    of = records.join(found, records[id_] == found["node"], "left").select(F.col(id_).alias("id"), F.coalesce("component", F.col(id_)).alias("cluster_id"), F.col(length).alias("_n"))
    w = Window.partitionBy("cluster_id")
    order = w.orderBy(F.desc("_n"), F.asc("id"))
    return of.select("id", "cluster_id", (F.row_number().over(order) == 1).alias("is_representative"), F.count("*").over(w).alias("cluster_size"))


def exact_clusters(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(cluster_key, cluster_id, cluster_size) of equal texts, by SHA-256, cluster_id being the smallest id; map-side sums, no window."""
    return docs.groupBy(F.sha2(text, 256).alias("cluster_key")).agg(F.min(id_).alias("cluster_id"), F.count("*").alias("cluster_size"))
