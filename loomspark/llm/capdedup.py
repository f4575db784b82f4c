"""Near-duplicate vectors by spherical caps with structured random product codes.

A direction is the concatenation of one codeword from each of ``PARTS`` small random codebooks, so a few
codewords make very many directions. A vector's cap is as high as lets in its nearest directions, a number
that all caps share; these are list-decoded from sorted partial products, of which only pairs of ranks i, j
whose product is no more than that number can be among them. A vector belongs to the filter of each direction
in its cap; vectors are joined on filters and verified. The number of directions grows with the number of
vectors, so a filter holds a few unrelated ones at any size, and so does the number in a cap, as finer
directions are shared less often: recall stays about the same. (With one height for all caps, half of the
vectors have no direction in theirs.)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.lean import lean
from loomspark.operators.components import connected_components
from loomspark.scratch import materialize

PARTS = 4
#: Filters of a vector up to so many vectors, and the power by which they grow beyond; unrelated vectors that a filter is expected to hold.
FILTERS, VECTORS, GROWTH, LOAD = 16, 10_000, 0.15, 2
#: Vectors of a filter that are compared at once; larger filters are dealt out as pairs of blocks.
BLOCK = 512


class Code:
    """Codebooks for a number of vectors."""

    def __init__(self, dim: int, vectors: int, seed: int = 11, filters: int | None = None) -> None:
        filters = filters or max(FILTERS, round(FILTERS * (vectors / VECTORS) ** GROWTH))
        self.words, self.most = max(4, round((max(vectors, 1) * filters / LOAD) ** (1 / PARTS))), filters
        rng = np.random.default_rng(seed)
        self.cuts = [dim * k // PARTS for k in range(PARTS + 1)]
        self.books = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            w = rng.standard_normal((self.words, b - a))
            self.books.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / PARTS**0.5)

    def _best(self, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest values of each row, in falling order, the smaller code first among equals, and their codes."""
        order = np.lexsort((codes, -values), axis=1)[:, : self.most]
        return np.take_along_axis(values, order, 1), np.take_along_axis(codes, order, 1)

    def _sums(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The greatest sums of one value of x and one of y: the sum of ranks i and j has (i + 1)(j + 1) - 1 sums before it at least."""
        i, j = np.nonzero(np.multiply.outer(np.arange(1, x[0].shape[1] + 1), np.arange(1, y[0].shape[1] + 1)) <= self.most)
        return self._best(x[0][:, i] + y[0][:, j], x[1][:, i] * size + y[1][:, j])

    def filters(self, v: np.ndarray) -> np.ndarray:
        """Sorted numbers of the directions in the cap of each unit vector."""
        k = self.words
        first = [self._best(p := v[:, a:b] @ book.T, np.broadcast_to(np.arange(k), p.shape)) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        return np.sort(self._sums(self._sums(first[0], first[1], k), self._sums(first[2], first[3], k), k * k)[1], axis=1)


def _unit(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are usable: of this dimension, finite and not zero."""
    out, good = np.zeros((len(rows), dim)), np.zeros(len(rows), bool)
    for i, x in enumerate(rows):
        if x is not None and len(x) == dim and None not in x:
            v = np.asarray(x, np.float64)
            top = np.abs(v).max(initial=0)
            if np.isfinite(top) and top > 0:
                v = v / top
                out[i], good[i] = v / np.sqrt(v @ v), True
    return out, good


def _again(raw: list[bytes], single: bool) -> np.ndarray:
    """Unit vectors in double precision from the components as they are stored; a vector's do not depend on the others."""
    v = np.frombuffer(b"".join(raw), np.float32 if single else np.float64).reshape(len(raw), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _decoded(code, dim: int, single: bool, base: int = 0):
    """Filters of each vector; its components travel in single precision where they are stored so."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = code.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rows = part.column("embedding").to_pylist()
                unit, good = _unit(rows, dim)
                found = c.filters(unit[good]) + base
                ids = [x for x, g in zip(part.column("nid").to_pylist(), good, strict=True) if g]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.asarray(x, kind).tobytes() for x, g in zip(rows, good, strict=True) if g], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["nid", "raw", "own", "filters"])

    return run


def first_common(own: list[np.ndarray], f: int) -> np.ndarray:
    """For vectors that all are in filter f: which pairs share a smaller one too."""
    lower = [x[: np.searchsorted(x, f)] for x in own]
    every, at = np.unique(np.concatenate(lower), return_inverse=True)
    m = np.zeros((len(own), max(1, len(every))), np.float32)
    m[np.repeat(np.arange(len(own)), [len(x) for x in lower]), at] = 1
    return m @ m.T > 0


def _linked(cosine: float, single: bool):
    """Links of blocks of filters, each pair only in the first filter that both are in."""

    def pairs(rows: dict[str, list]) -> tuple[list, list, list]:
        unit = _again(rows["raw"], single)
        ids, side, n = np.array(rows["nid"]), np.array(rows["side"]), np.array(rows["times"])
        near = np.triu(unit @ unit.T >= cosine - 1e-9, 1)
        if rows["a"] != rows["b"]:
            near &= side[:, None] != side[None, :]
        if not near.any():
            return [], [], []
        i, j = np.nonzero(near)
        # One sum for each pair in a fixed order, so its verdict is the same in any block.
        exact = np.zeros(len(i))
        for k in range(0, len(i), 100_000):
            exact[k : k + 100_000] = np.einsum("ij,ij->i", unit[i[k : k + 100_000]], unit[j[k : k + 100_000]])
        near[i[exact < cosine], j[exact < cosine]] = False
        near &= ~first_common([np.frombuffer(x, np.int64) for x in rows["own"]], rows["f"])
        near |= near.T
        links = near @ n
        has = np.flatnonzero(links)
        if not len(has):
            return [], [], []
        within = near[np.ix_(has, has)]
        root = np.arange(len(has))
        while True:  # the first vector that each reaches in this block; with it, a forest that keeps the block's components
            new = np.minimum(root, np.where(within, root[None, :], len(has)).min(axis=1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return ids[has].tolist(), links[has].tolist(), ids[has[root]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, None
        out: tuple[list, list, list] = ([], [], [])

        def flush(last: bool = False) -> Iterator[pa.RecordBatch]:
            if rows is not None and len(rows["nid"]) > 1:
                for o, p in zip(out, pairs(rows), strict=True):
                    o.extend(p)
            if out[0] and (last or len(out[0]) > 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["nid", "links", "near"])
                for o in out:
                    o.clear()

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("f", "a", "b")], strict=True)
            values = zip(*[batch.column(c).to_pylist() for c in ("nid", "raw", "own", "side", "times")], strict=True)
            for key, value in zip(keys, values, strict=True):
                if key != now:
                    yield from flush()
                    now, rows = key, dict(zip(("f", "a", "b"), key, strict=True)) | {c: [] for c in ("nid", "raw", "own", "side", "times")}
                for c, x in zip(("nid", "raw", "own", "side", "times"), value, strict=True):
                    rows[c].append(x)
        yield from flush(last=True)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding).

    Vectors whose cosine, in double precision, is ``cosine`` or more are linked; almost all of them are found
    (see README for the measured recall) and none below it. Equal vectors are one node with a number of
    copies. component_id is the smallest vec_id reachable by links.

    Vectors of different dimensions do not link. A vector that is null, empty, zero, or holds null or non-finite
    components links with nothing: n_links 0, its own id as component_id, kept. Repeated rows are separate rows that link
    with each other. An empty table gives no rows. Labels and other columns are not read.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    rows = vectors.select("vec_id", "embedding", F.expr("transform(embedding, x -> cast(x as double))").alias("_v"))
    bad = F.col("_v").isNull() | F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("_v", lambda x: x != 0)
    rows = rows.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    dims = sorted(r["d"] for r in rows.where("not _bad").select(F.size("_v").alias("d")).distinct().collect()) or [1]
    # Equal vectors have equal keys: 128 bits over the components.
    key = F.unhex(F.md5(F.concat_ws(",", F.transform("_v", lambda x: (x + 0.0).cast("string"))).cast("binary")))
    rows = materialize(rows.select("vec_id", "embedding", F.when(~F.col("_bad"), key).alias("key")), "caps-rows")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rid"), F.count("*").alias("times"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("nid", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")), "caps-nodes")
    # Vectors of each dimension have a code, and so filters, of their own: the numbers of another's lie beyond them.
    sizes = {r["d"]: r["count"] for r in nodes.groupBy(F.size("embedding").alias("d")).count().collect()}
    decoded, base = [], 0
    for dim in dims:
        of_dim = Code(dim, sizes.get(dim, 0), seed)
        code = spark.sparkContext.broadcast(of_dim)
        mine = nodes.where(F.size("embedding") == dim).select("nid", "embedding")
        decoded.append(mine.mapInArrow(lean(_decoded(code, dim, single, base)), "nid long, raw binary, own binary, filters array<long>"))
        base += of_dim.words**PARTS
    held = materialize(reduce(DataFrame.unionByName, decoded).join(nodes.select("nid", "times"), "nid"), "caps-filters")
    sizes = held.select(F.explode("filters").alias("f")).groupBy("f").count().where("count > 1").select("f", F.expr(f"cast((count + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
    member = held.select(F.explode("filters").alias("f"), "nid", "raw", "own", "times").hint("merge").join(sizes, "f")
    member = member.withColumn("side", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("f", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "nid", "raw", "own", "side", "times")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = materialize(
        dealt.repartition(n, "f", "a", "b").sortWithinPartitions("f", "a", "b", "nid").mapInArrow(lean(_linked(cosine, single)), "nid long, links long, near long"), "caps-links"
    )
    total = links.groupBy("nid").agg(F.sum("links").alias("links"))
    labels = connected_components(links.select(F.col("nid").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "nid")
    of_node = nodes.select("key", "nid", "rid", "times").join(total, "nid", "left").join(labels, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    least = of_node.groupBy("component").agg(F.min("rid").alias("least"))
    named = of_node.join(least, "component").select("key", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "least")
    out = rows.select("vec_id", "key").hint("merge").join(named, "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
