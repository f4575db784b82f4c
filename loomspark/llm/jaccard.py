"""Jaccard join of documents on word n-grams, as a pruned and blocked sparse product.

The incidence matrix has a row for each distinct n-gram set and a column for each n-gram. Its product with
its own transpose holds the overlap of every pair; all but a few entries are never formed:

1. Columns are ordered by document frequency, rare ones first (frequent ones are found by counts that each
   task makes and Spark adds up). A pair that reaches the threshold t shares one of the first
   n - ceil(t n) + 1 columns of either row, so only rows that meet in those prefixes have an entry. The row in
   which a prefix column comes earliest is its centre and meets the others: a group of n near copies gives n
   entries, not n^2.
2. Columns are also cut into bands by their hash, and each row has its number of columns in each band. The
   overlap of two rows is at most the sum over bands of the lesser number; entries whose sum is below the
   overlap that their sizes need are discarded before any column is sent.
3. The other entries are formed in blocks of a pivot and some of its rows. Overlaps are accumulated band by
   band, and an entry is discarded as soon as what it has and what the bands to come can add is too little.
4. Links are joined into components. Prefix columns that still hold rows of different components are
   multiplied out; the overlap that a pair can still have at a column, given what its row shares with any
   other, is held against the one that their sizes need. What is left goes through 2 and 3.

Pairs within a component, once formed, cannot change the components, so leaving them out loses nothing.
Words, n-grams and sets are told apart by hashes (64 bits for an n-gram, 96 for a set).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.lean import lean
from loomspark.llm.shingles import Hasher, set_id, texts
from loomspark.operators.components import connected_components
from loomspark.scratch import materialize

#: Frequent columns that are told to all tasks: 12 bytes each.
MAX_FREQUENT = 2_000_000
#: Documents whose columns are needed again are named by a broadcast up to this number, else by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Rows that a pivot meets in a block; bands in which a block's overlaps are accumulated.
BLOCK, BANDS = 64, 8
_CHUNK, _BYTES = 1_500_000, 8 << 20


def _counts(width: int):
    """Per task: n-grams that it met in two documents or more, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["w", "n"])

        for batch in batches:
            for s in hasher.shingles(texts(batch, "text"), width):
                held.append(s)
                size += len(s)
                if size > _CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def frequent(docs: DataFrame, width: int, limit: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent n-grams and their counts, at most ``limit``: the least count is raised until they fit.

    They only order the columns. Any order gives the same links; this one keeps blocks small.
    """
    seen = materialize(docs.select("text").mapInArrow(lean(_counts(width)), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n >= 4"), "frequent")
    sizes = dict(seen.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > limit:
            break
        least = k
    got = seen.where(F.col("n") >= 2.0**least).toArrow()
    keys, n = got["w"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], np.minimum(n[order], 2**31 - 1).astype(np.int32)


def prefix_length(n: int, percent: int) -> int:
    """Columns of a row of n that a partner must share one of."""
    return n - (percent * n + 99) // 100 + 1


def _rows(width: int, percent: int, keys, counts):
    """doc_id, key, size, id of the set, columns in each band, its prefix columns in their order, and the place of the last of them in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, often, freq = Hasher(), keys.value, counts.value
        for batch in batches:
            sizes, ids, prefixes, lasts, bands = [], [], [], [], []
            for s in hasher.shingles(texts(batch, "text"), width):
                sizes.append(len(s))
                ids.append(set_id(s))
                bands.append(band_sizes(s))
                if not len(s):
                    prefixes.append([])
                    lasts.append((0, 0))
                    continue
                p = prefix_length(len(s), percent)
                n = np.zeros(len(s), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    n = np.where(often[at] == s, freq[at], 0)
                    order = np.argsort(n, kind="stable")
                    s, n = s[order], n[order]
                prefixes.append(s[:p].view(np.int64))
                lasts.append((int(n[p - 1]), int(s[p - 1]) - (1 << 63)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), *[pa.array([x[i] for x in lasts], pa.int64()) for i in (0, 1)]],
                ["doc_id", "key", "n", "sid", "bands", "prefix", "last_n", "last_w"],
            )

    return run


def band_sizes(s: np.ndarray) -> bytes:
    """Columns in each of 2^k bands of hashes, a byte each (255: or more); about four to eight a band, and 16 bands at least."""
    k = max(4, (len(s) // 4).bit_length() - 1)
    return np.minimum(np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def needed(na, nb, percent: int):
    """The least overlap of rows of these sizes that link."""
    return -(-percent * (na + nb) // (100 + percent))


def most_common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each pair of rows the greatest overlap that their bands allow; -1 where a full byte hides it."""
    out = np.zeros(len(a), np.int64)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(zip(map(len, a), map(len, b), strict=True)):
        alike.setdefault(x, []).append(i)
    for (m, n), at in alike.items():
        for k in range(0, len(at), max(1, (4 << 20) // max(m, n))):
            some = at[k : k + max(1, (4 << 20) // max(m, n))]
            x, y = (np.frombuffer(b"".join([side[i] for i in some]), np.uint8).reshape(len(some), -1) for side in (a, b))
            full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
            x, y = (v.reshape(len(some), min(m, n), -1).sum(axis=2, dtype=np.int32) for v in (x, y))
            out[some] = np.where(full, -1, np.minimum(x, y).sum(axis=1))
    return out


def _possible(percent: int):
    """Pairs whose bands allow the overlap that their sizes need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_common(batch.column("ba").to_pylist(), batch.column("bb").to_pylist())
            good = (most < 0) | (most >= needed(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent))
            yield batch.select(["x", "y"]).filter(pa.array(good))

    return run


def _columns(width: int):
    """For each block that a document is in, its columns."""
    names = ["pivot", "salt", "is_row", "sid", "columns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            for s, places in zip(hasher.shingles(texts(batch, "text"), width), batch.column("places").to_pylist(), strict=True):
                sid, columns = set_id(s), s.tobytes()
                for p in places:
                    out.append((p["pivot"], p["salt"], p["is_row"], sid, columns))
                    size += len(columns) + 64
                    if size > _BYTES:
                        yield flush()
                        size = 0
        if out:
            yield flush()

    return run


def overlaps(pivot: np.ndarray, rows: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows link with the pivot: overlaps accumulated over bands of columns, rows that cannot reach theirs left out of the bands to come."""
    sizes = np.array([len(x) for x in rows])
    need = needed(len(pivot), sizes, percent)
    edges = (np.arange(1, BANDS, dtype=np.uint64) << np.uint64(61)) if BANDS == 8 else np.linspace(0, 2**64, BANDS + 1)[1:-1].astype(np.uint64)
    own = np.r_[0, np.searchsorted(pivot, edges), len(pivot)]
    cuts = np.stack([np.r_[0, np.searchsorted(x, edges), len(x)] for x in rows])
    rest = np.minimum(np.diff(cuts, axis=1), np.diff(own)[None, :])
    rest = rest[:, ::-1].cumsum(axis=1)[:, ::-1]  # what this band and those after it can add
    have, alive = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for k in range(BANDS):
        alive = alive[have[alive] + rest[alive, k] >= need[alive]]
        mine = pivot[own[k] : own[k + 1]]
        if not len(alive) or not len(mine):
            continue
        entries = np.concatenate([rows[i][cuts[i, k] : cuts[i, k + 1]] for i in alive])
        of = np.repeat(alive, cuts[alive, k + 1] - cuts[alive, k])
        hit = mine[np.minimum(np.searchsorted(mine, entries), len(mine) - 1)] == entries
        have += np.bincount(of[hit], minlength=len(rows))
    return have >= need


def _product(percent: int):
    """Links (a, b) of the blocks, each a run of equal (pivot, salt) with the pivot's columns first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = None, 0
        pivots: dict[bytes, np.ndarray] = {}
        rows: dict[bytes, np.ndarray] = {}
        links: list[tuple[bytes, bytes]] = []

        def flush() -> None:
            if rows:
                for sid, columns in pivots.items():
                    good = overlaps(columns, list(rows.values()), percent)
                    links.extend((sid, x) for x, g in zip(rows, good, strict=True) if g and x != sid)
            rows.clear()

        for batch in batches:
            for key, is_row, sid, columns in zip(zip(batch.column("pivot").to_pylist(), batch.column("salt").to_pylist(), strict=True), *[batch.column(c).to_pylist() for c in ("is_row", "sid", "columns")], strict=True):
                if key != now or size > _BYTES:
                    flush()
                    size = 0
                if key != now:
                    now = key
                    pivots.clear()
                (rows if is_row else pivots)[sid] = np.frombuffer(columns, np.uint64)
                size += len(columns)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])
                links.clear()
        flush()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return run


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Size and position bounds for rows that share a column at these places."""
    sizes = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    left = F.least(na - pa_, nb - pb)
    return sizes & (left * (100 + percent) >= percent * (na + nb))


def _prefix_rest(n: Column, percent: int) -> Column:
    """Columns of a row outside its prefix."""
    return F.floor((percent * n + 99) / 100).cast("long") - 1


def _ends(pairs: DataFrame) -> DataFrame:
    """(nid, x, y, is_y): each pair by either end."""
    return pairs.select("x", "y", F.explode(F.array(F.struct(F.col("x").alias("nid"), F.lit(False).alias("is_y")), F.struct(F.col("y").alias("nid"), F.lit(True).alias("is_y")))).alias("e")).select("e.nid", "x", "y", "e.is_y")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """Links among different pairs (x, y) of short ids, as pairs (a, b) of set ids."""
    n = pairs.count()
    at = _ends(pairs).join(nodes.select("nid", "n", "bands"), "nid")
    side = lambda c, y: F.first(F.when(F.col("is_y") == y, F.col(c)), ignorenulls=True)
    both = at.groupBy("x", "y").agg(side("n", False).alias("na"), side("n", True).alias("nb"), side("bands", False).alias("ba"), side("bands", True).alias("bb"))
    left = materialize(both.mapInArrow(lean(_possible(percent)), "x long, y long"), f"jaccard-{label}-possible", n)
    # The end with more pairs is the pivot; a block has the pivot and some of the rows that it meets.
    degree = _ends(left).groupBy("nid").agg(F.count("*").alias("deg"))
    dx, dy = (degree.select(F.col("nid").alias(c), F.col("deg").alias(f"d{c}")) for c in "xy")
    led = left.join(dx, "x").join(dy, "y").select(
        F.when(F.col("dx") >= F.col("dy"), F.col("x")).otherwise(F.col("y")).alias("pivot"), F.when(F.col("dx") >= F.col("dy"), F.col("y")).otherwise(F.col("x")).alias("row"),
        F.expr(f"cast(pmod(xxhash64(if(dx >= dy, y, x)), (greatest(dx, dy) + {BLOCK - 1}) div {BLOCK}) as int)").alias("salt"),
    )
    places = led.select(F.col("row").alias("nid"), "pivot", "salt", F.lit(True).alias("is_row")).unionByName(led.select(F.col("pivot").alias("nid"), "pivot", "salt", F.lit(False).alias("is_row")).distinct())
    # A pivot of very many blocks is named in several rows, so no list grows with its group.
    want = places.groupBy("nid", F.expr("salt div 256").alias("piece")).agg(F.collect_list(F.struct("pivot", "salt", "is_row")).alias("places"))
    want = materialize(want.join(nodes.select("nid", "rep"), "nid").select(F.col("rep.doc_id").alias("rid"), F.col("rep.key").alias("rkey"), "places"), f"jaccard-{label}-want", 4 * n)
    few = want.count() <= MAX_BROADCAST_IDS
    named = docs.join(F.broadcast(want) if few else want.hint("merge"), (F.col("key") == F.col("rkey")) & F.col("doc_id").eqNullSafe(F.col("rid"))).select("text", "places")
    formed = named.mapInArrow(lean(_columns(width)), "pivot long, salt int, is_row boolean, sid binary, columns binary")
    made = formed.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "is_row").mapInArrow(lean(_product(percent)), "a binary, b binary")
    return materialize(made, f"jaccard-{label}-links")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, component) for each row of ``docs`` (doc_id, text).

    key is a hash of the row's text and component names its component, which tell rows of one doc_id apart.

    Texts are lower-cased in A-Z and cut at [\\x20\\x09-\\x0D]. A row's set is its distinct ``width``-word
    shingles; the whole sequence, if shorter; empty without words. Rows link when their sets' Jaccard
    similarity is ``percent`` / 100 or more; component_id is the smallest doc_id reachable.

    A null or empty text has n_shingles 0 and its own doc_id as component_id, and links with nothing. Repeated
    rows stay, one result row for each. Rows without a doc_id take part; their component_id is null only if no
    row that they reach has one. Very long texts are taken whole. An empty table gives no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", _key().alias("key"))
    keys, counts = frequent(docs, width)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(
        docs.mapInArrow(lean(_rows(width, percent, spark.sparkContext.broadcast(keys), spark.sparkContext.broadcast(counts))), f"doc_id {kind}, key long, n long, sid binary, bands binary, prefix array<long>, last_n long, last_w long"), "jaccard-rows"
    )
    # Rows with the same set are one node; its number is 64 bits of the set's id, told apart by the id itself where it counts.
    nodes = materialize(
        rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rid"), F.min(F.struct("doc_id", "key")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("prefix").alias("prefix"), F.first("last_n").alias("last_n"), F.first("last_w").alias("last_w"))
        .withColumn("nid", F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long")),
        "jaccard-nodes",
    )
    post = nodes.select("nid", "n", F.posexplode("prefix").alias("pos", "w"))
    first = F.col("pos").cast("long") * F.lit(1 << 40) + F.col("nid").bitwiseAND(F.lit((1 << 40) - 1))
    shared = (
        post.groupBy("w").agg(F.count("*").alias("c"), F.min_by("nid", first).alias("cid"), F.min_by("n", first).alias("cn"), F.min("pos").alias("cpos")).where("c > 1").drop("c")
    )
    # Both sides may have a hot column; sort-merge joins are split by the adaptive planner.
    blocks = materialize(post.join(shared.hint("merge"), "w"), "jaccard-blocks")
    stars = materialize(
        blocks.where("nid != cid").where(_may_link(F.col("n"), F.col("pos"), F.col("cn"), F.col("cpos"), percent))
        .select(F.least("nid", "cid").alias("x"), F.greatest("nid", "cid").alias("y")).distinct(),
        "jaccard-stars",
    )
    links = _links(stars, docs, nodes, width, percent, "stars")
    n_links = links.count()
    labels = connected_components(links, rows=n_links).withColumnRenamed("node", "sid")

    # Of two rows, take x, whose prefix ends first: what it shares with the other is outside its prefix or in both
    # prefixes. Let u be its columns outside its prefix and those in it that other prefixes hold. If the overlap is
    # as needed, all but u - needed of the latter are shared, so one of the first u - needed + 1 is: the pair is
    # met at a column of rank r with u - r >= needed.
    own = Window.partitionBy("nid")
    placed = blocks.select("w", "nid", "n", (_prefix_rest(F.col("n"), percent) + F.count("*").over(own) - F.row_number().over(own.orderBy("pos")) + 1).alias("left"))
    whose = nodes.select("nid", "sid", F.struct("last_n", "last_w").alias("last")).join(labels, "sid", "left").select("nid", "last", F.coalesce("component", "sid").alias("comp"))
    held = placed.join(whose, "nid")
    mixed = held.groupBy("w").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("w")
    open_ = materialize(held.join(mixed.hint("merge"), "w"), "jaccard-open")
    p, q = (open_.select("w", *[F.col(c).alias(f"{side}_{c}") for c in ("nid", "n", "left", "last", "comp")]) for side in "pq")
    sizes = [F.col(c) for c in ("p_n", "q_n")]
    possible = (100 * sizes[0] >= percent * sizes[1]) & (100 * sizes[1] >= percent * sizes[0]) & (F.when(F.col("p_last") <= F.col("q_last"), F.col("p_left")).otherwise(F.col("q_left")) * (100 + percent) >= percent * (sizes[0] + sizes[1]))
    rest = (
        p.hint("merge").join(q, (p["w"] == q["w"]) & (F.col("p_nid") < F.col("q_nid")) & (F.col("p_comp") != F.col("q_comp")) & possible)
        .select(F.col("p_nid").alias("x"), F.col("q_nid").alias("y")).distinct().join(stars, ["x", "y"], "left_anti")
    )
    rest = materialize(rest, "jaccard-rest")
    final = labels
    if not rest.isEmpty() and (n_more := (more := _links(rest, docs, nodes, width, percent, "rest")).count()):
        # A star of the first components and the new links.
        final = connected_components(labels.select(F.col("sid").alias("a"), F.col("component").alias("b")).unionByName(more), rows=2 * n_links + n_more).withColumnRenamed("node", "sid")
    of_set = nodes.select("sid", "rid").join(final, "sid", "left").select("sid", "rid", F.coalesce("component", "sid").alias("component"))
    least = of_set.groupBy("component").agg(F.min("rid").alias("component_id"))
    named = of_set.join(least, "component").select("sid", "component", "component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "sid", "key").hint("merge").join(named, "sid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key", "component"
    )


def _key() -> Column:
    return F.xxhash64("text")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component, with all its columns, whatever their names.

    A null doc_id comes after all others; of rows with that doc_id, the one whose text hashes lowest stays, and
    of rows with the same text any one. Rows that share a doc_id but no links stay each, as do all rows without
    words (null and empty texts). Very long texts are compared whole. An empty table gives no rows.
    """
    found = jaccard_components(docs, width, percent).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n")).groupBy("component").agg(F.min_by(F.struct("doc_id", "key", "n"), order).alias("f"))
    first = materialize(first.select(F.col("f.doc_id").alias("id"), F.col("f.key").alias("key"), (F.col("f.n") > 1).alias("again")), "jaccard-kept")
    first = F.broadcast(first) if first.count() <= MAX_BROADCAST_IDS else first
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), _key().alias("own_key"), "text")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = row.where(~blank).drop("text").join(first, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("id")))
    again = kept.where("again").withColumn("i", F.row_number().over(Window.partitionBy("own_id", "own_key").orderBy(F.lit(0)))).where("i = 1")
    return row.where(blank).select("row.*").unionByName(kept.where("not again").select("row.*")).unionByName(again.select("row.*"))


def brute_force(rows: list[tuple[int, str | None]], width: int = 5, percent: int = 80) -> dict[int, tuple[int, int]]:
    """The same result over a few rows with distinct ids, from all pairs. For tests."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    least = {i: i for i in sets}

    def root(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
