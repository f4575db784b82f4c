"""A small typed property graph: nodes and edges with support, and bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def majority(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, support, aliases): the most frequent name, the smaller among equals; the others are aliases in that order."""
    counts = rows.groupBy(key, name).agg(F.count("*").alias("c"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(name).alias("name"))))
    names = counts.groupBy(key).agg(F.sum("c").alias("support"), F.transform(order, lambda x: x["name"]).alias("_names"))
    return names.select(key, F.col("_names")[0].alias("name"), "support", F.slice("_names", 2, F.greatest(F.size("_names") - 1, F.lit(0))).alias("aliases"))


def nodes(rows: DataFrame) -> DataFrame:
    """Candidates (entity_type, canonical_key, name, attributes, listing_id) to one node a key; attributes of the smallest listing."""
    key = ["entity_type", "canonical_key"]
    named = majority(rows.withColumn("_k", F.struct(*key)), "_k", "name").select("_k.*", "name", "support", "aliases")
    return named.join(rows.groupBy(*key).agg(F.min_by("attributes", "listing_id").alias("attributes")), key)


def edges(rows: DataFrame) -> DataFrame:
    """Candidates (src, dst, edge_type, listing_id, valid_from, valid_to) to one edge with support and the evidence of the smallest listing."""
    first = F.min_by(F.struct("listing_id", "valid_from", "valid_to"), "listing_id")
    return rows.groupBy("src", "dst", "edge_type").agg(F.count("*").alias("support"), first.alias("_f")).select("src", "dst", "edge_type", "support", F.col("_f.listing_id").alias("evidence_id"), F.col("_f.valid_from"), F.col("_f.valid_to"))


def both_ways(edges_: DataFrame) -> DataFrame:
    fwd = edges_.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type", F.lit("out").alias("direction"))
    return fwd.unionByName(edges_.select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_type", F.lit("in").alias("direction")))


def traverse(edges_: DataFrame, starts: DataFrame, depth: int = 2, along: tuple[str, ...] | None = None) -> DataFrame:
    """Simple paths of up to ``depth`` edges from the nodes of ``starts`` (start): (start, node, depth, nodes, types).

    Either way; or only forward, by the types of ``along`` in their order. All paths through a hub are asked for,
    so either way is for a stated set of starts; :func:`nearest` is the way for all of them.
    """
    adjacent = both_ways(edges_)
    now = starts.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("types"))
    out = None
    for d in range(1, depth + 1):
        step = adjacent if along is None else adjacent.where((F.col("direction") == "out") & (F.col("edge_type") == along[d - 1]))
        now = now.join(step, F.col("node") == F.col("a")).where(~F.array_contains("nodes", F.col("b"))).select(
            "start", F.col("b").alias("node"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("types", F.col("edge_type")).alias("types")
        )
        one = now.withColumn("depth", F.lit(d))
        out = one if out is None else out.unionByName(one)
    return out.select("start", "node", "depth", "nodes", "types")


def unit_paths(edges_: DataFrame, part_of: str = "PART_OF", has_unit: str = "HAS_UNIT_TYPE") -> DataFrame:
    """(project, building, unit, depth) by the edges' types: units of a project's buildings, two edges away, and its own, one away, without a building."""
    units = edges_.where(F.col("edge_type") == has_unit)
    built = edges_.where(F.col("edge_type") == part_of).select(F.col("dst").alias("project"), F.col("src").alias("building"))
    far = built.join(units.select(F.col("src").alias("building"), F.col("dst").alias("unit")), "building").select("project", "building", "unit", F.lit(2).alias("depth"))
    projects = built.select("project").distinct()
    near = units.select(F.col("src").alias("project"), F.col("dst").alias("unit")).join(projects, "project", "left_semi")
    return far.unionByName(near.select("project", F.lit(None).cast(dict(edges_.dtypes)["src"]).alias("building"), "unit", F.lit(1).alias("depth")))


def in_order(paths: DataFrame, limit: int) -> DataFrame:
    """The first paths by depth, then the types of their edges, then their nodes."""
    return paths.orderBy("depth", "types", "nodes").limit(limit)


def listed(nodes_: DataFrame, edges_: DataFrame, entity_type: str | None = None, search: str | None = None, with_building: bool = False, top: int = 50, part_of: str = "PART_OF") -> DataFrame:
    """The ``top`` nodes (node_id, entity_type, canonical_key, name, support) by support, then key, that meet the conditions that are given.

    ``search`` is a pattern in lower case in which % and _ stand for any characters, as users type it.
    """
    if entity_type is not None:
        nodes_ = nodes_.where(F.col("entity_type") == entity_type)
    if search:
        nodes_ = nodes_.where(F.lower("name").like(f"%{search.lower()}%"))
    if with_building:
        nodes_ = with_neighbour(nodes_, edges_, part_of)
    return nodes_.orderBy(F.desc("support"), "canonical_key").limit(top)


def path_label(nodes_, types):
    """node --TYPE--> node ..."""
    rest = F.slice(nodes_, 2, F.greatest(F.size(nodes_) - 1, F.lit(0)))
    return F.concat_ws(" ", F.element_at(nodes_, 1), F.array_join(F.flatten(F.zip_with(types, rest, lambda t, n: F.array(F.concat(F.lit("--"), t, F.lit("-->")), n.cast("string")))), " "))


def with_neighbour(nodes_: DataFrame, edges_: DataFrame, edge_type: str) -> DataFrame:
    """Nodes that some edge of the type leads to."""
    return nodes_.join(edges_.where(F.col("edge_type") == edge_type).select(F.col("dst").alias("node_id")), "node_id", "left_semi")


def capped_by_depth(paths: DataFrame, cap: int) -> DataFrame:
    """The nearest ``cap`` nodes of each start, by (depth, node)."""
    near = paths.groupBy("start", "node").agg(F.min("depth").alias("depth"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("depth", "node"))).where(F.col("rank") <= cap)


def nearest(edges_: DataFrame, starts: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """(start, node, depth, path): of the nodes of ``wanted`` (node) within two edges of each start, the first ``cap`` by (depth, node).

    A hub's neighbours are cut before they are joined: of its wanted ones only the first cap + 1 can be among a
    start's first ``cap`` that are not the start itself or nearer. path is the smallest of the shortest ones.
    """
    adjacent = both_ways(edges_).groupBy("a", "b").agg(F.min("edge_type").alias("t"))
    goal = adjacent.join(wanted.select(F.col("node").alias("b")).distinct(), "b", "left_semi")
    first = goal.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("i") <= 2 * cap + 1).drop("i")
    label = lambda p, t, n: F.concat_ws(" ", p, F.concat(F.lit("--"), t, F.lit("-->")), n.cast("string"))
    one = starts.select("start").join(first, F.col("start") == F.col("a")).where("b <> start").select("start", F.col("b").alias("node"), F.lit(1).alias("depth"), label(F.col("start").cast("string"), F.col("t"), F.col("b")).alias("path"))
    middle = starts.select("start").join(adjacent.select("a", F.col("b").alias("m"), F.col("t").alias("t1")), F.col("start") == F.col("a")).drop("a")
    two = middle.join(first, F.col("m") == F.col("a")).where("b <> start").select("start", F.col("b").alias("node"), F.lit(2).alias("depth"), label(label(F.col("start").cast("string"), F.col("t1"), F.col("m")), F.col("t"), F.col("b")).alias("path"))
    near = one.unionByName(two).groupBy("start", "node").agg(F.min(F.struct("depth", "path")).alias("f")).select("start", "node", "f.depth", "f.path")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("start").orderBy("depth", "node"))).where(F.col("_r") <= cap).drop("_r")
