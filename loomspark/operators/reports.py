"""Counts for reports, the data card, and what is deleted with a tenant's derived data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def of_tenant(df: DataFrame, tenant: str, name: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; where the table is partitioned by it, only its folders are read."""
    return df.where(F.col(name) == tenant)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with this key, if there is one."""
    return df.where(F.col(key) == value).limit(1)


def by_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows with any of the keys in ``wanted`` (key): point lookups of many keys are a join."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def conditions(df: DataFrame, **given) -> DataFrame:
    """Rows that meet every condition that is given: a true or false flag, or a value; None gives none."""
    for name, value in given.items():
        if value is not None:
            df = df.where(F.col(name) if value is True else ~F.col(name) if value is False else F.col(name) == value)
    return df


def coverage(rows: DataFrame, fields: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """(field, n, pct): rows that have each field, and those whose array has an element; one pass over the rows."""
    there = {f: F.col(f).isNotNull() for f in fields} | {a: F.coalesce(F.size(a) > 0, F.lit(False)) for a in arrays}
    counts = rows.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(f) for f, c in there.items()])
    pct = lambda n: F.coalesce(F.bround(F.try_divide(F.lit(100.0) * n, F.col("_all")), 1), F.lit(0.0))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n"), pct(F.col(f)).alias("pct")) for f in there])).alias("x")).select("x.*")


def distributions(rows: DataFrame, columns: Sequence[str], section: str) -> DataFrame:
    """(section, measure, key, n): how often each value of each column occurs, null as None."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("key")) for c in columns])).alias("x"))
    return long.groupBy(F.lit(section).alias("section"), "x.measure", "x.key").agg(F.count("*").alias("n"))


def clusters(rows: DataFrame, cluster: str, representative: str) -> DataFrame:
    """One row: clusters, representatives and the other rows."""
    return rows.agg(F.count_distinct(cluster).alias("clusters"), F.count_if(F.col(representative)).alias("representatives"), (F.count("*") - F.count_if(F.col(representative))).alias("duplicates"))


def quality_report(listings: DataFrame, quarantine: DataFrame, facts: DataFrame, nodes: DataFrame, edges: DataFrame, fields: Sequence[str], arrays: Sequence[str] = (), top: int = 10) -> DataFrame:
    """(section, measure, key, n, pct): the whole data-quality report as rows, for a table or a page.

    Listings are (dedup_cluster_id, is_cluster_representative, tier, property_type, price_confidence, fields), nodes
    (entity_type, canonical_key, support).
    """
    null = F.lit(None).cast("double").alias("pct")
    one = lambda section, measure, df, n: df.agg(n.alias("n")).select(F.lit(section).alias("section"), F.lit(measure).alias("measure"), F.lit("").alias("key"), "n", null)
    c = clusters(listings, "dedup_cluster_id", "is_cluster_representative")
    best = nodes.where("entity_type = 'Project'").orderBy(F.desc("support"), "canonical_key").limit(top)
    parts = [
        one("clean", "total", listings, F.count("*")), distributions(listings, ("tier", "property_type", "price_confidence"), "clean").withColumn("pct", null),
        coverage(listings, fields, arrays).select(F.lit("clean").alias("section"), F.lit("coverage").alias("measure"), F.col("field").alias("key"), "n", "pct"),
        c.select(F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).alias("n")) for x in ("clusters", "representatives", "duplicates")])).alias("x")).select(F.lit("dedup").alias("section"), "x.measure", F.lit("").alias("key"), "x.n", null),
        one("quarantine", "total", quarantine, F.count("*")), distributions(quarantine, ("error_code",), "quarantine").withColumn("pct", null),
        one("facts", "total", facts, F.count("*")), distributions(facts, ("predicate",), "facts").withColumn("pct", null), one("facts", "needs_review", facts, F.count_if(F.col("needs_review"))),
        one("graph", "entities", nodes, F.count("*")), distributions(nodes, ("entity_type",), "graph").withColumn("pct", null), one("graph", "edges", edges, F.count("*")), distributions(edges, ("edge_type",), "graph").withColumn("pct", null),
        best.select(F.lit("graph").alias("section"), F.lit("top_projects").alias("measure"), F.col("canonical_key").alias("key"), F.col("support").alias("n"), null),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_card(report: DataFrame, splits: DataFrame, leaking: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The quality report with the sizes of splits (split, units, listings), the groups that leak, questions by type, and chunks."""
    null = F.lit(None).cast("double").alias("pct")
    row = lambda df, section, measure, key, n: df.select(F.lit(section).alias("section"), F.lit(measure).alias("measure"), key.alias("key"), n.alias("n"), null)
    split = row(splits, "splits", "units", F.col("split"), F.col("units")).unionByName(row(splits, "splits", "listings", F.col("split"), F.col("listings")))
    leaks = row(leaking.agg(F.count("*").alias("n")), "leakage", "groups", F.lit(""), F.col("n"))
    gold = row(questions.groupBy("query_type").agg(F.count("*").alias("n")), "gold_queries", "by_type", F.col("query_type"), F.col("n"))
    held = chunks.agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
    index = row(held, "chunks", "total", F.lit(""), F.col("total")).unionByName(row(held, "chunks", "embedded", F.lit(""), F.col("embedded")))
    out = report
    for part in (split, leaks, gold, index):
        out = out.unionByName(part)
    return out


def usage(samples: DataFrame, columns: Sequence[str], project: str) -> DataFrame:
    """(measure, key, n): samples by each column, and how many different projects they use."""
    return distributions(samples, columns, "").drop("section").unionByName(samples.agg(F.count_distinct(project).alias("n")).select(F.lit("projects").alias("measure"), F.lit("").alias("key"), "n"))


def cascade(tables: dict[str, DataFrame], tenant: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each derived table without a tenant, and (table, deleted, place): how many rows go, those that refer to others first."""
    left, gone = {}, None
    for place, (name, df) in enumerate(tables.items()):
        left[name] = df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))
        one = of_tenant(df, tenant).agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted", F.lit(place).alias("place"))
        gone = one if gone is None else gone.unionByName(one)
    return left, gone


def merged(base: Column, more: Column) -> Column:
    """A map with the entries of both; those of the second replace the first's."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(kept, more)


def page(title: str, report: DataFrame, limit: int = 1000) -> str:
    """A report's rows as a page of sections; reports are short, longer ones are refused."""
    rows = report.orderBy("section", "measure", F.desc("n"), "key").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    out, section = [f"# {title}"], None
    for r in rows:
        if r["section"] != section:
            section = r["section"]
            out += ["", f"## {section}", "", "| measure | key | n | % |", "|-|-|-|-|"]
        out.append(f"| {r['measure']} | {r['key']} | {r['n']} | {'' if r['pct'] is None else r['pct']} |")
    return "\n".join(out) + "\n"


def write_card(spark: SparkSession, card: DataFrame, path: str) -> None:
    """The card's rows as one JSON file; cards are short."""
    card.orderBy("section", "measure", "key").coalesce(1).write.mode("overwrite").json(path)
