"""Measures of generated records, summaries of configurations and all comparisons that vary one factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators.evaluation import bootstrap_interval, paired_summary, permutation_test
from loomspark.operators.generation import CHANNELS
from loomspark.scratch import materialize

#: Pairs that differ in one factor; measures that are compared, and whether less is better.
PAIRS = (("A", "B", "retrieval"), ("C", "D", "retrieval"), ("A", "C", "adapter"), ("B", "D", "adapter"))
COMPARED = {"unsupported_claim_rate": True, "structured_ok": False, "length_ok": False, "n_claims": False}
MEASURES = ("unsupported_claim_rate", "n_claims", "n_forbidden", "structured_ok", "length_ok", "words", "latency_s")
MAX_NEW_TOKENS = 512


def item_metrics(records: DataFrame, most_tokens: int = MAX_NEW_TOKENS) -> DataFrame:
    """``records`` with their measures, all null where the record failed; length_ok is null where the answer was cut off."""
    done = F.col("status") == "done"
    text = F.concat_ws(" ", "headline", "body", "cta")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    limit = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for c, spec in CHANNELS.items() for x in (c, spec[i])]), F.col("channel"))
    full = F.coalesce(F.col("completion_tokens") >= most_tokens, F.lit(False))
    there = (F.coalesce(F.col("headline"), F.lit("")) != "") & (F.coalesce(F.col("body"), F.lit("")) != "") & (F.coalesce(F.col("cta"), F.lit("")) != "")
    made: dict[str, Column] = {
        "unsupported_claim_rate": F.coalesce(F.col("unsupported_rate"), F.lit(0.0)), "n_claims": F.coalesce(F.col("claims"), F.lit(0)).cast("double"), "n_forbidden": F.coalesce(F.col("forbidden"), F.lit(0)).cast("double"),
        "structured_ok": there.cast("double"), "length_ok": F.when(~full, words.between(limit(1), limit(2)).cast("double")), "words": words.cast("double"), "latency_s": F.col("latency_ms") / F.lit(1000.0),
    }
    return records.withColumns({name: F.when(done, c) for name, c in made.items()})


def summarize(scored: DataFrame) -> DataFrame:
    """By config: records done and failed, means of the measures with the number that has each, and records with an unsupported claim."""
    mean = lambda m: F.bround(F.avg(m), 4)
    return scored.groupBy("config").agg(
        F.count_if(F.col("status") == "done").alias("n"), F.count_if(F.col("status") != "done").alias("n_failed"), *[mean(m).alias(m) for m in MEASURES],
        F.count("length_ok").alias("length_ok_n"), F.count_if(F.col("unsupported_claim_rate") > 0).alias("outputs_with_unsupported"),
    )


def two_way(scored: DataFrame) -> DataFrame:
    """The shorter summary of two configurations: rate, claims, forbidden terms, length of bodies and latency of records that are done."""
    done = scored.where("status = 'done'")
    return done.groupBy("config").agg(
        F.count("*").alias("n"), F.bround(F.avg("unsupported_claim_rate"), 4).alias("unsupported_claim_rate"), F.bround(F.avg("n_claims"), 2).alias("claims_per_output"), F.sum("n_forbidden").cast("long").alias("forbidden_total"),
        F.floor(F.avg(F.length(F.coalesce("body", F.lit(""))))).alias("body_chars"), F.bround(F.avg("latency_ms") / 1000, 1).alias("latency_s"), F.count_if(F.col("unsupported_claim_rate") > 0).alias("outputs_with_unsupported"),
    )


def pairs(scored: DataFrame) -> DataFrame:
    """(pair, factor, metric, brief_no, before, after): each brief's measures in both configurations of a pair, null ones left out."""
    long = scored.select("config", "brief_no", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in COMPARED])).alias("x")).select("config", "brief_no", "x.*").where("v is not null")
    plan = scored.sparkSession.createDataFrame([(f"{a}→{b}", factor, a, b) for a, b, factor in PAIRS], "pair string, factor string, left string, right string")
    before = long.join(F.broadcast(plan), F.col("config") == F.col("left")).select("pair", "factor", "metric", "brief_no", F.col("v").alias("before"))
    after = long.join(F.broadcast(plan), F.col("config") == F.col("right")).select("pair", "metric", "brief_no", F.col("v").alias("after"))
    return before.join(after, ["pair", "metric", "brief_no"])


def compare_all(scored: DataFrame) -> DataFrame:
    """For each pair and measure: means, difference, wins, losses, ties and effect size."""
    both = pairs(scored)
    keys = ["pair", "factor", "metric"]
    means = both.groupBy(*keys).agg(F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"))
    lower = [m for m, less in COMPARED.items() if less]
    out = None
    for some, less in ((both.where(F.col("metric").isin(lower)), True), (both.where(~F.col("metric").isin(lower)), False)):
        one = paired_summary(some, keys, "before", "after", lower_is_better=less)
        out = one if out is None else out.unionByName(one)
    four = lambda c: F.bround(c, 4).alias(c)
    return out.join(means, keys).select(*keys, "n", *[four(c) for c in ("mean_before", "mean_after", "mean_diff")], "wins", "losses", "ties", F.bround("dz", 3).alias("cohens_dz"))


def compare_tests(scored: DataFrame) -> DataFrame:
    """For each pair and measure, p of the permutation test and the bootstrap interval of the difference."""
    keys = ["pair", "metric"]
    diffs = materialize(pairs(scored).select(*keys, F.col("brief_no").alias("i"), (F.col("after") - F.col("before")).alias("d")), "diffs")
    return permutation_test(diffs, keys).join(bootstrap_interval(diffs, keys), keys, "left")


def pick_briefs(rows: DataFrame, n: int, channels: tuple[str, ...] = tuple(CHANNELS), personas: tuple[str, ...] = ("young_family", "investor", "first_home")) -> DataFrame:
    """(project, brief_no, n, channel, persona, brief): the projects of the test split with most rows, channels and personas in turn.

    ``rows`` is (id, project, split, name, bedrooms); the name and rooms are those of the smallest id that has them.
    """
    named = F.min_by("name", F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("id")))
    rooms = F.min_by("bedrooms", F.when(F.coalesce(F.col("bedrooms"), F.lit(0)) != 0, F.col("id")))
    groups = rows.where("split = 'test' and project is not null").groupBy("project").agg(F.count("*").alias("n"), named.alias("name"), rooms.alias("bedrooms"))
    top = groups.orderBy(F.desc("n"), "project").limit(n)  # what is ranked in one task below
    i = (F.row_number().over(Window.orderBy(F.desc("n"), "project")) - 1).cast("int")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), F.col("brief_no") % len(names) + 1)
    what = F.when(F.col("bedrooms").isNotNull(), F.concat(F.lit("căn "), F.col("bedrooms").cast("string"), F.lit(" phòng ngủ"))).otherwise("bất động sản")
    brief = F.concat(F.lit("Giới thiệu "), what, F.lit(" tại dự án "), F.coalesce("name", "project"))
    return top.withColumn("brief_no", i).select("project", "brief_no", "n", pick(channels).alias("channel"), pick(personas).alias("persona"), brief.alias("brief"))


def snapshot(counts: dict[str, DataFrame], settings: dict[str, str]) -> DataFrame:
    """(key, value) of a run's conditions: how many rows each table has, and the versions and weights it ran with."""
    out = None
    for name, df in sorted(counts.items()):
        one = df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("key"), "value")
        out = one if out is None else out.unionByName(one)
    rows = next(iter(counts.values())).sparkSession.createDataFrame(sorted(settings.items()), "key string, value string")
    return rows if out is None else out.unionByName(rows)
