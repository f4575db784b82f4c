"""Splits and their audits, retrieval scores, claims, and paired statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import SENTENCE, deaccent, let, number, split_position, two_decimals
from loomspark.scratch import materialize

#: Fixed values.
RATIOS = (("train", 0.70), ("validation", 0.85), ("test", 1.0))
EXACT_PAIRS, BOOTSTRAPS, PERMUTATIONS = 14, 10_000, 20_000
#: Draws of a row, and values of a key that are hashed at once.
DRAWS, PIECE = 500, 8192
#: Constants of xxhash64.
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
PRICE_BANDS = ((0, 2e9, "dưới 2 tỷ"), (2e9, 3e9, "từ 2 đến 3 tỷ"), (3e9, 5e9, "từ 3 đến 5 tỷ"), (5e9, 1e10, "từ 5 đến 10 tỷ"), (1e10, float("inf"), "trên 10 tỷ"))
AREA_TOLERANCE, PER_TYPE = 0.15, 12
CLAIM_HINTS = ("gia", "dien tich", "phong ngu", "phong tam", "so hong", "so do", "phap ly", "tien ich", "ho boi", "cong vien", "truong hoc", "thang may", "m2", "ty", "trieu")
FORBIDDEN = ("cam kết lợi nhuận", "chắc chắn sinh lời", "chắc chắn tăng giá", "rẻ nhất thị trường", "lợi nhuận đảm bảo", "sinh lời chắc chắn")
MIN_CLAIM = 12
NUMBER = r"\d+(?:[.,]\d+)?"


def split_of(unit: Column, salt: str) -> Column:
    p = split_position(unit, salt)
    return F.when(p < RATIOS[0][1], "train").when(p < RATIOS[1][1], "validation").otherwise("test")


def stratum(size: Column) -> Column:
    return F.when(size >= 5, "large").when(size >= 2, "medium").otherwise("small")


def split_units(rows: DataFrame, project: str, cluster: str, salt: str) -> DataFrame:
    """(unit_type, unit_key, n, stratum, split): a project is one unit, and so is a cluster of rows without one."""
    kind = F.when(F.col(project).isNotNull(), "project").otherwise("cluster")
    units = rows.groupBy(kind.alias("unit_type"), F.coalesce(F.col(project), F.col(cluster).cast("string")).alias("unit_key")).agg(F.count("*").alias("n"))
    return units.select("*", stratum(F.col("n")).alias("stratum"), split_of(F.concat_ws(":", "unit_type", "unit_key"), salt).alias("split"))


def split_of_rows(rows: DataFrame, units: DataFrame, project: str, cluster: str) -> DataFrame:
    """``rows`` with the split of their unit: their project, or else their cluster; null where the unit has none."""
    kind = F.when(F.col(project).isNotNull(), "project").otherwise("cluster")
    keyed = rows.withColumns({"unit_type": kind, "unit_key": F.coalesce(F.col(project), F.col(cluster).cast("string"))})
    return keyed.join(units.select("unit_type", "unit_key", "split"), ["unit_type", "unit_key"], "left")


def leaking(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups in more than one split."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.count_if(F.col(split).isNull()).alias("n_unassigned")).where("n_splits > 1 or n_unassigned > 0")


def score_queries(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per (config, query_id): precision, recall, hit and reciprocal rank of (config, query_id, item, group, rank) against (query_id, items, groups).

    Group precision counts results, item precision distinct items, both as a share of what is reachable; measures of groups are null where none is expected.
    """
    keys = ["query_id", "config"] if "config" in expected.columns else ["query_id"]
    results = materialize(results, "results")
    return _scored(results, expected.select(*keys, "groups", F.size("items").alias("_size")), _right(results, expected), keys)


def _right(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, item) of the expected items, and config where they have one, that some result names: an expected list may be as long as the corpus, so it is not joined to each result."""
    keys = ["query_id", "config"] if "config" in expected.columns else ["query_id"]
    one = expected.select(*keys, F.explode("items").alias("item"))
    return one.join(results.select(*keys, "item").distinct(), [*keys, "item"], "left_semi").distinct().withColumn("_right", F.lit(True))


def _scored(results: DataFrame, sizes: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    joined = results.join(right, [c for c in right.columns if c != "_right"], "left").join(sizes, keys, "right")
    right_group, right_item = F.array_contains("groups", F.col("group")), F.col("_right")
    agg = joined.groupBy("config", "query_id").agg(
        F.count("item").alias("n"), F.count_if(right_group).alias("n_group"), F.count_distinct("item").alias("n_items"),
        F.count_distinct(F.when(right_item, F.col("item"))).alias("n_right"), F.min(F.when(right_group, F.col("rank"))).alias("first"),
        F.max("_size").alias("n_expected"), F.max(F.size("groups")).alias("n_groups"),
    )
    ceiling = F.least(F.lit(1.0), F.try_divide("n_expected", "n_items"))
    return agg.select(
        "config", "query_id",
        F.when(F.col("n_groups") > 0, F.coalesce(F.try_divide("n_group", "n"), F.lit(0.0))).alias("group_precision"),
        F.coalesce(F.try_divide("n_right", "n_items"), F.lit(0.0)).alias("item_precision"),
        F.coalesce(F.try_divide(F.try_divide("n_right", "n_items"), ceiling), F.lit(0.0)).alias("item_precision_normalised"),
        F.coalesce(F.try_divide("n_right", "n_expected"), F.lit(0.0)).alias("recall"),
        F.when(F.col("n_groups") > 0, F.col("first").isNotNull().cast("double")).alias("hit"),
        F.when(F.col("n_groups") > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def score_configs(results: DataFrame, expected: DataFrame, configs: Sequence[str]) -> DataFrame:
    """:func:`score_queries` of each config in ``configs`` for each question in ``expected``, also where it found nothing."""
    results = materialize(results, "results")
    sizes = expected.select("query_id", "groups", F.size("items").alias("_size"), F.explode(F.array(*[F.lit(c) for c in configs])).alias("config"))
    return _scored(results, sizes, _right(results, expected), ["query_id", "config"])


def mean_scores(scored: DataFrame, names: dict[str, str]) -> DataFrame:
    """Means by config, overall and by query_type, of the measures that a question has; ``names`` renames them."""
    both = scored.withColumn("level", F.explode(F.array(F.lit("overall"), F.col("query_type"))))
    return both.groupBy("config", "level").agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name) for c, name in names.items()], F.count("mrr").alias("mrr_n"))


def allowed_numbers(facts: Column) -> Column:
    """Normalised numbers in an array of texts."""
    return F.array_distinct(F.flatten(F.transform(facts, lambda t: F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), number))))


def allowed_of_facts(facts: Column) -> Column:
    """Numbers that an array of facts (text, value_text, value_num, valid_from, valid_to) supports.

    Those of their texts and dates, and each one's own number with two decimals, also in billions and in
    millions where it reaches one.
    """
    texts = F.transform(facts, lambda f: F.concat_ws(" ", f["text"], f["value_text"], f["valid_from"].cast("string"), f["valid_to"].cast("string")))
    two = lambda v: number(two_decimals(v))

    def scaled(f: Column) -> Column:
        v = f["value_num"].cast("double")
        forms = F.array(two(v), F.when(v >= 1e9, two(v / 1e9)), F.when(v >= 1e6, two(v / 1e6)))
        return F.when(F.coalesce(v, F.lit(0.0)) != 0, F.array_compact(forms)).otherwise(F.array().cast("array<string>"))

    return let(F.flatten(F.transform(facts, scaled)), lambda s: F.array_union(allowed_numbers(texts), s))


def claims(body: Column, allowed: Column, forbidden: tuple[str, ...] = FORBIDDEN) -> Column:
    """array<struct(text, status, numbers)>: sentences with a number or an attribute, held against the allowed numbers."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"https?://\S+", " "), SENTENCE), lambda s: F.regexp_replace(s, r"^[ \-•\t]+|[ \-•\t]+$", ""))

    def is_claim(s: Column) -> Column:
        flat = deaccent(s)
        hint = s.rlike(NUMBER)
        for h in CLAIM_HINTS:
            hint = hint | flat.contains(h)
        return (F.length(F.trim(s)) >= MIN_CLAIM) & hint

    def judge(s: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)), number)
        bad = F.lit(False)
        for term in forbidden:
            bad = bad | deaccent(s).contains(deaccent(F.lit(term)))
        status = F.when(bad, "forbidden").when(F.size(F.array_except(numbers, allowed)) > 0, "unsupported").otherwise("supported")
        return F.struct(s.alias("text"), status.alias("status"), numbers.alias("numbers"))

    return F.transform(F.filter(parts, is_claim), judge)


def claim_summary(found: Column) -> Column:
    n, bad = F.size(found), F.size(F.filter(found, lambda c: c["status"] != "supported"))
    return F.struct(n.alias("n_claims"), bad.alias("n_unsupported"), F.bround(F.coalesce(F.try_divide(bad, n), F.lit(0.0)), 4).alias("unsupported_rate"), F.size(F.filter(found, lambda c: c["status"] == "forbidden")).alias("n_forbidden"))


def paired_summary(pairs: DataFrame, keys: list[str], a: str, b: str, lower_is_better: bool = True) -> DataFrame:
    """Mean difference b - a, its deviation, Cohen's dz, and wins, losses and ties of b."""
    d = F.col(b) - F.col(a)
    better, worse = (d < 0, d > 0) if lower_is_better else (d > 0, d < 0)
    return pairs.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"),
        F.count_if(better).alias("wins"), F.count_if(worse).alias("losses"), F.count_if(d == 0).alias("ties"),
    ).withColumn("dz", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("mean_diff") / F.col("sd")))


def exact_permutation(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided sign-flip p over all 2^n sign patterns of (keys, i, d), i from 0, n at most EXACT_PAIRS."""
    sizes = diffs.groupBy(*keys).agg(F.count("*").alias("n"), F.abs(F.avg("d")).alias("seen"))
    if sizes.where(F.col("n") > EXACT_PAIRS).limit(1).count():
        raise ValueError(f"more than {EXACT_PAIRS} pairs; use the sampled test")
    signs = sizes.withColumn("mask", F.explode(F.expr("sequence(0, shiftleft(1, cast(n as int)) - 1)")))
    flipped = signs.join(diffs, keys).groupBy(*keys, "n", "seen", "mask").agg(F.abs(F.avg(F.when(F.expr("shiftright(mask, cast(i as int)) & 1 = 1"), -F.col("d")).otherwise(F.col("d")))).alias("v"))
    return flipped.groupBy(*keys, "n").agg(F.count_if(F.col("v") >= F.col("seen") - 1e-12).alias("extreme"), F.count("*").alias("patterns")).withColumn("p_value", F.bround(F.col("extreme") / F.col("patterns"), 5))


def _mixed(h: np.uint64, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of ints with the seed ``h``, in ``a``; ``x`` is :func:`_spread` of the ints, ``b`` room for as many."""
    np.bitwise_xor(x, h + _P5 + np.uint64(4), out=a)
    np.left_shift(a, np.uint64(23), out=b)
    np.right_shift(a, np.uint64(41), out=a)
    a |= b
    a *= _P2
    a += _P3
    for by, factor in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(a, np.uint64(by), out=b)
        a ^= b
        if factor is not None:
            a *= factor
    return a


def _spread(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64) * _P1


def _flipped(d: np.ndarray) -> Callable:
    """Sum of a piece of the differences with the signs that their hashes give."""

    def of(h: np.ndarray, piece: np.ndarray, whole: float) -> float:
        h &= np.uint64(1)
        return whole - 2.0 * float(h.view(np.int64).astype(np.float64) @ piece)

    return of


def _drawn(d: np.ndarray) -> Callable:
    """Sum of the values that the hashes of a piece pick from all."""

    def of(h: np.ndarray, piece: np.ndarray, whole: float) -> float:
        h, n = h.view(np.int64), len(d)
        return float(d.take(h - h // n * n).sum())

    return of


def _draws(values: DataFrame, keys: list[str], n: int, seed: int, flips: bool) -> DataFrame:
    """(keys, n, seen, _draw, m): means of ``n`` draws from the values d of each key by (i), nulls dropped; blocks of draws are rows.

    A draw flips the values' signs, or picks as many of them, by Spark's hash of (seed, draw, place); in Python, for
    a PIECE of places at a time, as a lambda of Spark takes some fifty times as long for each.
    """
    held = values.where("d is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.col("d").cast("double").alias("d"))))["d"].alias("d"), F.count("*").alias("n"), F.abs(F.avg("d")).alias("seen"))
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = held.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(DRAWS)))).repartition(tasks, *keys, "_from").select(*keys, "n", "seen", "_from", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty((2, max(PIECE, DRAWS)), np.uint64)
        with np.errstate(over="ignore"):
            first = _mixed(np.uint64(42), _spread(np.array([seed])), *room[:, :1])[0]
        for batch in batches:
            for at in range(batch.num_rows):
                d = batch.column("d").slice(at, 1).flatten().to_numpy(zero_copy_only=False)
                begin = batch.column("_from")[at].as_py()
                draws = np.arange(begin, min(begin + DRAWS, n))
                with np.errstate(over="ignore"):
                    starts = _mixed(first, _spread(draws), *room[:, : len(draws)]).copy()
                    of, sums = (_flipped if flips else _drawn)(d), np.zeros(len(draws))
                    for low in range(0, len(d), PIECE):
                        piece = d[low : low + PIECE]
                        places, whole, own = _spread(np.arange(low, low + len(piece))), float(piece.sum()), room[:, : len(piece)]
                        for j, h in enumerate(starts):
                            sums[j] += of(_mixed(h, places, *own), piece, whole)
                same = pa.array(np.full(len(draws), at))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in (*keys, "n", "seen")], pa.array(draws.astype(np.int32)), pa.array(sums / len(d))], [*keys, "n", "seen", "_draw", "m"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name not in ("_from", "d"))
    return blocks.mapInArrow(run, f"{kinds}, _draw int, m double")


def permutation_test(diffs: DataFrame, keys: list[str], n: int = PERMUTATIONS, seed: int = 42) -> DataFrame:
    """(keys, n, method, extreme, patterns, p_value) of (keys, i, d): exact for at most EXACT_PAIRS differences, else ``n`` hashed sign flips.

    The sampled p is (extreme + 1) / (n + 1), so it is never 0. Null differences are dropped; a key without others
    has none; a mean of 0 has p 1.
    """
    rows = diffs.where("d is not null").withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    few = rows.where(F.col("_n") <= EXACT_PAIRS).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("i")) - 1).drop("_n")
    exact = exact_permutation(few, keys).select(*keys, "n", F.lit("exact").alias("method"), "extreme", "patterns", "p_value")

    drawn = _draws(rows.where(F.col("_n") > EXACT_PAIRS), keys, n, seed, True).groupBy(*keys, "n")
    drawn = drawn.agg(F.count_if(F.abs("m") >= F.col("seen") - 1e-12).alias("extreme"), F.count("*").alias("patterns"), F.max("seen").alias("seen"))
    p = F.when(F.col("seen") == 0, 1.0).otherwise(F.bround((F.col("extreme") + 1) / (F.col("patterns") + 1), 5))
    return exact.unionByName(drawn.select(*keys, "n", F.lit("monte_carlo").alias("method"), "extreme", "patterns", p.alias("p_value")))


def bootstrap_interval(values: DataFrame, keys: list[str], n: int = BOOTSTRAPS, seed: int = 7) -> DataFrame:
    """95 % percentile interval of the mean of (keys, i, d): hashed draws, bounds at the floor indices; null for fewer than 2 values."""
    means = _draws(values, keys, n, seed, False)
    r = means.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("m", "_draw")) - 1).where(F.col("r").isin(int(0.025 * n), int(0.975 * n)))
    at = lambda share: F.max(F.when((F.col("r") == int(share * n)) & (F.col("n") > 1), F.col("m")))
    return r.groupBy(*keys).agg(at(0.025).alias("low"), at(0.975).alias("high"))


def nearest_rank(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """min, element n div 2, element floor(0.9 n) and max of the sorted values, by rank and not by interpolation.

    Equal values are counted first. What is left is sorted over all partitions; a partition's counts for each key
    tell where the next one's ranks begin, so no task gets all values of a key.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    held = materialize(counts.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).withColumn("_p", F.spark_partition_id()), "ranks")
    parts = held.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q")).agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    begins = parts.withColumn("_b", F.coalesce(F.sum("_s").over(w.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_s").over(w))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    placed = held.join(begins, [*same, F.col("_p") == F.col("_q")])
    upto = F.col("_b") + F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy(value))
    r = placed.withColumn("_u", upto)
    at = lambda i: F.min(F.when(F.col("_u") > i, F.col(value)))
    return r.groupBy(*keys).agg(F.min(value).alias("low"), at(F.expr("_n div 2")).alias("median"), at(F.floor(F.col("_n") * 9 / F.lit(10))).alias("p90"), F.max(value).alias("high"))


def price_band(value: Column, unit: float = 1.0) -> Column:
    """The label of the band [low, high) that a price in units of ``unit`` lies in."""
    out = F.lit(None).cast("string")
    for low, high, label in PRICE_BANDS:
        out = F.when((value * unit >= low) & (value * unit < high), label).otherwise(out)
    return out
