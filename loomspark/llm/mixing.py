"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words."""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 8
#: Words of a shard; shards of a group. A source of 10^12 words has 15 million shards in 3,700 groups.
SHARD_WORDS, GROUP_SHARDS = 1 << 16, 4096
#: The cuts have a row for each shard of a source; up to this number they are broadcast, beyond it joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
OWN = ("_size", "_source_size", "_target", "_taken")


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sainte_lague(claims: list[int | float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients claim / (2 k + 1), the lower index first among equal ones; none beyond its cap.

    Starts from the seats at the divisor sum / seats and gives or takes what is missing, by the same quotients.
    """
    total = sum(claims)
    if total <= 0 or seats <= 0:
        return [0] * len(claims)
    got = [min(cap, int(2 * c * seats / total + 1) // 2) for c, cap in zip(claims, caps, strict=True)]
    missing = seats - sum(got)
    if missing > 0:
        heap = [(-c / (2 * k + 1), i) for i, (c, k, cap) in enumerate(zip(claims, got, caps, strict=True)) if k < cap and c > 0]
        heapq.heapify(heap)
        while missing and heap:
            _, i = heapq.heappop(heap)
            got[i] += 1
            missing -= 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-claims[i] / (2 * got[i] + 1), i))
    elif missing < 0:
        heap = [(c / (2 * k - 1), -i) for i, (c, k) in enumerate(zip(claims, got, strict=True)) if k]
        heapq.heapify(heap)
        while missing and heap:
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            missing += 1
            if got[-i]:
                heapq.heappush(heap, (claims[-i] / (2 * got[-i] - 1), i))
    return got


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[Fraction]:
    """Shares of the sum of sizes by weight, none above ``most`` times its size; excess is shared again by weight."""
    left, out, open_ = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else share * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        held = set(full)
        open_ = [i for i in open_ if i not in held]
    return out


def _dealt(block: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        claims = [int(x) for x in pdf["supply"]]
        return pd.DataFrame({"k": pdf["k"], "g": pdf["g"], "part": pdf["part"], "seats": sainte_lague(claims, int(pdf["all_seats"].iloc[0]), [-(-most * c // block) for c in claims])})

    return run


def _quotas(supply: DataFrame, block: int, most: int) -> DataFrame:
    """(k, g, shard, supply, words): blocks of a source dealt to its groups of shards, then of a group to its shards. A task has the rows of one source's groups, or of one group."""
    kinds = "k int, g int, part int, seats long"
    groups = supply.groupBy("k", "g").agg(F.sum("supply").alias("supply"), F.first("seats").alias("all_seats"))
    dealt = groups.select("k", F.lit(0).alias("g"), F.col("g").alias("part"), "supply", "all_seats").groupBy("k").applyInPandas(_dealt(block, most), kinds)
    own = supply.select("k", "g", F.col("shard").alias("part"), "supply").join(dealt.select("k", F.col("part").alias("g"), F.col("seats").alias("all_seats")), ["k", "g"])
    seats = own.groupBy("k", "g").applyInPandas(_dealt(block, most), kinds).select("k", F.col("part").alias("shard"), "seats")
    return supply.drop("seats").join(seats, ["k", "shard"]).select("k", "shard", "supply", F.least(F.col("seats") * block, most * F.col("supply")).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, block_words: int = BLOCK_WORDS, most: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with _size, _source_size, _target and _taken, the words that the mix takes.

    Sources in code point order, null last, weigh ``weights`` in turn. Their targets are blocks of words: the
    blocks of all targets are dealt to sources by highest quotients, and a source's blocks to its shards of
    documents by the same rule. Within a shard, documents lie in an order that depends on the seed; its quota
    is that many blocks from the start, going round again up to ``most`` times. So at most one document of a
    shard (and its exact repeats, which share) is taken in part.

    A null text has no words. Rows without doc_id or source take part like others; a row that is repeated is
    taken as often as its copies. No words at all give targets and takes of 0; an empty table gives no rows.
    All columns of ``docs`` are kept, but those named as this operator's own four.

    Driver memory: one row for each source, which is the size of the list of weights that the mix sets.
    """
    spark = docs.sparkSession
    key = [F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"), words().alias("_size")]
    sized = materialize(docs.select("doc_id", "source", *key), "mix-sizes")
    rows = sorted(((r["source"], int(r["n"])) for r in sized.groupBy("source").agg(F.sum("_size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in rows]
    aim = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    blocks = max(1, round(sum(sizes) / block_words)) if sum(sizes) else 0
    seats = sainte_lague([float(x) for x in aim], blocks, [-(-most * n // block_words) for n in sizes])
    plan = spark.createDataFrame(
        [(i, s, n, float(aim[i]), seats[i], max(1, -(-n // SHARD_WORDS))) for i, (s, n) in enumerate(rows)],
        "k int, _source string, _source_size long, _target double, seats long, _shards int",
    ).withColumn("_groups", F.expr(f"cast(ceil(_shards / {GROUP_SHARDS}) as int)"))
    plan = F.broadcast(plan) if len(rows) <= MAX_BROADCAST_ROWS else plan
    shard = F.pmod(F.xxhash64("_h"), F.col("_shards")).cast("int").alias("shard")

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(plan, df["source"].eqNullSafe(plan["_source"])).select(*[df[c] for c in df.columns], "k", "_source_size", "_target", "seats", "_groups", shard)

    parts = dealt(sized).groupBy("k", "shard", "_h", "doc_id", "_size").agg(F.count("*").alias("m"), F.first("seats").alias("seats"), F.first("_groups").alias("_groups"))
    supply = parts.groupBy("k", "shard").agg(F.sum(F.col("_size") * F.col("m")).alias("supply"), F.first("seats").alias("seats"), F.pmod("shard", F.first("_groups")).alias("g"))
    quota = _quotas(supply, block_words, most).withColumns(
        {"epochs": F.expr("if(supply = 0, 0, words div supply)"), "rest": F.expr("if(supply = 0, 0, words % supply)")}
    )
    before = Window.partitionBy("k", "shard").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.withColumn("start", F.coalesce(F.sum(F.col("_size") * F.col("m")).over(before), F.lit(0)))
    # The document at which each shard's last round ends; those before it in the order are taken once more.
    last = (
        at.join(quota.select("k", "shard", "rest"), ["k", "shard"]).where((F.col("rest") > F.col("start")) & (F.col("rest") <= F.col("start") + F.col("_size") * F.col("m")))
        .select("k", "shard", F.col("_h").alias("lh"), F.col("doc_id").alias("ld"), F.col("_size").alias("ls"), F.expr("(rest - start) div m").alias("part"))
    )
    cuts = materialize(quota.select("k", "shard", "epochs").join(last, ["k", "shard"], "left"), "mix-cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= MAX_BROADCAST_ROWS else cuts
    keep = [c for c in docs.columns if c not in OWN]
    here = dealt(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), "doc_id", "source", *key)).join(cuts, ["k", "shard"])
    # doc_id null sorts first.
    mine, end = F.struct("_h", "doc_id", "_size"), F.struct("lh", "ld", "ls")
    more = F.when(F.col("lh").isNull(), 0).when(mine < end, F.col("_size")).when(mine.eqNullSafe(end), F.col("part")).otherwise(0)
    return here.select("_doc.*", "_size", "_source_size", "_target", (F.col("epochs") * F.col("_size") + more).cast("long").alias("_taken"))


def taken_texts(mixed: DataFrame) -> DataFrame:
    """The mix as rows: a document once for each whole time it is taken, and its first words for a part.

    Documents without words, and those that the mix does not take, give no rows. All columns but the operator's own
    four are kept, whatever their names.
    """
    keep = [c for c in mixed.columns if c not in OWN]
    row = mixed.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text", F.col("_taken").alias("taken"), F.col("_size").alias("size")).where("size > 0")
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(pieces, 1, F.expr("cast(taken % size as int)")), "")
    whole = row.where("taken >= size").select("row", F.explode(F.sequence(F.lit(1), F.expr("cast(taken div size as int)"))).alias("i")).select("row.*")
    part = row.where("taken % size > 0").select(F.struct(*[first.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in keep]).alias("row")).select("row.*")
    return whole.unionByName(part)
