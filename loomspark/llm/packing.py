"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Lengths are integers up to the size of a sequence, and documents of one length can stand for each other. So
a packing is a table of patterns (the lengths in a sequence) and how often each occurs, and its size does
not grow with the corpus. The algorithm works on that table: a gene is a pattern with its number of
sequences. Crossover injects whole well-filled sequences of one parent into the other, removes sequences
whose documents would then occur twice, and best-fits the displaced ones. Each island is a Spark task with
its own population; after each round its elite migrates to the next island. Documents get their places by
their rank among those of their length.
"""

from __future__ import annotations

import gc
import json
import os
import random
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.lean import lean
from loomspark.scratch import materialize

Genes = dict[tuple[int, ...], int]
MAX_SHARDS = 1 << 16
SHARD_ROWS = 512
#: Fixed value: how byte-level BPE files split a text before merging.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Ids of texts by a tokenizer's file, the end id last.

    Where the file is plain byte-level BPE, whose merges stand in the order of the ids they make, its
    vocabulary is also a table of ranks, and the faster ranked encoder gives the same ids. Any other file, and
    a text that holds one of the file's added tokens, goes to the tokenizer itself.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.path, self.end = path, np.array([end_id], "<u4")
        made = Tokenizer.from_file(path)
        spec = json.loads(made.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ranked = self._ranked(spec)
        self._tokenizer = made if self.ranked is None else None

    @property
    def tokenizer(self):
        """The file's own tokenizer: where there are ranks, it is loaded when a text first needs it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _ranked(self, spec: dict):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec["normalizer"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.added}
        for i, merge in enumerate(model["merges"]):
            if vocabulary.get("".join(merge.split(" ") if isinstance(merge, str) else merge)) != 256 + i:
                return None
        if len(vocabulary) != 256 + len(model["merges"]):
            return None
        import tiktoken

        of = {chr(c): b for b, c in _byte_letters().items()}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(of[c] for c in t): i for t, i in vocabulary.items()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        ids = None
        if self.ranked is not None and not any(x in text for x in self.added):
            try:
                ids = self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # its patterns give up on white space of hundreds of thousands of characters
                pass
        if ids is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.concatenate((ids, self.end))


@cache
def shared_ids(path: str, end_id: int) -> Ids:
    """One for all tasks of a Python worker: it takes tens of megabytes and half a second to make."""
    made = Ids(path, end_id)
    gc.collect()
    return made


def _byte_letters() -> dict[int, int]:
    """Byte-level files write a byte that prints as itself and the n-th of the others as the letter 256 + n."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: b for b in prints} | {b: 256 + n for n, b in enumerate(others)}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        coder = shared_ids(path, end_id)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k in range(0, len(texts), 200):
                rows = []
                for doc, text in zip(ids[k : k + 200], texts[k : k + 200], strict=True):
                    own = coder.encode(text or "")
                    rows += [(doc, i, s, n, zlib.crc32(own[s : s + n])) for i, (s, n) in enumerate(cut(len(own), capacity))]
                d, i, s, n, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, batch.schema.field("doc_id").type), pa.array(i, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(genes: Genes, displaced: dict[int, int], capacity: int, rng: random.Random | None = None) -> Genes:
    """Place displaced lengths, longest first, in the fullest sequences that have room for them, and the rest in new ones."""
    free: dict[int, Genes] = defaultdict(dict)
    for p, m in genes.items():
        free[capacity - sum(p)][p] = m
    open_ = sum(1 << r for r, g in free.items() if g)
    order = sorted((s for s, n in displaced.items() if n), reverse=True)
    if rng is not None:  # neighbours may change places
        order.sort(key=lambda s: -s + rng.uniform(0, 0.04 * capacity))
    for s in order:
        n = displaced[s]
        while n:
            room = open_ >> s
            if room:
                r = s + (room & -room).bit_length() - 1
                p, m = next(iter(free[r].items()))
            else:
                r, p, m = capacity, (), n
            q = min(r // s, n)
            k = min(m, n // q)
            to = tuple(sorted(p + (s,) * q, reverse=True))
            if p:
                if m == k:
                    del free[r][p]
                    if not free[r]:
                        open_ &= ~(1 << r)
                else:
                    free[r][p] = m - k
            free[r - q * s][to] = free[r - q * s].get(to, 0) + k
            open_ |= 1 << (r - q * s)
            n -= k * q
    return {p: m for g in free.values() for p, m in g.items()}


def fitness(genes: Genes, capacity: int) -> tuple[int, float]:
    """Sequences, then the mean squared fill, lower being better."""
    n = sum(genes.values())
    return n, -sum(m * (sum(p) / capacity) ** 2 for p, m in genes.items()) / max(n, 1)


def crossover(a: Genes, b: Genes, counts: dict[int, int], capacity: int, rng: random.Random) -> Genes:
    """Sequences of b filled to 99 % or more go into a; those of a that then hold a document twice are taken apart."""
    child = {p: m for p, m in b.items() if sum(p) * 100 >= 99 * capacity and rng.random() < 0.5}
    left = dict(counts)
    for p, m in child.items():
        for s in p:
            left[s] -= m
    for p, m in sorted(a.items(), key=lambda x: -sum(x[0])):
        need: dict[int, int] = defaultdict(int)
        for s in p:
            need[s] += 1
        k = min(m, *(left[s] // c for s, c in need.items()))
        if k > 0:
            child[p] = child.get(p, 0) + k
            for s, c in need.items():
                left[s] -= k * c
    return best_fit(child, left, capacity)


def mutate(genes: Genes, capacity: int, rng: random.Random) -> Genes:
    """Take the emptiest sequences and a few others apart and fit their documents anew."""
    kept, displaced = {}, defaultdict(int)
    for p, m in genes.items():
        if sum(p) * 100 < 97 * capacity or rng.random() < 0.1:
            for s in p:
                displaced[s] += m
        else:
            kept[p] = m
    return best_fit(kept, displaced, capacity, rng)


def evolve(population: list[Genes], counts: dict[int, int], capacity: int, generations: int, size: int, rng: random.Random) -> list[Genes]:
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    score = lambda g: fitness(g, capacity)
    if not population:
        population = [best_fit({}, counts, capacity)]
    while len(population) < size:
        population.append(best_fit({}, counts, capacity, rng))
    population.sort(key=score)
    for _ in range(generations):
        if score(population[0])[0] <= bound:
            break
        a, b = rng.sample(population[: max(2, size // 2)], 2)
        child = crossover(a, b, counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, capacity, rng)
        if score(child) < score(population[-1]):
            population[-1] = child
            population.sort(key=score)
    return population[:size]


def _island(counts: dict[int, int], capacity: int, generations: int, size: int, seed: int, turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        island = int(pdf["island"].iloc[0])
        found: dict[int, Genes] = defaultdict(dict)
        for member, pattern, m in zip(pdf["member"], pdf["pattern"], pdf["times"], strict=True):
            if m:
                found[member][tuple(int(x) for x in pattern)] = int(m)
        rng = random.Random(f"{seed} {turn} {island}")
        population = evolve([found[k] for k in sorted(found)], counts, capacity, generations, size, rng)
        rows = [(island, i, list(p), m) for i, g in enumerate(population) for p, m in g.items()]
        return pd.DataFrame(rows, columns=["island", "member", "pattern", "times"])

    return run


def islands(df_of: DataFrame, counts: dict[int, int], capacity: int, n_islands: int, rounds: int, generations: int, size: int, seed: int) -> list[tuple[tuple[int, ...], int]]:
    """The best packing of all islands, as (pattern, times). It has a few patterns for each length at most, whatever the counts."""
    schema = "island int, member int, pattern array<int>, times long"
    state = df_of.sparkSession.range(n_islands).select(F.col("id").cast("int").alias("island"), F.lit(0).alias("member"), F.array().cast("array<int>").alias("pattern"), F.lit(0).cast("long").alias("times"))
    for turn in range(rounds):
        state = state.repartition(n_islands, "island").groupBy("island").applyInPandas(_island(counts, capacity, generations, size, seed, turn), schema)
        state = materialize(state, "packing-islands")
        if turn < rounds - 1:
            elite = state.where("member = 0").select(F.pmod(F.col("island") + 1, F.lit(n_islands)).cast("int").alias("island"), F.lit(-1).alias("member"), "pattern", "times")
            state = state.where(f"member < {size - 1}").unionByName(elite)
    best: dict[int, Genes] = defaultdict(dict)
    for r in state.where("member = 0").collect():
        best[r["island"]][tuple(r["pattern"])] = r["times"]
    genes = min((best[k] for k in sorted(best)), key=lambda g: fitness(g, capacity))
    return sorted(genes.items(), reverse=True)


def _placed(slots):
    """Sequence and place from a document's rank among those of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, first, place = slots.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # Slots are sorted by length and rank; ranks stay below 2^42, lengths below 2^21.
            at = np.searchsorted(size * (1 << 42) + low, n * (1 << 42) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(first[at] + rank - low[at]), pa.array(place[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, n_islands: int = 6, rounds: int = 2, generations: int = 12, size: int = 6, seed: int = 5) -> DataFrame:
    """Pieces of all documents packed into sequences of ``capacity`` ids.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document's ids end with ``end_id``;
    longer ones than a sequence are cut, into whole sequences after a first piece that may be shorter.

    Null and empty texts are one piece of one id; very long texts are cut into as many pieces as they need.
    Pieces of one length take their places in the order of doc_id, piece and ids. Repeated rows are packed each. A null doc_id is kept. An
    empty table gives no rows. Other columns are not read. What reaches the driver has a row for each length
    (``capacity`` at most) and for each pattern.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(lean(_pieces(tokenizer, end_id, capacity)), out), "packing-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = counts.pop(capacity, 0)
    genes = islands(pieces, counts, capacity, n_islands, rounds, generations, size, seed) if counts else []
    if full:
        genes.append(((capacity,), full))
    slots, used, base = [], defaultdict(int), 0
    for p, m in genes:
        place = 0
        for s in p:
            slots.append((s, used[s], base, place))
            used[s] += m
            place += s
        base += m
    table = np.array(sorted(slots), np.int64).reshape(-1, 4).T.copy()
    shards = max(1, min(MAX_SHARDS, sum(counts.values()) // SHARD_ROWS + full // SHARD_ROWS))
    split = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    # Ranks within a length: those within its shards, after all earlier shards. A length's shards are MAX_SHARDS at most.
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = split.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = split.withColumn("own", own).join(before, ["length", "shard"]).withColumn("rank", F.col("own") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(_placed(spark.sparkContext.broadcast(table))), out + ", sequence_id long, offset long")
