"""Quality rules: counts of words, symbols and repeats, and bands of n-gram perplexity.

The language model is an interpolated modified Kneser-Ney model of order 4 for each language. Its grams are
of characters (UTF-16 units; capitals, digits and white space each folded), as four of them fill a 64-bit key exactly and
their number depends on the alphabet more than on the corpus. All texts are counted, copies once: tasks count
their own, Spark adds up and estimates. A text is scored by what the others have: its own counts of grams and
contexts are taken off first, so a gram that no other text has gets what its context leaves to the lower orders.
No gram is dropped: sorted arrays of hashed keys are broadcast in as many parts as the number of grams asks
for, and a text's sums over the parts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.lean import lean
from loomspark.llm.shingles import Hasher
from loomspark.scratch import materialize

ORDER = 4
#: Grams of a part of the model, at 24 bytes: what is broadcast at once. More grams make more parts.
PART_GRAMS = 4_000_000
#: Width of a language's band, in quartile ranges beyond the quartiles.
BAND = 3.0
MAX_BROADCAST_ROWS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 2_000_000
_START, _END = "\x02\x02\x02", "\x03"


@cache
def _folds() -> np.ndarray:
    table = np.arange(65536, dtype=np.uint16)
    for i in range(65536):
        ch = chr(i)
        if i <= 3:
            table[i] = 32
        elif 0xD800 <= i < 0xE000:
            pass
        elif ch.isspace():
            table[i] = 32
        elif ch.isdigit():
            table[i] = 48
        elif len(ch.lower()) == 1:
            table[i] = min(ord(ch.lower()), 65535)
    table[2], table[3] = 2, 3
    return table


def _units(texts: list[str]) -> np.ndarray:
    """Folded units of texts with marks at their ends; marks within a text become spaces."""
    joined = "".join([_START + (t.replace("\x02", " ").replace("\x03", " ") if "\x02" in t or "\x03" in t else t) + _END for t in texts])
    return _folds()[np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)]


def _grams(units: np.ndarray) -> np.ndarray:
    u = units.astype(np.uint64)
    return (u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, list[str]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            units = _units(texts)
            keys, n = np.unique(_grams(units)[units[3:] != 2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > _CHUNK:
                    yield from flush()
                    size = 0
    yield from flush()


def _once(docs: DataFrame) -> DataFrame:
    """Rows with a text, one for each text of a language; only ids and hashes are shuffled."""
    h = F.xxhash64("lang", "text")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    first = docs.where(F.length("text") > 0).groupBy(h.alias("_h")).agg(F.min(row).alias("_first"), F.count("*").alias("_n"))
    again = materialize(first.where("_n > 1"), "quality-again")
    few = again.count() <= MAX_BROADCAST_ROWS
    rows = docs.where(F.length("text") > 0).withColumn("_h", h)
    rows = rows.join(F.broadcast(again) if few else again.hint("merge"), "_h", "left")
    # Of copies, those with the first one's id; they may be rows repeated whole, of which the map stage keeps one.
    copies = rows.where(row == F.col("_first")).groupBy("_h").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    return rows.where(F.col("_n").isNull()).select("lang", "text").unionByName(copies.select("lang", "text"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, k, g, c): for order 4 the counts, below it the numbers of different grams that end in g."""
    most = materialize(_once(docs).mapInArrow(lean(_counts), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("c")), "quality-grams")
    out = last = most.select("lang", F.lit(ORDER).alias("k"), "g", "c")
    for k in range(ORDER - 1, 0, -1):
        last = last.groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("g")).agg(F.count("*").alias("c")).select("lang", F.lit(k).alias("k"), "g", "c")
        out = out.unionByName(last)
    return materialize(out, "quality-orders")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more; half a count less than usual where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


class Table:
    """Grams of order 4 in an array sorted by hashed key: counts, their contexts' counts and back-off weights, and the probability below."""

    def __init__(self, keys: np.ndarray, c: np.ndarray, total: np.ndarray, weight: np.ndarray, below: np.ndarray, cuts: np.ndarray) -> None:
        h = keys * _MIX  # an odd factor: no two keys meet
        order = np.argsort(h)
        self.h, self.c, self.total = h[order], c[order].astype(np.int32), total[order].astype(np.int64)
        self.weight, self.below, self.cuts = weight[order].astype(np.float32), below[order].astype(np.float32), cuts

    def log(self, g: np.ndarray, own: np.ndarray, own_context: np.ndarray) -> np.ndarray:
        """Log probabilities without the text's own counts; 0 for grams that the table lacks."""
        if not len(self.h):
            return np.zeros(len(g))
        h = g * _MIX
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        left, total = np.maximum(self.c[at] - own, 0), np.maximum(self.total[at] - own_context, 0)
        held = np.maximum(left - self.cuts[np.minimum(left, 3)], 0) / np.maximum(total, 1)
        p = held + np.where(total > 0, self.weight[at], 1.0) * self.below[at]
        return np.where(known, np.log(np.maximum(p, 1e-30)), 0.0)


def plain_table(texts: list[str]) -> Table:
    """The plain version of :func:`estimate`, for the different texts of one language."""
    units = _units(texts)
    keys, c = np.unique(_grams(units)[units[3:] != 2], return_counts=True)
    orders, low = {ORDER: (keys, c)}, keys
    for k in range(ORDER - 1, 0, -1):
        low, n = np.unique(low & np.uint64((1 << (16 * k)) - 1), return_counts=True)
        orders[k] = (low, n)
    p = np.full(len(orders[1][0]), 1.0 / (len(orders[1][0]) + 1))
    for k in range(1, ORDER + 1):
        g, c = orders[k]
        cuts = discounts(*[int((c == i).sum()) for i in range(1, 5)])
        d = cuts[np.minimum(c, 3)]
        contexts, at = np.unique(g >> np.uint64(16), return_inverse=True)
        total = np.bincount(at, c)
        weight = np.bincount(at, d) / total
        below = p if k == 1 else p[np.searchsorted(orders[k - 1][0], g & np.uint64((1 << (16 * (k - 1))) - 1))]
        p = (c - d) / total[at] + weight[at] * below
    return Table(g, c, total[at], weight[at], below, cuts)


def _lengths(texts: list[str]) -> np.ndarray:
    """Units of each text with its end."""
    return np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 + 1 for t in texts])


def _sums(texts: list[str], table: Table) -> np.ndarray:
    """The sum of the log probabilities that the table has, over the grams of each text."""
    units = _units(texts)
    grams, real = _grams(units), units[3:] != 2
    ends = np.cumsum(_lengths(texts) + 3)
    begins = np.r_[0, ends[:-1]]
    out = np.zeros(len(texts))
    for i, (a, z) in enumerate(zip(begins, np.minimum(ends, len(grams)), strict=True)):
        g, n = np.unique(grams[a:z][real[a:z]], return_counts=True)
        context = g >> np.uint64(16)  # as sorted as g
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        own = np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(g)))
        out[i] = (table.log(g, n, own) * n).sum()
    return out


def estimate(docs: DataFrame) -> tuple[DataFrame, dict[str | None, np.ndarray]]:
    """(lang, g, c, total, weight, below) of all grams of order 4, each language by itself, and the languages' discounts of that order."""
    orders = count_grams(docs)
    spread = orders.groupBy("lang", "k").agg(F.count("*").alias("n"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).collect()
    rows = [(r["lang"], r["k"], r["n"], *discounts(*[r[f"n{i}"] for i in range(1, 5)])[1:].tolist()) for r in spread]
    cuts = docs.sparkSession.createDataFrame(rows, "lang string, k int, n long, d1 double, d2 double, d3 double")
    lower = None
    for k in range(1, ORDER + 1):
        mine = cuts.where(F.col("k") == k).select(F.col("lang").alias("_lang"), "n", "d1", "d2", "d3")
        at = orders.where(F.col("k") == k).select("lang", "g", "c")
        at = at.join(mine, at["lang"].eqNullSafe(mine["_lang"])).drop("_lang").withColumn("ctx", F.shiftrightunsigned("g", 16))
        w = Window.partitionBy("lang", "ctx")
        kinds = [F.count_if(F.col("c") == 1).over(w), F.count_if(F.col("c") == 2).over(w), F.count_if(F.col("c") > 2).over(w)]
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        at = at.select("lang", "g", "n", "c", (F.col("c") - cut).alias("left"), F.sum("c").over(w).alias("total"), (kinds[0] * F.col("d1") + kinds[1] * F.col("d2") + kinds[2] * F.col("d3")).alias("lost"))
        if lower is None:
            below = 1 / (F.col("n") + 1)
        else:
            at = at.join(lower, at["lang"].eqNullSafe(lower["_lang"]) & (at["g"].bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1)) == lower["_g"]))
            below = F.col("_p")
        if k == ORDER:
            few = F.least("c", F.lit(2**31 - 1)).cast("int").alias("c")
            last = at.select("lang", "g", few, "total", (F.col("lost") / F.col("total")).cast("float").alias("weight"), below.cast("float").alias("below"))
            return materialize(last, "quality-model"), {lang: np.array([0.0, *d]) for lang, at, _, *d in rows if at == ORDER}
        p = F.col("left") / F.col("total") + F.col("lost") / F.col("total") * below
        lower = at.select(F.col("lang").alias("_lang"), F.col("g").alias("_g"), p.alias("_p"))
    raise AssertionError("no order")


def parts(model: DataFrame, part_grams: int) -> list[tuple[list[str | None], int, int]]:
    """(languages, piece, pieces) of each part: a language of more grams than a part holds is cut by hash, smaller ones share parts."""
    out, size = [], part_grams
    for lang, n in sorted(((r["lang"], r["count"]) for r in model.groupBy("lang").count().collect()), key=lambda x: (-x[1], x[0] or "")):
        if n > part_grams:
            pieces = -(-n // part_grams)
            out += [([lang], i, pieces) for i in range(pieces)]
        elif size + n > part_grams:
            out.append(([lang], 0, 1))
            size = n
        else:
            out[-1][0].append(lang)
            size += n
    return out


def _of(langs: list[str | None]) -> Column:
    """Rows of these languages."""
    named = F.coalesce(F.col("lang").isin([x for x in langs if x is not None]), F.lit(False))
    return named | F.col("lang").isNull() if None in langs else named


Tables = dict[str | None, Table]


def load(model: DataFrame, cuts: dict[str | None, np.ndarray], langs: list[str | None], piece: int, pieces: int) -> Tables:
    """A part of the model: 28 bytes a gram reach the driver, and the language where the part has several."""
    rows = model.where(_of(langs) & (F.pmod(F.xxhash64("g"), F.lit(pieces)) == piece))
    got = (rows.drop("lang") if len(langs) == 1 else rows).toArrow().combine_chunks()
    columns = [got[x].to_numpy() for x in ("g", "c", "total", "weight", "below")]
    out = {}
    for name in langs:
        at = slice(None)
        if len(langs) > 1:
            at = np.flatnonzero((pc.is_null(got["lang"]) if name is None else pc.fill_null(pc.equal(got["lang"], name), False)).to_numpy())
        g, c, total, weight, below = (x[at] for x in columns)
        out[name] = Table(g.view(np.uint64), c, total, weight, below, cuts[name])
    return out


def _log_sums(tables: Tables, lang: str | None, texts: list[str]) -> np.ndarray:
    """Sums of the log probabilities that this part has."""
    return _sums(texts, tables[lang]) if lang in tables else np.zeros(len(texts))


def base_counts(text: bytes, w: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text with words of these hashes."""
    inner = text.translate(None, b" \t\n\r\x0b\x0c")
    chars = int((np.frombuffer(inner, np.uint8) & 0xC0 != 0x80).sum())
    symbols = len(inner) - len(inner.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if len(w) > 3:
        h = Hasher.ngrams(w, 3)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(len(w), bool)
            for k in range(3):
                cover[k : k + len(h)] |= twice
            repeats = int(cover.sum())
    return len(w), chars, symbols, len(lines) - len(set(lines)), repeats


def _scored(part):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), part.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                raw = [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]
                counts = [base_counts(x, w) for x, w in zip(raw, hasher.each(raw, lower=False), strict=True)]
                texts, entropy = [x.decode() for x in raw], np.full(len(raw), np.nan)
                by: dict[str | None, list[int]] = {}
                for i, lang in enumerate(rows.column("lang").to_pylist()):
                    if texts[i]:
                        by.setdefault(lang, []).append(i)
                for lang, at in by.items():
                    mine = [texts[i] for i in at]
                    entropy[at] = -_log_sums(known, lang, mine) / _lengths(mine)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(x) for x in ("doc_id", "lang", "key")] + [pa.array(list(x), pa.int64()) for x in zip(*counts, strict=True)] + [pa.array(entropy, from_pandas=True)],
                    ["doc_id", "lang", "key", *names, "entropy"],
                )

    return run


def _more(part):
    """(key, more): what a further part adds to the entropy of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts, more = rows.column("text").to_pylist(), np.zeros(rows.num_rows)
                by: dict[str | None, list[int]] = {}
                for i, lang in enumerate(rows.column("lang").to_pylist()):
                    by.setdefault(lang, []).append(i)
                for lang, at in by.items():
                    mine = [texts[i] for i in at]
                    more[at] = -_log_sums(part.value, lang, mine) / _lengths(mine)
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(more)], ["key", "more"])

    return run


def score(docs: DataFrame, part_grams: int = PART_GRAMS) -> DataFrame:
    """(doc_id, lang, counts, entropy) of each row; texts are read once for each part that their language has."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    model, cuts = estimate(docs)
    # Equal texts of a language have equal sums, so they are told apart by nothing else: 128 bits over both.
    key = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.lit("\0"), "text").cast("binary")))
    every = parts(model, part_grams) or [([], 0, 1)]
    part = spark.sparkContext.broadcast(load(model, cuts, *every[0]))
    keyed = docs.withColumn("key", key if len(every) > 1 else F.lit(None).cast("binary"))
    out = keyed.mapInArrow(lean(_scored(part)), f"doc_id {kind}, lang string, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, entropy double")
    if len(every) == 1:
        return out.drop("key")
    sums = []
    for at in every[1:]:
        part = spark.sparkContext.broadcast(load(model, cuts, *at))
        rows = keyed.where(_of(at[0]) & (F.length("text") > 0)).select("key", "lang", "text")
        sums.append(materialize(rows.mapInArrow(lean(_more(part)), "key binary, more double").groupBy("key").agg(F.max("more").alias("more")), "quality-more"))
        part.unpersist()
    added = reduce(DataFrame.unionByName, sums).groupBy("key").agg(F.sum("more").alias("more"))
    return out.join(added, "key", "left").withColumn("entropy", F.col("entropy") + F.coalesce("more", F.lit(0.0))).drop("key", "more")


def rate(docs: DataFrame, band: float = BAND, min_words: int = 50, max_repeat: int = 50, part_grams: int = PART_GRAMS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang) with their counts, perplexity, its language's band, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` % of them in repeated 3-word
    windows. kept: not base_failed, and perplexity within the language's lower and upper bounds. These lie
    ``band`` quartile ranges of the log perplexity below and above the quartiles of the language's documents
    that pass the base rules.

    A null or empty text has counts of 0, no perplexity, and fails the base rules; very long texts are scored whole. A null lang is a language of
    its own. A language without documents that pass has no bounds; nor has it documents to reject. Repeated
    rows are repeated; an empty table gives no rows. Other columns are not read.
    """
    docs = docs.select("doc_id", "lang", "text")
    scored = score(docs, part_grams)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    scored = materialize(scored.withColumn("base_failed", failed), "quality-scored")
    q = F.percentile_approx("entropy", F.array(F.lit(0.25), F.lit(0.75)), 1000)
    edges = scored.where("not base_failed").groupBy("lang").agg(q.alias("q")).select(
        F.col("lang").alias("_lang"),
        (F.col("q")[0] - band * (F.col("q")[1] - F.col("q")[0])).alias("low"),
        (F.col("q")[1] + band * (F.col("q")[1] - F.col("q")[0])).alias("high"),
    )
    rows = scored.join(edges, scored["lang"].eqNullSafe(edges["_lang"]), "left")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True))).alias("kept"),
        F.exp("entropy").alias("perplexity"), F.exp("low").alias("perplexity_low"), F.exp("high").alias("perplexity_high"),
    )
