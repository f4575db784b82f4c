"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of its training text. A text is parsed into
phrases, each the longest match from where the last one ended (a byte that the language lacks is a phrase).
A language's cost is its number of phrases times the bits of a position in its training text; the language
with the least cost wins.

Letters are parsed as UTF-8 bytes. An automaton is a table of states by bytes, and very many stretches of
texts walk through it abreast: a step of all of them is a few operations on arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.llm.lean import lean

#: Bounds of the training sample: labelled rows of a language, characters of a row that is chosen before longer
#: ones, characters of all rows of a language and of all languages. Rows are learned whole.
ROWS, ROW_CHARS, CHARS, ALL_CHARS = 64, 4_000, 60_000, 480_000
MAX_BROADCAST_ROWS = 100_000
#: Bytes of a stretch, which begins with a phrase of its own; bytes that are parsed abreast.
STRETCH, _TOGETHER = 1024, 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+").findall
_MASK = np.uint32((1 << 30) - 1)
Model = tuple[tuple[str, str], ...]
_built: dict[Model, list] = {}


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Its states, the start first; a state is a dict from a byte to the next state."""
    moves: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and ch not in moves[p]:
            moves[p][ch] = now
            p = link[p]
        if p != -1:
            q = moves[p][ch]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(ch) == q:
                    moves[p][ch] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return moves


def table(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The automaton as a walk that never stops: the number of each byte, and at state + number the next state.

    States are numbered in steps of a row. Where the automaton has no way on, the walk goes on from the start,
    and the two highest bits count the phrases that end there.
    """
    known = sorted({ch for state in moves for ch in state})
    number = np.zeros(256, np.uint32)
    number[known] = np.arange(1, len(known) + 1)
    wide = len(known) + 1
    if len(moves) * wide > int(_MASK):
        raise ValueError("the training text is too long for this table")
    start = np.full(wide, 1 << 30, np.uint32)  # from the start, a byte that it lacks is one phrase
    for ch, to in moves[0].items():
        start[number[ch]] = to * wide
    # Elsewhere what is missing ends a phrase and is then tried from the start.
    grid = np.tile(start + np.uint32(1 << 30), (len(moves), 1))
    grid[0] = start
    sizes = np.fromiter(map(len, moves), np.int64, len(moves))
    of = np.repeat(np.arange(len(moves)), sizes)
    byte = np.fromiter((ch for state in moves for ch in state), np.int64, len(of))
    to = np.fromiter((t for state in moves for t in state.values()), np.int64, len(of))
    grid[of, number[byte]] = to * wide
    return number, grid.ravel()


def phrases(text: bytes, moves: list[dict[int, int]]) -> int:
    """The plain version of :func:`phrase_counts`, for one stretch."""
    n, state = 0, 0
    for ch in text:
        to = moves[state].get(ch)
        if to is None:
            n += 1
            if state == 0:
                continue
            to = moves[0].get(ch)
            if to is None:
                n += 1
                to = 0
        state = to
    return n + (state != 0)


def phrase_counts(texts: list[bytes], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Phrases of each text (rows) by each automaton (columns): those of its stretches."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = -(-sizes // STRETCH)
    of = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    long = np.minimum(sizes[of] - nth * STRETCH, STRETCH)
    order = np.argsort(-long, kind="stable")
    of, long = of[order], long[order]
    begin = (np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * STRETCH)[order]
    out = np.zeros((len(texts), len(tables)), np.int64)
    if not len(of):
        return out
    active = np.searchsorted(-long, -np.arange(long[0]), side="left")  # stretches of more than t bytes
    grid = np.zeros((int(long[0]), len(of)), np.uint8)
    for t, m in enumerate(active):
        grid[t, :m] = raw[begin[:m] + t]
    for k, (number, walk) in enumerate(tables):
        state, n = np.zeros(len(of), np.uint32), np.zeros(len(of), np.uint32)
        for t, m in enumerate(active):
            step = walk[state[:m] + number[grid[t, :m]]]
            n[:m] += step >> np.uint32(30)
            state[:m] = step & _MASK
        out[:, k] = np.bincount(of, n + (state != 0), len(texts))
    return out


def letters(text: str) -> str:
    """Lower-cased runs of letters, one space between them: marks and digits say nothing of a language."""
    return " ".join(_LETTERS(text.lower()))


def build(model: Model) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Names, tables and bits of a position; a Python worker makes them once."""
    if model not in _built:
        _built.clear()
        raw = [text.encode("utf-8", "surrogatepass") for _, text in model]
        _built[model] = ([name for name, _ in model], [table(suffix_automaton(x)) for x in raw], np.log2([len(x) + 2.0 for x in raw]))
    return _built[model]


def classify(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """Language and score of each text: by how much the second best is dearer, as a share of its cost."""
    names, tables, bits = build(model)
    plain = [letters(t) if t and names else "" for t in texts]
    plain = [t.encode("utf-8", "surrogatepass") if any(map(str.isalpha, t)) else b"" for t in plain]
    out = [("und", 0.0)] * len(texts)
    k = 0
    while k < len(texts):
        size, j = len(plain[k]), k + 1
        while j < len(texts) and size + len(plain[j]) <= _TOGETHER:
            size += len(plain[j])
            j += 1
        at = [i for i in range(k, j) if plain[i]]
        if at:
            costs = phrase_counts([plain[i] for i in at], tables) * bits
            best = costs.argmin(axis=1)  # of equal ones, the name that sorts first
            first = costs[np.arange(len(at)), best]
            if len(names) == 1:
                score = np.ones(len(at))
            else:
                second = np.partition(costs, 1, axis=1)[:, 1]
                score = (second - first) / second
            for i, b, s in zip(at, best.tolist(), score.tolist(), strict=True):
                out[i] = (names[b], s)
        k = j
    return out


def fit(docs: DataFrame, usable: Column, rows: int = ROWS, row_chars: int = ROW_CHARS, chars: int = CHARS, all_chars: int = ALL_CHARS) -> Model:
    """(language, training text) from a bounded sample of labelled rows.

    Of each language, ``rows`` rows: those of at most ``row_chars`` characters whose ids hash lowest, then longer
    ones, short before long. They are taken whole, in this order, while they have ``chars`` characters together
    (less where there are so many languages that all would have more than ``all_chars``). The first one is taken
    in any case; it is cut only if it alone has more.
    """
    h, n = F.xxhash64(F.lit(3), "doc_id"), F.length("text")
    labelled = docs.where(usable & F.col("lang").isNotNull() & (n > 0)).select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.greatest("n", F.lit(row_chars)), "h", "doc_id", "n")
    ranked = labelled.select("doc_id", "lang", h.alias("h"), n.alias("n")).withColumn("i", F.row_number().over(order)).where(F.col("i") <= rows).collect()
    chars = min(chars, max(1, all_chars // max(1, len({r["lang"] for r in ranked}))))
    chosen, used = [], dict.fromkeys({r["lang"] for r in ranked}, 0)
    for r in sorted(ranked, key=lambda r: (r["lang"], r["i"])):
        if not used[r["lang"]] or used[r["lang"]] + r["n"] <= chars:
            used[r["lang"]] += r["n"]
            chosen.append((r["doc_id"], r["lang"], r["n"]))
    if not chosen:
        return ()
    ids = docs.sparkSession.createDataFrame(sorted(set(chosen)), f"_id {docs.schema['doc_id'].dataType.simpleString()}, _lang string, _n int")
    ids = F.broadcast(ids) if len(chosen) <= MAX_BROADCAST_ROWS else ids
    got = labelled.join(ids, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")) & (n == F.col("_n"))).select("lang", h.alias("h"), F.substring("text", 1, chars).alias("text")).distinct().collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], r["text"])):
        by.setdefault(r["lang"], []).append(letters(r["text"]))
    return tuple((lang, " ".join(texts)) for lang, texts in sorted(by.items()))


def _predict(model, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classify(batch.column("text").to_pylist(), model.value)
            names = batch.schema.names
            keep = [i for i, c in enumerate(names) if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [names[i] for i in keep] + ["lang_pred", "score"],
            )

    return run


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id's digits leaves 2 when divided by 4. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, lang).

    Without ``model``, one is fitted to rows that are not held out. A null text or one without a letter is
    ``und`` with score 0, and so is every text where nothing could be learned. Equal costs go to the language
    that sorts first. Very long texts are parsed whole. Repeated rows are repeated; an empty table gives no
    rows. lang is read for the fit alone; other columns are not read.
    """
    if model is None:
        model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(_predict(shared)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def assign(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns, lang_pred and score; a column of either name that it has is replaced.

    Rows, nulls, ties and long texts are as in :func:`identify`.
    """
    own = docs.drop("lang_pred", "score")
    plain = own.toDF(*["text" if c == "text" else f"_{i}" for i, c in enumerate(own.columns)])  # columns of any name go to Python
    fields = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return plain.mapInArrow(lean(_predict(shared, keep_text=True)), fields).toDF(*own.columns, "lang_pred", "score")
