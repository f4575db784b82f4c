"""Personal data: fixed patterns, and identifiers found by bootstrapping from their contexts.

Entities of the fixed kinds are the seeds, and so are tokens that look like keys, of a further kind, secret. The
word before an identifier-like token is a lexical pattern, and so are the two words before it; patterns and
instances form a graph. In turn, a pattern's score is the share of all its occurrences in the corpus that
lead to believed instances of a kind, and an instance's score is the noisy-or of its patterns. Patterns of
high confidence, seen with several different seeds, then give their kind to the tokens that they lead to:
unseen identifiers, and secrets, which are reported nowhere else.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import fold, let
from loomspark.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
#: The kind of keys and passwords: found by contexts alone.
SECRET = "secret"
#: Fixed patterns, written so that no position is tried twice: a run of the leading characters is entered at
#: its start or where the last match ended, and runs are not given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens that may be identifiers: letters, digits and joints, with an @ or four digits; and the word before one.
TOKEN = r"(?:\G|(?<![A-Za-z0-9@._%+-]))(?=[A-Za-z._%+-]*+[@0-9])[A-Za-z0-9@._%+-]++"
WORDS = r"[\x20\x09-\x0D]+"
#: Different seeds that a pattern needs, the score it needs, and rounds.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.7, 3
MAX_BROADCAST_ROWS = 200_000
#: Last words of two-word patterns that are named in the plan; beyond it all pairs of words are made.
MAX_LASTS = 200
_ONE = "struct<start: int, rank: int, end: int, kind: string, value: string, left: string>"
_SPAN = f"array<{_ONE}>"
#: Characters before a span that its context is taken from.
NEAR = 64
#: Shape of a seed of the kind secret: a run of letters and digits this long, with so many digits and letters.
SECRET_LENGTH, SECRET_DIGITS, SECRET_LETTERS = 32, 6, 4


def _found(text: Column, pattern: str, rank: int, kind: str) -> Column:
    """Spans of all matches, from the lengths of what lies between and of the matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(hits.alias("m"), F.split(text, pattern, -1).alias("g"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["g"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"), F.right(x["g"], F.lit(NEAR)).alias("left"))
        return end, F.when(x["m"].isNull(), F.array().cast(_SPAN)).otherwise(F.array(one))

    return fold(zipped, F.lit(0), _ONE, step)["out"]


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans``, none of which meets another, that meet none of ``base``: in order of start, only the last one can meet the next of ``base``."""
    none = F.array().cast(_SPAN)

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        is_base, held = x["rank"] < len(KINDS), s["held"]
        met = is_base & (held["end"] > x["start"])
        add = F.when(held.isNull() | met, none).otherwise(F.array(held))
        new = F.when(~is_base & (x["start"] >= s["reach"]), x)
        return F.struct(F.when(is_base, F.greatest(s["reach"], x["end"])).otherwise(s["reach"]).alias("reach"), new.alias("held")), add

    state = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(_ONE).alias("held"))
    both = fold(F.array_sort(F.concat(base, spans)), state, _ONE, step)
    return F.when(F.size(base) == 0, spans).otherwise(let(both, lambda b: F.concat(b["out"], F.when(b["s"]["held"].isNull(), none).otherwise(F.array(b["s"]["held"])))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(x: Column) -> Column:
    v, n = x["value"], F.length(_digits(x["value"]))
    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255)
    return (
        F.when(x["kind"] == "ip", F.forall(F.split(v, r"\."), part))
        .when(x["kind"] == "card", n.between(14, 19) & F.when(n.between(14, 19), _luhn(v)).otherwise(False))
        .when(x["kind"] == "phone", n.between(10, 15)).otherwise(True)
    )


def base_spans(text: Column) -> Column:
    """Sorted spans (start, rank, end, kind, value) of the fixed kinds; code points, end exclusive."""
    none = F.array().cast(_SPAN)
    kinds = (("email", EMAIL, text.contains("@")), ("ip", IP, text.rlike(r"[0-9]\.[0-9]")), ("card", CARD, text.rlike("[0-9]")), ("phone", PHONE, text.rlike(r"\+[0-9]")))
    every = [F.when(cheap, F.filter(_found(text, pattern, i, kind), _valid)).otherwise(none) for i, (kind, pattern, cheap) in enumerate(kinds)]
    return F.array_sort(F.concat(*every))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _candidates(text: Column, base: Column) -> Column:
    """Base spans, with their kind, and identifier-like tokens that meet none, each with the words before it, nearest first."""
    alike = F.filter(_found(text, TOKEN, 9, ""), lambda x: x["value"].contains("@") | (F.length(_digits(x["value"])) >= 4))
    others = _apart(alike, base)
    word = r"[^\x20\x09-\x0D]+"
    before = rf"(?:({word})[\x20\x09-\x0D]+)?({word})[\x20\x09-\x0D]+[\"'(\[<]?$"
    secret = lambda v: (F.length(v) >= SECRET_LENGTH) & v.rlike("^[A-Za-z0-9]+$") & (F.length(_digits(v)) >= SECRET_DIGITS) & (F.length(F.regexp_replace(v, "[0-9]", "")) >= SECRET_LETTERS)

    def one(x: Column) -> Column:
        near = F.lower(x["left"])
        kind = F.when(x["kind"] != "", x["kind"]).when(secret(x["value"]), SECRET)
        lefts = let(F.struct(F.regexp_extract(near, before, 1).alias("far"), F.regexp_extract(near, before, 2).alias("near")), lambda w: F.array(w["near"], F.when(w["far"] != "", F.concat_ws(" ", w["far"], w["near"])).otherwise(F.lit(""))))
        good = F.filter(lefts, lambda w: (w != "") & ~w.rlike("[0-9@]"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), good.alias("lefts"), kind.alias("kind"))

    return F.filter(F.transform(F.concat(base, others), one), lambda x: F.size(x["lefts"]) > 0)


def _patterns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(left, kind) of confident patterns."""
    each = found.select(F.explode("candidates").alias("c")).select(F.explode("c.lefts").alias("left"), "c.value", "c.kind")
    edges = materialize(each.groupBy("left", "value").agg(F.max("kind").alias("kind"), F.count("*").alias("n")), "pii-edges")
    seeded = edges.where("kind is not null").groupBy("left").agg(F.count_distinct("value").alias("seeds")).where(F.col("seeds") >= SUPPORT).select("left")
    n = edges.count()
    seeded = materialize(seeded, "pii-seeded", n)
    near = F.broadcast(seeded) if seeded.count() <= MAX_BROADCAST_ROWS else seeded
    # How often each pattern's words occur at all, over whole texts.
    words = F.split(F.lower("text"), WORDS)
    two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = seeded.where(F.col("left").contains(" ")).select(F.substring_index("left", " ", -1).alias("last")).distinct()
    lasts = [r["last"] for r in pairs.limit(MAX_LASTS + 1).collect()]
    every = F.col("w")
    if lasts:
        # Pairs are made only where their last word is one that patterns end with.
        chosen = F.filter(two, lambda p: F.substring_index(p, " ", -1).isin(lasts)) if len(lasts) <= MAX_LASTS else two
        every = F.concat(every, chosen)
    often = docs.select(words.alias("w")).select(F.explode(every).alias("left")).join(near, "left", "left_semi").groupBy("left").agg(F.count("*").alias("total"))
    graph = materialize(edges.join(seeded, "left", "left_semi").join(often, "left"), "pii-graph", n)
    belief = graph.where("kind is not null").select("value", "kind", F.lit(1.0).alias("belief")).distinct()
    for turn in range(ROUNDS):
        score = (
            graph.select("left", "value", "n", "total").join(belief, "value").groupBy("left", "kind")
            .agg((F.sum(F.col("n") * F.col("belief")) / F.max("total")).alias("score"))
        )
        if turn == ROUNDS - 1:
            break
        spread = graph.where("kind is null").select("left", "value").join(score, "left").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("belief"))
        belief = materialize(graph.where("kind is not null").select("value", "kind", F.lit(1.0).alias("belief")).distinct().unionByName(spread.where("belief > 0.1")), "pii-belief", n)
    return score.where(F.col("score") >= CONFIDENCE).groupBy("left").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans) of each row of ``docs`` (doc_id, text); key is a digest of the text.

    ``base`` are spans of the fixed kinds, ``spans`` those and the ones that contexts add, which never overlap
    a base span. A null or empty text has none; very long ones are searched whole. Repeated rows are repeated; a
    null doc_id is kept. Of patterns that give a token different kinds, the most confident one counts, and of
    equal ones the kind that sorts last. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"))
    hint = F.col("text").rlike("[0-9@]")
    found = own.withColumn("base", F.when(hint, base_spans(F.col("text"))).otherwise(F.array().cast(_SPAN)))
    kind = "array<struct<start: int, end: int, value: string, lefts: array<string>, kind: string>>"
    found = found.withColumn("candidates", F.when(hint, _candidates(F.col("text"), F.col("base"))).otherwise(F.array().cast(kind)))
    found = materialize(found.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "base", "candidates"), "pii-found")
    patterns = materialize(_patterns(found, own), "pii-patterns")
    near = F.broadcast(patterns) if patterns.count() <= MAX_BROADCAST_ROWS else patterns
    unseen = found.where("size(candidates) > 0").select("doc_id", "key", F.explode("candidates").alias("c")).where(F.col("c.kind").isNull() | (F.col("c.kind") == SECRET))
    given = unseen.select("doc_id", "key", "c", F.explode("c.lefts").alias("left")).join(near.withColumnsRenamed({"kind": "given"}), "left")
    # One kind for each span: that of its most confident pattern.
    given = given.groupBy("doc_id", "key", "c.start", "c.end", "c.value").agg(F.max_by("given", F.struct("score", "given")).alias("kind"))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, SECRET)) for x in (k, i)]), F.col("kind"))
    more = given.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind", "value", F.lit("").alias("left"))).alias("more"))
    more = materialize(more, "pii-more").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "more")
    more = F.broadcast(more) if more.count() <= MAX_BROADCAST_ROWS else more
    both = found.join(more, (found["key"] == more["_key"]) & found["doc_id"].eqNullSafe(more["_id"]), "left")
    return both.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, a digest of their spans, all spans and their number, of each document. Odd rows are as in :func:`find`."""
    found = find(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; of spans that overlap, the first names the whole. Spans are in order of start.

    Spans are joined where they overlap, then masked in blocks, each in its own part of the text.
    """
    none = F.array().cast(_SPAN)
    given = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit("").alias("value"), F.lit("").alias("left")))

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        over = held.isNotNull() & (x["start"] < held["end"])
        longer = F.struct(held["start"].alias("start"), held["rank"].alias("rank"), F.greatest(held["end"], x["end"]).alias("end"), held["kind"].alias("kind"), held["value"].alias("value"), held["left"].alias("left"))
        return F.when(over, longer).otherwise(x), F.when(held.isNull() | over, none).otherwise(F.array(held))

    def masked_parts(every: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(every))).cast("int"))

        def part(i: Column) -> Column:
            begin = F.get(every, i - 1)["start"]
            own = F.substring(text, begin + 1, F.coalesce(F.get(every, i - 1 + size)["start"], F.length(text)) - begin)

            def of(own: Column) -> Column:
                first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
                step = lambda acc, x: F.struct((x["end"] - begin).alias("at"), F.concat(acc["out"], F.substring(own, acc["at"] + 1, x["start"] - begin - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
                return F.aggregate(F.slice(every, i, size), first, step, lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))))

            return let(own, of)

        return F.concat(F.substring(text, F.lit(1), F.get(every, 0)["start"]), F.array_join(F.transform(F.sequence(F.lit(1), F.size(every), size), part), ""))

    whole = let(fold(given, F.lit(None).cast(_ONE), _ONE, step), lambda b: F.concat(b["out"], F.array(b["s"])))
    return F.when(F.size(spans) > 0, let(whole, masked_parts)).otherwise(text)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with its personal data masked; n_chars, if there, is brought up to date. No row is dropped.

    Null and empty texts stay as they are; repeated rows are masked alike. An empty table gives no rows. Other
    columns are kept, whatever their names.
    """
    found = find(docs).where("size(spans) > 0").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.first("spans").alias("_spans"))
    found = materialize(found, "pii-mask")
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST_ROWS else found
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    both = docs.join(found, (key == found["_key"]) & docs["doc_id"].eqNullSafe(found["_id"]), "left")
    text = F.when(found["_spans"].isNull(), docs["text"]).otherwise(mask(docs["text"], found["_spans"]))
    changed = {"text": text} | ({"n_chars": F.when(found["_spans"].isNull(), docs["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return both.select(*[changed[c].alias(c) if c in changed else docs[f"`{c}`"] for c in docs.columns])
