"""Append-only logs: versions, states and their transitions, and chat samples for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import fold, sha_key

#: Fixed values: (state before, action, state after).
TRANSITIONS = (("draft", "submit", "in_review"), ("in_review", "approve", "approved"), ("in_review", "reject", "rejected"), ("rejected", "edit", "draft"), ("draft", "edit", "draft"))
CHANNELS, PERSONAS = ("facebook", "zalo", "website", "email"), ("first_home", "investor", "family")
MIN_CHARS, MAX_CHARS, MIN_FACTS = 140, 4000, 3


def latest(log: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The columns of each key's highest version, and the number of the next one."""
    top = log.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("_t"), F.max(version).alias("version"))
    return top.select(key, "version", (F.col("version") + 1).alias("next_version"), "_t.*")


def approved(versions: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Approved versions with the columns of their items."""
    return versions.where("status = 'approved'").join(items, key)


def _after(state: Column, action: Column) -> Column:
    out = F.lit(None).cast("string")
    for before, name, after in TRANSITIONS:
        out = F.when((state == before) & (action == name), after).otherwise(out)
    return out


def judged(events: DataFrame, key: str, order: str) -> DataFrame:
    """Events (key, order, action, actor, author, note) with the state before, the one after, and why an event is refused.

    The state is folded over a key's events in order; a refused event changes nothing. A key's events are the
    steps of one text's review, a few dozen.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, "action", "actor", "author", "note")))
    kind = f"struct<{order}: {dict(events.dtypes)[order]}, action: string, before: string, after: string, refused: string>"

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        to = _after(state, x["action"])
        why = (
            F.when(to.isNull(), "no_transition")
            .when((x["action"] == "approve") & x["actor"].eqNullSafe(x["author"]), "self_review")
            .when((x["action"] == "reject") & (F.coalesce(x["note"], F.lit("")) == ""), "no_note")
        )
        new = F.when(why.isNull(), to).otherwise(state)
        return new, F.array(F.struct(x[order].alias(order), x["action"].alias("action"), state.alias("before"), new.alias("after"), why.alias("refused")))

    folded = fold(F.col("_r"), F.lit("draft"), kind, step)["out"]
    return events.groupBy(key).agg(rows.alias("_r")).select(key, F.explode(folded).alias("e")).select(key, "e.*")


def rotation(df: DataFrame, id_: str, limit: int = 1500) -> DataFrame:
    """(id, sample_id, channel, persona) of the first ``limit`` ids, channels and personas taken by a hash of the id."""
    n = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return df.select(F.col(id_).alias("id")).orderBy("id").limit(limit).select("id", sha_key(F.lit("sample"), F.col("id").cast("string"), length=24).alias("sample_id"), pick(CHANNELS).alias("channel"), pick(PERSONAS).alias("persona"))


def cycled(df: DataFrame, order: str) -> DataFrame:
    """Rows in order with channels and personas in turn. For the few briefs of an experiment."""
    i = F.row_number().over(Window.orderBy(order)) - 1
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("brief_no") % len(names) + 1).cast("int"))
    return df.withColumn("brief_no", i).withColumns({"channel": pick(CHANNELS), "persona": pick(PERSONAS)})


def sample_reason(chars: Column, n_facts: Column, rate: Column, n_forbidden: Column, max_rate: float = 0.0) -> Column:
    """Why a sample is not kept, the first reason that holds; null if it is kept."""
    return F.when(~chars.between(MIN_CHARS, MAX_CHARS), "length").when(n_facts < MIN_FACTS, "few_facts").when(rate > max_rate, "unsupported").when(n_forbidden > 0, "forbidden")


def samples(rows: DataFrame, system: str, max_rate: float = 0.0) -> DataFrame:
    """(id, split, reason, messages) of (id, split, user, headline, body, cta, n_facts, rate, n_forbidden): chat samples, and why one is not kept."""
    answer = F.concat(F.lit("HEADLINE: "), "headline", F.lit("\nBODY:\n"), "body", F.lit("\nCTA: "), "cta")
    reason = sample_reason(F.length("body"), F.col("n_facts"), F.col("rate"), F.col("n_forbidden"), max_rate)
    return rows.select("id", "split", reason.alias("reason"), chat(F.lit(system), F.col("user"), answer).alias("messages"))


def chat(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))])
