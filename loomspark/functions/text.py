"""Text functions as Column expressions; only NFC and entity decoding need Python, by Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
BOILERPLATE = (r"(?s)Sentry\.onLoad.*", r"(?s)Sentry\.init.*", r"(?s)window\.__\w+.*", r"(?s)function\s*\(\s*\)\s*\{.*")
PHONE_HIDDEN = "[SĐT đã ẩn]"
MAX_TOKEN = 60
_TOKEN = re.compile("[a-z0-9]+")
SENTENCE = r"(?<=[.!?…])\s+|\n+"
#: What :func:`strip` takes off, for a batch in Python; there ``str.strip`` takes \x1c to \x1f too.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def fold(every: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """struct(s, out): the state after all elements of an array, and what the steps gave, as (state, array of ``kind``).

    An array that grows is copied each time, so elements are taken in blocks of about the root of their number.
    """
    none = F.array().cast(f"array<{kind}>")

    def of(every: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(every))).cast("int"))

        def one(acc: Column, x: Column) -> Column:
            s, add = step(acc["s"], x)
            return F.struct(s.alias("s"), F.concat(acc["out"], add).alias("out"))

        def block(acc: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(every, i, size), F.struct(acc["s"].alias("s"), none.alias("out")), one)
            return let(own, lambda got: F.struct(got["s"].alias("s"), F.array_append(acc["out"], got["out"]).alias("out")))

        first = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        blocks = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), size)
        return F.aggregate(blocks, first, block, lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["out"]).alias("out")))

    return let(every, of)


@cache
def accent_table() -> tuple[str, str]:
    """Lower-case letters with accents and what remains of each without them."""
    pairs = {"đ": "d"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(code).lower()
        plain = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(ch) == len(plain) == 1 and plain != ch:
            pairs[ch] = plain
    return "".join(pairs), "".join(pairs.values())


def deaccent(text: Column) -> Column:
    """A text of ASCII alone has no accents: letters are looked up in the others only."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.regexp_replace(F.translate(low, *accent_table()), r"\p{Mn}+", ""))


def flat_syllables(flat: Column) -> Column:
    """Syllables of a text that is without accents already."""
    return F.filter(F.regexp_extract_all(flat, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) <= MAX_TOKEN)


def flat_tokens(flat: str | None) -> list[str]:
    """:func:`flat_syllables` in a batch in Python, where it takes a tenth of the time."""
    return [t for t in _TOKEN.findall(flat or "") if len(t) <= MAX_TOKEN]


def syllables(text: Column) -> Column:
    return flat_syllables(deaccent(text))


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by joined neighbours; none of the latter for fewer than two tokens."""

    def add(t: Column) -> Column:
        n = F.size(t) - 1
        return F.when(n < 1, t).otherwise(F.concat(t, F.zip_with(F.slice(t, 1, F.greatest(n, F.lit(0))), F.slice(t, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))))

    return let(tokens, add)


def terms(text: Column) -> Column:
    return with_bigrams(syllables(text))


@F.pandas_udf(T.StringType())
def nfc_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", html.unescape(x)))


def strip_boilerplate(text: Column) -> Column:
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def mask_phones(text: Column) -> Column:
    """Vietnamese numbers of 9 to 11 digits; separators after the last digit stay. A match with another number of digits stays whole."""
    some = r"(?<!\d)(?:\+84|0)[\d.\- ]{7,14}"
    hits, gaps = F.regexp_extract_all(text, F.lit(some), F.lit(0)), F.split(text, some, -1)

    def hide(hit: Column) -> Column:
        core = F.regexp_replace(hit, r"[ .\-]+$", "")
        tail = F.substring(hit, F.length(core) + 1, F.length(hit))
        return F.when(F.length(F.regexp_replace(core, r"\D", "")).between(9, 11), F.concat(F.lit(PHONE_HIDDEN), tail)).otherwise(hit)

    return F.when(text.rlike(some), F.array_join(F.zip_with(gaps, F.transform(hits, hide), lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """NFC and entities decoded, boilerplate cut, phones masked, blanks squeezed, lines and text stripped; null is ''."""
    t = mask_phones(strip_boilerplate(nfc_unescape(F.coalesce(text, F.lit("")))))
    t = F.regexp_replace(F.replace(t, F.lit("\r"), F.lit("\n")), "[ \t ]+", " ")
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE), strip), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.array_join(F.filter(F.split(F.replace(deaccent(text), F.lit("."), F.lit(" ")), r"\s+"), lambda x: x != ""), "-")


def number(token: Column) -> Column:
    """A number's token with a point, without a zero fraction or trailing zeros."""
    v = F.regexp_replace(F.replace(token, F.lit(","), F.lit(".")), r"\.0$", "")
    return F.when(v.contains("."), F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", "")).otherwise(v)


def two_decimals(value: Column) -> Column:
    """A number with two decimals, rounded as its binary value lies, and to even only where that is a tie.

    Java rounds the shortest decimal that names the number, up: 1.615 would be 1.62, though it is a little less.
    From 2^-8 to 2^10 the number times a power of two is a whole number, whose hundredths are exact; beyond, what
    Java gives.
    """

    def exact(x: Column) -> Column:
        shift = F.when(x < 4, F.lit(1 << 60)).otherwise(F.lit(1 << 52))

        def hundredths(s: Column) -> Column:
            units = (x * s.cast("double")).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
            one = s.cast("decimal(19,0)")
            left = F.pmod(units, one)
            low = ((units - left) / one).cast("bigint")
            twice = left * F.lit(2).cast("decimal(1,0)")
            up = (twice > one) | ((twice == one) & (low % 2 == 1))
            return let(low + up.cast("bigint"), lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")))

        return let(shift, hundredths)

    return let(value.cast("double"), lambda x: F.when((x >= 2.0**-8) & (x < 2.0**10), exact(x)).otherwise(F.format_string("%.2f", x)))


def price_label(value: Column) -> Column:
    big = F.concat(F.regexp_replace(F.regexp_replace(two_decimals(value / 1e9), "0+$", ""), r"\.$", ""), F.lit(" tỷ"))
    return F.when(value >= 1e9, big).otherwise(F.concat(F.format_string("%.0f", F.bround(value / 1e6)), F.lit(" triệu")))


def evidence(text: Column, start: Column, end: Column, pad: int = 40) -> Column:
    """The text from ``pad`` code points before start to as many after end; both count from 0."""
    a = F.greatest(F.lit(0), start - pad)
    return F.trim(F.substring(text, a + 1, F.least(F.length(text), end + pad) - a))


def keyword_values(text: Column, keywords: dict[str, str]) -> Column:
    """Sorted (value, snippet) of the values whose keywords occur; the first keyword of a value gives the snippet."""
    low = F.lower(text)
    hits = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(i).alias("i"), F.locate(k, low).alias("at"), F.lit(len(k)).alias("n")) for i, (k, v) in enumerate(keywords.items())])
    firsts = let(F.filter(hits, lambda x: x["at"] > 0), lambda found: F.filter(found, lambda x: ~F.exists(found, lambda y: (y["value"] == x["value"]) & (y["i"] < x["i"]))))
    return F.array_sort(F.transform(firsts, lambda x: F.struct(x["value"].alias("value"), evidence(text, x["at"] - 1, x["at"] - 1 + x["n"], 30).alias("snippet"))))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def sha_key(*parts: Column | str, length: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def split_position(unit: Column, salt: str) -> Column:
    """[0, 1) from a hash of salt and unit, in steps of 1/10000."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), unit), 256), 1, 8), 16, 10).cast("long") % 10000 / F.lit(10000.0)
