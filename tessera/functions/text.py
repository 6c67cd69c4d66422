"""Normal forms of names and addresses as column expressions.

Only the folding of Unicode (compatibility forms, accents, scripts) is a Python function, and it runs on Arrow batches; all else
is built-in functions over arrays of tokens. Absent values are empty strings."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import tables as T

LATIN_END = 0x250
TOKEN_BREAK = re.compile(r"([\s,.;:()\[\]\-/#]+)")


def is_latin(c: Column) -> Column:
    """All code points below U+0250."""
    return ~c.rlike(r"[^\x{0}-\x{24F}]")


def without_marks(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))


def romanised(token: str) -> str:
    """A token of another script, letter by letter, by what Unicode names each: the last word of a letter's or vowel's name."""
    out = []
    for x in token:
        if ord(x) < LATIN_END:
            out.append(x)
        elif x.isdigit():
            out.append(str(unicodedata.digit(x)))
        else:
            name = unicodedata.name(x, "")
            if "LETTER" in name or "VOWEL SIGN" in name:
                sound = name.split()[-1].lower()
                out.append(sound if "VOWEL" in name or len(sound) < 2 or sound[-1] not in "a" else sound[:-1] or sound)
    return "".join(out)


def to_latin(text: str, learned: dict[str, str]) -> str:
    """Tokens outside the Latin script by a learned dictionary, else letter by letter."""
    if all(ord(x) < LATIN_END for x in text):
        return text
    parts = TOKEN_BREAK.split(text)
    for i, t in enumerate(parts):
        if any(ord(x) >= LATIN_END for x in t):
            known = learned.get(t) or romanised(t)
            parts[i] = T.STATE_WORDS.get(known, known)
    return "".join(parts)


def folder(learned: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Latin script, compatibility forms, no accents, lower case. learned: token to Latin token."""
    learned = dict(learned or {})

    @F.pandas_udf(StringType())
    def fold(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda x: x.lower() if x.isascii() else without_marks(unicodedata.normalize("NFKC", to_latin(x, learned))).lower())

    return fold


def lookup(table: dict[str, str], key: Column) -> Column:
    """The key's value, or null. The table is one constant, which the optimizer folds, however often it is used."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def among(t: Column, words: list[str]) -> Column:
    """Whether a token is one of some words without spaces."""
    return F.array_contains(F.split(F.lit(" ".join(words)), " "), t)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def strip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def unleeted(t: Column) -> Column:
    """Letters for the digits of a token that has digits and at least two letters."""
    mixed = t.rlike("[0-9]") & (F.length(F.regexp_replace(t, "[^a-z]", "")) >= 2)
    return F.when(mixed, F.translate(t, T.LEET_FROM, T.LEET_TO)).otherwise(t)


def digits(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def without_zeros(t: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))


def joined(a: Column, by: str = " ") -> Column:
    return F.array_join(a, by)


def normalise_names(df: DataFrame, raw: str, fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with name_clean, name_core, name_sorted, name_concat, legal and is_domain of the column `raw`."""
    step = df.withColumn("_n", F.trim((fold or folder())(F.coalesce(F.col(raw), F.lit("")))))
    step = step.withColumn("_n", strip(F.regexp_replace("_n", T.JUNK, " "), r" \-.,"))
    site = F.regexp_extract("_n", T.DOMAIN, 1)
    step = step.withColumn("is_domain", ((site != "") & ~F.col("_n").contains(" ")).cast("byte"))
    step = step.withColumn("_n", F.when(F.col("is_domain") == 1, F.replace(site, F.lit("-"), F.lit(""))).otherwise(F.col("_n")))
    padded = F.concat(F.lit(" "), F.col("_n"), F.lit(" "))
    place = F.instr(padded, " dba ")
    after, before = F.trim(F.substring(padded, place + 5, F.length(padded))), F.trim(F.substring(padded, F.lit(1), F.greatest(place - 1, F.lit(0))))
    other = F.when(after != "", after).when(before != "", before).otherwise(F.col("_n"))
    step = step.withColumn("_n", F.when(place > 0, other).otherwise(F.col("_n")))
    step = step.withColumn("_n", F.regexp_replace(F.replace("_n", F.lit("&"), F.lit(" and ")), r"(?<=\b[a-z])\.(?=[a-z]\b)", ""))
    step = step.withColumn("_t", F.transform(tokens(F.regexp_replace(F.regexp_replace("_n", "[.']", ""), T.NOT_ALNUM, " ")), unleeted))
    legal = lambda t: among(t, list(T.LEGAL_FORMS))
    step = step.withColumn("_c", F.transform("_t", lambda t: F.coalesce(lookup(T.LEGAL_FORMS, t), t)))
    step = step.withColumn("_k", F.filter("_t", lambda t: ~legal(t) & ~among(t, T.FILLER_WORDS)))
    step = step.withColumn("_k", F.when(F.size("_k") > 0, F.col("_k")).otherwise(F.col("_c")))
    out = {
        "name_clean": joined(F.col("_c")),
        "name_core": joined(F.col("_k")),
        "name_sorted": joined(F.array_sort(F.array_distinct("_k"))),
        "name_concat": joined(F.col("_k"), ""),
        "legal": joined(F.array_sort(F.array_distinct(F.transform(F.filter("_t", legal), lambda t: lookup(T.LEGAL_FORMS, t))))),
    }
    return step.withColumns(out).drop("_n", "_t", "_c", "_k")


def state_code(part: Column, country: Column) -> Column:
    """Code of an address part that is a state of the (lower-case) country, else null; in an unknown country any long full name."""
    known = F.lit(None).cast("string")
    for name, states in T.STATES.items():
        code = F.coalesce(lookup(states, part), F.when(among(part, sorted(set(states.values()))) & (F.length(part) == 2), part))
        known = F.when(country == name, code).otherwise(known)
    every = T.FRENCH_REGIONS | T.INDIAN_STATES | T.US_STATES
    return F.when(country.isin(list(T.STATES)), known).when(F.length(part) > 3, lookup(every, part))


def address_token(t: Column) -> Column:
    ordinal = F.regexp_extract(t, T.ORDINAL, 1)
    return F.when(ordinal != "", without_zeros(ordinal)).when(digits(t), without_zeros(t)).otherwise(F.coalesce(lookup(T.STREET_WORDS, t), t))


def normalise_addresses(df: DataFrame, raw: str, country: str | None = None, fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with addr_clean, addr_nums, house, street, city, state and postcode of the column `raw`."""
    where = F.lower(F.coalesce(F.col(country), F.lit(""))) if country else F.lit("")
    flat = F.regexp_replace(F.regexp_replace((fold or folder())(F.coalesce(F.col(raw), F.lit(""))), r"\bnull\b", " "), T.JUNK, " ")
    flat = F.replace(F.replace(flat, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    step = df.withColumn("_a", flat)
    parts = F.transform(F.split("_a", ","), lambda p: joined(tokens(F.regexp_replace(F.regexp_replace(p, "[.\\-/]", " "), T.NOT_ALNUM, " "))))
    step = step.withColumn("_p", F.filter(parts, lambda p: p != "")).withColumn("_w", where)
    step = step.withColumn("_s", F.transform("_p", lambda p: state_code(p, F.col("_w"))))
    kept = F.filter(F.arrays_zip(F.col("_p").alias("p"), F.col("_s").alias("s")), lambda x: x["s"].isNull())
    typed = lambda t: among(t, T.STREET_TYPES)
    step = step.withColumn("_k", F.transform(kept, lambda x: F.transform(tokens(x["p"]), address_token)))
    step = step.withColumn("_q", F.transform("_k", lambda k: F.struct(k.alias("k"), F.exists(k, digits).alias("n"), F.exists(k, typed).alias("t"))))
    numbered = F.transform("_q", lambda q, i: F.when(q["n"] | q["t"], i))
    step = step.withColumn("_i", F.coalesce(F.array_min(numbered), F.lit(-1)))
    street = F.when(F.col("_i") >= 0, F.get("_k", F.col("_i"))).otherwise(F.array().cast("array<string>"))
    rest = F.filter("_q", lambda q, i: (i != F.col("_i")) & ~q["n"])
    empty = F.lit("")
    step = step.withColumn("_r", street).withColumn("_f", F.flatten("_k"))
    nums, own = F.filter("_f", digits), F.filter("_r", digits)
    out = {
        "addr_clean": joined(F.col("_f")),
        "addr_nums": joined(F.array_distinct(nums)),
        "house": F.coalesce(F.get(own, F.lit(0)), F.get(nums, F.lit(0)), empty),
        "street": joined(F.filter("_r", lambda t: ~digits(t) & ~typed(t) & ~among(t, T.UNIT_WORDS))),
        "city": joined(F.array_distinct(F.filter(F.flatten(F.transform(rest, lambda q: q["k"])), lambda t: ~typed(t) & ~among(t, T.CITY_NOISE)))),
        "state": F.coalesce(F.get(F.filter("_s", lambda s: s.isNotNull()), F.lit(0)), empty),
        "postcode": F.when(F.col("_w").isin(T.NO_PIN), empty).otherwise(F.coalesce(F.get(F.filter(nums, lambda t: F.length(t) == 6), F.lit(0)), empty)),
    }
    return step.withColumns(out).drop("_a", "_p", "_w", "_s", "_k", "_q", "_i", "_r", "_f")


def sorted_key(c: Column) -> Column:
    """Tokens in order, repeats kept."""
    return joined(F.array_sort(tokens(c)))


def record_text(name: Column, address: Column, prefix: str = "") -> Column:
    """name | address, as encoders and cross-encoders read it."""
    empty = F.lit("")
    return F.concat(F.lit(prefix), F.coalesce(name, empty), F.lit(" | "), F.coalesce(address, empty))
