"""Binary confidence from the token trace of a structured answer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = "array<struct<token:string,logprob:double>>"
#: Type of a trace: the tokens of the output text in order.
TRACE = f"array<struct<token:string,bytes:array<int>,logprob:double,top_logprobs:{TOP}>>"
# Log-probability of a masked candidate, and the widest interval that a missing opponent may leave.
MASKED, WIDEST = -100.0, 0.05

_PIECES = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]]', re.DOTALL)
_NUMBER = re.compile(r"[ \t\r\n]*:[ \t\r\n]*(-?[0-9]+)")


def number_place(text: str, key: str) -> int | None:
    """Byte at which the integer of a top-level key begins; None without such a key or integer."""
    depth = 0
    for piece in _PIECES.finditer(text):
        sign = piece.group()
        if sign in "{[":
            depth += 1
        elif sign in "}]":
            depth -= 1
        elif depth == 1 and sign == f'"{key}"' and re.match(r"[ \t\r\n]*:", text[piece.end() :]):
            number = _NUMBER.match(text, piece.end())
            return len(text[: number.start(1)].encode()) if number else None
    return None


def value_offset(text: Column, key: str) -> Column:
    """`number_place` of a column; the nesting of JSON is beyond regular expressions."""

    @F.pandas_udf("long")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else number_place(t, key) for t in texts], dtype="Int64")

    return places(text)


def digit_of(token: Column) -> Column:
    """0 or 1 of a token that is the digit with white space, commas or braces around it; else null."""
    return F.nullif(F.regexp_extract(token, r"(?U)^\s*([01])\s*[,}]*\s*$", 1), F.lit("")).cast("int")


def _hex_bytes(entry: Column) -> Column:
    given = F.array_join(F.transform(entry["bytes"], lambda b: F.lpad(F.hex(b), 2, "0")), "")
    return F.coalesce(given, F.hex(F.encode(F.coalesce(entry["token"], F.lit("")), "UTF-8")))


def _pool(entry: Column) -> Column:
    """Candidates of an entry, the last of equal tokens, and its own token if it is not among them."""
    top = F.coalesce(entry["top_logprobs"], F.array().cast(TOP))
    tokens = F.transform(top, lambda t: t["token"])
    last = F.filter(top, lambda t, i: ~F.array_contains(F.slice(tokens, i + 2, F.greatest(F.size(tokens), F.lit(1))), t["token"]))
    own = F.array(F.struct(entry["token"].alias("token"), entry["logprob"].alias("logprob")))
    every = F.when(F.array_contains(tokens, entry["token"]), last).otherwise(F.concat(last, own))
    return F.filter(every, lambda t: t["logprob"] != MASKED)


def decision(text: Column, trace: Column, start: Column) -> Column:
    """struct(place, entry) of the token over byte `start`; null if bytes and text differ or no token covers it."""
    sizes = F.transform(trace, lambda e: F.length(_hex_bytes(e)) / 2)
    zero = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("place"))

    def step(acc: Column, size: Column) -> Column:
        here = (acc["used"] <= start) & (start < acc["used"] + size)
        return F.struct((acc["used"] + size).alias("used"), (acc["n"] + 1).alias("n"), F.coalesce(acc["place"], F.when(here, acc["n"])).alias("place"))

    place = F.aggregate(sizes, zero, step)["place"]
    whole = F.array_join(F.transform(trace, _hex_bytes), "") == F.hex(F.encode(text, "UTF-8"))
    return F.when(whole & place.isNotNull(), F.struct(place.alias("place"), F.get(trace, place).alias("entry")))


#: Columns that `with_confidence` adds, and the reason where they are null.
ADDED = ["ai_native", "p_one", "sampled_probability", "valid_mass", "decision_token", "decision_token_index", "censored", "p_other_max", "interval_width"]


def with_confidence(df: DataFrame, text: str, trace: str, key: str) -> DataFrame:
    """Adds to answers the sampled digit, its probability, and why there is none.

    `text` and `trace` (`TRACE`) name the columns of the output text and its tokens, `key`
    the field that holds the digit. An opponent that the candidates leave out gets half of
    the unreported mass, unless that leaves an interval wider than `WIDEST`. `problem` is
    null, `no_logprobs`, `no_key`, `bytes_differ`, `no_digit`, `no_mass` or `too_wide`; the
    other columns are null wherever it is not. Each step is a projection of its own: nested
    into one expression, the candidates would be worked out again for every use.
    """
    c = F.col
    mass = lambda v: F.aggregate(F.filter(c("_pool"), lambda t: F.coalesce(digit_of(t["token"]) == v, F.lit(False))), F.lit(0.0), lambda acc, t: acc + F.exp(t["logprob"]))
    reported = F.aggregate(c("_pool"), F.lit(0.0), lambda acc, t: acc + F.least(F.exp(t["logprob"]), F.lit(1.0)))
    steps = [
        {"_start": value_offset(c(text), key)},
        {"_at": decision(c(text), c(trace), c("_start"))},
        {"_pool": _pool(c("_at.entry")), "_digit": digit_of(c("_at.entry.token"))},
        {"_zero": mass(0), "_one": mass(1), "_reported": reported},
        {"_seen": F.when(c("_digit") == 1, c("_one")).otherwise(c("_zero")), "_other": F.when(c("_digit") == 1, c("_zero")).otherwise(c("_one"))},
        {"_rest": F.when(c("_other") > 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), c("_reported"))))},
        {"_width": F.when(c("_other") > 0, 0.0).otherwise(F.try_divide(c("_rest"), F.least(c("_seen"), F.lit(1.0)) + c("_rest"))), "_valid": c("_seen") + F.when(c("_other") > 0, c("_other")).otherwise(c("_rest") / 2)},
        {
            "problem": F.when(F.coalesce(F.size(trace), F.lit(0)) <= 0, "no_logprobs")
            .when(c("_start").isNull(), "no_key")
            .when(c("_at").isNull(), "bytes_differ")
            .when(c("_digit").isNull(), "no_digit")
            .when(c("_seen") <= 0, "no_mass")
            .when(c("_width") > WIDEST, "too_wide")
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    sampled = c("_seen") / c("_valid")
    values = [c("_digit"), F.when(c("_digit") == 1, sampled).otherwise(1 - sampled), sampled, c("_valid"), c("_at.entry.token"), c("_at.place"), c("_other") <= 0, c("_rest"), c("_width")]
    found = df.withColumns({n: F.when(c("problem").isNull(), v) for n, v in zip(ADDED, values, strict=True)})
    return found.drop("_start", "_at", "_pool", "_digit", "_zero", "_one", "_reported", "_seen", "_other", "_rest", "_width", "_valid")
