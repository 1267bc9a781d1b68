"""Recorded responses as column expressions: texts, usage, errors, durations, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a provider's refusal for money.
QUOTA_MARKS = ["insufficient_quota", "billing", "quota exceeded", "current quota", "credit balance", "insufficient credit"]
# Usage keys of credits, first one wins.
CREDIT_KEYS = ["total_credits", "credits", "api_credits", "cost"]
# Credits of a block of five extractions.
BLOCK, BLOCK_CREDITS = 5, {"basic": 1.0, "advanced": 2.0}


def output_text(output: Column) -> Column:
    """First output_text part of the messages of array<struct<type, content:array<struct<type, text, ...>>>>; null without one."""
    messages = F.filter(output, lambda o: o["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], F.slice(messages[0]["content"], F.lit(1), F.lit(0)))))
    return F.get(F.filter(parts, lambda p: p["type"] == "output_text"), F.lit(0))


def token_total(names: list[str], kind: str) -> Column:
    """Tokens of a kind: both passes together where the table has them, else its flat column; absent counts as 0."""
    wanted = [f"a_{kind}_tokens", f"b_{kind}_tokens"] if "a_input_tokens" in names else [f"{kind}_tokens"]
    out = F.lit(0).cast("long")
    for c in wanted:
        if c in names:
            out = out + F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    return out


def error_class(status: Column, name: Column, body: Column) -> tuple[Column, Column, Column]:
    """(category, retryable, billing ambiguous) of a failed request, tested from money to transport."""
    n, text = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    quota = F.lit(False)
    for mark in QUOTA_MARKS:
        quota = quota | F.contains(text, F.lit(mark))
    named = lambda *words: F.regexp_like(n, F.lit("|".join(words)))
    is_ = lambda *codes: F.coalesce(status.isin(*codes), F.lit(False))
    server = F.coalesce(status.between(500, 599), F.lit(False))
    category = (
        F.when(named("responsecontract", "validationerror", "logprobextraction"), "schema")
        .when(quota, "quota_or_billing")
        .when(is_(401) | named("authentication"), "authentication")
        .when(is_(403) | named("permission"), "permission")
        .when(is_(429) | named("ratelimit", "rate_limit"), "rate_limit")
        .when(is_(408, 504) | named("timeout"), "timeout")
        .when(named("connection", "connecterror"), "connection")
        .when(is_(409), "conflict")
        .when(is_(503), "service_unavailable")
        .when(server, "server_error")
        .when(is_(400, 404, 405, 413, 415, 422), "bad_request")
        .otherwise("unknown")
    )
    unsure = category.isin("timeout", "connection", "service_unavailable", "server_error")
    return category, unsure | category.isin("rate_limit", "conflict"), unsure


def duration_seconds(c: Column) -> Column:
    """Plain seconds, never negative, or the sum of parts such as 1m30s or 250ms; null if neither."""
    s = F.lower(F.trim(c))
    parts = F.regexp_extract_all(s, F.lit(r"([0-9]+(?:\.[0-9]+)?(?:ms|s|m|h))"), F.lit(1))
    unit = lambda p: F.regexp_extract(p, "(ms|s|m|h)$", 1)
    scale = lambda u: F.when(u == "ms", 0.001).when(u == "s", 1.0).when(u == "m", 60.0).otherwise(3600.0)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.regexp_extract(p, r"^[0-9.]+", 0).cast("double") * scale(unit(p)))
    return F.coalesce(F.when(s.try_cast("double").isNotNull(), F.greatest(F.lit(0.0), s.try_cast("double"))), F.when(F.size(parts) > 0, total))


def count_header(c: Column, least: int = 0) -> Column:
    """Whole number of a header, thousands commas allowed; null if it is no number or less than `least`."""
    n = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double").cast("long")
    return F.when(n >= least, n)


def has_usable(results: Column, body: str = "raw_content") -> Column:
    """Whether any page of the results has a text."""
    return F.coalesce(F.exists(results, lambda r: F.regexp_like(F.coalesce(r[body], F.lit("")), F.lit(r"(?U)\S"))), F.lit(False))


def failure_reason(reason: Column, status: Column) -> Column:
    """The given reason; legacy_empty for an empty result without one; else the status, or unknown."""
    known = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    s = known(status)
    return F.coalesce(known(reason), F.when(s == "empty_results", "legacy_empty").otherwise(s), F.lit("unknown"))


def estimated_credits(n: Column, depth: str = "basic") -> Column:
    return F.greatest(n, F.lit(0)) * BLOCK_CREDITS[depth] / float(BLOCK)


def usage_credits(usage_json: Column) -> Column:
    """Credits of a usage object: the first known key that is a number, else the sum of all numbers, else 0."""
    known = [F.get_json_object(usage_json, f"$.{k}").try_cast("double") for k in CREDIT_KEYS]
    values = F.map_values(F.from_json(usage_json, "map<string,string>"))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v.try_cast("double"), F.lit(0.0)))
    return F.coalesce(*known, total, F.lit(0.0))


def outcome(primary_ok: Column, fallback_ok: Column, had_error: Column, text_length: Column, least: int = 100) -> Column:
    """What became of a page: success, success_fallback, thin, error or empty_results."""
    got = primary_ok | fallback_ok
    return F.when(got & (F.coalesce(text_length, F.lit(0)) < least), "thin").when(primary_ok, "success").when(fallback_ok, "success_fallback").when(had_error, "error").otherwise("empty_results")


def same_site(host: Column, home: Column) -> Column:
    """Equal hosts, or one a subdomain of the other; never for an empty one."""
    inside = lambda a, b: F.endswith(a, F.concat(F.lit("."), b))
    return (host != "") & (home != "") & ((host == home) | inside(host, home) | inside(home, host))


def elapsed(seconds: Column) -> Column:
    """Whole seconds, halves to even, in their two largest units: 1h 2m, 2m 3s or 3s."""
    s = F.greatest(F.rint(seconds), F.lit(0.0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    shown = F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.when(seconds.isNull(), "not available").otherwise(shown)
