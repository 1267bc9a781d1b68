"""Text cleaning as column expressions: lines, boilerplate, evidence, hosts, archive addresses, messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines that are site furniture.
BOILERPLATE_EXACT = [
    "top of page", "bottom of page", "skip to content", "skip to main content", "scroll to top", "all rights reserved",
    "privacy policy", "terms of service", "terms and conditions", "terms & conditions", "accept cookies", "book a demo",
    "book a call", "blog", "booking faq", "other links", "rental links", "social media", "get in touch", "contact us",
    "learn more", "read more",
]
NAVIGATION = ["home", "contact", "login", "sign in", "sign up", "close menu"]
BOILERPLATE_CONTAINS = ["something went wrong", "all rights reserved", "thank you for joining", "i wish to subscribe", "please leave your email", "our website uses cookies", "copyright ", "© "]
# Words of lines that are kept first.
SIGNAL_TERMS = [
    "about", "ai", "api", "automation", "case stud", "customer", "data", "docs", "how it works", "industry", "integration",
    "machine learning", "model", "platform", "pricing", "product", "research", "service", "solution", "technical", "use case",
    "workflow",
]
# Marks of a parked domain.
PARKED = [
    "domain is for sale", "domain for sale", "this domain may be for sale", "this domain is parked", "parked free",
    "sedo domain parking", "forsale", "buy this domain", "hugedomains", "afternic", "dan.com/inquire", "domain has expired",
    "renew your domain", "under construction", "site not found", "default web site page", "welcome to nginx", "it works!",
]
# Hosts whose pages belong to many.
SHARED_HOSTS = ["airtable.com", "notion.so", "google.com", "docs.google.com", "sites.google.com", "medium.com", "substack.com", "linktr.ee", "carrd.co", "github.com", "angel.co", "itsmyurls.com"]
SHARED_SUFFIXES = [".notion.site", ".wixsite.com", ".github.io", ".webflow.io", ".framer.website", ".substack.com", ".myshopify.com"]
# Lines that an archive's banner adds.
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
ARCHIVE_LINES = [
    r"\d+\s+captures$", r"\[\d+\s+captures\]\(.*\)$", r"about this capture$", r"collected by$", r"timestamps$", r"collection:\s",
    r"web crawl data from common crawl\.?$", r"(?:the\s+)?wayback machine\b.*$",
    rf"\d{{1,2}}\s+(?:{_MONTHS})\w*\s+\d{{4}}\s*[-–]\s*\d{{1,2}}\s+(?:{_MONTHS})\w*\s+\d{{4}}$",
    r"\|[\s|]*$", r"\|\s*-{2,}.*$", rf"\|(?:\s*(?:{_MONTHS})\s*\|)+$", r"\|(?:\s*\d{1,4}\s*\|)+$",
]

BUDGET, LEAST_EVIDENCE, LONGEST_MESSAGE = 20_000, 100, 100_000


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cleaned(c: Column) -> Column:
    """Stripped; null and the words of missing values become empty."""
    s = stripped(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin("nan", "none", "nat"), "").otherwise(s)


def any_of(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def text_lines(c: Column) -> Column:
    """Lines with single spaces, without blank ones."""
    unix = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return F.filter(F.transform(F.split(unix, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


# Shapes of lines that carry no claim.
ASSET_START = "!["
ASSET_NAME = r"\.(png|jpe?g|gif|webp|svg|avif)(\)|\?|$)"
EDGE_SIGNS = r"^[\[\]()#*:_\-. ]+|[\[\]()#*:_\-. ]+$"
EMAIL_LINE = r"(?U)^[\w.+-]+@[\w.-]+\.[a-z]{2,}$"
TELEPHONE_LINE = r"(?U)^[\d\s().+-]{7,}$"
LINK_STARTS = ["tel:", "mailto:"]
MENU_PREFIX = r"(?i)^(social media|other links|rental links)\s+\[\.\.\.\]\s*"
SHORTEST_LINK = 80


def is_asset(low: Column) -> Column:
    """Of a lower-cased line."""
    return low.startswith(ASSET_START) | F.regexp_like(low, F.lit(ASSET_NAME))


def core_of(low: Column) -> Column:
    """A lower-cased line without signs at its ends."""
    return F.regexp_replace(low, EDGE_SIGNS, "")


def is_boilerplate(core: Column) -> Column:
    """Of a line's core."""
    starts = F.lit(False)
    for word in LINK_STARTS:
        starts = starts | core.startswith(word)
    return (
        core.isin("", *BOILERPLATE_EXACT, *NAVIGATION)
        | (F.contains(core, F.lit("{{")) & F.contains(core, F.lit("}}")))
        | ((F.length(core) <= 3) & ~F.regexp_like(core, F.lit(r"\p{L}")))
        | any_of(core, BOILERPLATE_CONTAINS)
        | starts
        | F.regexp_like(core, F.lit(EMAIL_LINE))
        | F.regexp_like(core, F.lit(TELEPHONE_LINE))
    )


def line_keys(lines: Column) -> Column:
    """Letters and digits of each line, lower-cased."""
    return F.transform(lines, lambda x: F.lower(F.regexp_replace(x, r"(?U)\W+", "")))


def first_seen(lines: Column, keys: Column | None = None) -> Column:
    """Lines whose letters and digits, lower-cased, were not seen before; lines without any all stay.

    `keys` are the lines' keys as a column of their own: an expression would be worked
    out again for every line.
    """
    keys = line_keys(lines) if keys is None else keys
    pairs = F.arrays_zip(lines.alias("line"), keys.alias("key"))
    kept = F.filter(pairs, lambda p, i: (p["key"] == "") | (F.array_position(keys, p["key"]) == i + 1))
    return F.transform(kept, lambda p: p["line"])


def within_budget(lines: Column, budget: int = BUDGET) -> Column:
    """Lines, signal lines first, up to the first that would overrun the budget of characters."""
    lowered = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    marked = F.transform(lowered, lambda p: F.struct(p["line"].alias("line"), (p["line"].startswith("#") | any_of(p["low"], SIGNAL_TERMS)).alias("signal")))
    # false sorts before true, and a stable order needs the place
    ordered = F.transform(F.array_sort(F.transform(marked, lambda p, i: F.struct((~p["signal"]).alias("after"), i.alias("place"), p["line"].alias("line")))), lambda p: p["line"])
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["over"] | (acc["used"] + F.length(x) + 1 > budget)
        return F.struct(F.when(over, acc["used"]).otherwise(acc["used"] + F.length(x) + 1).alias("used"), F.when(over, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"), over.alias("over"))

    whole = F.length(F.array_join(lines, "\n")) <= budget
    return F.when(whole, lines).otherwise(F.aggregate(ordered, start, step)["kept"])


def signal_lines(c: Column) -> Column:
    """A page's lines that can carry claims."""
    prefixed = F.transform(text_lines(c), lambda x: F.trim(F.regexp_replace(x, MENU_PREFIX, "")))
    lowered = F.transform(prefixed, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    cored = F.transform(lowered, lambda p: F.struct(p["line"].alias("line"), p["low"].alias("low"), core_of(p["low"]).alias("core")))
    link = lambda x: x.startswith("[") & F.contains(x, F.lit("](")) & (F.length(x) < SHORTEST_LINK)
    kept = F.filter(cored, lambda p: ~is_asset(p["low"]) & ~is_boilerplate(p["core"]) & ~link(p["line"]))
    return F.transform(kept, lambda p: p["line"])


def evidence_lines(pages: DataFrame, html: str, budget: int = BUDGET) -> DataFrame:
    """`pages` with `lines`, the visible lines of the column `html` that can carry claims, once each, within the budget.

    Lines and keys are columns of their own, so that each is worked out once.
    """
    rest = [c for c in pages.columns if c != "lines"]
    lines = pages.select(*rest, signal_lines(html_text(F.col(html))).alias("lines"))
    keyed = lines.select("*", line_keys(F.col("lines")).alias("keys of lines"))
    once = keyed.select(*rest, first_seen(F.col("lines"), F.col("keys of lines")).alias("lines"))
    return once.select(*rest, within_budget(F.col("lines"), budget).alias("lines"))


def page_kind(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last == "", "homepage").otherwise(last)


def evidence(pages: Column) -> tuple[Column, Column]:
    """(pages used, evidence) of an array of struct(url, lines); a page keeps its number if others are skipped."""
    blocks = F.transform(pages, lambda p, i: F.struct(p["url"].alias("url"), F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit(": "), page_kind(p["url"]), F.lit("]\nURL: "), p["url"], F.lit("\n"), F.array_join(p["lines"], "\n")).alias("block"), (F.size(p["lines"]) > 0).alias("ok")))
    used = F.filter(blocks, lambda b: b["ok"] & (b["url"] != ""))
    text = F.array_join(F.transform(used, lambda b: b["block"]), "\n\n")
    enough = F.length(text) >= LEAST_EVIDENCE
    return F.when(enough, F.array_join(F.transform(used, lambda b: b["url"]), " | ")).otherwise(""), F.when(enough, text).otherwise("")


def html_text(html: Column) -> Column:
    """Visible text of a page, a line for each block element."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1>", "")
    lines = F.regexp_replace(bare, r"(?i)<(br|/?(p|div|li|ul|ol|h[1-6]|nav|article|section|tr|table|footer|header))\b[^>]*>", "\n")
    text = F.regexp_replace(lines, r"<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def host_of(url: Column) -> Column:
    s = F.trim(F.coalesce(url, F.lit("")))
    with_scheme = F.when(F.contains(s, F.lit("://")), s).otherwise(F.concat(F.lit("http://"), s))
    return F.regexp_replace(F.lower(F.regexp_extract(with_scheme, r"^[^:]+://([^/?#]*)", 1)), r"^www\.", "")


def is_homepage(url: Column) -> Column:
    return F.coalesce(F.regexp_like(F.trim(url), F.lit(r"^https?://[^/?#]+")), F.lit(False))


def is_shared_host(host: Column) -> Column:
    out = host.isin(*SHARED_HOSTS)
    for suffix in SHARED_SUFFIXES:
        out = out | host.endswith(suffix)
    return out


def is_parked(html: Column) -> Column:
    return any_of(F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 32_768)), PARKED)


def archive_url(url: Column, timestamp: Column, modifier: str = "if_") -> Column:
    s = F.trim(url)
    full = F.when((s != "") & ~F.contains(s, F.lit("://")), F.concat(F.lit("https://"), s)).otherwise(s)
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit(f"{modifier}/"), full)


def unwrapped(url: Column) -> Column:
    origin = F.regexp_replace(url, r"^https?://web\.archive\.org/web/\d+[a-z_]*/", "")
    return F.regexp_replace(origin, r"^(https?):/([^/])", "$1://$2")


def without_archive_chrome(c: Column) -> Column:
    rule = "(?i)^(?:" + "|".join(ARCHIVE_LINES) + ")"
    kept = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: ~F.regexp_like(stripped(x), F.lit(rule)))
    inline = F.regexp_replace(F.array_join(kept, "\n"), r"https?://web\.archive\.org/web/\d+[a-z_]*/", "")
    return F.regexp_replace(inline, r"(https?):/([^/])", "$1://$2")


def archived_evidence(pages: DataFrame, url: str, raw: str, html: bool = True, budget: int = BUDGET) -> DataFrame:
    """`pages` of an archive as those of the live site: their own addresses, without the archive's lines and links, and `lines` cleaned as live ones are.

    Text comes as HTML or as plain lines.
    """
    text = html_text(F.col(raw)) if html else F.col(raw)
    rest = [c for c in pages.columns if c not in (url, raw, "lines")]
    bare = pages.select(*rest, unwrapped(F.col(url)).alias(url), without_archive_chrome(text).alias(raw))
    lines = bare.select(*rest, url, signal_lines(F.col(raw)).alias("lines"))
    keyed = lines.select("*", line_keys(F.col("lines")).alias("keys of lines"))
    once = keyed.select(*rest, url, first_seen(F.col("lines"), F.col("keys of lines")).alias("lines"))
    return once.select(*rest, url, within_budget(F.col("lines"), budget).alias("lines"))


def parity(a: DataFrame, b: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of two versions that differ in a column or that one of them lacks: the key, which, and both values as JSON."""
    shown = lambda side, c: F.to_json(F.struct(F.col(f"{side}.{c}").alias("v")), {"ignoreNullFields": "false"})
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    said = F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("column"), shown("a", c).alias("first"), shown("b", c).alias("second"))) for c in columns])
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.array_compact(said)).alias("d")).select(key, "d.*")


def prompt(template: str, block: str, placeholder: str = "{family_block}") -> str:
    """A template with its one placeholder filled; fails if it has none or several."""
    if template.count(placeholder) != 1:
        raise ValueError(f"the template has {template.count(placeholder)} of {placeholder}")
    return template.replace(placeholder, block)


def scope_pattern(url: Column) -> Column:
    host = F.regexp_replace(host_of(url), r"([.\-+*?|&~#$^(){}\[\]\\])", r"\\$1")
    return F.when(host != "", F.concat(F.lit(r"/web/\d+[a-z_]*/https?:/+(?:www\.)?"), host, F.lit(".*"))).otherwise("")


# Efforts as tokens of a run's name, in the order in which they are looked for.
EFFORTS = ["none", "low", "medium", "high", "minimal"]


def run_effort(run_id: Column) -> Column:
    """The effort among the tokens of a run's name, or null."""
    tokens = F.split(F.lower(run_id), "_")
    return F.coalesce(*[F.when(F.array_contains(tokens, e), e) for e in EFFORTS])


def run_repeat(run_id: Column) -> Column:
    """The number of a last token such as r2, or null."""
    return F.nullif(F.regexp_extract(run_id, r"(?:^|_)r([0-9]+)$", 1), F.lit("")).try_cast("int")


def run_model(run_id: Column, known: list[str]) -> Column:
    """The first of the known models that a run's name holds, or blank."""
    return F.coalesce(*[F.when(F.contains(run_id, F.lit(m)), m) for m in known], F.lit(""))


def custom_id(key: Column, prefix: str) -> Column:
    """The name of a request for a key, each space inside as a hyphen; fails on a blank key."""
    clean = F.replace(cleaned(key), F.lit(" "), F.lit("-"))
    return F.when(clean == "", F.raise_error(F.lit("no identifier for a blank key"))).otherwise(F.concat(F.lit(prefix), clean))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def message(parts: list[tuple[str, Column]], optional: list[tuple[str, Column]]) -> Column:
    """Labelled lines; optional ones only where they have a value; cut at the longest message."""
    lines = [F.concat(F.lit(f"{label}: "), cleaned(c)) for label, c in parts]
    lines += [F.when(cleaned(c) != "", F.concat(F.lit(f"{label}: "), cleaned(c))) for label, c in optional]
    text = F.concat_ws("\n", *lines)
    return F.when(F.length(text) > LONGEST_MESSAGE, F.concat(F.substring(text, 1, LONGEST_MESSAGE), F.lit("\n[truncated]"))).otherwise(text)
