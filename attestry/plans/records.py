"""Queries over recorded responses, runs and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import contracts as C
from attestry.functions import responses as R
from attestry.functions import text, traces
from attestry.operators import reports, scoring
from attestry.plans.catalog import query
from attestry.plans.tables import COMPANIES, REPLAYED, SCORED, companies, journal, scored, table
from attestry.streaming import journal as J

_K = "(props->>'$.k')::INT"


def _events(spark, d):
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))


def _picked(words: list, n) -> F.Column:
    return F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))


# token traces


@query(f"""
WITH t AS (SELECT event_id, (event_id % 2)::INT AS ai_native, event_id % 5 = 0 OR event_id % 7 = 0 AS censored, least(exp(-value / 4000), 1) AS p, exp(-3 - {_K} / 50.0::DOUBLE) AS q FROM events),
m AS (SELECT *, CASE WHEN censored THEN (1 - p) / 2 ELSE q END AS other, censored AND 1 - p > 0.05 AS wide FROM t)
SELECT event_id, CASE WHEN NOT wide THEN ai_native END AS ai_native, CASE WHEN NOT wide THEN round(p / (p + other), 9) END AS sampled_probability,
  CASE WHEN NOT wide THEN round(p + other, 9) END AS valid_mass, CASE WHEN NOT wide THEN censored END AS censored, CASE WHEN wide THEN 'too_wide' END AS problem FROM m
""")  # fmt: skip
def trace_confidence(spark, d):
    """Confidence of the sampled digit from synthetic token traces, opponents masked or left out at times."""
    digit = (F.col("event_id") % 2).cast("string")
    head, tail = F.lit('{"note":"é \\"ai_native\\":0","in":{"ai_native":0},"ai_native":'), F.lit(',"n":1}')
    other = F.when(F.col("event_id") % 7 == 0, F.lit(traces.MASKED)).otherwise(-3 - F.col("k") / 50)
    p = -F.col("value") / 4000
    pair = lambda t, lp: F.struct(t.alias("token"), lp.alias("logprob"))
    top = F.when(F.col("event_id") % 5 == 0, F.array(pair(digit, p))).otherwise(F.array(pair(digit, p), pair((1 - F.col("event_id") % 2).cast("string"), other)))
    token = lambda t, lp, c: F.struct(t.alias("token"), F.lit(None).cast("array<int>").alias("bytes"), lp.alias("logprob"), c.alias("top_logprobs"))
    none = F.lit(None).cast(traces.TOP)
    rows = _events(spark, d).select("event_id", F.concat(head, digit, tail).alias("text"), F.array(token(head, F.lit(0.0), none), token(digit, p, top), token(tail, F.lit(0.0), none)).alias("trace"))
    found = traces.with_confidence(rows, "text", "trace", "ai_native")
    return found.select("event_id", "ai_native", F.round("sampled_probability", 9).alias("sampled_probability"), F.round("valid_mass", 9).alias("valid_mass"), "censored", "problem")


# responses


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY 1")
def output_text(spark, d):
    part = F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"))
    kind = F.when(F.col("role") == "assistant", "message").otherwise("reasoning")
    output = F.sort_array(F.collect_list(F.struct("turn", kind.alias("type"), F.array(part).alias("content"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(output.alias("output"))
    return rows.select("conv_id", R.output_text(F.col("output"))["text"].alias("answer"))


@query("SELECT o_orderkey, (o_orderkey % 1000 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END)::BIGINT AS input, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 7 END, 0)::BIGINT AS cached FROM orders")
def usage_totals(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (k % 1000).alias("a_input_tokens"), F.when(k % 3 != 0, F.col("o_custkey")).alias("b_input_tokens"), F.when(k % 2 == 0, 7).alias("a_cached_tokens"))
    return rows.select("o_orderkey", R.token_total(rows.columns, "input").alias("input"), R.token_total(rows.columns, "cached").alias("cached"))


_STATUSES = [401, 403, 429, 408, 409, 503, 500, 404, 200, 504]


@query(f"""
WITH e AS (SELECT event_id, ({_STATUSES})[{_K} % 10 + 1] AS status, event_id % 11 = 0 AS quota, event_id % 13 = 0 AS dropped FROM events),
c AS (SELECT event_id, CASE WHEN quota THEN 'quota_or_billing' WHEN status = 401 THEN 'authentication' WHEN status = 403 THEN 'permission' WHEN status = 429 THEN 'rate_limit' WHEN status IN (408, 504) THEN 'timeout'
  WHEN dropped THEN 'connection' WHEN status = 409 THEN 'conflict' WHEN status = 503 THEN 'service_unavailable' WHEN status = 500 THEN 'server_error' WHEN status = 404 THEN 'bad_request' ELSE 'unknown' END AS category FROM e)
SELECT category, count(*) AS n, bool_or(category IN ('timeout', 'connection', 'service_unavailable', 'server_error', 'rate_limit', 'conflict')) AS retryable, bool_or(category IN ('timeout', 'connection', 'service_unavailable', 'server_error')) AS ambiguous FROM c GROUP BY 1
""")  # fmt: skip
def error_classes(spark, d):
    e = _events(spark, d)
    category, retryable, ambiguous = R.error_class(_picked(_STATUSES, F.col("k") % 10), F.when(F.col("event_id") % 13 == 0, "APIConnectionError"), F.when(F.col("event_id") % 11 == 0, "You exceeded your Current Quota"))
    rows = e.select(category.alias("category"), retryable.alias("retryable"), ambiguous.alias("ambiguous"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.bool_or("retryable").alias("retryable"), F.bool_or("ambiguous").alias("ambiguous"))


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_K}::DOUBLE WHEN 1 THEN {_K} * 60.0::DOUBLE + {_K} WHEN 2 THEN round({_K} * 0.001::DOUBLE, 6) END AS seconds, ({_K} * 1000)::BIGINT AS allowed FROM events")
def header_durations(spark, d):
    k = F.col("k").cast("string")
    shown = F.when(F.col("event_id") % 4 == 0, k).when(F.col("event_id") % 4 == 1, F.concat(k, F.lit("m"), k, F.lit("s"))).when(F.col("event_id") % 4 == 2, F.concat(k, F.lit("ms"))).otherwise("soon")
    count = F.when(F.col("k") == 0, "0").otherwise(F.concat(k, F.lit(",000")))
    return _events(spark, d).select("event_id", F.round(R.duration_seconds(shown), 6).alias("seconds"), R.count_header(count).alias("allowed"))


@query(f"SELECT CASE WHEN event_type = 'error' AND {_K} % 2 = 0 THEN 'blocked' WHEN event_type = 'error' THEN 'legacy_empty' WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS reason, count(*) AS n FROM events GROUP BY 1")
def failure_reasons(spark, d):
    status = F.when(F.col("event_type") == "error", "empty_results").when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    reason = F.when((F.col("event_type") == "error") & (F.col("k") % 2 == 0), "blocked")
    return _events(spark, d).select(R.failure_reason(reason, status).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT page_id % 20 AS crawl, count(*) AS pages, sum((host = 'example.com' OR host LIKE '%.example.com')::INT)::BIGINT AS on_domain_pages, sum(length(html))::BIGINT AS total_raw_chars,
  count(*) - sum((host = 'example.com' OR host LIKE '%.example.com')::INT)::BIGINT AS off_domain_pages, 100.0::DOUBLE * sum((host = 'example.com' OR host LIKE '%.example.com')::INT) / count(*) AS on_domain_pct
FROM (SELECT page_id, html, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages) GROUP BY 1
""")  # fmt: skip
def crawl_quality(spark, d):
    pages = table(spark, d, "pages").withColumn("crawl", F.col("page_id") % 20)
    return reports.crawl_quality(pages, "crawl", R.same_site(text.host_of(F.col("url")), F.lit("example.com")), F.col("html"))


@query(f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {_K}::DOUBLE WHEN 1 THEN {_K} + 2.0::DOUBLE ELSE 0.0::DOUBLE END AS credits, {_K} / 5.0::DOUBLE AS estimate FROM events")
def crawl_credits(spark, d):
    k = F.col("k").cast("string")
    usage = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"credits":'), k, F.lit(',"pages":9}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"pages":2,"extra":'), k, F.lit("}")))
    return _events(spark, d).select("event_id", R.usage_credits(usage).alias("credits"), R.estimated_credits(F.col("k")).alias("estimate"))


@query("SELECT CASE WHEN event_type IN ('purchase', 'signup') AND value < 10 THEN 'thin' WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'signup' THEN 'success_fallback' WHEN event_type = 'error' THEN 'error' ELSE 'empty_results' END AS outcome, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, outcome")
def fetch_outcomes(spark, d):
    is_ = lambda x: F.col("event_type") == x
    rows = table(spark, d, "events").select(R.outcome(is_("purchase"), is_("signup"), is_("error"), F.col("value"), 10).alias("outcome"))
    return reports.run_counters(rows, "outcome")


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS elapsed FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def elapsed_labels(spark, d):
    return table(spark, d, "events").select("event_id", R.elapsed((F.col("event_id") * 7 % 9000).cast("double")).alias("elapsed"))


# labels and runs


@query(f"""
WITH {COMPANIES} SELECT company, CASE WHEN company % 17 = 0 THEN 'subclass' WHEN company % 19 = 0 THEN 'family' WHEN ai = (rad = 'RAD-NA') OR company % 23 = 0 AND ai THEN 'rad_family' ELSE 'rationale' END AS breach FROM companies
WHERE company % 17 = 0 OR company % 19 = 0 OR company % 23 = 0 AND ai OR company % 29 = 0
""")  # fmt: skip
def taxonomy_audit(spark, d):
    c, k = companies(spark, d), F.col("company")
    rows = c.select(
        "company",
        F.when(k % 17 == 0, "2X").otherwise(F.col("subclass")).alias("subclass"),
        F.when((k % 23 == 0) & F.col("ai"), "RAD-NA").otherwise(F.col("rad")).alias("rad"),
        F.when(k % 19 == 0, (~F.col("ai")).cast("int")).otherwise(F.col("ai").cast("int")).alias("ai_native"),
        F.when(k % 29 == 0, " ").otherwise("as the evidence says").alias("rationale"),
    )
    return reports.taxonomy_breaches(rows, "ai_native", "subclass", "rad", "rationale").select("company", "breach")


@query(f"WITH {COMPANIES} SELECT company, ai::INT AS ai_native, subclass, rad AS rad_score, CASE WHEN ai THEN confidence::VARCHAR ELSE '' END AS rad_confidence, CASE WHEN ai THEN category ELSE '' END AS rad_critique FROM companies")
def pass_assembly(spark, d):
    c = companies(spark, d)
    first = c.select("company", F.col("ai").cast("int").alias("ai_native"))
    second = c.select("company", "subclass", F.col("rad").alias("rad_score"), F.col("confidence").alias("rad_confidence"), F.col("category").alias("rad_critique"))
    return reports.assembled(first, second, "company").select("company", "ai_native", "subclass", "rad_score", "rad_confidence", "rad_critique")


@query(f"""
WITH {COMPANIES}, p AS (SELECT ai::INT::VARCHAR AS g_ai, subclass AS g_sub, rad AS g_rad, (CASE WHEN company % 6 = 0 THEN NOT ai ELSE ai END)::INT::VARCHAR AS p_ai, CASE WHEN company % 4 = 0 THEN '1A' ELSE subclass END AS p_sub, CASE WHEN company % 5 = 0 THEN 'RAD-L' ELSE rad END AS p_rad FROM companies),
r AS (SELECT 'subclass_given_family' AS measure, g_sub AS g, p_sub AS p FROM p WHERE g_ai = p_ai UNION ALL SELECT 'rad_of_native', g_rad, p_rad FROM p WHERE g_ai = '1'),
l AS (SELECT measure, g AS x FROM r UNION SELECT measure, p FROM r),
f AS (SELECT l.measure, x, coalesce(2.0::DOUBLE * sum((g = x AND p = x)::INT) / nullif(sum((g = x)::INT) + sum((p = x)::INT), 0), 0) AS f1 FROM l JOIN r USING (measure) GROUP BY ALL)
SELECT a.*, macro_f1 FROM (SELECT measure, count(*) AS n, avg((g = p)::INT::DOUBLE) AS accuracy FROM r GROUP BY 1) a JOIN (SELECT measure, avg(f1) AS macro_f1 FROM f GROUP BY 1) USING (measure)
""")  # fmt: skip
def pass_b_isolated(spark, d):
    k, ai = F.col("company"), F.col("ai")
    rows = companies(spark, d).select(
        ai.cast("int").cast("string").alias("g_ai"), F.col("subclass").alias("g_sub"), F.col("rad").alias("g_rad"), F.when(k % 6 == 0, ~ai).otherwise(ai).cast("int").cast("string").alias("p_ai"),
        F.when(k % 4 == 0, "1A").otherwise(F.col("subclass")).alias("p_sub"), F.when(k % 5 == 0, "RAD-L").otherwise(F.col("rad")).alias("p_rad"),
    )
    return reports.isolating(rows, {"ai_native": "g_ai", "subclass": "g_sub", "rad": "g_rad"}, {"ai_native": "p_ai", "subclass": "p_sub", "rad": "p_rad"})


@query(f"WITH {SCORED} SELECT count(*) AS n, avg(confidence) AS mean_confidence, avg((confidence >= 0.9)::INT::DOUBLE) AS share_above FROM scored")
def calibration_rollup(spark, d):
    return reports.calibration_rollup(scoring.reliability(scored(spark, d), "confidence", "correct"))


@query(f"WITH {SCORED} SELECT lang, count(*) AS n, avg(1 - confidence / 20) AS mean, avg((1 - confidence / 20 < 0.96)::INT::DOUBLE) AS below_share, CASE WHEN avg(1 - confidence / 20) < 0.96 OR avg((1 - confidence / 20 < 0.96)::INT::DOUBLE) > 0.2 THEN 'fail' ELSE 'pass' END AS verdict FROM scored GROUP BY 1")
def mass_gate(spark, d):
    rows = scored(spark, d).withColumn("mass", 1 - F.col("confidence") / 20)
    return reports.mass_gate(rows, "mass", "lang", floor=0.96, allowed=0.2)


@query("SELECT user_id, count(*) AS n, count(c) AS n_present, CASE WHEN count(c) = count(*) THEN 'all' WHEN count(c) = 0 THEN 'none' ELSE 'partial' END AS presence FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 OR user_id % 3 = 1 AND event_id % 2 = 0 THEN value END AS c FROM events) GROUP BY 1")
def cached_presence(spark, d):
    u = F.col("user_id") % 3
    rows = table(spark, d, "events").withColumn("cached", F.when((u == 0) | ((u == 1) & (F.col("event_id") % 2 == 0)), F.col("value")))
    return reports.presence(rows, "cached", "user_id")


@query("SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_custkey // 2) > 1 AND c_custkey % 5 <> 0 THEN 'run ' || c_custkey // 2 || ' · r' || c_custkey % 5 ELSE 'run ' || c_custkey // 2 END AS label FROM customer")
def repeat_labels(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("run "), F.floor(k / 2).cast("string")).alias("label"), F.when(k % 5 != 0, k % 5).alias("repeat"))
    return reports.told_apart(rows, "label", "repeat").select("c_custkey", "label")


@query(f"WITH {COMPANIES} SELECT s AS subclass, " + ", ".join(f'count(*) FILTER (rad = \'{r}\') AS "{r}"' for r in C.RADS) + f" FROM (SELECT unnest({C.SUBCLASSES}) AS s) LEFT JOIN companies ON subclass = s GROUP BY 1")
def subclass_rad_heatmap(spark, d):
    return reports.heatmap(companies(spark, d), ("subclass", C.SUBCLASSES), ("rad", C.RADS))


@query("SELECT level, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 8 = 0 THEN '' ELSE event_type END AS level FROM events) GROUP BY 1")
def value_counts(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(F.when(e % 9 == 0, F.lit(None)).when(e % 8 == 0, "").otherwise(F.col("event_type")).alias("level"))
    return reports.levels(rows, "level")


@query("""
WITH p AS (SELECT n_chars AS a, n_chars + 100 AS b0, n_chars + 250 AS b1, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS f FROM documents),
s AS (SELECT count(*) AS n_first, count(*) AS n_second, sum((f IS NULL)::INT)::BIGINT AS n_unknown, sum(a)::BIGINT AS first_in, sum(CASE WHEN f = 1 THEN b1 ELSE b0 END)::BIGINT AS second_in_0, sum(CASE WHEN f = 0 THEN b0 ELSE b1 END)::BIGINT AS second_in_1, count(*) * 320 + count(*) * 350 AS tokens_out FROM p)
SELECT * REPLACE (tokens_out::BIGINT AS tokens_out), round(((first_in + second_in_0) * 0.2::DOUBLE + tokens_out * 1.25::DOUBLE) / 1e6, 6) AS usd_least, round(((first_in + second_in_1) * 0.2::DOUBLE + tokens_out * 1.25::DOUBLE) / 1e6, 6) AS usd_most FROM s
""")  # fmt: skip
def cost_preview(spark, d):
    n, f = F.col("n_chars"), F.col("doc_id") % 3
    plan = table(spark, d, "documents").select(n.alias("a"), (n + 100).alias("b0"), (n + 250).alias("b1"), F.when(f == 0, 0).when(f == 1, 1).alias("family"))
    out = reports.cost_range(plan, "a", "b0", "b1", "family", C.PRICES["small"], (320, 350))
    return out.withColumn("usd_least", F.round("usd_least", 6)).withColumn("usd_most", F.round("usd_most", 6))


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def backfill_rows(spark, d):
    written = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    log = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    return reports.backfill(log, written, "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "value")


@query(f"WITH {REPLAYED.replace('user_id AS company', '(event_id // 4) AS company')} SELECT company, error_line FROM replayed WHERE error_line IS NOT NULL AND error_retriable")
def retry_requests(spark, d):
    # four events a company, so that some end in an error
    events = journal(spark, d).withColumn("company", F.floor(F.col("line_no") / 4))
    return reports.retry_requests(J.replay(events), "company", "error_line", "error_retriable")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' OR value > 50 ORDER BY event_id DESC LIMIT 1")
def last_operational_event(spark, d):
    e = table(spark, d, "events").withColumn("limit_hit", F.when(F.col("event_type") == "error", 1)).withColumn("latency", F.when(F.col("value") > 50, F.col("value")))
    return reports.last_operational(e, "event_id", "limit_hit", "latency").select("event_id", "event_type", "value")


@query("SELECT event_type || ':' || user_id % 10 AS route, min(event_id) AS first_line, count(*) AS calls FROM events GROUP BY 1")
def route_warmup(spark, d):
    rows = table(spark, d, "events").withColumn("route", F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")))
    return reports.first_of_route(rows, "route", "event_id")


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def gated_predictions(spark, d):
    gold = table(spark, d, "labels").select("doc_id", "quality")
    return reports.gated_pairs(gold, table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 1).select("doc_id", "lang", "quality")


@query("SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(c_custkey) FROM customer)) + 1 AS next_number")
def instance_number(spark, d):
    return reports.next_number(table(spark, d, "orders").select(F.col("o_orderkey").alias("n")), table(spark, d, "customer").select(F.col("c_custkey").alias("n")), "n")
