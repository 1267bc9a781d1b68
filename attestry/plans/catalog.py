"""Every query by name, with the DuckDB SQL that its rows have to equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry import contracts as C
from attestry.functions import dates, numbers, text
from attestry.operators import aggregates as A
from attestry.operators import dedupe, joins, sampling, scoring, stats
from attestry.operators.quantiles import exact_quantiles
from attestry.plans.tables import COMPANIES, REPLAYED, SCORED, companies, journal, scored, table
from attestry.sources import sinks
from attestry.streaming import journal as J
from attestry.streaming import limits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# text and evidence


@query()
def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every web page: visible lines, without furniture, deduplicated, within the budget."""
    pages = text.evidence_lines(table(spark, d, "pages").select("page_id", "url", "html"), "html")
    shaped = pages.select("page_id", F.array(F.struct("url", "lines")).alias("pages"))
    used, words = text.evidence(F.col("pages"))
    return shaped.select("page_id", used.alias("website_pages_used"), words.alias("website_evidence"))


@query("SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '') GROUP BY doc_id")
def evidence_lines_dedup(spark, d):
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return table(spark, d, "documents").select("doc_id", lines.alias("l")).select("doc_id", F.size("l").cast("long").alias("n_lines"), F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("n_chars")).filter("n_lines > 0")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
r AS (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM l)
SELECT doc_id, count(*) AS kept, max(used)::BIGINT AS used FROM r WHERE used <= 2000 GROUP BY doc_id
""")  # fmt: skip
def evidence_budget(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    used = lines.withColumn("used", F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("pos")))
    return used.filter("used <= 2000").groupBy("doc_id").agg(F.count("*").alias("kept"), F.max("used").alias("used"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_matches(url, '^https?://[^/?#]+') AS eligible, regexp_matches(url, '\.github\.io|\.substack\.com|\.notion\.site') AS shared, 'https://web.archive.org/web/20230314000000if_/' || url AS archived, url AS origin FROM pages")
def host_normalise(spark, d):
    url = F.col("url")
    archived = text.archive_url(url, F.lit("20230314000000"))
    return table(spark, d, "pages").select("page_id", text.host_of(url).alias("host"), text.is_homepage(url).alias("eligible"), text.is_shared_host(text.host_of(url)).alias("shared"), archived.alias("archived"), text.unwrapped(archived).alias("origin"))


@query("SELECT count(*) AS n, count(*) FILTER (contains(lower(substr(html, 1, 32768)), 'under construction') OR contains(lower(substr(html, 1, 32768)), 'domain for sale') OR contains(lower(substr(html, 1, 32768)), 'forsale')) AS parked FROM pages")
def parked_pages(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("n"), F.sum(text.is_parked(F.col("html")).cast("long")).alias("parked"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS words, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) <= 100 AS within_limit FROM documents")
def word_limit(spark, d):
    n = text.word_count(F.col("text")).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("words"), (n <= 100).alias("within_limit"))


@query("SELECT conv_id, turn, 'Conversation: ' || conv_id || chr(10) || 'Role: ' || trim(role) || CASE WHEN turn > 0 THEN chr(10) || 'Turn: ' || turn ELSE '' END AS message FROM conversations")
def message_format(spark, d):
    turn = F.when(F.col("turn") > 0, F.col("turn").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.message([("Conversation", F.col("conv_id").cast("string")), ("Role", F.col("role"))], [("Turn", turn)]).alias("message"))


@query("SELECT conv_id, to_json(list_distinct_ordered) AS sources FROM (SELECT conv_id, list(role ORDER BY first_turn) AS list_distinct_ordered FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL) GROUP BY conv_id)")
def stable_source_union(spark, d):
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.array_distinct(roles)).alias("sources"))


@query("SELECT doc_id, sha256('[[\"doc_id\",\"' || doc_id || '\"],[\"lang\",\"' || lang || '\"],[\"source\",\"' || source || '\"]]') AS input_hash, substr(sha1('documents' || chr(31) || doc_id), 1, 12) AS identity FROM documents")
def input_hash(spark, d):
    names = ["doc_id", "lang", "source"]
    return table(spark, d, "documents").select("doc_id", numbers.canonical_digest(names, [F.col(c) for c in names]).alias("input_hash"), numbers.short_identity(F.lit("documents"), F.col("doc_id").cast("string")).alias("identity"))


# dates


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN strftime(o_orderdate, '%Y-%m') >= '1998-03' THEN 'GENAI-ERA' ELSE 'PRE-GENAI' END
  WHEN o_orderkey % 5 = 1 THEN CASE WHEN year(o_orderdate) >= 1999 THEN 'GENAI-ERA' ELSE 'PRE-GENAI' END
  WHEN o_orderdate::DATE >= DATE '1998-03-14' THEN 'GENAI-ERA' ELSE 'PRE-GENAI' END AS cohort,
  CASE WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS founded FROM orders
""")  # fmt: skip
def cohort_assignment(spark, d):
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(t, "yyyy-MM")).when(k == 1, F.date_format(t, "yyyy")).when(k == 2, F.date_format(t, "yyyy-MM-dd")).when(k == 3, F.lower(F.date_format(t, "ddMMMyyyy"))).otherwise(F.date_format(t, "MM/dd/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", dates.cohort_of(shown, "1998-03-14").alias("cohort"), dates.founded_month(shown).alias("founded"))


@query("SELECT CASE WHEN year(o_orderdate) <= 1995 THEN '<=2018' WHEN year(o_orderdate) >= 2001 THEN '2024+' ELSE (year(o_orderdate) + 23)::VARCHAR END AS bucket, count(*) AS n, avg((o_orderstatus = 'F')::INT::DOUBLE) AS rate, 1.96 * sqrt(avg((o_orderstatus = 'F')::INT::DOUBLE) * (1 - avg((o_orderstatus = 'F')::INT::DOUBLE)) / count(*)) AS half_width FROM orders GROUP BY 1")
def founded_bucket_counts(spark, d):
    rows = table(spark, d, "orders").withColumn("bucket", dates.founded_bucket(F.add_months("o_orderdate", 12 * 23)))  # orders play companies founded 23 years later
    return A.rate_with_normal_interval(rows, F.col("o_orderstatus") == "F", "bucket")


# deduplication

_LAST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {}) AS rn FROM events) WHERE rn = 1"


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "value")


@query(_LAST.format("event_id DESC"))
def dedupe_keep_last(spark, d):
    return dedupe.keep_last(_events(spark, d), "user_id", "event_id")


@query(_LAST.format("value, event_id"))
def dedupe_keep_first(spark, d):
    return dedupe.keep_first(_events(spark, d), "user_id", "value", "event_id")


@query(_LAST.format("event_type = 'error', event_id"))
def dedupe_prefer_ok_first(spark, d):
    return dedupe.prefer_ok_first(_events(spark, d), "user_id", F.col("event_type") != "error", "event_id")


@query(_LAST.format("event_type = 'error', event_id DESC"))
def dedupe_prefer_ok_last(spark, d):
    return dedupe.prefer_ok_last(_events(spark, d), "user_id", F.col("event_type") != "error", "event_id")


_RANK = "CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 0 ELSE 1 END"


@query(_LAST.format(f"{_RANK} DESC, CASE WHEN {_RANK} = 0 THEN -event_id ELSE event_id END"))
def dedupe_probe_rank(spark, d):
    return dedupe.by_rank(_events(spark, d), "user_id", F.expr(_RANK), "event_id")


@query(_LAST.format("event_id DESC").replace("FROM events", "FROM events WHERE event_type = 'purchase'"))
def last_completed(spark, d):
    return dedupe.last_where(_events(spark, d), "user_id", F.col("event_type") == "purchase", "event_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS user_id, row_number() OVER (PARTITION BY CASE WHEN user_id % 9 = 0 THEN -event_id ELSE user_id END ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def registry_upsert(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("user_id"))
    return dedupe.upsert(rows, "user_id", "event_id")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1")
def duplicate_conflicts(spark, d):
    return dedupe.conflicts(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


# joins

_PROCESSED = "processed AS (SELECT o_custkey AS c_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS evidence, o_orderkey FROM orders), last AS (SELECT c_custkey, evidence FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS rn FROM processed) WHERE rn = 1)"


def _processed(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("evidence"), "o_orderkey")


@query(f"WITH {_PROCESSED} SELECT c_custkey, c_name, coalesce(evidence, '') AS evidence FROM customer LEFT JOIN last USING (c_custkey)")
def evidence_left_join(spark, d):
    return joins.with_evidence(table(spark, d, "customer").select("c_custkey", "c_name"), _processed(spark, d), "c_custkey", "o_orderkey", ["evidence"])


@query(f"WITH {_PROCESSED} SELECT c_custkey, c_name, evidence FROM customer JOIN last USING (c_custkey) WHERE evidence <> ''")
def panel_inner_join(spark, d):
    return joins.evidence_panel(table(spark, d, "customer").select("c_custkey", "c_name"), _processed(spark, d), "c_custkey", "o_orderkey", "evidence").select("c_custkey", "c_name", "evidence")


@query("SELECT count(*) AS n_left, sum((l.doc_id IS NULL)::INT)::BIGINT AS n_unmatched, 0::BIGINT AS n_gained FROM documents LEFT JOIN labels l USING (doc_id)")
def join_audit_1to1(spark, d):
    return joins.audit_one_to_one(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""
WITH t AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F'), v AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS c_mktsegment FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c.c_custkey, CASE WHEN t.c_custkey IS NOT NULL AND v.c_custkey IS NOT NULL THEN v.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment,
  CASE WHEN t.c_custkey IS NULL THEN 'live' WHEN v.c_custkey IS NULL THEN 'dead_metadata' ELSE 'wayback_dead' END AS evidence_source
FROM customer c LEFT JOIN t USING (c_custkey) LEFT JOIN v USING (c_custkey)
""")  # fmt: skip
def overlay_merge(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    verdicts = orders.filter("o_orderstatus = 'O'").groupBy("c_custkey").agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return joins.overlay(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), orders.filter("o_orderstatus = 'F'"), verdicts, "c_custkey", ["c_mktsegment"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_anti_join(spark, d):
    log = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.unfinished(table(spark, d, "customer").select("c_custkey"), log, "c_custkey", F.col("o_orderstatus") == "F")


@query("SELECT count(*) AS overlap FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def overlap_check(spark, d):
    keys = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select("o_custkey")
    return keys("F").intersect(keys("O")).agg(F.count("*").alias("overlap"))


@query("""
WITH m AS (SELECT o_custkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey) AS death_ts FROM orders),
g AS (SELECT o_custkey, count(*) AS n_captures, max(death_ts) AS death_ts, max(death_ts) - INTERVAL 182 DAY AS target_ts, min(o_orderdate) AS first_ts, max(o_orderdate) FILTER (o_orderdate <= death_ts - INTERVAL 182 DAY) AS before FROM m GROUP BY 1)
SELECT o_custkey, n_captures, death_ts, target_ts, coalesce(before, first_ts) AS closest_ts, before IS NULL AS thin_history,
  abs(floor((epoch(coalesce(before, first_ts)) - epoch(target_ts)) / 86400))::BIGINT AS drift_days, floor((epoch(death_ts) - epoch(first_ts)) / 86400)::BIGINT AS lifespan_days FROM g
""")  # fmt: skip
def asof_predeath(spark, d):
    return joins.as_of(table(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("""
WITH w AS (SELECT o_custkey, o_orderdate, abs(floor((epoch(o_orderdate) - epoch(TIMESTAMP '1998-03-14')) / 86400))::BIGINT AS gap FROM orders WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-07-01')
SELECT o_custkey, arg_min(o_orderdate, (gap, o_orderdate)) AS closest_ts, min(gap) AS drift_days, count(*) AS n_window FROM w GROUP BY 1
""")  # fmt: skip
def nearest_capture(spark, d):
    return joins.nearest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "1997-12-01", "1998-07-01", "1998-03-14")


@query("SELECT e.event_id, e.user_id, p.value AS last_price FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'")
def asof_last_value(spark, d):
    e = table(spark, d, "events")
    prices = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_price"))
    return joins.latest_before(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), prices, "user_id", "ts", "ts", "last_price").select("event_id", "user_id", "last_price")


@query(f"WITH {COMPANIES} SELECT funding_bucket, count(*) AS n, min(funding) AS low, max(funding) AS high FROM companies GROUP BY 1")
def range_buckets(spark, d):
    return companies(spark, d).groupBy("funding_bucket").agg(F.count("*").alias("n"), F.min("funding").alias("low"), F.max("funding").alias("high"))


@query("SELECT place, c_custkey, c_name FROM customer JOIN (SELECT unnest([7, 3, 42, 99]) AS c_custkey, unnest([0, 1, 2, 3]) AS place) USING (c_custkey)")
def ordered_selection(spark, d):
    return joins.in_order(table(spark, d, "customer"), [7, 3, 42, 99], "c_custkey").select("place", "c_custkey", "c_name")


@query("SELECT count(*) AS n_both, sum((a.event_type <> b.event_type)::INT)::BIGINT AS event_type_flips FROM (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1) a JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) b USING (user_id)")
def verdict_flips(spark, d):
    e = _events(spark, d)
    return joins.flips(dedupe.keep_first(e, "user_id", "event_id"), dedupe.keep_last(e, "user_id", "event_id"), "user_id", ["event_type"])


@query("SELECT m.x AS model, e.x AS effort, count(d.doc_id) AS n FROM (SELECT unnest(['small','medium','large']) AS x) m CROSS JOIN (SELECT unnest(['low','medium','high']) AS x) e LEFT JOIN documents d ON (['small','medium','large'])[(d.doc_id % 3 + 1)::INT] = m.x AND (['low','medium','high'])[(d.doc_id % 4 + 1)::INT] = e.x GROUP BY ALL")
def run_matrix(spark, d):
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % n).cast("int"))
    models, efforts = ["small", "medium", "large"], ["low", "medium", "high"]
    rows = table(spark, d, "documents").groupBy(pick(models, 3).alias("model"), pick(efforts, 4).alias("effort")).agg(F.count("*").alias("n"))
    cells = spark.createDataFrame([(m, e) for m in models for e in efforts], "model string, effort string")
    return cells.join(rows, ["model", "effort"], "left").na.fill(0, ["n"])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 0 THEN c_acctbal END, -1) AS confidence FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def coalescing_lookup(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    first, second = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 3 == 0, F.col("c_acctbal"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(first, second, F.lit(-1.0)).alias("confidence"))


# survivorship


@query(f"WITH {COMPANIES} SELECT s AS subclass, count(company) AS n, 100.0::DOUBLE * count(company) / sum(count(company)) OVER () AS pct FROM (SELECT unnest({C.SUBCLASSES}) AS s) LEFT JOIN companies ON subclass = s AND survivor GROUP BY 1")
def distribution_fixed_domain(spark, d):
    return A.fixed_domain(companies(spark, d).filter("survivor"), "subclass", C.SUBCLASSES)


_WILSON = """SELECT {by}, k, n, 100.0::DOUBLE * k / n AS pct,
  100 * greatest(0, ((k::DOUBLE / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8416 / (4.0::DOUBLE * n * n)) / (1 + 3.8416 / n)) AS low,
  100 * least(1, ((k::DOUBLE / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8416 / (4.0::DOUBLE * n * n)) / (1 + 3.8416 / n)) AS high
FROM (SELECT {by}, sum(ai::INT)::BIGINT AS k, count(*) AS n FROM companies GROUP BY 1)"""


@query(f"WITH {COMPANIES} {_WILSON.format(by='source')}")
def wilson_rates(spark, d):
    return A.rate_with_interval(companies(spark, d), "ai", "source")


@query(f"WITH {COMPANIES} {_WILSON.format(by='thin')}")
def sensitivity_thin(spark, d):
    return A.rate_with_interval(companies(spark, d), "ai", "thin")


_MORTALITY = "SELECT {by}, sum(dead::INT)::BIGINT AS dead, sum(survivor::INT)::BIGINT AS survivors, 100.0::DOUBLE * sum(dead::INT) / (sum(dead::INT) + sum(survivor::INT)) AS mortality_pct FROM companies {where} GROUP BY 1 HAVING sum(dead::INT) + sum(survivor::INT) > 0"


@query(f"WITH {COMPANIES} {_MORTALITY.format(by='rad', where='WHERE ai')}")
def mortality_by_level(spark, d):
    return A.mortality(companies(spark, d).filter("ai"), "dead", "survivor", "rad")


@query(f"WITH {COMPANIES} SELECT b AS funding_bucket, r AS rad, coalesce(sum(dead::INT), 0)::BIGINT AS dead, coalesce(sum(survivor::INT), 0)::BIGINT AS survivors, 100.0::DOUBLE * sum(dead::INT) / nullif(sum(dead::INT) + sum(survivor::INT), 0) AS mortality_pct FROM (SELECT unnest({[b for b, _, _ in C.FUNDING_BUCKETS]}) AS b) CROSS JOIN (SELECT unnest({C.RADS[:3]}) AS r) LEFT JOIN companies ON funding_bucket = b AND rad = r AND ai GROUP BY ALL")
def mortality_grid(spark, d):
    return A.grid(companies(spark, d).filter("ai"), ("funding_bucket", [b for b, _, _ in C.FUNDING_BUCKETS]), ("rad", C.RADS[:3]), "dead", "survivor")


@query(f"WITH {COMPANIES}, t AS (SELECT unnest([1, 2, 3, 4, 5])::INT AS min_score) SELECT coalesce(source, 'ALL') AS source, coalesce(era, 'ALL') AS era, min_score, subclass, count(*) AS n FROM companies JOIN t ON confidence >= min_score GROUP BY GROUPING SETS ((source, era, min_score, subclass), (source, min_score, subclass), (era, min_score, subclass), (min_score, subclass))")
def filter_grid(spark, d):
    return A.threshold_cube(companies(spark, d), ["source", "era"], "confidence", [1, 2, 3, 4, 5], "subclass")


@query(f"WITH {COMPANIES}, c AS (SELECT subclass, sum(dead::INT)::BIGINT AS n_dead, sum(survivor::INT)::BIGINT AS n_survivor FROM companies GROUP BY 1) SELECT *, n_dead::DOUBLE / sum(n_dead) OVER () AS dead_share, n_survivor::DOUBLE / sum(n_survivor) OVER () AS survivor_share, (n_dead::DOUBLE / sum(n_dead) OVER ()) / nullif(n_survivor::DOUBLE / sum(n_survivor) OVER (), 0) AS lift FROM c")
def lift_table(spark, d):
    return A.lift(companies(spark, d), "subclass", "dead", "survivor")


@query(f"WITH {COMPANIES} {_MORTALITY.format(by='funding_bucket', where='')}")
def funding_shares(spark, d):
    return A.mortality(companies(spark, d), "dead", "survivor", "funding_bucket")


@query(f"WITH {COMPANIES} SELECT * FROM ({_MORTALITY.format(by='category', where='')}) ORDER BY dead + survivors DESC, category LIMIT 8")
def vertical_top8(spark, d):
    m = A.mortality(companies(spark, d), "dead", "survivor", "category")
    return m.orderBy(F.desc(F.col("dead") + F.col("survivors")), "category").limit(8)


@query("SELECT coalesce(a.month, b.month) AS month, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_a FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) a FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_b FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1) b ON a.month = b.month")
def monthly_series(spark, d):
    return A.monthly(table(spark, d, "orders"), "o_orderdate", table(spark, d, "lineitem"), "l_shipdate", "1997-01-01")


@query(f"WITH {COMPANIES} SELECT source, count(*) AS n, avg(confidence) AS mean, median(confidence::DOUBLE) AS median, quantile_cont(confidence::DOUBLE, 0.25) AS q1, quantile_cont(confidence::DOUBLE, 0.75) AS q3, avg((confidence <= 2)::INT::DOUBLE) AS low_share FROM companies GROUP BY 1")
def confidence_stats(spark, d):
    rows = companies(spark, d).select("source", "confidence")
    q = exact_quantiles(rows, "confidence", [0.25, 0.5, 0.75], "source").drop("n")
    rest = rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.avg((F.col("confidence") <= 2).cast("double")).alias("low_share"))
    return rest.join(q, "source").select("source", "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "low_share")


@query(f"WITH {SCORED}, e AS (SELECT unnest({C.HISTOGRAM_EDGES[:-1]})::DOUBLE AS low, unnest({C.HISTOGRAM_EDGES[1:]})::DOUBLE AS high, unnest(range(8))::INT AS bin) SELECT bin, low, high, count(doc_id) AS n FROM e LEFT JOIN scored ON confidence >= low AND confidence < high GROUP BY ALL")
def fixed_histogram(spark, d):
    return A.histogram(scored(spark, d), "confidence", C.HISTOGRAM_EDGES)


@query(f"WITH {COMPANIES} SELECT count(*) AS total, sum(survivor::INT)::BIGINT AS survivors, sum(excluded::INT)::BIGINT AS excluded, sum(dead::INT)::BIGINT AS dead, sum((source = 'wayback_dead')::INT)::BIGINT AS recovered, sum(strict::INT)::BIGINT AS strict FROM companies")
def funnel_counts(spark, d):
    n = lambda c: F.sum(F.expr(c).cast("long"))
    return companies(spark, d).agg(F.count("*").alias("total"), n("survivor").alias("survivors"), n("excluded").alias("excluded"), n("dead").alias("dead"), n("source = 'wayback_dead'").alias("recovered"), n("strict").alias("strict"))


_ASOF = ORACLES["asof_predeath"]


@query(f"SELECT count(*) AS n, sum(thin_history::INT)::BIGINT AS thin, floor(median(drift_days::DOUBLE))::BIGINT AS median_drift, floor(median(lifespan_days::DOUBLE))::BIGINT AS median_lifespan, 100.0::DOUBLE * sum((drift_days <= 30)::INT) / count(*) AS within_30_pct FROM ({_ASOF})")
def death_summary(spark, d):
    a = asof_predeath(spark, d)
    return a.agg(F.count("*").alias("n"), F.sum(F.col("thin_history").cast("long")).alias("thin"), F.floor(F.median("drift_days")).alias("median_drift"), F.floor(F.median("lifespan_days")).alias("median_lifespan"), (100.0 * F.sum((F.col("drift_days") <= 30).cast("long")) / F.count("*")).alias("within_30_pct"))


@query(f"SELECT CASE WHEN drift_days <= 7 THEN '<=7' WHEN drift_days <= 30 THEN '8-30' WHEN drift_days <= 90 THEN '31-90' WHEN drift_days <= 180 THEN '91-180' ELSE '181+' END AS drift, CASE WHEN n_captures = 1 THEN '1' WHEN n_captures <= 5 THEN '2-5' WHEN n_captures <= 20 THEN '6-20' WHEN n_captures <= 100 THEN '21-100' ELSE '101+' END AS captures, count(*) AS n FROM ({_ASOF}) GROUP BY ALL")
def coverage_summary(spark, d):
    a = asof_predeath(spark, d)
    return a.groupBy(numbers.bucket_of(F.col("drift_days"), C.DRIFT_BUCKETS).alias("drift"), numbers.bucket_of(F.col("n_captures"), C.CAPTURE_BUCKETS).alias("captures")).agg(F.count("*").alias("n"))


@query(f"WITH {COMPANIES}, c AS (SELECT subclass, sum(dead::INT)::DOUBLE AS a, sum(survivor::INT)::DOUBLE AS b FROM companies GROUP BY 1), t AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c) SELECT subclass, a::BIGINT AS a, b::BIGINT AS b, (a / na - b / nb) / sqrt((a + b) / (na + nb) * (1 - (a + b) / (na + nb)) * (1 / na + 1 / nb)) AS z FROM t")
def z_statistics(spark, d):
    return stats.z_tests(companies(spark, d), "subclass", "dead", "survivor")


@query()
def ztest_bh(spark, d):
    z = stats.z_tests(companies(spark, d), "subclass", "dead", "survivor").withColumn("p", stats.two_sided_p("z"))
    return stats.step_up(z, "p")


@query(f"WITH {COMPANIES}, c AS (SELECT rad, sum(dead::INT)::DOUBLE AS a, sum(survivor::INT)::DOUBLE AS b FROM companies GROUP BY 1), t AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c), e AS (SELECT a, b, (a + b) / (na + nb) * na AS ea, (a + b) / (na + nb) * nb AS eb FROM t) SELECT sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb) AS chi2, count(*) - 1 AS dof FROM e")
def chi2_statistic(spark, d):
    return stats.chi_square(companies(spark, d), "rad", "dead", "survivor")


@query()
def chi2_omnibus(spark, d):
    return stats.chi_square(companies(spark, d), "rad", "dead", "survivor").withColumn("p", stats.chi_square_tail("chi2", F.col("dof").cast("double")))


@query()
def logistic(spark, d):
    f = companies(spark, d).filter("dead OR survivor")
    rows = f.select(F.col("dead").cast("int").alias("dead"), F.col("ai").cast("int").alias("ai"), numbers.log_funding(F.col("funding")).alias("log_funding"), (F.col("era") == "GENAI-ERA").cast("int").alias("genai_era"))
    return stats.logistic(rows, "dead", ["ai", "log_funding", "genai_era"])


@query()
def logistic_models(spark, d):
    f = companies(spark, d).filter("dead OR survivor")
    group = F.when(F.col("subclass").isin("1A", "1B", "1C"), "core").otherwise("applied")
    rows = f.select(F.col("dead").cast("int").alias("died"), "ai", numbers.log_funding(F.col("funding")).alias("log_funding"), "era", F.col("category").alias("vertical"), "rad", group.alias("grouped"))
    return stats.death_models(rows, "died", "ai", "log_funding", "era", "vertical", "rad", "grouped", top=3)


@query(f"""
WITH {COMPANIES}, c AS (SELECT rad, sum(dead::INT)::DOUBLE AS a, sum((NOT dead)::INT)::DOUBLE AS b FROM companies WHERE dead OR survivor GROUP BY 1),
base AS (SELECT a AS a0, b AS b0 FROM c WHERE rad = 'RAD-NA'), t AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a * ln(a / (a + b)) + b * ln(b / (a + b))) AS ll FROM c)
SELECT 'rad[' || rad || ']' AS term, round(ln(a * b0 / (b * a0)), 7) AS coefficient, round(sqrt(1 / a + 1 / b + 1 / a0 + 1 / b0), 7) AS std_error, round(1 - ll / (na * ln(na / (na + nb)) + nb * ln(nb / (na + nb))), 7) AS pseudo_r2
FROM c CROSS JOIN base CROSS JOIN t WHERE rad <> 'RAD-NA'
""")  # fmt: skip
def logistic_by_level(spark, d):
    """A model of one factor, whose coefficients have a closed form."""
    f = companies(spark, d).filter("dead OR survivor").select(F.col("dead").cast("int").alias("died"), "rad")
    fitted = stats.logit_models(f, "died", {"rad": stats.Design(F.lit(True), stats.treatment(f, "rad", "RAD-NA"))})
    return fitted.filter("term <> 'intercept'").select("term", *[F.round(c, 7).alias(c) for c in ("coefficient", "std_error", "pseudo_r2")])


# scoring


@query(f"WITH {SCORED} SELECT lang, count(*) AS n, avg((gold = pred)::INT::DOUBLE) AS accuracy FROM scored GROUP BY 1")
def accuracy_axes(spark, d):
    return scoring.accuracy(scored(spark, d), "gold", "pred", "lang")


@query(f"WITH {SCORED}, l AS (SELECT gold AS x FROM scored UNION SELECT pred FROM scored), f AS (SELECT x, 2.0::DOUBLE * sum((gold = x AND pred = x)::INT) / nullif(sum((gold = x)::INT) + sum((pred = x)::INT), 0) AS f1 FROM l CROSS JOIN scored GROUP BY 1) SELECT count(*) AS n_labels, avg(coalesce(f1, 0)) AS macro_f1 FROM f")
def macro_f1(spark, d):
    return scoring.macro_f1(scored(spark, d), "gold", "pred")


@query(f"WITH {SCORED} SELECT gold, pred, count(*) AS n FROM scored GROUP BY ALL")
def confusion(spark, d):
    return scoring.confusion(scored(spark, d), "gold", "pred")


@query(f"WITH {SCORED} SELECT b::INT AS bin, count(doc_id) AS n, avg(confidence) AS mean_confidence, avg(correct::INT::DOUBLE) AS accuracy FROM (SELECT unnest(range(10)) AS b) LEFT JOIN scored ON least(floor(confidence * 10), 9) = b GROUP BY 1")
def reliability_bins(spark, d):
    return scoring.reliability(scored(spark, d), "confidence", "correct")


@query(f"WITH {SCORED}, r AS (SELECT least(floor(confidence * 10), 9) AS b, count(*) AS n, avg(confidence) AS c, avg(correct::INT::DOUBLE) AS a FROM scored GROUP BY 1) SELECT sum(n)::BIGINT AS n, sum(n * abs(a - c)) / sum(n) AS ece FROM r")
def reliability_ece(spark, d):
    return scoring.calibration_error(scored(spark, d), "confidence", "correct")


@query(f"WITH {SCORED}, r AS (SELECT row_number() OVER w AS rank, avg(correct::INT::DOUBLE) OVER (ORDER BY confidence DESC, doc_id ROWS UNBOUNDED PRECEDING) AS accuracy, count(*) OVER () AS total FROM scored WINDOW w AS (ORDER BY confidence DESC, doc_id)), g AS (SELECT unnest(range(1, 11)) / 10.0::DOUBLE AS coverage) SELECT coverage, rank AS k, accuracy FROM g JOIN r ON rank = greatest(1, round_even(coverage * total, 0)::BIGINT)")
def selective_curve(spark, d):
    return scoring.selective_curve(scored(spark, d), "confidence", "correct", "doc_id")


_BOOT = f"""
WITH {SCORED}, ranked AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n, correct, confidence FROM scored),
drawn AS (
  SELECT resample, (('0x' || substr(md5('20260705:' || resample || ':0:' || (draw // 4)), 1 + 8 * (draw % 4)::INT, 8))::BIGINT * n) >> 32 AS place
  FROM (SELECT count(*) AS n FROM scored), (SELECT unnest(range(10000)) AS resample), LATERAL (SELECT unnest(range(n)) AS draw)),
b AS (SELECT resample, avg(correct::INT::DOUBLE) AS hit, avg((correct::INT - (confidence >= 0.5)::INT)::DOUBLE) AS gap FROM drawn JOIN ranked USING (place) GROUP BY 1)
"""


def _resamples(spark, d, value):
    rows = scored(spark, d).select("doc_id", F.col("correct").cast("int").alias("hit"), (F.col("correct").cast("int") - (F.col("confidence") >= 0.5).cast("int")).alias("gap"))
    return scoring.bootstrap(rows, [value], "doc_id", 10_000, 20260705)


@query(_BOOT + "SELECT avg(hit) AS mean, quantile_cont(hit, 0.025) AS low, quantile_cont(hit, 0.975) AS high FROM b")
def bootstrap_ci(spark, d):
    return scoring.interval(_resamples(spark, d, "hit"), "hit")


@query(_BOOT + "SELECT avg(gap) AS mean, quantile_cont(gap, 0.025) AS low, quantile_cont(gap, 0.975) AS high, quantile_cont(gap, 0.025) > 0 OR quantile_cont(gap, 0.975) < 0 AS significant FROM b")
def paired_bootstrap(spark, d):
    return scoring.interval(_resamples(spark, d, "gap"), "gap").withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


@query(f"WITH {SCORED} SELECT count(*) AS n, min(confidence) AS least, avg(confidence) AS mean, list_sort(list(confidence))[(count(*) // 2 + 1)::INT] AS upper_median, avg((confidence < 0.9)::INT::DOUBLE) AS below_share FROM scored")
def valid_mass_summary(spark, d):
    return scoring.spread_summary(scored(spark, d), "confidence", 0.9)


@query("SELECT vec_id, -(p * log2(p) + (1 - p) * log2(1 - p)) AS entropy_bits, abs(2 * p - 1) AS margin, greatest(p, 1 - p) AS top1 FROM (SELECT vec_id, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS p FROM embeddings)")
def token_entropy(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", (1 / (1 + F.exp(-F.col("embedding")[0].cast("double")))).alias("p"))
    return p.select("vec_id", numbers.entropy_bits(F.col("p")).alias("entropy_bits"), F.abs(2 * F.col("p") - 1).alias("margin"), F.greatest("p", 1 - F.col("p")).alias("top1"))


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS min, avg(l_quantity) AS mean, quantile_cont(l_quantity::DOUBLE, 0.5) AS p50, quantile_cont(l_quantity::DOUBLE, 0.95) AS p95, max(l_quantity) AS max FROM lineitem GROUP BY 1")
def token_percentiles(spark, d):
    return A.percentiles(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


@query("SELECT l_linestatus, sum(i)::BIGINT AS tokens_in, sum(least(c, i))::BIGINT AS cached, sum(o)::BIGINT AS tokens_out, round((sum(i - least(c, i)) * 0.2 + sum(least(c, i)) * 0.1 + sum(o) * 1.25) / 1e6, 6) AS usd FROM (SELECT l_linestatus, (l_quantity * 100)::BIGINT AS i, (l_discount * 40000)::BIGINT AS c, (l_tax * 1000)::BIGINT AS o FROM lineitem) GROUP BY 1")
def usage_cost(spark, d):
    n = lambda c: F.rint(c).cast("long")
    rows = table(spark, d, "lineitem").select("l_linestatus", n(F.col("l_quantity") * 100).alias("i"), n(F.col("l_discount") * 40000).alias("c"), n(F.col("l_tax") * 1000).alias("o"))
    sums = rows.groupBy("l_linestatus").agg(F.sum("i").alias("tokens_in"), F.sum(F.least("c", "i")).alias("cached"), F.sum("o").alias("tokens_out"))
    return sums.withColumn("usd", F.round(numbers.list_cost(F.col("tokens_in"), F.col("tokens_out"), C.PRICES["small"], F.col("cached")), 6))


@query("SELECT count(*) AS n_golden, round(sum(t) / 1e6 * 0.75, 9) AS golden_usd, round(sum(t) / 1e6 * 0.75 * 37746 / count(*), 6) AS production_usd, bool_and(n_chars IS NOT NULL) AS every_row_counted FROM (SELECT ceil(strlen(text) / 3.0) + 32 AS t, n_chars FROM documents JOIN labels USING (doc_id))")
def cost_ladder(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(numbers.estimated_tokens(F.col("text")).alias("t"), "n_chars")
    golden = F.sum("t") / 1e6 * 0.75
    return rows.agg(F.count("*").alias("n_golden"), F.round(golden, 9).alias("golden_usd"), F.round(golden * 37746 / F.count("*"), 6).alias("production_usd"), F.bool_and(F.col("n_chars").isNotNull()).alias("every_row_counted"))


@query("SELECT user_id % 9 AS cell, count(*) AS n, avg(v) AS mean, min(v) AS low, max(v) AS high, (max(v) - min(v)) / 2 AS half_range FROM (SELECT user_id, max(value) AS v FROM events GROUP BY 1) GROUP BY 1 HAVING count(*) >= 2")
def repeat_aggregate(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("v"))
    return A.repeats(runs.withColumn("cell", F.col("user_id") % 9), "v", "cell")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def consensus_or_null(spark, d):
    return A.consensus(table(spark, d, "orders"), "o_orderstatus", "o_custkey")


# sampling


@query()
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return sampling.quota_sample(docs, "lang", "n_chars", "doc_id", {"en": 24, "fr": 12, "de": 12, "es": 8}, "42")


@query("WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, sha256('parent:' || doc_id)) - 1 AS place, count(*) OVER () AS n FROM documents), s AS (SELECT DISTINCT round_even(i * (n - 1) / 9.0::DOUBLE, 0)::BIGINT AS place FROM (SELECT unnest(range(10)) AS i), (SELECT count(*) AS n FROM documents)) SELECT doc_id, n_chars FROM r JOIN s USING (place)")
def smoke_select(spark, d):
    return sampling.length_spread(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 10, "parent")


@query("SELECT company, src, row_number() OVER (ORDER BY rn, src <> 'live', company) AS place FROM (SELECT c_custkey AS company, CASE WHEN c_custkey % 2 = 0 THEN 'live' ELSE 'dead' END AS src, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) AS rn FROM customer)")
def source_interleave(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("company"), F.when(F.col("c_custkey") % 2 == 0, "live").otherwise("dead").alias("src"))
    return sampling.interleave(rows, "src", "company", "live").withColumn("place", F.col("place").cast("long"))


# journal and limits


@query(f"WITH {REPLAYED} SELECT company, pass_a_line, completed_line, error_line, error_retriable, n_retries, n_illegal FROM replayed")
def journal_replay(spark, d):
    return J.replay(journal(spark, d))


@query(f"WITH {REPLAYED} SELECT fault, count(*) AS n, min(line_no) AS first_line FROM (SELECT line_no, CASE WHEN company IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) THEN fault ELSE 'unknown company' END AS fault FROM steps WHERE place > 0) WHERE fault IS NOT NULL GROUP BY fault")
def journal_faults(spark, d):
    return J.faults(journal(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("company")).filter("company % 10 <> 3"))


@query(f"""
WITH {REPLAYED}, m AS (SELECT r.* FROM customer LEFT JOIN replayed r ON company = c_custkey)
SELECT count(*) AS total, count(*) FILTER (pass_a_line IS NULL) AS untouched, count(*) FILTER (pass_a_line IS NOT NULL AND completed_line IS NULL) AS pass_a_only, count(completed_line) AS complete,
  count(*) FILTER (completed_line IS NULL AND error_line IS NOT NULL AND error_retriable) AS retryable, count(*) FILTER (completed_line IS NULL AND error_line IS NOT NULL AND NOT error_retriable) AS terminal FROM m
""")  # fmt: skip
def run_status(spark, d):
    return J.run_status(J.replay(journal(spark, d)), table(spark, d, "customer").select(F.col("c_custkey").alias("company")))


@query("SELECT coalesce(event_type, '*') AS stage, coalesce(reason, '*') AS reason, count(*) AS n FROM (SELECT event_type, CASE WHEN value < 20 THEN 'low' ELSE 'high' END AS reason FROM events) GROUP BY CUBE (event_type, reason)")
def nested_failure_sets(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("value") < 20, "low").otherwise("high").alias("why"))
    return A.failure_sets(rows, "event_type", "why")


@query("SELECT CASE WHEN event_type <> 'error' THEN 'ok' WHEN k >= 50 THEN 'rate_limited' WHEN k >= 20 THEN 'network_error' ELSE 'unknown' END AS reason, count(*) AS n, sum((event_type = 'error' AND k >= 20)::INT)::BIGINT AS retryable FROM (SELECT event_type, (props->>'$.k')::INT AS k FROM events) GROUP BY 1")
def failure_breakdown(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    reason = F.when(F.col("event_type") != "error", "ok").when(k >= 50, "rate_limited").when(k >= 20, "network_error").otherwise("unknown")
    rows = table(spark, d, "events").select(reason.alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.col("reason").isin("rate_limited", "network_error").cast("long")).alias("retryable"))


@query("SELECT user_id, count(*) AS n, round(coalesce(sum(d) FILTER (d > 0 AND d <= 7200), 0), 3) AS active_s FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS d FROM events) GROUP BY 1")
def active_time(spark, d):
    return A.active_seconds(table(spark, d, "events"), "ts", 7200, "user_id").withColumn("active_s", F.round("active_s", 3))


@query("SELECT event_id, count(*) OVER w / 40.0::DOUBLE AS rpm_share, round(sum(value) OVER w / 900.0, 6) AS tpm_share FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)")
def window_utilisation(spark, d):
    u = limits.utilisation(table(spark, d, "events"), "ts", "value", 40, 900, "event_type", seconds=3600)
    return u.select("event_id", "rpm_share", F.round("tpm_share", 6).alias("tpm_share"))


@query()
def concurrency_replay(spark, d):
    outcome = F.when(F.col("event_type") != "error", "ok").when(F.col("event_id") % 4 == 0, "rate_limited").otherwise("transient")
    return limits.adaptive_concurrency(table(spark, d, "events").select("user_id", "event_id", outcome.alias("outcome")), "user_id", "event_id", "outcome")


@query("SELECT event_id, user_id FROM (SELECT *, max(over::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM (SELECT event_id, user_id, coalesce(sum(value) OVER w, 0) + coalesce(avg(value) OVER w, 0) > 500 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE stop = 0")
def budget_gate(spark, d):
    return limits.budget_stop(table(spark, d, "events").select("event_id", "user_id", "value"), "event_id", "value", 500.0, "user_id").select("event_id", "user_id")


@query("""
WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
e AS (SELECT user_id, place, value AS mean FROM v WHERE place = 1 UNION ALL SELECT user_id, v.place, mean + 0.2::DOUBLE * (value - mean) FROM e JOIN v USING (user_id) WHERE v.place = e.place + 1)
SELECT user_id, max(place) AS n, round(arg_max(mean, place), 9) AS ewma FROM e GROUP BY 1
""")  # fmt: skip
def latency_ewma(spark, d):
    return limits.smoothed(table(spark, d, "events"), "user_id", "event_id", "value").withColumn("ewma", F.round("ewma", 9))


@query("SELECT c_custkey::VARCHAR AS org_uuid, c_name AS name, '' AS short_description, '' AS \"Long description\", c_mktsegment AS category_list, '' AS category_groups_list, '' AS founded_date, '' AS employee_count, '' AS total_funding_usd, '' AS homepage_url, '' AS website_alive FROM customer")
def contract_projection(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("org_uuid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category_list"), F.lit(1).alias("not_in_contract"))
    return sinks.contract(rows, C.MASTER_COLUMNS)
