"""Queries over archive candidates, listings, banks and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.numbers import hashed_unit
from attestry.operators import archive as R
from attestry.operators import joins
from attestry.plans.catalog import query
from attestry.plans.tables import SCORED, scored, table
from attestry.sources import files

_PROBES = """probes AS (SELECT o_orderkey AS company, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'error:timeout' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS has_window,
  CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE strftime(o_orderdate, '%Y%m%d') || '000000' END AS stamp, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS founded, o_totalprice FROM orders)"""


def _probes(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, d, "orders").select(
        k.alias("company"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error:timeout").alias("status"), F.when(k % 2 == 0, "True").otherwise("False").alias("has_window"),
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.date_format(day, "yyyyMMdd"), F.lit("000000"))).alias("stamp"), F.when(k % 7 == 0, "").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("founded"), "o_totalprice",
    )


@query(f"WITH {_PROBES} SELECT company, status = 'ok' AND trim(stamp) <> '' AS resolvable, status = 'ok' AND trim(stamp) <> '' AND has_window = 'True' AS retrievable, founded <> '' AND substr(founded, 1, 7) <= '1998-03' AS existed FROM probes")
def archive_filters(spark, d):
    status, stamp = F.col("status"), F.col("stamp")
    return _probes(spark, d).select("company", R.is_resolvable(status, stamp).alias("resolvable"), R.is_retrievable(status, F.col("has_window"), stamp).alias("retrievable"), R.existed_by(F.col("founded"), "1998-03").alias("existed"))


_CAPTURES = "captures AS (SELECT o_custkey, count(*) AS n_captures, date_diff('day', min(o_orderdate), max(o_orderdate)) AS lifespan, o_custkey % 10 < 6 AS alive FROM orders GROUP BY o_custkey)"


def _captures(spark, d):
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_captures"), F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("lifespan"))
    return grouped.withColumn("alive", F.col("o_custkey") % 10 < 6)


@query(f"WITH {_CAPTURES} SELECT * FROM captures WHERE NOT alive AND n_captures >= 2 ORDER BY n_captures DESC, lifespan DESC, o_custkey LIMIT 40")
def archive_candidates(spark, d):
    return R.ranked_candidates(_captures(spark, d), ~F.col("alive") & (F.col("n_captures") >= 2), 40, "o_custkey", "n_captures", "lifespan")


@query(f"WITH {_CAPTURES} (SELECT *, 'smallest' AS listed FROM captures ORDER BY n_captures, o_custkey LIMIT 6) UNION ALL (SELECT *, 'longest' AS listed FROM captures ORDER BY lifespan DESC, o_custkey LIMIT 3)")
def coverage_examples(spark, d):
    return R.example_rows(_captures(spark, d), ("n_captures", 6), ("lifespan", 3), "o_custkey")


@query("SELECT url_host, n, row_number() OVER (ORDER BY n DESC, url_host) AS place FROM (SELECT split_part(split_part(url, '/', 3), ':', 1) AS url_host, count(*) AS n FROM pages GROUP BY 1)")
def count_listing(spark, d):
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    return R.listing(table(spark, d, "pages").select(host.alias("url_host")), "url_host")


@query(f"WITH {SCORED} SELECT lang, count(*) AS n, avg(correct::INT::DOUBLE) AS accuracy, row_number() OVER (ORDER BY avg(correct::INT::DOUBLE) DESC, lang) AS place FROM scored GROUP BY lang HAVING count(*) >= 5")
def accuracy_leaderboard(spark, d):
    return R.leaderboard(scored(spark, d), "lang", "correct", 5)


@query("SELECT c_custkey AS company, 'live' AS source, 0 AS ordinal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'dead', 1 FROM customer WHERE c_custkey % 3 = 0")
def source_union(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("company"))
    return R.union_sources(("live", rows.filter("company % 3 <> 0")), ("dead", rows.filter("company % 3 = 0")))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def membership(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    return R.members(docs, labels, "doc_id").withColumn("labelled", F.lit(True)).unionByName(R.members(docs, labels, "doc_id", False).withColumn("labelled", F.lit(False)))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def mandatory_lookup(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joins.required(both.select("o_orderkey", "c_name"), "c_name", "customer of an order")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 50000)")
def bank_coverage(spark, d):
    bank = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.missing_from_bank(table(spark, d, "customer"), bank, "c_custkey", F.col("o_totalprice") > 50000)


@query("SELECT c_custkey, c_name AS payload FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'fresh' FROM customer WHERE c_custkey % 2 <> 0")
def bank_upsert(spark, d):
    c = table(spark, d, "customer")
    bank = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("payload"))
    return R.banked(bank, c.select("c_custkey", F.lit("fresh").alias("payload")), "c_custkey")


@query("SELECT c_custkey, coalesce(m, c_acctbal) AS usd FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def refreshed_costs(spark, d):
    fresh = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("usd"))
    return R.refreshed(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("usd")), fresh, "c_custkey", "usd")


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url WHEN page_id % 2 = 0 THEN 'again ' || url ELSE '' END AS body, CASE WHEN page_id % 3 <> 0 THEN 'primary' WHEN page_id % 2 = 0 THEN 'fallback' ELSE 'none' END AS used FROM pages")
def empty_fallback(spark, d):
    pages = table(spark, d, "pages")
    first = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.col("url")).alias("body"))
    return R.first_usable(first, pages.filter("page_id % 2 = 0").select("page_id", F.concat(F.lit("again "), "url").alias("body")), "page_id", "body")


@query("SELECT event_type AS cell, event_id::VARCHAR AS run, value FROM events UNION ALL SELECT event_type, 'mean of ' || count(*), avg(value) FROM events GROUP BY 1 HAVING count(*) >= 2")
def repeat_rows(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("cell"), F.col("event_id").cast("string").alias("run"), "value")
    return R.with_repeats(rows, "cell", "value", "run")


@query("""SELECT doc_id, concat_ws(':', doc_id, 'pass_a', md5(text)) AS request_key, '{"model":"small","reasoning":{"effort":"low"},"input":[{"role":"system","content":[{"type":"input_text","text":"Classify."}]},{"role":"user","content":[{"type":"input_text","text":"' || lang || '"}]}]}' AS request, sha256('[["effort","low"],["model","small"],["prompt","Classify."],["schema","' || md5(source) || '"]]') AS fingerprint FROM documents""")
def requests(spark, d):
    docs = table(spark, d, "documents")
    key = R.idempotency_key(F.col("doc_id").cast("string"), F.lit("pass_a"), F.md5("text"))
    settings = {"schema": F.md5("source"), "model": "small", "effort": "low", "prompt": "Classify."}
    return docs.select("doc_id", key.alias("request_key"), R.request_json("small", "low", F.lit("Classify."), F.col("lang")).alias("request"), R.request_fingerprint(settings).alias("fingerprint"))


@query("SELECT event_id, least(8.0::DOUBLE, 0.5::DOUBLE * pow(2.0::DOUBLE, event_id % 7)) * (0.8::DOUBLE + 0.4::DOUBLE * (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS delay_s FROM events")
def retry_delays(spark, d):
    return table(spark, d, "events").select("event_id", R.retry_delay(F.col("event_id") % 7 + 1, hashed_unit(F.col("event_id"))).alias("delay_s"))


@query("WITH a AS (SELECT event_id, user_id, row_number() OVER w AS attempt FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, least(600.0::DOUBLE, 60.0::DOUBLE * pow(2.0::DOUBLE, attempt - 1)) AS wait_s FROM a), c AS (SELECT *, sum(wait_s) OVER (PARTITION BY user_id ORDER BY event_id) AS waited_s FROM b) SELECT *, waited_s > 1800 AS given_up FROM c")
def outage_replay(spark, d):
    return R.outage_waits(table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id"), "user_id", "event_id")


@query("WITH r AS (SELECT event_type, row_number() OVER w AS done, epoch_us(ts) / 1e6 AS s, min(epoch_us(ts) / 1e6) OVER w AS f, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_type, done, CASE WHEN s > f THEN done * 60.0::DOUBLE / (s - f) END AS per_minute, CASE WHEN s > f THEN (n - done) / (done * 60.0::DOUBLE / (s - f)) END AS minutes_left FROM r WHERE done % 25 = 0 OR done = n")
def job_heartbeats(spark, d):
    return R.heartbeats(table(spark, d, "events"), "event_type", "ts", "event_id", 25)


@query("SELECT event_type, count(*) AS n, sum(value) AS second_usd, sum(CASE WHEN event_id % 2 = 0 THEN 0 ELSE value / 4 END) AS first_usd, sum(value) + sum(CASE WHEN event_id % 2 = 0 THEN 0 ELSE value / 4 END) AS usd FROM events GROUP BY 1")
def combined_cost(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("value") / 4).alias("first"), F.col("value").alias("second"), (F.col("event_id") % 2 == 0).alias("is_banked"))
    return R.cell_cost(rows, "event_type", "first", "second", "is_banked")


@query("SELECT user_id, arg_max(strftime(ts, '%Y-%m-%d'), event_id) FILTER (event_type <> 'error') AS live_date, arg_min(strftime(ts, '%Y-%m-%d'), event_id) AS archive_date FROM events WHERE event_id % 4 <> 0 GROUP BY 1 HAVING bool_or(event_type <> 'error')")
def snapshot_dates(spark, d):
    e = table(spark, d, "events").filter("event_id % 4 <> 0")
    rows = e.select("user_id", "event_id", "event_type", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("fetched"), F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"))
    live = files.snapshot_dates(rows, "user_id", F.col("event_type") != "error", "fetched", "event_id").withColumnRenamed("snapshot_date", "live_date")
    return live.join(files.archive_dates(rows, "user_id", "stamp", "event_id").withColumnRenamed("snapshot_date", "archive_date"), "user_id")


@query("WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' True ' WHEN 1 THEN '' WHEN 2 THEN 'unknown' END AS alive FROM customer), p AS (SELECT o_custkey AS c_custkey, CASE WHEN count(*) > 12 THEN 'true' ELSE 'false' END AS fresh FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN lower(trim(coalesce(alive, ''))) IN ('true', 'false') THEN alive ELSE coalesce(fresh, alive) END AS alive FROM r LEFT JOIN p USING (c_custkey)")
def probed_column(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 4 == 0, " True ").when(k % 4 == 1, "").when(k % 4 == 2, "unknown").alias("alive"))
    probes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.count("*") > 12, "true").otherwise("false").alias("alive"))
    return R.probed(rows, probes, "c_custkey", "alive")


_JOBS = "jobs AS (SELECT c_custkey AS job, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS stage, c_custkey % 20 AS rows_total FROM customer), done AS (SELECT o_custkey AS job, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS stage, o_orderdate AS row_id, o_orderkey % 100 / 8.0::DOUBLE AS usd FROM orders)"


@query(f"WITH {_JOBS}, n AS (SELECT job, count(DISTINCT row_id) AS rows_done FROM done GROUP BY job), s AS (SELECT job, stage, sum(usd) AS spend_usd FROM done GROUP BY job, stage) SELECT job, stage, rows_total, coalesce(rows_done, 0) AS rows_done, coalesce(spend_usd, 0.0::DOUBLE) AS spend_usd, coalesce(rows_done, 0) = rows_total AS complete FROM jobs LEFT JOIN n USING (job) LEFT JOIN s USING (job, stage)")
def job_progress(spark, d):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    jobs = table(spark, d, "customer").select(c.alias("job"), F.when(c % 2 == 0, "a").otherwise("b").alias("stage"), (c % 20).alias("rows_total"))
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.when(o % 3 == 0, "a").otherwise("b").alias("stage"), F.col("o_orderdate").alias("row"), ((o % 100) / F.lit(8.0)).alias("usd"))
    return R.job_progress(jobs, done)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) ORDER BY o_orderkey LIMIT 500")
def first_pending(spark, d):
    done = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return R.first_pending(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey", "o_orderkey", 500).select("o_orderkey", "o_custkey")
