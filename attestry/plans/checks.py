"""Queries that check: schemas of JSON texts, cleaners against each other, what a run still lacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import dates, text, validated
from attestry.operators import reports, scoring
from attestry.plans.catalog import query
from attestry.plans.tables import REPLAYED, SCORED, journal, scored, table
from attestry.sources import gates, publication
from attestry.streaming import journal as J
from attestry.streaming import limits

#: Contract of an event's properties.
PROPS = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90}}}


@query("""
WITH t AS (
  SELECT event_id, CASE event_id % 8 WHEN 1 THEN replace(props, '"k"', '"j"') WHEN 2 THEN replace(replace(props, ':', ':"'), '}', '"}') WHEN 3 THEN '[' || props || ']'
    WHEN 4 THEN props || '}' WHEN 5 THEN replace(props, '}', ', "z": null, "b": 1}') WHEN 6 THEN replace(props, '}', '.5}') ELSE props END AS said,
    (props->>'$.k')::INT AS k FROM events)
SELECT event_id, CASE event_id % 8 WHEN 1 THEN '$.k: missing' WHEN 2 THEN '$.k: no integer' WHEN 3 THEN '$: no object' WHEN 4 THEN '$: no JSON' WHEN 5 THEN '$.b: unknown' WHEN 6 THEN '$.k: no integer'
  ELSE CASE WHEN k < 5 THEN '$.k: under 5' WHEN k > 90 THEN '$.k: over 90' END END AS fault,
  CASE WHEN event_id % 8 IN (0, 7) AND k BETWEEN 5 AND 90 THEN k END AS k
FROM t
""")  # fmt: skip
def checked_props(spark, d):
    """Properties of events, some of them damaged in six ways, against their contract."""
    p, way = F.col("props"), F.col("event_id") % 8
    put = lambda a, b: F.replace(p, F.lit(a), F.lit(b))
    said = F.when(way == 1, put('"k"', '"j"')).when(way == 2, F.replace(put(":", ':"'), F.lit("}"), F.lit('"}'))).when(way == 3, F.concat(F.lit("["), p, F.lit("]"))).when(way == 4, F.concat(p, F.lit("}"))).when(way == 5, put("}", ', "z": null, "b": 1}')).when(way == 6, put("}", ".5}")).otherwise(p)
    rows = table(spark, d, "events").select("event_id", said.alias("said"))
    return validated.checked(rows, "said", PROPS, "k int").select("event_id", "fault", F.col("value.k").alias("k"))


@query("SELECT count(*) AS pages, 0::BIGINT AS differing FROM pages")
def archive_parity(spark, d):
    """Every page as its archive shows it, with the archive's lines and links, against the page itself: evidence may not differ."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    chrome = "<p>12 captures</p><p>About this capture</p><p>Timestamps</p><p>The Wayback Machine - https://web.archive.org/web/20230314000000/</p>"
    linked = F.regexp_replace("html", r"(https?://)", "https://web.archive.org/web/20230314000000if_/$1")
    stored = pages.select("page_id", text.archive_url(F.col("url"), F.lit("20230314000000")).alias("url"), F.concat(F.lit(chrome), linked).alias("html"))
    own = pages.select("page_id", F.trim("url").alias("url"), "html")
    live = text.evidence_lines(own, "html").select("page_id", "url", "lines")
    found = text.parity(live, text.archived_evidence(stored, "url", "html"), "page_id", "url", "lines")
    return pages.agg(F.count("*").alias("pages")).join(F.broadcast(found.agg(F.countDistinct("page_id").alias("differing"))), F.lit(True))  # one row each


@query(f"""
WITH {REPLAYED} SELECT c_custkey AS company, CASE WHEN pass_a_line IS NULL THEN 'pass_a' ELSE 'pass_b' END AS stage, CASE WHEN pass_a_line IS NULL THEN 'not_started' ELSE 'pass_a_only' END AS state,
  error_line, error_retriable, CASE WHEN error_line IS NULL THEN 'not_completed' END AS reason
FROM customer LEFT JOIN replayed ON company = c_custkey WHERE completed_line IS NULL
""")  # fmt: skip
def run_failures(spark, d):
    """What a run still lacks, company by company."""
    return publication.failures(table(spark, d, "customer").select(F.col("c_custkey").alias("company")), J.replay(journal(spark, d)), "company")


@query("""
WITH t AS (SELECT event_id, value, count(*) OVER w AS place, coalesce(sum((value * 100)::BIGINT) OVER w, 0) AS spent FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT min(place) AS stop FROM t WHERE spent + CASE WHEN place > 0 THEN spent::DOUBLE / place ELSE 0 END > (SELECT sum((value * 100)::BIGINT) / 3.0::DOUBLE FROM events))
SELECT event_id FROM t, o WHERE stop IS NULL OR place < stop
""")  # fmt: skip
def credit_gate(spark, d):
    """Events that a budget of a third of all their credits lets through, over the whole log."""
    rows = table(spark, d, "events").select("event_id", F.rint(F.col("value") * 100).cast("long").alias("credits"))
    return limits.credit_gate(rows, "event_id", "credits", rows.agg(F.sum("credits") / 3).first()[0]).select("event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_type <> 'view' GROUP BY 1")
def first_blocks(spark, d):
    """Each user's first event that is no view."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    return reports.first_blocks(rows, "user_id", "event_id", "event_type")


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN epoch_us(date_trunc('second', ts)) END AS micros FROM events")
def iso_times(spark, d):
    """Times as UTC, with offsets, without any, and damaged, read back."""
    way, shown = F.col("event_id") % 5, lambda shift: F.date_format(F.col("ts") + F.expr(f"interval {shift} minutes"), "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(way == 0, F.concat(shown(0), F.lit("Z"))).when(way == 1, F.concat(shown(120), F.lit("+02:00"))).when(way == 2, F.concat(shown(-330), F.lit("-0530"))).when(way == 3, shown(0)).otherwise(F.concat(shown(0), F.lit("?")))
    return table(spark, d, "events").select("event_id", F.unix_micros(dates.iso_time(said)).alias("micros"))


_FINISHED = "bool_or(event_type = 'purchase') AS succeeded, arg_max(event_type = 'error', event_id) AS again"


@query(f"SELECT user_id, succeeded FROM (SELECT user_id, {_FINISHED} FROM events WHERE event_id % 3 = 0 GROUP BY 1) WHERE succeeded OR NOT again")
def finished_ids(spark, d):
    """Users whose log needs no further call."""
    log = table(spark, d, "events").filter("event_id % 3 = 0")
    return gates.finished_ids(log, "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("""
WITH s AS (SELECT user_id, arg_min(event_type, event_id) AS kind, arg_max(event_type, event_id) AS kind_now, arg_min(props->>'$.k', event_id) AS k, arg_max(props->>'$.k', event_id) AS k_now FROM events GROUP BY 1)
SELECT user_id, 'kind' AS field, kind AS was, kind_now AS now FROM s WHERE kind <> kind_now UNION ALL SELECT user_id, 'k', k, k_now FROM s WHERE k <> k_now
""")  # fmt: skip
def resume_audit(spark, d):
    """Settings that changed between a user's first and last event."""
    e = table(spark, d, "events")
    settings = F.map_from_arrays(F.array(F.lit("kind"), F.lit("k"), F.lit("noise")), F.array("event_type", F.get_json_object("props", "$.k"), F.col("event_id").cast("string")))
    both = e.groupBy("user_id").agg(F.min_by(settings, "event_id").alias("was"), F.max_by(settings, "event_id").alias("now"))
    return gates.changed_settings(both, "was", "now", ["kind", "k", "absent"], "user_id")


@query(f"""
WITH {SCORED}, p AS (SELECT doc_id, gold = (n_chars >= 600)::INT::VARCHAR AS a, gold = (n_chars >= 300)::INT::VARCHAR AS b FROM scored)
SELECT count(*) AS n, avg(a::INT::DOUBLE) AS run, avg(b::INT::DOUBLE) AS baseline, avg(a::INT::DOUBLE - b::INT::DOUBLE) AS delta, count(*) FILTER (a AND NOT b) AS only_run, count(*) FILTER (b AND NOT a) AS only_baseline FROM p
""")  # fmt: skip
def paired_runs(spark, d):
    """Two runs over the same gold rows: their accuracies, and the rows that only one has right."""
    rows = scored(spark, d)
    run = lambda least: rows.select("doc_id", (F.col("n_chars") >= least).cast("int").cast("string").alias("pred"))
    return scoring.paired_accuracy(scoring.paired(rows.select("doc_id", "gold"), run(600), run(300), "doc_id", "gold", "pred"))
