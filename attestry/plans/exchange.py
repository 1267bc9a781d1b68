"""Queries over files that a run writes and reads again: tables of text, journals, manifests, publications, and what is told from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestry import contracts as C
from attestry.functions import dates, responses, text
from attestry.operators import reports
from attestry.operators.ranks import checkpoint_folder
from attestry.plans.catalog import query
from attestry.plans.tables import COMPANIES, REPLAYED, companies, journal, table
from attestry.sources import files, manifests, publication, sinks
from attestry.streaming import journal as J


def _folder(spark) -> str:
    """A new place in the folder that all tasks share."""
    return f"{checkpoint_folder(spark)}/exchange/{uuid.uuid4().hex}"


# tables as text


@query("""SELECT doc_id::VARCHAR AS doc_id, ' "' || lang || '",' || chr(10) || coalesce(text, '') || ' ' AS note FROM documents""")
def contract_csv(spark, d):
    """Documents through a contract's CSV and back, their texts with quotes, commas, line ends and white space around them."""
    note = F.concat(F.lit(' "'), "lang", F.lit('",\n'), F.coalesce("text", F.lit("")), F.lit(" "))
    place = _folder(spark)
    sinks.write_csv(table(spark, d, "documents").select("doc_id", "source", note.alias("note")), ["doc_id", "source", "note"], place)
    before = files.file_stamps(spark, f"{place}/*.csv")
    rows = files.csv_contract(spark, place, ["note", "doc_id"], "doc_id").select("doc_id", "note")
    files.require_unchanged(spark, f"{place}/*.csv", before)
    return rows


@query("""
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS at, CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS event_type FROM events
""")  # fmt: skip
def typed_csv(spark, d):
    """Events appended to a CSV in two parts, one without its types; times and numbers that do not parse are null."""
    e, place = F.col("event_id"), _folder(spark)
    stamp = F.when(e % 7 == 0, "2024013").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    rows = table(spark, d, "events").select("event_id", "event_type", stamp.alias("at"), F.when(e % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    columns = ["event_id", "at", "value", "event_type"]
    sinks.append_csv(rows.filter(e % 2 == 0), columns, place)
    sinks.append_csv(rows.filter(e % 2 == 1).drop("event_type"), columns, place)
    read = files.typed(files.csv_strings(spark, place, columns), stamps=["at"], numbers=["value"])
    return read.select(F.col("event_id").cast("long"), F.unix_timestamp("at").alias("at"), "value", "event_type")


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN epoch(date_trunc('second', ts))::BIGINT END AS at FROM events")
def stamp_times(spark, d):
    """14-digit times, some cut short or with letters, read back."""
    shown, way = F.date_format("ts", "yyyyMMddHHmmss"), F.col("event_id") % 4
    said = F.when(way < 2, shown).when(way == 2, F.substring(shown, 1, 13)).otherwise(F.concat(F.lit("x"), shown))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(dates.stamp14(said)).alias("at"))


# lines of JSON


def _log_lines(rows, way):
    """Rows as JSON lines, some cut in the middle and some blank."""
    line = F.to_json(F.struct(*rows.columns))
    return rows.select(F.when(way == 3, F.substring(line, 1, 12)).when(way == 4, "  ").otherwise(line).alias("value"))


@query("""
SELECT count(*) FILTER (ok AND event_type = 'purchase') AS successful, count(*) FILTER (ok AND event_type <> 'purchase') AS empty, count(*) FILTER (NOT ok) AS failed, count(DISTINCT user_id) FILTER (ok OR event_id % 3 = 0) AS completed_ids
FROM (SELECT *, event_type <> 'error' AS ok FROM events WHERE event_id % 10 NOT IN (3, 4))
""")  # fmt: skip
def resume_tallies(spark, d):
    """Counters of a log of fetches, read from lines of which some are damaged."""
    place, e = _folder(spark), F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error").otherwise("empty_results")
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), (e % 3 != 0).alias("retryable"), kind.alias("status"))
    _log_lines(rows, e % 10).write.text(place)
    log = files.json_lenient(spark, place, "user_id long, event_id long, ok boolean, retryable boolean, status string")
    return reports.resume_tallies(log, "user_id", "ok", "retryable", "status")


@query("SELECT event_id, user_id, event_type, value FROM events")
def strict_lines(spark, d):
    """Events through JSON lines that may hold nothing else."""
    place = _folder(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    sinks.append_json(rows, place)
    return files.json_strict(spark, place, "event_id long, user_id long, event_type string, value double", last_may_break=False).drop("line_no")


@query(f"WITH {REPLAYED} SELECT company, pass_a_line, completed_line, error_line, error_retriable, n_retries, n_illegal FROM replayed")
def appended_journal(spark, d):
    """The journal appended to its log in two parts, read as committed lines and replayed."""
    place = _folder(spark)
    events = journal(spark, d).select("company", F.col("line_no").alias("seq"), "kind", "retriable")
    for part in (0, 1):
        sinks.append_json(events.filter(F.col("seq") % 2 == part), place)
    read = files.journal_lines(spark, place, "company long, seq long, kind string, retriable boolean")
    return J.replay(read.select("company", F.col("seq").alias("line_no"), "kind", "retriable"))


# runs and their artefacts


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_custkey, c_name, c_mktsegment FROM customer")
def verified_manifest(spark, d):
    """Customers as a manifest, verified against its header when it is read."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = manifests.write_manifest(rows, "c_custkey", "c_mktsegment", _folder(spark))
    return manifests.load_manifest(spark, path, "c_custkey long, c_name string, c_mktsegment string", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer")
def addressed_table(spark, d):
    """A table under the digest of its rows; a second write of the same rows finds it there."""
    rows, folder = table(spark, d, "customer").select("c_custkey", "c_name"), _folder(spark)
    digest = sinks.rows_digest(rows.withColumn("d", F.sha2(F.to_json(F.struct("*")), 256)), "d", "c_custkey")
    paths = {sinks.write_addressed(rows, digest, folder), sinks.write_addressed(rows.limit(0), digest, folder)}
    return spark.read.schema(rows.schema).parquet(*paths)


@query(f"""
WITH {REPLAYED}, m AS (SELECT c_custkey AS company, completed_line FROM customer LEFT JOIN replayed ON company = c_custkey)
SELECT company, 'in_progress' AS artefact FROM m WHERE completed_line IS NOT NULL UNION ALL SELECT company, 'failures' FROM m WHERE completed_line IS NULL
""")  # fmt: skip
def published_state(spark, d):
    """What a run publishes of its companies, read through the pointer to the version of now."""
    state, folder = J.replay(journal(spark, d)), _folder(spark)
    manifest = table(spark, d, "customer").select(F.col("c_custkey").alias("company"))
    for facts in ({"try": 1}, {"try": 2}):
        publication.publish_state(manifest, state, manifest, "company", folder, facts)
    parts = [publication.published(spark, folder, name, "company long").withColumn("artefact", F.lit(name)) for name in ("in_progress", "failures")]
    return parts[0].unionByName(parts[1])


@query("""
WITH p AS (SELECT c_custkey, c_custkey % 8 <> 0 AS valid, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS done FROM customer),
o AS (SELECT event_type AS status, value FROM events WHERE event_id % 2 = 0)
SELECT (SELECT count(*) FROM p WHERE done) AS skipped_existing, (SELECT count(*) FROM p WHERE NOT done AND NOT valid) AS skipped_invalid, count(*) AS attempted, count(*) FILTER (status = 'purchase') AS completed,
  count(*) FILTER (status IN ('view', 'click')) AS empty_results, count(*) FILTER (status NOT IN ('purchase', 'view', 'click')) AS failed, round(sum(value), 3) AS credits FROM o
""")  # fmt: skip
def crawl_report(spark, d):
    """One row on a crawl of the customers."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("purchase", "success", "view", "empty_results", "click", "thin", "signup", "rate_limited", "error", "error")]), F.col("event_type"))
    outcomes = table(spark, d, "events").filter("event_id % 2 = 0").select(kind.alias("status"), "value")
    done = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    out = reports.run_report(table(spark, d, "customer"), done, outcomes, "c_custkey", F.col("c_custkey") % 8 != 0, "status", "value")
    return out.withColumn("credits", F.round("credits", 3))


_MODELS = ["large-2", "large", "small"]


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'none' END AS effort, CASE WHEN event_id % 3 < 2 THEN (event_id % 3 + 1)::INT END AS repeat,
  CASE event_id % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'large-2' WHEN 2 THEN 'large' ELSE '' END AS model, 'item-' || event_type || '--' || event_id AS request FROM events
""")  # fmt: skip
def run_id_parts(spark, d):
    """Effort, repeat and model from the names of runs, and the names of requests."""
    e = F.col("event_id")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (e % n + 1).cast("int"))
    run = F.concat_ws("_", F.date_format("ts", "yyyy-MM-dd"), pick(5, "small", "large-2", "x-large", "mid", "tiny"), pick(4, "LOW", "medium", "high_none", "lowest"), pick(3, "r1", "r2", "rx"))
    key = F.concat(F.lit(" "), "event_type", F.lit("  "), e.cast("string"))
    return table(spark, d, "events").select("event_id", text.run_effort(run).alias("effort"), text.run_repeat(run).alias("repeat"), text.run_model(run, _MODELS).alias("model"), text.custom_id(key, "item-").alias("request"))


# archive and responses


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, '/web/\d+[a-z_]*/https?:/+(?:www\.)?' || replace(replace(host, '.', '\.'), '-', '\-') || '.*' AS scope, true AS own, page_id % 2 = 0 AS other FROM h
""")  # fmt: skip
def crawl_scope(spark, d):
    """The scope of a crawl of each page's site in the archive: the page's own address is within it, and of two others the one on the site."""
    pages = table(spark, d, "pages")
    scope, own = text.scope_pattern(F.col("url")), text.archive_url(F.col("url"), F.lit("20230314000000"))
    host = text.host_of(F.col("url"))
    other = text.archive_url(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://www."), host, F.lit("/a"))).otherwise(F.concat(F.lit("http://x"), host)), F.lit("20230314000000"))
    return pages.select("page_id", scope.alias("scope"), F.regexp_like(own, scope).alias("own"), F.regexp_like(other, scope).alias("other"))


@query("SELECT conv_id, bool_or(turn % 2 = 1 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS usable FROM conversations GROUP BY 1")
def usable_results(spark, d):
    """Whether any page of a conversation's results has a text; every other one is blank."""
    body = lambda odd: F.struct(F.when(F.col("turn") % 2 == odd, F.col("text")).otherwise(" \n").alias("raw_content"))
    pages = table(spark, d, "conversations").select("conv_id", F.array(body(1), body(2)).alias("results"))
    return pages.select("conv_id", responses.has_usable(F.col("results")).alias("usable")).groupBy("conv_id").agg(F.bool_or("usable").alias("usable"))


# the dashboard

_DASH = f"""
WITH {COMPANIES}, t AS (SELECT subclass, rad, CASE WHEN era = 'GENAI-ERA' THEN era ELSE 'PRE-GENAI' END AS era, ai, confidence FROM companies),
s AS (SELECT unnest({C.SUBCLASSES}) AS s), r AS (SELECT unnest({C.RADS}) AS r), e AS (SELECT unnest({C.ERAS}) AS e),
q AS (SELECT subclass, confidence FROM t WHERE subclass IN (SELECT s FROM s) UNION ALL SELECT '', confidence FROM t),
qs AS (SELECT subclass, count(*)::DOUBLE AS count, avg(confidence) AS mean, quantile_cont(confidence::DOUBLE, 0.25) AS q1, median(confidence::DOUBLE) AS median, quantile_cont(confidence::DOUBLE, 0.75) AS q3 FROM q GROUP BY 1)
SELECT 'rows' AS metric, '' AS first, '' AS second, count(*)::DOUBLE AS value FROM t
UNION ALL SELECT 'yes', '', '', count(*) FILTER (ai) FROM t UNION ALL SELECT 'yes_pct', '', '', 100.0::DOUBLE * count(*) FILTER (ai) / count(*) FROM t
UNION ALL SELECT 'low_confidence', '', '', count(*) FILTER (confidence <= 2) FROM t UNION ALL SELECT 'low_confidence_pct', '', '', 100.0::DOUBLE * count(*) FILTER (confidence <= 2) / count(*) FROM t
UNION ALL SELECT 'subclass', s, '', count(subclass) FROM s LEFT JOIN t ON subclass = s GROUP BY 2
UNION ALL SELECT 'level', r, '', count(rad) FROM r LEFT JOIN t ON rad = r GROUP BY 2
UNION ALL SELECT 'era', e, '', count(era) FROM e LEFT JOIN t ON era = e GROUP BY 2
UNION ALL SELECT 'era_pct', e, '', 100.0::DOUBLE * count(era) / (SELECT count(*) FROM t) FROM e LEFT JOIN t ON era = e GROUP BY 2
UNION ALL SELECT 'yes_pct_by_era', e, '', 100.0::DOUBLE * count(*) FILTER (ai) / nullif(count(era), 0) FROM e LEFT JOIN t ON era = e GROUP BY 2
UNION ALL SELECT 'subclass_by_era', e, s, count(era) FROM e CROSS JOIN s LEFT JOIN t ON era = e AND subclass = s GROUP BY 2, 3
UNION ALL SELECT 'level_by_era', e, r, count(era) FROM e CROSS JOIN r LEFT JOIN t ON era = e AND rad = r GROUP BY 2, 3
UNION ALL SELECT 'heatmap', s, r, count(rad) FROM s CROSS JOIN r LEFT JOIN t ON subclass = s AND rad = r GROUP BY 2, 3
UNION ALL SELECT 'confidence', confidence::VARCHAR, '', count(*) FROM t GROUP BY 2
UNION ALL SELECT 'confidence_by_subclass', subclass, name, value FROM (UNPIVOT qs ON count, mean, q1, median, q3 INTO NAME name VALUE value)
"""


@query(_DASH)
def dashboard_metrics(spark, d):
    """All numbers of the dashboard of labels, long."""
    era = F.when(F.col("era") == "GENAI-ERA", F.col("era")).otherwise("PRE-GENAI")
    return reports.dashboard(companies(spark, d).withColumn("era", era), ("subclass", C.SUBCLASSES), ("rad", C.RADS), ("era", C.ERAS), "ai", "confidence")
