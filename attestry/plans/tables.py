"""How the roles of the evidence platform are played by the driver's tables, in DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.contracts import FUNDING_BUCKETS
from attestry.functions.numbers import bucket_of, hashed_unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis frame: verdicts, covariates and cohort flags of each company."""
    k = F.col("c_custkey")
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("founded"))
    base = table(spark, sf_dir, "customer").join(first, F.col("o_custkey") == k, "left")
    label = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (k % n + 1).cast("int"))
    source = F.when(k % 10 < 6, "live").when(k % 10 < 9, "wayback_dead").otherwise("dead_metadata")
    out = base.select(
        k.alias("company"), label(["0A", "1A", "1B", "0B", "1C", "1D", "0C", "1E", "1F", "1G", "0A"], 11).alias("subclass"), label(["RAD-H", "RAD-M", "RAD-L"], 3).alias("_rad"),
        (k % 5 + 1).cast("int").alias("confidence"), (F.col("c_acctbal") * 20000).alias("funding"), source.alias("source"), (k % 7 == 0).alias("thin"), (k % 3 == 0).alias("website_dead"), (k % 4 != 0).alias("has_evidence"),
        F.col("c_mktsegment").alias("category"), "founded",
    )
    ai = F.col("subclass").startswith("1")
    return out.select(
        "*", ai.alias("ai"), F.when(ai, F.col("_rad")).otherwise("RAD-NA").alias("rad"), bucket_of(F.col("funding"), FUNDING_BUCKETS).alias("funding_bucket"),
        F.when(F.col("founded").isNull(), "unknown").when(F.col("founded") >= F.lit("1998-03-14").cast("timestamp"), "GENAI-ERA").otherwise("PRE-GENAI").alias("era"),
        (F.col("source") != "live").alias("dead"), ((F.col("source") == "live") & F.col("has_evidence")).alias("survivor"), ((F.col("source") == "live") & ~F.col("has_evidence")).alias("excluded"),
        ((F.col("source") != "live") & F.col("website_dead") & ~F.col("thin")).alias("strict"),
    ).drop("_rad")


COMPANIES = """
first AS (SELECT o_custkey, min(o_orderdate) AS founded FROM orders GROUP BY o_custkey),
named AS (
  SELECT c_custkey AS company, (['0A','1A','1B','0B','1C','1D','0C','1E','1F','1G','0A'])[(c_custkey % 11 + 1)::INT] AS subclass,
    (['RAD-H','RAD-M','RAD-L'])[(c_custkey % 3 + 1)::INT] AS _rad, (c_custkey % 5 + 1)::INT AS confidence, c_acctbal * 20000 AS funding,
    CASE WHEN c_custkey % 10 < 6 THEN 'live' WHEN c_custkey % 10 < 9 THEN 'wayback_dead' ELSE 'dead_metadata' END AS source,
    c_custkey % 7 = 0 AS thin, c_custkey % 3 = 0 AS website_dead, c_custkey % 4 <> 0 AS has_evidence, c_mktsegment AS category, founded
  FROM customer LEFT JOIN first ON o_custkey = c_custkey),
companies AS (
  SELECT *, subclass LIKE '1%' AS ai, CASE WHEN subclass LIKE '1%' THEN _rad ELSE 'RAD-NA' END AS rad,
    CASE WHEN funding <= 0 THEN 'unknown' WHEN funding BETWEEN 1 AND 1000000 THEN '<$1M' WHEN funding BETWEEN 1000001 AND 10000000 THEN '$1-10M'
      WHEN funding BETWEEN 10000001 AND 100000000 THEN '$10-100M' WHEN funding >= 100000001 THEN '$100M+' ELSE 'unknown' END AS funding_bucket,
    CASE WHEN founded IS NULL THEN 'unknown' WHEN founded >= TIMESTAMP '1998-03-14' THEN 'GENAI-ERA' ELSE 'PRE-GENAI' END AS era,
    source <> 'live' AS dead, source = 'live' AND has_evidence AS survivor, source = 'live' AND NOT has_evidence AS excluded,
    source <> 'live' AND website_dead AND NOT thin AS strict
  FROM named)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted labels with a confidence: a rule by length against the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    pred = (F.col("n_chars") >= 600).cast("int")
    return both.select("doc_id", "lang", "source", "n_chars", F.col("quality").cast("string").alias("gold"), pred.cast("string").alias("pred"), (F.col("quality") == pred).alias("correct"), hashed_unit(F.col("doc_id")).alias("confidence"))


SCORED = """
scored AS (
  SELECT doc_id, lang, source, n_chars, quality::VARCHAR AS gold, (n_chars >= 600)::INT::VARCHAR AS pred, quality = (n_chars >= 600)::INT AS correct,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS confidence
  FROM documents JOIN labels USING (doc_id))
"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the labelling journal of each user's company."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "pass_a", "click", "retry", "signup", "error", "purchase", "completed", "error", "error")]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("company"), F.col("event_id").alias("line_no"), kind.alias("kind"), (F.col("event_id") % 3 != 0).alias("retriable"), "ts", "value")


#: The journal's events in each company's order, every step of its state with the fault of the event, and the last state.
REPLAYED = """
RECURSIVE logged AS (
  SELECT *, row_number() OVER (PARTITION BY company ORDER BY line_no) AS next_place
  FROM (SELECT user_id AS company, event_id AS line_no, event_id % 3 <> 0 AS retriable, CASE event_type WHEN 'view' THEN 'pass_a' WHEN 'click' THEN 'retry' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS kind FROM events)),
steps AS (
  SELECT DISTINCT company, 0::BIGINT AS place, NULL::BIGINT AS line_no, NULL::VARCHAR AS fault, NULL::BIGINT AS pass_a_line, NULL::BIGINT AS completed_line, NULL::BIGINT AS error_line, NULL::BOOLEAN AS error_retriable, 0::BIGINT AS n_retries, 0::BIGINT AS n_illegal FROM logged
  UNION ALL
  SELECT company, next_place, line, wrong, CASE WHEN wrong IS NULL AND kind = 'pass_a' THEN line ELSE pass_a_line END, CASE WHEN wrong IS NULL AND kind = 'completed' THEN line ELSE completed_line END,
    CASE WHEN wrong IS NOT NULL THEN error_line WHEN kind = 'error' THEN line END, CASE WHEN wrong IS NOT NULL THEN error_retriable WHEN kind = 'error' THEN retriable END,
    n_retries + (wrong IS NULL AND kind = 'retry')::BIGINT, n_illegal + (wrong IS NOT NULL)::BIGINT
  FROM (
    SELECT s.*, l.line_no AS line, l.kind, l.retriable, l.next_place,
      CASE WHEN kind = 'pass_a' AND pass_a_line IS NOT NULL THEN 'first stage twice' WHEN kind = 'completed' AND pass_a_line IS NULL THEN 'completed before first stage'
        WHEN kind = 'completed' AND completed_line IS NOT NULL THEN 'completed twice' WHEN kind = 'error' AND completed_line IS NOT NULL THEN 'failure after completion'
        WHEN kind = 'retry' AND error_line IS NULL THEN 'retry without failure' WHEN kind = 'retry' AND NOT error_retriable THEN 'retry of terminal failure' END AS wrong
    FROM steps s JOIN logged l ON l.company = s.company AND l.next_place = s.place + 1)),
replayed AS (SELECT * FROM steps QUALIFY place = max(place) OVER (PARTITION BY company))
"""
