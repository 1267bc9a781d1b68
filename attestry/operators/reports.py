"""Audits and summaries of labelling runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import contracts as C
from attestry.functions.numbers import list_cost
from attestry.functions.text import word_count
from attestry.operators.joins import unfinished
from attestry.operators.ranks import checkpointed
from attestry.operators.scoring import macro_f1


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0).cast("long"))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def taxonomy_breaches(df: DataFrame, native: str, subclass: str, rad: str, rationale: str) -> DataFrame:
    """Rows with their first breach of the taxonomy; a batch is fit if there are none."""
    n, s, r = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (native, subclass, rad))
    breach = (
        F.when(~s.isin(*C.SUBCLASSES), "subclass")
        .when(~r.isin(*C.RADS), "rad")
        .when(~n.isin("0", "1"), "ai_native")
        .when((n == "1") != s.startswith("1"), "family")
        .when((n == "0") != (r == "RAD-NA"), "rad_family")
        .when(_blank(F.col(rationale)), "rationale")
        .when(word_count(F.col(rationale)) > 100, "too_long")
    )
    return df.withColumn("breach", breach).filter("breach IS NOT NULL")


def assembled(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both passes of each key; outside the native family the RAD columns are fixed or blank."""
    both = first.join(second, key)
    native = F.col("ai_native") == 1
    return both.withColumns(
        {
            "rad_score": F.when(native, F.col("rad_score")).otherwise("RAD-NA"),
            "rad_confidence": F.when(native, F.col("rad_confidence").cast("string")).otherwise(""),
            "rad_critique": F.when(native, F.col("rad_critique")).otherwise(""),
        }
    )


def gated_pairs(gold: DataFrame, predictions: DataFrame, key: str, expected: int, partial: bool = False) -> DataFrame:
    """Gold rows with a prediction; fails where they are fewer than expected, unless a part will do."""
    both = gold.join(predictions, key)
    if partial:
        return both
    enough = both.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") < expected, F.raise_error(F.concat(F.lit(f"of {expected} rows only "), F.col("_n").cast("string"), F.lit(" are predicted")))).otherwise(F.lit(True)).alias("_enough"))
    return both.join(F.broadcast(enough), F.col("_enough")).drop("_enough")


def isolating(df: DataFrame, gold: dict[str, str], pred: dict[str, str]) -> DataFrame:
    """Second-pass scores apart from the first's: subclass where the family is right, RAD of native gold rows."""
    family = df.filter(F.col(pred["ai_native"]) == F.col(gold["ai_native"]))
    native = df.filter(F.col(gold["ai_native"]) == "1")

    def one(rows: DataFrame, axis: str, name: str) -> DataFrame:
        hit = F.avg((F.col(gold[axis]) == F.coalesce(F.col(pred[axis]), F.lit("__missing__"))).cast("double"))
        f1 = macro_f1(rows, gold[axis], pred[axis]).select("macro_f1")
        return rows.agg(F.count("*").alias("n"), hit.alias("accuracy")).crossJoin(F.broadcast(f1)).select(F.lit(name).alias("measure"), "n", "accuracy", "macro_f1")

    return one(family, "subclass", "subclass_given_family").unionByName(one(native, "rad", "rad_of_native"))


def calibration_rollup(bins: DataFrame, edge: float = 0.9, n_bins: int = 10) -> DataFrame:
    """Mean confidence over the counts of the bins, and the share of rows in bins from `edge` on."""
    n = F.sum("n")
    high = F.sum(F.when(F.col("bin") / n_bins >= edge, F.col("n")).otherwise(0))
    return bins.agg(n.alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean_confidence")), n).alias("mean_confidence"), F.try_divide(high.cast("double"), n).alias("share_above"))


def mass_gate(df: DataFrame, mass: str, *by: str, floor: float = 0.9, allowed: float = 0.05) -> DataFrame:
    """Pass, fail or pending of each model: the mean at the floor or above, few rows below it."""
    got = df.groupBy(*by).agg(F.count(mass).alias("n"), F.avg(mass).alias("mean"), F.avg((F.col(mass) < floor).cast("double")).alias("below_share"))
    return got.withColumn("verdict", F.when(F.col("n") == 0, "pending").when((F.col("mean") < floor) | (F.col("below_share") > allowed), "fail").otherwise("pass"))


def presence(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Whether every record, some, or none carries a field."""
    n, has = F.count("*"), F.count(column)
    return df.groupBy(*by).agg(n.alias("n"), has.alias("n_present")).withColumn("presence", F.when(F.col("n_present") == F.col("n"), "all").when(F.col("n_present") == 0, "none").otherwise("partial"))


def told_apart(df: DataFrame, label: str, repeat: str) -> DataFrame:
    """Labels that several runs share get their repeat's number, where it has one."""
    shared = F.count("*").over(Window.partitionBy(label)) > 1
    return df.withColumn(label, F.when(shared & F.col(repeat).isNotNull(), F.concat(F.col(label), F.lit(" · r"), F.col(repeat).cast("string"))).otherwise(F.col(label)))


def heatmap(df: DataFrame, row: tuple[str, list[str]], column: tuple[str, list[str]]) -> DataFrame:
    """Counts of both domains as a wide table, empty cells 0."""
    counts = df.filter(F.col(row[0]).isin(*row[1])).groupBy(row[0]).pivot(column[0], column[1]).agg(F.count(F.lit(1)))
    dim = df.sparkSession.createDataFrame([(r,) for r in row[1]], f"{row[0]} string")
    return F.broadcast(dim).join(counts, row[0], "left").na.fill(0, column[1])


def levels(df: DataFrame, column: str) -> DataFrame:
    """Rows of each level, null and blank being levels too."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def crawl_quality(pages: DataFrame, key: str, on_site: Column, text: Column) -> DataFrame:
    """Pages of each crawl on and off its own site, and their characters."""
    got = pages.groupBy(key).agg(F.count("*").alias("pages"), _count(on_site).alias("on_domain_pages"), F.coalesce(F.sum(F.length(text)), F.lit(0).cast("long")).alias("total_raw_chars"))
    return got.withColumn("off_domain_pages", F.col("pages") - F.col("on_domain_pages")).withColumn("on_domain_pct", 100.0 * F.col("on_domain_pages") / F.col("pages"))


def run_counters(df: DataFrame, status: str) -> DataFrame:
    """Rows of each status, most first, then by name."""
    return df.groupBy(status).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(status))


def run_report(planned: DataFrame, done: DataFrame, outcomes: DataFrame, key: str, valid: Column, status: str, credits: str) -> DataFrame:
    """One row on a run: what was attempted, completed, failed, found empty or skipped, and its credits.

    `planned` rows are skipped where `done` has their key or they are not `valid`; an
    outcome that is neither a success nor empty is a failure.
    """
    marked = planned.select(key, F.coalesce(valid, F.lit(False)).alias("_valid")).join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    plans = marked.agg(_count(F.col("_done")).alias("skipped_existing"), _count(F.col("_done").isNull() & ~F.col("_valid")).alias("skipped_invalid"))
    good, empty = F.col(status).isin("success", "success_fallback"), F.col(status).isin("empty_results", "thin")
    sums = outcomes.agg(F.count("*").alias("attempted"), _count(good).alias("completed"), _count(empty).alias("empty_results"), _count(~F.coalesce(good | empty, F.lit(False))).alias("failed"), F.coalesce(F.sum(credits), F.lit(0.0)).alias("credits"))
    return sums.join(F.broadcast(plans), F.lit(True))  # one row each


def resume_tallies(log: DataFrame, key: str, ok: str, retryable: str, status: str) -> DataFrame:
    """One row on a log: successes, empty results, failures, and the keys that need no further call."""
    good, bad = F.col(ok).eqNullSafe(F.lit(True)), F.col(ok).eqNullSafe(F.lit(False))
    ended = (good | F.col(retryable).eqNullSafe(F.lit(False))) & (F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "")
    return log.agg(
        _count(good & (F.col(status) == "success")).alias("successful"),
        _count(good & F.col(status).isin("empty_results", "thin_evidence")).alias("empty"),
        _count(bad).alias("failed"),
        F.countDistinct(F.when(ended, F.col(key))).alias("completed_ids"),
    )


def dashboard(df: DataFrame, subclass: tuple[str, list[str]], level: tuple[str, list[str]], era: tuple[str, list[str]], yes: str, confidence: str, low: int = 2) -> DataFrame:
    """(metric, first, second, value): the counts, rates and quantiles of a table of labels, every value of the fixed domains among them.

    One scan counts the combinations of labels, of which there are few; all else comes
    from those counts.
    """
    names = [subclass[0], level[0], era[0]]
    cells = df.groupBy(*[F.col(c).alias(a) for c, a in zip(names, "sle", strict=True)], F.coalesce(F.col(yes), F.lit(False)).alias("y"), F.col(confidence).cast("double").alias("c")).agg(F.count("*").alias("n"))
    held = checkpointed(cells)
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("double")
    share = lambda a, b: F.when(b > 0, 100 * a / b)
    s, lv, e, y, everything = F.col("s"), F.col("l"), F.col("e"), F.col("y"), F.lit(True)
    listed = [("rows", "", "", of(everything)), ("yes", "", "", of(y)), ("yes_pct", "", "", share(of(y), of(everything))), ("low_confidence", "", "", of(F.col("c") <= low)), ("low_confidence_pct", "", "", share(of(F.col("c") <= low), of(everything)))]
    listed += [("subclass", x, "", of(s == x)) for x in subclass[1]] + [("level", x, "", of(lv == x)) for x in level[1]]
    for x in era[1]:
        listed += [("era", x, "", of(e == x)), ("era_pct", x, "", share(of(e == x), of(everything))), ("yes_pct_by_era", x, "", share(of((e == x) & y), of(e == x)))]
        listed += [("subclass_by_era", x, z, of((e == x) & (s == z))) for z in subclass[1]] + [("level_by_era", x, z, of((e == x) & (lv == z))) for z in level[1]]
    listed += [("heatmap", x, z, of((s == x) & (lv == z))) for x in subclass[1] for z in level[1]]
    one = held.agg(*[v.alias(f"v{i}") for i, (*_, v) in enumerate(listed)])
    counts = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"v{i}").alias("value")) for i, (m, a, b, _) in enumerate(listed)])).alias("r")).select("r.*")

    known = held.filter(F.col("c").isNotNull())
    histogram = known.groupBy("c").agg(F.sum("n").cast("double").alias("value")).select(F.lit("confidence").alias("metric"), F.col("c").cast("int").cast("string").alias("first"), F.lit("").alias("second"), "value")
    both = known.select("s", "c", "n").filter(F.col("s").isin(*subclass[1])).unionByName(known.select(F.lit("").alias("s"), "c", "n"))
    by = both.groupBy("s").agg(F.sum("n").alias("n"), (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("mean"))
    up_to = both.groupBy("s", "c").agg(F.sum("n").alias("m")).withColumn("up_to", F.sum("m").over(Window.partitionBy("s").orderBy("c")))  # one row a confidence
    at = lambda rank: F.min(F.when(F.col("up_to") > rank, F.col("c")))
    place = {name: (F.col("n") - 1) * p for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    ranked = up_to.join(by, "s").groupBy("s", "n", "mean").agg(*[at(g(r)).alias(f"{name}_{end}") for name, r in place.items() for g, end in ((F.floor, "a"), (F.ceil, "b"))])
    between = lambda name: F.col(f"{name}_a") + (place[name] - F.floor(place[name])) * (F.col(f"{name}_b") - F.col(f"{name}_a"))
    values = [("count", F.col("n").cast("double")), ("mean", F.col("mean")), *[(name, between(name)) for name in place]]
    stats = ranked.select("s", F.explode(F.array(*[F.struct(F.lit(k).alias("second"), v.alias("value")) for k, v in values])).alias("r"))
    quantiles = stats.select(F.lit("confidence_by_subclass").alias("metric"), F.col("s").alias("first"), "r.*")
    return counts.unionByName(histogram).unionByName(quantiles)


def cost_range(plan: DataFrame, first: str, if_zero: str, if_one: str, family: str, price: tuple[float, float, float], outputs: tuple[int, int]) -> DataFrame:
    """Cost of a plan under either verdict of the rows whose family is unknown.

    `first`, `if_zero` and `if_one` are input tokens (null: that call is not planned);
    `outputs` the tokens expected back of a first and a second call.
    """
    f = F.col(family)
    zero = F.when(f == 1, F.col(if_one)).otherwise(F.col(if_zero))
    one = F.when(f == 0, F.col(if_zero)).otherwise(F.col(if_one))
    sums = plan.agg(F.count(first).alias("n_first"), F.count(zero).alias("n_second"), _count(f.isNull()).alias("n_unknown"), F.sum(first).alias("first_in"), F.sum(zero).alias("second_in_0"), F.sum(one).alias("second_in_1"))
    out = F.col("n_first") * outputs[0] + F.col("n_second") * outputs[1]
    costs = [list_cost(F.coalesce("first_in", F.lit(0)) + F.coalesce(c, F.lit(0)), out, price) for c in ("second_in_0", "second_in_1")]
    return sums.withColumn("tokens_out", out).withColumn("usd_least", F.least(*costs)).withColumn("usd_most", F.greatest(*costs))


def backfill(log: DataFrame, written: DataFrame, key: str, line: str, ok: Column) -> DataFrame:
    """First success of each key that the log has and the table lacks."""
    missing = unfinished(log.filter(ok), written, key, F.lit(True))
    rest = [c for c in missing.columns if c != key]
    return missing.groupBy(key).agg(F.min_by(F.struct(*rest), line).alias("_row")).select(key, *[f"_row.{c}" for c in rest])


def retry_requests(state: DataFrame, key: str, error: str, retriable: str, stage: str | None = None, only: str | None = None) -> DataFrame:
    """Keys whose active error may be tried again, of one stage if asked."""
    wanted = F.col(error).isNotNull() & F.coalesce(F.col(retriable), F.lit(False))
    if stage is not None and only is not None:
        wanted = wanted & (F.col(stage) == only)
    return state.filter(wanted).select(key, F.col(error).alias("error_line"))


def last_operational(events: DataFrame, line: str, *signs: str) -> DataFrame:
    """The latest event that carries any of the fields."""
    return events.filter(F.coalesce(*[F.col(c).cast("string") for c in signs]).isNotNull()).orderBy(F.desc(line)).limit(1)


def first_of_route(events: DataFrame, route: str, line: str) -> DataFrame:
    """The call that warms each route."""
    return events.groupBy(route).agg(F.min(line).alias("first_line"), F.count("*").alias("calls"))


def first_blocks(runs: DataFrame, model: str, ordinal: str, block: str) -> DataFrame:
    """The first recorded block of each model; runs without one do not count."""
    return runs.filter(F.col(block).isNotNull()).groupBy(model).agg(F.min_by(block, ordinal).alias(block))


def next_number(registry: DataFrame, files: DataFrame, number: str) -> DataFrame:
    """One more than any number in the registry or on disk; 1 if there is none."""
    return registry.select(number).unionByName(files.select(number)).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))
