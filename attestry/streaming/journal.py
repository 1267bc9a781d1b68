"""The labelling journal: an event-sourced state of each company, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestry.operators.folds import Fold, folded

#: company, line_no, kind (pass_a, completed, error, retry), retriable
STATE = "company long, pass_a_line long, completed_line long, error_line long, error_retriable boolean, n_retries long, n_illegal long"


def fold(state: tuple, kind: str, line: int, retriable: bool) -> tuple:
    """One event on a company's state; an event that its state does not allow counts as illegal and changes nothing."""
    a, done, error, can, retries, illegal = state
    if kind == "error":
        return (a, done, line, retriable, retries, illegal) if done is None else (a, done, error, can, retries, illegal + 1)
    if kind == "retry":
        return (a, done, None, None, retries + 1, illegal) if error is not None and can else (a, done, error, can, retries, illegal + 1)
    if kind == "pass_a":
        return (line, done, None, None, retries, illegal) if a is None else (a, done, error, can, retries, illegal + 1)
    if kind == "completed":
        return (a, line, None, None, retries, illegal) if a is not None and done is None else (a, done, error, can, retries, illegal + 1)
    return (a, done, error, can, retries, illegal + 1)


START = (None, None, None, None, 0, 0)


def _folded(state: tuple, pdf: pd.DataFrame) -> tuple:
    for kind, line, retriable in zip(pdf["kind"], pdf["line_no"], pdf["retriable"], strict=True):
        state = fold(state, kind, int(line), bool(retriable))
    return state


def _frame(company: int, state: tuple) -> pd.DataFrame:
    out = pd.DataFrame([(company, *state)], columns=[c.split()[0] for c in STATE.split(", ")])
    return out.astype({"pass_a_line": "Int64", "completed_line": "Int64", "error_line": "Int64", "error_retriable": "boolean"})


#: States of a company: whether its first stage is there, and its last failure.
UNTOUCHED, UNTOUCHED_RETRIABLE, UNTOUCHED_TERMINAL, STAGED, STAGED_RETRIABLE, STAGED_TERMINAL, COMPLETE = STATES = range(7)
#: What is wrong with an event that its company's state does not allow.
FAULTS = ["unknown kind", "first stage twice", "completed before first stage", "completed twice", "failure after completion", "retry without failure", "retry of terminal failure"]
#: For each kind, by state: the next state, or the fault that leaves it.
STEPS = {
    "pass_a": [STAGED, STAGED, STAGED, *["first stage twice"] * 4],
    "completed": [*["completed before first stage"] * 3, COMPLETE, COMPLETE, COMPLETE, "completed twice"],
    "error": [UNTOUCHED_RETRIABLE] * 3 + [STAGED_RETRIABLE] * 3 + ["failure after completion"],
    "terminal": [UNTOUCHED_TERMINAL] * 3 + [STAGED_TERMINAL] * 3 + ["failure after completion"],
    "retry": ["retry without failure", UNTOUCHED, "retry of terminal failure", "retry without failure", STAGED, "retry of terminal failure", "retry without failure"],
    "other": ["unknown kind"] * 7,
}
_KINDS = list(STEPS)
#: Line of a failure that was there before a run of events.
_BEFORE = -1
_STATE = "struct<state:int,pass_line:bigint,done_line:bigint,error_line:bigint,retries:bigint,faults:array<struct<n:bigint,first:bigint>>>"


def _table(value) -> Column:
    return F.array(*[F.lit(value(kind, s)) for kind in _KINDS for s in STATES])


def _begin(state: int) -> Column:
    failed = state in (UNTOUCHED_RETRIABLE, UNTOUCHED_TERMINAL, STAGED_RETRIABLE, STAGED_TERMINAL)
    none = F.lit(None)
    return F.struct(F.lit(state).alias("state"), none.alias("pass_line"), none.alias("done_line"), F.lit(_BEFORE if failed else None).alias("error_line"), F.lit(0).alias("retries"), F.array(*[F.struct(F.lit(0).alias("n"), none.alias("first"))] * len(FAULTS)).alias("faults")).cast(_STATE)


def automaton() -> Fold:
    """The journal's rules as a fold; a function has a state after a run of events for each state before it."""
    step_to = _table(lambda kind, s: x if isinstance(x := STEPS[kind][s], int) else s)
    fault_of = _table(lambda kind, s: FAULTS.index(x) if isinstance(x := STEPS[kind][s], str) else -1)

    def step(s: Column, row: Column) -> Column:
        at = row["symbol"] * len(STATES) + s["state"]
        fault, line = fault_of[at], row["line"]
        done = lambda *kinds: (fault < 0) & row["symbol"].isin(*map(_KINDS.index, kinds))
        counted = F.transform(s["faults"], lambda f, i: F.when(i == fault, F.struct((f["n"] + 1).alias("n"), F.coalesce(f["first"], line).alias("first"))).otherwise(f))
        return F.struct(
            step_to[at].alias("state"), F.when(done("pass_a"), line).otherwise(s["pass_line"]).alias("pass_line"), F.when(done("completed"), line).otherwise(s["done_line"]).alias("done_line"),
            F.when(done("error", "terminal"), line).when(~done("pass_a", "completed", "retry"), s["error_line"]).alias("error_line"),
            (s["retries"] + done("retry").cast("long")).alias("retries"), F.when(fault < 0, s["faults"]).otherwise(counted).alias("faults"),
        ).cast(_STATE)

    def after(s: Column, t: Column) -> Column:
        """`t`, which began at the state of `s`, seen from before `s`."""
        both = F.zip_with(s["faults"], t["faults"], lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), F.coalesce(x["first"], y["first"]).alias("first")))
        return F.struct(
            t["state"].alias("state"), F.coalesce(t["pass_line"], s["pass_line"]).alias("pass_line"), F.coalesce(t["done_line"], s["done_line"]).alias("done_line"),
            F.when(t["error_line"] == _BEFORE, s["error_line"]).otherwise(t["error_line"]).alias("error_line"), (s["retries"] + t["retries"]).alias("retries"), both.alias("faults"),
        ).cast(_STATE)

    return Fold(
        _begin(UNTOUCHED), step, F.array(*[_begin(s) for s in STATES]),
        lambda f, row: F.transform(f, lambda s: step(s, row)), lambda f, g: F.transform(f, lambda s: after(s, g[s["state"]])), lambda f: f[UNTOUCHED],
    )


def _states(events: DataFrame, **sizes: int) -> DataFrame:
    """(company, state) after all events; a failure that cannot be tried again is a kind of its own."""
    kind = F.when((F.col("kind") == "error") & ~F.coalesce(F.col("retriable"), F.lit(False)), "terminal").when(F.col("kind").isin("pass_a", "completed", "error", "retry"), F.col("kind")).otherwise("other")
    symbol = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), kind).cast("int") - 1
    return folded(events.select("company", "line_no", symbol.alias("symbol")), "company", "line_no", ["symbol"], automaton(), **sizes)


def replay(events: DataFrame, **sizes: int) -> DataFrame:
    """State of every company after all its events, in the order of the log."""
    s = F.col("state")
    failed = s["error_line"].isNotNull()
    return _states(events, **sizes).select(
        "company", s["pass_line"].alias("pass_a_line"), s["done_line"].alias("completed_line"), s["error_line"].alias("error_line"),
        F.when(failed, s["state"].isin(UNTOUCHED_RETRIABLE, STAGED_RETRIABLE)).alias("error_retriable"), s["retries"].alias("n_retries"), F.aggregate(s["faults"], F.lit(0).cast("long"), lambda n, f: n + f["n"]).alias("n_illegal"),
    )


def faults(events: DataFrame, manifest: DataFrame, key: str = "company", **sizes: int) -> DataFrame:
    """(fault, n, first_line): how often each rule is broken and where first; events of companies that the manifest lacks break one of their own.

    A strict replay fails at the least first_line.
    """
    known = manifest.select(F.col(key).alias("_known")).distinct()
    own = events.join(known, F.col("company") == F.col("_known"), "left_semi")
    strange = events.join(known, F.col("company") == F.col("_known"), "left_anti").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")).filter("n > 0").select(F.lit("unknown company").alias("fault"), "n", "first_line")
    each = _states(own, **sizes).select(F.posexplode("state.faults").alias("at", "f")).filter("f.n > 0")
    named = each.select(F.array(*[F.lit(f) for f in FAULTS])[F.col("at")].alias("fault"), "f.n", "f.first")
    return named.groupBy("fault").agg(F.sum("n").alias("n"), F.min("first").alias("first_line")).unionByName(strange)


def require_sound(found: DataFrame) -> None:
    """Fails with the first fault, as a strict replay does."""
    worst = found.orderBy("first_line").limit(1).collect()
    if worst:
        raise ValueError(f"line {worst[0].first_line}: {worst[0].fault}")


def replay_stream(events: DataFrame) -> DataFrame:
    """The same state, updated with each micro-batch; output mode update."""
    kept = "pass_a long, done long, error long, can boolean, retries long, illegal long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        rows = pd.concat(list(parts)).sort_values("line_no")
        now = _folded(now, rows)
        state.update(now)
        yield _frame(key[0], now)

    return events.select("company", "line_no", "kind", "retriable").groupBy("company").applyInPandasWithState(step, STATE, kept, "update", GroupStateTimeout.NoTimeout)


def run_status(state: DataFrame, manifest: DataFrame, key: str = "company") -> DataFrame:
    """Untouched, first stage only, complete, retryable and terminal companies of a manifest."""
    both = manifest.select(key).distinct().join(state, key, "left")
    is_ = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    a, done, error = F.col("pass_a_line").isNotNull(), F.col("completed_line").isNotNull(), F.col("error_line").isNotNull()
    return both.agg(F.count("*").alias("total"), is_(~a).alias("untouched"), is_(a & ~done).alias("pass_a_only"), is_(done).alias("complete"), is_(~done & error & F.col("error_retriable")).alias("retryable"), is_(~done & error & ~F.col("error_retriable")).alias("terminal"))


def windowed_activity(events: DataFrame, ts: str, minutes: int, late: str = "1 hour") -> DataFrame:
    """Events by kind and window, for a stream with late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes"), "kind").agg(F.count("*").alias("n"))
