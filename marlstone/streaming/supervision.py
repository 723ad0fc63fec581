"""Supervised runs: events to facts, silence, outcomes (X1 to X10, W11, W12), in batch and as a stream.

Events are rows (run_id, event_id, ts, fact, alive): fact is vivo (a sign), finito, fallito or
chiuso; only signs with ``alive`` put off the end by silence. Clocks: silence as a measure starts
anew at every vivo event, silence as a reason to stop only at those with ``alive``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: seconds of silence after which a run is stopped.
SILENCE = 900
TERMINAL = ("finito", "fallito", "chiuso")


def normalized(raw: Column) -> Column:
    """Struct (fact, type, detail, alive) of a line of JSON. A blank line, or one that isn't
    JSON, still is a sign of life."""
    kind = F.get_json_object(raw, "$.event")
    status = F.get_json_object(raw, "$.result.status")
    parsed = F.try_parse_json(raw)
    fact = F.when(kind == "result", F.when(status == "ok", "finito").otherwise("fallito")).when(kind == "closed", "chiuso").otherwise("vivo")
    type_ = F.when(F.trim(raw) == "", "riga_vuota").when(parsed.isNull(), "riga_non_json").otherwise(F.coalesce(F.get_json_object(raw, "$.step_update.step_type"), kind, F.lit("sconosciuto")))
    return F.struct(F.coalesce(fact, F.lit("vivo")).alias("fact"), type_.alias("type"), F.when(parsed.isNotNull(), raw).alias("detail"), F.lit(True).alias("alive"))


def normalized_session(data: Column, session: str) -> Column:
    """X1 for the second engine: struct (fact, type, state, alive) of an event's data (JSON); null for
    events of other sessions. Whether an idle session has finished is for ``confirmed`` to say, so
    idle is its own fact until then; data that isn't JSON still is a sign of life."""
    at = lambda path: F.get_json_object(data, path)
    kind, own, bad = at("$.type"), at("$.properties.sessionID"), F.try_parse_json(data).isNull()
    state = F.when(kind == "session.status", at("$.properties.status.type")).when(kind == "message.part.updated", at("$.properties.part.type"))
    idle = (kind == "session.idle") | ((kind == "session.status") & (state == "idle"))
    fact = F.when(kind == "session.error", "fallito").when(idle, "idle").otherwise("vivo")
    out = F.struct(F.coalesce(fact, F.lit("vivo")).alias("fact"), F.when(bad, "sse_non_json").otherwise(F.coalesce(kind, F.lit("None"))).alias("type"), state.alias("state"), F.lit(True).alias("alive"))
    return F.when(own.isNull() | (own == "") | (own == session), out)


def closed(events: DataFrame, ended: DataFrame) -> DataFrame:
    """``events`` and, for each stream (run_id, event_id, ts) that ended without a terminal event
    before, the fact chiuso."""
    over = events.where(F.col("fact").isin(*TERMINAL)).select("run_id").distinct()
    return events.unionByName(ended.join(over, "run_id", "left_anti").select("run_id", "event_id", "ts", F.lit("chiuso").alias("fact"), F.lit(True).alias("alive")))


def evicted(models: DataFrame, *, idle: float = 600) -> DataFrame:
    """Loaded models (name, loaded, idle_s, idle_locked_s) that go: idle for ``idle`` seconds, also
    when looked at again under the lock; an idle time is null while nothing was loaded."""
    return models.where(F.col("loaded") & (F.col("idle_s") >= idle) & (F.col("idle_locked_s") >= idle))


def silences(events: DataFrame) -> DataFrame:
    """silence_s: seconds since the last vivo event before, or the run's first event."""
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    before = F.last(F.when(F.col("fact") == "vivo", F.col("ts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.first("ts").over(order)
    return events.withColumn("silence_s", (F.unix_micros("ts") - F.unix_micros(F.coalesce(before, start))) / 1e6)


def outcomes(events: DataFrame, *, silence: float = SILENCE, longest: float | None = None) -> DataFrame:
    """``run_id, outcome, started, ended, n_events, longest_silence_s``.

    A run ends with its first terminal event, or ``silence`` seconds after its last sign of life,
    or ``longest`` after its start, whichever comes first; of equals the cap goes before silence
    and silence before an event, as an event that comes just then comes too late.
    """
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    start = F.min(us).over(Window.partitionBy("run_id"))
    sign = F.coalesce(F.last(F.when(F.col("alive"), us), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), start)
    timed = events.withColumn("_us", us).withColumn("_start", start).withColumn("_due", sign + int(silence * 1e6))
    late = F.when(F.col("_us") >= F.col("_due"), F.col("_due"))
    last_due = F.max(F.when(F.col("alive"), F.col("_us")).otherwise(F.col("_start"))) + int(silence * 1e6)
    terminal = F.col("fact").isin(*TERMINAL)
    ends = timed.groupBy("run_id").agg(
        F.min("_start").alias("_start"),
        F.coalesce(F.min(late), last_due).alias("_silent"),
        F.min(F.when(terminal, F.struct("_us", "event_id", "fact"))).alias("_end"),
    )
    cap = (F.col("_start") + int(longest * 1e6)) if longest is not None else F.lit(None).cast("long")
    end = F.least(cap, F.col("_silent"), F.col("_end._us"))
    outcome = F.when(cap == end, "ucciso_per_durata").when(F.col("_silent") == end, "ucciso_per_silenzio").when(F.col("_end.fact") == "finito", "finito_bene").otherwise("fallito")
    known = ends.select("run_id", outcome.alias("outcome"), "_start", end.alias("_stop"))
    within = silences(events).join(known, "run_id").where(F.unix_micros("ts") <= F.col("_stop"))
    return within.groupBy("run_id", "outcome", F.timestamp_micros("_start").alias("started"), F.timestamp_micros("_stop").alias("ended")).agg(F.count(F.lit(1)).alias("n_events"), F.max("silence_s").alias("longest_silence_s"))


def healthy(outcome: DataFrame, outputs: DataFrame, expected: DataFrame, present: DataFrame) -> DataFrame:
    """A run is healthy if it finished, its output isn't blank, and no expected file is missing.

    outputs: run_id, output; expected and present: run_id, path.
    """
    missing = expected.join(present.select("run_id", "path").distinct(), ["run_id", "path"], "left_anti").groupBy("run_id").agg(F.array_sort(F.collect_set("path")).alias("missing"))
    met = outcome.join(outputs, "run_id", "left").join(missing, "run_id", "left")
    return met.withColumn("missing", F.coalesce("missing", F.expr("cast(array() as array<string>)"))).withColumn("healthy", (F.col("outcome") == "finito_bene") & (F.trim(F.coalesce("output", F.lit(""))) != "") & (F.size("missing") == 0))


def confirmed(idle: DataFrame, messages: DataFrame) -> DataFrame:
    """Idle events that end a run: the first with a completed, non-blank assistant message at or before it.

    idle: run_id, ts; messages: run_id, ts, role, completed, text.
    """
    said = messages.where("role = 'assistant' and completed and trim(coalesce(text, '')) != ''").groupBy("run_id").agg(F.min("ts").alias("_said"))
    return idle.join(said, "run_id").where("ts >= _said").groupBy("run_id").agg(F.min("ts").alias("finished"))


def answer(policy: Column, kind: Column) -> Column:
    """A permission policy's answer: of the kind, else of ``*``, else reject."""
    return F.coalesce(F.element_at(policy, kind), F.element_at(policy, F.lit("*")), F.lit("reject"))


def steps(outcome: Column) -> Column:
    """What is done to stop a run, in order; nothing to one that ended by itself."""
    # The ladder and its waits in seconds.
    return F.when(outcome.startswith("ucciso"), F.array(F.lit("abort 10"), F.lit("SIGTERM 15"), F.lit("SIGKILL 5"))).otherwise(F.expr("cast(array() as array<string>)"))


def wakes(checks: DataFrame, *, least: float = 60) -> DataFrame:
    """Whether a host's slept seconds grew by more than ``least`` since the check before."""
    order = Window.partitionBy("host").orderBy("ts", "slept_s")
    return checks.withColumn("woke", F.coalesce(F.col("slept_s") - F.lag("slept_s").over(order) > least, F.lit(False)))


def reasons_to_stay(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold; sleep if there is none."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def notices(states: DataFrame, *, repeat: float = 86400, tie: str | None = None) -> DataFrame:
    """Health notices: of each host's states (ts, ok) those that are told: a change (not the
    first state), and while not ok a reminder every ``repeat`` seconds since the change. tie: a
    column that orders states of one instant; without it the bad one comes first."""
    at = ["ts", tie or "ok"]
    order = Window.partitionBy("host").orderBy(*at)
    before = F.lag("ok").over(order)
    turned = states.withColumn("_turn", (before.isNull() | (before != F.col("ok"))).cast("int")).withColumn("_first", before.isNull())
    turned = turned.withColumn("_run", F.sum("_turn").over(order))
    since = F.min(F.unix_seconds("ts")).over(Window.partitionBy("host", "_run"))
    slot = F.floor((F.unix_seconds("ts") - since) / repeat)
    timed = turned.withColumn("_slot", slot).withColumn("_before", F.lag("_slot").over(Window.partitionBy("host", "_run").orderBy(*at)))
    kind = F.when(F.col("_first"), None).when((F.col("_turn") == 1) & ~F.col("ok"), "red").when(F.col("_turn") == 1, "green").when(~F.col("ok") & (F.col("_slot") > F.col("_before")), "still red")
    return timed.withColumn("notice", kind).where("notice is not null").select("host", "ts", "ok", "notice")


def outcome_stream(events: DataFrame, *, silence: float = SILENCE, longest: float | None = None, delay: str = "10 minutes") -> DataFrame:
    """The stream twin of ``outcomes``: ``run_id, outcome, n_events`` when a run ends.

    Time is the events' own, with a watermark of ``delay`` (the batch original has processing
    time only). A run's state is a few numbers; a timer ends runs that fall silent.
    """
    limit, cap = int(silence * 1000), None if longest is None else int(longest * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, sign, n, ended = state.get if state.exists else (-1, -1, 0, False)
        outcome = None
        if state.hasTimedOut:
            outcome = None if ended else "ucciso_per_durata" if cap is not None and start + cap <= sign + limit else "ucciso_per_silenzio"
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for ms, fact, alive in zip(rows.ts.astype("datetime64[ms]").astype("int64"), rows.fact, rows.alive, strict=True):
                if ended or outcome:
                    break
                if start < 0:
                    start = sign = ms
                if cap is not None and ms >= start + cap and start + cap <= sign + limit:
                    outcome = "ucciso_per_durata"
                elif ms >= sign + limit:
                    outcome = "ucciso_per_silenzio"
                else:
                    n += 1
                    outcome = {"finito": "finito_bene", "fallito": "fallito", "chiuso": "fallito"}.get(fact)
                    sign = ms if alive and fact == "vivo" else sign
        if outcome:
            ended = True
        if ended and state.hasTimedOut:
            state.remove()
        else:
            # an ended run is remembered until the watermark passes, so that late events don't begin it anew
            state.update((int(start), int(sign), int(n), bool(ended)))
            due = sign + limit if cap is None else min(sign + limit, start + cap)
            state.setTimeoutTimestamp(max(int(due), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run_id": [key[0]], "outcome": [outcome], "n_events": [n]} if outcome else {"run_id": [], "outcome": [], "n_events": []})

    id_type = events.schema["run_id"].dataType.simpleString()
    return (
        events.withWatermark("ts", delay)
        .groupBy("run_id")
        .applyInPandasWithState(run, f"run_id {id_type}, outcome string, n_events long", "start long, sign long, n long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
    )
