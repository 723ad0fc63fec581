"""Queries over events: a user's events are a run; an error fails it, a purchase finishes it, all
others are signs of life. Silence of a day stops a run (the original 900 s would stop nearly all)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.catalogue import register
from marlstone.session import table
from marlstone.streaming import supervision

DAY = 86400

EVENTS = """e AS (SELECT user_id AS run_id, event_id, ts, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 'fallito' WHEN 'purchase' THEN 'finito' ELSE 'vivo' END AS fact, event_type <> 'view' AS alive FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    fact = F.when(kind == "error", "fallito").when(kind == "purchase", "finito").otherwise("vivo")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), fact.alias("fact"), (kind != "view").alias("alive"))


@register("silence_gaps", f"""WITH {EVENTS}
SELECT run_id, event_id, (us - coalesce(last_value(CASE WHEN fact = 'vivo' THEN us END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(us) OVER w)) / 1000000.0::DOUBLE AS silence_s
FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)""")
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervision.silences(_events(spark, sf_dir)).select("run_id", "event_id", "silence_s")


def _outcome_sql(longest: int | None) -> str:
    cap = f"start + {longest * 1000000}" if longest else "NULL::BIGINT"
    return f"""WITH {EVENTS},
s AS (SELECT *, min(us) OVER (PARTITION BY run_id) AS start FROM e),
d AS (SELECT *, coalesce(last_value(CASE WHEN alive THEN us END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) + {DAY * 1000000} AS due FROM s),
g AS (SELECT run_id, min(start) AS start, coalesce(min(CASE WHEN us >= due THEN due END), max(CASE WHEN alive THEN us ELSE start END) + {DAY * 1000000}) AS silent,
  min(CASE WHEN fact <> 'vivo' THEN us END) AS term, arg_min(CASE WHEN fact <> 'vivo' THEN fact END, us::HUGEINT * 1000000 + event_id) FILTER (WHERE fact <> 'vivo') AS tfact FROM d GROUP BY run_id),
o AS (SELECT run_id, start, {cap} AS cap, silent, term, tfact, least({cap}, silent, term) AS stop FROM g),
r AS (SELECT *, CASE WHEN cap = stop THEN 'ucciso_per_durata' WHEN silent = stop THEN 'ucciso_per_silenzio' WHEN tfact = 'finito' THEN 'finito_bene' ELSE 'fallito' END AS outcome FROM o)
SELECT r.run_id, outcome, start AS started_us, stop AS ended_us, count(*) AS n_events FROM r JOIN e ON e.run_id = r.run_id AND e.us <= r.stop GROUP BY ALL"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("run_id", "outcome", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events")


@register("run_outcome", _outcome_sql(None))
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(supervision.outcomes(_events(spark, sf_dir), silence=DAY))


@register("run_outcome_capped", _outcome_sql(DAY // 2))
def run_outcome_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(supervision.outcomes(_events(spark, sf_dir), silence=DAY, longest=DAY // 2))


@register("outcome_steps", f"WITH o AS ({_outcome_sql(None)}) SELECT outcome, count(*) AS n, CASE WHEN starts_with(outcome, 'ucciso') THEN 'abort 10,SIGTERM 15,SIGKILL 5' ELSE '' END AS steps FROM o GROUP BY outcome")
def outcome_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = supervision.outcomes(_events(spark, sf_dir), silence=DAY).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return found.select("outcome", "n", F.array_join(supervision.steps(F.col("outcome")), ",").alias("steps"))


@register("event_normalization", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'finito' WHEN 'error' THEN 'fallito' ELSE 'vivo' END AS fact, CASE WHEN event_type IN ('purchase', 'error') THEN 'result' ELSE event_type END AS type FROM events")
def event_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines of an engine's JSON, then read as facts."""
    kind = F.col("event_type")
    line = F.when(kind == "purchase", '{"event":"result","result":{"status":"ok"}}').when(kind == "error", '{"event":"result","result":{"status":"bad"}}').otherwise(F.concat(F.lit('{"event":"step_update","step_update":{"step_type":"'), kind, F.lit('"}}')))
    read = table(spark, sf_dir, "events").select("event_id", supervision.normalized(line).alias("e"))
    return read.select("event_id", "e.fact", "e.type")


@register("health_notices", """WITH s AS (SELECT user_id AS host, ts, event_id, event_type <> 'error' AS ok FROM events),
t AS (SELECT *, lag(ok) OVER w AS before FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)),
r AS (SELECT *, sum((before IS NULL OR before <> ok)::INT) OVER (PARTITION BY host ORDER BY ts, event_id) AS run FROM t),
p AS (SELECT *, floor((epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER (PARTITION BY host, run)) / 86400) AS slot FROM r),
q AS (SELECT *, lag(slot) OVER (PARTITION BY host, run ORDER BY ts, event_id) AS pslot FROM p),
n AS (SELECT host, CASE WHEN before IS NULL THEN NULL WHEN before <> ok AND NOT ok THEN 'red' WHEN before <> ok THEN 'green' WHEN NOT ok AND slot > pslot THEN 'still red' END AS notice FROM q)
SELECT host, notice, count(*) AS n FROM n WHERE notice IS NOT NULL GROUP BY ALL""")
def health_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a host's states: an error is a bad one."""
    states = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return supervision.notices(states, tie="event_id").groupBy("host", "notice").agg(F.count(F.lit(1)).alias("n"))
