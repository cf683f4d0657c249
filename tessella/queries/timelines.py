"""Temporal, event-store, streaming and memory queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.functions import intervals as I
from tessella.operators import decision, events as E, memory, temporal
from tessella.sources import catalog
from tessella.sources.tables import table
from tessella.streaming import watchers, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
_AT = datetime(1997, 6, 1)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals of some days; those of urgent priority are open."""
    days = F.col("o_custkey") % 30 + 1
    end = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("timestamp_ntz")).otherwise(F.expr("o_orderdate + make_dt_interval(cast(o_custkey % 30 + 1 as int))"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("valid_from"), end.alias("valid_to"), days.alias("days"))


_INTERVALS = "i AS (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate + to_days((o_custkey % 30 + 1)::INT) END AS valid_to FROM orders)"


def temporal_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are valid at an instant."""
    return temporal.active_at(_intervals(spark, sf_dir), F.lit(_AT).cast("timestamp_ntz")).select("o_orderkey")


def temporal_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders whose intervals overlap."""
    rows = _intervals(spark, sf_dir)
    a = rows.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))
    b = rows.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("valid_from").alias("other_start"), F.col("valid_to").alias("other_end"))
    return temporal.overlapping(a, b, ["o_custkey"], 90 * 86400).where("a < b").select("a", "b")


def temporal_interval_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, and the common part with the year 1997, of every order's interval."""
    rows = _intervals(spark, sf_dir)
    year = (F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz"), F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz"))
    s, e = F.col("valid_from"), F.col("valid_to")
    common = I.intersection(s, e, *year)
    return rows.select("o_orderkey", F.coalesce(I.seconds(s, e), F.lit(-1)).alias("seconds"), common["start"].alias("common_start"), common["end"].alias("common_end"), I.before(e, year[0]).alias("is_before"), I.contains_interval(*year, s, e).alias("is_within"))


def temporal_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's last purchase at or before it."""
    rows = table(spark, sf_dir, "events")
    facts = rows.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("bought_at")).agg(F.max("value").alias("price"))
    return temporal.as_of(rows.select("user_id", "event_id", "ts"), facts, "user_id", "ts", "bought_at").select("event_id", "bought_at", "price")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and customers with orders after those of low balance moved to another segment."""
    rows = table(spark, sf_dir, "customer")
    ordering = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    before = rows.where("c_acctbal < 9000").select("c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attributes"))
    moved = F.when(F.col("c_acctbal") < 0, F.lit("MOVED")).otherwise(F.col("c_mktsegment"))
    after = rows.join(ordering, "c_custkey", "left_semi").select("c_custkey", F.create_map(F.lit("segment"), moved, F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attributes"))
    return before, after


def temporal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers added, removed and modified between two snapshots."""
    return temporal.difference(*_snapshots(spark, sf_dir), "c_custkey", "attributes").select("c_custkey", "change")


def temporal_attribute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of customers that changed."""
    return temporal.attribute_changes(temporal.difference(*_snapshots(spark, sf_dir), "c_custkey", "attributes"), "c_custkey")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("date").alias("snapshot_ts"), F.col("user_id").alias("id")).distinct()


def temporal_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each day against the day before."""
    return temporal.evolution(_members(spark, sf_dir)).withColumn("snapshot_ts", F.col("snapshot_ts").cast("string"))


def temporal_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of daily users, and the share of the first day's users on the last."""
    members = _members(spark, sf_dir)
    churn = temporal.churn(temporal.evolution(members)).select(F.lit("churn").alias("measure"), F.round("churn", 9).alias("value"))
    return churn.union(temporal.survival(members).select(F.lit("survival"), F.round("survival", 9)))


def temporal_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression of daily events on the day, by type."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))
    found = temporal.trend(days, "x", "y", ["event_type"])
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


def temporal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types with their probability and their number a month ahead."""
    found = temporal.projection(temporal.kind_probabilities(table(spark, sf_dir, "events"), "event_type"), "n", 720)
    return found.select("event_type", "n", F.round("probability", 9).alias("probability"), F.round("projected", 6).alias("projected"), "direction")


QUERIES |= {f.__name__: f for f in (temporal_active, temporal_overlaps, temporal_interval_measures, temporal_as_of, temporal_diff, temporal_attribute_changes, temporal_evolution, temporal_churn, temporal_trend, temporal_forecast)}
_SNAPSHOTS = "b AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal < 9000), a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'MOVED' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"
_EVOLUTION = """m AS (SELECT DISTINCT ts::DATE AS d, user_id AS id FROM events), t AS (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM m)),
    s AS (SELECT t.d AS snapshot_ts, (SELECT count(*) FROM m WHERE m.d = t.d) AS size,
        CASE WHEN t.p IS NULL THEN 0 ELSE (SELECT count(*) FROM m WHERE m.d = t.d AND id NOT IN (SELECT id FROM m x WHERE x.d = t.p)) END AS added,
        CASE WHEN t.p IS NULL THEN 0 ELSE (SELECT count(*) FROM m WHERE m.d = t.p AND id NOT IN (SELECT id FROM m x WHERE x.d = t.d)) END AS removed FROM t)"""
SQL |= {
    "temporal_active": f"WITH {_INTERVALS} SELECT o_orderkey FROM i WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-06-01')",
    "temporal_overlaps": f"WITH {_INTERVALS} SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM i x JOIN i y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey WHERE (y.valid_to IS NULL OR x.valid_from < y.valid_to) AND (x.valid_to IS NULL OR y.valid_from < x.valid_to)",
    "temporal_interval_measures": f"WITH {_INTERVALS} SELECT o_orderkey, coalesce(date_diff('second', valid_from, valid_to), -1) AS seconds, CASE WHEN o THEN greatest(valid_from, TIMESTAMP '1997-01-01') END AS common_start, CASE WHEN o THEN least(coalesce(valid_to, TIMESTAMP '1998-01-01'), TIMESTAMP '1998-01-01') END AS common_end, coalesce(valid_to <= TIMESTAMP '1997-01-01', false) AS is_before, TIMESTAMP '1997-01-01' <= valid_from AND coalesce(valid_to <= TIMESTAMP '1998-01-01', false) AS is_within FROM (SELECT *, valid_from < TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR TIMESTAMP '1997-01-01' < valid_to) AS o FROM i)",
    "temporal_as_of": "WITH f AS (SELECT user_id, ts AS bought_at, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT event_id, bought_at, price FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.bought_at",
    "temporal_diff": f"WITH {_SNAPSHOTS} SELECT coalesce(a.k, b.k) AS c_custkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s",
    "temporal_attribute_changes": f"WITH {_SNAPSHOTS} SELECT a.k AS c_custkey, 'segment' AS attribute, b.s AS old_value, a.s AS new_value FROM b JOIN a ON a.k = b.k WHERE a.s <> b.s",
    "temporal_evolution": f"WITH {_EVOLUTION} SELECT * REPLACE (snapshot_ts::VARCHAR AS snapshot_ts) FROM s",
    "temporal_churn": f"WITH {_EVOLUTION} SELECT 'churn' AS measure, round(sum(added + removed) / count(*) / avg(size), 9) AS value FROM s UNION ALL SELECT 'survival', round((SELECT count(*) FROM m WHERE d = (SELECT min(d) FROM m) AND id IN (SELECT id FROM m WHERE d = (SELECT max(d) FROM m)))::DOUBLE / (SELECT count(*) FROM m WHERE d = (SELECT min(d) FROM m)), 9)",
    "temporal_trend": "WITH d AS (SELECT event_type, day(ts)::DOUBLE AS x, count(*)::DOUBLE AS y FROM events GROUP BY ALL) SELECT event_type, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, CASE WHEN var_pop(y) = 0 THEN 0 ELSE round(regr_r2(y, x), 6) END AS r2 FROM d GROUP BY 1",
    "temporal_forecast": "SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 9) AS probability, round(count(*) * (1 + 720.0 / 8760), 6) AS projected, 'increasing' AS direction FROM events GROUP BY 1",
}


# ---------------------------------------------------------------- event store


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an event store: a user is an aggregate, its events have versions in their order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Deleted").otherwise("Updated")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("aggregate_id"), F.concat(F.lit("Type"), (F.col("user_id") % 3).cast("string")).alias("aggregate_type"), kind.alias("event_type"), F.row_number().over(w).cast("long").alias("version"), F.col("props").alias("data"), F.col("ts").alias("timestamp"))


_STORE = "s AS (SELECT event_id AS id, user_id::VARCHAR AS aggregate_id, 'Type' || (user_id % 3) AS aggregate_type, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Updated' END AS event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, props AS data, ts AS timestamp FROM events)"


def events_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every aggregate."""
    return E.latest_versions(store(spark, sf_dir))


def events_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by aggregate type."""
    return E.counts(store(spark, sf_dir))


def events_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate's events after a version."""
    return E.by_aggregate(store(spark, sf_dir), "7", 3).select("id", "version", "event_type")


def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after an id."""
    return E.since(store(spark, sf_dir), 500).select("id", "aggregate_id")


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an aggregate type."""
    return E.by_type(store(spark, sf_dir), "Type1").select("id", "timestamp")


def events_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last fortnight that do not follow those before it; updates were lost, so there are some."""
    rows = store(spark, sf_dir)
    cut = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    return E.conflicts(rows.where(F.col("timestamp") < cut), rows.where((F.col("timestamp") >= cut) & (F.col("id") % 11 != 0))).select("id", "version")


def events_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of the aggregates that are not deleted."""
    return E.replay(store(spark, sf_dir), ["k"]).select("aggregate_id", "k", "version", "created_at", "updated_at")


def events_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last view, click and purchase."""
    rows = table(spark, sf_dir, "events")
    fields = {f"last_{t}": F.when(F.col("event_type") == t, F.col("value")) for t in ("view", "click", "purchase")}
    return E.fold_last(rows, "user_id", ["ts", "event_id"], fields)


def events_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against the user's event before."""
    return E.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "change")


def events_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by day."""
    rows = table(spark, sf_dir, "events").withColumn("session", F.date_trunc("day", "ts").cast("date"))
    found = E.episodes(rows, "session", "ts", F.col("event_type"), F.col("user_id"))
    return found.select(F.col("session").cast("string").alias("session"), "started_at", "ended_at", "n_events", F.array_join("actors", ",").alias("actors"), "n_entities", F.round("importance", 6).alias("importance"))


def events_session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as job states and whether they may follow each other."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("failed").alias("state"))
    return E.session_states(rows).select("seq", "valid")


QUERIES |= {f.__name__: f for f in (events_latest_versions, events_counts, events_by_aggregate, events_since, events_by_type, events_conflicts, events_replay, events_fold, events_changes, events_episodes, events_session_states)}
SQL |= {
    "events_latest_versions": f"WITH {_STORE} SELECT aggregate_id, max(version) AS version FROM s GROUP BY 1",
    "events_counts": f"WITH {_STORE} SELECT aggregate_type, count(*) AS n FROM s GROUP BY 1",
    "events_by_aggregate": f"WITH {_STORE} SELECT id, version, event_type FROM s WHERE aggregate_id = '7' AND version > 3",
    "events_since": f"WITH {_STORE} SELECT id, aggregate_id FROM s WHERE id > 500",
    "events_by_type": f"WITH {_STORE} SELECT id, timestamp FROM s WHERE aggregate_type = 'Type1'",
    "events_conflicts": f"WITH {_STORE}, o AS (SELECT aggregate_id, max(version) AS held FROM s WHERE timestamp < TIMESTAMP '2024-01-16' GROUP BY 1), n AS (SELECT *, lag(version) OVER (PARTITION BY aggregate_id ORDER BY version) AS b FROM s WHERE timestamp >= TIMESTAMP '2024-01-16' AND id % 11 <> 0) SELECT id, version FROM n LEFT JOIN o USING (aggregate_id) WHERE version <> coalesce(b, held, 0) + 1",
    "events_replay": f"WITH {_STORE}, l AS (SELECT aggregate_id, coalesce(max(version) FILTER (event_type = 'Created'), 0) AS born, coalesce(max(version) FILTER (event_type = 'Deleted'), -1) AS gone FROM s GROUP BY 1) SELECT aggregate_id, arg_max(data ->> '$.k', version) FILTER (version >= born AND data ->> '$.k' IS NOT NULL) AS k, max(version) AS version, min(timestamp) FILTER (version >= born) AS created_at, max(timestamp) AS updated_at FROM s JOIN l USING (aggregate_id) WHERE gone < born GROUP BY 1",
    "events_fold": "SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (event_type = '{t}') AS last_{t}" for t in ("view", "click", "purchase")) + " FROM events GROUP BY 1",
    "events_changes": "WITH p AS (SELECT event_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN n = 1 THEN 'initial' WHEN event_type = b THEN 'no_change' ELSE 'changed' END AS change FROM p",
    "events_episodes": "SELECT ts::DATE::VARCHAR AS session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actors, count(DISTINCT user_id) AS n_entities, round(least(1.0, 0.1 * count(*)), 6)::DOUBLE AS importance FROM events GROUP BY 1",
    "events_session_states": "WITH s AS (SELECT o_custkey AS t, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'failed' END AS state FROM orders), p AS (SELECT *, lag(state) OVER (PARTITION BY t ORDER BY seq) AS b FROM s) SELECT seq, CASE WHEN b IS NULL THEN state = 'queued' WHEN b = 'queued' THEN state = 'running' WHEN b = 'running' THEN state = 'failed' ELSE state = 'queued' END AS valid FROM p",
}


# ---------------------------------------------------------------- windows and watchers


def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    found = windows.tumbling(windows.timed(table(spark, sf_dir, "events")), "1 hour", ["event_type"])
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of a day every half day."""
    found = windows.sliding(windows.timed(table(spark, sf_dir, "events")), "1 day", "12 hours", [])
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions with gaps of less than two hours."""
    found = windows.sessions(windows.timed(table(spark, sf_dir, "events")), "2 hours", ["user_id"])
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


def watch_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of a user's state; errors are failed polls."""
    polls = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), "ts", F.col("event_type").alias("state"), (F.col("event_type") != "error").alias("ok"))
    return watchers.watched(polls, watchers.WATCHERS["package"], ["ts", "event_id"]).select("event_id", "change", "previous")


def watch_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as polls of the customers' feeds: the parts of an order are the ids of its advisories, and only those never seen are new; urgent orders are failed polls."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") != "1-URGENT").alias("ok"))
    polls = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return watchers.advisories(polls, ["ts", "o_orderkey"]).select("o_orderkey", "change", F.size("fresh").cast("long").alias("n_fresh"))


def watch_organization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of purchases and of errors, and of the users by their first event, at the end of every day and half an hour later."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "user_id")
    days = events.select(F.date_trunc("day", "ts").alias("d")).distinct()
    at = days.select(F.explode(F.array(F.expr("d + interval 1 day"), F.expr("d + interval 1 day"), F.expr("d + interval 1 day 1 microsecond"))).alias("at"))
    found = watchers.landscape(events.where("event_type = 'purchase'"), events.where("event_type = 'error'"), events.groupBy("user_id").agg(F.min("ts").alias("ts")), at)
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


def watch_threat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as advisories by brand, events as changes, and users with many errors as snapshots with alerts."""
    severity = F.when(F.col("p_size") >= 45, "critical").when(F.col("p_size") >= 35, "high").otherwise("low")
    found = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), severity.alias("severity"))
    events = table(spark, sf_dir, "events")
    changes = events.select(F.when(F.col("event_type") == "error", "poll_failed").otherwise("changed").alias("change"))
    snapshots = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("alerts_raised"))
    return watchers.threats(found, changes, snapshots)


QUERIES |= {f.__name__: f for f in (watch_cve, watch_organization, watch_threat)}
SQL |= {
    "watch_cve": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT o_orderkey, o_orderdate AS ts, o_custkey, o_orderpriority <> '1-URGENT' AS ok FROM orders),
        f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY ts, o_orderkey, o_custkey) = 1 AS fresh FROM l JOIN p ON o_orderkey = l_orderkey WHERE ok),
        n AS (SELECT l_orderkey, count(*) FILTER (fresh) AS n FROM f GROUP BY 1)
        SELECT o_orderkey, CASE WHEN NOT ok THEN 'feed_failed' WHEN coalesce(n, 0) > 0 THEN 'new_advisory' ELSE 'feed_polled' END AS change, CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END AS n_fresh FROM p LEFT JOIN n ON l_orderkey = o_orderkey""",
    "watch_organization": """
        WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS d FROM events), a AS (SELECT unnest([d + INTERVAL 1 DAY, d + INTERVAL 1 DAY + INTERVAL 1 MICROSECOND])::TIMESTAMP AS poll FROM d),
        u AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1),
        c AS (SELECT poll, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND ts <= poll) AS entity_events, (SELECT count(*) FROM events WHERE event_type = 'error' AND ts <= poll) AS relationship_events, (SELECT count(*) FROM u WHERE ts <= poll) AS tracked FROM a),
        b AS (SELECT *, lag((entity_events, relationship_events, tracked)) OVER (ORDER BY poll) AS before FROM c)
        SELECT poll AS "at", entity_events, relationship_events, tracked, CASE WHEN before IS NULL THEN 'initial' WHEN before = (entity_events, relationship_events, tracked) THEN 'no_change' ELSE 'updated' END AS change FROM b""",
    "watch_threat": """
        SELECT p_brand AS subject, 'high_severity_cve' AS change, 1 AS n, CASE WHEN max(p_size) >= 45 THEN 'critical' ELSE 'high' END AS severity FROM part WHERE p_size >= 35 GROUP BY 1
        UNION ALL SELECT 'service_availability', 'multiple_unreachable', count(*), 'medium' FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'system_health', 'system_alert', n, 'medium' FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)""",
}
QUERIES |= {f.__name__: f for f in (window_tumbling, window_sliding, window_sessions, watch_package)}
SQL |= {
    "window_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "window_sliding": "WITH w AS (SELECT unnest([date_trunc('day', ts) + (CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END), date_trunc('day', ts) + (CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END) - INTERVAL 12 HOUR]) AS window_start FROM events) SELECT window_start, count(*) AS n FROM w GROUP BY 1",
    "window_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
    "watch_package": "WITH p AS (SELECT event_id, event_type, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events) SELECT event_id, CASE WHEN event_type = 'error' THEN 'poll_failed' WHEN previous IS NULL THEN 'initial' WHEN previous = event_type THEN 'no_change' ELSE 'version_changed' END AS change, previous FROM p",
}


# ---------------------------------------------------------------- memory and stores


def memory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest facts about parts of a brand."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("predicate"), F.col("p_name").alias("object"), (F.col("p_size") / 50).alias("confidence"))
    return memory.facts(rows, subjects=["Brand#11", "Brand#23"], least_confidence=0.3).select("id", F.round("confidence", 6).alias("confidence"))


def memory_long_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders of a year, the newest first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return memory.long_term(rows, created_from=datetime(1996, 1, 1), created_to=datetime(1996, 12, 31), limit=50, offset=20).select("id")


def memory_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order date and the largest key on it."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), "o_orderkey")
    return memory.newest(rows).select("id", "o_orderkey")


def memory_working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most accessed live keys: users by their events near the end of the month."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("accesses"), F.max("ts").alias("accessed_at"))
    return memory.working_set(rows, F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz"), 86400, 40).select("key", "accesses")


def memory_log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each user in the log of events; errors delete."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("deleted"))
    return memory.latest_value(rows, "user_id", "seq", "value", "deleted")


def store_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with keys in a range."""
    return memory.range_scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 2000)


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after those with an order over a price were moved to another segment."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.lit("LARGE").alias("c_mktsegment"))
    return catalog.upsert(rows, new, "c_custkey")


def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest orders."""
    return catalog.listing(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


def store_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Virtual folders of parts: brands below the root."""
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("/parts/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return catalog.folder(paths, "/parts")


def store_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts."""
    return catalog.kinds(table(spark, sf_dir, "part").select(F.col("p_type").alias("kind")))


def decide_what_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in a week, with the verdict's confidence."""
    return decision.what_changed(table(spark, sf_dir, "events"), ts="ts", since=datetime(2024, 1, 8), until=datetime(2024, 1, 15))


QUERIES |= {f.__name__: f for f in (memory_facts, memory_long_term, memory_newest, memory_working_set, memory_log_compaction, store_range_scan, store_upsert, store_listing, store_folder, store_kinds, decide_what_changed)}
SQL |= {
    "memory_facts": "SELECT p_partkey AS id, round(p_size / 50.0, 6)::DOUBLE AS confidence FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') AND p_size / 50.0 >= 0.3 ORDER BY p_size DESC, p_partkey LIMIT 100",
    "memory_long_term": "SELECT o_orderkey AS id FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20",
    "memory_newest": "SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "memory_working_set": "SELECT user_id AS key, count(*) AS accesses FROM events GROUP BY 1 HAVING date_diff('second', max(ts), TIMESTAMP '2024-01-31') <= 86400 ORDER BY accesses DESC, key LIMIT 40",
    "memory_log_compaction": "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'",
    "store_range_scan": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000",
    "store_upsert": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'LARGE' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT DISTINCT o_custkey, 'LARGE' FROM orders WHERE o_totalprice > 200000 AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "store_listing": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "store_folder": "SELECT p_brand AS name, count(*) AS entries FROM part GROUP BY 1",
    "store_kinds": "SELECT DISTINCT p_type AS kind FROM part",
    "decide_what_changed": "WITH c AS (SELECT event_type AS kind, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15' GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM c) SELECT kind, n, total, 0.95::DOUBLE AS confidence, CASE WHEN total > 100 THEN 'high' WHEN total > 10 THEN 'medium' ELSE 'low' END AS severity FROM c, t",
}
