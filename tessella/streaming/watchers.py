"""Stateful change detection by subject, for streams and for tables.

A watcher maps a poll (subject, ts, state, ok) to a change type against the last
state of its subject. The stream keeps one state a subject; the batch form is a
window over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Watcher:
    """Names of a watcher's change types, and how often it polls."""

    kind: str
    initial: str
    changed: str
    same: str
    failed: str
    interval_seconds: int


#: Fixed change types and intervals of the watchers.
WATCHERS = {w.kind: w for w in (
    Watcher("api", "no_change", "changed", "no_change", "poll_failed", 120),
    Watcher("cve", "new_advisory", "new_advisory", "feed_polled", "feed_failed", 1800),
    Watcher("hidden_service", "status_changed", "status_changed", "no_change", "poll_failed", 600),
    Watcher("organization", "initial", "updated", "no_change", "dns_failed", 3600),
    Watcher("package", "initial", "version_changed", "no_change", "poll_failed", 3600),
    Watcher("repository", "reachable", "reachable", "no_change", "unreachable", 300),
    Watcher("threat", "system_alert", "high_severity_cve", "no_change", "multiple_unreachable", 600),
)}
OUTPUT = "subject string, ts timestamp, change string, previous string, current string"
STATE = "state string"


def _kind(w: Watcher, known: bool, previous: str | None, state: str | None, ok: bool) -> str:
    if not ok:
        return w.failed
    if not known:
        return w.initial
    return w.same if previous == state else w.changed


def watch(polls: DataFrame, watcher: Watcher) -> DataFrame:
    """Changes of a stream of polls (subject, ts, state, ok), with one state a subject."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        known = state.exists
        last = state.get[0] if known else None
        out = []
        for r in rows.itertuples(index=False):
            out.append((key[0], r.ts, _kind(watcher, known, last, r.state, bool(r.ok)), last, r.state))
            if r.ok:
                known, last = True, r.state
        if known:
            state.update((last,))
        yield pd.DataFrame(out, columns=["subject", "ts", "change", "previous", "current"])

    return polls.groupBy("subject").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def watched(polls: DataFrame, watcher: Watcher, order: list[str] | None = None) -> DataFrame:
    """The same over a table: the last good state of a subject is looked up by a window."""
    w = Window.partitionBy("subject").orderBy(*(order or ["ts"])).rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("ok"), F.struct(F.col("state").alias("s")))
    last = F.last(good, ignorenulls=True).over(w)
    rows = polls.withColumn("_last", last)
    previous = F.col("_last.s")
    change = F.when(~F.col("ok"), watcher.failed).when(F.col("_last").isNull(), watcher.initial).when(F.col("state").eqNullSafe(previous), watcher.same).otherwise(watcher.changed)
    return rows.withColumn("change", change).withColumn("previous", previous).drop("_last")


def advisories(polls: DataFrame, order: list[str]) -> DataFrame:
    """Polls of a feed (subject, ids array, ok, and the order's columns) with ``change`` and ``fresh``, the ids that no earlier poll of any feed had.

    The known ids are a set: an id that comes again, whatever came between, is
    not new. Of polls with the same place in the order, the one whose feed sorts
    first has the id. Null ids are left out; a failed poll has no ids.
    """
    keys = [*order, "subject"]
    rows = polls.withColumn("_at", F.struct(*keys))
    each = rows.where("ok").select("_at", F.explode(F.array_distinct("ids")).alias("id")).where("id is not null")
    firsts = each.groupBy("id").agg(F.min("_at").alias("_first"))
    fresh = firsts.groupBy("_first").agg(F.array_sort(F.collect_list("id")).alias("_fresh"))
    found = rows.join(fresh, F.col("_at") == F.col("_first"), "left").withColumn("fresh", F.when(F.col("ok"), F.coalesce("_fresh", F.array().cast("array<string>"))))
    w = WATCHERS["cve"]
    change = F.when(~F.col("ok"), w.failed).when(F.size("fresh") > 0, w.changed).otherwise(w.same)
    return found.withColumn("change", change).select(*polls.columns, "change", F.coalesce("fresh", F.array().cast("array<string>")).alias("fresh"))


def watch_advisories(polls: DataFrame) -> DataFrame:
    """The same for a stream of polls (subject, ts, ids, ok), with a set of known ids for each feed: (subject, ts, change, fresh)."""
    w = WATCHERS["cve"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        out = []
        for r in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            fresh = sorted({i for i in r.ids if i is not None} - known) if r.ok else []
            known.update(fresh)
            out.append((key[0], r.ts, w.failed if not r.ok else w.changed if fresh else w.same, fresh))
        state.update((sorted(known),))
        yield pd.DataFrame(out, columns=["subject", "ts", "change", "fresh"])

    return polls.groupBy("subject").applyInPandasWithState(step, "subject string, ts timestamp, change string, fresh array<string>", "known array<string>", "append", GroupStateTimeout.NoTimeout)


def landscape(entities: DataFrame, relationships: DataFrame, tracked: DataFrame, at: DataFrame) -> DataFrame:
    """(at, entity_events, relationship_events, tracked, change): the counts up to each poll, against those of the poll before. Rows of the first three have ``ts``, of the last ``at``, one a poll."""

    def upto(rows: DataFrame, name: str) -> DataFrame:
        # Events are counted by the poll that first sees them, then summed over the polls, which are few.
        counts = rows.where("ts is not null").groupBy(F.col("ts").alias("t")).agg(F.count("*").alias("n"))
        polls = at.select("at").distinct()
        near = polls.agg(F.array_sort(F.collect_list("at")).alias("polls"))
        seen = counts.join(F.broadcast(near)).select("n", F.expr("filter(polls, p -> p >= t)[0]").alias("at")).where("at is not null").groupBy("at").agg(F.sum("n").alias("n"))
        total = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("at"))
        return polls.join(seen, "at", "left").select("at", total.cast("long").alias(name))

    counts = upto(entities, "entity_events").join(upto(relationships, "relationship_events"), "at").join(upto(tracked, "tracked"), "at")
    state = F.struct("entity_events", "relationship_events", "tracked")
    before = F.lag(state).over(Window.orderBy("at"))
    w = WATCHERS["organization"]
    return counts.withColumn("_before", before).withColumn("change", F.when(F.col("_before").isNull(), w.initial).when(F.col("_before") == state, w.same).otherwise(w.changed)).drop("_before")


def threats(advisories: DataFrame, changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(subject, change, n, severity) of one look at all that was gathered.

    Each advisory (id, severity) that is critical or high is one threat, however
    often it was recorded; its severity is the first of the two in that order.
    Failed polls among the changes (change) and snapshots with raised alerts
    (alerts_raised) add a row each: the number of failures, and the alerts.
    """
    severe = advisories.where(F.col("severity").isin("critical", "high")).groupBy(F.col("id").alias("subject")).agg(F.min("severity").alias("severity"))
    severe = severe.select("subject", F.lit("high_severity_cve").alias("change"), F.lit(1).cast("long").alias("n"), "severity")
    failed = changes.where(F.col("change") == "poll_failed").agg(F.count("*").alias("n")).where("n > 0")
    failed = failed.select(F.lit("service_availability").alias("subject"), F.lit("multiple_unreachable").alias("change"), "n", F.lit("medium").alias("severity"))
    raised = snapshots.where(F.col("alerts_raised") > 0).select(F.lit("system_health").alias("subject"), F.lit("system_alert").alias("change"), F.col("alerts_raised").cast("long").alias("n"), F.lit("medium").alias("severity"))
    return severe.unionByName(failed).unionByName(raised)


def due(watchers: DataFrame, now: Column) -> DataFrame:
    """Watchers (kind, last_poll, interval_seconds) whose interval is over, and those that never polled."""
    return watchers.where(F.col("last_poll").isNull() | (F.timestamp_diff("SECOND", F.col("last_poll"), now) >= F.col("interval_seconds")))


def alerts(changes: DataFrame, most_failed: int = 3) -> DataFrame:
    """(alert, n): subjects whose last poll failed, if there are many, and all failures."""
    failed = changes.where(F.col("change").isin("poll_failed", "feed_failed", "dns_failed", "unreachable"))
    return failed.agg(F.count_distinct("subject").alias("n")).select(F.when(F.col("n") >= most_failed, "multiple_unreachable").otherwise("system_alert").alias("alert"), "n")
