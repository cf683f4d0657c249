"""Event store: an append-only table of versioned events, its filters, checks and projections.

Events have the columns id, aggregate_id, aggregate_type, event_type, version,
data (JSON) and timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed event types by aggregate type.
EVENT_TYPES = {
    "Entity": ["Created", "Updated", "Deleted"], "Observation": ["Recorded"], "Artifact": ["Stored", "Deleted"], "Evidence": ["Extracted"],
    "Relationship": ["Established", "Deleted"], "Knowledge": ["Produced"], "Finding": ["Created", "Updated"], "Decision": ["Made", "Executed"],
    "Service": ["Registered", "Updated", "Deleted"], "Investigation": ["Opened", "Closed", "Archived"], "Timeline": ["EntryAdded"],
    "Agent": ["Started", "Stopped", "Heartbeat"], "Monitoring": ["ChangeDetected"],
}


class VersionConflict(ValueError):
    """New events do not follow the stored ones without gaps."""


def by_aggregate(events: DataFrame, aggregate_id: str, since_version: int = 0) -> DataFrame:
    return events.where((F.col("aggregate_id") == aggregate_id) & (F.col("version") > since_version)).orderBy("version")


def by_type(events: DataFrame, aggregate_type: str) -> DataFrame:
    return events.where(F.col("aggregate_type") == aggregate_type).orderBy("timestamp", "id")


def since(events: DataFrame, last_id) -> DataFrame:
    return events.where(F.col("id") > F.lit(last_id)).orderBy("id")


def latest_versions(events: DataFrame) -> DataFrame:
    """(aggregate_id, version)."""
    return events.groupBy("aggregate_id").agg(F.max("version").alias("version"))


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("aggregate_type").agg(F.count("*").alias("n"))


def conflicts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New events whose version is not one more than that before them."""
    w = Window.partitionBy("aggregate_id").orderBy("version", "id")
    last = latest_versions(stored).withColumnRenamed("version", "held")
    rows = new.withColumn("before", F.lag("version").over(w)).join(last, "aggregate_id", "left")
    return rows.where(F.col("version") != F.coalesce("before", "held", F.lit(0)) + 1).drop("before", "held")


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both together; raises VersionConflict if the new events leave a gap or repeat a version."""
    bad = conflicts(stored, new).first()
    if bad is not None:
        raise VersionConflict(f"version {bad.version} of {bad.aggregate_id} does not follow the stored ones")
    return stored.unionByName(new)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot with the largest version of each aggregate type."""
    return snapshots.groupBy("aggregate_type").agg(F.max_by(F.struct(*snapshots.columns), "version").alias("s")).select("s.*")


def replay(events: DataFrame, fields: list[str], created: str = "Created", deleted: str = "Deleted") -> DataFrame:
    """Current state of each aggregate: the last value that is not null of each field of the JSON data, folded in version order.

    Deleted aggregates are left out; what came before a later creation is not
    carried over. The fold is an aggregation of the last value by version, which
    combines in part before the shuffle.
    """
    born = F.max(F.when(F.col("event_type") == created, F.col("version")))
    life = events.groupBy("aggregate_id").agg(F.coalesce(born, F.lit(0)).alias("_born"), F.coalesce(F.max(F.when(F.col("event_type") == deleted, F.col("version"))), F.lit(-1)).alias("_gone"))

    def value(name: str) -> Column:
        return F.get_json_object("data", f"$.{name}")

    def last(name: str) -> Column:
        return F.max(F.when((F.col("version") >= F.col("_born")) & value(name).isNotNull(), F.struct("version", value(name).alias("v"))))["v"].alias(name)

    rows = events.join(life, "aggregate_id").where(F.col("_gone") < F.col("_born"))
    first, now = F.min(F.when(F.col("version") >= F.col("_born"), F.col("timestamp"))), F.max("timestamp")
    return rows.groupBy("aggregate_id").agg(*(last(f) for f in fields), F.max("version").alias("version"), first.alias("created_at"), now.alias("updated_at"))


def fold_last(events: DataFrame, key: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """The last value that is not null of each field, by key."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*(F.max(F.when(v.isNotNull(), F.struct(at.alias("at"), v.alias("v"))))["v"].alias(name) for name, v in fields.items()))


def changes(states: DataFrame, subject: str, ts: str, state: str) -> DataFrame:
    """Adds previous and change: initial, no_change or changed, against the poll before of the same subject."""
    w = Window.partitionBy(subject).orderBy(*([ts] if isinstance(ts, str) else ts))
    previous = F.lag(state).over(w)
    first = F.row_number().over(w) == 1
    return states.withColumn("previous", previous).withColumn("change", F.when(first, "initial").when(F.col(state).eqNullSafe(F.col("previous")), "no_change").otherwise("changed"))


def episodes(events: DataFrame, session: str, ts: str, actor: Column, entity: Column) -> DataFrame:
    """(session, started_at, ended_at, events, actors, entities, importance) of each session; importance is a tenth of its events, 1 at most."""
    return events.groupBy(session).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n_events"),
        F.array_sort(F.collect_set(actor)).alias("actors"), F.count_distinct(entity).alias("n_entities"),
    ).withColumn("importance", F.least(F.lit(1.0), 0.1 * F.col("n_events")))


def session_states(transitions: DataFrame) -> DataFrame:
    """Adds valid to rows (task_id, seq, state): whether the state may follow the one before it."""
    allowed = F.create_map(*(x for k, v in {"queued": ["running", "cancelled"], "running": ["succeeded", "failed", "cancelled"], "failed": ["queued"], "succeeded": [], "cancelled": []}.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    before = F.lag("state").over(Window.partitionBy("task_id").orderBy("seq"))
    return transitions.withColumn("before", before).withColumn("valid", F.when(F.col("before").isNull(), F.col("state") == "queued").otherwise(F.array_contains(F.coalesce(F.element_at(allowed, F.col("before")), F.array().cast("array<string>")), F.col("state"))))


def queue_order(tasks: DataFrame) -> DataFrame:
    """Tasks by rising priority, then by sequence."""
    return tasks.orderBy("priority", "seq")
