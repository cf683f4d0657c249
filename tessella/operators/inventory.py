"""Inventories over packages, modules, crawls, sessions and agents' events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators import graph
from tessella.sources.checkpoints import cut


def packages(dependencies: DataFrame) -> DataFrame:
    """(id, ecosystem, name) of all packages that dependency rows (ecosystem, package, dependency) name, each once."""
    ends = F.explode(F.array("package", "dependency")).alias("name")
    rows = dependencies.select("ecosystem", ends).where("name <> ''").distinct()
    return rows.select(F.concat_ws("/", "ecosystem", "name").alias("id"), "ecosystem", "name")


def package_edges(dependencies: DataFrame) -> DataFrame:
    """(src, dst, constraint, kind) between package ids; of repeated edges the first by constraint."""
    rows = dependencies.where("package <> ''").select(F.concat_ws("/", "ecosystem", "package").alias("src"), F.concat_ws("/", "ecosystem", "dependency").alias("dst"), "constraint", "kind")
    return rows.groupBy("src", "dst").agg(F.min(F.struct("constraint", "kind")).alias("m")).select("src", "dst", "m.constraint", "m.kind")


def dependents(edges: DataFrame, package: str) -> DataFrame:
    return edges.where(F.col("dst") == package).select(F.col("src").alias("id")).distinct()


def dependencies_of(edges: DataFrame, package: str, depth: int | None = 1) -> DataFrame:
    """(id, level) of what a package needs, within a depth or altogether."""
    return graph.levels(edges, [package], depth, directed=True).where("level > 0").select(F.col("node").alias("id"), "level")


def per_ecosystem(found: DataFrame) -> DataFrame:
    return found.groupBy("ecosystem").agg(F.count("*").alias("n"))


def modules_by_language(modules: DataFrame) -> DataFrame:
    """(language, files, lines) of rows (path, language, line_count)."""
    return modules.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


def sessions_by_state(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("state").agg(F.count("*").alias("n"))


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2, most_links: int = 50) -> DataFrame:
    """(url, depth) that a crawl visits: from the seeds along links (url, target, position), each page once, the first links of each."""
    w = Window.partitionBy("url").orderBy("position")
    taken = cut(links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_links).select("url", "target").distinct())
    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for at in range(1, depth + 1):
        step = taken.join(frontier.select("url"), "url").select(F.col("target").alias("url")).distinct()
        frontier = cut(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(at)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def task_list(tasks: DataFrame) -> DataFrame:
    """Tasks by rising priority, the newest first."""
    return tasks.orderBy("priority", F.desc("created_at"), "id")


def retried(sessions: DataFrame, most: int) -> DataFrame:
    """Failed sessions that may run again, queued with a priority one lower."""
    rows = sessions.where((F.col("state") == "failed") & (F.col("attempts") < most))
    return rows.withColumn("state", F.lit("queued")).withColumn("attempts", F.col("attempts") + 1).withColumn("priority", F.col("priority") + 1)


def provenance(steps: DataFrame) -> DataFrame:
    """(id, steps) of each record's processing steps (id, seq, actor, action) in order."""
    rows = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "actor", "action"))).alias("s"))
    return rows.select("id", F.transform("s", lambda s: F.concat_ws(":", s["actor"], s["action"])).alias("steps"))


def timeline(rows: list[DataFrame], limit: int = 1000) -> DataFrame:
    """Entries (ts, kind, source_id, summary) of several tables in order of time."""
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.orderBy("ts", "source_id").limit(limit)


def health(heartbeats: DataFrame, now: Column, silent_seconds: int) -> DataFrame:
    """(agent, last_seen, state) of agents: healthy, or silent for too long."""
    last = heartbeats.groupBy("agent").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("state", F.when(F.timestamp_diff("SECOND", F.col("last_seen"), now) > silent_seconds, "silent").otherwise("healthy"))


#: Fixed fields of the current state of each aggregate type, for replay.
PROJECTIONS = {
    "Entity": ["kind", "name", "attributes"], "Observation": ["kind", "content_type", "source"], "Artifact": ["kind", "sha256", "storage_path", "byte_count"], "Evidence": ["artifact_id", "kind", "value", "confidence"],
    "Relationship": ["kind", "source_id", "target_id", "properties"], "Knowledge": ["kind", "content", "confidence"], "Finding": ["title", "severity", "confidence", "status"], "Decision": ["kind", "status", "actor", "executed_at"],
    "Service": ["name", "kind", "locator", "status", "version"], "Investigation": ["title", "status", "owner"], "Timeline": ["investigation_id"],
}


def project(events: DataFrame, aggregate_type: str) -> DataFrame:
    """Current state of all aggregates of a type; created, deleted and changing events are told by the type's own names."""
    from tessella.operators import events as E

    first = {"Observation": "Recorded", "Artifact": "Stored", "Evidence": "Extracted", "Relationship": "Established", "Knowledge": "Produced", "Decision": "Made", "Service": "Registered", "Investigation": "Opened", "Timeline": "EntryAdded"}.get(aggregate_type, "Created")
    return E.replay(events.where(F.col("aggregate_type") == aggregate_type), PROJECTIONS[aggregate_type], created=first)
