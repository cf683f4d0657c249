"""Temporal graph: intervals, snapshots, as-of state, differences, evolution, forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions import intervals as I


def active_at(rows: DataFrame, at: Column) -> DataFrame:
    """Rows valid at an instant (valid_from, valid_to, the end excluded)."""
    return rows.where(I.contains(F.col("valid_from"), F.col("valid_to"), at))


def as_of(probes: DataFrame, facts: DataFrame, key: str, probe_ts: str, fact_ts: str) -> DataFrame:
    """Every probe row with the latest fact of its key at or before it; columns of the fact are null if there is none.

    Facts and probes of a key are merged by one sort, so a key costs its rows and
    not their pairs. Column names of the two must differ, but for the key.
    """
    own = [c for c in facts.columns if c != key]
    merged = probes.select(key, F.col(probe_ts).alias("_at"), F.lit(1).alias("_of"), F.struct(*probes.columns).alias("_probe"), F.lit(None).cast(facts.select(F.struct(*own)).schema[0].dataType).alias("_fact"))
    merged = merged.unionByName(facts.select(key, F.col(fact_ts).alias("_at"), F.lit(0).alias("_of"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_probe"), F.struct(*own).alias("_fact")))
    w = Window.partitionBy(key).orderBy("_at", "_of").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).where("_of = 1").select("_probe.*", *(F.col(f"_last.{c}").alias(c) for c in own))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], width_seconds: int) -> DataFrame:
    """Pairs of rows (start, end of a; other_start, other_end of b) that overlap and agree in ``on``.

    Intervals are dealt to buckets of a fixed width, and a pair is kept only in
    the bucket where its common part begins. Open ends reach to the last start.
    """
    latest = a.select(F.max("start").alias("x")).union(b.select(F.max("other_start"))).agg(F.max("x")).first()[0]

    def bucket(ts: Column) -> Column:
        return F.floor(F.unix_timestamp(ts.cast("timestamp")) / width_seconds)

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.coalesce(F.col(end), F.lit(latest)), F.col(start))
        return df.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(last))))

    joined = dealt(a, "start", "end").join(dealt(b, "other_start", "other_end"), [*on, "_bucket"])
    both = I.overlaps(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
    first = F.col("_bucket") == F.greatest(bucket(F.col("start")), bucket(F.col("other_start")))
    return joined.where(both & first).drop("_bucket")


def difference(before: DataFrame, after: DataFrame, key: str, attributes: str) -> DataFrame:
    """(key, change, old, new): rows added, removed or modified between two snapshots, by a map column."""
    a, b = before.select(F.col(key).alias("_a"), F.col(attributes).alias("old")), after.select(F.col(key).alias("_b"), F.col(attributes).alias("new"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.array_sort(F.map_entries("old")) != F.array_sort(F.map_entries("new")), "modified")
    return joined.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), "old", "new").where("change is not null")


def attribute_changes(changed: DataFrame, key: str) -> DataFrame:
    """(key, attribute, old_value, new_value) of the modified rows of ``difference``."""
    names = F.array_union(F.map_keys("old"), F.map_keys("new"))
    each = changed.where("change = 'modified'").select(key, "old", "new", F.explode(names).alias("attribute"))
    each = each.select(key, "attribute", F.element_at("old", F.col("attribute")).alias("old_value"), F.element_at("new", F.col("attribute")).alias("new_value"))
    return each.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def evolution(members: DataFrame) -> DataFrame:
    """(snapshot_ts, size, added, removed) of each snapshot against the one before, over rows (snapshot_ts, id)."""
    rows = members.distinct()
    times = rows.select("snapshot_ts").distinct()
    order = Window.orderBy("snapshot_ts")  # over the snapshots, not their members
    steps = times.withColumn("previous", F.lag("snapshot_ts").over(order)).withColumn("next", F.lead("snapshot_ts").over(order))
    here = rows.join(steps, "snapshot_ts")
    before = rows.withColumnsRenamed({"snapshot_ts": "at", "id": "same"}).withColumn("there", F.lit(True))
    added = here.join(before, (here.id == F.col("same")) & (here.previous == F.col("at")), "left").groupBy("snapshot_ts").agg(F.count("*").alias("size"), F.sum(F.when(F.col("there").isNull() & F.col("previous").isNotNull(), 1).otherwise(0)).alias("added"))
    gone = here.where("next is not null").join(before, (here.id == F.col("same")) & (here.next == F.col("at")), "left").groupBy(F.col("next").alias("snapshot_ts")).agg(F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("removed"))
    return added.join(gone, "snapshot_ts", "left").select("snapshot_ts", "size", "added", F.coalesce("removed", F.lit(0)).alias("removed"))


def churn(steps: DataFrame) -> DataFrame:
    """(churn): all additions and removals by the number of snapshots and their mean size, from ``evolution``."""
    total = steps.agg(F.sum(F.col("added") + F.col("removed")).alias("moved"), F.count("*").alias("n"), F.avg("size").alias("mean"))
    return total.select(F.when((F.col("n") > 0) & (F.col("mean") > 0), F.col("moved") / F.col("n") / F.col("mean")).otherwise(0.0).alias("churn"))


def survival(members: DataFrame) -> DataFrame:
    """(survival): the share of the first snapshot's members that are in the last."""
    ends = members.agg(F.min("snapshot_ts").alias("first"), F.max("snapshot_ts").alias("last"))
    rows = members.distinct().join(F.broadcast(ends)).where("snapshot_ts = first or snapshot_ts = last")
    each = rows.groupBy("id").agg(F.max((F.col("snapshot_ts") == F.col("first")).cast("int")).alias("f"), F.max((F.col("snapshot_ts") == F.col("last")).cast("int")).alias("l"))
    return each.agg(F.when(F.sum("f") > 0, F.sum(F.col("f") * F.col("l")) / F.sum("f")).otherwise(0.0).alias("survival"))


def trend(points: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(slope, intercept, r2), all 0 where the points leave them open: fewer than two, or no spread."""
    n, vx, vy = F.count("*"), F.var_pop(x), F.var_pop(y)
    flat = (n < 2) | (vx == 0)
    return points.groupBy(*(by or [])).agg(
        F.when(flat, 0.0).otherwise(F.regr_slope(y, x)).alias("slope"),
        F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        F.when(flat | (vy == 0), 0.0).otherwise(F.regr_r2(y, x)).alias("r2"),
    )


def kind_probabilities(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n, probability) of kinds by their frequency."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(kind, "n", (F.col("n") / F.col("total")).alias("probability"))


def projection(counts: DataFrame, n: str, hours: float) -> DataFrame:
    """Adds projected, the count grown by the share that the horizon has of a year, and direction."""
    value = F.col(n) * (1 + hours / 8760)
    return counts.withColumn("projected", value).withColumn("direction", F.when(value > F.col(n), "increasing").when(value < F.col(n), "decreasing").otherwise("stable"))
