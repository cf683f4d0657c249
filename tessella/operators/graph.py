"""Graph algorithms over edge tables (src, dst, weight).

Loops run on the driver and hold only counts; every step is a join and an
aggregation whose lineage is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessella.sources.checkpoints import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return edges.unionByName(transpose(edges)).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(swap.get(c, c)).alias(c) for c in edges.columns))


def measures(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(nodes, edges, density, average_degree) of a graph without loops or double edges; density is E / (N (N - 1) / 2)."""
    pairs = edges.where("src <> dst")
    pairs = pairs.select("src", "dst").distinct() if directed else pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    n, e = nodes(edges).agg(F.count("*").alias("nodes")), pairs.agg(F.count("*").alias("edges"))
    row = n.join(e)  # one row each
    return row.select(
        "nodes", "edges",
        F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2)).otherwise(0.0).alias("density"),
        F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0).alias("average_degree"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def levels(edges: DataFrame, start: list, depth: int | None = None, directed: bool = False) -> DataFrame:
    """(node, level): nodes within ``depth`` hops of the start nodes and their distance, start nodes included."""
    spark = edges.sparkSession
    pairs = edges.select("src", "dst").distinct() if directed else both_ways(edges.select("src", "dst"))
    kind = edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(s,) for s in start], f"node {kind}").distinct().withColumn("level", F.lit(0))
    frontier, at = seen, 0
    while depth is None or at < depth:
        at += 1
        step = pairs.join(frontier, pairs.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("level", F.lit(at)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # of checkpoints, so only their number grows
        if not at % 16:
            seen = cut(seen)
    return seen


def within(edges: DataFrame, start: list, depth: int, directed: bool = False) -> DataFrame:
    """(node, level) of other nodes within ``depth`` hops."""
    return levels(edges, start, depth, directed).where("level > 0")


def shortest(edges: DataFrame, start, directed: bool = False, rounds: int = 1000) -> DataFrame:
    """(node, distance, previous) by relaxing edges until nothing changes; weights must not be negative. Ties go to the smaller previous node."""
    spark = edges.sparkSession
    own = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    own = own if directed else both_ways(own)
    own = own.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    kind = edges.schema["src"].dataType.simpleString()
    best = spark.createDataFrame([(start, 0.0, None)], f"node {kind}, distance double, previous {kind}")
    changed = best
    for _ in range(rounds):
        offers = own.join(changed, own.src == changed.node).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("previous"))
        rows = best.withColumn("was", F.col("distance")).unionByName(offers.withColumn("was", F.lit(None).cast("double")))
        merged = rows.groupBy("node").agg(F.min(F.struct("distance", F.col("previous").isNotNull().alias("found"), "previous")).alias("m"), F.max("was").alias("was"))
        merged = cut(merged.select("node", F.col("m.distance").alias("distance"), F.col("m.previous").alias("previous"), "was"))
        changed = merged.where("was is null or distance < was").drop("was")
        best = merged.drop("was")
        if changed.isEmpty():
            return best
    raise RuntimeError(f"distances still change after {rounds} rounds")


def path(found: DataFrame, goal) -> list:
    """The nodes of the shortest path to a goal, from ``shortest``; empty if there is none. Looks up a node at a time."""
    out, at = [], goal
    while at is not None:
        row = found.where(F.col("node") == F.lit(at)).select("previous").first()
        if row is None:
            return []
        out.append(at)
        at = row[0]
    return out[::-1]


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, sinks: bool = True) -> DataFrame:
    """(node, rank) after a number of rounds; ranks of nodes without out-edges are spread over all.

    Without ``sinks`` the nodes are those with out-edges only, and what flows to
    others is lost.
    """
    links = edges.select("src", "dst")
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    own = nodes(edges) if sinks else out.select(F.col("src").alias("node"))
    n = own.count()
    if not n:
        return own.withColumn("rank", F.lit(0.0))
    flows = cut(links.join(out, "src"))
    ranks = cut(own.withColumn("rank", F.lit(1.0 / n)))
    has_out = out.select(F.col("src").alias("node"), "out")
    for _ in range(rounds):
        loose = ranks.join(has_out, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        given = flows.join(ranks, flows.src == ranks.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        rank = (1 - damping) / n + damping * F.col("loose") / n + damping * F.coalesce("given", F.lit(0.0))
        ranks = cut(own.join(given, "node", "left").join(F.broadcast(loose)).select("node", rank.alias("rank")))  # loose is one row
    return ranks


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node reaches over edges either way, by large-star and small-star steps."""
    own = nodes(edges)
    table = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = table.union(table.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "node")
        large = cut(both.join(least, both.a == least.node).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        down = large.join(least, large.a == least.node).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        table = cut(down.union(least.select("node", "m")).toDF("a", "b").distinct())
        now = tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return own.join(table, own.node == table.a, "left").select("node", F.coalesce("b", "node").alias("component"))


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) of a directed graph by colouring: the smallest colour spreads forward, then its node collects who reaches it with that colour."""
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    remaining = cut(nodes(edges))
    done = None
    for _ in range(rounds):
        colours = remaining.withColumn("colour", F.col("node"))
        while True:
            offers = left.join(colours, left.src == colours.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
            merged = cut(colours.join(offers, "node", "left").select("node", F.least("colour", "offer").alias("colour"), F.col("colour").alias("was")))
            colours = merged.drop("was")
            if merged.where("colour <> was").isEmpty():
                break
        # Backward from each colour's own node, within the colour.
        same = cut(left.join(colours.withColumnsRenamed({"node": "src", "colour": "c1"}), "src").join(colours.withColumnsRenamed({"node": "dst", "colour": "c2"}), "dst").where("c1 = c2").select("src", "dst"))
        found = cut(colours.where("node = colour"))
        frontier = found
        while True:
            step = same.join(frontier, same.dst == frontier.node).select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut(step.join(found, "node", "left_anti"))
            if frontier.isEmpty():
                break
            found = cut(found.unionByName(frontier))
        own = found.select("node", F.col("colour").alias("component"))
        done = own if done is None else cut(done.unionByName(own))
        remaining = cut(remaining.join(found, "node", "left_anti"))
        if remaining.isEmpty():
            return done
        left = cut(left.join(remaining.withColumnRenamed("node", "src"), "src", "left_semi").join(remaining.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    raise RuntimeError(f"components are left after {rounds} rounds")


def topological(edges: DataFrame, tasks: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, layer): the length of the longest chain of prerequisites (src before dst); raises ValueError on a cycle."""
    layers = cut(tasks.select("node").distinct().withColumn("layer", F.lit(0)))
    count = layers.count()
    for i in range(min(rounds, count) + 1):
        raised = edges.join(layers, edges.src == layers.node).groupBy(F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("least"))
        merged = cut(layers.join(raised, "node", "left").select("node", F.greatest("layer", F.coalesce("least", F.lit(0))).alias("layer"), F.col("layer").alias("was")))
        layers = merged.drop("was")
        if merged.where("layer <> was").isEmpty():
            return layers
    raise ValueError("the tasks wait for each other in a cycle")


def critical_path(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(node, finish): the earliest finish of each task (node, cost) after all its prerequisites."""
    order = topological(edges, tasks)
    layers = order.agg(F.max("layer")).first()[0] or 0
    finish = cut(tasks.join(order, "node").where("layer = 0").select("node", F.col("cost").cast("double").alias("finish")))
    for layer in range(1, layers + 1):
        own = tasks.join(order.where(F.col("layer") == layer), "node")
        ready = edges.join(finish, edges.src == finish.node).groupBy(F.col("dst").alias("node")).agg(F.max("finish").alias("start"))
        finish = cut(finish.unionByName(own.join(ready, "node").select("node", (F.col("start") + F.col("cost")).alias("finish"))))
    return finish


def ready(edges: DataFrame, tasks: DataFrame, finished: DataFrame) -> DataFrame:
    """Tasks that are not finished and whose prerequisites all are."""
    waiting = edges.join(finished.withColumnRenamed("node", "src"), "src", "left_anti").select(F.col("dst").alias("node")).distinct()
    return tasks.join(finished, "node", "left_anti").join(waiting, "node", "left_anti")


def visit_order(edges: DataFrame, start, depth_first: bool = False, most: int = 1_000_000) -> list:
    """Nodes in the order that a search from ``start`` visits them, smaller neighbours first. The order is sequential, so the edges, at most ``most``, come to the driver."""
    rows = edges.select("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a visiting order is for at most {most} edges")
    near: dict = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
    seen, out, queue = {start}, [], [start]
    if depth_first:
        seen = set()
    while queue:
        node = queue.pop() if depth_first else queue.pop(0)
        if depth_first:
            if node in seen:
                continue
            seen.add(node)
        out.append(node)
        for other in sorted(near.get(node, ()), reverse=depth_first):
            if other not in seen:
                if not depth_first:
                    seen.add(other)
                queue.append(other)
    return out


def rank_within(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The k rows of each group with the largest order value, ties by the other columns' order."""
    w = Window.partitionBy(group).orderBy(F.desc(order), *[c for c in df.columns if c not in (group, order)])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
