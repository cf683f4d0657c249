"""Graphs, sketches, temporal graphs, events, knowledge, streams on hand-made rows."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.functions import intervals as I, json as J, text as T, vectors as V
from tessella.operators import aitext, events as E, graph, inventory, knowledge, memory, sketches, temporal
from tessella.sources import catalog
from tessella.streaming import ingest, watchers, windows

SIMPLE = [(0, 1, 1.0), (0, 2, 4.0), (1, 2, 2.0), (1, 3, 5.0), (2, 3, 1.0)]
DIRECTED = [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 3, 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return lambda rows: spark.createDataFrame(rows, "src long, dst long, weight double")


def test_graphs(edges):
    simple, directed = edges(SIMPLE), edges(DIRECTED)
    assert {r.node for r in graph.levels(simple, [0]).collect()} == {0, 1, 2, 3}
    found = graph.shortest(simple, 0)
    assert {r.node: r.distance for r in found.collect()} == {0: 0, 1: 1, 2: 3, 3: 4}
    assert graph.path(found, 3) == [0, 1, 2, 3] and graph.path(found, 5) == []
    assert {r.node: r.component for r in graph.strong_components(directed).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    ranks = {r.node: r.rank for r in graph.pagerank(edges([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (2, 0, 1.0)])).collect()}
    assert len(ranks) == 3 and sum(ranks.values()) == pytest.approx(1)
    assert sum(r.rank for r in graph.pagerank(edges([(0, 1, 1.0), (1, 2, 1.0)])).collect()) == pytest.approx(1)
    assert {r.node for r in graph.pagerank(edges([(0, 1, 1.0), (1, 2, 1.0)]), sinks=False).collect()} == {0, 1}
    chain = edges([(i, i + 1, 1.0) for i in range(4)])
    assert {r.node for r in graph.within(chain, [0], 3).collect()} == {1, 2, 3}
    assert graph.visit_order(simple, 0) == [0, 1, 2, 3] and graph.visit_order(simple, 0, depth_first=True)[0] == 0
    assert graph.measures(simple).first().asDict() == {"nodes": 4, "edges": 5, "density": 5 / 6, "average_degree": 2.5}


def test_task_graphs(spark, edges):
    tasks = spark.createDataFrame([(n, float(n + 1)) for n in range(4)], "node long, cost double")
    order = edges([(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)])
    assert {r.node: r.layer for r in graph.topological(order, tasks).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert {r.node: r.finish for r in graph.critical_path(order, tasks).collect()} == {0: 1, 1: 3, 2: 4, 3: 8}
    done = spark.createDataFrame([(0,), (1,)], "node long")
    assert {r.node for r in graph.ready(order, tasks, done).collect()} == {2}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological(edges([(0, 1, 1.0), (1, 0, 1.0)]), tasks.where("node < 2"))


def test_sketches(spark):
    values = spark.createDataFrame([(f"v{i % 5000}",) for i in range(8000)], "v string")
    estimate = sketches.hll_estimate(sketches.hll_registers(values, "v", 10), 10).first()[0]
    assert abs(estimate - 5000) < 500
    bits, hashes = sketches.bloom_size(100, 0.01)
    items = spark.createDataFrame([(f"a{i}",) for i in range(100)], "v string")
    built = sketches.bloom_build(items, "v", bits, hashes)
    others = spark.createDataFrame([(f"b{i}",) for i in range(400)], "v string")
    assert sketches.bloom_probe(items, "v", built, bits, hashes).count() == 100
    assert sketches.bloom_probe(others, "v", built, bits, hashes).count() < 20


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_merkle_trees(spark, n):
    values = [f"data{i}" for i in range(n)]
    root, leaves = sketches.merkle_root(spark.createDataFrame(list(enumerate(values)), "i long, v string"), "i", "v").first()
    hashes = [hashlib.sha256(v.encode()).hexdigest() for v in values]
    assert leaves == n
    for i, v in enumerate(values):
        steps = sketches.merkle_proof(hashes, i)
        assert sketches.merkle_verify(v, steps, root) and not sketches.merkle_verify("wrong", steps, root)


def _members(spark, snapshots):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(start + timedelta(days=i), n) for i, s in enumerate(snapshots) for n in s], "snapshot_ts timestamp, id string")


def test_evolution(spark):
    def value(df):
        return df.first()[0]

    assert value(temporal.survival(_members(spark, [["a", "b"], ["a", "c"]]))) == 0.5
    assert value(temporal.churn(temporal.evolution(_members(spark, [["a", "b"], ["c", "d"]])))) == pytest.approx(1.0)
    steps = temporal.evolution(_members(spark, [["a"], ["a", "b"], ["a", "b", "c"]]))
    assert [(r["size"], r.added, r.removed) for r in steps.orderBy("snapshot_ts").collect()] == [(1, 0, 0), (2, 1, 0), (3, 1, 0)]
    points = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert temporal.trend(points, "x", "y").first().asDict() == {"slope": 1.0, "intercept": 1.0, "r2": 1.0}
    assert temporal.trend(points.limit(1), "x", "y").first().slope == 0
    assert temporal.trend(points.withColumn("y", F.lit(2.0)), "x", "y").first().r2 == 0


def test_differences(spark):
    before = spark.createDataFrame([("a", {"color": "red"}), ("b", {"x": "1"}), ("d", {})], "id string, attributes map<string,string>")
    after = spark.createDataFrame([("a", {"color": "blue", "new": "1"}), ("c", {}), ("d", {})], "id string, attributes map<string,string>")
    found = temporal.difference(before, after, "id", "attributes")
    assert {(r.id, r.change) for r in found.collect()} == {("a", "modified"), ("b", "removed"), ("c", "added")}
    assert {tuple(r) for r in temporal.attribute_changes(found, "id").collect()} == {("a", "color", "red", "blue"), ("a", "new", None, "1")}
    assert temporal.difference(before, before, "id", "attributes").count() == 0


def test_intervals(spark):
    d = [datetime(2024, 1, i) for i in range(1, 6)]
    rows = spark.createDataFrame([(d[0], d[2], d[1], d[3]), (d[0], d[1], d[1], d[3]), (d[0], None, d[2], None), (d[0], d[0], d[0], d[4])], "a timestamp, b timestamp, c timestamp, d timestamp")
    found = rows.select(I.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o"), I.before(F.col("b"), F.col("c")).alias("f"), I.contains(F.col("a"), F.col("b"), F.col("a")).alias("c")).collect()
    assert [(r.o, r.f, r.c) for r in found] == [(True, False, True), (False, True, True), (True, False, True), (False, True, False)]


def _events(spark, rows):
    return spark.createDataFrame([(i, a, "Entity", t, v, data, datetime(2024, 1, 1) + timedelta(hours=i)) for i, (a, t, v, data) in enumerate(rows)], "id long, aggregate_id string, aggregate_type string, event_type string, version long, data string, timestamp timestamp")


def test_event_store(spark):
    stored = _events(spark, [("x", "Created", 1, '{"name":"a","kind":"k"}'), ("x", "Updated", 2, '{"name":"b"}'), ("y", "Created", 1, '{"name":"c"}'), ("y", "Deleted", 2, "{}"), ("z", "Created", 1, '{"name":"d"}'), ("z", "Deleted", 2, "{}"), ("z", "Created", 3, '{"kind":"q"}')])
    assert {(r.aggregate_id, r.name, r.kind, r.version) for r in E.replay(stored, ["name", "kind"]).collect()} == {("x", "b", "k", 2), ("z", None, "q", 3)}
    assert inventory.project(stored, "Entity").count() == 2
    new = _events(spark, [("x", "Updated", 3, "{}"), ("n", "Created", 1, "{}")])
    assert E.append(stored, new).count() == 9
    with pytest.raises(E.VersionConflict):
        E.append(stored, _events(spark, [("x", "Updated", 5, "{}")]))
    with pytest.raises(E.VersionConflict):
        E.append(stored, _events(spark, [("x", "Updated", 2, "{}")]))


def test_knowledge(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (2, "a", 0.9), (3, "b", 0.5)], "id long, content string, confidence double")
    assert {r.id for r in knowledge.resolve_duplicates(rows, "id", "content", "discard").collect()} == {1, 3}
    assert {(r.id, r.linked_to) for r in knowledge.resolve_duplicates(rows, "id", "content", "keep_linked").collect()} == {(1, None), (2, 1), (3, None)}
    assert {r.id for r in knowledge.resolve_duplicates(rows, "id", "content", "replace_if_higher", "confidence").collect()} == {2, 3}
    assert knowledge.any_of_group(rows, "content", "confidence").where("content = 'a'").first().confidence == pytest.approx(0.92)
    with pytest.raises(ValueError, match="strategy"):
        knowledge.resolve_duplicates(rows, "id", "content", "x")
    prints = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, -2), (5, 15)], "id long, simhash long")
    assert {(r.a, r.b, r.distance) for r in knowledge.near_pairs(prints, "id").collect()} == {(1, 2, 3), (3, 4, 1), (2, 5, 1)}


def test_memory_and_stores(spark):
    now = F.lit(datetime(2024, 1, 2))
    rows = spark.createDataFrame([("a", 5, datetime(2024, 1, 1, 23, 59)), ("b", 9, datetime(2024, 1, 1)), ("c", 7, datetime(2024, 1, 1, 23, 58))], "key string, accesses int, accessed_at timestamp")
    assert [r.key for r in memory.working_set(rows, now, 300, 1).collect()] == ["c"]
    table = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    assert {tuple(r) for r in catalog.kv_store(table, spark.createDataFrame([("b", 3), ("c", 4)], "key string, value int")).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    paths = spark.createDataFrame([("/a/x/1",), ("/a/x/2",), ("/a/y",), ("/ab/z",)], "path string")
    assert {(r.name, r.entries) for r in catalog.folder(paths, "/a").collect()} == {("x", 2), ("y", 1)}
    assert {r.path for r in catalog.renamed(paths, "/a/x", "/q").collect()} == {"/q/1", "/q/2", "/a/y", "/ab/z"}
    drivers = catalog.standard(spark)
    assert drivers.find("read_parquet") == ["parquet"]
    with pytest.raises(KeyError):
        drivers.execute("fly")


def test_files(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"\x00\x01")
    row = catalog.standard(spark).execute("read_file", str(tmp_path)).first()
    assert bytes(row.data) == b"\x00\x01" and row.base64 == "AAE="
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    assert catalog.standard(spark).execute("read_json", catalog.exported(rows, str(tmp_path / "out"), "json"), schema="k int, v string").collect() == rows.collect()


def test_text(spark):
    rows = spark.createDataFrame([(1, "Contact support@example.com on 2025-01-15. Cost: $1,299.99, up 23.5%"), (2, ""), (3, None), (4, "café Ann Lee")], "id long, text string")
    found = aitext.entities(rows, "id", "text").collect()
    assert {(r.id, r.kind) for r in found} >= {(1, "EMAIL"), (1, "DATE"), (1, "MONEY"), (1, "PERCENT"), (4, "PERSON")}
    assert next((r.start, r.end) for r in found if r.id == 4) == (6, 13)
    text = "This is the first long sentence here. Short. Another sentence with the first words. " * 3
    summary = aitext.summaries(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", 2).first()
    assert summary.n_sentences == 2 and summary.summary.startswith("This is the first")
    scores = aitext.sentence_scores(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy(F.desc("score"), "position").limit(3).collect()
    assert [r.sentence for r in sorted(scores, key=lambda r: r.position)] == aitext.best_sentences(text, 3)
    one = spark.createDataFrame([("abcabcab", "café")], "a string, b string").select(T.overlapping(F.col("a"), "ab"), T.occurrences(F.col("a"), "abc"), T.positions(F.col("b"), "é"), T.byte_levenshtein(F.col("b"), F.lit("cafe"))).first()
    assert tuple(one) == (3, 2, [3], 2)


def test_vectors_and_hashes(spark):
    row = spark.range(1).select(V.dot(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (1.0, 2.0, 3.0)))), V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), V.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()
    assert tuple(row) == (14.0, -1.0, 0.0, 1.0)
    assert J.fnv1a(b"") == 0xCBF29CE484222325 and J.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert J.canonical('{"B": " x  Y", "a": [1, {"d": null, "C": 2}]}') == '{"a":[1,{"c":2,"d":null}],"b":"x y"}'
    assert J.canonical("nope") is None
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, embedding array<float>")
    assert [(r.query_id, r.id, r.score) for r in aitext.nearest(vectors, vectors, 1).orderBy("query_id").collect()] == [(0, 0, 1.0), (1, 1, 1.0)]
    assert aitext.nearest(vectors, vectors, 9).count() == 4


def _brute(vectors, queries, k):
    """(query_id, rank, id, score) by the rule of similar_vectors' SQL, where a vector without length has the cosine 0."""
    rows = []
    for q, a in queries:
        own = []
        for i, b in vectors:
            score = None
            if a is not None and b is not None:
                dot, scale = sum(x * y for x, y in zip(a, b, strict=True)), math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
                score = round(dot / scale, 12) if scale else 0.0
            own.append((score is None, 0.0 if score is None else -score, i is None, i or 0, score))
        rows += [(q, rank, None if none else i, score) for rank, (_, _, none, i, score) in enumerate(sorted(own, key=lambda r: r[:4])[:k], 1)]
    return sorted(rows, key=lambda r: r[:2])


def test_nearest_takes_all_queries_in_blocks_and_breaks_ties_by_id(spark):
    schema = "id long, embedding array<float>"
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(297)] + [(297, None), (298, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rng.shuffle(rows)
    vectors = spark.createDataFrame(rows, schema).repartition(3)
    asked = [(i, v) for i, v in rows if i is not None and i % 9 == 0]
    assert (297, None) in asked
    for k, at_once in ((5, 7), (400, 100_000)):
        found = aitext.nearest(vectors, vectors.where("id % 9 = 0"), k, rows_at_once=at_once)
        assert sorted(map(tuple, found.select("query_id", "rank", "id", "score").collect()), key=lambda r: r[:2]) == _brute(rows, asked, k)
    many = [(i, v) for i in range(2_200) if (v := rng.choice(rows)[1]) is not None]
    found = aitext.nearest(spark.createDataFrame(many, schema).coalesce(1), spark.createDataFrame(many[::4], schema), 3)
    assert sorted(map(tuple, found.select("query_id", "rank", "id", "score").collect())) == _brute(many, many[::4], 3)
    assert aitext.nearest(vectors, vectors.where("id < 0"), 5).collect() == [] and aitext.nearest(vectors.where("id < 0"), vectors, 5).collect() == []
    assert len({r.id for r in aitext.nearest(vectors, vectors, 5).where("query_id = 297").collect()} & set(range(5))) == 5
    with pytest.raises(Exception, match="components"):
        aitext.nearest(spark.createDataFrame([(1, [1.0])], schema), vectors, 5).collect()
    odd = spark.createDataFrame([(1, [1.0, math.nan]), (2, [1.0, 0.0]), (3, [1.0, None])], schema)
    assert [(r.id, r.score is None or math.isnan(r.score)) for r in aitext.nearest(odd, odd.where("id = 2"), 3).orderBy("rank").collect()] == [(1, True), (2, False), (3, True)]


def test_nearest_holds_no_matrix_of_all_queries_by_a_batch(spark, monkeypatch):
    def table(n):
        return spark.range(n).select("id", F.array(*(F.sin(F.col("id") * (i + 1)).cast("float") for i in range(8))).alias("embedding"))

    seen, frame = [], type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, run=frame.mapInArrow, **b: (seen.append(f), run(self, f, *a, **b))[1])
    aitext.nearest(table(10_000), table(3_000), 5)
    batch = table(10_000).toArrow().combine_chunks().to_batches()[0]
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in seen[-1](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 15_000 and peak < 3_000 * 10_000 * 8 / 2


def test_streams(spark, tmp_path):
    schema = "id long, aggregate_id string, aggregate_type string, event_type string, version long, data string, timestamp timestamp"
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    _events(spark, [("x", "Created", 1, "{}"), ("x", "Updated", 2, "{}")]).write.parquet(source)
    stream = ingest.catch_up(spark, source, _events(spark, []).schema)
    ingest.append_to(stream, target, checkpoint).awaitTermination(60)
    _events(spark, [("x", "Updated", 3, "{}")]).write.mode("append").parquet(source)
    ingest.append_to(ingest.catch_up(spark, source, _events(spark, []).schema), target, checkpoint).awaitTermination(60)
    assert spark.read.schema(schema).parquet(f"{target}/batch=0", f"{target}/batch=1").count() == 3
    _events(spark, [("x", "Updated", 9, "{}")]).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="does not follow"):
        ingest.append_to(ingest.catch_up(spark, source, _events(spark, []).schema), target, checkpoint).awaitTermination(60)


def _polls(spark):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(s, start + timedelta(minutes=i), v, ok) for i, (s, v, ok) in enumerate([("a", "1", True), ("a", "1", True), ("b", "7", False), ("a", None, False), ("a", "2", True), ("b", "7", True), ("b", "7", True)])], "subject string, ts timestamp, state string, ok boolean")


def test_watchers_in_a_stream_and_in_a_table(spark, tmp_path):
    watcher = watchers.WATCHERS["package"]
    expected = [("a", "initial"), ("a", "no_change"), ("a", "poll_failed"), ("a", "version_changed"), ("b", "poll_failed"), ("b", "initial"), ("b", "no_change")]
    table = watchers.watched(_polls(spark), watcher)
    assert [(r.subject, r.change) for r in table.orderBy("subject", "ts").collect()] == expected
    path = str(tmp_path / "polls")
    _polls(spark).coalesce(1).write.parquet(path)
    query = watchers.watch(spark.readStream.schema(_polls(spark).schema).parquet(path), watcher).writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.subject, r.change) for r in spark.table("watched").orderBy("subject", "ts").collect()] == expected
    assert watchers.alerts(table).first().alert == "system_alert"


def test_windows_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame([(datetime(2024, 1, 1, h), "a", 1.0) for h in (0, 0, 1, 5)], "ts timestamp, kind string, value double")
    rows.write.parquet(path)
    stream = windows.tumbling(spark.readStream.schema(rows.schema).parquet(path), "1 hour", ["kind"], watermark="10 minutes")
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.window_start.hour, r.n) for r in spark.table("hours").collect()) == [(0, 2), (1, 1), (5, 1)]


def test_advisories_are_new_once_whatever_comes_between(spark, tmp_path):
    polls = spark.createDataFrame([("f", 1, ["CVE-1"], True), ("f", 2, ["CVE-2"], True), ("f", 3, ["CVE-1"], True), ("f", 4, ["CVE-3"], False), ("f", 5, ["CVE-3", "CVE-3", None], True), ("g", 6, ["CVE-1"], True), ("g", 7, [], True), ("h", 8, None, True)], "subject string, n int, ids array<string>, ok boolean")
    expected = [["CVE-1"], ["CVE-2"], [], [], ["CVE-3"], [], [], []]
    rows = watchers.advisories(polls, ["n"]).orderBy("n").collect()
    assert [r.fresh for r in rows] == expected
    assert [r.change for r in rows] == ["new_advisory", "new_advisory", "feed_polled", "feed_failed", "new_advisory", "feed_polled", "feed_polled", "feed_polled"]
    assert watchers.advisories(polls.limit(0), ["n"]).collect() == []
    stream = polls.where("subject = 'f'").select("subject", F.timestamp_seconds("n").alias("ts"), "ids", "ok")
    stream.write.parquet(str(tmp_path / "in"))
    query = watchers.watch_advisories(spark.readStream.schema(stream.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("advisories").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.fresh for r in spark.table("advisories").orderBy("ts").collect()] == expected[:5]


def test_longest_prefixes_of_any_length_and_edge_rows(spark):
    terms = spark.createDataFrame([("a" * 70,), ("aaa",), ("aaa",), (None,), ("",), ("b",)], "term string")
    asked = spark.createDataFrame([("a" * 80,), ("aab",), (None,), ("",), ("bc",), ("bc",)], "word string")
    assert {r.word: r.prefix for r in memory.longest_prefix(terms, asked).collect()} == {"a" * 80: "a" * 70, "aab": "", "": "", "bc": "b"}
    assert memory.longest_prefix(terms.limit(0), asked).collect() == []


def test_equal_prints_are_a_class_without_pairs(spark):
    prints = spark.createDataFrame([(i, 7 if i < 500 else 6 if i < 600 else 15 << 40) for i in range(700)], "id long, simhash long")
    assert [(r.a, r.b, r.distance) for r in knowledge.near_pairs(prints, "id").collect()] == [(0, 500, 1)]
    assert {(r.id, r["class"], r.copies) for r in knowledge.near_classes(prints, "id").collect()} == {(i, 0 if i < 500 else 500 if i < 600 else 600, 500 if i < 500 else 100) for i in range(700)}
    nearest = {r.id: (r.closest, r.distance) for r in knowledge.near_closest(prints, "id").collect()}
    assert nearest[0] == (1, 0) and nearest[499] == (0, 0) and nearest[500] == (501, 0) and nearest[600] == (601, 0)
    assert knowledge.near_pairs(prints.limit(0), "id").collect() == []
    # more prints than four parts hold: other parts, the same pairs
    few = knowledge.near_pairs(prints, "id", bucket=0).collect()
    assert [(r.a, r.b, r.distance) for r in few] == [(0, 500, 1)]
