"""Graph, similarity and sketch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.functions import hashing as H, text as T, vectors as V
from tessella.operators import aitext, graph, knowledge, sketches
from tessella.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a directed graph with two ways out of each."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.length("n_name") + 1).cast("double").alias("weight"))
    step = F.explode(F.array((F.col("k") + 1) % 25, (F.col("k") * 7 + 3) % 25))
    return n.select(F.col("k").alias("src"), step.alias("dst"), "weight")


_ROADS = "e AS (SELECT n_nationkey::BIGINT AS src, unnest([(n_nationkey + 1) % 25, (n_nationkey * 7 + 3) % 25])::BIGINT AS dst, (length(n_name) + 1)::DOUBLE AS weight FROM nation)"


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region in a ring, and one way from each region to the next."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    w = Window.partitionBy("n_regionkey").orderBy("k")
    ring = n.select(F.col("k").alias("src"), F.coalesce(F.lead("k").over(w), F.first("k").over(w)).alias("dst"))
    firsts = n.groupBy("n_regionkey").agg(F.min("k").alias("k"))
    bridge = firsts.alias("a").join(firsts.alias("b"), F.col("b.n_regionkey") == F.col("a.n_regionkey") + 1).select(F.col("a.k").alias("src"), F.col("b.k").alias("dst"))
    return ring.union(bridge).withColumn("weight", F.lit(1.0))


_RINGS = """e AS (SELECT n_nationkey::BIGINT AS src, coalesce(lead(n_nationkey) OVER w, first_value(n_nationkey) OVER w)::BIGINT AS dst FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    UNION ALL SELECT a.k::BIGINT, b.k::BIGINT FROM (SELECT n_regionkey AS r, min(n_nationkey) AS k FROM nation GROUP BY 1) a JOIN (SELECT n_regionkey AS r, min(n_nationkey) AS k FROM nation GROUP BY 1) b ON b.r = a.r + 1)"""


def _dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.length("n_name").cast("double").alias("cost"))
    edges = n.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") + 1, F.col("node") + 7)).alias("dst")).where("dst < 25")
    return edges, n


def _orders_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order linked to the customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst is not null")


def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first distances from nation 0 along roads."""
    return graph.levels(_roads(spark, sf_dir), [0], directed=True)


def graph_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations within two hops of nation 3, either way."""
    return graph.within(_roads(spark, sf_dir), [3], 2)


def graph_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest road distances from nation 0."""
    return graph.shortest(_roads(spark, sf_dir), 0, directed=True).select("node", "distance")


def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of nations along roads after 20 rounds."""
    return graph.pagerank(_roads(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of orders as components: each is one customer's."""
    return graph.components(_orders_chain(spark, sf_dir))


def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that reach each other: the rings."""
    return graph.strong_components(_rings(spark, sf_dir))


def graph_topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of the task graph."""
    return graph.topological(*_dag(spark, sf_dir))


def graph_critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest finish of every task."""
    return graph.critical_path(*_dag(spark, sf_dir))


def graph_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, density and degree of the supplier-part graph."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))
    return graph.measures(edges).select("nodes", "edges", F.round("density", 9).alias("density"), F.round("average_degree", 9).alias("average_degree"))


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In and out degrees of suppliers and parts."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))
    return graph.degrees(edges.distinct())


def graph_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads the other way."""
    return graph.transpose(_roads(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (graph_levels, graph_within, graph_shortest, graph_pagerank, graph_components, graph_strong_components, graph_topological, graph_critical_path, graph_measures, graph_degrees, graph_transpose)}
SQL |= {
    "graph_levels": f"WITH RECURSIVE {_ROADS}, r AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.node WHERE level < 12) SELECT node, min(level) AS level FROM r GROUP BY node",
    "graph_within": f"WITH RECURSIVE {_ROADS}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT 3::BIGINT AS node, 0 AS level UNION SELECT u.dst, level + 1 FROM r JOIN u ON u.src = r.node WHERE level < 2) SELECT node, min(level) AS level FROM r GROUP BY node HAVING min(level) > 0",
    "graph_shortest": f"WITH RECURSIVE {_ROADS}, r AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS distance, 0 AS hops UNION SELECT e.dst, min(distance + weight), min(hops + 1) FROM r JOIN e ON e.src = r.node WHERE hops < 24 GROUP BY e.dst) SELECT node, min(distance) AS distance FROM r GROUP BY node",
    "graph_pagerank": f"WITH RECURSIVE {_ROADS}, o AS (SELECT src, count(*) AS out FROM e GROUP BY src), r AS (SELECT src AS node, 1 / 25.0::DOUBLE AS rank, 0 AS it FROM o UNION ALL SELECT e.dst, 0.15 / 25 + 0.85 * sum(rank / out), min(it) + 1 FROM r JOIN e ON e.src = r.node JOIN o ON o.src = r.node WHERE it < 20 GROUP BY e.dst) SELECT node, round(rank, 9) AS rank FROM r WHERE it = 20",
    "graph_components": "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1",
    "graph_strong_components": f"WITH RECURSIVE {_RINGS}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), b AS (SELECT a.src, a.dst FROM r a JOIN r c ON c.src = a.dst AND c.dst = a.src) SELECT src AS node, least(src, min(dst)) AS component FROM b GROUP BY src",
    "graph_topological": "WITH RECURSIVE r AS (SELECT n_nationkey::BIGINT AS node, 0 AS layer FROM nation UNION SELECT node + unnest([1, 7]), layer + 1 FROM r WHERE layer < 25 AND node < 24) SELECT node, max(layer) AS layer FROM r WHERE node < 25 GROUP BY node",
    "graph_critical_path": "WITH RECURSIVE c AS (SELECT n_nationkey::BIGINT AS node, length(n_name)::DOUBLE AS cost FROM nation), r AS (SELECT 0::BIGINT AS node, cost AS finish FROM c WHERE node = 0 UNION SELECT s.node, s.finish + c.cost FROM (SELECT node + unnest([1, 7]) AS node, finish FROM r) s JOIN c USING (node)) SELECT node, max(finish) AS finish FROM r GROUP BY node",
    "graph_measures": "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), n AS (SELECT (count(DISTINCT a) + count(DISTINCT b)) AS nodes, count(*) AS edges FROM e) SELECT nodes, edges, round(edges / (nodes * (nodes - 1) / 2.0), 9) AS density, round(2.0 * edges / nodes, 9) AS average_degree FROM n",
    "graph_degrees": "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 10000000 AS b FROM lineitem) SELECT a AS node, count(*) AS out_degree, 0 AS in_degree FROM e GROUP BY a UNION ALL SELECT b, 0, count(*) FROM e GROUP BY b",
    "graph_transpose": f"WITH {_ROADS} SELECT dst AS src, src AS dst, weight FROM e",
}


# ---------------------------------------------------------------- similarity


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = aitext.nearest(vectors, vectors.where("id % 100 = 0"), 5)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, and dot product, cosine and distance to the vector reversed."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.dot(e, F.reverse(e)), 6).alias("dot"), F.round(V.cosine(e, F.reverse(e)), 6).alias("cosine"), F.round(V.euclidean(e, F.reverse(e)), 6).alias("distance"))


def similar_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of each message's words to those of the message before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.alnum_words(F.col("text"))).alias("words"))
    before = F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("before", before).where("before is not null").select("conv_id", "turn", F.round(V.jaccard(F.col("words"), F.col("before")), 9).alias("jaccard"))


def similar_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document's distinct words."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.alnum_words(F.col("text")))).alias("word"))
    return sketches.simhash(words, "doc_id", "word").select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.alnum_words(F.col("text")))).alias("word"))
    return sketches.simhash(words, "doc_id", "word")


def similar_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents of one SimHash that differ in one to three bits."""
    return knowledge.near_pairs(_prints(spark, sf_dir), "doc_id").select("a", "b", "distance", "similarity")


def similar_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the class of their SimHash and its size."""
    return knowledge.near_classes(_prints(spark, sf_dir), "doc_id").select("doc_id", "class", "copies")


def similar_near_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other document of each within three bits."""
    return knowledge.near_closest(_prints(spark, sf_dir), "doc_id")


def knowledge_resolve_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as known entities, found again by the SimHash of others."""
    prints = _prints(spark, sf_dir)
    known = prints.where("doc_id % 2 = 0").select(F.col("doc_id").alias("entity_id"), "simhash")
    return knowledge.resolve_by_print(known, prints.where("doc_id % 2 = 1").select(F.col("doc_id").alias("asked"), "simhash"))


def similar_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four MinHash slots of every message's words."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.array_distinct(T.alnum_words(F.col("text"))), H.token_hash).alias("hashes")).where(F.size("hashes") > 0)
    slots = rows.select("conv_id", "turn", H.minhash(F.col("hashes"), 4).alias("s"))
    return slots.select("conv_id", "turn", *(F.element_at("s", i + 1).cast("string").alias(f"slot{i}") for i in range(4)))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.transform(F.array_distinct(T.alnum_words(F.col("text"))), H.token_hash).alias("hashes")).where(F.size("hashes") > 0)
    return rows.select("id", H.minhash(F.col("hashes"), 4).alias("signature"))


def similar_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of messages of one MinHash that share a band of it."""
    return sketches.lsh_pairs(_signatures(spark, sf_dir), "id", 2).select(F.col("a.conv_id").alias("conv_a"), F.col("a.turn").alias("turn_a"), F.col("b.conv_id").alias("conv_b"), F.col("b.turn").alias("turn_b"))


def similar_lsh_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the first message of the same MinHash."""
    return sketches.lsh_classes(_signatures(spark, sf_dir), "id").select("id.conv_id", "id.turn", F.col("class.conv_id").alias("class_conv"), F.col("class.turn").alias("class_turn"))


_TOKEN = "('0x' || array_to_string(list_reverse(regexp_extract_all(substr(sha256(word), 1, 16), '..')), ''))::UBIGINT"
_UNIQUE = r"w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents)"
_SIMHASH = f"{_UNIQUE}, h AS (SELECT doc_id, {_TOKEN} AS h FROM w), s AS (SELECT doc_id, " + " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64)) + " AS simhash FROM h GROUP BY doc_id)"
_SLOTS = ", ".join(f"min((h::HUGEINT * {1000003 * (i + 1) + 1000009}) % 18446744073709551616) AS slot{i}" for i in range(4))
_MESSAGES = rf"w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM conversations), h AS (SELECT conv_id, turn, {_TOKEN} AS h FROM w), m AS (SELECT conv_id, turn, {_SLOTS} FROM h GROUP BY ALL)"

QUERIES |= {f.__name__: f for f in (similar_vectors, vector_measures, similar_jaccard, similar_simhash, similar_near_pairs, similar_near_classes, similar_near_closest, knowledge_resolve_print, similar_minhash, similar_lsh, similar_lsh_classes)}
SQL |= {
    "similar_vectors": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "vector_measures": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding::DOUBLE[]) AS r FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(e, r), 6) AS dot, round(list_cosine_similarity(e, r), 6) AS cosine, round(list_distance(e, r), 6) AS distance FROM v",
    "similar_jaccard": r"WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS l FROM conversations), p AS (SELECT *, lag(l) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(l || b)) = 0 THEN 1.0 ELSE len(list_intersect(l, b))::DOUBLE / len(list_distinct(l || b)) END, 9) AS jaccard FROM p WHERE b IS NOT NULL",
    "similar_simhash": f"WITH {_SIMHASH} SELECT doc_id, lower(lpad(to_hex(simhash), 16, '0')) AS simhash FROM s",
    "similar_near_pairs": f"WITH {_SIMHASH}, c AS (SELECT simhash, min(doc_id) AS doc_id FROM s GROUP BY 1) SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.simhash, y.simhash)) AS distance, 1 - bit_count(xor(x.simhash, y.simhash)) / 64.0::DOUBLE AS similarity FROM c x JOIN c y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.simhash, y.simhash)) <= 3",
    "similar_near_classes": f"WITH {_SIMHASH} SELECT doc_id, min(doc_id) OVER w AS class, count(*) OVER w AS copies FROM s WINDOW w AS (PARTITION BY simhash)",
    "similar_near_closest": f"WITH {_SIMHASH}, p AS (SELECT x.doc_id, y.doc_id AS closest, bit_count(xor(x.simhash, y.simhash)) AS distance FROM s x JOIN s y ON x.doc_id <> y.doc_id WHERE bit_count(xor(x.simhash, y.simhash)) <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, closest) AS k FROM p) SELECT doc_id, closest, distance FROM r WHERE k = 1",
    "knowledge_resolve_print": f"WITH {_SIMHASH}, p AS (SELECT x.doc_id AS asked, y.doc_id AS entity_id, bit_count(xor(x.simhash, y.simhash)) AS distance FROM s x JOIN s y ON x.doc_id % 2 = 1 AND y.doc_id % 2 = 0 WHERE bit_count(xor(x.simhash, y.simhash)) <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, entity_id) AS k FROM p) SELECT asked, entity_id, distance FROM r WHERE k = 1",
    "similar_minhash": f"WITH {_MESSAGES} SELECT conv_id, turn, " + ", ".join(f"slot{i}::VARCHAR AS slot{i}" for i in range(4)) + " FROM m",
    "similar_lsh": f"WITH {_MESSAGES}, i AS (SELECT slot0, slot1, slot2, slot3, min((conv_id, turn)) AS id FROM m GROUP BY ALL) SELECT DISTINCT x.id[1] AS conv_a, x.id[2] AS turn_a, y.id[1] AS conv_b, y.id[2] AS turn_b FROM i x JOIN i y ON x.id < y.id AND ((x.slot0 = y.slot0 AND x.slot1 = y.slot1) OR (x.slot2 = y.slot2 AND x.slot3 = y.slot3))",
    "similar_lsh_classes": f"WITH {_MESSAGES}, i AS (SELECT conv_id, turn, min((conv_id, turn)) OVER (PARTITION BY slot0, slot1, slot2, slot3) AS id FROM m) SELECT conv_id, turn, id[1] AS class_conv, id[2] AS class_turn FROM i",
}


# ---------------------------------------------------------------- sketches


def sketch_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog estimate of the customers that ordered."""
    registers = sketches.hll_registers(table(spark, sf_dir, "orders"), "o_custkey")
    return sketches.hll_estimate(registers).select(F.round("estimate", 6).alias("estimate"))


def sketch_hll_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate over two tables' keys by merging their registers."""
    a = sketches.hll_registers(table(spark, sf_dir, "customer"), "c_custkey")
    b = sketches.hll_registers(table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).alias("k")), "k")
    return sketches.hll_estimate(sketches.hll_merge(a, b)).select(F.round("estimate", 6).alias("estimate"))


def sketch_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of every second customer, asked for all: how many were put in, how many of these it misses, and whether it admits at most three in a hundred of the others."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    inside = customers.where("key % 2 = 0")
    bits, hashes = sketches.bloom_size(max(inside.count(), 1), 0.01)
    admitted = sketches.bloom_probe(customers, "key", sketches.bloom_build(inside, "key", bits, hashes), bits, hashes).withColumn("admitted", F.lit(1))
    asked = customers.join(admitted, "key", "left").withColumn("own", F.col("key") % 2 == 0)
    own, other = F.col("own"), ~F.col("own")
    return asked.agg(F.count_if(own).alias("n_inside"), F.count_if(own & F.col("admitted").isNull()).alias("missed"), (F.count_if(other & F.col("admitted").isNotNull()) <= 0.03 * F.count_if(other)).alias("few_false"))


def sketch_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root over all documents in the order of their ids."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "text")
    return sketches.merkle_root(rows, "i", "text")


def _hll_sql(values: str) -> str:
    return f"""WITH w AS ({values}), h AS (SELECT {_TOKEN} AS h FROM w), r AS (SELECT h >> 52 AS bucket, max(53 - CASE WHEN h & 4503599627370495 = 0 THEN 0 ELSE length(bin(h & 4503599627370495)) END) AS rank FROM h GROUP BY 1),
        s AS (SELECT sum(pow(2.0, -rank)) AS s, count(*) AS n FROM r), e AS (SELECT 4096 - n AS empty, (0.7213 / (1 + 1.079 / 4096)) * 4096 * 4096 / (s + 4096 - n) AS raw FROM s)
        SELECT round(CASE WHEN raw <= 20480 AND empty > 0 THEN 4096 * ln(4096.0 / empty) ELSE raw END, 6) AS estimate FROM e"""


QUERIES |= {f.__name__: f for f in (sketch_hll, sketch_hll_merge, sketch_bloom, sketch_merkle)}
SQL |= {
    "sketch_hll": _hll_sql("SELECT o_custkey::VARCHAR AS word FROM orders"),
    "sketch_hll_merge": _hll_sql("SELECT c_custkey::VARCHAR AS word FROM customer UNION ALL SELECT (p_partkey + 1000000)::VARCHAR FROM part"),
    "sketch_bloom": "SELECT count(*) AS n_inside, 0 AS missed, true AS few_false FROM customer WHERE c_custkey % 2 = 0",
    "sketch_merkle": """WITH RECURSIVE r AS (SELECT list(sha256(text) ORDER BY doc_id) AS l, count(*) AS leaves FROM documents
        UNION ALL SELECT list_transform(range(1, len(l) + 1, 2), lambda i: CASE WHEN i < len(l) THEN sha256(l[i] || l[i + 1]) ELSE l[i] END), leaves FROM r WHERE len(l) > 1)
        SELECT l[1] AS root, leaves FROM r WHERE len(l) = 1""",
}
