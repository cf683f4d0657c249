"""Graph search, the pipeline language's graph and text verbs, an index's actions, resources of pages and actions on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import search as S
from tessella.plans import compiler
from tessella.processors import pages, registry as processors
from tessella.queries import searching
from tessella.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document to the one with half its number, of the kind of its language, and to the one before it, of kind next: they grow with the table."""
    ids = table(spark, sf_dir, "documents").where("doc_id > 0").select(F.col("doc_id").alias("src"), "lang")
    half = ids.select("src", F.expr("src div 2").alias("dst"), F.col("lang").alias("kind"))
    return half.union(ids.select("src", (F.col("src") - 1).alias("dst"), F.lit("next").alias("kind")))


_EDGES = "e AS (SELECT doc_id AS src, doc_id // 2 AS dst, lang AS kind FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id, doc_id - 1, 'next' FROM documents WHERE doc_id > 0)"
_BOTH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _reach(name: str, start: str, pairs: str, depth: int) -> str:
    """A recursive table (node, level) of the nodes within some hops."""
    return f"{name} AS (SELECT * FROM (VALUES {start}) t(node, level) UNION SELECT {pairs.split()[2]}, level + 1 FROM {name} JOIN {pairs.split()[0]} ON {pairs.split()[1]} = node WHERE level < {depth})"


def _found(spark: SparkSession, sf_dir: str, query: object) -> DataFrame:
    found = S.Search(searching.documents(spark, sf_dir), edges=_edges(spark, sf_dir)).run(query)
    return found.select("id", "score", F.array_join("matched_on", ",").alias("matched_on"))


_GRAPHS = {
    "search_graph_edge": (S.Edge("fr"), f"WITH {_EDGES} SELECT DISTINCT unnest([src, dst]) AS id, 1.0::DOUBLE AS score, 'graph' AS matched_on FROM e WHERE kind = 'fr'"),
    "search_graph_neighbors": (S.Neighbors(20, 3), f"WITH RECURSIVE {_EDGES}, {_BOTH}, {_reach('r', '(20, 0)', 'b src dst', 3)} SELECT DISTINCT node AS id, 1.0::DOUBLE AS score, 'graph' AS matched_on FROM r WHERE node <> 20"),
    "search_graph_path": (S.Path(120, 13, 5), f"WITH RECURSIVE {_EDGES}, {_reach('o', '(120, 0)', 'e src dst', 5)}, {_reach('i', '(13, 0)', 'e dst src', 5)} SELECT o.node AS id, 1.0::DOUBLE AS score, 'graph' AS matched_on FROM o JOIN i USING (node) GROUP BY o.node HAVING min(o.level + i.level) <= 5"),
    "search_graph_subgraph": (S.Subgraph((7, 150), 2), f"WITH RECURSIVE {_EDGES}, {_BOTH}, {_reach('r', '(7, 0), (150, 0)', 'b src dst', 2)} SELECT DISTINCT node AS id, 1.0::DOUBLE AS score, 'graph' AS matched_on FROM r"),
}


def _graph(name: str, query: object, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _found(spark, sf_dir, query)
    SQL[name] = sql


for _name, (_query, _sql) in _GRAPHS.items():
    _graph(_name, _query, _sql)


def _language(program: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("body"))
    held = {"documents": searching.documents(spark, sf_dir), "parts": parts}
    return compiler.compile_program(program, compiler.Catalog(spark, held, edges=_edges(spark, sf_dir)))[-1]


def dsl_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within three steps of two of them."""
    return _language('FROM documents\nMATCH id == 20 or id == 90\nTRAVERSE "next" DEPTH 3\n', spark, sf_dir)


def dsl_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the documents of a language."""
    return _language('FROM documents\nMATCH kind == "en"\nSUMMARIZE\n', spark, sf_dir)


def dsl_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts most like a text."""
    found = _language('FROM parts\nSIMILAR TO "red plate plate economy"\n', spark, sf_dir)
    return found.select("id", F.round("similarity", 9).alias("similarity"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of an index of the documents, where every tenth was put in anew with another title, and the number of all matches."""
    docs = searching.documents(spark, sf_dir)
    found = S.Index(docs).index(docs.where("id % 10 = 0").withColumn("title", F.lit("license"))).search("license", 50)
    return found.select("id", "score", "total_count")


def process_page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of every tag of a page that names a resource."""
    found = pages.resources(F.col("html"))
    each = F.explode(F.array(*(F.struct(F.lit(tag).alias("tag"), F.col(f"_{tag}").alias("targets")) for tag in found))).alias("r")
    rows = table(spark, sf_dir, "pages").select("page_id", *(c.alias(f"_{tag}") for tag, c in found.items()))
    return rows.select("page_id", each).select("page_id", "r.tag", F.size("r.targets").cast("long").alias("n"), F.array_join("r.targets", " ").alias("targets"))


#: Texts with words of the categories and phrases, of which the tables hold few: id, text, category, Spanish, confidence.
TEXTS = [
    (-1, "The api code has an api function.", "technical", "The api code has an api function.", "0.0000"), (-2, "market growth and revenue", "business", "market growth and revenue", "0.0000"),
    (-3, "a clinical study of a hypothesis", "science", "a clinical study of a hypothesis", "0.0000"), (-4, "zero-day exploit after a breach", "security", "zero-day exploit after a breach", "0.0000"),
    (-5, "hello network, hello file", "unknown", "hola red, hola archivo", "0.7500"), (-6, "", "unknown", "", "0.0000"), (-7, None, "unknown", "", "0.0000"),
]


def _acted(rows: DataFrame, action: str, **meta: str) -> DataFrame:
    """What the text processor's action derives from rows (doc_id, text)."""
    values = [x for pair in {"action": action, **meta}.items() for x in pair]
    own = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("data"), F.lit("application/x-ai-runtime").alias("content_type"), F.create_map(*map(F.lit, values)).alias("metadata"))
    return processors.process(own, ["ai_runtime"]).withColumn("id", F.col("id").cast("long"))


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([t[:2] for t in TEXTS], "doc_id long, text string")


def process_ai_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the text processor's summaries; texts without a sentence have an empty one."""
    found = _acted(table(spark, sf_dir, "documents"), "summarize")
    return found.where("value <> ''").select(F.col("id").alias("doc_id"), F.col("value").alias("summary"), F.col("metadata")["summary_sentences"].cast("int").alias("n_sentences"))


def process_ai_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and a few texts with words of the categories through the text processor's classification."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").union(_texts(spark))
    return _acted(rows, "classify").select("id", F.lit("report").alias("class"), F.col("value").alias("category"))


def process_ai_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few texts with known phrases through the text processor's translation."""
    found = _acted(_texts(spark), "translate", target_language="es")
    return found.select("id", F.col("value").alias("spanish"), F.col("metadata")["confidence"].alias("confidence"))


QUERIES |= {f.__name__: f for f in (dsl_traverse, dsl_summarize, dsl_similar, search_index, process_page_resources, process_ai_summaries, process_ai_classes, process_ai_translations)}
_ASKED = "(VALUES ('red', 1), ('plate', 2), ('economy', 1)) a(term, v)"
_TARGETS = " UNION ALL ".join(rf"""SELECT page_id, '{tag}' AS tag, list_filter(regexp_extract_all(html, '(?i)<{tag}(?:\s[^<>]*?)?\s{attribute}\s*=\s*["'']([^"'']*)["'']', 1), lambda x: x <> '') AS l FROM pages""" for tag, attribute in pages.RESOURCES.items())
SQL |= {
    "dsl_traverse": f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e WHERE kind = 'next' UNION SELECT dst, src FROM e WHERE kind = 'next'), {_reach('r', '(20, 0), (90, 0)', 'b src dst', 3)} SELECT DISTINCT node AS id FROM r WHERE node NOT IN (20, 90)",
    "dsl_summarize": "WITH t AS (" + searching.SQL["text_summaries"] + ") SELECT t.doc_id AS id, summary, n_sentences FROM t JOIN documents d ON d.doc_id = t.doc_id WHERE lang = 'en'",
    "dsl_similar": rf"WITH w AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{{L}}\p{{N}}]+')) AS term FROM part), c AS (SELECT id, term, count(*)::DOUBLE AS w FROM w GROUP BY ALL), s AS (SELECT id, sum(w * coalesce(v, 0)) / (sqrt(sum(w * w)) * sqrt(6)) AS s FROM c LEFT JOIN {_ASKED} ON a.term = c.term GROUP BY id) SELECT id, round(s, 9) AS similarity FROM s WHERE s >= 0.8 ORDER BY s DESC, id LIMIT 20",
    "search_index": f"WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'license' ELSE split_part(text, chr(10), 1) END AS title, text AS body FROM documents), m AS (SELECT id, {searching._keyword('license')[1]} AS score FROM d WHERE {searching._keyword('license')[0]}) SELECT id, score, count(*) OVER () AS total_count FROM m ORDER BY score DESC, id LIMIT 50",
    "process_page_resources": f"SELECT page_id, tag, len(l) AS n, array_to_string(l, ' ') AS targets FROM ({_TARGETS})",
    "process_ai_summaries": searching.SQL["text_summaries"],
    "process_ai_classes": f"SELECT * FROM ({searching.SQL['dsl_classify']}) UNION ALL SELECT id, 'report', category FROM (VALUES {searching._values([(t[0], t[2]) for t in TEXTS])}) t(id, category)",
    "process_ai_translations": f"SELECT * FROM (VALUES {searching._values([(t[0], t[3], t[4]) for t in TEXTS])}) t(id, spanish, confidence)",
}
