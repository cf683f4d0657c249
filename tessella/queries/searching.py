"""Search, text analysis and language queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import text as T
from tessella.operators import aitext, memory, search as S
from tessella.plans import compiler
from tessella.processors import code
from tessella.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

DOCS = "d AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, lang AS kind, source FROM documents)"
LIMIT = 100


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as search documents; the title is the first line."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.col("lang").alias("kind"), "source",
        F.lit(None).cast("timestamp").alias("ts"), F.create_map(F.lit("package"), F.concat(F.lit("pkg-"), "lang"), F.lit("depends_on"), F.col("source"), F.lit("package_name"), F.concat(F.lit("pkg-"), "lang")).alias("metadata"),
    )


#: Small sources in several languages with their chains of dependencies, as the tables hold no code: (id, title, body, chain, depth).
SOURCES = [
    (1, "a.rs", "pub fn run_all() {}\nstruct Runner;\nuse std::run;", "app>serde", 1), (2, "a.py", "import runner\nclass Runner:\n    def run(self): pass", "app>http>serde", 2),
    (3, "a.ts", "export interface Run { }\nfunction run() {}", "app>x>y>serde", 4), (4, "b.txt", "nothing of the kind, run along", "app", 0), (5, "a.go", "func Run() {}\nimport \"run\"", "serde_json", 3), (6, "c.rs", "trait Stop {}\nfn halt() {}", "tokio", 1),
]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small sources as search documents."""
    rows = spark.createDataFrame(SOURCES, "id long, title string, body string, chain string, depth int")
    metadata = F.create_map(F.lit("dep_chain"), F.col("chain"), F.lit("dep_depth"), F.col("depth").cast("string"))
    return rows.select("id", "title", "body", F.lit("source").alias("kind"), F.lit("inline").alias("source"), F.lit(None).cast("timestamp").alias("ts"), metadata.alias("metadata"))


def _values(rows: list[tuple]) -> str:
    """Rows as an SQL list of values."""
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _search(name: str, query: object, sql: str, limit: int | None = LIMIT, among: Callable[[SparkSession, str], DataFrame] = documents) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = S.Search(among(spark, sf_dir)).run(query, limit)
        return found.select("id", "score", F.array_join("matched_on", ",").alias("matched_on"))

    QUERIES[name] = run
    held = DOCS if among is documents else f"d AS (SELECT * FROM (VALUES {_values(SOURCES)}) t(id, title, body, chain, depth))"
    SQL[name] = f"WITH {held} {sql}" + (f" ORDER BY score DESC, id LIMIT {limit}" if limit else "")


def _count(column: str, term: str) -> str:
    return f"((length(lower({column})) - length(replace(lower({column}), '{term}', ''))) // {len(term)})"


def _keyword(term: str) -> tuple[str, str, str]:
    title, body = _count("title", term), _count("body", term)
    return f"({title} > 0 OR {body} > 0)", f"(3.0 * {title} + {body})::DOUBLE", f"CASE WHEN {title} > 0 THEN 'title' ELSE 'body' END"


_m, _s, _o = _keyword("the")
_search("search_keyword", S.Keyword("The"), f"SELECT id, {_s} AS score, {_o} AS matched_on FROM d WHERE {_m}")
_search("search_phrase", S.Phrase(("of", "the")), "SELECT id, 2.0::DOUBLE AS score, 'phrase' AS matched_on FROM d WHERE contains(lower(title), 'of the') OR contains(lower(body), 'of the')")
_search("search_contains", S.Contains("tion"), "SELECT id, 1.0::DOUBLE AS score, 'prefix' AS matched_on FROM d WHERE contains(lower(title), 'tion') OR contains(lower(body), 'tion')")
_search("search_prefix", S.StartsWith("tion"), r"SELECT id, 1.0::DOUBLE AS score, 'prefix' AS matched_on FROM d WHERE len(list_filter(regexp_extract_all(lower(title || ' ' || body), '[\p{L}\p{N}]+'), lambda w: starts_with(w, 'tion'))) > 0")
_k = {t: _keyword(t) for t in ("der", "und", "license", "and")}
_search("search_and", S.And((S.Keyword("der"), S.Keyword("und"))), f"SELECT id, {_k['der'][1]} AS score, {_k['der'][2]} AS matched_on FROM d WHERE {_k['der'][0]} AND {_k['und'][0]}")
_search("search_or", S.Or((S.Keyword("license"), S.Keyword("und"))), f"SELECT id, CASE WHEN {_k['license'][0]} THEN {_k['license'][1]} ELSE {_k['und'][1]} END AS score, CASE WHEN {_k['license'][0]} THEN {_k['license'][2]} ELSE {_k['und'][2]} END AS matched_on FROM d WHERE {_k['license'][0]} OR {_k['und'][0]}")
_search("search_not", S.Not(S.Keyword("and")), f"SELECT id, 1.0::DOUBLE AS score, 'not' AS matched_on FROM d WHERE NOT {_k['and'][0]}")
_search("search_and_not", S.And((S.Keyword("and"), S.Not(S.Keyword("license")))), f"SELECT id, {_k['and'][1]} AS score, {_k['and'][2]} AS matched_on FROM d WHERE {_k['and'][0]} AND NOT {_k['license'][0]}")
_search("search_filter", S.Filter(S.Keyword("and"), (("kind", "en"), ("score_above", 5.0), ("score_below", 50.0))), f"SELECT id, {_k['and'][1]} AS score, {_k['and'][2]} AS matched_on FROM d WHERE {_k['and'][0]} AND kind = 'en' AND {_k['and'][1]} BETWEEN 5 AND 50")
_search("search_filter_metadata", S.Filter(S.Keyword("and"), (("metadata", "package", "pkg-en"), ("source", "src0"))), f"SELECT id, {_k['and'][1]} AS score, {_k['and'][2]} AS matched_on FROM d WHERE {_k['and'][0]} AND kind = 'en' AND source = 'src0'")
for _construct, _marks in S.CONSTRUCTS.items():
    _any = " OR ".join(f"contains(lower(body), '{m}')" for m in _marks)
    _search(f"search_structural_{_construct}", S.Structural(_construct, "run"), f"SELECT id, 1.0::DOUBLE AS score, 'structural' AS matched_on FROM d WHERE ({_any}) AND contains(lower(body), 'run')", among=sources)
_search("search_structural_call", S.Structural("call", "run"), "SELECT id, 1.0::DOUBLE AS score, 'structural' AS matched_on FROM d WHERE contains(lower(body), 'run(')", among=sources)
_search("search_structural_symbol", S.Structural("symbol", "run", "struct"), "SELECT id, 1.0::DOUBLE AS score, 'structural' AS matched_on FROM d WHERE contains(lower(body), 'struct') AND contains(lower(body), 'run')", among=sources)
_search("search_transitive", S.Dependency("transitive", "serde", 3), "SELECT id, 1.0::DOUBLE AS score, 'dependency' AS matched_on FROM d WHERE contains(chain, 'serde') AND depth <= 3", among=sources)
_search("search_graph_node", S.Node("The", "en"), "SELECT id, 1.0::DOUBLE AS score, 'graph' AS matched_on FROM d WHERE (contains(title, 'The') OR contains(body, 'The')) AND kind = 'en'")
_search("search_dependents", S.Dependency("dependents", "src1"), "SELECT id, 1.0::DOUBLE AS score, 'dependency' AS matched_on FROM d WHERE contains(source, 'src1')")
_search("search_dependencies", S.Dependency("dependencies", "pkg-fr"), "SELECT id, 1.0::DOUBLE AS score, 'dependency' AS matched_on FROM d WHERE kind = 'fr'")
_search("search_ecosystem", S.Dependency("ecosystem", "src1"), "SELECT id, 1.0::DOUBLE AS score, 'dependency' AS matched_on FROM d WHERE contains(source, 'src1')")
_search("search_module", S.Architecture("module", "src1"), "SELECT id, 1.0::DOUBLE AS score, 'architecture' AS matched_on FROM d WHERE contains(source, 'src1') OR contains(title, 'src1')")
_search("search_package", S.Architecture("package", "pkg-de"), "SELECT id, 1.0::DOUBLE AS score, 'architecture' AS matched_on FROM d WHERE kind = 'de'")


def search_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents, within a week, both ends included."""
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("props").alias("body"), F.col("event_type").alias("kind"), F.lit("events").alias("source"), "ts", F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    found = S.Search(docs).run(S.Temporal(datetime(2024, 1, 8), datetime(2024, 1, 14, 23, 59, 59)))
    return found.select("id", "score")


def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the cosine of their embeddings to a fixed vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = S.Search(documents(spark, sf_dir), embeddings=vectors).run(S.Semantic(tuple(1.0 if i % 2 else -0.5 for i in range(64))))
    return found.select("id", F.round("score", 6).alias("score"))


def search_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like any that mentions a licence."""
    found = S.Search(documents(spark, sf_dir)).run(S.Similarity(S.Keyword("apache"), 0.9))
    return found.select("id", F.round("score", 6).alias("score"))


QUERIES |= {"search_temporal": search_temporal, "search_semantic": search_semantic, "search_similarity": search_similarity}
SQL |= {
    "search_temporal": "SELECT event_id AS id, 1.0::DOUBLE AS score FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14 23:59:59'",
    "search_semantic": "SELECT doc_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 2 = 1 THEN 1.0 ELSE -0.5 END)::DOUBLE[]), 6) AS score FROM documents JOIN embeddings ON vec_id = doc_id",
    "search_similarity": rf"""
        WITH {DOCS}, w AS (SELECT id, term, sum(n)::DOUBLE AS w FROM (
            SELECT id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+')) AS term, 3 AS n FROM d UNION ALL
            SELECT id, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')), 1 FROM d) GROUP BY ALL),
        norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
        base AS (SELECT id FROM d WHERE {_keyword('apache')[0]}),
        dots AS (SELECT a.id, b.id AS base, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (term) WHERE b.id IN (SELECT id FROM base) GROUP BY ALL),
        s AS (SELECT dots.id, base, dot / (x.norm * y.norm) AS score FROM dots JOIN norms x ON x.id = dots.id JOIN norms y ON y.id = dots.base)
        SELECT id, round(arg_min(score, base), 6) AS score FROM s WHERE score >= 0.9 - 1e-12 GROUP BY id""",
}


# ---------------------------------------------------------------- text analysis


def text_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the entity patterns in every document."""
    counts = T.entity_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(counts[k].cast("long").alias(k.lower()) for k in ("EMAIL", "URL", "DATE", "MONEY", "PERCENT", "PERSON")))


def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every document with their places."""
    return aitext.entities(table(spark, sf_dir, "documents"), "doc_id", "text")


def text_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the categories of their words, at a low threshold."""
    found = T.classified(table(spark, sf_dir, "documents"), "text", 0.001)
    return found.select("doc_id", F.col("category").alias("label"), F.round("confidence", 9).alias("confidence"))


_PHRASED = "concat(text, ' ', " + "CASE conv_id % 4 " + " ".join(f"WHEN {i} THEN '{' and '.join(list(T.PHRASES)[i::4])}'" for i in range(4)) + " END)"


def text_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, each with some of the fixed phrases at its end, with the phrases replaced."""
    found = T.translate(F.lower(F.expr(_PHRASED)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(found["text"], 256).alias("sha"), F.round(found["confidence"], 9).alias("confidence"))


def text_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best sentences of every document."""
    return aitext.summaries(table(spark, sf_dir, "documents"), "doc_id", "text")


def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and bytes of the sentences of every document."""
    found = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.aggregate(found, F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s)).alias("n_bytes"))


def text_bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word frequencies of every conversation message by its most frequent word."""
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return aitext.bag_of_words(rows, "id", T.alnum_words(F.col("text"))).select("id.conv_id", "id.turn", "term", F.round("tf", 9).alias("tf"))


def text_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programming language that each document's marks tell."""
    return table(spark, sf_dir, "documents").select("doc_id", code.language(F.col("text")).alias("language"))


def _case(values: list[tuple[str, str]], best: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} = {best} THEN '{n}'" for n, v in values) + f" ELSE '{otherwise}' END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_scores = [(name, "(" + " + ".join(f"((length(t) - length(replace(t, '{k}', ''))) // {len(k)}) * {w}" for k, w in words.items()) + ") / n") for name, words in T.CATEGORIES.items()]
_langs = [(name, "(" + " + ".join(f"contains(text, {_quoted(m)})::INT" for m in marks) + ")") for name, marks in code.LANGUAGES.items()]
_translated, _hits = f"lower({_PHRASED})", []
for _phrase, _other in T.PHRASES.items():
    _hits.append(f"contains({_translated}, '{_phrase}')::INT")
    _translated = f"replace({_translated}, '{_phrase}', '{_other}')"

QUERIES |= {f.__name__: f for f in (text_entity_counts, text_entities, text_classify, text_translate, text_summaries, text_sentences, text_bag_of_words, text_code_language)}
SQL |= {
    "text_entity_counts": "SELECT doc_id, " + ", ".join("(" + " + ".join(f"len(regexp_extract_all(text, {_quoted(p)}))" for k, p, _ in T.ENTITIES if k == kind) + f") AS {kind.lower()}" for kind in ("EMAIL", "URL", "DATE", "MONEY", "PERCENT", "PERSON")) + " FROM documents",
    "text_classify": "WITH x AS (SELECT doc_id, lower(text) AS t, greatest(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 1) AS n FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{v} AS {n}" for n, v in _scores) + " FROM x), b AS (SELECT *, greatest(technical, business, science, security) AS best FROM s) SELECT doc_id, CASE WHEN best >= 0.001 THEN " + _case([(n, n) for n, _ in _scores], "best", "unknown") + " ELSE 'unknown' END AS label, CASE WHEN best >= 0.001 THEN round(best, 9) ELSE 0.0 END AS confidence FROM b",
    "text_summaries": r"""
        WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')), lambda x: strlen(x) > 1) AS l FROM documents),
        e AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos, len(l) AS n FROM s),
        w AS (SELECT *, list_filter(list_transform(list_filter(regexp_extract_all(lower(sentence), '[^ \t\n\r\f\x0B]+'), lambda x: strlen(x) > 2), lambda x: regexp_replace(x, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')), lambda x: x <> '') AS words FROM e),
        d AS (SELECT doc_id, pos, unnest(list_distinct(words)) AS word FROM w), f AS (SELECT doc_id, word, count(*) AS f FROM d GROUP BY ALL),
        t AS (SELECT d.doc_id, pos, sum(f) AS total FROM d JOIN f ON f.doc_id = d.doc_id AND f.word = d.word GROUP BY ALL),
        r AS (SELECT w.doc_id, w.pos, sentence, row_number() OVER (PARTITION BY w.doc_id ORDER BY CASE WHEN len(words) > 0 THEN coalesce(total, 0)::DOUBLE / len(words) ELSE 0 END * (1 + (1 - w.pos::DOUBLE / n) * 0.5::DOUBLE) DESC, w.pos) AS rank
              FROM w LEFT JOIN t ON t.doc_id = w.doc_id AND t.pos = w.pos WHERE strlen(sentence) >= 20)
        SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary, count(*)::INT AS n_sentences FROM r WHERE rank <= 5 GROUP BY doc_id""",
    "text_translate": f"SELECT conv_id, turn, sha256({_translated}) AS sha, round(({' + '.join(_hits)})::DOUBLE / greatest(len(regexp_extract_all({_PHRASED}, '[^ \t\n\r\f\x0B]+')), 1), 9) AS confidence FROM conversations",
    "text_sentences": r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')), lambda x: strlen(x) > 1) AS l FROM documents) SELECT doc_id, len(l) AS n_sentences, coalesce(list_sum(list_transform(l, lambda x: strlen(x))), 0)::BIGINT AS n_bytes FROM s",
    "text_bag_of_words": r"WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations), c AS (SELECT conv_id, turn, term, count(*) AS n FROM w GROUP BY ALL) SELECT conv_id, turn, term, round(n / max(n) OVER (PARTITION BY conv_id, turn), 9) AS tf FROM c",
    "text_code_language": "WITH s AS (SELECT doc_id, " + ", ".join(f"{v} AS l_{n}" for n, v in _langs) + " FROM documents), b AS (SELECT *, greatest(" + ", ".join(f"l_{n}" for n, _ in _langs) + ") AS best FROM s) SELECT doc_id, CASE WHEN best = 0 THEN 'unknown' ELSE " + _case([(n, f"l_{n}") for n, _ in _langs], "best", "unknown") + " END AS language FROM b",
}


# ---------------------------------------------------------------- indexes


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.postings(table(spark, sf_dir, "documents"), "doc_id", T.alnum_words(F.col("text")))


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with their documents and first and last positions."""
    return _index(spark, sf_dir).select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


def index_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all terms in all documents."""
    n = table(spark, sf_dir, "documents").count()
    return memory.tf_idf(_index(spark, sf_dir), "doc_id", n).select("term", "doc_id", "df", F.round("weight", 6).alias("weight"))


def index_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have all of some terms."""
    return memory.with_all_terms(_index(spark, sf_dir), "doc_id", ["the", "and", "of"])


def index_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent terms of every document."""
    return memory.top_terms(_index(spark, sf_dir), "doc_id", 3)


def index_substring_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping occurrences of a string in every whole document."""
    return documents(spark, sf_dir).select("id", T.overlapping(F.col("body"), "enen").cast("long").alias("n"))


def index_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of the documents that each word of the conversations, with an ending, begins with."""
    known, asked = (table(spark, sf_dir, t).select(F.explode(T.alnum_words(F.col("text"))).alias("word")).distinct() for t in ("documents", "conversations"))
    return memory.longest_prefix(known.withColumnRenamed("word", "term"), asked.select(F.concat("word", F.lit("-x")).alias("word")))


_WORDS = r"w AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM documents))"
QUERIES |= {f.__name__: f for f in (index_postings, index_tf_idf, index_all_terms, index_top_terms, index_substring_count, index_longest_prefix)}
SQL |= {
    "index_postings": f"WITH {_WORDS} SELECT term, doc_id, count(*) AS tf, min(pos) AS first, max(pos) AS last FROM w GROUP BY ALL",
    "index_tf_idf": f"WITH {_WORDS}, c AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term) SELECT term, doc_id, df, round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS weight FROM c JOIN f USING (term)",
    "index_all_terms": f"WITH {_WORDS} SELECT doc_id FROM w WHERE term IN ('the', 'and', 'of') GROUP BY doc_id HAVING count(DISTINCT term) = 3",
    "index_top_terms": f"WITH {_WORDS}, c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM c) SELECT doc_id, rank, term, tf FROM r WHERE rank <= 3",
    # Overlapping "enen" are the runs of "en", one less than each run is long.
    "index_substring_count": "SELECT doc_id AS id, coalesce(list_sum(list_transform(regexp_extract_all(text, '(?:en){2,}'), lambda x: length(x) // 2 - 1)), 0)::BIGINT AS n FROM documents",
    "index_longest_prefix": r"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) || '-x' AS word FROM conversations), p AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda n: substr(word, 1, n))) AS prefix FROM w) SELECT word, arg_max(prefix, length(prefix)) AS prefix FROM p JOIN t ON term = prefix GROUP BY word",
}


# ---------------------------------------------------------------- pipeline language


def _catalog(spark: SparkSession, sf_dir: str) -> compiler.Catalog:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("props").alias("body"), "event_type", "value", "user_id")
    facts = table(spark, sf_dir, "nation").select(F.lit("in_region").alias("predicate"), F.col("n_name").alias("subject"), F.col("n_regionkey").cast("string").alias("object"), F.lit(1.0).alias("confidence"))
    return compiler.Catalog(spark, {"documents": documents(spark, sf_dir), "events": events, "facts": facts})


_PROGRAMS = {
    "dsl_match": ('FROM documents\nMATCH kind == "en"\nWHERE source != "src0"\nSORT BY id DESC\nLIMIT 50', ["id", "kind", "source"], "SELECT doc_id AS id, lang AS kind, source FROM documents WHERE lang = 'en' AND source <> 'src0' ORDER BY doc_id DESC LIMIT 50"),
    "dsl_conditions": ('from events\nfilter value >= 50 and (event_type == "click" or event_type == "view")\nwhere not user_id < 10\n', ["id", "event_type", "user_id"], "SELECT event_id AS id, event_type, user_id FROM events WHERE value >= 50 AND event_type IN ('click', 'view') AND NOT user_id < 10"),
    "dsl_wildcard": ("FROM documents\nMATCH source == 'src1*'\n", ["id", "source"], "SELECT doc_id AS id, source FROM documents WHERE source LIKE 'src1%'"),
    "dsl_timeline": ('FROM events\nMATCH event_type == "purchase"\nTIMELINE FROM "2024-01-10" TO "2024-01-20"\n', ["id", "ts"], "SELECT event_id AS id, ts FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 50"),
    "dsl_store_load": ('FROM events\nMATCH value > 90\nSTORE AS high\nLOAD high\nMATCH event_type == "error"\n', ["id", "event_type"], "SELECT event_id AS id, event_type FROM events WHERE value > 90 AND event_type = 'error'"),
    "dsl_infer": ("FROM facts\nINFER in_region\n", ["subject", "object"], "SELECT n_name AS subject, n_regionkey::VARCHAR AS object FROM nation"),
    "dsl_classify": ("FROM documents\nCLASSIFY AS report\n", ["id", "class", "category"], None),
}


def _program(name: str, program: str, columns: list[str], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compiler.compile_program(program, _catalog(spark, sf_dir))[-1].select(*columns)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


for _name, (_text, _columns, _sql) in _PROGRAMS.items():
    _program(_name, _text, _columns, _sql)
SQL["dsl_classify"] = SQL["text_classify"].replace("0.001", "0.3").replace("SELECT doc_id, CASE WHEN best", "SELECT doc_id AS id, 'report' AS class, CASE WHEN best").replace("AS label, CASE WHEN best >= 0.3 THEN round(best, 9) ELSE 0.0 END AS confidence", "AS category")


def dsl_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How documents go with a text."""
    found = compiler.compile_program('FROM documents\nCORRELATE WITH "the and of to in is"\n', _catalog(spark, sf_dir))[-1]
    return found.select("id", F.round("similarity", 6).alias("similarity"), "correlation")


QUERIES["dsl_correlate"] = dsl_correlate
SQL["dsl_correlate"] = rf"""
    WITH {DOCS}, w AS (SELECT id, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')) AS term FROM d), c AS (SELECT id, term, count(*)::DOUBLE AS w FROM w GROUP BY ALL),
    s AS (SELECT id, sum(CASE WHEN term IN ('the', 'and', 'of', 'to', 'in', 'is') THEN w ELSE 0 END) / (sqrt(sum(w * w)) * sqrt(6)) AS s FROM c GROUP BY id)
    SELECT d.id, round(coalesce(s, 0), 6) AS similarity, CASE WHEN coalesce(s, 0) > 0.85 THEN 'strong' WHEN coalesce(s, 0) > 0.6 THEN 'moderate' WHEN coalesce(s, 0) > 0.3 THEN 'weak' ELSE 'none' END AS correlation FROM d LEFT JOIN s USING (id)"""
