"""Knowledge, reasoning, decision, processor and relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import text as T
from tessella.operators import decision, knowledge, reasoning
from tessella.processors import measures, pages, registry as processors
from tessella.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def knowledge_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge records."""
    found = knowledge.ingest(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang"))
    return found.select("id", "fingerprint", "kind", F.sha2("canonical_form", 256).alias("canonical"), "version")


def knowledge_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second versions of the orders' customers, one for each status they had."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus").distinct()
    records = rows.groupBy("id").agg(F.count("*").cast("int").alias("version"))
    revisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("content"))
    return knowledge.revise(records, revisions)


def knowledge_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once."""
    return knowledge.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def knowledge_keep_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with copies linked to the first."""
    found = knowledge.resolve_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "keep_linked")
    return found.select("doc_id", F.coalesce("linked_to", F.lit(-1)).alias("linked_to"))


def knowledge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copies with their number of copies."""
    return knowledge.resolve_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "merge").select("doc_id", "copies")


def knowledge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers of a segment and nation, the one with the highest balance."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("content"), "c_acctbal")
    return knowledge.resolve_duplicates(rows, "c_custkey", "content", "replace_if_higher", "c_acctbal").select("c_custkey")


def knowledge_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations by alias."""
    aliases = table(spark, sf_dir, "nation").select(F.lit("nation").alias("namespace"), F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("entity_id"))
    asked = table(spark, sf_dir, "customer").select(F.lit("nation").alias("namespace"), F.col("c_nationkey").cast("string").alias("value")).distinct()
    return knowledge.resolve(aliases, asked)


def knowledge_resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their first letter lost, resolved within two edits."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    aliases = rows.select(F.lit("segment").alias("namespace"), F.col("c_mktsegment").alias("value"), F.col("c_mktsegment").alias("entity_id"))
    asked = rows.select(F.lit("segment").alias("namespace"), F.expr("substring(c_mktsegment, 2)").alias("value"))
    return knowledge.resolve_fuzzy(aliases, asked, 2)


def knowledge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as versions, each with the one before and after."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version")).distinct()
    return knowledge.version_chains(rows).select("id", "version", F.coalesce("previous_version", F.lit(0)).alias("previous"), F.coalesce("next_version", F.lit(0)).alias("next"))


def knowledge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined and decayed confidences of parts by their size and price."""
    a, b = F.col("p_size") / 50, F.col("p_retailprice") / 3000
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 9).alias(n) for n, c in (("both", knowledge.combine_and(a, b)), ("either", knowledge.combine_or(a, b)), ("weighted", knowledge.combine_weighted(a, b, 0.7)), ("decayed", knowledge.decay(a, 0.9, F.col("p_size"))))))


def knowledge_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that any of a brand's findings holds."""
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 500).alias("c"))
    return knowledge.any_of_group(rows, "p_brand", "c").select("p_brand", F.round("confidence", 9).alias("confidence"))


def reason_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in regions, from customers in nations and nations in regions."""
    nations = table(spark, sf_dir, "nation").select(F.lit("in").alias("predicate"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("subject"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("object"), F.lit(1.0).alias("confidence"))
    customers = table(spark, sf_dir, "customer").select(F.lit("in"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit(1.0))
    rule = reasoning.Rule("transitive", (reasoning.Pattern("in", "$X", "$Y"), reasoning.Pattern("in", "$Y", "$Z")), reasoning.Pattern("in", "$X", "$Z"), 0.9)
    return reasoning.chain(nations.union(customers), [rule])


QUERIES |= {f.__name__: f for f in (knowledge_ingest, knowledge_revise, knowledge_exact_duplicates, knowledge_keep_linked, knowledge_merge, knowledge_replace, knowledge_resolve, knowledge_resolve_fuzzy, knowledge_versions, knowledge_confidence, knowledge_any_of, reason_chain)}
_FIRST = "f AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS copies FROM documents)"
SQL |= {
    "knowledge_ingest": r"SELECT doc_id AS id, sha256(text) AS fingerprint, lang AS kind, sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '))) AS canonical, 1 AS version FROM documents",
    "knowledge_revise": "WITH v AS (SELECT o_custkey AS k, count(DISTINCT o_orderstatus) AS v FROM orders GROUP BY 1) SELECT k || '-v' || (v + 1) AS id, k AS previous_id, (v + 1)::INT AS version, c_mktsegment AS content FROM v JOIN customer ON c_custkey = k",
    "knowledge_exact_duplicates": "SELECT sha256(text) AS fingerprint, max(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "knowledge_keep_linked": f"WITH {_FIRST} SELECT doc_id, CASE WHEN doc_id <> first THEN first ELSE -1 END AS linked_to FROM f",
    "knowledge_merge": f"WITH {_FIRST} SELECT doc_id, copies FROM f WHERE doc_id = first",
    "knowledge_replace": "SELECT arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey FROM customer GROUP BY c_mktsegment, c_nationkey",
    "knowledge_resolve": "SELECT DISTINCT 'nation' AS namespace, c_nationkey::VARCHAR AS value, n_name AS entity_id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "knowledge_resolve_fuzzy": "WITH s AS (SELECT DISTINCT c_mktsegment AS s FROM customer), p AS (SELECT substr(a.s, 2) AS value, b.s AS entity_id, levenshtein(substr(a.s, 2), b.s) AS distance FROM s a, s b) SELECT 'segment' AS namespace, value, arg_min(entity_id, (distance, entity_id)) AS entity_id, min(distance)::INT AS distance FROM p WHERE distance <= 2 GROUP BY value",
    "knowledge_versions": "SELECT id, version, coalesce(lag(version) OVER w, 0) AS previous, coalesce(lead(version) OVER w, 0) AS next FROM (SELECT DISTINCT l_orderkey AS id, l_linenumber AS version FROM lineitem) WINDOW w AS (PARTITION BY id ORDER BY version)",
    "knowledge_confidence": "WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS a, p_retailprice / 3000 AS b, p_size FROM part) SELECT p_partkey, round(least(a * b, 1), 9) AS both, round(least(a + b - a * b, 1), 9) AS either, round(least(a * 0.7::DOUBLE + b * (1 - 0.7::DOUBLE), 1), 9) AS weighted, round(least(a * pow(0.9::DOUBLE, p_size), 1), 9) AS decayed FROM p",
    "knowledge_any_of": "SELECT p_brand, round(1 - exp(sum(ln(1 - p_size / 500.0::DOUBLE))), 9) AS confidence FROM part GROUP BY 1",
    "reason_chain": "SELECT 'in' AS predicate, 'c' || c_custkey AS subject, 'r' || n_regionkey AS object, 0.9::DOUBLE AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey",
}


# ---------------------------------------------------------------- decisions


def decide_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by their orders and customers."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    kinds = rows.groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n_events"), F.count_distinct("c_custkey").alias("n_links"))
    return decision.impact(kinds).select("kind", "n_events", "n_links", F.round("score", 9).alias("score"))


def decide_risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as kinds of risk; errors count as findings."""
    kind = F.when(F.col("event_type") == "error", "finding").when(F.col("event_type") == "view", "monitoring").otherwise(F.col("event_type"))
    kinds = table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg((F.count("*") % 7).alias("n_events"), F.lit(0).alias("n_links"))
    return decision.risky(kinds).select("kind", F.round("score", 9).alias("score"))


def decide_investigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line names."""
    objects = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("label"))
    looked_at = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").cast("string").alias("title")).distinct()
    return decision.to_investigate(objects, looked_at).select("p_partkey")


def decide_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts like part 1, by type and name."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split("p_type", " ")).alias("label_words"), F.array_distinct(F.split("p_name", " ")).alias("words"))
    return decision.what_is_similar(rows, 1).select("id", F.round("score", 9).alias("score"))


def decide_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is behind user 5: its first events and the links of its nation."""
    from tessella.queries.timelines import store

    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target_id"))
    return decision.why(store(spark, sf_dir), links, "5").select("evidence", "detail")


QUERIES |= {f.__name__: f for f in (decide_impact, decide_risky, decide_investigate, decide_similar, decide_why)}
SQL |= {
    "decide_impact": "SELECT c_mktsegment AS kind, count(*) AS n_events, count(DISTINCT c_custkey) AS n_links, round(least(1.0::DOUBLE, 0.3 + ln(1 + count(*)) / 10 + ln(1 + count(DISTINCT c_custkey)) / 5), 9)::DOUBLE AS score FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY score DESC, kind LIMIT 10",
    "decide_risky": "WITH k AS (SELECT CASE event_type WHEN 'error' THEN 'finding' WHEN 'view' THEN 'monitoring' ELSE event_type END AS kind, count(*) % 7 AS n FROM events GROUP BY 1) SELECT kind, round(least(1.0::DOUBLE, least(1.0::DOUBLE, 0.3 + ln(1 + n) / 10) * CASE kind WHEN 'finding' THEN 1.5 WHEN 'monitoring' THEN 1.3 ELSE 1 END), 9)::DOUBLE AS score FROM k ORDER BY score DESC, kind LIMIT 10",
    "decide_investigate": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
    "decide_similar": "WITH p AS (SELECT p_partkey AS id, list_distinct(string_split(p_type, ' ')) AS l, list_distinct(string_split(p_name, ' ')) AS w FROM part), s AS (SELECT a.id, 0.4::DOUBLE * (len(list_intersect(a.l, b.l))::DOUBLE / len(list_distinct(a.l || b.l))) + 0.6::DOUBLE * (len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w))) AS score FROM p a, p b WHERE b.id = 1 AND a.id <> 1) SELECT id, round(score, 9) AS score FROM s WHERE score > 0.1 ORDER BY s.score DESC, id LIMIT 10",
    "decide_why": "SELECT * FROM (SELECT 'event' AS evidence, row_number() OVER (ORDER BY ts, event_id) || ':' || CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Updated' END AS detail FROM events WHERE user_id = 5 ORDER BY ts, event_id LIMIT 5) UNION ALL SELECT 'link', c_custkey || '>n' || c_nationkey FROM customer WHERE c_custkey = 5",
}


# ---------------------------------------------------------------- processors


def process_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte measures of every document."""
    found = measures.measures(table(spark, sf_dir, "documents"), "doc_id", "text")
    exact = ["n_bytes", "unique_bytes", "mode_byte", "spanning_bytes", "first_half_sum", "second_half_sum"]
    return found.select("doc_id", *exact, *(F.round(c, 6).alias(c) for c in ("entropy", "redundancy", "mean", "std_dev", "transition_rate", "sparsity", "half_pmi")))


def process_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page by pattern."""
    found = pages.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(found, " ").alias("links"))


def process_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the page processor derives from every page."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("data"), F.lit("text/html").alias("content_type"), F.create_map(F.lit("url"), F.col("url")).alias("metadata"))
    found = processors.process(rows, ["html"])
    return found.where("kind in ('html.title', 'html.heading')").select("id", "kind", "value")


def process_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many processors take each content type."""
    kinds = F.element_at(F.array(*map(F.lit, ("text/html", "image/png", "application/pdf", "text/x-python", "video/mp4"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kinds.alias("content_type"))
    return processors.routes(rows).groupBy("processor").agg(F.count("*").alias("n"))


def process_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a crawl of two domains would take, with host and priority."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url"), pages.domain(F.col("url")).alias("host"), pages.priority(F.col("page_id") % 5).alias("priority"), pages.admitted(F.col("url"), ["example.com", "example.org"]).alias("admitted"))
    return rows.select("page_id", "host", "priority", "admitted")


QUERIES |= {f.__name__: f for f in (process_measures, process_page_links, process_pages, process_routes, process_crawl)}
SQL |= {
    "process_measures": r"""
        WITH b AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
        x AS (SELECT doc_id, n, unnest(range(n)) AS pos, ('0x' || substr(h, 2 * unnest(range(n)) + 1, 2))::INT AS byte FROM b),
        t AS (SELECT *, lag(byte) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM x),
        c AS (SELECT doc_id, n, byte, count(*) AS k, count(*) FILTER (pos < n // 2) AS k1, count(*) FILTER (pos >= n // 2) AS k2, count(*) FILTER (before IS NOT NULL AND before <> byte) AS changes FROM t GROUP BY ALL),
        m AS (SELECT doc_id, any_value(n) AS n, count(*) AS u, -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) AS e, sum(byte * k)::DOUBLE / any_value(n) AS mean, sum(byte::DOUBLE * byte * k) AS squares, arg_max(byte, (k, -byte)) AS mode_byte,
              count(*) FILTER (k > 1) AS spanning, sum(changes) AS changes, sum(byte * k1)::BIGINT AS s1, sum(byte * k2)::BIGINT AS s2,
              coalesce(sum(k / n::DOUBLE * log2((k / n::DOUBLE) / ((k1 / (n // 2)::DOUBLE) * (k2 / (n - n // 2)::DOUBLE)))) FILTER (k1 > 0 AND k2 > 0), 0) AS pmi FROM c GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, u AS unique_bytes, mode_byte, spanning AS spanning_bytes, s1 AS first_half_sum, s2 AS second_half_sum, round(e, 6) AS entropy, round(1 - e / 8, 6) AS redundancy, round(mean, 6) AS mean,
               round(sqrt(greatest(squares / n - mean * mean, 0)), 6) AS std_dev, CASE WHEN n > 1 THEN round(changes / (n - 1)::DOUBLE, 6) ELSE 0 END AS transition_rate, round(1 - least(u, n) / least(256, n)::DOUBLE, 6) AS sparsity, round(pmi, 6) AS half_pmi FROM m""",
    "process_page_links": r"""WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), lambda x: x <> '' AND NOT starts_with(x, '#')) AS l FROM pages) SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM l""",
    "process_pages": r"""
        WITH p AS (SELECT page_id::VARCHAR AS id, 'html.title' AS kind, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS v FROM pages
                   UNION ALL SELECT page_id::VARCHAR, 'html.heading', trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '[ \t\n\r\f\x0B]+', ' ', 'g')) FROM pages)
        SELECT id, kind, replace(regexp_replace(replace(v, '&quot;', '"'), '&amp;?', chr(1), 'g'), chr(1), '&') AS value FROM p WHERE kind = 'html.heading' OR v <> ''""",
    "process_routes": "SELECT p AS processor, count(*) AS n FROM (SELECT unnest(CASE doc_id % 5 WHEN 0 THEN ['html'] WHEN 1 THEN ['images'] WHEN 2 THEN ['pdf'] WHEN 3 THEN ['ast'] ELSE ['video'] END) AS p FROM documents) GROUP BY 1",
    "process_crawl": r"WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages) SELECT page_id, host, CASE WHEN page_id % 5 <= 1 THEN 'high' WHEN page_id % 5 = 2 THEN 'medium' WHEN page_id % 5 = 3 THEN 'low' ELSE 'background' END AS priority, (host = 'example.com' OR host = 'example.org' OR ends_with(host, '.example.com') OR ends_with(host, '.example.org')) AND NOT regexp_matches(url, '\.(jpg|jpeg|png|gif|svg|ico|css|js|woff|woff2|ttf|mp4|mp3|pdf|zip|gz)$') AS admitted FROM h",
}


# ---------------------------------------------------------------- relational surface


def sql_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals by flag and status, through the SQL surface."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tessella_lineitem")
    return spark.sql(_PRICING.format(lineitem="tessella_lineitem"))


_PRICING = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"


def sql_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority with all subtotals."""
    found = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return found.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


def sql_join_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three customers with most spending of every nation."""
    from tessella.operators.graph import rank_within

    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = table(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "c_custkey", "spent")
    return rank_within(rows, "c_nationkey", "spent", 3)


def sql_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the messages by role."""
    words = table(spark, sf_dir, "conversations").select("role", F.explode(T.alnum_words(F.col("text"))).alias("word"))
    return words.groupBy("role").agg(F.count("*").alias("n_words"), F.count_distinct("word").alias("n_distinct"))


QUERIES |= {f.__name__: f for f in (sql_pricing, sql_cube, sql_join_rank, sql_text_search)}
SQL |= {
    "sql_pricing": _PRICING.format(lineitem="lineitem"),
    "sql_cube": "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_join_rank": "WITH s AS (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS rank FROM s) SELECT * FROM r WHERE rank <= 3",
    "sql_text_search": r"WITH w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM conversations) SELECT role, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM w GROUP BY 1",
}


# ---------------------------------------------------------------- encodings and inventories


def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events in canonical form."""
    from tessella.functions import json as J

    return table(spark, sf_dir, "events").select("event_id", J.canonical_json(F.col("props")).alias("canonical"))


def json_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events in base64 and back."""
    return table(spark, sf_dir, "events").select("event_id", F.base64("props").alias("coded"), F.unbase64(F.base64("props")).cast("string").alias("back"))


def text_term_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the words of parts' names and types."""
    from tessella.functions import json as J

    found = J.term_cosine(F.split("p_name", " "), F.concat(F.split("p_type", " "), F.split("p_name", " ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(found, 9).alias("cosine"))


def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-gram vectors of parts' names, by component."""
    from tessella.functions import json as J

    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(J.ngram_embedding(F.col("p_name"))).alias("dim", "value"))
    return rows.select("p_partkey", "dim", F.round(F.col("value").cast("double"), 4).alias("value"))


def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of the first four bytes of parts' names."""
    from tessella.functions import json as J

    return table(spark, sf_dir, "part").select("p_partkey", J.fnv1a_hex(F.substring("p_name", 1, 4)).alias("fnv"))


def _fnv(values: list[str]) -> str:
    """FNV-1a over bytes given as SQL expressions."""
    h = "14695981039346656037::UBIGINT"
    for v in values:
        h = f"((xor({h}, ({v})::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT"
    return h


_GRAMS = " UNION ALL ".join(f"SELECT p_partkey, ({_fnv([f'ascii(substr(p_name, i + {k}, 1))' for k in range(n)])} % 64)::INT AS dim FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - {n} + 2)) AS i FROM part)" for n in range(1, 5))


def inventory_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a crawl from supplier 1 reaches in two steps over lines."""
    from tessella.operators import inventory

    rows = table(spark, sf_dir, "lineitem")
    links = rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("url"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_partkey").alias("position"))
    back = rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_suppkey").alias("position"))
    return inventory.crawl(links.union(back), spark.createDataFrame([("s1",)], "url string"), 2, 1_000_000)


def inventory_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as agents by their last event."""
    from datetime import datetime

    from tessella.operators import inventory

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), "ts")
    return inventory.health(rows, F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz"), 86400).select("agent", "state")


def inventory_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors in order of time."""
    from tessella.operators import inventory

    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), F.col("event_id").alias("source_id"), F.col("props").alias("summary"))
    return inventory.timeline([rows.where("kind = 'purchase'"), rows.where("kind = 'error'")], 500).select("source_id", "kind")


def inventory_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as its processing steps."""
    from tessella.operators import inventory

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), F.col("l_linestatus").alias("actor"), F.col("l_returnflag").alias("action"))
    return inventory.provenance(rows).select("id", F.array_join("steps", ",").alias("steps"))


QUERIES |= {f.__name__: f for f in (json_canonical, json_base64, text_term_cosine, text_embedding, text_fingerprint, inventory_crawl, inventory_health, inventory_timeline, inventory_provenance)}
SQL |= {
    "json_canonical": "SELECT event_id, replace(lower(props), ' ', '') AS canonical FROM events",
    "json_base64": "SELECT event_id, base64(encode(props)) AS coded, props AS back FROM events",
    "text_term_cosine": "WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t, 1 AS a, 1 AS b FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_type, ' ')), 0, 1 FROM part), c AS (SELECT p_partkey, t, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM w GROUP BY ALL) SELECT p_partkey, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 9) AS cosine FROM c GROUP BY 1",
    "text_embedding": f"WITH g AS ({_GRAMS}), c AS (SELECT p_partkey, dim, count(*)::DOUBLE AS n FROM g GROUP BY ALL), s AS (SELECT p_partkey, sqrt(sum(n * n)) AS size FROM c GROUP BY 1), d AS (SELECT p_partkey, size, unnest(range(64))::INT AS dim FROM s) SELECT d.p_partkey, d.dim, round(coalesce(n, 0) / size, 4) AS value FROM d LEFT JOIN c ON c.p_partkey = d.p_partkey AND c.dim = d.dim",
    "text_fingerprint": f"SELECT p_partkey, lower(lpad(to_hex({_fnv([f'ascii(substr(p_name, {k}, 1))' for k in range(1, 5)])}), 16, '0')) AS fnv FROM part",
    "inventory_crawl": "WITH p AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_suppkey = 1) SELECT 's1' AS url, 0 AS depth UNION ALL SELECT 'p' || p, 1 FROM p UNION ALL SELECT DISTINCT 's' || l_suppkey, 2 FROM lineitem WHERE l_partkey IN (SELECT p FROM p) AND l_suppkey <> 1",
    "inventory_health": "SELECT user_id AS agent, CASE WHEN date_diff('second', max(ts), TIMESTAMP '2024-01-31') > 86400 THEN 'silent' ELSE 'healthy' END AS state FROM events GROUP BY 1",
    "inventory_timeline": "SELECT event_id AS source_id, event_type AS kind FROM events WHERE event_type IN ('purchase', 'error') ORDER BY ts, event_id LIMIT 500",
    "inventory_provenance": "SELECT l_orderkey AS id, string_agg(l_linestatus || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_linestatus, l_returnflag) AS steps FROM lineitem GROUP BY 1",
}
