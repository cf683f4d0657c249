"""Statements to lazy DataFrames, and the fluent builder with the same verbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions import text as T
from tessella.operators import aitext, graph, reasoning, search
from tessella.plans import dsl

TIMELINE_ROWS = 50
SIMILAR_LEAST = 0.8
_BANDS = ((0.85, "strong"), (0.6, "moderate"), (0.3, "weak"))


class Catalog:
    """Sources by name, edges for TRAVERSE, rules for INFER, and where STORE and EXPORT write."""

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame] | None = None, edges: DataFrame | None = None, rules: dict[str, list[reasoning.Rule]] | None = None, key: str = "id", text: str = "body", time: str = "ts", root: str | None = None):
        self.spark, self.sources, self.edges, self.rules = spark, dict(sources or {}), edges, dict(rules or {})
        self.key, self.text, self.time, self.root = key, text, time, root

    def open(self, name: str) -> DataFrame:
        if name in self.sources:
            return self.sources[name]
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise KeyError(f"no source is named {name!r}")


def _side(value: object, df: DataFrame) -> Column:
    return F.col(value.text) if isinstance(value, dsl.Name) and value.text.split(".")[0] in df.columns else F.lit(value.text if isinstance(value, dsl.Name) else value)


def condition(c: object, df: DataFrame) -> Column:
    """A boolean column; ``*`` in a compared text stands for any characters."""
    if c is None:
        return F.lit(True)
    if isinstance(c, dsl.Negation):
        return ~condition(c.part, df)
    if isinstance(c, dsl.Junction):
        parts = [condition(p, df) for p in c.parts]
        return reduce((lambda a, b: a & b) if c.op == "AND" else (lambda a, b: a | b), parts)
    left, right = _side(c.left, df), _side(c.right, df)
    if isinstance(c.right, str) and "*" in c.right and c.op in ("==", "!="):
        pattern = c.right.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        return left.like(pattern) if c.op == "==" else ~left.like(pattern)
    if c.right is None or c.left is None:
        same = left.eqNullSafe(right)
        return same if c.op == "==" else ~same
    return {"==": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}[c.op]


class Pipeline:
    """A current DataFrame and the verbs that change it; every verb returns a new pipeline."""

    def __init__(self, catalog: Catalog, df: DataFrame):
        self.catalog, self.df = catalog, df

    def _with(self, df: DataFrame) -> Pipeline:
        return Pipeline(self.catalog, df)

    def where(self, c: object) -> Pipeline:
        """Rows for which a condition holds: a Column, a text in the language, or a parsed condition."""
        if isinstance(c, str):
            c = dsl.Parser(c)._or()
        return self._with(self.df.where(c if isinstance(c, Column) else condition(c, self.df)))

    def traverse(self, relation: str, depth: int = 1) -> Pipeline:
        """Rows of the pipeline's source that are within depth hops of its rows over edges of this kind, the start rows left out."""
        if self.catalog.edges is None:
            raise ValueError("TRAVERSE needs edges")
        key = self.catalog.key
        edges = self.catalog.edges.where(F.col("kind") == relation) if relation != "*" else self.catalog.edges
        pairs = graph.both_ways(edges.select("src", "dst"))
        start = self.df.select(F.col(key).alias("node")).distinct()
        seen, frontier = start, start
        for _ in range(depth):
            frontier = pairs.join(frontier, pairs.src == frontier.node).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
            frontier = graph.cut(frontier)
            seen = seen.unionByName(frontier)
        reached = seen.join(start, "node", "left_anti")
        return self._with(reached.withColumnRenamed("node", key))

    def summarize(self, most: int = 5) -> Pipeline:
        return self._with(aitext.summaries(self.df, self.catalog.key, self.catalog.text, most))

    def classify(self, label: str) -> Pipeline:
        """Adds class, the label asked for, and category and confidence by keywords."""
        return self._with(T.classified(self.df, self.catalog.text).withColumn("class", F.lit(label)))

    def infer(self, rule: str) -> Pipeline:
        """Conclusions of a named rule set over the facts in the pipeline, or the facts with this predicate."""
        if rule in self.catalog.rules:
            return self._with(reasoning.chain(self.df, self.catalog.rules[rule]))
        return self._with(self.df.where(F.col("predicate") == rule))

    def _scored(self, text: str) -> DataFrame:
        """Adds similarity: the cosine of the rows' word counts to those of a text."""
        own = self.df.select(F.col(self.catalog.key).alias("id"), F.explode(T.alnum_words(F.col(self.catalog.text))).alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("w"))
        asked = self.df.sparkSession.range(1).select(F.explode(T.alnum_words(F.lit(text))).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("v"))
        size = asked.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
        norms = own.join(F.broadcast(asked), "term", "left").groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("dot"))
        scored = norms.join(F.broadcast(size)).select(F.col("id").alias("_id"), F.when((F.col("norm") > 0) & (F.col("size") > 0), F.col("dot") / (F.col("norm") * F.col("size"))).otherwise(0.0).alias("similarity"))
        return self.df.join(scored, self.df[self.catalog.key] == scored["_id"], "left").drop("_id").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))

    def similar(self, text: str, least: float = SIMILAR_LEAST, most: int = 20) -> Pipeline:
        scored = self._scored(text)
        return self._with(scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), self.catalog.key).limit(most))

    def correlate(self, target: str) -> Pipeline:
        """Adds similarity and correlation (strong, moderate, weak, none) to a text."""
        label = F.lit("none")
        for least, name in reversed(_BANDS):
            label = F.when(F.col("similarity") > least, name).otherwise(label)
        return self._with(self._scored(target).withColumn("correlation", label))

    def timeline(self, start: str | None = None, end: str | None = None, most: int = TIMELINE_ROWS) -> Pipeline:
        """Rows in time order within the bounds, both included."""
        df, ts = self.df, F.col(self.catalog.time)
        if start is not None:
            df = df.where(ts >= F.lit(start).cast(df.schema[self.catalog.time].dataType))
        if end is not None:
            df = df.where(ts <= F.lit(end).cast(df.schema[self.catalog.time].dataType))
        return self._with(df.orderBy(self.catalog.time, self.catalog.key).limit(most))

    def search(self, query: object, limit: int | None = None) -> Pipeline:
        """Scored rows of a search query; the source needs the columns of search documents."""
        return self._with(search.Search(self.df, edges=self.catalog.edges).run(query, limit))

    def collect(self, name: str) -> Pipeline:
        """A pipeline of another source."""
        return source(self.catalog, name)

    def observe(self) -> Pipeline:
        """The rows as they are, with the time and fingerprint of what was seen."""
        return self._with(self.df.withColumn("fingerprint", F.sha2(F.col(self.catalog.text).cast("string"), 256)))

    def resolve(self, query: object) -> Pipeline:
        """Rows of the source that a search query matches, scores joined."""
        found = search.Search(self.df, edges=self.catalog.edges).run(query)
        return self._with(self.df.join(found, self.catalog.key))

    def snapshot(self, kind: str = "full") -> Pipeline:
        """A row that describes the current rows: their kind, number and columns."""
        count = self.df.agg(F.count("*").alias("rows"))
        return self._with(count.select(F.lit(kind).alias("kind"), "rows", F.lit(",".join(self.df.columns)).alias("columns")))

    def sort(self, by: str, descending: bool = False) -> Pipeline:
        return self._with(self.df.orderBy(F.desc(by) if descending else F.asc(by), *([self.catalog.key] if self.catalog.key in self.df.columns and by != self.catalog.key else [])))

    def limit(self, n: int) -> Pipeline:
        return self._with(self.df.limit(n))

    def store(self, name: str) -> Pipeline:
        """Name the current rows as a source, written below the catalog's root if it has one."""
        if self.catalog.root:
            path = f"{self.catalog.root}/{name}"
            self.df.write.mode("overwrite").parquet(path)
            self.catalog.sources[name] = self.df.sparkSession.read.parquet(path)
        else:
            self.catalog.sources[name] = self.df
        return self

    def export(self, fmt: str) -> Pipeline:
        """Write the current rows below the catalog's root in a format of Spark's."""
        if not self.catalog.root:
            raise ValueError("EXPORT needs a root to write below")
        self.df.write.mode("overwrite").format(fmt).save(f"{self.catalog.root}/export-{fmt}")
        return self


def source(catalog: Catalog, name: str) -> Pipeline:
    return Pipeline(catalog, catalog.open(name))


def compile_program(program: str, catalog: Catalog) -> list[DataFrame]:
    """A lazy DataFrame for each pipeline of a program; the last is its result."""
    done: list[Pipeline] = []
    for s in dsl.parse(program):
        if s.verb == "from":
            done.append(source(catalog, s.args["source"]))
            continue
        if not done:
            raise dsl.SyntaxProblem(f"{s.verb} comes before any source")
        p = done[-1]
        if s.verb == "where":
            p = p.where(F.lit(True) if s.args["condition"] is None else s.args["condition"])
        elif s.verb in ("similar", "correlate", "classify", "store"):
            p = getattr(p, s.verb)(s.args["target"])
        elif s.verb == "infer":
            p = p.infer(s.args["rule"])
        elif s.verb == "export":
            p = p.export(s.args["format"])
        else:
            p = getattr(p, s.verb)(**s.args)
        done[-1] = p
    return [p.df for p in done]
