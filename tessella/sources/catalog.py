"""Named sources and stores: key-value tables, objects and links, virtual folders, files, listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


class Drivers:
    """Capabilities by name: functions that open a DataFrame."""

    def __init__(self):
        self._by_name: dict[str, tuple[set[str], Callable[..., DataFrame]]] = {}

    def register(self, name: str, capabilities: set[str], execute: Callable[..., DataFrame]) -> None:
        if name in self._by_name:
            raise ValueError(f"a driver is named {name!r} already")
        self._by_name[name] = (set(capabilities), execute)

    def find(self, capability: str) -> list[str]:
        return sorted(n for n, (c, _) in self._by_name.items() if capability in c)

    def execute(self, capability: str, *args, **options) -> DataFrame:
        names = self.find(capability)
        if not names:
            raise KeyError(f"no driver can {capability}")
        return self._by_name[names[0]][1](*args, **options)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, data, base64) of files, by Spark's binary reader."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("data"), F.base64("content").alias("base64"))


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    system, at = _located(spark, path)
    return system.exists(at)


def write_file(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> str:
    """Write bytes that the driver holds as one file of any file system that Spark reads, and return its path."""
    system, at = _located(spark, path)
    out = system.create(at, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def standard(spark: SparkSession) -> Drivers:
    """Drivers for Spark's file formats, tables and SQL databases."""
    out = Drivers()
    for fmt in ("parquet", "orc", "json", "csv", "text"):
        out.register(fmt, {f"read_{fmt}"}, lambda path, schema=None, fmt=fmt, **options: (spark.read.schema(schema) if schema else spark.read).options(**options).format(fmt).load(path))
    out.register("filesystem", {"read_file", "list_dir", "file_metadata"}, lambda path, pattern="*": files(spark, path, pattern))
    out.register("table", {"read_table"}, lambda name: spark.table(name))
    out.register("jdbc", {"read_jdbc"}, lambda **options: spark.read.format("jdbc").options(**options).load())
    return out


def kv_load(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("key") == key)


def kv_exists(table: DataFrame, key: str) -> DataFrame:
    """(exists): one row."""
    return kv_load(table, key).limit(1).agg((F.count("*") > 0).alias("exists"))


def kv_list(table: DataFrame, prefix: str) -> DataFrame:
    return table.where(F.col("key").startswith(prefix)).select("key").orderBy("key")


def kv_store(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows put in the place of those with their keys."""
    return table.join(rows, "key", "left_anti").unionByName(rows)


def kv_delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, "key", "left_anti")


def objects_of_kind(objects: DataFrame, kind: str) -> DataFrame:
    return objects.where(F.col("kind") == kind)


def objects_with_label(objects: DataFrame, part: str) -> DataFrame:
    return objects.where(F.lower("label").contains(part.lower()))


def links_of(links: DataFrame, subject) -> DataFrame:
    """Links that a subject is either end of."""
    return links.where((F.col("source_id") == F.lit(subject)) | (F.col("target_id") == F.lit(subject)))


def unlink(links: DataFrame, source, target) -> DataFrame:
    return links.where(~((F.col("source_id") == F.lit(source)) & (F.col("target_id") == F.lit(target))))


def listing(rows: DataFrame, order: str, key: str, limit: int = 100) -> DataFrame:
    """The newest rows."""
    return rows.orderBy(F.desc(order), key).limit(limit)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with the same key; of several new ones the last by its other columns holds."""
    one = rows.groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(key, "r.*").select(*rows.columns)
    return table.join(one, key, "left_anti").unionByName(one)


def folder(paths: DataFrame, at: str) -> DataFrame:
    """(name, entries): the next segment of the paths below a virtual folder."""
    prefix = at.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    rows = paths.where(F.col("path").startswith(prefix))
    return rows.select(F.substring_index(rest, "/", 1).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("entries"))


def renamed(paths: DataFrame, old: str, new: str) -> DataFrame:
    """Paths below a virtual folder, moved."""
    moved = F.concat(F.lit(new.rstrip("/")), F.expr(f"substring(path, {len(old.rstrip('/')) + 1})"))
    return paths.withColumn("path", F.when((F.col("path") == old.rstrip("/")) | F.col("path").startswith(old.rstrip("/") + "/"), moved).otherwise(F.col("path")))


def exported(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write rows in a format of Spark's and return the path."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def kinds(objects: DataFrame) -> DataFrame:
    """Distinct kinds in order."""
    return objects.select("kind").distinct().orderBy("kind")
