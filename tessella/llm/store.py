"""Shared storage that the operators of this subpackage cut lineage with.

Intermediate tables go below the folder named by ``spark.checkpoint.dir``, the
one place that driver and executors share. Only where that setting is absent
(unit tests on a bare local session) a temporary folder is set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessella-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path of this run in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessella/{kind}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's (FileSystem, Path class) for a path, on the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path; a session that has ended already leaves it to the cluster's cleaner."""
    if spark.sparkContext._jsc is None:
        return
    try:
        fs, at = file_system(spark, path)
        fs.delete(at(path), True)
    except (OSError, RuntimeError):
        return
    except Exception as e:  # py4j wraps whatever the gateway raises while it shuts down
        if "Py4J" not in type(e).__name__:
            raise


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors cost no recomputation of what lies above."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored = path
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """As ``written``; shuffle files of the write go when it ends, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return written(df, kind)
    finally:
        conf.set(_CLEANUP, before)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``written`` or ``kept`` returned and nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._stored)


_CELLS = 4096


def ranged(df: DataFrame, key: str, range_rows: int, most_ranges: int = 20_000) -> tuple[DataFrame, int]:
    """Deal rows to partitions by ranges of a long key: adds ``range``, ascending with the key, and returns the number of ranges too.

    The ranges depend on the keys alone, not on a sample or on how the input is
    split. Keys are counted in cells of their leading bits; a cell with more
    than range_rows rows is counted again with more bits, until it is small or
    one key. Neighbouring cells are packed to ranges of about range_rows rows,
    at most some 20,000 of them. Null keys are in the first range.
    """
    spark = df.sparkSession
    low, high, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
    rows = max(range_rows, n // most_ranges)
    if low is None:
        return df.withColumn("range", F.lit(0)).repartitionById(1, "range"), 1
    shift = 0
    while (high >> shift) - (low >> shift) >= _CELLS:
        shift += 1
    keys = df.select(F.col(key).alias("key")).where(F.col(key).isNotNull())
    cell = F.struct(F.lit(shift).alias("shift"), F.shiftright("key", shift).alias("cell"))
    keys = keys.select("key", cell.alias("at"))
    refined, done = [], []
    while True:
        counts = [(r.at.shift, r.at.cell, r.n) for r in keys.groupBy("at").agg(F.count("*").alias("n")).collect()]
        heavy = [(s, c, max(1, min(s, (4 * k // rows).bit_length()))) for s, c, k in counts if k > rows and s]
        split = {(s, c) for s, c, _ in heavy}
        done += [(c << s, s, c, k) for s, c, k in counts if (s, c) not in split]
        if not heavy:
            break
        table = spark.createDataFrame(heavy, "shift int, cell long, bits int")  # a row for each range at most
        refined.append(table)
        keys = keys.join(F.broadcast(table), (keys.at["shift"] == table["shift"]) & (keys.at["cell"] == table["cell"])).select("key", F.struct((keys.at["shift"] - table.bits).alias("shift"), F.expr("shiftright(key, at.shift - bits)").alias("cell")).alias("at"))
    places, number, held = [], 0, 0
    for _, s, c, k in sorted(done):
        if held and held + k > rows:
            number, held = number + 1, 0
        places.append((s, c, number))
        held += k
    dealt = df.withColumn("_shift", F.lit(shift)).withColumn("_cell", F.shiftright(key, shift))
    for table in refined:
        table = table.select(F.col("shift").alias("_s"), F.col("cell").alias("_c"), F.col("bits").alias("_b"))
        dealt = dealt.join(F.broadcast(table), (F.col("_shift") == F.col("_s")) & (F.col("_cell") == F.col("_c")), "left")
        dealt = dealt.withColumn("_shift", F.col("_shift") - F.coalesce("_b", F.lit(0))).withColumn("_cell", F.expr(f"shiftright(`{key}`, _shift)")).drop("_s", "_c", "_b")
    table = spark.createDataFrame(places, "_s int, _c long, range int")
    dealt = dealt.join(F.broadcast(table), (F.col("_shift") == F.col("_s")) & (F.col("_cell") == F.col("_c")), "left")
    dealt = dealt.withColumn("range", F.coalesce("range", F.lit(0))).drop("_s", "_c", "_shift", "_cell")
    return dealt.repartitionById(number + 1, "range"), number + 1


def commit(fs, temporary: str, final: str) -> None:
    """Give a finished file its name. Another attempt's file of the same size there already is this file: its bytes depend on its rows alone."""
    try:
        fs.move(temporary, final)
    except OSError:
        there, own = fs.get_file_info([final, temporary])
        if not there.is_file or there.size != own.size:
            raise
        fs.delete_file(temporary)
