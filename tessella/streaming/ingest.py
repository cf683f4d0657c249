"""Append-only logs by micro-batches, and catching up with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.operators import events


def catch_up(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 1000) -> DataFrame:
    """A stream of what is appended to a Parquet folder; offsets are in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, check: bool = True) -> StreamingQuery:
    """Append each micro-batch to a folder of its own, so that a batch that runs again replaces itself; versions are checked against what is stored.

    The last version of each aggregate after a batch is a table below
    ``_versions``, which readers of the folder skip. A batch reads the newest one
    before it, so it never reads the log again, and removes those that are older
    than that: the newest and the one before are kept for a batch that runs again.
    """

    versions = f"{path}/_versions"

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}"
        spark = batch.sparkSession
        if not check:
            batch.write.mode("overwrite").parquet(target)
            return
        own = batch.select("aggregate_id", "version")
        stored = spark.read.schema(own.schema).parquet(f"{versions}/batch={number - 1}") if number else own.limit(0)
        bad = events.conflicts(stored, batch).first()
        if bad is not None:
            raise events.VersionConflict(f"version {bad.version} of {bad.aggregate_id} does not follow the stored ones")
        batch.write.mode("overwrite").parquet(target)
        events.latest_versions(stored.unionByName(own)).write.mode("overwrite").parquet(f"{versions}/batch={number}")
        if number > 1:
            _remove(spark, f"{versions}/batch={number - 2}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
