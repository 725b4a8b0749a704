"""Change logs as streams: the keyed table of the last writes, kept up by micro-batches.

No event time is needed; this is the streaming form of
operators.keyed.upsert.  Every micro-batch is reduced to its last write per key,
merged with the table of the batch before, and written as a new version; a batch that is
run again after a failure writes the same version, so the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_writes(log: DataFrame, key: str, sequence: str) -> DataFrame:
    values = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*values), F.col(sequence)).alias("last")).select(key, "last.*")


def version(spark, folder: str, n: int) -> DataFrame:
    """The table after micro-batch n; a version that is missing or damaged is an error, not an empty table."""
    return spark.read.parquet(f"{folder}/v={n}")


def forget(spark, folder: str, n: int) -> None:
    """Removes version n, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={n}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def start_upserts(stream: DataFrame, key: str, sequence: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps ``folder``/v=N up to date, N being the micro-batch."""

    def merge(batch: DataFrame, n: int) -> None:
        before = version(batch.sparkSession, folder, n - 1) if n else None
        log = batch if before is None else before.unionByName(batch)
        last_writes(log, key, sequence).write.mode("overwrite").parquet(f"{folder}/v={n}")
        if n > 1:
            forget(batch.sparkSession, folder, n - 2)  # the version before is kept, for a batch that runs again

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
