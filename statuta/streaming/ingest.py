"""Continuous ingest with insert-if-absent (ST1, ST2, ST3).

The original re-crawls in an endless loop and checks each document against the
stored table before inserting.  Here landed files are a Structured Streaming file
source; each micro-batch goes through ``foreachBatch`` into the parquet sink with
the batch-level insert-if-absent of ``store.py``:

* resume after restart = the streaming checkpoint (replaces the bookmark table);
* a replayed micro-batch (crash between sink write and commit) appends nothing,
  because its keys are already stored -- the sink stays exactly-once;
* no unbounded dedup state: the sink itself is the state, probed with an anti
  join by key digest in the partitions that a batch touches, instead of
  ``dropDuplicates`` without a watermark;
* a micro-batch takes many files, so ``order_cols`` must tell which row came first.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statuta.operators import store as S
from statuta.session import row_bytes

#: Bytes of a micro-batch's rows to a shuffle partition.
PARTITION_BYTES = 64 << 20


def land(df: DataFrame, landing_dir: str) -> None:
    """Land one batch of rows as new files in the landing folder (tests, replays)."""
    df.write.mode("append").parquet(landing_dir)


def shuffle_partitions(batch: DataFrame, least: int) -> int:
    """Partitions whose share of a batch does not grow with it."""
    size = batch.agg(F.sum(row_bytes(batch))).first()[0] or 0
    return max(least, -(-size // PARTITION_BYTES))


def insert_if_absent_stream(spark: SparkSession, landing_dir: str, schema: StructType,
                            sink_path: str, checkpoint: str, key_cols: list[str],
                            order_cols: list[str], available_now: bool = True,
                            processing_time: str | None = None, files_per_trigger: int = 1000):
    """Start the ingest query; with ``available_now`` it processes what has landed and
    stops (returns after termination), otherwise it runs on ``processing_time``."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # nothing coalesces or splits the shuffles of a micro-batch: their tasks' share is set here
        batch.sparkSession.conf.set("spark.sql.shuffle.partitions", shuffle_partitions(batch, least))
        S.append_if_absent(batch.sparkSession, sink_path, batch, key_cols, order_cols)

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(landing_dir))
    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return w.trigger(processingTime=processing_time or "30 seconds").start()
