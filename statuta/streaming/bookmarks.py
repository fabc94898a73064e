"""Bookmarks as a keyed stateful stream (MUT4-MUT6).

The original keeps one bookmark per crawler and overwrites it as it goes.  Here set and
clear events are a stream; a ``transformWithState`` operator keeps one value per crawler
(the operation that decides, with its order), and each change is a row of a changelog.
An event that is older than the one in the state arrives late and changes nothing, so
any order of arrival ends in the same bookmarks.  A cleared bookmark stays in the state
with an empty link, so that a late set does not bring it back; ``ttl_ms`` lets go the state
of crawlers that have been silent for so long.

A micro-batch's changes are written into a folder that its number names, so a replayed one
overwrites itself; the bookmarks are the last change of each crawler.
"""
from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Python workers get the operator with their tasks, so they need not import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS = "crawler string, op string, link string, at timestamp, seq long"
CHANGES = "crawler string, link string, at timestamp, seq long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestOperation(StatefulProcessor):
    """State: (at in microseconds, seq, link) of the operation that decides."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bookmark", "at long, seq long, link string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else None
        best = None if held is None else (held[0], held[1])
        link, changed = None, False
        for part in rows:
            at = part["at"].astype("datetime64[us]").astype("int64")
            for micros, seq, op, to in zip(at, part["seq"], part["op"], part["link"]):
                order = (int(micros), int(seq))
                if best is None or order > best:
                    best, changed = order, True
                    link = None if op == "clear" or pd.isna(to) else to
        if changed:
            self.state.update((*best, link))
            yield pd.DataFrame({"crawler": [key[0]], "link": pd.Series([link], dtype=object),
                                "at": pd.to_datetime([best[0]], unit="us"), "seq": [best[1]]})

    def close(self) -> None:
        pass


def run_bookmarks(spark: SparkSession, landing_dir: str, changelog: str, checkpoint: str,
                  ttl_ms: int | None = None, files_per_trigger: int = 1000) -> None:
    """Process the events (``EVENTS``) that have landed, then stop; a later call goes on
    from the checkpoint."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(landing_dir)
        changes = events.where("crawler IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL").groupBy(
            "crawler").transformWithStateInPandas(
            LatestOperation(ttl_ms), outputStructType=CHANGES, outputMode="Update",
            timeMode="None" if ttl_ms is None else "ProcessingTime")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{changelog}/batch={number}")

        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def bookmarks(spark: SparkSession, changelog: str) -> DataFrame:
    """(crawler, link): the bookmarks after all changes; null where cleared."""
    rows = spark.read.schema(CHANGES).parquet(changelog)
    last = rows.groupBy("crawler").agg(F.max_by(F.struct("link"), F.struct("at", "seq")).alias("last"))
    return last.select("crawler", F.col("last.link").alias("link"))
