"""Session helpers: building a session for tests/bench and reading shared settings."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "statuta") -> SparkSession:
    """Session for tests and the bench; on a cluster use the session you are given."""
    master = master or os.environ.get("STATUTA_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STATUTA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``.  Only a local session may go without:
    it gets a folder under the warehouse directory.  On a cluster that folder could be
    the driver's own disk, so an unset folder is an error there.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        sc = None
    configured = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc is None or not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        configured = warehouse.rstrip("/") + "/_statuta_checkpoints"
    if sc is None:
        return configured
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


#: Largest estimated size of a frame that is broadcast by hint.
MAX_BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row: 16, and per column 8, and what its text takes."""
    size = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif f.dataType.typeName() in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
    return size


def broadcast_if_small(df: DataFrame, max_rows: int, persist: bool = False) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only after checking its rows and bytes.

    The check is one aggregation, with a partial sum per task.  Beyond ``max_rows`` or
    ``MAX_BROADCAST_BYTES`` the frame is returned unchanged and Spark plans a shuffle join
    (AQE may still convert it); the result is the same.  ``persist`` keeps the checked
    frame so the join does not compute it again.
    """
    if persist:
        from pyspark import StorageLevel

        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    if rows <= max_rows and size <= MAX_BROADCAST_BYTES:
        return F.broadcast(df), True
    return df, False


#: Compressed bytes of a table that one task takes after ``spread``.
SPREAD_BYTES = 8 << 20


def spread(scan: DataFrame, key_cols: list[str]) -> DataFrame:
    """Hash-partition a table scan by ``key_cols`` when it has fewer files than the cluster
    has task slots (e.g. one large single-row-group file), into partitions that do not grow
    with the table.  A many-file input keeps its scan partitioning and is not shuffled.  The
    files and their size are taken from the plan; no job runs.
    Apply it where a table is read, not to derived frames."""
    session = scan.sparkSession
    try:
        slots = session.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect: the server's slots are not known here
        return scan
    if len(scan.inputFiles()) >= slots:
        return scan
    return clustered(scan, key_cols)


def clustered(scan: DataFrame, key_cols: list[str], part_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Hash-partition a table scan by ``key_cols`` into partitions that do not grow with the
    table (``part_bytes`` of its files), however many files it has: what is then grouped by these and more columns needs no
    other shuffle.  The size of the table is taken from the plan; no job runs."""
    try:
        slots = scan.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect: the server's slots are not known here
        return scan.repartition(*key_cols)
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(max(slots, -(-size // part_bytes)), *key_cols)


#: Partitions to a task slot of rows that are costly by their number, not their bytes.
EVEN_PARTS = 4


def even_parts(scan: DataFrame) -> int:
    """Partitions for a table scan whose rows are costly by their number: some to every task slot, and more
    of a large table.  The size is taken from the plan; no job runs."""
    try:
        slots = scan.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect: the server's slots are not known here
        slots = 1
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(EVEN_PARTS * slots, -(-size // SPREAD_BYTES))


def evenly(rows: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows hash-partitioned over all task slots, however few bytes they have."""
    try:
        slots = rows.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect: the server's slots are not known here
        return rows.repartition(*key_cols)
    return rows.repartition(EVEN_PARTS * slots, *key_cols)
