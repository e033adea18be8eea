"""Tables that cut lineage, ranks over all rows without one big task, and checks of a side's size before a broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: A side is broadcast only if it has at most this many rows.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch where the session leaves Spark's own 64 MB: executor and worker hold several batches and copies.
ARROW_BYTES, ARROW_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a partition where the session leaves Spark's own: ids and weights are ten times as large in a task as compressed.
PARTITION_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": ("64MB", "67108864b", "16m"), "spark.sql.files.maxPartitionBytes": ("128MB", "134217728b", "32m"), "spark.sql.files.openCostInBytes": ("4MB", "4194304b", "256k")}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the session was started from, and keeps Arrow batches and partitions small."""
    if spark.conf.get(ARROW_KEY, None) == "67108864b":
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))
    for key, (*own, less) in PARTITION_BYTES.items():
        if spark.conf.get(key, own[0]) in own:
            spark.conf.set(key, less)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is set: the warehouse on a cluster, a temporary folder where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] == "local":
            named = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomspark-scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts lineage, survives a lost executor."""
    path = f"{scratch_dir(df.sparkSession)}/loomspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).collect()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counting stops there), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df plus `name`: 1-based place of each row in the order of `order` over all rows.

    A range exchange sorts the rows in parallel; a row's place is its place inside its partition plus the rows of
    the partitions before, so that no window has all rows in one task. Rows must be told apart by the order."""
    sorted_df = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = sorted_df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return sorted_df.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


#: Graphs of at most this many edges and nodes (a few tens of MB as arrays) are iterated over in one process.
LOCAL_EDGES = 1_000_000


def local_arrays(df: DataFrame, most: int = LOCAL_EDGES) -> pa.Table | None:
    """df as an Arrow table if it has at most `most` rows, else None; no more than `most` + 1 rows are ever fetched."""
    got = df.limit(most + 1).toArrow()
    return got if got.num_rows <= most else None
