"""File events as a stream: filter, debounce by session windows, and incremental indexing."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP = "200 milliseconds"
EVENT = "ts timestamp, path string, op string"
#: Folders and files whose events don't count.
IGNORED_FOLDERS, IGNORED_NAMES = (".loomspark", ".git", "node_modules", "target"), (r"\.swp$", r"~$")


def watched(path: Column) -> Column:
    """Whether a change at the path matters."""
    ok = ~path.rlike("(?:^|/)(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED_FOLDERS) + ")(?:/|$)")
    for name in IGNORED_NAMES:
        ok = ok & ~path.rlike(name)
    return ok


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events (ts, path, op) from JSON files that appear in a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def debounced(events: DataFrame, gap: str = GAP, late: str = "1 second", keys: list[str] = ()) -> DataFrame:
    """(start, end, paths): bursts of events with pauses shorter than the gap, and the distinct watched paths in each.

    All events keep a burst open, also those that don't count; bursts without a watched path are dropped. Works on
    streams (append mode: a burst leaves once the watermark passes it) and on tables."""
    rows = events
    if events.isStreaming:
        # a task's own bursts are merged before all of one key meet in a task: bursts travel, not events
        events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        rows = events.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    paths = F.collect_set(F.when(watched(F.col("path")), F.col("path")))
    # Spark wants a key beside a stream's session window; this one is the same for all rows, but no literal
    alone = [] if keys else [F.coalesce(F.length("op") * 0, F.lit(0)).alias("_all")]
    got = rows.groupBy(w.alias("w"), *alone, *keys).agg(F.sort_array(paths).alias("paths"))
    return got.where(F.size("paths") > 0).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths")


def index_stream(events: DataFrame, root: str, source_root: str, checkpoint: str, ignore: list[str] = (), **trigger) -> StreamingQuery:
    """Applies each micro-batch of debounced bursts to the graph snapshot at root. A batch that fails is logged, and
    the stream goes on with the next one."""
    from loomspark.operators.graph import build
    from loomspark.operators.graph.store import Store
    from loomspark.sources.files import scan

    def apply(batch: DataFrame, number: int) -> None:
        try:
            paths = batch.select(F.explode("paths").alias("path")).distinct()
            spark = batch.sparkSession
            store, _ = build.update(Store.open(spark, root), scan(spark, source_root, ignore), paths)
            store.save(root)
        except Exception:
            logging.getLogger(__name__).exception("batch %d could not be indexed", number)

    return debounced(events).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
