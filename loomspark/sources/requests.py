"""Requests and results as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.model import CHUNK, CHUNK_KINDS, LANGUAGES, REQUEST


def _chunks(rows: DataFrame) -> DataFrame:
    """chunks of rows (request_id, chunks) with defaults in the place of what is missing."""
    c = rows.select("request_id", F.posexplode("chunks").alias("pos", "c")).select("request_id", F.col("pos").cast("long").alias("pos"), "c.*")
    values = lambda name, known, other: F.when(F.col(name).isin(*known), F.col(name)).otherwise(other).alias(name)
    return c.select("request_id", F.coalesce("id", F.lit("")).alias("id"), "pos", "path", values("language", LANGUAGES, "unknown"), F.coalesce("content", F.lit("")).alias("content"), values("kind", CHUNK_KINDS, "code"), F.coalesce("priority", F.lit(0)).alias("priority"), F.coalesce("skeleton_hint", F.lit(False)).alias("skeleton_hint"), "community")


def read_request(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(chunks, query) of one request file."""
    rows = spark.read.schema(REQUEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    row = rows.select("query").first()
    return _chunks(rows.withColumn("request_id", F.lit(0))).drop("request_id").to(spark.createDataFrame([], CHUNK).schema), row.query if row else None


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with request_id, queries) of many request files, one request a file; the id is the file's name."""
    rows = spark.read.schema(REQUEST).option("multiLine", True).json(path).withColumn("request_id", F.col("_metadata.file_path"))
    return _chunks(rows), rows.select("request_id", "query")


def parse_request(spark: SparkSession, text: str) -> tuple[DataFrame, str | None]:
    """The same from JSON text, for requests that come over a pipe."""
    row = json.loads(text)
    if not isinstance(row, dict) or not isinstance(row.get("chunks"), list):
        raise ValueError("a request needs chunks")
    parsed = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", REQUEST, {"mode": "FAILFAST"}).alias("r")).select("r.*").withColumn("request_id", F.lit(0))
    return _chunks(parsed).drop("request_id").to(spark.createDataFrame([], CHUNK).schema), row.get("query")


def chunk_json(chunk: Column = None) -> Column:
    names = ["id", "path", "language", "content", "kind", "priority", "skeleton_hint", "community"]
    return F.to_json(F.struct(*names))


def result_json(result, pretty: bool = False) -> str:
    """The result of a request as JSON text; its chunks are what the budget admits."""
    names = ["id", "path", "language", "content", "kind", "priority", "skeleton_hint", "community"]
    body = {"chunks": [r.asDict() for r in result.chunks.select(*names).collect()], "original_tokens": result.original_tokens, "final_tokens": result.final_tokens, "tokens_saved": result.tokens_saved, "reduction_pct": result.reduction_pct, "elapsed_ms": result.elapsed_ms, "stats": result.stats}
    return json.dumps(body, ensure_ascii=False, indent=2 if pretty else None)


def write_results(chunks: DataFrame, path: str) -> None:
    """Many requests' chunks as JSON lines, written in parallel."""
    chunks.write.mode("errorifexists").json(path)


def bundle(chunks: DataFrame, order: str = "pos", by: list[str] = ()) -> DataFrame:
    """One row (bundle), or one a group of `by`: chunks of a request under headers, with a blank line between."""
    head = F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("// --- "), F.col("path"), F.lit(" ("), F.col("kind"), F.lit(") ---\n"))).otherwise(F.concat(F.lit("// --- "), F.col("id"), F.lit(" ---\n")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(head, "content").alias("t")))), lambda x: x["t"])
    return chunks.groupBy(*by).agg(F.array_join(parts, "\n\n").alias("bundle"))


def selection_request(active: DataFrame, selection: str | None) -> DataFrame:
    """One chunk of priority 10 from the active file (path, content): the selection, or all where it is empty."""
    text = F.lit(selection) if selection else F.col("content")
    return active.limit(1).select(F.concat(F.lit("selection:"), F.col("path")).alias("id"), F.lit(0).cast("long").alias("pos"), "path", T.language_of_path(F.col("path")).alias("language"), text.alias("content"), F.lit("selection").alias("kind"), F.lit(10).alias("priority"), F.lit(False).alias("skeleton_hint"), F.lit(None).cast("int").alias("community"))
