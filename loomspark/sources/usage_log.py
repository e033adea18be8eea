"""The usage log: JSON lines."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.model import USAGE

QUERY_BYTES = 200
DISABLED_BY = "LOOMSPARK_NO_USAGE"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the log; blank and malformed lines are skipped, and a missing log has none."""
    try:
        return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], USAGE)


def shortened(text: str | None, most: int = QUERY_BYTES) -> str | None:
    """text cut to at most so many UTF-8 bytes, between characters."""
    return text if text is None else text.encode()[:most].decode("utf-8", "ignore")


def append_usage(records: DataFrame, path: str) -> bool:
    """Appends records (USAGE columns); ts 0 becomes now, queries are cut to 200 bytes. False if switched off."""
    if os.environ.get(DISABLED_BY):
        return False
    rows = records.withColumn("ts", F.when(F.coalesce("ts", F.lit(0)) == 0, F.lit(int(time.time()))).otherwise(F.col("ts")))
    # bytes of the longest prefix of whole characters: code points up to where the byte count passes the limit
    chars = F.split("query", "")
    sums = F.aggregate(chars, F.struct(F.lit(0).alias("bytes"), F.lit("").alias("text")), lambda a, c: F.when(a["bytes"] + F.octet_length(c) <= QUERY_BYTES, F.struct((a["bytes"] + F.octet_length(c)).alias("bytes"), F.concat(a["text"], c).alias("text"))).otherwise(F.struct(F.lit(QUERY_BYTES + 1).alias("bytes"), a["text"].alias("text"))))
    rows.withColumn("query", F.when(F.octet_length("query") > QUERY_BYTES, sums["text"]).otherwise(F.col("query"))).write.mode("append").json(path)
    return True
