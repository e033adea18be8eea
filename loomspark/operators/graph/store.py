"""Graph tables: nodes, edges and the file manifest as DataFrames; upserts, deletes, lookups, snapshots on disk."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.model import DEPENDENCY_KINDS, EDGE, EDGE_KINDS, FILE, LANGUAGES, NODE, NODE_KINDS


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """old with the rows of new in the place of equal keys; columns `keep` stay as they were where the key is known.

    Of new rows with one key the last by column `seq` (if there is one) wins."""
    if "seq" in new.columns:
        cols = [c for c in new.columns if c not in (*key, "seq")]
        new = new.groupBy(*key).agg(F.max_by(F.struct(*cols), "seq").alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    kept = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    merged = new.join(kept, key, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(merged)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """By qualified name; known nodes keep their id."""
    return upsert(nodes, new, ["qualified"], ["id"])


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(edges, new, ["src", "dst", "kind"])


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(files, new, ["path"])


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files at paths (path): their nodes, all edges from or to those, their manifest rows."""
    p = paths.select("path").distinct()
    gone = nodes.join(p, "path", "left_semi").select(F.col("id").alias("_id"))
    left = edges.join(gone, F.col("src") == F.col("_id"), "left_anti").join(gone, F.col("dst") == F.col("_id"), "left_anti")
    return nodes.join(p, "path", "left_anti"), left, files.join(p, "path", "left_anti")


def known_or(col: str, values: tuple[str, ...], other: str):
    return F.when(F.col(col).isin(*values), F.col(col)).otherwise(other)


@dataclass
class Store:
    """A snapshot of the graph. Unknown kinds and languages read as import, tests and unknown."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(*(spark.createDataFrame([], s) for s in (NODE, EDGE, FILE)))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """The snapshot that root's pointer names; an empty graph where there is none."""
        try:
            row = spark.read.schema("at string, seq long").json(f"{root}/current").orderBy(F.desc("seq")).first()
        except Exception as e:  # no such folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        if row is None:
            return cls.empty(spark)
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{row.at}/{name}")
        nodes = read("nodes", NODE).withColumn("kind", known_or("kind", NODE_KINDS, "import")).withColumn("language", known_or("language", LANGUAGES, "unknown"))
        return cls(nodes, read("edges", EDGE).withColumn("kind", known_or("kind", EDGE_KINDS, "tests")), read("files", FILE))

    def save(self, root: str) -> Store:
        """Writes a new snapshot, then one small pointer record; readers see the old or the new one, never a mixture."""
        spark = self.nodes.sparkSession
        at = f"snapshot-{uuid.uuid4().hex}"
        for name in ("nodes", "edges", "files"):
            getattr(self, name).write.parquet(f"{root}/{at}/{name}")
        spark.sql("SELECT 1").select(F.lit(at).alias("at"), F.unix_micros(F.current_timestamp()).alias("seq")).coalesce(1).write.mode("append").json(f"{root}/current")
        return Store.open(spark, root)

    def find(self, name: str, limit: int | None = None) -> DataFrame:
        """Nodes of exactly this name, by id."""
        rows = self.nodes.where(F.col("name") == name).orderBy("id")
        return rows if limit is None else rows.limit(limit)

    def by_qualified(self, qualified: str) -> DataFrame:
        return self.nodes.where(F.col("qualified") == qualified)

    def in_file(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("path") == path)

    def by_id(self, node: int) -> DataFrame:
        return self.nodes.where(F.col("id") == node)

    def neighbours(self, frontier: DataFrame, forward: bool = True, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
        """Edges that leave (or, backwards, enter) the nodes of frontier (id)."""
        end = "src" if forward else "dst"
        return self.edges.where(F.col("kind").isin(*kinds)).join(frontier.select(F.col("id").alias(end)).distinct(), end, "left_semi")

    def stats(self) -> tuple[int, int, int]:
        return self.nodes.count(), self.edges.count(), self.files.count()
