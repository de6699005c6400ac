"""Shared helpers: the shared work folder, written intermediate tables, size-checked broadcasts, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: A side is broadcast only if it has at most so many rows; its columns are fixed-width, 32 bytes a row or fewer.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own in a single process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, dealt over the cores if it is stored as fewer splits than these."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


class Workspace:
    """A fresh folder below the shared one for the written tables of one call.

    A written table cuts the lineage: if an executor is lost, its readers reread files instead of recomputing.
    The tables must outlive the returned DataFrame, so they stay until ``drop`` is called or the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of queries that have ended: it does so when the driver's plans are collected, which on a
        driver with memory to spare may not come before all of them are on the disk."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is a written table of at most ``rows`` narrow rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[list, list]:
    """(columns under names that no operator uses, the same renamed back): an operator carries a caller's columns through as the first,
    so none can clash with its own."""
    names = [(f"own{i}_", c) for i, c in enumerate(df.columns) if c not in without]
    return [F.col(quoted(c)).alias(k) for k, c in names], [F.col(k).alias(c) for k, c in names]


def connected_components(work: Workspace, edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Distributed union-find over edges (u, v) of long ids: rows (node, root), root being the smallest id reachable.

    Alternates large-star and small-star steps: every round links neighbours to the smallest node seen, and the edges end as
    stars around the roots. A hub's minimum is pre-aggregated before its shuffle. Nodes without an edge have no row; self-loops
    and repeated edges are ignored. Edges never reach the driver.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = work.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    mark = None
    for i in range(1, rounds + 1):
        e = both(now)
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        step = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = work.table(step.where("u <> v").distinct(), f"{name}{i}")
        work.drop(f"{name}{i - 1}")
        now = new
        seen = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
