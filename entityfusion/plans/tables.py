"""Written tables: how plans cut lineage. Each is Parquet in the shared folder named by spark.checkpoint.dir, written once and read
again, so a lost executor costs a re-read and not the work before it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two columns up to which a table of parents is broadcast (some 40 bytes each); beyond, it is joined by shuffle.
PARENTS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors. Where it is unset, local mode gets a temporary one; a cluster gets an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{os.path.join(tempfile.gettempdir(), 'entityfusion')}"
        spark.conf.set("spark.checkpoint.dir", at)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "file:///", uri).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it; a missing one is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Written tables of one run of an operator.

    ``table(df)`` writes and rereads; ``drop(...)`` removes tables that nothing needs any more. Tables that a returned DataFrame
    still reads stay in the shared folder, as Spark's own checkpoint files do, until ``close`` or the cluster's clean-up of
    that folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n, self._of = 0, {}

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        self._n += 1
        at = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self._of[id(out)] = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if at := self._of.pop(id(f), None):
                remove(self.spark, at)

    def close(self) -> None:
        remove(self.spark, self.root)


def few(df: DataFrame, most: int) -> bool:
    """Whether a written table has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


#: Rows a task sorts or collects at most, in the mean: tens of bytes to some hundred each.
TASK_ROWS = 250_000


def shares(spark: SparkSession, rows: int) -> int:
    """Parts that so many rows are dealt over: as many as Spark's shuffles have at least, and more as rows grow, so that what one task holds does not. A
    number that is stated is kept; adaptive execution joins other parts by their compressed bytes, however many rows those are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _renamed(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """df with the values of ``column`` that have a parent (node, up) replaced by it."""
    met = df.join(parents.select(F.col("node").alias("_node"), F.col("up").alias("_up")), F.col(column) == F.col("_node"), "left")
    return met.withColumn(column, F.coalesce("_up", column)).drop("_node", "_up")


def roots(parents: DataFrame, tables: Tables) -> DataFrame:
    """node, up: the root above each node of a forest. parents: a written table of node and up, where roots have no row.

    Each round a node takes its parent's parent, so the depth halves; nodes that are below a root already are not joined again."""
    now = tables.table(parents.select("node", "up", F.lit(True).alias("moved")), "jumps")
    small = few(parents, PARENTS)
    while not now.filter("moved").isEmpty():
        above = now.select("node", "up")
        moving = _renamed(now.filter("moved").withColumn("was", F.col("up")), "up", F.broadcast(above) if small else above)
        moving = moving.select("node", "up", (F.col("up") != F.col("was")).alias("moved"))
        new = tables.table(moving.unionByName(now.filter("not moved")), "jumps")
        tables.drop(now)
        now = new
    return now.select("node", "up")


def components(nodes: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame:
    """node, label: the least node reachable from each. nodes: node; edges: a, b, of nodes, in either direction.

    Rounds of contraction. Each node with a lesser neighbour takes the least one as its parent: an aggregate that combines before
    the shuffle, so a hub is no hot key. Parents lead to roots. Then edges are those between roots; as every node but local
    minima goes, the graph shrinks by a factor each round, and a star goes at once. A component's least node never gets a parent,
    so it is the label.
    """
    left = tables.table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not left.isEmpty():
        up = roots(tables.table(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "parents"), tables)
        parents = F.broadcast(up) if few(up, PARENTS) else up
        found = up if found is None else tables.table(_renamed(found, "up", parents).unionByName(up), "found")
        rest = _renamed(_renamed(left, "a", parents), "b", parents).filter("a <> b")
        rest = tables.table(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        tables.drop(left)
        left = rest
    if found is None:
        return nodes.select("node", F.col("node").alias("label"))
    return _renamed(nodes.select("node", F.col("node").alias("label")), "label", found)
