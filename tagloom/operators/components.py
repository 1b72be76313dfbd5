"""Connected components of an edge list by contraction: each round leaves a graph of about a third of the nodes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all run in one process; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = d.get() if d.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tagloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialised(df: DataFrame, what: str) -> DataFrame:
    """df as Parquet in the shared folder: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialised`` made, once nothing that is still to run reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/tagloom-" in folder:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, rounds: int = 60, sizes: list[int] | None = None) -> DataFrame:
    """(id, root) of every id of ``edges`` (a, b); root is the least id of its component.

    A round gives every node a place in an order: those of more neighbours first, by powers of two, then in an order that is
    drawn anew (a hash of its id and the round). It points each node to the first of its neighbours and itself. Following
    that three times leads most nodes to one that comes before all of its neighbours: of a path one in three, of a hub and
    what hangs on it the hub. Edges are then those between such nodes, each once, so that a round's tables are a fraction of
    the last one's: a path of a million ids takes 13 rounds. A hub's edges are combined in each task before they meet, and
    where they are joined the side of nodes has one row each, so that Spark splits the hub.
    When no edge is left, labels are followed back from the last round to the first. ``sizes`` gets each round's edges.
    """
    e = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    left = materialised(e.union(e.select("b", "a")).distinct(), "edges")
    levels: list[DataFrame] = []
    for k in range(rounds):
        n = left.count()
        if sizes is not None:
            sizes.append(n)
        if not n:
            break
        place = F.struct(F.floor(-F.log2(F.count(F.lit(1)))).alias("d"), F.xxhash64("a", F.lit(k)).alias("h"), F.col("a").alias("i"))
        nodes = materialised(left.groupBy("a").agg(place.alias("place")), "places")
        seen = left.join(nodes.select(F.col("a").alias("b"), "place"), "b").select("a", "place").unionByName(nodes)
        first = seen.groupBy("a").agg(F.min("place").alias("m")).select(F.col("a").alias("id"), F.col("m.i").alias("root"))
        first = materialised(first, "first")
        up = first.select(F.col("id").alias("u"), F.col("root").alias("up"))
        label = first
        for _ in range(2):
            label = label.join(up, label.root == up.u).select("id", F.col("up").alias("root"))
        label = materialised(label, "labels")
        of = lambda c: label.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        then = left.join(of("a"), "a").select("ra", "b").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b")
        then = materialised(then.distinct(), "edges")
        discard(left, first, nodes)
        levels.append(label)
        left = then
    else:
        raise RuntimeError("edges are still left")
    discard(left)
    if not levels:
        return edges.sparkSession.createDataFrame([], "id bigint, root bigint")
    root = levels[-1]
    for label in reversed(levels[:-1]):
        far = root.select(F.col("id").alias("u"), F.col("root").alias("far"))
        root = label.join(far, label.root == far.u, "left").select("id", F.coalesce("far", "root").alias("root"))
    root = materialised(root, "roots")
    discard(*levels)
    least = root.groupBy("root").agg(F.min("id").alias("least"))
    return root.join(least, "root").select("id", F.col("least").alias("root"))
