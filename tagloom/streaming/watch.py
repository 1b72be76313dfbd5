"""Watching folders: new images flow into the catalog batch by batch.

The file source notices files once and remembers them in its checkpoint; what is in work, and what failed and has to wait,
is state by path (see ``intake``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.functions import images
from tagloom.operators import batches, tagging
from tagloom.operators.components import materialised
from tagloom.sources.catalog import Catalog
from tagloom.sources.listing import suffixes
from tagloom.streaming import intake

# Fixed value: the schema of Spark's binary file source.
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, *, extensions: Iterable[str] | None = None, per_trigger: int = 1000) -> DataFrame:
    """A stream of path, size, mtime, content of image files that come into a folder or below it."""
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    kinds = "(" + "|".join("\\" + s for s in suffixes(extensions)) + ")$"
    path = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    return rows.filter(F.lower("path").rlike(kinds)).select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")


def take_in(catalog: Catalog, batch: DataFrame, make: Callable[[], tagging.Tagger], signature: str, *, top_k: int = 128) -> None:
    """Decodes, tags and stores a batch of images: files, tags, links, documents and signatures in one version.

    Only the parts of the catalog that the batch touches are rewritten. What can't be tagged is stored without a tagger's
    mark, so that the next scan tries it again; another writer's version in between is merged into.
    """
    batch = materialised(batch.dropDuplicates(["path"]).withColumn("sha256", F.sha2("content", 256)).withColumn("file_id", F.monotonically_increasing_id()), "arrivals")
    if batch.isEmpty():
        return
    named = batch.select("file_id", "path")
    tagged = materialised(named.join(tagging.tag(batch, make), "file_id").drop("file_id"), "tagged")
    made = materialised(named.join(images.signatures(batch), "file_id").drop("file_id"), "signatures")
    batches.store(catalog, batches.Batch(batch.select("path", "size", "mtime", "sha256"), tagged, signature, time.time(), made), top_k=top_k)


def store(catalog: Catalog, batch: DataFrame, signature: str, *, top_k: int = 128) -> None:
    """Stores a micro-batch of ``intake.tried``. A batch that is repeated after a failure upserts the same rows."""
    rows = materialised(batch, "tried")
    if rows.isEmpty():
        return
    made = rows.filter("phash_u64 is not null").select("path", "phash_u64", "dhash_u64")
    found = batches.Batch(rows.select("path", "size", "mtime", "sha256"), rows.select("path", "tags", "width", "height"), signature, time.time(), made)
    batches.store(catalog, found, top_k=top_k)


def watch(catalog: Catalog, folder: str, checkpoint: str, make: Callable[[], tagging.Tagger], signature: str, *, once: bool = False, interval: str = "10 seconds", tries: int = 5, wait: float = 60.0, top_k: int = 128, **how) -> StreamingQuery:
    """Starts the intake; ``once`` takes what is there and stops, and what failed waits in the checkpoint for the next start.

    A file that can't be tagged is tried ``tries`` times, first after ``wait`` seconds, then after twice as long each time.
    """
    stream = intake.tried(arrivals(catalog.spark, folder, **how), make, tries=tries, wait=wait)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(lambda df, _: store(catalog, df, signature, top_k=top_k))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


__all__ = ["arrivals", "store", "take_in", "watch"]
