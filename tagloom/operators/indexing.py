"""The whole index run: scan, hash, tag, write; and the refresh of one folder."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import batches, maintenance, tagging
from tagloom.operators.components import materialised
from tagloom.operators.search import within
from tagloom.sources import layout, listing
from tagloom.sources.catalog import Catalog


def _tagged(todo: DataFrame, make: Callable[[], tagging.Tagger]) -> DataFrame:
    """path, tags, error, width, height of files to tag (path, size)."""
    numbered = materialised(listing.batch_order(todo).withColumn("file_id", F.monotonically_increasing_id()), "todo")
    tagged = tagging.tag(listing.contents(numbered), make)
    return materialised(numbered.select("file_id", "path").join(tagged, "file_id").drop("file_id"), "tagged")


def scan(catalog: Catalog, roots: Sequence[str], signature: str, *, files: DataFrame | None = None, links: DataFrame | None = None, **how) -> DataFrame:
    """What changed below the roots: see ``maintenance.changes``. Only new and touched files are read and hashed.

    files and links: the stored ones to compare with, all by default.
    """
    files = catalog.read("files") if files is None else files
    links = catalog.read("file_tags") if links is None else links
    found = materialised(listing.images(catalog.spark, roots, **how).dropDuplicates(["path"]), "listing")
    hashes = listing.contents(maintenance.to_hash(found, files)).select("path", "sha256")
    known = found.join(hashes, "path", "left").join(files.select("path", F.col("sha256").alias("old")), "path", "left").select("path", "size", "mtime", F.coalesce("sha256", "old").alias("sha256"))
    return materialised(maintenance.changes(known, files, links, signature), "changes")


def run(catalog: Catalog, roots: Sequence[str], make: Callable[[], tagging.Tagger], signature: str, *, top_k: int = 128, **how) -> dict[str, int]:
    """Indexes the roots into a new version and returns its counters."""
    found = scan(catalog, roots, signature, **how)
    counts = {k: v or 0 for k, v in maintenance.counters(found).first().asDict().items()}
    here = found.filter("not is_missing")
    tagged = _tagged(here.filter("needs_tagging").select("path", "size"), make)
    batches.store(catalog, batches.Batch(here.select("path", "size", "mtime", "sha256"), tagged, signature, time.time()), top_k=top_k)
    done = tagged.agg(F.count("tags").alias("tagged"), F.count("error").alias("failed")).first()
    return {**counts, "tagged": done.tagged, "failed": done.failed}


def refresh(catalog: Catalog, root: str, make: Callable[[], tagging.Tagger], signature: str, *, recursive: bool = True, hard_delete: bool = False, top_k: int = 128) -> dict[str, int]:
    """One folder anew: tags what is new or untagged, and marks or deletes what is gone.

    Of the stored files only the ranges of paths below the folder are read and rewritten, of the links only those files'.
    """
    root = listing.resolved(root)
    files = catalog.read("files", catalog.between("files", *layout.below(root)))
    stored = within(files.filter("is_present = 1"), root, recursive=recursive)
    links = catalog.read("file_tags", catalog.touched("file_tags", stored.select(F.col("id").alias("file_id"))))
    found = materialised(within(scan(catalog, [root], signature, files=files, links=links), root, recursive=recursive), "refresh")
    gone = materialised(maintenance.missing(stored, found.filter("not is_missing")).select("path", F.col("id").alias("file_id")), "gone")
    here = found.filter("not is_missing")
    tagged = _tagged(here.filter("needs_tagging").select("path", "size"), make)
    batch = batches.Batch(here.select("path", "size", "mtime", "sha256"), tagged, signature, time.time(), gone=gone)
    batches.store(catalog, batch, hard=hard_delete, when=time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()), top_k=top_k)
    return {"queued": tagged.count(), "tagged": tagged.filter("tags is not null").count(), "missing": gone.count()}
