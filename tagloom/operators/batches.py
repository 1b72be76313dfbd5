"""Storing a batch of scanned and tagged files in a catalog, at the cost of the parts that it touches.

The rules are those of ``maintenance``, applied to the touched parts of each relation instead of the whole: files by the
ranges of their paths, tags by their names, links, documents and signatures by their files, and postings, if the catalog
has a text index, by the terms that a document loses or gains. All of it becomes one version. Another writer's version in
between is no failure: what the batch brings doesn't depend on the catalog, so it is merged anew into the newest one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import maintenance, textindex
from tagloom.operators.components import materialised
from tagloom.sources import schema
from tagloom.sources.catalog import Catalog, Conflict


@dataclass(frozen=True)
class Batch:
    """What a run found, by path: rows may be missing from any part.

    seen: path, size, mtime, sha256. tagged: path, tags (null if tagging failed), width, height. signatures: path, phash_u64,
    dhash_u64. gone: path, file_id of stored files that are no more.
    """

    seen: DataFrame
    tagged: DataFrame
    signature: str
    at: float
    signatures: DataFrame | None = None
    gone: DataFrame | None = None


def _parts(catalog: Catalog, only: dict, name: str, keys: DataFrame) -> DataFrame:
    """The parts of a relation that keys fall into, noted in ``only``."""
    only[name] = catalog.touched(name, keys)
    return catalog.read(name, only[name])


def merged(catalog: Catalog, batch: Batch, *, hard: bool = False, when: str = "", top_k: int = 128) -> tuple[dict[str, DataFrame], dict[str, list[int] | None]]:
    """The touched parts of each relation after the batch, and their numbers."""
    only: dict[str, list[int] | None] = {}
    paths = batch.seen.select("path").union(batch.tagged.select("path"))
    if batch.gone is not None:
        paths = paths.union(batch.gone.select("path"))
    old_files = _parts(catalog, only, "files", paths)
    files = materialised(maintenance.upsert_files(old_files, batch.seen, top=catalog.top_id("files")), "files")
    number = files.select("path", F.col("id").alias("file_id"))
    items = batch.tagged.filter("tags is not null").join(number, "path").select("file_id", "tags", "width", "height", F.lit(batch.signature).alias("tagger_sig"), F.lit(batch.at).alias("tagged_at"))
    items = materialised(items, "items")
    gone = None if batch.gone is None else batch.gone.select("file_id")
    names = items.select(F.explode("tags").alias("t")).select(F.trim("t.name").alias("name")).filter("name <> ''").distinct()
    old_tags = _parts(catalog, only, "tags", names)
    ids = items.select("file_id") if gone is None else items.select("file_id").union(gone)
    old_links, old_documents = _parts(catalog, only, "file_tags", ids), _parts(catalog, only, "fts_files", ids)
    out = maintenance.write_batch(files, old_tags, old_links, old_documents, items, k=top_k, top_tag=catalog.top_id("tags"))
    failed = batch.tagged.filter("tags is null").join(number, "path").select(F.col("file_id").alias("id"))
    # What could not be tagged loses its mark: its contents may be new, its tags are not, and the next scan tries again.
    out["files"] = maintenance.mark_retag(out["files"], failed)
    if batch.signatures is not None:
        made = materialised(batch.signatures.join(number, "path").select("file_id", "phash_u64", "dhash_u64"), "signatures")
        both = made.select("file_id") if gone is None or not hard else made.select("file_id").union(gone)
        out["signatures"] = maintenance.upsert_signatures(_parts(catalog, only, "signatures", both), made)
    elif gone is not None and hard:
        out["signatures"] = _parts(catalog, only, "signatures", gone)
    if gone is not None:
        if hard:
            out = maintenance.hard_delete(out, gone)
        else:
            out["files"], out["fts_files"] = maintenance.soft_delete(out["files"], out["fts_files"], gone, when)
    out["tags"], only["tags"] = _changed_tags(catalog, old_tags, out["tags"], only["tags"])
    if catalog.held("postings"):
        of = ids.distinct()
        before, after = old_documents.join(of, "file_id", "left_semi"), materialised(out["fts_files"], "documents")
        out["fts_files"] = after
        fresh, lost = textindex.delta(before, after.join(of, "file_id", "left_semi"))
        fresh, lost = materialised(fresh, "fresh"), materialised(lost, "lost")
        old = _parts(catalog, only, "postings", fresh.select("term", "file_id").union(lost))
        out["postings"] = textindex.applied(old, fresh, lost)
    # An empty list touches nothing: that relation stays as it is.
    return {n: df for n, df in out.items() if only.get(n) != []}, only


def _changed_tags(catalog: Catalog, old: DataFrame, new: DataFrame, parts: list[int] | None) -> tuple[DataFrame, list[int] | None]:
    """Of the tags that were met those parts where a tag is new or has another category: names that stay rewrite nothing."""
    if not parts:
        return new, parts
    new = materialised(new, "tags")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in schema.TAGS.names]
    differ = new.alias("n").join(old.alias("o"), same[0] & same[1] & same[2], "left_anti")
    changed = catalog.touched("tags", differ)
    return new.filter(catalog.part_of("tags").isin(changed) if changed else F.lit(False)), changed


def store(catalog: Catalog, batch: Batch, *, hard: bool = False, when: str = "", top_k: int = 128, tries: int = 8) -> str:
    """Publishes the batch and returns the version; after ``tries`` versions of others in between it gives up."""
    for left in range(tries - 1, -1, -1):
        base = catalog.number()
        try:
            out, only = merged(catalog, batch, hard=hard, when=when, top_k=top_k)
            return catalog.publish(out, base=base, only=only)
        except Conflict:
            if not left:
                raise
    raise AssertionError("unreachable")


__all__ = ["Batch", "merged", "store"]
