"""Catalog maintenance as pure transformations: relations in, relations out. ``sources.catalog`` publishes results.

Nothing is changed in place. New ids are max(id) plus a number in path or name order, so a run that repeats gives the
same ids; the number comes from counts of range partitions, not from one task that sorts everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.operators import documents as docs
from tagloom.operators.components import materialised
from tagloom.plans.compile import matching
from tagloom.sources.schema import FILES

#: Columns that an upsert overwrites even with null; the others keep their value when the new one is null.
OVERWRITTEN = ("size", "mtime", "sha256", "deleted_at")
KEPT = ("is_present", "width", "height", "indexed_at", "tagger_sig", "last_tagged_at")


def last(rows: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Of rows with equal keys the one with the greatest ``order``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in others))


def numbered(rows: DataFrame, by: str, start: Column | int, name: str = "id") -> DataFrame:
    """rows with start + 1, start + 2, ... in the order of ``by``."""
    placed = materialised(rows.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned(F.col("__m"), 33)
    counts = placed.groupBy(part.alias("__p")).count()
    before = counts.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    out = placed.withColumn("__p", part).join(F.broadcast(before), "__p")
    return out.withColumn(name, (F.lit(start) if isinstance(start, int) else start) + F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__p", "__b")


def top_id(rows: DataFrame) -> int:
    return rows.agg(F.max("id")).first()[0] or 0


def upsert_files(files: DataFrame, incoming: DataFrame, *, revive: bool = True, top: int | None = None) -> DataFrame:
    """Files after upserts by path (``incoming`` may lack columns; of equal paths the greatest ``seq`` counts).

    By default a row that is met is present again and no longer deleted. ``top`` is the greatest id so far, if ``files`` are
    not all there are.
    """
    new = incoming
    if "seq" not in new.columns:
        new = new.withColumn("seq", F.lit(0))
    for f in FILES:
        if f.name not in new.columns:
            new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    if revive:
        new = new.withColumn("is_present", F.coalesce("is_present", F.lit(1)))
    new = last(new.select("path", "seq", *OVERWRITTEN, *KEPT, "created_at"), ["path"])
    o, n = files.alias("o"), new.alias("n")
    met = n.join(o, F.col("o.path") == F.col("n.path"), "left")
    both = met.filter("o.id is not null").select(
        F.col("o.id").alias("id"), F.col("o.path").alias("path"), *(F.col(f"n.{c}").alias(c) for c in OVERWRITTEN), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in KEPT), F.col("o.created_at").alias("created_at")
    )
    fresh = met.filter("o.id is null").select("n.*").withColumn("is_present", F.coalesce("is_present", F.lit(1))).withColumn("created_at", F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")))
    fresh = numbered(fresh, "path", top_id(files) if top is None else top)
    rest = files.join(new.select("path"), "path", "left_anti")
    names = FILES.names
    return rest.select(*names).unionByName(both.select(*names)).unionByName(fresh.select(*names))


def update_meta(files: DataFrame, meta: DataFrame, *, coalesce: Sequence[str] = ("width", "height", "tagger_sig", "last_tagged_at"), present: bool = True, insert: bool = False) -> DataFrame:
    """Files with width, height, tagger_sig, last_tagged_at of ``meta`` by id; columns in ``coalesce`` keep old values over nulls.

    ``insert`` adds unknown ids with a placeholder path. Of equal ids the greatest ``seq`` counts, if there is one.
    """
    cols = ["width", "height", "tagger_sig", "last_tagged_at"]
    m = meta if "seq" in meta.columns else meta.withColumn("seq", F.lit(0))
    for c in cols:
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast(FILES[c].dataType))
    m = last(m.select("id", "seq", *cols), ["id"])
    j = files.alias("o").join(m.alias("n"), F.col("o.id") == F.col("n.id"), "left")
    hit = F.col("n.id").isNotNull()

    def value(c: str) -> Column:
        if c in cols:
            return F.when(hit, F.coalesce(f"n.{c}", f"o.{c}") if c in coalesce else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c == "is_present" and present:
            return F.when(hit, F.lit(1)).otherwise(F.col("o.is_present"))
        return F.col(f"o.{c}")

    out = j.select(*(value(c).alias(c) for c in files.columns))
    if not insert:
        return out
    unknown = m.join(files.select("id"), "id", "left_anti").withColumn("path", F.concat(F.lit("placeholder:"), F.col("id").cast("string"))).withColumn("is_present", F.lit(1))
    return out.unionByName(unknown.select(*((F.col(c) if c in unknown.columns else F.lit(None).cast(FILES[c].dataType)).alias(c) for c in files.columns)))


def upsert_tags(tags: DataFrame, incoming: DataFrame, *, top: int | None = None) -> DataFrame:
    """Tags after upserts by trimmed name: category overwritten, ids stable, the greatest ``seq`` counting among equals.

    ``top`` is the greatest id so far, if ``tags`` are not all there are.
    """
    new = incoming if "seq" in incoming.columns else incoming.withColumn("seq", F.lit(0))
    new = last(new.select(F.trim("name").alias("name"), "category", "seq").filter("name <> ''"), ["name"]).drop("seq")
    met = new.alias("n").join(tags.alias("o"), "name", "left").select("name", F.col("n.category").alias("category"), F.col("o.id").alias("old"))
    kept = met.filter("old is not null").select(F.col("old").alias("id"), "name", "category")
    fresh = numbered(met.filter("old is null").select("name", "category"), "name", top_id(tags) if top is None else top).select("id", "name", "category")
    return tags.join(new.select("name"), "name", "left_anti").select("id", "name", "category").unionByName(kept).unionByName(fresh)


def replace_links(file_tags: DataFrame, links: DataFrame, file_ids: DataFrame) -> DataFrame:
    """file_tags with all links of ``file_ids`` (file_id) replaced by ``links``; files without new ones end with none."""
    return file_tags.join(file_ids.select("file_id"), "file_id", "left_anti").select("file_id", "tag_id", "score").unionByName(links.select("file_id", "tag_id", "score"))


def upsert_signatures(signatures: DataFrame, incoming: DataFrame) -> DataFrame:
    return signatures.join(incoming.select("file_id"), "file_id", "left_anti").unionByName(incoming.select(*signatures.columns))


def write_batch(files: DataFrame, tags: DataFrame, file_tags: DataFrame, documents: DataFrame, items: DataFrame, *, overwrite_meta: bool = True, k: int = 128, top_tag: int | None = None) -> dict[str, DataFrame]:
    """The relations after a batch of tagged items (file_id, tags array<struct<name,score,category>>, width, height, tagger_sig, tagged_at).

    New names become tags, links of every item's file are replaced (an empty list deletes), metadata is updated (the
    signature and time overwrite, unless told otherwise) and documents are made anew. A file twice in a batch raises.
    """
    if not items.groupBy("file_id").count().filter("count > 1").isEmpty():
        raise ValueError("a file occurs twice in the batch")
    flat = items.select("file_id", F.posexplode("tags").alias("position", "t")).select("file_id", "position", F.trim("t.name").alias("name"), F.col("t.score").alias("score"), F.col("t.category").alias("category")).filter("name <> ''")
    staged = flat.groupBy("name").agg(F.max("category").alias("category"))
    tags2 = upsert_tags(tags, staged, top=top_tag)
    best = flat.groupBy("file_id", "name").agg(F.max("score").alias("score"))
    links = best.join(tags2.select(F.col("id").alias("tag_id"), "name"), "name")
    ids = items.select("file_id")
    meta = items.select(F.col("file_id").alias("id"), "width", "height", "tagger_sig", F.col("tagged_at").alias("last_tagged_at"))
    coalesce = ("width", "height") if overwrite_meta else ("width", "height", "tagger_sig", "last_tagged_at")
    return {
        "files": update_meta(files, meta, coalesce=coalesce),
        "tags": tags2,
        "file_tags": replace_links(file_tags, links, ids),
        "fts_files": docs.delete(documents, ids).unionByName(docs.update(documents.limit(0), best, k).select(*documents.columns)),
    }


def batch_totals(items: DataFrame) -> DataFrame:
    """files, links and tags of a batch as it is staged: its files, the (file, name) pairs of trimmed names, distinct names."""
    names = items.select("file_id", F.explode_outer("tags").alias("t")).select("file_id", F.nullif(F.trim("t.name"), F.lit("")).alias("name"))
    pairs = names.groupBy("file_id", "name").agg(F.lit(1).alias("one"))
    return pairs.agg(F.countDistinct("file_id").alias("files"), F.count("name").alias("links"), F.countDistinct("name").alias("tags"))


def soft_delete(files: DataFrame, documents: DataFrame, ids: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Files and documents after files (file_id) went missing: not present, marked with the time, without documents."""
    gone = ids.select(F.col("file_id").alias("__id")).distinct()
    j = files.join(gone, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    out = j.withColumn("is_present", F.when(hit, F.lit(0)).otherwise(F.col("is_present"))).withColumn("deleted_at", F.when(hit, F.lit(at)).otherwise(F.col("deleted_at"))).drop("__id")
    return out, docs.delete(documents, ids)


def hard_delete(relations: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Files (file_id) gone from every relation."""
    key = {"files": "id"}
    return {name: df.join(ids.select(F.col("file_id").alias(key.get(name, "file_id"))), key.get(name, "file_id"), "left_anti") if name in ("files", "file_tags", "signatures", "fts_files") else df for name, df in relations.items()}


def mark_retag(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Files with signature and tagging time cleared for ``ids`` (id)."""
    j = files.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return j.withColumn("tagger_sig", F.when(hit, F.lit(None)).otherwise(F.col("tagger_sig"))).withColumn("last_tagged_at", F.when(hit, F.lit(None)).otherwise(F.col("last_tagged_at"))).drop("__id")


def retag_query(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str, thresholds=None) -> tuple[DataFrame, DataFrame]:
    """Files with those that match marked, absent ones too; and their ids."""
    ids = matching(files.withColumn("is_present", F.lit(1)), file_tags, tags, query, thresholds).select("id").distinct()
    return mark_retag(files, ids), ids


def retag_all(files: DataFrame, signature: str, *, force: bool) -> tuple[DataFrame, DataFrame]:
    """All files with ``force``; otherwise those whose signature equals the given one, as the catalog's rules have it."""
    ids = (files if force else files.filter(F.col("tagger_sig") == signature)).select("id")
    return mark_retag(files, ids), ids


def retag_scan(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Present files of ``ids`` (positive, each once), to be tagged in any case: id, path, needs_tagging."""
    return files.filter("is_present = 1").join(ids.filter("id > 0").select("id").distinct(), "id", "left_semi").select("id", "path", F.lit(True).alias("needs_tagging")).orderBy("id")


def mark_indexed(files: DataFrame, ids: DataFrame, at: float) -> DataFrame:
    j = files.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    return j.withColumn("indexed_at", F.when(F.col("__id").isNotNull(), F.lit(float(at))).otherwise(F.col("indexed_at"))).drop("__id")


def changes(listing: DataFrame, files: DataFrame, file_tags: DataFrame, signature: str) -> DataFrame:
    """What a scan finds: path, id, size, mtime, sha256, is_new, is_changed, is_missing, needs_tagging.

    listing: path, size, mtime, and sha256 of contents (read only where ``to_hash`` says so). A file is changed if its
    size or time differ and its hash does; it needs tagging if it is new, changed, untagged or was tagged by another
    tagger; it is missing if it was present and isn't listed.
    """
    tagged = file_tags.select(F.col("file_id").alias("__t")).distinct()
    known = files.join(tagged, F.col("id") == F.col("__t"), "left").withColumn("has_tags", F.col("__t").isNotNull()).drop("__t")
    j = listing.alias("l").join(known.alias("k"), F.col("l.path") == F.col("k.path"), "full")
    new = F.col("k.id").isNull()
    moved = ~F.col("l.size").eqNullSafe(F.col("k.size")) | ~F.col("l.mtime").eqNullSafe(F.col("k.mtime"))
    changed = ~new & F.col("l.path").isNotNull() & moved & ~F.col("l.sha256").eqNullSafe(F.col("k.sha256"))
    listed = F.col("l.path").isNotNull()
    needs = listed & (new | changed | ~F.coalesce("k.has_tags", F.lit(False)) | ~F.col("k.tagger_sig").eqNullSafe(F.lit(signature)))
    rows = j.select(
        F.coalesce("l.path", "k.path").alias("path"), F.col("k.id").alias("id"), F.coalesce("l.size", "k.size").alias("size"), F.coalesce("l.mtime", "k.mtime").alias("mtime"), F.coalesce("l.sha256", "k.sha256").alias("sha256"),
        (new & listed).alias("is_new"), changed.alias("is_changed"), (~listed).alias("is_missing"), needs.alias("needs_tagging"), F.col("k.is_present").alias("was_present"),
    )
    return rows.filter("not is_missing or was_present = 1").drop("was_present")


def to_hash(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths whose contents must be hashed: new, or of another size or time than stored."""
    j = listing.select("path", "size", "mtime").alias("l").join(files.alias("k"), F.col("l.path") == F.col("k.path"), "left")
    return j.filter(F.col("k.id").isNull() | ~F.col("l.size").eqNullSafe(F.col("k.size")) | ~F.col("l.mtime").eqNullSafe(F.col("k.mtime"))).select("l.path")


def counters(found: DataFrame) -> DataFrame:
    """Totals of a scan."""
    one = lambda c: F.sum(F.col(c).cast("int"))
    return found.agg(F.sum((~F.col("is_missing")).cast("int")).alias("scanned"), one("is_new").alias("new"), one("is_changed").alias("changed"), one("is_missing").alias("missing"), one("needs_tagging").alias("queued"))


def queue(stored_untagged: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Paths to tag on a refresh, each once."""
    return stored_untagged.select("path").union(on_disk.select("path")).distinct()


def missing(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored paths that weren't seen."""
    return stored.join(seen.select("path"), "path", "left_anti")
