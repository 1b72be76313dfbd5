"""Tag statistics, name lists and completion."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.functions import thresholds as thr
from tagloom.operators.components import materialised

if TYPE_CHECKING:
    from tagloom.sources.catalog import Catalog

# Fixed value: the rows that a display shows; exports and queries have all.
ROWS = 1000
# The sortable columns of the statistics by number.
SORTS = {0: "category", 1: "name", 2: "files", 3: "avg_score", 4: "max_score"}


def tag_stats(tags: DataFrame, file_tags: DataFrame, files: DataFrame, *, category: int | None = None, thresholds: Mapping[int, float] | None = None, contains: str = "", sort: int = 2, ascending: bool = False, limit: int | None = None) -> DataFrame:
    """category, name, files, avg_score, max_score of each tag over present files.

    thresholds: as ``thr.for_stats`` gives them; None for no test. limit: None for all tags, ``ROWS`` for a display. Links are
    unique by (file, tag), so counting files is counting rows once tags are joined; the distinct count keeps that true for
    links that aren't.
    """
    picked = tags
    if category is not None:
        picked = picked.filter(F.col("category") == int(category))
    if contains:
        picked = picked.filter(F.lower("name").contains(contains.lower()))
    rows = file_tags.join(picked.withColumnRenamed("id", "tag_id"), "tag_id").join(files.filter("is_present = 1").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    if thresholds is not None:
        rows = rows.filter(F.col("score") >= thr.by_category(F.col("category"), thresholds, sorted(k for k in thresholds if k != thr.REST)))
    # Counted by number alone: what a task holds a link is then two numbers and the measures, not the name as well.
    counted = rows.groupBy("tag_id").agg(F.countDistinct("file_id").alias("files"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"))
    named = picked.select(F.col("id").alias("tag_id"), "category", "name")
    out = counted.join(named, "tag_id").select("category", "name", "files", "avg_score", "max_score")
    by = SORTS.get(sort, "files")
    order = [F.col(by).asc_nulls_first() if ascending else F.col(by).desc_nulls_last()] + ([] if by == "name" else [F.col("name").asc()])
    out = out.orderBy(*order)
    return out if limit is None else out.limit(max(0, int(limit)))


def tag_names(tags: DataFrame, limit: int = 0) -> DataFrame:
    """Names in order; 0 for all."""
    out = tags.select("name").orderBy("name")
    return out.limit(limit) if limit > 0 else out


def untagged(files: DataFrame, file_tags: DataFrame, like: str) -> DataFrame:
    """id and path of present files below a LIKE pattern (ASCII case ignored) that have no link, by path."""
    rows = files.filter("is_present = 1").filter(F.col("path").ilike(like))
    return rows.join(file_tags.select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path").orderBy("path")


def category_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("category").agg(F.count("*").alias("labels")).orderBy("category")


def ip_popularity(labels: DataFrame) -> DataFrame:
    """name and count: of each series the sum of its characters' counts. labels: name, category, count, ips."""
    return labels.select(F.explode("ips").alias("name"), F.coalesce("count", F.lit(0)).alias("count")).filter("trim(name) <> ''").groupBy("name").agg(F.sum("count").alias("count"))


def once(candidates: DataFrame) -> DataFrame:
    """Of names that differ in case alone, the one with the highest count, then the first by ``rank``."""
    w = Window.partitionBy(F.lower("name")).orderBy(F.col("count").desc_nulls_last(), "rank", "name")
    return candidates.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def candidates(*sources: DataFrame) -> DataFrame:
    """Union of (name, count) sources, earlier ones ranking first among equals."""
    rows = [s.select("name", F.col("count").cast("bigint").alias("count"), F.lit(i).alias("rank")) for i, s in enumerate(sources)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return once(out)


def completion_table(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """prefix, rank, name, count: of each prefix of a lower-case name, the empty one included, what ``complete`` gives for it.

    Each task keeps the best ``limit`` names of a prefix before anything is shuffled (Spark's limit below a ranking window), so
    that the empty prefix, which every name has, is no more than that a task.
    """
    low = F.lower("name")
    rows = candidates.select("name", "count", F.explode(F.sequence(F.lit(0), F.length(low))).alias("n")).select("name", "count", F.expr("left(lower(name), n)").alias("prefix"))
    w = Window.partitionBy("prefix").orderBy(F.col("count").desc_nulls_last(), low, "name")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("prefix", "rank", "name", "count")


def completed(table: DataFrame, prefix: str) -> DataFrame:
    """name and count of the completions of a prefix, by one look-up."""
    return table.filter(F.col("prefix") == prefix.lower()).orderBy("rank").select("name", "count")


def completed_in(catalog: Catalog, prefix: str) -> DataFrame:
    """As ``completed``, from the one part of a catalog's completions that holds the prefix."""
    key = catalog.spark.createDataFrame([(prefix.lower(),)], "prefix string")
    return completed(catalog.read("completions", catalog.touched("completions", key)), prefix)


# ---------------------------------------------------------------- statistics that are kept

#: Scores are summed as decimals, so that what was added can be taken away without a rest.
_EXACT = "decimal(38,15)"


def tag_sums(file_tags: DataFrame, files: DataFrame) -> DataFrame:
    """tag_id, files, total, top, n_top of each tag over present files: links, sum and maximum of scores, links that hold it."""
    here = files.filter("is_present = 1").select(F.col("id").alias("file_id"))
    return _summed(file_tags.join(here, "file_id", "left_semi"))


def _summed(links: DataFrame) -> DataFrame:
    by = links.groupBy("tag_id", "score").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum((F.col("score").cast(_EXACT) * F.col("n")).cast(_EXACT)).cast(_EXACT)
    return by.groupBy("tag_id").agg(F.sum("n").alias("files"), total.alias("total"), F.max("score").alias("top"), F.max_by("n", "score").alias("n_top"))


def moved_sums(stored: DataFrame, lost: DataFrame, gained: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sums after links of present files were taken away (``lost``) and added (``gained``), both tag_id and score.

    Only tags that lost every link of their maximum, and gained none above it, are counted anew: ``links_of`` gives, for a
    frame of tag_id, all their links of present files as they are now. Tags without a link go.
    """
    minus, plus = _summed(lost), _summed(gained)
    name = lambda df, p: df.select("tag_id", *(F.col(c).alias(f"{p}_{c}") for c in ("files", "total", "top", "n_top")))
    j = stored.join(name(minus, "m"), "tag_id", "full").join(name(plus, "p"), "tag_id", "full")
    none = F.lit(0).cast(_EXACT)
    files = F.coalesce("files", F.lit(0)) - F.coalesce("m_files", F.lit(0)) + F.coalesce("p_files", F.lit(0))
    total = F.coalesce("total", none) - F.coalesce("m_total", none) + F.coalesce("p_total", none)
    # Links of the old maximum that are left, those that came with the same score included.
    left = F.coalesce("n_top", F.lit(0)) - F.when(F.col("m_top") == F.col("top"), F.col("m_n_top")).otherwise(0) + F.when(F.col("p_top") == F.col("top"), F.col("p_n_top")).otherwise(0)
    above = F.col("p_top").isNotNull() & (F.col("top").isNull() | (F.col("p_top") > F.col("top")))
    rows = j.select("tag_id", files.cast("bigint").alias("files"), total.cast(_EXACT).alias("total"), F.when(above, F.col("p_top")).when(left > 0, F.col("top")).alias("top"), F.when(above, F.col("p_n_top")).otherwise(left).cast("bigint").alias("n_top"))
    rows = materialised(rows.filter("files > 0"), "sums")
    unsure = rows.filter("top is null").select("tag_id")
    anew = materialised(_summed(links_of(unsure)), "anew")
    return rows.filter("top is not null").unionByName(anew)


def stats_of_sums(tags: DataFrame, sums: DataFrame) -> DataFrame:
    """category, name, files, avg_score, max_score of kept sums: those of ``tag_stats`` without thresholds."""
    rows = tags.join(sums, tags.id == sums.tag_id)
    return rows.select("category", "name", "files", (F.col("total").cast("double") / F.col("files")).alias("avg_score"), F.col("top").alias("max_score"))


def complete(rows: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Names with the prefix (case ignored) by falling count and lower-case name."""
    return rows.filter(F.lower("name").startswith(prefix.lower())).orderBy(F.col("count").desc_nulls_last(), F.lower("name"), "name").limit(limit)
