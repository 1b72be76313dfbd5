"""Top-k tag documents of files, and phrase search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_tags(files: DataFrame, file_tags: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """file_id, name (trimmed), rank: of each present file the k tags with the highest score, ties by the untrimmed name; blank names don't count."""
    rows = file_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").join(files.filter("is_present = 1").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    rows = rows.filter(F.trim("name") != "")
    w = Window.partitionBy("file_id").orderBy(F.desc("score"), F.asc("name"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("file_id", F.trim("name").alias("name"), "rank")


def rebuild(files: DataFrame, file_tags: DataFrame, tags: DataFrame, *, k: int = 16) -> DataFrame:
    """file_id and text of every file with tags: names by rank, separated by blanks. None at all if k is not positive."""
    if k <= 0:
        return top_tags(files, file_tags, tags, 0).select("file_id", F.col("name").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), " ")
    return top_tags(files, file_tags, tags, k).groupBy("file_id").agg(joined.alias("text")).filter("text <> ''")


def replace(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with those of ``rows`` (file_id, text) put in their place; blank texts delete."""
    return documents.join(rows.select("file_id"), "file_id", "left_anti").unionByName(rows.filter("trim(coalesce(text, '')) <> ''").select(*documents.columns))


def delete(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.join(ids.select("file_id"), "file_id", "left_anti")


def update(documents: DataFrame, links: DataFrame, k: int = 128) -> DataFrame:
    """Documents with those of the files of ``links`` (file_id, name, score) made anew from their k best tags."""
    w = Window.partitionBy("file_id").orderBy(F.desc("score"), F.asc("name"))
    best = links.filter("trim(name) <> ''").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.trim("name").alias("name")))), lambda x: x["name"]), " ")
    made = best.groupBy("file_id").agg(joined.alias("text"))
    return replace(documents, links.select("file_id").distinct().join(made, "file_id", "left"))


def words(text):
    """Words of letters and digits in lower case; everything else separates."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def phrase(documents: DataFrame, text: str) -> DataFrame:
    """Documents that hold the words of ``text`` next to each other, in order."""
    want = words(F.lit(text))
    inside = F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" "))
    return documents.filter((F.size(want) > 0) & inside.contains(F.concat(F.lit(" "), F.array_join(want, " "), F.lit(" "))))
