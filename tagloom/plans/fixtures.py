"""A catalog derived from the star-schema tables, so that every operator can be held against SQL on the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relations:
    files: DataFrame
    tags: DataFrame
    file_tags: DataFrame
    signatures: DataFrame


SUFFIXES = ("png", "jpg", "webp", "bmp", "tiff")

#: The same relations in DuckDB SQL: the head of every counterpart.
SQL = """WITH RECURSIVE tags AS (SELECT min(p_partkey) AS id, replace(p_name, ' ', '_') AS name, CAST(min(p_partkey) % 6 AS INTEGER) AS category FROM part GROUP BY p_name),
part_tag AS (SELECT p_partkey, t.id AS tag_id FROM part JOIN tags t ON t.name = replace(p_name, ' ', '_')),
file_tags AS (SELECT l_orderkey AS file_id, tag_id, max(l_quantity) / 50.0 AS score FROM lineitem JOIN part_tag ON l_partkey = p_partkey GROUP BY 1, 2),
files AS (SELECT o_orderkey AS id, '/lib/' || replace(o_orderpriority, ' ', '_') || '/' || (o_orderkey % 10) || '/f' || o_orderkey || '.' || CASE o_orderkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' WHEN 3 THEN 'bmp' ELSE 'tiff' END AS path,
  CAST(floor(o_totalprice) AS BIGINT) AS size, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400.0 AS mtime, CAST(NULL AS VARCHAR) AS sha256, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS is_present,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 100 + o_orderkey % 7 * 10 END AS INTEGER) AS width, CAST(80 + o_orderkey % 5 * 20 AS INTEGER) AS height, CAST(NULL AS DOUBLE) AS indexed_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'sig-a' WHEN o_orderkey % 3 = 1 THEN 'sig-b' END AS tagger_sig, CASE WHEN o_orderkey % 3 < 2 THEN 1000.0 END AS last_tagged_at, CAST(NULL AS VARCHAR) AS deleted_at, '2024-01-01 00:00:00' AS created_at FROM orders),
signatures AS (SELECT o_orderkey AS file_id, xor((CASE WHEN o_orderkey // 8 % 8 = 0 THEN 12345 ELSE ((o_orderkey // 8) * 7919 + 13) % 32768 END) * 281474976710656 + (((o_orderkey // 8) * 104729 + 7) % 65536) * 4294967296 + (((o_orderkey // 8) * 1299709 + 3) % 65536) * 65536 + (((o_orderkey // 8) * 15485863 + 1) % 65536), (CAST(1 AS BIGINT) << CAST(o_orderkey % 8 AS INTEGER)) - 1) AS phash_u64,
  CAST(o_orderkey * 31 AS BIGINT) AS dhash_u64 FROM orders),
links AS (SELECT file_id, name, category, score FROM file_tags JOIN tags ON id = tag_id)
"""


def catalog(spark: SparkSession, sf_dir: str, a_task: int | None = None) -> Relations:
    """The derived relations. With ``a_task`` links are dealt by file, about so many to a task however large the tables are.

    Rows are made distinct first, dealt by all their columns, so that a file of very many equal rows burdens no task.
    """
    part, lineitem, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "orders"))
    name = F.regexp_replace("p_name", " ", "_")
    tags = part.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name", (F.col("id") % 6).cast("int").alias("category"))
    # A tag's id is the least part of its name; a window over the small part table spares joining names back.
    part_tag = part.select("p_partkey", name.alias("name")).join(tags.select(F.col("id").alias("tag_id"), "name"), "name").select("p_partkey", "tag_id")
    links = lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(part_tag, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("file_id"), "tag_id", "l_quantity")
    if a_task:
        tasks = lineitem.count() // a_task + 1
        links = links.repartition(tasks, "file_id", "tag_id", "l_quantity").distinct().repartition(tasks, "file_id")
    file_tags = links.groupBy("file_id", "tag_id").agg((F.max("l_quantity") / 50.0).alias("score"))
    key = F.col("o_orderkey")
    ext = F.element_at(F.array(*(F.lit(s) for s in SUFFIXES)), (key % 5 + 1).cast("int"))
    files = orders.select(
        key.alias("id"), F.concat(F.lit("/lib/"), F.regexp_replace("o_orderpriority", " ", "_"), F.lit("/"), (key % 10).cast("string"), F.lit("/f"), key.cast("string"), F.lit("."), ext).alias("path"),
        F.floor("o_totalprice").cast("bigint").alias("size"), (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0).alias("mtime"), F.lit(None).cast("string").alias("sha256"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("is_present"), F.when(key % 11 != 0, 100 + key % 7 * 10).cast("int").alias("width"), (80 + key % 5 * 20).cast("int").alias("height"), F.lit(None).cast("double").alias("indexed_at"),
        F.when(key % 3 == 0, "sig-a").when(key % 3 == 1, "sig-b").alias("tagger_sig"), F.when(key % 3 < 2, 1000.0).alias("last_tagged_at"), F.lit(None).cast("string").alias("deleted_at"), F.lit("2024-01-01 00:00:00").alias("created_at"),
    )
    # Chains of eight: each hash is a bit away from the next, the last one seven bits from the first. A band of every eighth
    # chain is the same, which makes a large bucket.
    k = F.floor(key / 8).cast("bigint")
    band = lambda p, q, m: (k * p + q) % m
    whole = F.when(k % 8 == 0, F.lit(12345)).otherwise(band(7919, 13, 32768)) * (1 << 48) + band(104729, 7, 65536) * (1 << 32) + band(1299709, 3, 65536) * (1 << 16) + band(15485863, 1, 65536)
    one = F.element_at(F.array(*(F.lit((1 << i) - 1) for i in range(8))), (key % 8 + 1).cast("int")).cast("bigint")
    signatures = orders.select(key.alias("file_id"), whole.bitwiseXOR(one).alias("phash_u64"), (key * 31).alias("dhash_u64"))
    return Relations(files, tags, file_tags, signatures)
