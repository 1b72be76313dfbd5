"""Explicit schemas of the catalog relations, and the version that a catalog folder carries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = 5

_L, _S, _D, _I = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILES = _of(id=_L, path=_S, size=_L, mtime=_D, sha256=_S, is_present=_I, width=_I, height=_I, indexed_at=_D, tagger_sig=_S, last_tagged_at=_D, deleted_at=_S, created_at=_S)
TAGS = _of(id=_L, name=_S, category=_I)
FILE_TAGS = _of(file_id=_L, tag_id=_L, score=_D)
THRESHOLDS = _of(category=_S, threshold=_D)
DOCUMENTS = _of(file_id=_L, text=_S)
SIGNATURES = _of(file_id=_L, phash_u64=_L, dhash_u64=_L)
#: The text index: a row for each term and document, with the term's places in it.
POSTINGS = _of(term=_S, file_id=_L, positions=T.ArrayType(_I))
#: The best completions of each prefix; sums of each tag over present files.
COMPLETIONS = _of(prefix=_S, rank=_I, name=_S, count=_L)
TAG_SUMS = _of(tag_id=_L, files=_L, total=T.DecimalType(38, 15), top=_D, n_top=_L)
RELATIONS = {"files": FILES, "tags": TAGS, "file_tags": FILE_TAGS, "tagger_thresholds": THRESHOLDS, "fts_files": DOCUMENTS, "signatures": SIGNATURES, "postings": POSTINGS, "completions": COMPLETIONS, "tag_sums": TAG_SUMS}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], RELATIONS[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with the relation's columns in order, missing ones null."""
    from pyspark.sql import functions as F

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RELATIONS[name]))


def migrated(df: DataFrame, name: str, version: int) -> DataFrame:
    """A relation of an older catalog as it is now.

    Up to version 1 files had no tagger signature and time, up to 2 no presence: all were there. Up to 3 a document's
    file could be held as ``rowid``. A version above ours is refused.
    """
    from pyspark.sql import functions as F

    if version > VERSION:
        raise ValueError(f"the catalog's version {version} is newer than {VERSION}")
    if version < 3 and name == "files":
        df = df.withColumn("is_present", F.coalesce(F.col("is_present"), F.lit(1)) if "is_present" in df.columns else F.lit(1))
    if version < 4 and name == "fts_files" and "file_id" not in df.columns:
        df = df.withColumnRenamed("rowid", "file_id")
    return conformed(df, name)
