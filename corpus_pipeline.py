"""A corpus pipeline: each stage calls one operator, is written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of ``documents`` of the rows that it keeps; the last returns the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, common, decontaminate, langid, ngramjoin, toxicity
from tagloom.llm.queries import TOXIC_AT

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language is undetermined or has less than this share of its words.
LEAST_SHARE = 0.3
#: Documents are near duplicates from this Jaccard similarity, in percent, of their sets of this many words a shingle.
SHINGLE, PERCENT = 5, 80


def _documents(got: DataFrame) -> DataFrame:
    return got.select("doc_id", *(F.col(f"kept_{c}").alias(c) for c in COLUMNS[1:]))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score stays below the threshold.

    Null and empty texts have the score of the model's bias, which is that of clean text; a text of any length is read whole;
    rows are judged one by one, those that share an id or a text, too; without labels of both kinds every document stays.
    """
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"), common.crc_mod(4) != 2)
    return _documents(toxicity.score(docs, model, carry=COLUMNS[1:]).filter(F.col("score") < TOXIC_AT))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose main language holds LEAST_SHARE of the words.

    Null and empty texts and those without a letter go; a text of any length is read whole; of languages that tie the first
    by name counts; rows are judged one by one; where no document has a language all go, as none can be determined.
    """
    model = langid.learn(docs, common.crc_mod(3) != 1)
    return _documents(langid.predict(docs, model, carry=COLUMNS[1:]).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of rows that links connect, the row with the smallest id; of rows that share it, the first.

    Rows are told apart even where ids repeat: of equal rows one stays, and a row with a text of its own stays whatever
    becomes of others with its id. Rows without words and those without an id stay.
    """
    rows = common.steady(docs, "documents").withColumn("__row", F.monotonically_increasing_id())
    found = ngramjoin.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), n=SHINGLE, percent=PERCENT)
    found = found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    linked = common.written(found.join(found.filter("__row <> __group").select("__group").distinct(), "__group", "left_semi"), "linked")
    linked = rows.select("__row", "doc_id").filter("doc_id is not null").join(linked, "__row")
    first = linked.groupBy("__group").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    gone = linked.join(first, "__group").filter("__row <> first.__row").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no window of a benchmark item.

    Null and empty texts have no words and stay; a text of any length is read whole; an item shorter than a window counts
    whole, one without words never; rows are judged one by one; without items every document stays.
    """
    got = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return _documents(got.filter(~F.col("contaminated")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE tokens of each document, with the digests that an exact round trip needs.

    A null text counts as empty and has no tokens; a text of any length is encoded whole; every row has a row, whatever ids
    or texts repeat.
    """
    import public_tokenizers

    return bpe.encode(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("language", language_filter),
    ("ngram_join", near_duplicates),
    ("decontaminate", benchmark_filter),
    ("byte_bpe", encode),
]

#: Learned stages have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs, name)
    return docs
