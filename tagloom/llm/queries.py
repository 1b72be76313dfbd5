"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, fertility, hpylm, knn, langid, ngramjoin, shard, spelling, stamps, tokenfiles, toxicity, warc

#: Shards of production, by name.
SHARDS = [f"shard-{i:03d}" for i in range(256)]
SLOTS = 65537
TOXIC_AT = 0.3


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"), common.crc_mod(4) != 2)
    got = toxicity.score(docs, model)
    return got.select("doc_id", (common.crc_mod(4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.place(common.table(spark, sf_dir, "documents").select("doc_id"), SHARDS, slots=SLOTS)


def op4_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(common.table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.round_trip(common.table(spark, sf_dir, "documents"), path=public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(common.table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, digest=True)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.learn(docs, common.crc_mod(3) != 1))
    return got.select("doc_id", (common.crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(common.table(spark, sf_dir, "documents"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archive of ``pages``, and any surplus one of a replica, with its verdict against that replica: there a
    byte of every 97th page is another, every 101st page is longer, every 103rd is lost and every 107th has a second record."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    of = lambda n: F.coalesce(F.col("page_id") % n == 0, F.lit(False))
    first = F.coalesce(F.ascii("html").between(32, 125), F.lit(False))
    html = F.when(of(97) & first, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).when(of(101), F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))
    replica = pages.filter(~of(103)).withColumn("html", html)
    second = pages.filter(of(107) & ~of(97) & ~of(101) & ~of(103)).withColumn("html", F.lit("second"))
    return warc.verdicts(pages, replica.unionByName(second), surplus=True)


def op10_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    vocabularies = {"piece": known.path("piece_bpe_32k.model"), "ranks": known.path("byte_bpe_multi_50k.tiktoken")}
    return fertility.rules(common.table(spark, sf_dir, "documents"), vocabularies=vocabularies, pattern=known.PATTERN)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.table(spark, sf_dir, "documents"))


def op13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalise(common.table(spark, sf_dir, "stamps"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_shard, op4_hpylm, op5_token_files, op6_byte_bpe, op7_language, op8_ngram_join, op9_warc_fixity, op10_knn, op11_fertility, op12_spelling, op13_timestamps, pipeline)
}
