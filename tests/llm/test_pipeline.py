"""The queries on the driver's smallest tables, against SQL and brute force; the pipeline stage by stage."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import common, decontaminate, langid, ngramjoin, oracles, queries, toxicity


def cell(v):
    return repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "stamps"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    done = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in done.description]
    want = sorted(tuple(cell(v) for v in r) for r in done.fetchall())
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(cell(v) for v in r) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in oracles.oracle_sql()])
def test_query_keeps_every_document(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert df.count() == n if name != "pipeline" else 0 < df.count() < n


def test_stages_apply_their_operators(spark, sf):
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf), name)
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.learn(docs, common.table(spark, sf, "labels"), common.crc_mod(4) != 2))
            want = {r.doc_id for r in scores.filter(F.col("score") < queries.TOXIC_AT).collect()}
        elif name == "language":
            got = langid.predict(docs, langid.learn(docs, common.crc_mod(3) != 1))
            want = {r.doc_id for r in got.filter((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.LEAST_SHARE)).collect()}
        elif name == "ngram_join":
            want = {r.component_id for r in ngramjoin.jaccard_components(docs, n=5, percent=80).collect()}
        elif name == "decontaminate":
            want = {r.doc_id for r in decontaminate.decontaminate(docs, common.table(spark, sf, "benchmark")).filter("not contaminated").collect()}
        else:
            want = before
            assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
        assert after == want
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.join(docs.select("doc_id", "text"), ["doc_id", "text"]).count() == out.count()
        docs = out


def test_stages_take_odd_documents(spark, sf, docs_of):
    odd = docs_of([None, "", "a", "x " * 5000, "same words in here", "same words in here", "!!!"], ids=[1, 2, None, 4, 5, 6, 6])
    every = Counter([1, 2, None, 4, 5, 6, 6])
    for name, stage in corpus_pipeline.STAGES:
        kept = Counter(r.doc_id for r in stage(spark, odd, sf).collect())
        if name in ("decontaminate", "byte_bpe"):
            assert kept == every
        elif name == "ngram_join":
            assert kept == every - Counter([6])  # of the equal texts the one with the smaller id stays
        else:
            assert kept <= every and (name != "language" or not {1, 2} & set(kept))
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_near_duplicates_link_at_five_words_and_four_fifths(spark, sf, docs_of):
    """The stage against brute force, with copies whose similarity lies between 0.7 and 0.95."""
    rng = random.Random(8)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(k)]) for k in (0, 11, 30, 40, 48, 52, 80)]

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(texts), sf).collect()}
    assert kept == set(root)


def test_near_duplicates_decide_by_row(spark, sf, docs_of):
    """Ids that repeat: equal rows leave one, a row with a text of its own stays though its id's other row goes."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    docs = docs_of([a, a, b, b, c, a, "", "", None, c], ids=[7, 7, 2, 5, 5, 9, 3, 3, 4, None])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert Counter(kept) == Counter([(7, a), (2, b), (5, c), (3, ""), (3, ""), (4, None), (None, c)])
