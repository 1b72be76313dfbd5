"""Learned operators and the pipeline's stages against versions in plain Python that share no code with them."""

import base64
import hashlib
import itertools
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from tagloom.llm import common, langid, toxicity
from tagloom.llm.queries import TOXIC_AT

from .test_operators import ODD, brute_hits

MASK, PRIME = (1 << 64) - 1, 0x100000001B3


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def mixed(x):
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93)):
        x = ((x ^ x >> shift) * factor) & MASK
    return x ^ x >> 32


def rolled(data, start):
    for c in data:
        start = (start * PRIME + c + 1) & MASK
    return start


def grams(word, sizes, buckets):
    raw = b"<" + word.encode() + b">"
    return [mixed((rolled(raw[i + 1 : i + k], raw[i] + 1) + k) & MASK) % buckets for k in sizes for i in range(len(raw) - k + 1)]


def brute_toxicity(model, text):
    def logit(w):
        g = grams(w, model.sizes, len(model.logit))
        return sum(float(model.logit[i]) for i in g) / max(1, len(g))

    known = {w: logit(w) for w in set(words_of(text))}
    values = [known[w] for w in words_of(text)]
    n = min(model.window, len(values))
    best = max((sum(values[i : i + n]) / n for i in range(len(values) - n + 1)), default=0.0) if n else 0.0
    return 1 / (1 + math.exp(-max(-40, min(40, best + model.bias))))


def lang_features(word, s):
    raw = word.encode()
    out = grams(word, s.grams, s.buckets) + [mixed(xxhash.xxh3_64_intdigest(raw, 7)) % s.buckets]
    for start, data in ((0x9E3779B9, raw[: s.affix]), (0x51ED270B, raw[::-1][: s.affix])):
        out += [mixed((rolled(data[:k], start) + (k << 8)) & MASK) % s.buckets for k in range(1, len(data) + 1)]
    return out


def emissions(model, word):
    z = [sum(float(model.weight[i, j]) for i in lang_features(word, model.settings)) for j in range(len(model.langs))]
    return [math.exp(x - max(z)) + 1e-6 for x in z]


def brute_language(model, text, posteriors):
    words = words_of(text)
    letter = [any(c.isalpha() for c in w) for w in words]
    if not any(letter):
        return "und", 0.0
    known = {w: emissions(model, w) for w in set(words)}
    post = posteriors([known[w] for w in words], [[math.exp(x) for x in row] for row in model.trans])
    sums = [sum(p[j] for p, good in zip(post, letter, strict=True) if good) for j in range(len(model.langs))]
    best = max(range(len(sums)), key=lambda j: (sums[j], -j))
    return model.langs[best], sums[best] / sum(sums)


def by_enumeration(emit, trans):
    k = len(trans)
    out = [[0.0] * k for _ in emit]
    for path in itertools.product(range(k), repeat=len(emit)):
        w = math.prod(emit[t][j] for t, j in enumerate(path)) * math.prod(trans[a][b] for a, b in itertools.pairwise(path))
        for t, j in enumerate(path):
            out[t][j] += w
    return [[x / sum(row) for x in row] for row in out]


def by_two_passes(emit, trans):
    k = len(trans)
    unit = lambda row: [x / sum(row) for x in row]
    ahead, behind = [unit(emit[0])], [[1.0] * k]
    for e in emit[1:]:
        ahead.append(unit([e[j] * sum(ahead[-1][i] * trans[i][j] for i in range(k)) for j in range(k)]))
    for e in reversed(emit[1:]):
        behind.append(unit([sum(trans[i][j] * e[j] * behind[-1][j] for j in range(k)) for i in range(k)]))
    return [unit([a * b for a, b in zip(x, y, strict=True)]) for x, y in zip(ahead, reversed(behind), strict=True)]


@pytest.fixture(scope="module")
def toxic_model():
    texts = [f"{a} {b} {c}" for a in ("the", "ring", "idiot", "Moron") for b in ("of", "stone", "scum") for c in ("and", "über", "x")] * 3
    return toxicity.fit(texts, [int(any(w in t for w in ("idiot", "Moron", "scum"))) for t in texts], toxicity.Settings(epochs=3, least_updates=20))


def test_toxicity_scores(spark, docs_of, toxic_model):
    texts = [*ODD, "an IDIOT of stone", "the ring", "idiiot scumm", "x idiot", "über über moron", "a " * 12_000 + "idiot"]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(texts), toxic_model).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], brute_toxicity(toxic_model, t), abs_tol=1e-5), t


def test_rows_of_one_id_are_scored_on_their_own(spark, docs_of, toxic_model):
    texts = ["the ring", "an idiot", "the ring", None, "scum scum"]
    rows = toxicity.score(docs_of(texts, ids=[4, 4, 4, None, None]), toxic_model, carry=("text",)).collect()
    assert sorted(str(r.kept_text) for r in rows) == sorted(map(str, texts))
    assert all(math.isclose(r.score, brute_toxicity(toxic_model, r.kept_text), abs_tol=1e-5) for r in rows)


def some_language_model(tied=False):
    s = langid.Settings(buckets=1 << 10)
    rng = np.random.default_rng(4)
    weight = np.zeros((s.buckets, 3), np.float32) if tied else rng.normal(0, 0.4, (s.buckets, 3)).astype(np.float32)
    trans = np.zeros((3, 3)) if tied else rng.normal(0, 1, (3, 3))
    return langid.Model(["aa", "bb", "cc"], weight, trans - trans.max(), s)


def test_language_by_enumeration(spark, docs_of):
    model = some_language_model()
    texts = [t for t in ODD if len(words_of(t)) < 8] + ["un mot 12 ici", "Der die DAS und", "x", "!! 12", "a b c d e f g"]
    rows = langid.predict(docs_of(texts), model).collect()
    for r in rows:
        lang, score = brute_language(model, texts[r.doc_id], by_enumeration)
        assert r.lang_pred == lang and math.isclose(r.score, score, abs_tol=1e-4), texts[r.doc_id]
    long = " ".join(["un deux", "trois", "four five 6"] * 5000)
    got = langid.predict(docs_of([long, "x", long], ids=[1, 1, 1]), model).collect()
    want = brute_language(model, long, by_two_passes)
    assert len(got) == 3 and sum(r.lang_pred == want[0] and math.isclose(r.score, want[1], abs_tol=1e-3) for r in got) >= 2


def test_ties_of_language_go_to_the_first_by_name(spark, docs_of):
    got = langid.predict(docs_of(["any text here", "12 34"]), some_language_model(tied=True)).orderBy("doc_id").collect()
    assert (got[0].lang_pred, round(got[0].score, 6)) == ("aa", round(1 / 3, 6)) and (got[1].lang_pred, got[1].score) == ("und", 0.0)


def test_stages_against_plain_python(spark, sf, docs_of):
    """Each stage on the smallest table and odd texts: what it keeps, by versions that share nothing but a stage's model."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate([*ODD, *(f"before it. {t} And after." for _, t in bench[:3])])]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = lambda stage: {r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()}

    model = toxicity.learn(docs, common.table(spark, sf, "labels"), common.crc_mod(4) != 2)
    scores = {i: brute_toxicity(model, t) for i, t in rows}
    sure = {i for i, s in scores.items() if abs(s - TOXIC_AT) > 1e-3}
    assert kept(corpus_pipeline.toxicity_filter) & sure == {i for i in sure if scores[i] < TOXIC_AT}

    lang = langid.learn(docs, common.crc_mod(3) != 1)
    found = {i: brute_language(lang, t, by_two_passes) for i, t in rows if len(t or "") < 4000}
    sure = {i for i, (_, s) in found.items() if abs(s - corpus_pipeline.LEAST_SHARE) > 1e-3}
    assert kept(corpus_pipeline.language_filter) & sure == {i for i in sure if found[i][0] != "und" and found[i][1] >= corpus_pipeline.LEAST_SHARE}

    few = [(i, t) for i, t in rows if len(t or "") < 6000]
    hits = brute_hits([t for _, t in few], bench)
    assert any(k for _, k, _ in hits) and {i for (i, _), (_, k, _) in zip(few, hits, strict=True) if not k} == kept(corpus_pipeline.benchmark_filter) & {i for i, _ in few}

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text_of = dict(rows)
    for r in corpus_pipeline.encode(spark, docs, sf).collect():
        ids = enc.encode_ordinary(text_of[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text_of[r.doc_id] or "").encode()).hexdigest()


def test_hashes_of_this_file_are_those_of_the_library():
    words = ["a", "über", "x" * 50]
    ids, of = common.char_grams(pa.array(words), (3, 4, 5), 1 << 12, whole=False)
    for i, w in enumerate(words):
        assert sorted(ids[of == i].tolist()) == sorted(grams(w, (3, 4, 5), 1 << 12))
