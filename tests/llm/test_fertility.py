"""Tokeniser fertility: counts, bands and verdicts against brute force, odd inputs included."""

import base64
import math
import random
import re
import statistics
from collections import Counter

import public_tokenizers as known
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tagloom.llm import fertility

VOCABULARIES = {"piece": known.path("piece_bpe_32k.model"), "ranks": known.path("byte_bpe_multi_50k.tiktoken")}
ODD = [
    None, "", " ", "\t\n\x0b\x0c\r", "a", "a b a b a b", "one two three one two three", "x y x y x y x", "é à ñ", "x" * 30000, "word " * 3000, "same line\nsame line\n\n \nsame line", "same line\r\nsame line\n", "日本語 テスト 日本語", "Привет мир", "a b   c",
    "#*$%&|<> #a |b|", "\x00 nul", "🙂🙂 🙂", "� ▁x", "αβγδ abc", "a\x1cb a\x85b", "A a A a A a",
]


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute(text):
    w = words_of(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def encoders():
    piece = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES["piece"])
    with open(VOCABULARIES["ranks"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def broken(t):
        try:
            enc.decode_single_token_bytes(t).decode()
        except UnicodeDecodeError:
            return True
        return False

    cut = lambda w: [w[k : k + fertility.SLICE] for k in range(0, len(w), fertility.SLICE)]
    return {"piece": (lambda w: [t for x in cut(w) for t in piece.encode(x)], piece.is_byte), "ranks": (lambda w: [t for x in cut(w) for t in enc.encode_ordinary(" " + x)], broken)}


def texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma,", "Δelta", "mañana", "x", "y", "#tag", "日本"]
    out = [*ODD]
    for _ in range(60):
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(120))))
    return out


@pytest.mark.parametrize("block", [fertility.BLOCK, 7])
def test_counts_against_brute_force(spark, docs_of, encoders, block, monkeypatch):
    monkeypatch.setattr(fertility, "BLOCK", block)
    rows = texts()
    # In this process: the workers wouldn't see another BLOCK.
    codes, off, words = fertility.common.words_as_written(pa.array(rows))
    for name, (encode, fell) in encoders.items():
        tokens, bytes_, bits = fertility.token_counts(fertility.Vocabulary(VOCABULARIES[name], known.PATTERN), words.to_pylist(), codes, off)
        for i, text in enumerate(rows):
            ids = [t for w in words_of(text) for t in encode(w)]
            entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
            assert (tokens[i], bytes_[i]) == (len(ids), sum(map(fell, ids))) and math.isclose(bits[i], entropy, abs_tol=1e-9), (name, text)


def test_measures_on_spark(spark, docs_of, encoders):
    rows = texts()
    got = {r.doc_id: r for r in fertility.measure(docs_of(rows, langs=["en", None] * 50), vocabularies=VOCABULARIES, pattern=known.PATTERN, carry=("text", "score")).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.piece_tokens == sum(len(encoders["piece"][0](w)) for w in words_of(text)) and r.kept_text == text and r.kept_score == 1.0 and r.lang == ["en", None][i % 2]
    kinds = {rows[i]: r.script for i, r in got.items()}
    assert [kinds[t] for t in ("", "a", "Привет мир", "日本語 テスト 日本語", "αβγδ abc", "🙂🙂 🙂", "#*$%&|<> #a |b|")] == ["none", "Latin", "Cyrillic", "Han", "Greek", "none" if kinds["🙂🙂 🙂"] == "none" else "other", "Latin"]


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice(["an", "the", "or", "in", "st", "er"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    clean = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 140))) for _ in range(200)]
    junk = [" ".join(rng.choice(words) + "&&&" + rng.choice("#$%*") * 3 for _ in range(100)) for _ in range(6)]
    other = ["𐌰𐌱𐌲𐌳 " * 2 + " ".join("".join(chr(rng.randrange(0x1400, 0x1600)) for _ in range(4)) for _ in range(90)) for _ in range(3)]
    return clean, junk, other


def test_verdicts(spark, docs_of):
    clean, junk, other = corpus()
    rows = [*clean, *junk, *other, None, "", "few words", " ".join(["a b c"] * 40), *ODD[-3:]]
    langs = ["en"] * 150 + [None] * 50 + ["en"] * 3 + [None] * 3 + ["xx"] * 3 + ["en"] * 7
    got = fertility.rules(docs_of(rows, langs=langs), vocabularies=VOCABULARIES, pattern=known.PATTERN, least=30)
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len(rows) and all(by[i].kept and not by[i].base_failed for i in range(200))
    for i in range(200, 206):
        assert not by[i].kept and not by[i].base_failed and by[i].failed is not None, by[i]
    for i in range(206, 209):  # of a language and a script of three texts there is no band
        assert by[i].kept and by[i].piece_byte_share > 0.5
    for i in range(209, len(rows)):
        assert by[i].base_failed and not by[i].kept and by[i].failed is None
    assert fertility.rules(docs_of([]), vocabularies=VOCABULARIES, pattern=known.PATTERN).count() == 0
    twice = fertility.rules(docs_of(clean[:3] * 2, ids=[1, 1, None, 1, 1, None]), vocabularies=VOCABULARIES, pattern=known.PATTERN, least=2)
    assert twice.count() == 6 and twice.filter("kept").count() == 6


def test_bands_are_quartiles_of_all_documents(spark, docs_of):
    clean, junk, _ = corpus()
    rows = clean + junk
    measured = fertility.measure(docs_of(rows, langs=["en"] * len(rows)), vocabularies=VOCABULARIES, pattern=known.PATTERN).persist()
    got = {r.band: r for r in fertility.bands(measured, list(VOCABULARIES), reach=3.0, least=1).collect()}
    groups = {}
    for r in measured.collect():
        groups.setdefault(math.floor(math.log2(r.piece_tokens) / 2), []).append(round(r.word_chars / r.piece_tokens / 0.02) * 0.02)
    assert set(got) == {f"{k}{s}" for k in ("lang en", "script Latin") for s in ["", *(f" {g}" for g in groups)]}
    for s, values in [*((f" {g}", v) for g, v in groups.items()), ("", [x for v in groups.values() for x in v])]:
        r = got[f"lang en{s}"]
        assert r.n_docs == len(values)
        if len(values) > 1:
            q = statistics.quantiles(values, n=4, method="inclusive")
            far = 3.0 * max(q[2] - q[0], 0.1)
            assert math.isclose(r.piece_chars_per_token_low, q[1] - far, abs_tol=1e-6) and math.isclose(r.piece_chars_per_token_high, q[1] + far, abs_tol=1e-6)
    assert fertility.bands(measured.filter(F.lit(False)), list(VOCABULARIES)).count() == 0
    measured.unpersist()


def test_the_query_keeps_clean_text(spark):
    from tagloom.llm.queries import op11_fertility

    sf = "/root/testdata/sf0.01"
    got = op11_fertility(spark, sf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    texts_of = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(texts_of)
    kept = []
    for r in got:
        want = brute(texts_of[r.doc_id])
        assert tuple(r)[1:6] == want and r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if not r.base_failed:
            kept.append((sum(c in "#*$%&" for c in texts_of[r.doc_id]) > 0.1 * want[1], r.kept))
    junk, clean = [k for j, k in kept if j], [k for j, k in kept if not j]
    assert sum(clean) >= 0.995 * len(clean) and sum(junk) <= 0.2 * len(junk)
