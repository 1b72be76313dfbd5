"""The pipeline operators against brute force, exact round trips and held-out accuracy, odd inputs included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import bpe, common, decontaminate, hpylm, knn, langid, ngramjoin, shard, tokenfiles, toxicity, warc

ODD = [None, "", " ", "\t\n\x0b\x0c\r", "a", "A b", "!!!", "é à ñ", "x" * 30000, "word " * 3000, "same text here now", "same text here now", "日本語 テスト", "a b  c", "\x00 nul", "don't 'S 're"]


# ---------------------------------------------------------------- 1


def brute_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    wins = [(i, tuple(w[k : k + window])) for i, t in items if (w := word.findall(low(t))) for k in range(max(1, len(w) - window + 1))]
    out = []
    for t in texts:
        w = word.findall(low(t))
        hit, found = [False] * len(w), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit[k : k + len(win)] = [True] * len(win)
                    if i is not None:
                        found.add(str(i))
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [64 << 20, 700])
def test_decontaminate(spark, docs_of, block):
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma3", "délta", "x"]
    texts = [*ODD, *(" ".join(rng.choice(words) + rng.choice(["", ",", ". "]) for _ in range(rng.randrange(40))) for _ in range(40))]
    items = [(1, "x beta x"), (2, None), (3, ""), (None, "gamma3 ALPHA"), (4, "x, BETA: x"), (10, " ".join(["alpha beta"] * 6)), (5, "..."), (6, "a"), (7, texts[20])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(texts), bench, window=4, block_bytes=block, carry=("text", "score")).collect()}
    for i, (n, k, found) in enumerate(brute_hits(texts, items, 4)):
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, k, found, k > 0), texts[i]
        assert r.kept_text == texts[i] and sum(len(decontaminate.words_of(texts[i][s.start : s.stop])) for s in r.spans) == k
    assert decontaminate.decontaminate(docs_of([]), bench).count() == 0
    assert decontaminate.decontaminate(docs_of(["a b"]), bench.limit(0)).first().n_hit == 0


# ---------------------------------------------------------------- 2


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    bad, clean = ["idiot", "moron", "scumbag"], ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((" ".join(w), int(i % 4 == 0)))
    return rows


def test_toxicity(spark, docs_of):
    rows = toxic_corpus(400, 1)
    docs = docs_of([t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(9999, 1), (None, 1), (0, None)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.learn(docs, labels, common.crc_mod(4) != 2)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == bool(rows[i][1]) for i in held) / len(held) > 0.97
    misspelt = {r.doc_id: r.score for r in toxicity.score(docs_of(["aa bb cc idiiot dd", "aa bb mooron cc", "aa bb cc dd"]), model).collect()}
    assert misspelt[0] > 0.3 and misspelt[1] > 0.3 and misspelt[2] < 0.3
    odd = toxicity.score(docs_of(ODD), model, carry=("score",)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.kept_score == 1.0 for r in odd)
    assert toxicity.learn(docs, labels.filter("toxic = 1"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs_of(["a"]), None).collect()} == {0.0} and toxicity.score(docs_of([]), model).count() == 0


# ---------------------------------------------------------------- 3


def test_shard(spark, docs_of):
    names = [f"s{i}" for i in range(7)]
    table = shard.fill(names, 101)
    order = [[(shard._digest(n, "offset") + j * (shard._digest(n, "skip") % 100 + 1)) % 101 for j in range(101)] for n in names]
    want, at = {}, [0] * 7
    while len(want) < 101:
        for i in range(7):
            while at[i] < 101 and order[i][at[i]] in want:
                at[i] += 1
            if len(want) < 101:
                want[order[i][at[i]]] = i
    assert table == [want[i] for i in range(101)]
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = shard.fill(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 30
    df = shard.place(docs_of(["a"] * 5, ids=[1, 1, None, 3, 4]), names, slots=101)
    got = df.collect()
    assert len(got) == 5 and all(r.shard == names[table[r.slot]] for r in got)
    assert {r.slot for r in got if r.doc_id == 1} == {int(hashlib.md5(b"1").hexdigest()[:15], 16) % 101}
    assert shard.place(docs_of([]), names, slots=101).count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas|Arrow", plan)
    for bad in (100, 5):
        with pytest.raises(ValueError):
            shard.fill(names, bad)
    clash = spark.createDataFrame([(1, "a", "b", "c")], "doc_id bigint, Slot string, SHARD string, `a.b` string")
    assert shard.place(clash, names, slots=101).columns == ["doc_id", "a.b", "slot", "shard"]


# ---------------------------------------------------------------- 4


def test_hpylm_counts_and_gain(spark, docs_of):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    follow = {w: rng.sample(vocab, 3) for w in vocab}

    def text():
        w = [rng.choice(vocab)]
        for _ in range(rng.randrange(5, 60)):
            w.append(rng.choice(follow[w[-1]]) if w[-1] in follow and rng.random() < 0.9 else rng.choice([*vocab, f"new{rng.randrange(500)}"]))
        return " ".join(w)

    texts = [*ODD, *(text() for _ in range(150))]
    got = {r.doc_id: r for r in hpylm.score(docs_of(texts, parts=3)).collect()}
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    c = Counter(w for i, t in enumerate(texts) if not held[i] for w in low(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w, r = low(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-6)
    test = [i for i in held if held[i] and i >= len(ODD)]
    assert sum(got[i].score for i in test) > sum(got[i].base_score for i in test) + 0.2 * sum(got[i].n_tokens for i in test)
    assert hpylm.score(docs_of([])).count() == 0
    only_held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    r = hpylm.score(docs_of(["a b", "c"], ids=only_held)).collect()
    assert all(x.n_known == 0 and x.train_tokens == 0 and math.isfinite(x.score) for x in r)
    again = hpylm.score(docs_of(["a b", "a b", "c"], ids=[3, 3, None])).collect()
    assert len(again) == 3


def hpylm_pairs(spark, docs, hot, parts=4):
    """(context, token) -> probability of every pair in docs, by the steps that score them; and the model."""
    docs = docs.select("doc_id", "text")
    model = hpylm.fit(docs, parts, hot, hpylm.Settings(), 5, 1)
    rows = docs.collect()
    sent = hpylm.places(0, pa.array([r.text for r in rows], pa.string()), pa.array([r.doc_id for r in rows], pa.int64()), parts, hot, 5, 1)
    back, out = [tuple(r) for r in model.rows.collect()], {}
    for p in range(parts):
        got = {}
        for r in sorted((r for r in [*sent, *back] if r[1] == p), key=lambda r: (r[2], r[3])):
            got.setdefault(r[0], []).append(r)
        if hpylm.OCCUR in got:
            x, prob, *_ = hpylm.scored_pairs(got, model, hpylm.Settings())
            for u, w, v in zip(x.contexts[x.ui].tolist(), x.names[x.wi].tolist(), prob.tolist(), strict=True):
                assert (u, w) not in out
                out[u, w] = v
    return out, model


def test_hpylm_probabilities_sum_to_one(spark, docs_of):
    """On the path of production: over all known tokens, the end and the unknown one, in each context, hot ones included."""
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(12)]
    held = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    texts = [" ".join(rng.choices(vocab, [1 / (k + 1) ** 2 for k in range(12)], k=rng.randrange(200))) for _ in train]
    every = [*vocab, "never"]
    asked = ["", *every, *(f"{a} {b}" for a in every for b in every)]
    docs = docs_of(texts + asked, ids=train + held[: len(asked)])
    end, want = int(hpylm.END), None
    hash_of = dict(zip(common.hash_words(pa.array(every)).tolist(), every, strict=True)) | {end: "end"}
    for hot in (np.zeros(0, np.uint64), np.sort(np.array([end, *list(hash_of)[:3]], np.uint64))):
        got, model = hpylm_pairs(spark, docs, hot)
        assert model.tokens == sum(len(t.split()) + 1 for t in texts) and model.types == 13
        sums = Counter()
        for (u, _), p in got.items():
            sums[hash_of[u]] += p
        assert set(sums) == {*every, "end"} and all(v == pytest.approx(1, abs=1e-9) for v in sums.values())
        assert want is None or {k: pytest.approx(v, rel=1e-9) for k, v in got.items()} == want  # dealing changes nothing
        want = got


def test_hpylm_scores_do_not_depend_on_partitions(spark, docs_of):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.randrange(150))) for _ in range(120)]
    was, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scores.append({r.doc_id: r.score for r in hpylm.score(docs_of(texts, parts=n // 2)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert scores[0] == {k: pytest.approx(v, rel=1e-12) for k, v in scores[1].items()}


def test_hpylm_contexts_have_restaurants_of_their_own():
    """More contexts than any table of a fixed size that small corpora would fill: each stays apart, in the rows' packing too."""
    n = 300_000
    names, w, u, _ = hpylm.occurrences(pa.array([" ".join(f"w{i}" for i in range(n))]))
    assert len(np.unique(u)) == len(names) == n + 1
    wide = len(names).bit_length()
    key = np.sort((u << wide) | w)
    back = hpylm._unpack_pairs(hpylm.packer(names, 0)(key, np.arange(len(w), dtype=np.uint32)), "<u4")
    assert (back[0] == names[key >> wide]).all() and (back[1] == names[key & ((1 << wide) - 1)]).all() and (back[2] == np.arange(len(w))).all()
    for hot in (np.zeros(0, np.uint64), names[::1000]):
        dealt = np.concatenate([at for _, at in hpylm.deal(names, key, 0, 7, hot)])
        assert (np.sort(dealt) == np.arange(len(key))).all()


def exact_table_weights(c, x, d):
    """Weights of 1 .. c tables, by the recurrence that seats one customer after another."""
    row = np.full(c + 2, -np.inf)
    row[1] = 0
    for k in range(1, c):
        t = np.arange(1, k + 1)
        new = np.full(c + 2, -np.inf)
        new[1 : k + 1] = np.logaddexp(row[:k], row[1 : k + 1] + np.log(k - d * t))
        new[k + 1] = 0
        row = new
    w = row[1 : c + 1] + np.arange(1, c + 1) * np.log(x)
    w = np.exp(w - w.max())
    return w / w.sum()


@pytest.mark.parametrize("d", [0.75, 0.5])
@pytest.mark.parametrize(("c", "x"), [(2, 0.5), (40, 3.0), (128, 50.0), (129, 1e-4), (300, 0.01), (300, 40.0), (1000, 1500.0), (2000, 3.0), (2000, 60.0), (2000, 1e6)])
def test_hpylm_tables_follow_their_conditional(c, x, d):
    """Every sweep draws from the exact conditional, whatever the number of customers."""
    n, want = 4000, exact_table_weights(c, x, d)
    t = hpylm.draw(np.full(n, c), np.full(n, x), common.mix(np.arange(n, dtype=np.uint64)), d, 1, 2)
    got = np.bincount(t - 1, minlength=c)[:c] / n
    at = np.arange(1, c + 1)
    mean = (at * want).sum()
    sd = math.sqrt(((at - mean) ** 2 * want).sum())
    assert abs(t.mean() - mean) < 0.08 * sd + 1e-3 and np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.05


def test_hpylm_auxiliary_variables_are_gamma():
    key = common.mix(np.arange(20_000, dtype=np.uint64))
    for a in (1.4, 7.0, 3000.0):
        g = hpylm.gammas(np.full(len(key), a), key, 3)
        assert g.mean() == pytest.approx(a, rel=0.03) and g.var() == pytest.approx(a, rel=0.06)


# ---------------------------------------------------------------- 5

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TRICKY = ["a <|endoftext|> b", "<|ENDOFTEXT|>é́<|EndOfText|> x", "x<|startoftext|>'s", "don't .'s it's'' 'twas été é áb <|endoftext|> x", "日本語 テスト。foo", "A.B.C... 3.14 x1y2 $5 it's!' '!s", "'s's 're", "ﬁ ﬁne İstanbul İ.x ß.y ΣΑΣ", "a\tb\nc\rd\x0be\x0cf", "“q”.x …a' .…"]


def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aZé'.,!-0 9\t日ñİ́sS")), max_size=30), max_size=5))
def test_word_pieces_encode_like_the_library(texts):
    ids, off = tokenfiles.encode_texts(pa.array(texts, pa.string()), WORD_BPE, 2)
    t = word_tokenizer()
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_token_files(spark, docs_of):
    texts = [*ODD, *TRICKY]
    ids = [5, None, 3, 3, *range(100, 100 + len(texts) - 4)]
    got = sorted(tokenfiles.round_trip(docs_of(texts, ids=ids), path=WORD_BPE, end_id=2).collect(), key=lambda r: r.start)
    t = word_tokenizer()
    want = {}
    for i, text in zip(ids, texts, strict=True):
        x = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    for r in got:
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    assert tokenfiles.round_trip(docs_of([]), path=WORD_BPE, end_id=2).count() == 0
    assert tokenfiles.id_kind(WORD_BPE, 2) == "<u2" and tokenfiles.id_kind(WORD_BPE, 1 << 16) == "<u4"
    wide = tokenfiles.round_trip(docs_of(["a"]), path=WORD_BPE, end_id=70_000).first()
    assert (wide.n_tokens, wide.ids_crc32) == (2, zlib.crc32(np.array([320, 70_000], "<u4").tobytes()))


def test_token_files_equal_the_library_on_the_whole_table(spark, sf):
    from tagloom.llm import queries

    t, start = word_tokenizer(), 0
    got = {r.doc_id: r for r in queries.op5_token_files(spark, sf).collect()}
    rows = sorted(common.table(spark, sf, "documents").select("doc_id", "text").collect())
    assert len(got) == len(rows)
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_in_another_store():
    """A store that is no folder: the same files through Arrow's file systems."""
    s = tokenfiles.Store("mock:///")
    with s.create(".t") as f:
        f.write(np.arange(9, dtype="<u2").tobytes())
    s.rename(".t", "a.bin")
    assert s.folder is None and s.items("a.bin", "<u2", 2, 5).tolist() == [2, 3, 4] and s.text("a.bin")[0] == "\0"


# ---------------------------------------------------------------- 6

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'srelv\n\t 9é日!.  \x1c")), max_size=120), st.integers(1, 9))
def test_tree_encoding_equals_the_library(text, leaf):
    c = bpe.coder(RANKS, public_tokenizers.PATTERN)
    was, c.leaf = c.leaf, leaf
    try:
        ids = c.encode(text)
        assert ids == c.encoding.encode_ordinary(text)
        assert c.decode(ids) == text.encode()
    finally:
        c.leaf = was


def test_byte_bpe(spark, docs_of):
    texts = [*ODD, "long " * 40000, "a" * 70000]
    got = {r.doc_id: r for r in bpe.encode(docs_of(texts), path=RANKS, pattern=public_tokenizers.PATTERN, digest=True, carry=("score",)).collect()}
    enc = bpe.coder(RANKS, public_tokenizers.PATTERN).encoding
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs_of(texts), path=RANKS, pattern=public_tokenizers.PATTERN), path=RANKS, pattern=public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.encode(docs_of([]), path=RANKS, pattern=public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.Coder(RANKS, r"\w+|\W+")
    clash = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id bigint, text string, N_Tokens bigint, Text2 string")
    assert bpe.encode(clash, path=RANKS, pattern=public_tokenizers.PATTERN, digest=True, carry=("N_Tokens", "Text2")).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "Text2"]


def test_byte_bpe_equals_the_library_on_the_whole_table(spark, sf):
    """Every document of the table, most of them over seams of the tree."""
    from tagloom.llm import queries

    enc, tree, texts = bpe.coder(RANKS, public_tokenizers.PATTERN).encoding, bpe.Coder(RANKS, public_tokenizers.PATTERN), {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    for r in queries.op6_byte_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    joined = 0
    for t in texts.values():
        tree.joins = 0
        tree.encode(t)
        joined += tree.joins > 0
    assert joined > 0.5 * len(texts)


# ---------------------------------------------------------------- 7


def test_language(spark, docs_of):
    rng = random.Random(9)
    parts = {"aa": ["ka", "ro", "ti", "mu"], "bb": ["sch", "ung", "ein", "keit"], "cc": ["ción", "ado", "ñe", "osa"]}
    word = lambda g: "".join(rng.choice(parts[g]) for _ in range(rng.randrange(1, 4)))
    langs = [rng.choice(list(parts)) for _ in range(240)]
    texts = [" ".join(word(g) for _ in range(rng.randrange(3, 40))) for g in langs]
    docs = docs_of(texts, langs=langs)
    model = langid.learn(docs, common.crc_mod(3) != 1, langid.Settings(epochs=4))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.95
    mixed = [word("aa") for _ in range(12)] + [word("bb") for _ in range(12)]
    labelled = langid.label_words(docs_of([" ".join(mixed)]), model).first().words
    assert sum(w.lang == g for w, g in zip(labelled, ["aa"] * 12 + ["bb"] * 12, strict=True)) >= 22
    odd = {r.doc_id: r for r in langid.predict(docs_of(ODD), model, carry=("score",)).collect()}
    assert all((odd[i].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) and 0 <= odd[i].score <= 1 for i, t in enumerate(ODD))
    assert langid.learn(docs_of(["a"]), F.lit(True)) is None and langid.predict(docs_of(["a"]), None).first().lang_pred == "und"
    assert langid.predict(docs_of([]), model).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    emit, trans = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1
    lens = np.array([4, 2, 1])
    post, pairs, logs = langid.forward_backward(emit, trans, lens)
    want_pairs, at = np.zeros((3, 3)), 0
    for k, n in enumerate(lens):
        total, marg = 0.0, np.zeros((n, 3))
        pair = np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            p = np.prod([emit[at + t, y] for t, y in enumerate(path)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += p
            for t, y in enumerate(path):
                marg[t, y] += p
            for a, b in zip(path, path[1:], strict=False):
                pair[a, b] += p
        assert post[at : at + n] == pytest.approx(marg / total) and logs[k] == pytest.approx(np.log(total))
        want_pairs += pair / total
        at += n
    assert pairs == pytest.approx(want_pairs)


# ---------------------------------------------------------------- 8


def brute_components(texts, ids, n=4, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(find(i))) for i in range(len(texts))]


@pytest.mark.parametrize("block,long", [(128, 1024), (6, 1024), (4, 5)])
def test_ngram_join(spark, docs_of, block, long):
    rng = random.Random(block)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    texts = list(ODD)
    for b in base:
        for _ in range(rng.choice([1, 2, 9, 30])):
            w = list(b)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(w))
    ids = [None if i == 20 else 7000 - i for i in range(len(texts))]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in ngramjoin.jaccard_components(docs_of(texts, ids=ids, parts=3), block=block, long=long).collect()), key=key)
    assert got == sorted(brute_components(texts, ids), key=key)
    assert ngramjoin.jaccard_components(docs_of([])).count() == 0


@pytest.mark.parametrize("percent", [85, 60, 40])
def test_ngram_join_of_one_template(spark, docs_of, percent):
    """Texts of one template with a few varying words: rare hashes are shared by many that don't link, whose lists are split."""
    rng = random.Random(percent)
    frame = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(frame)
        for k in range(5, 60, 9):
            w[k] = f"v{rng.randrange(6)}"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    got = sorted(tuple(r) for r in ngramjoin.jaccard_components(docs_of(texts, ids=ids), block=8, long=10, percent=percent).collect())
    want = sorted(brute_components(texts, ids, percent=percent))
    assert got == want and len({c for *_, c in want}) > (1 if percent > 60 else 0)


# ---------------------------------------------------------------- 9


def warc_pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("File", F.lit(9)).withColumn("fk", F.lit("x"))


def warc_found(left, right, **kw):
    return [(r.page_id, r.warc_file, r.place) for r in warc.verdicts(left, right, per_file=64, fanout=4, surplus=True, **kw).filter("damaged").collect()]


def test_warc_audit(spark):
    pages = warc_pages(spark, [(i, f"http://x/{i}", "<p>" * (i % 7)) for i in range(300)] + [(300, None, None), (None, "u", "h"), (None, "v", "h")])
    broken = pages.withColumn("html", F.when(F.col("page_id").isin(3, 77, 299), F.regexp_replace("html", "<p>", "<q>")).otherwise(F.col("html")))
    assert {p for p, *_ in warc_found(pages, broken)} == {3, 299}  # page 77 is empty, so nothing changed
    assert warc_found(pages, pages) == [] and warc.verdicts(pages, pages).count() == 303
    hurt = pages.withColumn("html", F.when(F.col("url") == "v", F.lit("?")).otherwise(F.col("html")))
    assert [(p, f) for p, f, _ in warc_found(pages, hurt)] == [(None, None)] * 2  # the one lost, the other surplus
    assert warc.verdicts(pages.limit(0), pages).count() == 0 and warc.verdicts(pages, pages.limit(0)).filter("not damaged").count() == 0
    one = pages.filter("page_id = 1").select(warc.record(F.col("url"), F.col("html"), F.col("page_id"))).first()[0]
    head, _, body = bytes(one).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 3" in head and body == b"<p>\r\n\r\n"


def test_warc_audit_locates_one_record(spark):
    """Longer, shorter, missing and surplus records: each found alone, what lies behind is moved and nothing else."""
    pages = warc_pages(spark, [(i, f"http://x/{i}", "<p>" * 5) for i in range(100)])
    size = {r.page_id: r.length for r in warc.records(pages, per_file=64).collect()}
    for change, at, gone in (
        (F.concat("html", F.lit("x")), 3, False), (F.lit(""), 3, False), (F.expr("substring(html, 1, 7)"), 63, False), (F.col("html"), 3, True),
    ):
        other = pages.filter(F.col("page_id") != at) if gone else pages.withColumn("html", F.when(F.col("page_id") == at, change).otherwise(F.col("html")))
        got = warc.verdicts(pages, other, per_file=64, fanout=4, surplus=True).collect()
        assert [r.page_id for r in got if r.damaged] == [at]
        assert sorted(r.page_id for r in got if r.moved) == [i for i in range(at + 1, 64)]
        assert all(r.record_length == size[r.page_id] for r in got) and len(got) == 100
    more = pages.unionByName(warc_pages(spark, [(5, "http://y", "<b>"), (130, "http://y", "<b>")]))
    assert sorted(warc_found(pages, more))[1] == (130, 2, 0) and [p for p, *_ in sorted(warc_found(pages, more))] == [5, 130]
    assert len(warc_found(pages.limit(0), pages)) == 100


def test_warc_audit_of_repeated_ids(spark):
    """Equal records and ids of many records, more than a file holds, in files of their own."""
    rows = [(7, "u", f"text {i}") for i in range(300)] + [(None, "u", f"text {i}") for i in range(200)] + [(8, "same", "same")] * 50 + [(i, "u", "x") for i in range(9, 30)]
    pages = warc_pages(spark, rows)
    recs = warc.records(pages, per_file=64).collect()
    assert len(recs) == len(rows) and max(Counter((r.file, r.shelf) for r in recs).values()) <= 50 + 21 + 64
    by = {}
    for r in sorted(recs, key=lambda r: r.place):
        f = by.setdefault((r.file, r.shelf), [0, 0])
        assert (r.place, r.offset) == tuple(f)
        f[0], f[1] = f[0] + 1, f[1] + r.length
    less = warc_pages(spark, [r for r in rows if r[2] != "text 5"])
    assert Counter(p for p, *_ in warc_found(pages, less)) == {7: 1, None: 1}
    fewer = warc_pages(spark, rows[:500] + rows[510:])
    assert Counter(p for p, *_ in warc_found(pages, fewer)) == {8: 10} and Counter(p for p, *_ in warc_found(fewer, pages)) == {8: 10}


# ---------------------------------------------------------------- 10


def brute_top(rows, k=10):
    """Keyed by row, shorter vectors padded by zeros, in whole numbers of any size."""
    whole = lambda v: [int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v]
    ok = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(ok):
        if q is not None and q % 100 == 0:
            top = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0) for n, (i, b) in enumerate(ok) if n != at)[:k]
            out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(top)]
    return sorted(out, key=str)


def knn_rows(df, **kw):
    return sorted((tuple(r) for r in knn.search(df, F.col("vec_id") % 100 == 0, **kw).collect()), key=str)


@pytest.mark.parametrize("pivots,block,rows", [(1, 512, 1 << 16), (16, 3, 100), (None, 4096, 1 << 16)])
def test_knn(spark, pivots, block, rows):
    rng = np.random.default_rng(pivots or 0)
    centre = rng.normal(0, 3, (5, 8))
    data = [(i, (centre[i % 5] + rng.normal(0, 0.2, 8)).tolist()) for i in range(800)]
    data += [(900, None), (1000, []), (1100, [float("nan")] * 8), (1200, [None] * 8), (1250, [float("inf")] + [0.0] * 7), (1300, [1.0]), (None, [1.0] * 8), (1400, [0.0] * 8), (1500, data[3][1]), (1501, data[3][1]), (1500, data[7][1]), (1600, [1e9] * 8), (1601, [1.0] * 11)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1)).withColumn("grp", F.lit("x")).withColumn("rid", F.lit(1)).withColumn("CELL", F.lit(1))
    assert knn_rows(df, pivots=pivots, block=block, rows=rows) == brute_top(data)
    assert knn.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame(data[:3], "vec_id bigint, embedding array<double>")
    assert knn_rows(few) == brute_top(data[:3])


def test_knn_counts_large_components_and_equal_ids(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    rows = [(0, [1.0, 0.0]), (1, [2e12, 0.0]), (2, [5.0, 1.0]), (3, [-1e12, 2.0]), (100, [1.0, 3e4]), (4, [3e4, -1e4])]
    assert knn_rows(of(rows)) == brute_top(rows) and knn_rows(of(rows))[0] == (0, 1, 1, 1024 * 1024 * 2 * 10**12)
    rows = [(0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [2.0, 0.0])]
    assert knn_rows(of(rows)) == brute_top(rows) and len(brute_top(rows)) == 4
    with pytest.raises(Exception, match="64 bits"):
        knn_rows(of([(0, [1e300]), (1, [1e300])]))


def test_knn_rules_out_most_of_clustered_data(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (40, 16))
    data = [(i, (centre[rng.integers(40)] + rng.normal(0, 0.05, 16)).tolist()) for i in range(3000)]
    said = {}
    assert knn_rows(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), report=said, block=1) == brute_top(data)
    assert 0 < said["share"] < 0.25
