"""Spelling variants: counts, the automaton, neighbours and roots against brute force, odd inputs included."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import spelling

ODD = [
    None, "", " ", "1234 --", "short words only", "abcdef", "ABCDEF Abcdef abcdeF", "abcdef-abcdef_abcdef.abcdéf", "Straße STRASSE Ålander ÅLANDER ÿÿÿÿÿÿ", "×÷×÷×÷ plus", "Ωmegabyte ĀBCDEFG", "x" * 40000, "日本語abcdefg日本語", "a\x00bcdefgh", "naïveté naïveté naivete",
    "Ãcdefgh\xa0abcdef\xadabcdef", "abcdef " * 500, "🙂abcdef🙂",
]


def brute_words(texts, ids):
    n = Counter()
    for i, t in zip(ids, texts, strict=True):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return n


def apart(a, b):
    """Whether two words differ by exactly one code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(n):
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def mutated(rng, w, letters):
    i = rng.randrange(len(w) + 1)
    kind = rng.randrange(3)
    return w[:i] + rng.choice(letters) + w[i + (kind == 0) :] if kind < 2 else w[:i] + w[i + 1 :]


def corpus(seed, bases=12, each=30, letters="abcé"):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        words = [base] * 300
        for _ in range(each):
            v = mutated(rng, base, letters)
            words += [v] * rng.choice([3, 5, 6, 40])
            words += [mutated(rng, v, letters)] * rng.choice([4, 5, 9])
        rng.shuffle(words)
        texts += [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    return texts


@pytest.mark.parametrize("most", [spelling.MOST, 3])
def test_variants_against_brute_force(spark, docs_of, most):
    texts = ODD + corpus(1) + ["variant variants"] * 5
    ids = [None if i % 37 == 5 else i % 90 for i in range(len(texts))]
    n = brute_words(texts, ids)
    got = spelling.variants(docs_of(texts, ids=ids), most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_forms({w: k for w, k in n.items() if k >= 5})
    assert sorted(map(tuple, got.collect())) == want
    assert any(root not in (word, form) for word, form, root, *_ in want) and len(want) > 200


def test_nothing_to_group(spark, docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([None, "", "too short"])).count() == 0
    lone = spelling.variants(docs_of(["lonely " * 5])).collect()
    assert [tuple(r) for r in lone] == [("lonely", None, "lonely", 5, 0, None)]


def test_ties_go_to_the_first_word(spark, docs_of):
    texts = ["wordaa " * 5 + "wordab " * 50 + "wordac " * 50 + "wordad " * 24]
    n = brute_words(texts, [0])
    assert {r.word: r.form for r in spelling.variants(docs_of(texts)).collect()} == {w: f for w, f, *_ in brute_forms(n)}


def test_counts_of_a_chunk():
    texts = ODD + corpus(2, bases=3)
    ids = [None if i % 11 == 0 else i for i in range(len(texts))]
    got = Counter()
    for w, k in zip(*spelling.counted(pa.array([None if i is None else str(i) for i in ids]), pa.array(texts), 6), strict=True):
        got[w] += k
    assert got == brute_words(texts, ids)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=600))
def test_joined_checksums(a, b):
    got = spelling.crcs(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abÿ", min_size=5, max_size=9), min_size=1, max_size=60))
def test_the_automaton_is_minimal_and_numbers_its_words(words):
    words = sorted(words)
    points = spelling.matrix(words)
    m = spelling.Automaton(points)
    futures = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(m.final) == len(futures)
    for i, w in enumerate(words):
        state, number = m.root, 0
        for c in w:
            edge, there = m.step(np.array([state]), np.array([ord(c)]))
            assert there[0]
            state, number = m.target[edge[0]], number + m.skip[edge[0]]
        assert m.final[state] and number == i
    q, v = m.with_one_error(points, np.zeros(len(words), np.int64))
    assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == [(i, k) for i, a in enumerate(words) for k, b in enumerate(words) if apart(a, b)]


def test_a_hot_half_is_dealt_anew(spark):
    rng = random.Random(4)
    words = sorted({"shared" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(1500)})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n bigint")
    sizes = [r["count"] for r in spelling.meetings(df, most=100).filter("length - a - b > 1").groupBy("key").count().collect()]
    assert max(sizes) <= 100
    for cells in (spelling.CELLS, 50):
        got = sorted((r.word, r.near, r.near_n) for r in spelling.neighbours(df, most=100, cells=cells).collect())
        assert got == sorted((a, b, words.index(b) + 1) for a in words for b in words if a != b and apart(a, b))


def test_very_long_words_beside_short_ones(spark):
    """A word of 20,000 code points doesn't widen the rows of short ones."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(20_000)})
    long = "z" * 20_000
    words += [long, long + "z", long[:-1] + "q", "q" + long[1:], long[:9000] + "q" + long[9001:]]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint").repartition(2)
    got = [(r.word, r.near) for r in spelling.neighbours(df).filter("length(word) > 100").collect()]
    assert sorted(got) == sorted((a, b) for a in words[-5:] for b in words[-5:] if a != b and apart(a, b)) and len(got) == 8


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w7"), ("y", "z")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {**{f"w{i}": "w40" for i in range(40)}, "x": "w40", "y": "z"}
