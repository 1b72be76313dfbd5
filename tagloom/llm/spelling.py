"""Spelling variants: words of a corpus that differ by one code point, each pointing to a much more frequent neighbour.

``vocabulary`` counts words over whole texts, each task adding up within chunks first. ``neighbours`` finds all pairs that
differ by exactly one inserted, deleted or replaced code point. One error leaves the first half of a word as it is, or its
second half, so words meet by halves: a word of n code points is dealt to the halves that words of n - 1, n and n + 1 would
share with it. Where words met, a minimal acyclic automaton of them is built, forwards for first halves and over reversed
words for second ones, with the number of words before each edge, so that a path adds up to the number of its word. A query
walks its exact part and completes the rest with one error. The error's place is unique, as it is where the words first
differ, so that neither automaton finds a pair twice, and what the forward one finds the backward one leaves out.

A half that over ``most`` rows share is halved anew: its words meet by that half and one half of the rest, exact at its
start or at its end, until no group is larger or a single code point is left, which bounds a group by the alphabet's square.
So no task holds more than a batch of rows and a group, whatever the words; rows come by length, and a batch ends where they
would become twice as long.

``forms`` gives each word its form, the neighbour of largest count if that is ``times`` the word's own or more, and the root
that following forms leads to, by pointer doubling over written tables: counts grow by that factor, so rounds are few.

Defined results: a null text has no words and a null id counts as the empty text; ties of count go to the first word in
code-point order; repeated rows count each; an empty table, or one without words, gives none; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Of so many runs one loses a code point.
ONE_IN = 199
#: Rows that one exact part may bring together, and matrix cells (words x code points) that an automaton is built from.
MOST, CELLS = 20_000, 1 << 21
#: Edges are looked up by state and code point: those of words are below 256.
WIDE = 256

U32 = np.uint32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


# ---------------------------------------------------------------- words and counts


def runs_only(text: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and every byte outside ``[A-Za-z\\u00C0-\\u00FF]`` a space.

    In UTF-8 the letters from U+00C0 to U+00FF are just the pairs of a byte C3 and a continuation byte.
    """
    text = pc.fill_null(text, "").cast(pa.large_string())
    lens = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(text.cast(pa.large_binary()).to_pylist()), np.uint8)
    lead, tail = raw == 0xC3, (raw & 0xC0) == 0x80
    keep = _LETTER[raw]
    keep[:-1] |= lead[:-1] & tail[1:]
    keep[1:] |= tail[1:] & lead[:-1]
    off = np.concatenate([[0], np.cumsum(lens)])
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(off), pa.py_buffer(np.where(keep, _LOWER[raw], 32).astype(np.uint8))).cast(pa.string())


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """Tables by which a crc32, byte by byte, becomes that of the same text followed by n further bytes, but for theirs."""
    zeros = bytes(n)
    rest = zlib.crc32(zeros)
    out = np.zeros((4, 256), U32)
    for bit in range(32):
        image, k, step = U32(zlib.crc32(zeros, 1 << bit) ^ rest), bit // 8, 1 << bit % 8
        for start in range(step, 256, 2 * step):
            out[k, start : start + step] ^= image
    return out


def crcs(first: np.ndarray, second: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """crc32 of joined texts by those of their parts; lens: bytes of the second parts."""
    sizes, which = np.unique(lens, return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in sizes]) if len(sizes) else np.zeros((1, 4, 256), U32)
    out = second.astype(U32)
    for k in range(4):
        out = out ^ tables[which, k, (first >> U32(8 * k)) & U32(255)]
    return out


def counted(ids: pa.Array, text: pa.Array, least: int) -> tuple[list[str], list[int]]:
    """The words of a chunk of at least ``least`` code points and their counts, one in ONE_IN runs shortened by the contract's rule."""
    codes, off, dictionary = common.words_as_written(runs_only(text))
    size = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(text)), np.diff(off))
    keep = size[codes] >= least
    codes, doc = codes[keep], doc[keep]
    used, codes = np.unique(codes, return_inverse=True)
    words = dictionary.take(pa.array(used)).to_pylist()
    raw = [w.encode() for w in words]
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], U32)
    h = crcs(before[doc], np.array([zlib.crc32(w) for w in raw], U32)[codes], np.array([len(w) for w in raw], np.int64)[codes])
    hit = np.flatnonzero(h % ONE_IN == 0)
    n = np.bincount(codes, minlength=len(words)) - np.bincount(codes[hit], minlength=len(words))
    shorter: Counter[str] = Counter()
    for code, value in zip(codes[hit].tolist(), h[hit].tolist(), strict=True):
        w = words[code]
        at = value % len(w)
        if len(w) > least:
            shorter[w[:at] + w[at + 1 :]] += 1
    full = np.flatnonzero(n)
    return [words[i] for i in full] + list(shorter), n[full].tolist() + list(shorter.values())


def vocabulary(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of at least that length and count."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            words, n = counted(common.column(b, "doc_id"), common.column(b, "text"), least_length)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- the automaton


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, and the number of words before each edge.

    words: a matrix of code points, zero behind a word's end, its rows in order. States with equal futures are found by
    64-bit hashes of what may follow, made bottom-up, and then compared edge by edge; should two hashes ever clash, states
    stay apart, which costs size alone.
    """

    def __init__(self, words: np.ndarray):
        n, width = words.shape
        lens = (words > 0).sum(1)
        same = np.zeros(n, np.int64)
        if n > 1:
            differ = words[1:] != words[:-1]
            same[1:] = np.where(differ.any(1), differ.argmax(1), width)
        depth_starts, ids, total = [], [], 0
        for d in range(width + 1):
            start = np.flatnonzero((lens >= d) & ((same < d) | (np.arange(n) == 0)))
            depth_starts.append(start)
            ids.append(np.arange(total, total + len(start)))
            total += len(start)
        final, size, future = np.zeros(total, bool), np.zeros(total, np.int64), np.zeros(total, common.U64)
        first, many = np.zeros(total, np.int64), np.zeros(total, np.int64)
        chars, targets, skips, at = [], [], [], 0
        for d in range(width, -1, -1):
            start, own = depth_starts[d], ids[d]
            final[own] = lens[start] == d
            size[own] = final[own]
            future[own] = common.mix(final[own].astype(common.U64) + common.U64(1))
            if d < width and len(depth_starts[d + 1]):
                below, children = depth_starts[d + 1], ids[d + 1]
                parent = np.searchsorted(start, below, side="right") - 1
                begins, counts = common.runs(parent)
                first[own[parent[begins]]], many[own[parent[begins]]] = at + begins, counts
                letter = words[below, d].astype(np.int64)
                before = np.cumsum(size[children]) - size[children]
                skips.append(before - np.repeat(before[begins], counts) + final[own[parent]])
                size[own] += np.bincount(parent, size[children], minlength=len(own)).astype(np.int64)
                with np.errstate(over="ignore"):
                    edge = common.mix(future[children] * common.U64(WIDE) + letter.astype(common.U64))
                    future[own[parent[begins]]] += np.add.reduceat(edge, begins)
                chars.append(letter)
                targets.append(children)
                at += len(children)
        char, target, skip = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (chars, targets, skips))
        _, kept, state = np.unique(future, return_index=True, return_inverse=True)
        if not self._alike(kept[state], state, final, first, many, char, target):
            kept, state = np.arange(total), np.arange(total)
        out = many[kept]
        edges = np.repeat(first[kept] - (np.cumsum(out) - out), out) + np.arange(int(out.sum()))
        self.root = int(state[0]) if total else 0
        self.final, self.first, self.many = final[kept], np.cumsum(out) - out, out
        self.char, self.target, self.skip = char[edges], state[target[edges]], skip[edges]
        self.keys = np.repeat(np.arange(len(kept)), out) * WIDE + self.char

    @staticmethod
    def _alike(kept: np.ndarray, state: np.ndarray, final: np.ndarray, first: np.ndarray, many: np.ndarray, char: np.ndarray, target: np.ndarray) -> bool:
        if (final != final[kept]).any() or (many != many[kept]).any():
            return False
        node = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
        mine, theirs = first[node] + place, first[kept[node]] + place
        return bool((char[mine] == char[theirs]).all() and (state[target[mine]] == state[target[theirs]]).all())

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edge, whether there is one) of each state for a code point."""
        if not len(self.keys):
            return np.zeros(len(state), np.int64), np.zeros(len(state), bool)
        key = state * WIDE + char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def with_one_error(self, words: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, number of the word) of each word that differs from a query by one code point, first differing
        at ``exact`` or later. Queries are words of the automaton themselves."""
        n, width = words.shape
        lens = (words > 0).sum(1)
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(width + 1):
            active = np.flatnonzero((exact <= i) & (i <= lens))
            if len(active):
                own = words[active, i].astype(np.int64) if i < width else np.zeros(len(active), np.int64)
                next_ = words[active, i + 1].astype(np.int64) if i + 1 < width else np.zeros(len(active), np.int64)
                gone = active[(own > 0) & (own != next_)]
                out = self.many[state[active]]
                query = np.repeat(active, out)
                edge = np.repeat(self.first[state[active]] - (np.cumsum(out) - out), out) + np.arange(int(out.sum()))
                other = self.char[edge] != np.repeat(own, out)
                query, edge = query[other], edge[other]
                past = number[query] + self.skip[edge]
                replaced = i < lens[query]
                # Without its code point, with another in its place, with another before it.
                found.append(self._complete(words, lens, gone, np.full(len(gone), i + 1), state[gone], number[gone]))
                found.append(self._complete(words, lens, query[replaced], np.full(int(replaced.sum()), i + 1), self.target[edge[replaced]], past[replaced]))
                found.append(self._complete(words, lens, query, np.full(len(query), i), self.target[edge], past))
            if i < width:
                going = np.flatnonzero(lens > i)
                edge, _ = self.step(state[going], words[going, i].astype(np.int64))
                state[going], number[going] = self.target[edge], number[going] + self.skip[edge]
        return np.concatenate([q for q, _ in found]), np.concatenate([v for _, v in found])

    def _complete(self, words: np.ndarray, lens: np.ndarray, query: np.ndarray, at: np.ndarray, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks the rest of each query exactly."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            ended = at == lens[query]
            good = ended & self.final[state]
            done.append((query[good], number[good]))
            query, at, state, number = query[~ended], at[~ended], state[~ended], number[~ended]
            edge, there = self.step(state, words[query, at].astype(np.int64))
            query, at, edge, number = query[there], at[there] + 1, edge[there], number[there]
            state, number = self.target[edge] if len(edge) else edge, number + self.skip[edge] if len(edge) else number
        return (np.concatenate([q for q, _ in done]), np.concatenate([v for _, v in done])) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def matrix(words: list[str]) -> np.ndarray:
    """Code points of words, zero behind their ends."""
    text = np.array(words)
    return text.view(U32).reshape(len(words), -1) if len(words) and text.dtype.itemsize else np.zeros((len(words), 1), U32)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code points that the rows of two matrices share at their start."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def pairs_of(words: list[str], query: np.ndarray, exact: tuple[np.ndarray, np.ndarray], below: np.ndarray, backward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the query's word, place of its neighbour) among the given distinct words.

    For each query: the place of its word, code points that must agree at the start and at the end, the common start that a
    pair must stay below, and the direction in which it is looked for.
    """
    n = len(words)
    ahead = matrix(words)
    back = matrix([w[::-1] for w in words])
    found = []
    for side, points in ((False, ahead), (True, back)):
        mine = np.flatnonzero(backward == side)
        if not len(mine):
            continue
        order = np.lexsort(points.T[::-1]) if n else np.zeros(0, np.int64)
        q, number = Automaton(points[order]).with_one_error(points[query[mine]], exact[int(side)][mine])
        q, v = mine[q], order[number]
        a, b = query[q], v
        start = _common(ahead[a], ahead[b])
        good = (start >= exact[0][q]) & (start < below[q]) & (_common(back[a], back[b]) >= exact[1][q])
        found.append((a[good], b[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


# ---------------------------------------------------------------- neighbours on Spark


def _key() -> Column:
    """Of the rows that an exact part brings together."""
    start = F.expr("substring(word, 1, a)")
    end = F.expr("if(b = 0, '', substring(word, greatest(length(word) - b, 0) + 1, b))")
    return F.xxhash64("length", "a", "b", "below", "backward", start, end)


def _halved(rows: DataFrame, length: str, a: str, b: str, below: str) -> DataFrame:
    """Each row twice: what lies between its exact parts exact in its first half, and in its second one."""
    middle = f"({length} - {a} - {b})"
    half = f"({middle} div 2)"
    first = f"named_struct('length', int({length}), 'a', int({a} + {half}), 'b', int({b}), 'below', int({below}), 'backward', false)"
    second = f"named_struct('length', int({length}), 'a', int({a}), 'b', int({b} + {middle} - {half}), 'below', int(least({below}, {a} + {half})), 'backward', true)"
    return rows.select("word", "n", F.expr(f"inline(array({first}, {second}))")).withColumn("key", _key())


def meetings(words: DataFrame, *, least_length: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """(word, n, length, a, b, below, backward, key): the exact parts at which words meet, ``a`` code points at the start and
    ``b`` at the end, for queries of ``length``. A pair counts where its common start is below ``below``."""
    lengths = words.withColumn("length", F.explode(F.sequence(F.length("word") - 1, F.length("word") + 1))).filter(F.col("length") >= least_length)
    rows, done = _halved(lengths, "length", "0", "0", "length + 2"), []
    while True:
        crowded = common.written(rows.filter("length - a - b > 1").groupBy("key").count().filter(F.col("count") > most).select("key"), "crowded")
        if crowded.isEmpty():
            common.discard(crowded)
            done.append(rows)
            break
        rows = common.written(rows, "meetings")
        # A key may be shared by rows of which some can't be halved further: those stay.
        split = F.expr("length - a - b > 1")
        done.append(rows.filter(split).join(crowded, "key", "left_anti").unionByName(rows.filter(~split)))
        rows = _halved(rows.filter(split).join(crowded, "key", "left_semi"), "length", "a", "b", "below")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def neighbours(words: DataFrame, *, least_length: int = LEAST_LENGTH, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """(word, near, near_n): every pair of words that differ by one code point, both ways; words must be distinct."""
    spark = words.sparkSession
    common.ship(spark)
    rows = meetings(words, least_length=least_length, most=most).repartition(common.shuffle_partitions(spark), "key").sortWithinPartitions("length", "key")

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        enc = t["word"].combine_chunks().dictionary_encode()
        code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = enc.dictionary.to_pylist()
        n = np.zeros(len(texts), np.int64)
        n[code] = t["n"].to_numpy()
        length, a, b, below = (t[c].to_numpy().astype(np.int64) for c in ("length", "a", "b", "below"))
        backward = t["backward"].to_numpy(zero_copy_only=False)
        asks = np.flatnonzero(np.array([len(w) for w in texts], np.int64)[code] == length)
        q, v = pairs_of(texts, code[asks], (a[asks], b[asks]), below[asks], backward[asks])
        return pa.RecordBatch.from_arrays([enc.dictionary.take(pa.array(q)), enc.dictionary.take(pa.array(v)), pa.array(n[v])], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last, least = 0, None, 0
        for b in batches:
            key = common.column(b, "key").to_numpy(zero_copy_only=False)
            weight = common.column(b, "length").to_numpy(zero_copy_only=False).astype(np.int64) + 1
            begins, lens = common.runs(key)
            kept = 0
            for at, many in zip(begins.tolist(), lens.tolist(), strict=True):
                # Words of a batch are rows of one matrix, so that one of them must not be much longer than the others.
                if size and key[at] != last and (size >= cells or weight[at] > 2 * least):
                    held.append(b.slice(kept, at - kept))
                    yield found(held)
                    held, size, kept = [], 0, at
                least = least if size else int(weight[at])
                size, last = size + int(weight[at : at + many].sum()), key[at]
            held.append(b.slice(kept))
        if held:
            yield found(held)
        common.trim()

    return rows.mapInArrow(run, "word string, near string, near_n bigint")


def roots(links: DataFrame) -> DataFrame:
    """word and root of (word, form): where following forms ends, a form that isn't a word itself. Forms must not go in circles."""
    now = common.written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        then = common.written(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        common.discard(now)
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def forms(words: DataFrame, near: DataFrame, *, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "best")
    fit = -F.col("best.m") >= times * F.col("n")
    rows = common.written(rows.select("word", "n", "n_near", F.when(fit, F.col("best.w")).alias("form"), F.when(fit, -F.col("best.m")).alias("form_n")), "forms")
    rooted = rows.join(roots(rows.filter("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, most: int = MOST) -> DataFrame:
    """Words of whole texts, each with its form and root."""
    words = common.written(vocabulary(docs, least_length=least_length, least_count=least_count), "words")
    return forms(words, neighbours(words, least_length=least_length, most=most), times=times)
