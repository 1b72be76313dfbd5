"""Language-model scoring by a hierarchical Pitman-Yor model with Gibbs-sampled Chinese-restaurant seating.

The model. Tokens are lower-cased words and one end a document. A token's context is the token before it (the end, for
the first), as its 64-bit hash: each context has a restaurant of its own, so their number grows with the corpus. Every
context restaurant is a child of one root restaurant, whose base is a fixed share for the unknown token and an even
share for each known one. With c customers and t tables of a dish w, C and T over all dishes, a restaurant predicts

    p(w) = (c - d t) / (theta + C) + (theta + d T) / (theta + C) * p_parent(w),

and each table of a context restaurant is a customer of the root.

The sampler. Occurrences in training documents are customers. Seatings of c customers at t tables are summed over, by
generalized Stirling numbers S, so a sweep seats every customer of every dish anew. With an auxiliary variable
lambda ~ Gamma(theta / d + T) for each restaurant, the rising factorial of its tables falls apart, and the tables of its
dishes are independent given lambda, each with weight S(c, t) (d lambda p_parent(w))^t. So a sweep is exact however the
dishes are dealt to tasks, and its draws, seeded by dish, are the same for any number of partitions. A block of the
sampler draws the root given the contexts' tables (one a dish to start with), the next one sweeps the contexts given the
root, the last one the root again; burn-in sweeps are left out and the predictions of ``samples`` sweeps averaged.
Averages of tables leave the predictions of each context summing to 1 over the known tokens and the unknown one.

The distribution. Pairs are dealt by the hash of their context, so a restaurant is in one task; contexts of more than a
share of 1 / (2 * parts) of the tokens are dealt by pair, and of those, at most a few per part, the totals are gathered
for each sweep and sent out. Root customers of a token are added up by ranges of the tokens' hashes and go back to the
parts that hold the token. The first pass over the texts sends counts of pairs, the second the places of all tokens,
which get their probabilities where the pair's restaurant is and are summed by document.

Defined results: null and empty texts hold the end alone; without training documents every token is unknown and scores
the base; repeated rows count and are kept; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

#: The end of a document, as a hash.
END = U64(0xA0761D6478BD642F)
_ODD = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    strength: float = 1.0
    root_discount: float = 0.7
    root_strength: float = 1.0
    burn_in: int = 1
    samples: int = 3
    seed: int = 5


# ---------------------------------------------------------------- draws


def salted(key: np.ndarray, *salt: int) -> np.ndarray:
    """A hash of each key and the salt."""
    h = key
    for x in salt:
        h = common.mix(h ^ common.mix(np.array([x + 1], U64) * _ODD))
    return h


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number between 0 and 1 for each key."""
    return ((salted(key, *salt) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, key: np.ndarray, *salt: int) -> np.ndarray:
    """Gamma draws of shapes above 1 (Marsaglia and Tsang), by the keys' hashes alone."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, k = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        a, b, u = (uniform(key[left], *salt, k, i) for i in range(3))
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * math.pi * b)
        v = (1 + c[left] * x) ** 3
        fine = v > 0
        take = fine & (np.log(u) < 0.5 * x * x + d[left] * (1 - v + np.log(np.where(fine, v, 1))))
        out[left[take]] = (d[left] * v)[take]
        left, k = left[~take], k + 1
    return out


#: Up to so many customers of a dish, numbers of tables are drawn from all their weights.
SMALL = 128


@cache
def small_seatings(d: float) -> np.ndarray:
    """[c, t]: log of the weight of all seatings of c customers at t tables, a generalized Stirling number, up to SMALL."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, SMALL):
        join = np.log(c - d * np.arange(1, c + 1))
        out[c + 1, 1 : c + 1] = np.logaddexp(out[c, :c], out[c, 1 : c + 1] + join)
        out[c + 1, c + 1] = 0
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    low = 0.0
    if x.size and x.min() < 16:
        low = np.log(np.prod([x + i for i in range(8)], axis=0))
        x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - low


#: Terms of the sum for few tables.
TERMS = 64


def log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The log of the same weight for each row's c, more than SMALL customers, at its numbers t: c!/t! d^-t times the coefficient
    of z^c in (1 - (1 - z)^d)^t, which is the sum over powers of (1 - z)^d for few tables and a saddle point's value for many."""
    c = np.asarray(c, float)[:, None]
    out = np.zeros(t.shape)
    few = t <= 2 ** (4 * (1 - d)) * c**d
    some = np.flatnonzero(few.any(1))
    if len(some):
        j = np.arange(1, TERMS + 1)
        sign = np.array([0.0 if (d * k) % 1 == 0 else (-1) ** k / math.gamma(-d * k) for k in j.tolist()])
        power = log_gamma(c[some] - d * j) - log_gamma(c[some] - d)
        size = np.log(np.maximum(t[some][:, :, None] - j + 1, 1e-300)) - np.log(j)
        size = np.cumsum(size, axis=2, out=size)
        size += power[:, None, :]
        total = np.exp(size, out=size) @ sign
        out[some] = np.log(np.maximum(total, 1e-300)) + log_gamma(c[some] - d) - log_gamma(c[some] + 1)
    many = ~few
    if many.any():
        a, n = np.broadcast_to(c, t.shape)[many], t[many]
        low, high = np.full(len(a), -80.0), np.full(len(a), -1e-12)
        for _ in range(40):
            mid = (low + high) / 2
            over = n * d * -np.expm1(mid) * np.exp((d - 1) * mid) / -np.expm1(d * mid) > a
            low, high = np.where(over, mid, low), np.where(over, high, mid)
        z, y, g = -np.expm1(mid), np.exp(mid), -np.expm1(d * mid)
        mean = d * z * np.exp((d - 1) * mid) / g
        spread = n * mean * (1 + (1 - d) * z / y - mean)
        out[many] = np.where(n >= a, a * math.log(d), n * np.log(g) - a * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-3)))
    return out + log_gamma(c + 1) - log_gamma(t + 1) - t * math.log(d)


#: Numbers of tables that are weighed for a dish of more customers: all that matter, or evenly spaced ones.
GRID = 64


def draw(c: np.ndarray, x: np.ndarray, key: np.ndarray, d: float, *salt: int) -> np.ndarray:
    """Numbers of tables of dishes with c customers, t with weight S(c, t) x^t, by the keys' hashes alone.

    Up to SMALL customers all weights are summed. Beyond, those around the mode are: it lies near (x / d) (1 - y^d) with
    (1 - y) x y^(d - 1) = c, the saddle point of the sum over t.
    """
    out = np.minimum(c, 1).astype(np.int64)
    u = uniform(key, *salt)
    log_s, log_x = small_seatings(d), np.log(x)
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2) :]
    start, length = common.runs(c[order])
    for a, m in zip(start.tolist(), length.tolist(), strict=True):
        k = int(c[order[a]])
        if k > SMALL:
            break
        step = max(1, (1 << 19) // k)
        for i in range(a, a + m, step):
            at = order[i : min(i + step, a + m)]
            w = log_s[k, 1 : k + 1] + log_x[at][:, None] * np.arange(1, k + 1)
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            out[at] = 1 + (w < (u[at] * w[:, -1])[:, None]).sum(1)
    large = np.flatnonzero(c > SMALL)
    for i in range(0, len(large), 512):
        at = large[i : i + 512]
        n, lx = c[at].astype(float), log_x[at]
        low, high = np.full(len(at), -300.0), np.full(len(at), -1e-12)
        for _ in range(60):
            mid = (low + high) / 2
            over = np.log(-np.expm1(mid)) + lx + (d - 1) * mid > np.log(n)
            low, high = np.where(over, mid, low), np.where(over, high, mid)
        y = np.exp(mid)
        centre = np.clip(x[at] / d * -np.expm1(d * mid), 1, n)
        spread = np.sqrt(np.clip(centre - n / (1 + (1 - d) * (1 - y) / np.maximum(y, 1e-300)), 1, None))
        first = np.maximum(1, np.floor(centre - 7 * spread - 2))
        step = np.maximum(1, np.ceil((np.minimum(n, centre + 7 * spread + 12) - first + 1) / GRID))
        t = first[:, None] + step[:, None] * np.arange(GRID) + (step[:, None] - 1) / 2
        inside = t <= n[:, None]
        t = np.where(inside, t, n[:, None])
        w = log_seatings(n, t, d) + t * lx[:, None]
        w = np.where(inside, w, -np.inf)
        w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
        v = u[at] * w[:, -1]
        j = (w < v[:, None]).sum(1)
        rows = np.arange(len(at))
        before = np.where(j > 0, w[rows, j - 1], 0)
        part = (v - before) / np.maximum(w[rows, j] - before, 1e-300)
        out[at] = np.clip(first + step * j + np.floor(part * step), 1, n).astype(np.int64)
    return out


# ---------------------------------------------------------------- state


@dataclass
class Root:
    """The root restaurant over its samples: even and unknown shares of the base, customers C, tables T of all samples,
    and the auxiliary variable of each."""

    even: float
    unknown: float
    customers: int
    tables: int = 0
    lambdas: list[float] = field(default_factory=list)

    def share(self, k: np.ndarray, st: np.ndarray, s: Settings) -> np.ndarray:
        """Predictions of tokens with k customers and st tables in all samples; for k = 0 the unknown token's."""
        escape = (s.root_strength + s.root_discount * self.tables / s.samples) / (s.root_strength + self.customers)
        seen = (k - s.root_discount * st / s.samples) / (s.root_strength + self.customers) + escape * self.even
        return np.where(k > 0, seen, escape * self.unknown)


@dataclass
class Hot:
    """Contexts whose pairs are dealt apart, in the order of their hashes: customers, dishes of one customer, tables of all
    samples, and the auxiliary variables of each sweep."""

    names: np.ndarray
    customers: np.ndarray
    single: np.ndarray
    tables: np.ndarray
    lambdas: list[np.ndarray] = field(default_factory=list)

    def place(self, u: np.ndarray) -> np.ndarray:
        """Places of contexts among these, -1 for others."""
        if not len(self.names):
            return np.full(len(u), -1)
        at = np.minimum(np.searchsorted(self.names, u), len(self.names) - 1)
        return np.where(self.names[at] == u, at, -1)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, the place of one of each, each key's place among them)."""
    by = np.argsort(key)
    x = key[by]
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    back = np.empty(len(key), np.int64)
    back[by] = np.cumsum(new) - 1
    return x[new], by[new], back


def dish(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of each pair of context and token."""
    with np.errstate(over="ignore"):
        return common.mix(common.mix(u) + w * _ODD)


@dataclass
class Dishes:
    """Of one part, in the order of their hashes: pairs with training counts; the tokens' names and the contexts' in order,
    to whose places ``wi`` and ``ui`` point."""

    key: np.ndarray
    n: np.ndarray
    names: np.ndarray
    wi: np.ndarray
    contexts: np.ndarray
    ui: np.ndarray


def dishes(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[Dishes, np.ndarray]:
    """The pairs of rows (u, w) with n training customers each, and each row's pair."""
    key, first, row = grouped(dish(u, w))
    names, _, wi = grouped(w[first])
    contexts, _, ui = grouped(u[first])
    return Dishes(key, np.bincount(row, n, len(key)).astype(np.int64), names, wi.astype(np.int32), contexts, ui.astype(np.int32)), row


#: What a context leaves to the root is added up in whole numbers of this, so that sums don't depend on their order.
UNIT = 1 << 16


def left_over(c: np.ndarray, t: np.ndarray, s: Settings) -> int:
    """Customers of contexts times the share that each context leaves to the root, in 1 / UNIT."""
    return int(np.rint((s.strength + s.discount * t) / (s.strength + c) * c * UNIT).sum())


def sweeps(n: np.ndarray, ui: np.ndarray, single: np.ndarray, contexts: np.ndarray, base: np.ndarray, key: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(tables of all samples, of the last sweep) of dishes of several customers; single: of each context, its other dishes."""
    total = single + np.bincount(ui, minlength=len(contexts))
    out = np.zeros(len(n), np.int64)
    t = np.ones(len(n), np.int64)
    for j in range(s.burn_in + s.samples):
        lam = gammas(s.strength / s.discount + total, contexts, s.seed, j)
        t = draw(n, s.discount * lam[ui] * base, key, s.discount, s.seed, j)
        total = single + np.bincount(ui, t, len(contexts))
        if j >= s.burn_in:
            out += t
    return out, t


# ---------------------------------------------------------------- rows


def held(ids: pa.Array, mod: int, rest: int) -> np.ndarray:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; a null id counts as the empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % mod == rest for i in ids.to_pylist()), bool, len(ids))


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens in order; of every token, ends included, text by text: its place among them, its context's, its text)."""
    codes, off, words = common.tokens(texts)
    names, _, place = grouped(np.append(common.hash_words(words), END))
    count = len(off) - 1
    w = np.full(len(codes) + count, place[-1])
    inner = np.ones(len(w), bool)
    inner[off[1:] + np.arange(count)] = False
    w[inner] = place[codes]
    doc = np.repeat(np.arange(count), np.diff(off) + 1)
    return names, w, np.concatenate([place[-1:], w[:-1]]), doc  # what stands before a text's first token is an end, too


def deal(names: np.ndarray, key: np.ndarray, low: int, parts: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places in key) of rising keys (context, token, ``low`` more bits): by context, and of hot contexts by pair."""
    wide = int(len(names)).bit_length()
    u = key >> (low + wide)
    part = common.part_of(names, parts)[u]
    warm = np.zeros(0, np.int64)
    if len(hot):
        warm = np.flatnonzero(np.isin(names, hot)[u])
        w = (key[warm] >> low) & ((1 << wide) - 1)
        to = common.part_of(dish(names[u[warm]], names[w]), parts)
        cold = np.delete(np.arange(len(key)), warm)
        by = np.argsort(to, kind="stable")
        warm, to = warm[by], to[by]
        hot_cut = np.searchsorted(to, np.arange(parts + 1))
    else:
        cold, hot_cut = np.arange(len(key)), np.zeros(parts + 1, np.int64)
    cut = np.searchsorted(part[cold], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut) + np.diff(hot_cut)).tolist():
        at = cold[cut[p] : cut[p + 1]]
        yield p, np.sort(np.concatenate([at, warm[hot_cut[p] : hot_cut[p + 1]]])) if hot_cut[p + 1] > hot_cut[p] else at


def hot_tokens(docs: DataFrame, parts: int) -> np.ndarray:
    """Hashes of tokens that make up more than 1 / (2 * parts) of some chunk: a superset of those that do of the corpus,
    of which the 4 * parts most frequent are taken. Which they are decides where pairs go, never a result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "__text"):
            codes, _, words = common.tokens(common.column(b, "__text"))
            n = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
            big = np.flatnonzero(n * 2 * parts > len(codes))
            h, c = common.hash_words(words.take(pa.array(big))), n[big]
            if b.num_rows * 2 * parts > len(codes) + b.num_rows:
                h, c = np.append(h, END), np.append(c, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "n"])

    rows = docs.select(docs["text"].cast("string").alias("__text")).mapInArrow(run, "h bigint, n bigint")
    top = rows.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(4 * parts).collect()
    return np.sort(np.array([r.h for r in top], np.int64).view(U64))


def packer(names: np.ndarray, low: int):
    """Packs rows of rising keys (context, token, ``low`` more bits): each distinct context once, with the length of its run, and
    each distinct token once, with its places."""
    wide = int(len(names)).bit_length()
    held, code_of = np.zeros(len(names), bool), np.zeros(len(names), np.uint32)

    def pack(key: np.ndarray, v: np.ndarray) -> bytes:
        u, w = key >> (low + wide), (key >> low) & ((1 << wide) - 1)
        start, length = common.runs(u)
        held[w] = True
        own = np.flatnonzero(held)
        held[own] = False
        code_of[own] = np.arange(len(own))
        code = code_of[w].astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
        head, tail = common.pack_sorted(names[u[start]]), common.pack_sorted(names[own])
        return np.array([len(head), len(tail), code.itemsize], "<u4").tobytes() + head + tail + common.pack(length.astype(np.uint32), code, v)

    return pack


def _unpack_pairs(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, m, wide = (int(x) for x in np.frombuffer(data, "<u4", 3))
    w, names = common.unpack_sorted(data[12 : 12 + k]), common.unpack_sorted(data[12 + k : 12 + k + m])
    n, code, v = common.unpack(data[12 + k + m :], "<u4", f"<u{wide}", kind)
    return np.repeat(w, n), names[code], v


def _tables(spark, df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, in folders by its column ``kind``, so that kinds are read apart."""
    path = common.new_path(spark, what)
    df.write.partitionBy("kind").parquet(path)
    common.release(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Rows between the steps. kind: what the row is; part, block: where it belongs; a, b: numbers; data: packed arrays.
ROWS = "kind int, part int, block bigint, a bigint, b bigint, data binary"
_ROWS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])
ROWS_COLUMNS = [f.name for f in _ROWS]
#: Kinds: a part's tokens (with their customers in the root, and training counts), more customers for tokens of a part, pairs of
#: several customers, a hot context's totals, pairs of hot contexts, tables of such pairs, occurrences, documents, replies.
ASK, MORE, STATIC, TOTAL, HOT, TABLES, OCCUR, HEAD, REPLY = range(9)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """Rows by kind, in the order of (block, a)."""
    out: dict[int, list[tuple]] = {}
    for b in batches:
        for r in zip(*(common.column(b, f.name).to_pylist() for f in _ROWS), strict=True):
            out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[2], r[3])) for k, v in out.items()}


def _asks(part: int, kind: int, names: np.ndarray, k: np.ndarray, c: np.ndarray, parts: int) -> Iterator[tuple]:
    cut = np.searchsorted(common.part_of(names, parts), np.arange(parts + 1))
    for i in np.flatnonzero(np.diff(cut)).tolist():
        yield kind, part, i, 0, 0, _pack_names(names[cut[i] : cut[i + 1]], k[cut[i] : cut[i + 1]], c[cut[i] : cut[i + 1]])


def counts(docs: DataFrame, parts: int, hot: np.ndarray, s: Settings, mod: int, rest: int) -> DataFrame:
    """First pass. Of each part: its tokens with the dishes that they are in and their training counts (ASK), its pairs of
    several customers (STATIC), and totals: customers, escape and dishes (TOTAL of block -1), or of a hot context."""
    at_hot = hot

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "__text"):
            names, w, u, doc = occurrences(common.column(b, "__text"))
            train, wide = ~held(common.column(b, "doc_id"), mod, rest), int(len(names)).bit_length()
            key = np.sort((((u << wide) | w) << 1) | train[doc])
            start, _ = common.runs(key >> 1)
            n = np.add.reduceat(key & 1, start).astype(np.uint32) if len(start) else np.zeros(0, np.uint32)  # 0 where held-out documents alone ask for the pair
            key, pack = key[start] >> 1, packer(names, 0)
            yield _rows([(0, p, 0, 0, 0, pack(key[at], n[at])) for p, at in deal(names, key, 0, parts, at_hot)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(r[1], _unpack_pairs(r[5], "<u4")) for r in _gather(batches).get(0, [])]
        if not got:
            return
        part = got[0][0]
        u, w, n = (np.concatenate([g[1][i] for g in got]) for i in range(3))
        del got
        x, _ = dishes(u, w, n)
        del u, w, n
        known = x.n > 0
        c_ctx, k_ctx = np.bincount(x.ui, x.n, len(x.contexts)), np.bincount(x.ui[known], minlength=len(x.contexts))
        out = list(_asks(part, ASK, x.names, np.bincount(x.wi[known], minlength=len(x.names)), np.bincount(x.wi, x.n, len(x.names)).astype(np.int64), parts))
        many, one = x.n > 1, x.n == 1
        # Contexts without pairs of several customers need no sampling, their tables are their dishes.
        used, _, ui = grouped(x.ui[many])
        single = np.bincount(x.ui[one], minlength=len(x.contexts))[used]
        out.append((STATIC, part, 0, 0, 0, common.pack(x.contexts[used], single.astype(np.uint32), ui.astype(np.uint32), x.wi[many].astype(np.uint32), x.n[many].astype(np.uint32), x.key[many], np.bincount(x.wi[one], minlength=len(x.names)).astype(np.uint32))))
        is_hot = np.isin(x.contexts, at_hot)
        for i in np.flatnonzero(is_hot & (c_ctx > 0)).tolist():
            out.append((TOTAL, part, 0, int(x.contexts[i : i + 1].view(np.int64)[0]), 0, common.pack(np.array([c_ctx[i], k_ctx[i], np.count_nonzero(x.ui[one] == i)], np.int64))))
        cold = ~is_hot & (c_ctx > 0)
        out.append((TOTAL, part, -1, int(x.n.sum()), left_over(c_ctx[cold], k_ctx[cold], s), b""))
        yield _rows(out)

    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"))
    return _tables(docs.sparkSession, frame.mapInArrow(pairs, ROWS).repartitionById(parts, F.col("part")).mapInArrow(merge, ROWS), "counts")


def by_token(rows: DataFrame, counted: bool = False) -> DataFrame:
    """A row for each range of tokens: block, how many are known, occur once and are the root's customers once, all root
    customers, several: names and customers of those with more, and data: customers, training counts, and for each part the
    places of the tokens that it holds.

    counted: whether the rows hold training counts over all parts, not each its part's.
    """
    schema = "block bigint, types bigint, once bigint, single bigint, customers bigint, several binary, data binary"

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _gather(batches)
        asks, more = ([(r[1], *_unpack_names(r[5])) for r in sorted(by.get(kind, []))] for kind in (ASK, MORE))
        names, _, at = grouped(np.concatenate([r[1] for r in asks]))
        k, c = (np.zeros(len(names), np.int64) for _ in range(2))
        out, end = [], 0
        for part, own, kk, cc in asks:
            mine = at[end : end + len(own)]
            end += len(own)
            k[mine] += kk
            c[mine] = np.maximum(c[mine], cc) if counted else c[mine] + cc
            out.append((part, mine.astype(np.uint32)))
        for _, own, kk, _ in more:
            np.add.at(k, np.searchsorted(names, own), kk)
        data = common.pack(k, c, np.array([p for p, _ in out], np.int32), np.array([len(m) for _, m in out], np.int64), np.concatenate([m for _, m in out]))
        numbers = (key[0].as_py(), int((c > 0).sum()), int((c == 1).sum()), int((k == 1).sum()), int(k.sum()))
        blobs = (common.pack(names[k > 1], k[k > 1]), data)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in numbers] + [pa.array([v], pa.binary()) for v in blobs], names=["block", "types", "once", "single", "customers", "several", "data"])

    got = common.written(rows.filter(F.col("kind").isin(ASK, MORE)).select(ROWS_COLUMNS).groupBy("block").applyInArrow(add, schema), "tokens")
    common.release(rows.sparkSession)
    return got


def root_samples(tokens: DataFrame, root: Root, s: Settings, salt: int) -> Root:
    """The root's tables swept given its customers: one number a sweep reaches the driver."""
    first = tokens.agg(F.sum("types").alias("types"), F.sum("single").alias("single")).first()
    total, single = first["types"] or 0, first["single"] or 0
    for j in range(s.burn_in + s.samples):
        lam = float(gammas(np.array([s.root_strength / s.root_discount + total]), np.array([END]), s.seed, salt, j)[0])

        def tables(batches: Iterator[pa.RecordBatch], lam=lam, j=j) -> Iterator[pa.RecordBatch]:
            n = 0
            for b in batches:
                for data in common.column(b, "several").to_pylist():
                    names, k = common.unpack(data, "<u8", "<i8")
                    n += int(_root_tables(names, k, root.even, lam, s, salt, j).sum())
            yield pa.RecordBatch.from_pydict({"t": pa.array([n], pa.int64())})

        total = single + (tokens.select("several").mapInArrow(tables, "t bigint").agg(F.sum("t")).first()[0] or 0)
        if j >= s.burn_in:
            root.lambdas.append(lam)
            root.tables += total
    return root


def _root_tables(names: np.ndarray, k: np.ndarray, even: float, lam: float, s: Settings, salt: int, j: int) -> np.ndarray:
    return draw(k, np.full(len(k), s.root_discount * lam * even), names, s.root_discount, s.seed, salt, j)


def replies(tokens: DataFrame, root: Root, s: Settings, salt: int) -> DataFrame:
    """To each part, in the order of its tokens: training counts, root customers and root tables of all samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, several, data in zip(*(common.column(b, c).to_pylist() for c in ("block", "several", "data")), strict=True):
                k, c, to, length, at = common.unpack(data, "<i8", "<i8", "<i4", "<i8", "<u4")
                names, more = common.unpack(several, "<u8", "<i8")
                st, many = np.where(k == 1, len(root.lambdas), 0), np.flatnonzero(k > 1)
                for j, lam in enumerate(root.lambdas):
                    st[many] += _root_tables(names, more, root.even, lam, s, salt, s.burn_in + j)
                cut = np.concatenate([[0], np.cumsum(length)])
                for i in range(0, len(to), 64):
                    yield _rows([(REPLY, p, block, 0, 0, common.pack(c[m], k[m], st[m])) for p, m in ((int(to[q]), at[cut[q] : cut[q + 1]]) for q in range(i, min(i + 64, len(to))))])

    return tokens.select("block", "several", "data").mapInArrow(run, ROWS)


def _replied(rows: list[tuple]) -> list[np.ndarray]:
    got = [common.unpack(r[5], "<i8", "<i8", "<i8") for r in rows]
    return [np.concatenate([g[i] for g in got]) for i in range(3)]


#: Pairs of hot contexts in one row.
PIECE = 100_000


def contexts_given_root(first: DataFrame, answers: DataFrame, root: Root, hot: Hot, parts: int, s: Settings) -> DataFrame:
    """Sweeps of the contexts: ASK anew, now with the tables of the last sweep, TABLES of all samples of a part's pairs of
    several customers, and HOT, the pairs of hot contexts, which wait for ``hot_samples``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _gather(batches)
        if STATIC not in by:
            return
        part = by[STATIC][0][1]
        contexts, single, ui, wi, n, key, k = common.unpack(by[STATIC][0][5], "<u8", "<u4", "<u4", "<u4", "<u4", "<u8", "<u4")
        c, k_root, st = _replied(by[REPLY])
        base = root.share(k_root, st, s)
        names = np.concatenate([_unpack_names(r[5])[0] for r in by[ASK]])
        n, single, k = n.astype(np.int64), single.astype(np.int64), k.astype(np.int64)
        place = hot.place(contexts)[ui]
        cold = place < 0
        some, last = sweeps(n[cold], ui[cold], single, contexts, base[wi[cold]], key[cold], s)
        k += np.bincount(wi[cold], last, len(names)).astype(np.int64)
        out = [*_asks(part, ASK, names, k, c, parts), (TABLES, part, 0, 0, 0, common.pack(some.astype(np.uint32)))]
        warm = np.flatnonzero(~cold)
        for i in range(0, len(warm), PIECE):
            at = warm[i : i + PIECE]
            out.append((HOT, part, i // PIECE, 0, 0, common.pack(place[at].astype(np.uint32), n[at].astype(np.uint32), key[at], names[wi[at]], base[wi[at]])))
        yield _rows(out)

    dealt = first.filter(F.col("kind").isin(ASK, STATIC)).select(ROWS_COLUMNS).unionByName(answers).repartitionById(parts, F.col("part"))
    return _tables(first.sparkSession, dealt.mapInArrow(run, ROWS), "contexts")


def hot_samples(rows: DataFrame, hot: Hot, parts: int, s: Settings) -> DataFrame | None:
    """Sweeps of hot contexts, whose totals reach the driver after each; MORE root customers and TABLES of their pairs."""
    if not len(hot.names):
        return None
    pieces, several = rows.filter(F.col("kind") == HOT).select("part", "block", "data"), hot.tables - hot.single
    for j in range(s.burn_in + s.samples):
        lam = gammas(s.strength / s.discount + hot.single + several, hot.names, s.seed, j)
        hot.lambdas.append(lam)

        def tables(batches: Iterator[pa.RecordBatch], lam=lam, j=j) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(lam), np.int64)
            for b in batches:
                for data in common.column(b, "data").to_pylist():
                    at, n, key, _, base = common.unpack(data, "<u4", "<u4", "<u8", "<u8", "<f8")
                    total += np.bincount(at, draw(n.astype(np.int64), s.discount * lam[at] * base, key, s.discount, s.seed, j), len(lam)).astype(np.int64)
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(total[i])], names=["i", "t"])

        several = np.zeros(len(lam), np.int64)
        for r in pieces.mapInArrow(tables, "i int, t bigint").groupBy("i").agg(F.sum("t").alias("t")).collect():
            several[r.i] = r.t
        if j == s.burn_in:
            hot.tables = np.zeros(len(lam), np.int64)
        if j >= s.burn_in:
            hot.tables = hot.tables + hot.single + several

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, piece, data in zip(common.column(b, "part").to_pylist(), common.column(b, "block").to_pylist(), common.column(b, "data").to_pylist(), strict=True):
                at, n, key, w, base = common.unpack(data, "<u4", "<u4", "<u8", "<u8", "<f8")
                some = np.zeros(len(at), np.int64)
                for j, lam in enumerate(hot.lambdas):
                    t = draw(n.astype(np.int64), s.discount * lam[at] * base, key, s.discount, s.seed, j)
                    some += t if j >= s.burn_in else 0
                names, _, to = grouped(w)
                k = np.bincount(to, t, len(names)).astype(np.int64)
                yield _rows([*_asks(part, MORE, names, k, np.zeros(len(names), np.int64), parts), (TABLES, part, piece, 1, 0, common.pack(some.astype(np.uint32)))])

    return _tables(rows.sparkSession, pieces.mapInArrow(finish, ROWS), "hot")


def _pack_names(names: np.ndarray, k: np.ndarray, c: np.ndarray) -> bytes:
    head = common.pack_sorted(names)
    return np.array([len(head)], "<u4").tobytes() + head + common.pack(k.astype(np.int64), c.astype(np.int64))


def _unpack_names(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return [common.unpack_sorted(data[4 : 4 + n]), *common.unpack(data[4 + n :], "<i8", "<i8")]


def probabilities(x: Dishes, tables: np.ndarray, hot: Hot, base: np.ndarray, s: Settings) -> np.ndarray:
    """Predictions of a part's pairs, averaged over samples. tables: of all samples, of its pairs of several customers."""
    t = np.where(x.n > 0, s.samples, 0)
    t[x.n > 1] = tables
    c_ctx, t_ctx = (np.bincount(x.ui, v, len(x.contexts)) for v in (x.n, t))
    place = hot.place(x.contexts)
    warm = place >= 0
    c_ctx[warm], t_ctx[warm] = hot.customers[place[warm]], hot.tables[place[warm]]
    seen = np.where(x.n > 0, (x.n - s.discount * t / s.samples) / (s.strength + c_ctx[x.ui]), 0)
    return seen + ((s.strength + s.discount * t_ctx / s.samples) / (s.strength + c_ctx))[x.ui] * base[x.wi]


@dataclass
class Model:
    """What scoring takes: shares and totals to send out, and the rows that go to the parts."""

    root: Root
    hot: Hot
    tokens: int
    types: int
    rows: DataFrame


def fit(docs: DataFrame, parts: int, at_hot: np.ndarray, s: Settings, mod: int, rest: int) -> Model:
    """Blocks of the sampler: root, contexts, root."""
    spark = docs.sparkSession
    first = counts(docs, parts, at_hot, s, mod, rest)
    sums = first.filter((F.col("kind") == TOTAL) & (F.col("block") == -1)).agg(F.sum("a").alias("n"), F.sum("b").alias("left")).first()
    n, left = sums["n"] or 0, sums["left"] or 0
    totals: dict[int, np.ndarray] = {}
    for r in first.filter((F.col("kind") == TOTAL) & (F.col("block") == 0)).groupBy("a").agg(F.collect_list("data").alias("data")).collect():  # a few contexts per part
        totals[r.a] = sum(common.unpack(bytes(d), "<i8")[0] for d in r["data"])
    names = np.sort(np.array(list(totals), np.int64).view(U64))
    of = np.array([totals[int(h)] for h in names.view(np.int64)], np.int64).reshape(-1, 3)
    hot = Hot(names, of[:, 0], of[:, 2], of[:, 1])
    left += left_over(hot.customers, hot.tables, s)

    tokens = by_token(first)
    sums = tokens.agg(F.sum("types").alias("types"), F.sum("once").alias("once"), F.sum("customers").alias("customers")).first()
    types, once, customers = (sums[c] or 0 for c in ("types", "once", "customers"))
    unknown = 0.5
    if n:
        # Such that the model expects the unknown token as often as tokens occurred once (Good and Turing).
        escape = left / UNIT / n * (s.root_strength + s.root_discount * types) / (s.root_strength + customers)
        unknown = round(float(np.clip(max(once, 1) / n / max(escape, 1e-12), 0.05, 0.95)), 6)
    even = (1 - unknown) / max(1, types)
    root = root_samples(tokens, Root(even, unknown, customers), s, 1000)
    middle = contexts_given_root(first, replies(tokens, root, s, 1000), root, hot, parts, s)
    common.discard(first)
    common.discard(tokens)
    more = hot_samples(middle, hot, parts, s)
    kept = middle.filter(F.col("kind") == TABLES).select(ROWS_COLUMNS)
    asked = middle.filter(F.col("kind") == ASK).select(ROWS_COLUMNS).withColumn("b", F.lit(0).cast("bigint"))
    if more is not None:
        kept, asked = kept.unionByName(more.filter(F.col("kind") == TABLES).select(ROWS_COLUMNS)), asked.unionByName(more.filter(F.col("kind") == MORE).select(ROWS_COLUMNS))
    tokens = by_token(asked, counted=True)
    root = root_samples(tokens, Root(even, unknown, tokens.agg(F.sum("customers")).first()[0] or 0), s, 2000)
    return Model(root, hot, n, types, kept.unionByName(replies(tokens, root, s, 2000)))


#: How often a row of the second pass can hold a pair in a text.
MOST_TIMES = (1 << 18) - 1


def places(chunk: int, texts: pa.Array, ids: pa.Array, parts: int, hot: np.ndarray, mod: int, rest: int) -> list[tuple]:
    """Second pass: of a chunk, the places of its pairs in texts for each part (OCCUR), and its documents (HEAD)."""
    names, w, u, doc = occurrences(texts)
    out, wide = held(ids, mod, rest), int(len(names)).bit_length()
    length = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    # A pair that a text holds several times is sent once, with their number, up to what fits beside the text's place.
    key = np.sort((((u << wide) | w) << 13) | doc)
    start, times = common.runs(key)
    key = key[start]
    if times.max(initial=0) > MOST_TIMES:
        again = np.repeat(np.arange(len(times)), -(-times // MOST_TIMES))
        left = times[again] - MOST_TIMES * (np.arange(len(again)) - np.searchsorted(again, again))
        key, times = key[again], np.minimum(left, MOST_TIMES)
    tag, pack = ((times << 14) | ((key & 8191) << 1) | (~out)[key & 8191]).astype(np.uint32), packer(names, 13)
    data = [(OCCUR, p, chunk, 0, 0, pack(key[at], tag[at])) for p, at in deal(names, key, 13, parts, hot)]
    head = common.pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), out.astype(np.uint8), length)
    return [*data, (HEAD, chunk % parts, chunk, 0, 0, head)]


def scored_pairs(got: dict[int, list[tuple]], model: Model, s: Settings) -> tuple[Dishes, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Of one part's rows: its pairs, their probabilities, their tokens' training counts, and the places of the rows'
    occurrences (pair, text, times, row)."""
    rows = [_unpack_pairs(r[5], "<u4") for r in got[OCCUR]]
    src = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    u, w, tag = (np.concatenate([r[i] for r in rows]) for i in range(3))
    del rows
    times = (tag >> 14).astype(np.int64)
    x, pair = dishes(u, w, times * (tag & 1))
    c, k, st = _replied(got[REPLY])
    warm_at = model.hot.place(x.contexts)[x.ui] >= 0
    many = x.n > 1
    tables = np.zeros(len(x.n), np.int64)
    for warm in (0, 1):
        parts_of = [common.unpack(r[5], "<u4")[0] for r in got.get(TABLES, []) if r[3] == warm]
        tables[many & (warm_at == bool(warm))] = np.concatenate([*parts_of, np.zeros(0, np.uint32)])
    p = probabilities(x, tables[many], model.hot, model.root.share(k, st, s), s)
    return x, p, c, pair, ((tag >> 1) & 8191, times, src)


def score(docs: DataFrame, *, settings: Settings = Settings(), mod: int = 5, rest: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Documents whose crc32(doc_id as text) leaves ``rest`` modulo ``mod`` are held out of training.
    """
    spark, s = docs.sparkSession, settings
    common.ship(spark)
    parts = common.shuffle_partitions(spark)
    docs = common.steady(docs.select("doc_id", "text"), "documents")
    hot = hot_tokens(docs, parts)
    model = fit(docs, parts, hot, s, mod, rest)
    sent = spark.sparkContext.broadcast(Model(model.root, model.hot, model.tokens, model.types, None))  # 4 * parts contexts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in zip(common.chunk_ids(), common.chunks(batches, "__text"), strict=False):
            yield _rows(places(chunk, common.column(b, "__text"), common.column(b, "doc_id"), parts, hot, mod, rest))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, got = sent.value, _gather(batches)
        heads = got.pop(HEAD, [])
        if heads:
            yield _rows(heads)
        if OCCUR not in got:
            return
        x, p, c, pair, (doc, times, src) = scored_pairs(got, m, s)
        chunks = [r[2] for r in got[OCCUR]]
        del got
        logs = np.log10(np.maximum(p, 1e-300))
        base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.types + 1)))[x.wi]
        known = (c > 0)[x.wi]
        for a, n, chunk in zip(*common.runs(src), chunks, strict=True):
            at = slice(int(a), int(a + n))
            texts, to = np.unique(doc[at], return_inverse=True)
            sums = [np.bincount(to, v[pair[at]] * times[at], len(texts)) for v in (known, base, logs)]
            yield _rows([(OCCUR, 0, chunk, 0, 0, common.pack(texts.astype(np.uint16), sums[0].astype(np.uint32), sums[1], sums[2]))])

    def finish(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts_of = None, []
        for b in batches:
            for kind, data in zip(common.column(b, "kind").to_pylist(), common.column(b, "data").to_pylist(), strict=True):
                if kind == HEAD:
                    head = common.unpack(data, "<i8", "u1", "u1", "<i8")
                else:
                    parts_of.append(common.unpack(data, "<u2", "<u4", "<f8", "<f8"))
        ids, null, held_out, n = head
        known, sums = np.zeros(len(ids), np.int64), [np.zeros(len(ids)) for _ in range(2)]
        for at, k, b1, m1 in parts_of:
            known[at] += k
            sums[0][at] += b1
            sums[1][at] += m1
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(held_out.astype(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(ids), sent.value.tokens, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"))
    dealt = frame.mapInArrow(rows, ROWS).unionByName(model.rows).repartitionById(parts, F.col("part"))
    summed = dealt.mapInArrow(solve, ROWS).select("block", "kind", "data")
    return summed.groupBy("block").applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
