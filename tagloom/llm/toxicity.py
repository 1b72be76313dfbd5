"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams; a stretch of text is the average of its words; a linear softmax over
the average gives the probability of label 1. Embeddings and softmax are trained together, and training leaves out each
n-gram half of the time without making up for it, so that part of a word's n-grams suffice to know it when misspelt. As
averaging and softmax weights are linear, a word has one number, its logit, and a stretch the average of those: scoring
looks every distinct word up once. A text is read as overlapping windows of ``window`` words and scored by its most
toxic window, so that length doesn't dilute; training takes, of each text, the window that scores highest just then.

Learning sees at most ``per_class`` labelled texts of each label, chosen by a hash of their ids (a documented bound, as
allowed for fitting a classifier); whole texts are used. Scoring covers every whole text.

Defined results: null and empty texts, and texts without words, score by the softmax bias alone; of documents of one id
the least text teaches; labels that are null, that disagree between rows of one document, or whose document doesn't exist
teach nothing; without texts of both labels every score is 0; repeated rows are kept; an empty table gives none;
columns named in ``carry`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000
    #: Texts of more bytes are left out of the sample, which so has a bound in bytes, too.
    longest: int = 1 << 16
    buckets: int = 1 << 17
    dim: int = 8
    sizes: tuple[int, ...] = (3, 4, 5)
    window: int = 2
    epochs: int = 15
    least_updates: int = 1000
    batch: int = 128
    rate: float = 0.1
    decay: float = 0.0
    keep: float = 0.5
    seed: int = 7


@dataclass
class Model:
    """logit: of each bucket; bias: of the softmax."""

    logit: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    window: int

    def words(self, words: pa.Array, step: int = 50_000) -> np.ndarray:
        """The logit of each distinct word, some at a time: n-grams take many times the room of their words."""
        out = np.zeros(len(words))
        for i in range(0, len(words), step):
            some = words.slice(i, step)
            ids, of = common.char_grams(some, self.sizes, len(self.logit), whole=False)
            n = len(some)
            out[i : i + step] = np.bincount(of, self.logit[ids], n) / np.maximum(1, np.bincount(of, minlength=n))
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        codes, off, words = common.tokens(texts)
        best, _ = best_windows(self.words(words)[codes] if len(codes) else np.zeros(0), off, self.window)
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -40, 40)))


def best_windows(values: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the highest average of ``window`` consecutive values (or of all, if fewer) and where it starts."""
    n = np.diff(off)
    best, at = np.zeros(len(n)), off[:-1].copy()
    if not len(values):
        return best, at
    total = np.concatenate([[0.0], np.cumsum(values)])
    short = (n > 0) & (n <= window)
    best[short] = (total[off[1:]] - total[off[:-1]])[short] / n[short]
    for i in np.flatnonzero(n > window):
        a, b = off[i], off[i + 1]
        sums = total[a + window : b + 1] - total[a : b - window + 1]
        k = int(sums.argmax())
        best[i], at[i] = sums[k] / window, a + k
    return best, at


def by_word(words: pa.Array, s: Settings, step: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, numbers of them) of the words in order, some words at a time to keep the driver's memory low."""
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), step):
        some = words.slice(i, step)
        g, of = common.char_grams(some, s.sizes, s.buckets, whole=False)
        ids.append(g[np.argsort(of, kind="stable")].astype(np.int32))
        counts.append(np.bincount(of, minlength=len(some)))
    return np.concatenate(ids), np.concatenate(counts)


def fit(texts: list[str], labels: list[int], s: Settings) -> Model | None:
    """Adagrad on the cross entropy of each text's highest window, all texts weighing so that both labels weigh alike."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    codes, off, words = common.tokens(pa.array(texts, pa.string()))
    ids, grams = by_word(words, s)
    first = np.concatenate([[0], np.cumsum(grams)])
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    soft = rng.normal(0, 1, (2, s.dim)).astype(np.float32)
    bias = np.zeros(2)
    g_emb, g_soft, g_bias = np.full(s.buckets, 1e-8, np.float32), np.full((2, s.dim), 1e-8, np.float32), np.full(2, 1e-8)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    n = np.diff(off)

    def logits() -> np.ndarray:
        per = (emb @ (soft[1] - soft[0])).astype(np.float64)
        return np.add.reduceat(per[ids], first[:-1]) / grams if len(words) else np.zeros(0)

    for epoch in range(max(s.epochs, -(-s.least_updates // max(1, len(y) // s.batch)))):
        start = off[:-1].copy()
        if epoch:  # in the first pass a random window stands for the text
            _, start = best_windows(logits()[codes] if len(codes) else np.zeros(0), off, s.window)
        else:
            start = start + (rng.random(len(n)) * np.maximum(0, n - s.window + 1)).astype(np.int64)
        size = np.minimum(n, s.window)
        for pick in np.array_split(rng.permutation(len(y)), max(1, len(y) // s.batch)):
            pick = pick[size[pick] > 0]
            if not len(pick):
                continue
            m = size[pick]
            row = np.repeat(np.arange(len(pick)), m)
            word = codes[np.repeat(start[pick], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            k = grams[word]
            gram = ids[np.repeat(first[word], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            row_g = np.repeat(row, k)
            part = np.repeat(1.0 / (m[row] * k), k).astype(np.float32)
            if s.keep < 1:
                kept = rng.random(len(gram)) < s.keep
                gram, row_g, part = gram[kept], row_g[kept], part[kept]
            used, at = np.unique(gram, return_inverse=True)
            bag = np.zeros((len(pick), len(used)), np.float32)
            np.add.at(bag, (row_g, at), part)
            mean = bag @ emb[used]
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p.copy()
            d[np.arange(len(pick)), y[pick].astype(int)] -= 1
            d *= weight[pick][:, None] / len(pick)
            d = d.astype(np.float32)
            by_emb = bag.T @ (d @ soft) + s.decay * emb[used]
            by_soft = d.T @ mean
            by_bias = d.sum(0)
            g_emb[used] += (by_emb**2).mean(1)
            emb[used] -= s.rate * by_emb / np.sqrt(g_emb[used])[:, None]
            g_soft += by_soft**2
            soft -= s.rate * by_soft / np.sqrt(g_soft)
            g_bias += by_bias**2
            bias -= s.rate * by_bias / np.sqrt(g_bias)
    return Model((emb @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]), s.sizes, s.window)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, longest: int, label: str) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: of each label the ``per_class`` documents that come first by a hash of their ids.

    Two bounded sorts choose the ids and one scan fetches the texts; no more than 2 * per_class ids are sent out.
    """
    agreed = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo = hi").select("doc_id", F.col("lo").alias("y")).filter(learn)
    key = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    chosen = [agreed.filter(F.col("y") == v).orderBy(key, "doc_id").limit(per_class) for v in (1, 0)]
    ids = {r.doc_id: r.y for c in chosen for r in c.collect()}
    if not ids:
        return [], []
    small = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id bigint, __y int")
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(small), "doc_id").filter(F.octet_length("text") <= longest).groupBy("doc_id", "__y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r["__y"] for r in rows]


def learn(docs: DataFrame, labels: DataFrame, who: Column, *, label: str = "toxic", settings: Settings = Settings()) -> Model | None:
    """A model from the labelled documents for which ``who`` (of doc_id) holds."""
    return fit(*sample(docs, labels, who, settings.per_class, settings.longest, label), settings)


def score(docs: DataFrame, model: Model | None, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns ``carry`` (as kept_<name>) of every row."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x 4 bytes, a setting
    kept = list(carry)
    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"), *(F.col(c).alias(f"kept_{c}") for c in kept if c != "text"))
    schema = docs.sparkSession.createDataFrame([], "doc_id bigint, score double").schema
    for c in kept:
        schema = schema.add(f"kept_{c}", frame.schema[common.sent(c)].dataType, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in common.chunks(batches, "__text", common.SMALL_CHUNK):
            got = m.texts(common.column(b, "__text")) if m else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), pa.array(got, pa.float64()), *(common.column(b, common.sent(c)) for c in kept)], names=schema.names)

    return frame.mapInArrow(run, schema)
