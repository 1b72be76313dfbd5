"""Language identification of code-switched text by a linear-chain conditional random field over words.

Emissions of a word are sums of learned weights of its features: affixes of 1 to 4 bytes, inner n-grams of 2 to 4
bytes and the word itself (the lexicon), all hashed into one table. Transitions between languages are learned, too.
Training maximises the likelihood of labelled sequences by forward-backward gradients. The sequences are made of
stretches of documents of known language, of random lengths, so that languages switch within a sequence and the
transitions see it. Prediction runs forward-backward over every word of a text: its language is the one with the
greatest sum of posteriors over words that have a letter, its score that sum's share.

Learning sees at most ``per_lang`` documents of each language, chosen by a hash of their ids (a documented bound); the
languages themselves are counted over all documents.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
learned; rows with a null language teach nothing; ties go to the first language by name; repeated rows are kept; an
empty table gives none; columns named in ``carry`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Settings:
    per_lang: int = 400
    #: Texts of more bytes are left out of the sample, which so has a bound in bytes, too.
    longest: int = 1 << 16
    words_per_doc: int = 400
    buckets: int = 1 << 17
    grams: tuple[int, ...] = (2, 3, 4)
    affix: int = 4
    length: int = 48
    batch: int = 64
    epochs: int = 3
    rate: float = 0.2
    seed: int = 11


def features(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of inner n-grams, affixes and the word itself."""
    ids, of = common.char_grams(words, s.grams, s.buckets)
    n = len(words)
    if not n:
        return ids, of
    joined = b"".join(words.cast(pa.large_binary()).to_pylist())
    lens = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(joined, np.uint8).astype(common.U64)
    start = np.cumsum(lens) - lens
    out_ids, out_of = [ids], [of]
    mask = common.U64(s.buckets - 1)
    with np.errstate(over="ignore"):
        for from_end in (False, True):
            h = np.full(n, 0x51ED270B if from_end else 0x9E3779B9, common.U64)
            for k in range(1, s.affix + 1):
                has = lens >= k
                at = (start + lens - k) if from_end else (start + k - 1)
                h[has] = h[has] * common.U64(0x100000001B3) + raw[at[has]] + common.U64(1)
                out_ids.append((common.mix(h[has] + common.U64(k << 8)) & mask).astype(np.int64))
                out_of.append(np.flatnonzero(has))
    return np.concatenate(out_ids), np.concatenate(out_of)


def forward_backward(emit: np.ndarray, trans: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of sequences laid out one after another, longest first.

    emit: (words, languages) potentials, not logarithms; trans: (languages, languages) potentials. Returns posteriors,
    the sum of pair posteriors, and the logarithm of each sequence's normaliser. Each step handles all sequences that
    are that long, and sums are scaled to 1 at each word, so long texts neither overflow nor vanish.
    """
    n_seq, k = len(lens), trans.shape[0]
    start = np.cumsum(lens) - lens
    alpha = np.empty_like(emit)
    scale = np.ones(len(emit), emit.dtype)
    longest = int(lens[0]) if n_seq else 0
    alive = np.searchsorted(-lens, -np.arange(longest), side="left")  # sequences longer than t
    prev = None
    for t in range(longest):
        m = alive[t]
        at = start[:m] + t
        a = emit[at] if prev is None else (prev[:m] @ trans) * emit[at]
        z = a.sum(1)
        scale[at] = z
        a /= z[:, None]
        alpha[at] = a
        prev = a
    pairs = np.zeros((k, k))
    post = np.empty_like(emit)
    beta = np.ones((n_seq, k), emit.dtype)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = start[:m] + t
        p = alpha[at] * beta[:m]
        post[at] = p / p.sum(1, keepdims=True)
        if t:
            right = emit[at] * beta[:m] / scale[at][:, None]
            before = alpha[at - 1]
            pairs += trans * (before.T @ right)
            beta[:m] = right @ trans.T
    logs = np.add.reduceat(np.log(scale), start) if n_seq and len(scale) else np.zeros(n_seq)
    return post, pairs, logs


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray
    trans: np.ndarray
    settings: Settings

    def emissions(self, words: pa.Array, step: int = 30_000) -> np.ndarray:
        """Potentials of distinct words, some at a time: features take many times the room of their words."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        for i in range(0, len(words), step):
            some = words.slice(i, step)
            ids, of = features(some, self.settings)
            for j in range(len(self.langs)):
                out[i : i + step, j] = np.bincount(of, self.weight[ids, j], len(some))
        return np.exp(out - out.max(1, keepdims=True)) + np.float32(1e-6) if len(out) else out

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Posteriors of all words; with the words' codes, offsets, dictionary, and whether they hold a letter."""
        codes, off, words = common.tokens(texts)
        lens = np.diff(off)
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] > 0]
        lens_o = lens[order]
        src = np.repeat(off[:-1][order] - (np.cumsum(lens_o) - lens_o), lens_o) + np.arange(lens_o.sum())
        post = np.zeros((len(codes), len(self.langs)), np.float32)
        if len(src):
            post[src] = forward_backward(self.emissions(words)[codes[src]], np.exp(self.trans).astype(np.float32), lens_o)[0]
        letter = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
        return post, codes, off, words, letter[codes] if len(codes) else np.zeros(0, bool)

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        post, _, off, _, letter = self.words(texts)
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(post * letter[:, None], 0, dtype=np.float64)])
        sums = total[off[1:]] - total[off[:-1]]
        have = np.concatenate([[0], np.cumsum(letter)])
        none = (have[off[1:]] - have[off[:-1]]) == 0
        best = sums.argmax(1)
        score = np.where(none, 0.0, np.clip(sums[np.arange(len(best)), best] / np.maximum(sums.sum(1), 1e-30), 0, 1))
        return ["und" if x else self.langs[i] for i, x in zip(best.tolist(), none.tolist(), strict=True)], score


def fit(texts: list[str], langs: list[str], s: Settings) -> Model | None:
    """Adagrad on the likelihood of sequences that switch language between stretches."""
    names = sorted(set(langs))
    if not names:
        return None
    codes, off, words = common.tokens(pa.array(texts, pa.string()))
    ids, of = features(words, s)
    order = np.argsort(of, kind="stable")
    ids = ids[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
    n_feat = np.diff(first)
    y_doc = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(s.seed)
    k = len(names)
    weight, g_weight = np.zeros((s.buckets, k), np.float32), np.full((s.buckets, k), 1e-6, np.float32)
    trans, g_trans = np.zeros((k, k)), np.full((k, k), 1e-6)
    lens = np.diff(off)
    docs_by = [np.flatnonzero((y_doc == j) & (lens > 0)) for j in range(k)]
    usable = [j for j in range(k) if len(docs_by[j])]
    if not usable:
        return None
    n_words = int(np.minimum(lens, s.words_per_doc).sum())
    for _ in range(max(1, s.epochs * n_words // (s.batch * s.length))):
        seq = np.empty((s.batch, s.length), np.int64)
        gold = np.empty((s.batch, s.length), np.int64)
        for i in range(s.batch):
            t = 0
            while t < s.length:
                j = usable[rng.integers(len(usable))]
                d = docs_by[j][rng.integers(len(docs_by[j]))]
                m = int(min(s.length - t, lens[d], rng.integers(2, s.length + 1)))
                a = off[d] + rng.integers(lens[d] - m + 1)
                seq[i, t : t + m], gold[i, t : t + m] = codes[a : a + m], j
                t += m
        flat, y = seq.reshape(-1), gold.reshape(-1)
        uniq, inv = np.unique(flat, return_inverse=True)
        nf = n_feat[uniq]
        idx = ids[np.repeat(first[uniq], nf) + np.arange(nf.sum()) - np.repeat(np.cumsum(nf) - nf, nf)]
        logit = np.add.reduceat(weight[idx], np.cumsum(nf) - nf, axis=0)
        emit = np.exp(logit - logit.max(1, keepdims=True)).astype(np.float64) + 1e-6
        post, pairs, _ = forward_backward(emit[inv], np.exp(trans), np.full(s.batch, s.length))
        d = post
        d[np.arange(len(y)), y] -= 1
        per_word = np.zeros((len(uniq), k))
        np.add.at(per_word, inv, d)
        used, at = np.unique(idx, return_inverse=True)
        grad = np.zeros((len(used), k), np.float32)
        for j in range(k):
            grad[:, j] = np.bincount(at, np.repeat(per_word[:, j], nf), len(used))
        grad /= s.batch
        g_weight[used] += grad**2
        weight[used] -= s.rate * grad / np.sqrt(g_weight[used])
        g = gold
        real = np.zeros((k, k))
        np.add.at(real, (g[:, :-1].reshape(-1), g[:, 1:].reshape(-1)), 1)
        g_t = (pairs - real) / s.batch
        g_trans += g_t**2
        trans -= s.rate * g_t / np.sqrt(g_trans)
    return Model(names, weight, trans - trans.max(), s)


def sample(docs: DataFrame, learn: Column, per_lang: int, longest: int) -> tuple[list[str], list[str]]:
    """Of each language about ``per_lang`` documents, never more: those whose hash falls below the share that gives twice as many."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & (F.octet_length(F.col("text").cast("string")) <= longest))
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    space = 1 << 30
    share = docs.sparkSession.createDataFrame([(k, min(space, -(-2 * per_lang * space // n))) for k, n in counts.items()], "lang string, __share bigint")
    key = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id"), F.xxhash64("text")), F.lit(space))
    got = rows.select("lang", F.col("text").cast("string").alias("text"), key.alias("__key"), "doc_id").join(F.broadcast(share), "lang").filter("__key < __share").collect()
    got.sort(key=lambda r: (r.lang, r["__key"], r.doc_id is None, r.doc_id or 0))
    texts, langs, seen = [], [], {}
    for r in got:
        seen[r.lang] = seen.get(r.lang, 0) + 1
        if seen[r.lang] <= per_lang:
            texts.append(r.text)
            langs.append(r.lang)
    return texts, langs


def learn(docs: DataFrame, who: Column, settings: Settings = Settings()) -> Model | None:
    return fit(*sample(docs, who, settings.per_lang, settings.longest), settings)


def predict(docs: DataFrame, model: Model | None, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns ``carry`` (as kept_<name>) of every row."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages x 4 bytes
    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"), *(F.col(c).alias(f"kept_{c}") for c in carry if c != "text"))
    schema = docs.sparkSession.createDataFrame([], "doc_id bigint, lang_pred string, score double").schema
    for c in carry:
        schema = schema.add(f"kept_{c}", frame.schema[common.sent(c)].dataType, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in common.chunks(batches, "__text", common.SMALL_CHUNK):
            langs, got = m.texts(common.column(b, "__text")) if m else (["und"] * b.num_rows, np.zeros(b.num_rows))
            yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), pa.array(langs, pa.string()), pa.array(got, pa.float64()), *(common.column(b, common.sent(c)) for c in carry)], names=schema.names)

    return frame.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, and for each word its text, language and posterior: the labelling of code-switched text itself."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in common.chunks(batches, "__text"):
            post, codes, off, words, _ = m.words(common.column(b, "__text"))
            best = post.argmax(1) if len(post) else np.zeros(0, np.int64)
            w = words.to_pylist()
            rows = [[{"word": w[codes[i]], "lang": m.langs[best[i]], "score": float(post[i, best[i]])} for i in range(x, y)] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), pa.array(rows, kind)], names=["doc_id", "words"])

    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"))
    return frame.mapInArrow(run, "doc_id bigint, words array<struct<word:string,lang:string,score:double>>")
