"""Quality rules by tokeniser fertility: how well public vocabularies fit a text, held against bands of its like.

Every whole text is counted once (``measure``): words, symbols, repeated lines and windows, and for each vocabulary its
tokens, those that fall back to bytes, and the entropy of its token ids. Words are encoded on their own, each distinct word
of a chunk once; a word of more than SLICE code points is encoded in slices of that many, which bounds the time of one word.
From the counts follow three measures a vocabulary: code points of words a token, share of byte fallback, and entropy as a
share of the most that so many tokens can have.

``bands`` takes quartiles of each measure over all documents that pass the base rules, by language and by script; of
entropy, which falls with length, also by powers of four of the tokens. A band reaches ``reach`` times the distance between
the quartiles to both sides of the median, that distance counting as WIDTH at least. A text is judged by its language's
band, by its script's where the language is null or has fewer than ``least`` such documents, and by none where the script
has fewer, too. ``judge`` joins bands, one row a group, and gives the verdict with the first measure that failed.

Defined results: a null or empty text has no words and fails the base rules; a text without tokens fails them, too; texts of
any length are read whole; repeated rows and ids keep a row each and count each; an empty table gives none; extra columns
are left out but for those that ``carry`` names, which come back as ``kept_<name>``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Code points of a word that are encoded at once.
SLICE = 2048
#: Words whose tokens are counted at once: bounds the memory that a long text takes.
BLOCK = 1 << 18
#: Measures of a vocabulary, with the width of the bins that quartiles are taken over and the least distance of quartiles.
MEASURES = {"chars_per_token": (0.02, 0.1), "byte_share": (0.002, 0.02), "entropy_share": (0.005, 0.01)}
#: Where blocks of letters of a script begin and end, by code point.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x531, 0x587)],
    "Hebrew": [(0x5D0, 0x5EA)],
    "Arabic": [(0x620, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3041, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
NAMES = ("none", *SCRIPTS, "other")
_RANGES = sorted((a, b, NAMES.index(n)) for n, spans in SCRIPTS.items() for a, b in spans)
_STARTS = np.array([a for a, _, _ in _RANGES], np.uint32)
_ENDS = np.array([b for _, b, _ in _RANGES], np.uint32)
_CLASSES = np.array([c for _, _, c in _RANGES], np.int64)

_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """A public vocabulary: a sentencepiece model or a file of ranks."""

    def __init__(self, path: str, pattern: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.vocab_size()
            self.fallback = np.array([model.is_byte(i) for i in range(self.size)])
            self._encode = lambda words: model.encode(words, num_threads=1)
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self.fallback = np.zeros(self.size, bool)
            for token, i in ranks.items():
                self.fallback[i] = not _whole(token)
            self._encode = lambda words: [encoding.encode_ordinary(" " + w) for w in words]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words, where each word's begin, and the end)."""
        cut, owner = words, None
        if any(len(w) > SLICE for w in words):
            pieces = [(i, w[k : k + SLICE]) for i, w in enumerate(words) for k in range(0, len(w), SLICE)]
            owner, cut = np.array([i for i, _ in pieces], np.int64), [w for _, w in pieces]
        lists = self._encode(cut)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((t for x in lists for t in x), np.int64, int(n.sum()))
        if owner is not None:
            n = np.bincount(owner, n, minlength=len(words)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(n)])


def _whole(token: bytes) -> bool:
    """Whether a token is whole characters; if not it is a byte, or bytes, that a text falls back to."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path, pattern)
    return _loaded[path]


def scripts_of(words: list[str]) -> np.ndarray:
    """For each word the place in NAMES of its letters' script: the last one among them, Latin only if there is no other.

    A text has the script of most of its letters' words, of equal ones the first in NAMES.
    """
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.searchsorted(_STARTS, points, side="right") - 1
    kind = np.where((at >= 0) & (points <= _ENDS[at]), _CLASSES[at], np.where(points >= 0x250, len(NAMES) - 1, 0))
    kind[(points >= 0x2000) & (points < 0x2C00) | (points >= 0x3000) & (points < 0x3041) | (points >= 0xFE00) & (points < 0xFE10)] = 0
    ends = np.flatnonzero(points == 10)
    return np.maximum.reduceat(kind, np.concatenate([[0], ends[:-1] + 1]))


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def repeated_words(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each text within a window of three that the text holds twice or more."""
    n, docs = len(codes), len(off) - 1
    if n < 3:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(off))
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(inside):
        return np.zeros(docs, np.int64)
    many = int(codes.max()) + 1
    _, pair = np.unique(codes[inside] * many + codes[inside + 1], return_inverse=True)
    _, window = np.unique(pair * many + codes[inside + 2], return_inverse=True)
    _, which, times = np.unique(doc[inside] * (int(window.max()) + 1) + window, return_inverse=True, return_counts=True)
    first = inside[times[which] > 1]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[first + k] = True
    return np.bincount(doc[hit], minlength=docs).astype(np.int64)


def repeated_lines(text: pa.Array) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier one."""
    lists = pc.split_pattern(text, "\n")
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    enc = lists.flatten().dictionary_encode()
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.binary_length(pc.ascii_trim_whitespace(enc.dictionary)).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(text)), np.diff(off))
    keep = worded[code]
    code, doc = code[keep], doc[keep]
    distinct = np.unique(doc * max(1, len(worded)) + code) // max(1, len(worded))
    return np.bincount(doc, minlength=len(text)) - np.bincount(distinct, minlength=len(text))


def token_counts(v: Vocabulary, words: list[str], codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, tokens of byte fallback, entropy of the token ids in bits) of each text."""
    docs = len(off) - 1
    ids, at = v.encode(words)
    size = np.diff(at)
    fell = _sums(v.fallback[ids].astype(np.int64), at)
    tokens, bytes_ = _sums(size[codes], off), _sums(fell[codes], off)
    doc = np.repeat(np.arange(docs), np.diff(off))
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(codes), BLOCK):
        c = codes[a : a + BLOCK]
        n = size[c]
        place = np.repeat(at[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found, times = np.unique(np.repeat(doc[a : a + BLOCK], n) * v.size + ids[place], return_counts=True)
        # Documents follow each other, so only those at the seam of two blocks can share a key.
        seam = np.searchsorted(keys, doc[a] * v.size)
        both, which = np.unique(np.concatenate([keys[seam:], found]), return_inverse=True)
        keys, counts = np.concatenate([keys[:seam], both]), np.concatenate([counts[:seam], np.bincount(which, np.concatenate([counts[seam:], times])).astype(np.int64)])
    owner = keys // v.size
    share = counts / np.maximum(tokens[owner], 1)
    return tokens, bytes_, np.bincount(owner, -share * np.log2(share), minlength=docs)


def measure(docs: DataFrame, *, vocabularies: dict[str, str], pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts of each text and, for each vocabulary, ``<name>_tokens``, ``_bytes`` and ``_bits``; script and language."""
    common.ship(docs.sparkSession)
    kept = [F.col(c).alias(f"kept_{c}") for c in carry]
    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"), docs["lang"].cast("string").alias("lang"), *kept)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([frame.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("script", T.StringType()), *(T.StructField(c, T.LongType()) for c in counts)])
    for name in vocabularies:
        for suffix, kind in (("tokens", T.LongType()), ("bytes", T.LongType()), ("bits", T.DoubleType())):
            schema = schema.add(f"{name}_{suffix}", kind)
    schema = T.StructType([*schema.fields, *frame.schema.fields[3:]])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    labels = pa.array(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {name: vocabulary(path, pattern) for name, path in vocabularies.items()}
        for b in common.chunks(batches, "__text", common.SMALL_CHUNK):
            text = pc.fill_null(common.column(b, "__text"), "")
            codes, off, dictionary = common.words_as_written(text)
            words = dictionary.to_pylist()
            chars = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            ends = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
            raw = np.frombuffer(b"".join(text.cast(pa.large_binary()).to_pylist()), np.uint8)
            signs = np.diff(np.searchsorted(np.flatnonzero(symbol[raw]), np.concatenate([[0], ends])))
            of_script = np.bincount(doc * len(NAMES) + scripts_of(words)[codes], chars[codes], minlength=b.num_rows * len(NAMES)).reshape(-1, len(NAMES))
            of_script[:, 0] = 0.5  # of no letter: only where there is none
            out = [common.column(b, "doc_id"), common.column(b, "lang"), labels.take(pa.array(of_script.argmax(1)))]
            out += [pa.array(x.astype(np.int64)) for x in (np.diff(off), _sums(chars[codes], off), signs, repeated_lines(text), repeated_words(codes, off))]
            for v in known.values():
                tokens, bytes_, bits = token_counts(v, words, codes, off)
                out += [pa.array(tokens), pa.array(bytes_), pa.array(bits)]
            out += [common.column(b, f"kept_{c}") for c in carry]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return frame.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _measures(names: list[str]) -> dict[str, Column]:
    out = {}
    for v in names:
        tokens, bits = F.greatest(F.col(f"{v}_tokens"), F.lit(1)), F.log2(F.greatest(F.col(f"{v}_tokens"), F.lit(2)).cast("double"))
        out |= {f"{v}_chars_per_token": F.col("word_chars") / tokens, f"{v}_byte_share": F.col(f"{v}_bytes") / tokens, f"{v}_entropy_share": F.col(f"{v}_bits") / bits}
    return out


def _groups(first: str) -> dict[str, Column]:
    """The keys of a text's bands; those of its language are null if that is. Entropy is held against the sized ones."""
    size = F.floor(F.log2(F.greatest(F.col(f"{first}_tokens"), F.lit(1)).cast("double")) / 2).cast("string")
    plain = {k: F.concat(F.lit(f"{k} "), F.col(k)) for k in ("lang", "script")}
    return plain | {f"{k}_sized": F.concat(v, F.lit(" "), size) for k, v in plain.items()}


def bands(measured: DataFrame, names: list[str], *, reach: float = 4.0, least: int = 50) -> DataFrame:
    """``band`` (group), and for each measure ``<measure>_low`` and ``_high``, of groups of ``least`` documents or more.

    Quartiles are exact over bins: each task keeps a count a bin, so the largest group is as small behind the shuffle as any.
    """
    values = _measures(names)
    frame = measured.filter(~base_failed()).select(F.explode(F.array_compact(F.array(*_groups(names[0]).values()))).alias("band"), *(v.alias(m) for m, v in values.items()))
    wide = {m: MEASURES[m.split("_", 1)[1]] for m in values}
    quartiles = [F.expr(f"percentile(round({m} / {wide[m][0]}) * {wide[m][0]}, array(0.25, 0.5, 0.75))").alias(m) for m in values]
    got = frame.groupBy("band").agg(F.count(F.lit(1)).alias("n_docs"), *quartiles).filter(F.col("n_docs") >= least)
    out = ["band", "n_docs"]
    for m in values:
        q = F.col(m)
        far = reach * F.greatest(q[2] - q[0], F.lit(wide[m][1]))
        out += [(q[1] - far).alias(f"{m}_low"), (q[1] + far).alias(f"{m}_high")]
    return got.select(*out)


def judge(measured: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """``measured`` with base_failed, the measures, kept, and ``failed``: the first measure outside its band, null if none is."""
    values = _measures(names)
    groups = _groups(names[0])
    rows = measured.withColumns(values | {"base_failed": base_failed()} | {f"__{k}": v for k, v in groups.items()})
    limits = F.struct(*(c for c in found.columns if c not in ("band", "n_docs")))
    for k in groups:
        rows = rows.join(found.select(F.col("band").alias(f"__{k}"), limits.alias(f"__of_{k}")), f"__{k}", "left")
    inside = []
    for m in values:
        own = F.coalesce(*(F.col(f"__of_{k}") for k in groups if k.endswith("_sized") == m.endswith("entropy_share")))
        inside.append(F.when((F.col(m) < own[f"{m}_low"]) | (F.col(m) > own[f"{m}_high"]), F.lit(m)))
    rows = rows.withColumn("failed", F.when(~F.col("base_failed"), F.coalesce(*inside)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("failed").isNull()).drop(*(f"__{x}{k}" for k in groups for x in ("", "of_")))


def rules(docs: DataFrame, *, vocabularies: dict[str, str], pattern: str, reach: float = 4.0, least: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures of all texts, bands from all of them, and each one's verdict."""
    measured = common.written(measure(docs, vocabularies=vocabularies, pattern=pattern, carry=carry), "fertility")
    names = list(vocabularies)
    # Written, so that Spark knows their size and broadcasts them while that is small: a hot language then needs no shuffle.
    found = common.written(bands(measured, names, reach=reach, least=least), "bands")
    return judge(measured, found, names)
