"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test items, one scan of each text.

Normalised text is what is left after lower-casing A-Z and turning every ASCII character that is neither a digit nor
a letter into a word break; other characters belong to words. A window is ``window`` consecutive words of an item; an
item with fewer words, but not none, is one window. Windows are matched as whole words, and each match is traced to
the characters of the original text that it covers.

Items whose windows take at most ``block_bytes`` are broadcast as texts, and each worker builds their automaton once. More
items are dealt by hash into as many blocks as that bound asks for: one scan of the documents for each block, with its
automaton, whose hits are merged by row. So neither the driver nor a worker holds more than a block's items at a time.

Defined results: a null or empty text has no words and no hits; a null or empty item has no windows; an item without
an id marks words but is not counted or listed; items with equal texts are all listed; repeated documents give
repeated rows; of an empty table nothing is returned; further columns of either table are ignored (``carry`` keeps
columns of the documents as kept_<name>).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<start:int,stop:int>>, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def windows_of(text: str | None, window: int) -> set[str]:
    """The windows of an item, one Latin-1 character per byte, with a space at either end."""
    w = words_of(text)
    return {(b" " + b" ".join(w[i : i + window]) + b" ").decode("latin-1") for i in range(max(1, len(w) - window + 1))} if w else set()


def automaton(items: list[tuple[str | None, str | None]], window: int):
    """Of (item id as text, text): the automaton and the ids. Each window leads to (its words, its length, the places in ids of
    the items that have it); a place of -1 stands for no id. None without windows."""
    import ahocorasick

    by: dict[str, list[int]] = {}
    ids: list[str] = []
    for item, text in items:
        found = windows_of(text, window)
        place = -1
        if found and item is not None:
            place = len(ids)
            ids.append(item)
        for w in found:
            by.setdefault(w, []).append(place)
    a = ahocorasick.Automaton()
    for w, places in by.items():
        a.add_word(w, (w.count(" ") - 1, len(w), places))
    a.make_automaton()
    return (a, ids) if by else (None, ids)


def scan(joined: str, n: int, a, ids: list[str], hit: np.ndarray, items: set[str]) -> None:
    """Marks the hit words of a normalised text and gathers the items."""
    starts = None
    for end, (k, length, places) in a.iter(joined):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        first = int(np.searchsorted(starts, end - length + 1))
        hit[first : first + k] = True
        items.update(ids[p] for p in places if p >= 0)


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Stretches of hit words as character offsets into the original text."""
    at = [m.span() for m in WORD.finditer(text.translate(_UPPER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": at[i][0], "stop": at[j - 1][1]} for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def hits_of(texts: list[str | None], a, ids: list[str]) -> list[tuple[np.ndarray, set[str]]]:
    """Of each text: which words are hit, and the items found."""
    out = []
    for t in texts:
        w = words_of(t)
        hit, items = np.zeros(len(w), bool), set()
        if w and a is not None:
            scan((b" " + b" ".join(w) + b" ").decode("latin-1"), len(w), a, ids, hit, items)
        out.append((hit, items))
    return out


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("contaminated", pa.bool_()),
])


def _results(ids: pa.Array, texts: list[str | None], got: list[tuple[np.ndarray, set[str]]], kept: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    n_hit = [int(h.sum()) for h, _ in got]
    out = [
        ids, pa.array([len(h) for h, _ in got], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for _, f in got], pa.int64()), pa.array([sorted(f) for _, f in got], pa.list_(pa.string())),
        pa.array([spans_of(t, h) if k else [] for t, (h, _), k in zip(texts, got, n_hit, strict=True)], _RESULT.field("spans").type), pa.array([k > 0 for k in n_hit]),
    ]
    return pa.RecordBatch.from_arrays(out + kept, names=_RESULT.names + names)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = 16 << 20, text: str = "text", item_text: str = "text", item_id: str = "item_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """What each document has of the items' windows, with the spans of the original text; ``carry``: columns kept."""
    spark = docs.sparkSession
    common.ship(spark)
    names = [f"kept_{c}" for c in carry]
    frame = docs.select("doc_id", docs[text].cast("string").alias("__text"), *(docs[c].alias(f"kept_{c}") for c in carry if c != text))
    schema = spark.createDataFrame([], SCHEMA).schema
    for c in carry:
        schema = schema.add(f"kept_{c}", frame.schema[common.sent(c, text)].dataType, True)
    items = items.select(items[item_id].cast("string").alias("item"), items[item_text].cast("string").alias("words"))
    # A window takes at most as many words as the item has from its first one on.
    size = items.agg(F.sum(F.octet_length("words") * window)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def sent(rows: DataFrame):
        return spark.sparkContext.broadcast([(r.item, r.words) for r in rows.collect()])  # a block: block_bytes / window of text

    if blocks == 1:
        one = sent(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, ids = automaton(one.value, window)
            for b in common.chunks(batches, "__text", common.SMALL_CHUNK):
                texts = common.column(b, "__text").to_pylist()
                yield _results(common.column(b, "doc_id"), texts, hits_of(texts, a, ids), [common.column(b, common.sent(c, text)) for c in carry], names)

        return frame.mapInArrow(run, schema)

    frame = common.written(frame.withColumn("__row", F.monotonically_increasing_id()), "documents")
    found = None
    for i in range(blocks):
        block = sent(items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i))

        def some(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            a, ids = automaton(block.value, window)
            for b in common.chunks(batches, "__text", common.SMALL_CHUNK):
                got = hits_of(common.column(b, "__text").to_pylist(), a, ids)
                at = [k for k, (h, _) in enumerate(got) if h.any()]
                yield pa.RecordBatch.from_arrays(
                    [common.column(b, "__row").take(pa.array(at, pa.int64())), pa.array([np.packbits(got[k][0]).tobytes() for k in at], pa.binary()), pa.array([sorted(got[k][1]) for k in at], pa.list_(pa.string()))], names=["__row", "__hit", "__items"]
                )

        hits = common.written(frame.select("__row", "__text").mapInArrow(some, "__row bigint, __hit binary, __items array<string>"), "hits")
        block.unpersist()
        found = hits if found is None else found.unionByName(hits)
    gathered = found.groupBy("__row").agg(F.collect_list("__hit").alias("__hits"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))  # a row a block at most

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "__text", common.SMALL_CHUNK):
            texts, got = common.column(b, "__text").to_pylist(), []
            for t, parts, items in zip(texts, common.column(b, "__hits").to_pylist(), common.column(b, "__items").to_pylist(), strict=True):
                n = len(words_of(t))
                packed = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts]) if parts else np.zeros((n + 7) // 8, np.uint8)
                got.append((np.unpackbits(packed)[:n].astype(bool), set(items or [])))
            yield _results(common.column(b, "doc_id"), texts, got, [common.column(b, common.sent(c, text)) for c in carry], names)

    return frame.join(gathered, "__row", "left").mapInArrow(merge, schema)
