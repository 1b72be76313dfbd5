"""Token ids as flat files: unsigned integers, 64-bit document offsets, read back by memory mapping.

A data set is a folder of parts. ``part-NNNNN.bin`` holds the ids of a part's documents one after another as
little-endian unsigned integers of 16 bits, or 32 where the vocabulary needs it; ``part-NNNNN.idx`` holds, as
little-endian signed 64-bit integers, the number of documents, their ids, a byte each telling whether the id is null
(padded to 8), and n + 1 offsets counted in ids from the start of the part. ``base`` of a part is the prefix sum of the
counts of the parts before it. Documents ascend by doc_id over the parts (null ids first; equal ids by a hash of
the text). ``manifest.json``, written last, names the bytes of an id and the parts with their sizes and bases.

Parts are cut by range, so no part holds more than its share, and a task writes in the data set's own store under a name
of its own and renames, so that a task that runs again or twice leaves one whole file. Words between white space are encoded once per worker
process and batch, which is exact: the tokenizer drops white space, and neither its normaliser nor its pattern reaches
across white space (and words of plain characters are cut at marks, see ``Pieces``). A text that holds the string of a
special token goes to the tokenizer whole, which gives that token's id there as the library does.

Where the store is a folder, files are read by memory mapping; elsewhere, the ranges needed are read.

Defined results: a null or empty text has the end id alone; an empty table gives a data set without documents;
repeated ids keep a row each; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces whose ids a worker process remembers; beyond that it starts afresh.
MEMORY_PIECES = 600_000
#: Ids read at a time.
READ = 1 << 20
#: Pieces joined into one text for the tokenizer.
JOINED = 4000
#: Characters that are letters or digits in every version of Unicode that a library may carry and stay one when lower-cased, and marks other than the apostrophe.
LETTERS, DIGITS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", "0-9", "!-&(-/:-@\\[-`{-~"

_state: dict = {}


class Pieces:
    """The tokenizer of a file with the ids of the pieces met so far.

    A piece is a word between white space, or, in a word of plain letters, digits and marks (no apostrophes), a run of
    marks or what stands between such runs: the pattern never matches across these borders. A run of letters or of
    marks is one match, and the last token of a match bears the end-of-word suffix, so many are encoded as one text and
    told apart by it; any other piece is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.whole, self.tokenizer = path, Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces are lower-cased: what looks like a special token there is none
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = "|".join(re.escape(t) for t in added) if added else None
        vocab = self.tokenizer.get_vocab()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or None
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.single = re.compile(f"[{LETTERS}]+|[{MARKS}]+") if suffix else None
        self.kind = np.dtype("<u4")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, self.kind)

    def learn(self, pieces: list[str]) -> None:
        lens, ids = [self.lens], [self.ids]
        whole = [p for p in pieces if self.single and self.single.fullmatch(p)]
        rest = [p for p in pieces if not (self.single and self.single.fullmatch(p))]
        for i in range(0, len(whole), JOINED):
            some = whole[i : i + JOINED]
            got = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(some) or (len(ends) and ends[-1] != len(got)):
                rest += some
                continue
            self.index.update(zip(some, range(len(self.index), len(self.index) + len(some)), strict=True))
            lens.append(np.diff(ends, prepend=0))
            ids.append(got)
        for i in range(0, len(rest), JOINED):
            for p, e in zip(rest[i : i + JOINED], self.tokenizer.encode_batch_fast(rest[i : i + JOINED], add_special_tokens=False), strict=True):
                self.index[p] = len(self.index)
                lens.append(np.array([len(e.ids)]))
                ids.append(np.array(e.ids, self.kind))
        self.lens, self.ids = np.concatenate(lens), np.concatenate(ids)

    def of(self, pieces: list[str]) -> pa.ListArray:
        """The ids of each piece."""
        new = [p for p in pieces if p not in self.index]
        if len(self.index) + len(new) > MEMORY_PIECES:
            self.forget()
            new = pieces
        if new:
            self.learn(new)
        at = np.fromiter((self.index[p] for p in pieces), np.int64, len(pieces))
        known = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int32)), pa.array(self.ids))
        return known.take(pa.array(at))


def _pieces(path: str) -> Pieces:
    if _state.get("path") != path:
        _state.update(path=path, pieces=Pieces(path))
    return _state["pieces"]


def _split(words: pa.Array) -> pa.ListArray:
    """The pieces of each word."""
    plain = pc.match_substring_regex(words, f"^[{LETTERS}{DIGITS}{MARKS}]*$")
    return pc.ascii_split_whitespace(pc.if_else(plain, pc.replace_substring_regex(words, f"([{MARKS}]+)", r" \1 "), words))


def encode_texts(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts, with the end id after each."""
    tok = _pieces(path)
    whole = pc.fill_null(pc.match_substring_regex(texts, tok.special), False).to_numpy(zero_copy_only=False) if tok.special and len(texts) else np.zeros(len(texts), bool)
    if not whole.any():
        return _encode_plain(texts, tok, end_id)
    plain, off = _encode_plain(pc.if_else(pa.array(whole), pa.scalar(None, texts.type), texts), tok, end_id)
    out, tail = [plain[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], [end_id] if end_id is not None else []
    for i in np.flatnonzero(whole).tolist():
        out[i] = np.array(tok.whole.encode(texts[i].as_py(), add_special_tokens=False).ids + tail, tok.kind)
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def _encode_plain(texts: pa.Array, tok: Pieces, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    codes, off, words = common.tokens(texts)  # lower-casing A-Z first is what the tokenizer would do
    parts = _split(words)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy() - parts.offsets[0].as_py()] if len(words) else np.zeros(1, np.int64)
    enc = flat.filter(full).dictionary_encode()
    by_piece = tok.of(enc.dictionary.to_pylist())
    pooled = by_piece.take(enc.indices.cast(pa.int64()))
    # ids of each distinct word: those of its pieces one after another; the end of a text is a word of its own
    starts = pooled.offsets.to_numpy()[ends].astype(np.int64)
    values = pooled.values.to_numpy()
    tail = [end_id] if end_id is not None else []
    by_word = pa.ListArray.from_arrays(pa.array(np.append(starts, starts[-1] + len(tail)).astype(np.int32)), pa.array(np.append(values[: starts[-1]], np.array(tail, tok.kind)).astype(tok.kind)))
    count = len(off) - 1
    at = np.full(len(codes) + count, len(words), np.int64)
    inner = np.ones(len(at), bool)
    inner[off[1:] + np.arange(count)] = False
    at[inner] = codes
    out = by_word.take(pa.array(at))
    where = out.offsets.to_numpy().astype(np.int64)
    return out.values.to_numpy()[where[0] : where[-1]], (where - where[0])[np.concatenate([[0], off[1:] + np.arange(1, count + 1)])]


def id_kind(path: str, end_id: int | None) -> str:
    """The least unsigned type that holds every id of the tokenizer and the end id."""
    from tokenizers import Tokenizer

    top = max([*Tokenizer.from_file(path).get_vocab().values(), 0 if end_id is None else end_id])
    return "<u2" if top < 1 << 16 else "<u4"


class Store:
    """The files of a data set: in a folder that all machines see, or in any file system that Arrow knows."""

    def __init__(self, uri: str):
        u = urlparse(uri)
        self.folder = u.path if u.scheme in ("", "file") else None
        if self.folder is None:
            from pyarrow import fs

            self.system, self.base = fs.FileSystem.from_uri(uri)
        else:
            os.makedirs(self.folder, exist_ok=True)

    def _path(self, name: str) -> str:
        return f"{self.base if self.folder is None else self.folder}/{name}"

    def create(self, name: str):
        return self.system.open_output_stream(self._path(name)) if self.folder is None else open(self._path(name), "wb")

    def rename(self, name: str, to: str) -> None:
        (self.system.move if self.folder is None else os.replace)(self._path(name), self._path(to))

    def text(self, name: str) -> str:
        with self.system.open_input_stream(self._path(name)) if self.folder is None else open(self._path(name), "rb") as f:
            return f.read().decode()

    def items(self, name: str, kind: str, first: int, stop: int) -> np.ndarray:
        """Items first to stop of a file of numbers."""
        width = np.dtype(kind).itemsize
        if self.folder is None:
            with self.system.open_input_file(self._path(name)) as f:
                return np.frombuffer(f.read_at((stop - first) * width, first * width), kind)
        return np.memmap(self._path(name), kind, "r", first * width, (stop - first,)) if stop > first else np.zeros(0, kind)


def write(docs: DataFrame, uri: str, *, path: str, end_id: int | None) -> list[dict]:
    """Writes the data set and returns its parts: part, n_docs, n_tokens, base. One row a part reaches the driver."""
    spark = docs.sparkSession
    common.ship(spark)
    store, kind, parts = Store(uri), id_kind(path, end_id), common.shuffle_partitions(spark)
    # Cut by id and a hash of the text, not by the text: the sample that sets the cuts stays small.
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    frame = docs.select("doc_id", docs["text"].cast("string").alias("text")).withColumn("key", F.xxhash64("text")).repartitionByRange(parts, *order)
    frame = frame.sortWithinPartitions(*order, F.col("text").asc_nulls_first()).drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, store = TaskContext.get(), Store(uri)
        part, temp = c.partitionId(), f".{c.partitionId():05d}-{c.taskAttemptId()}"
        ids, nulls, offs, total = [], [], [np.zeros(1, "<i8")], 0
        with store.create(temp + ".bin") as out:
            for b in common.chunks(batches, most=common.SMALL_CHUNK):
                got, off = encode_texts(common.column(b, "text"), path, end_id)
                out.write(got.astype(kind).tobytes())
                col = common.column(b, "doc_id")
                nulls.append(col.is_null().to_numpy(zero_copy_only=False))
                ids.append(pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype("<i8"))
                offs.append((off[1:] + total).astype("<i8"))
                total += len(got)
        n = sum(map(len, ids))
        with store.create(temp + ".idx") as out:
            flags = np.concatenate([*nulls, np.zeros(0, bool)]).astype(np.uint8)
            out.write(np.array([n], "<i8").tobytes() + b"".join(x.tobytes() for x in ids) + flags.tobytes() + bytes(-n % 8) + b"".join(x.tobytes() for x in offs))
        for end in ("bin", "idx"):
            store.rename(f"{temp}.{end}", f"part-{part:05d}.{end}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n], "n_tokens": [total]}, pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    done = sorted(frame.mapInArrow(run, "part int, n_docs bigint, n_tokens bigint").collect(), key=lambda r: r["part"])
    out, base = [], 0
    for r in done:
        out.append({"part": r["part"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "base": base})
        base += r["n_tokens"]
    with store.create(".manifest") as f:
        f.write(json.dumps({"id_bytes": np.dtype(kind).itemsize, "parts": out}).encode())
    store.rename(".manifest", "manifest.json")
    return out


def read(spark, uri: str) -> DataFrame:
    """Each document of a data set: doc_id, start (over all parts), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    common.ship(spark)
    manifest = json.loads(Store(uri).text("manifest.json"))
    kind = f"<u{manifest['id_bytes']}"
    some = [(p["part"], p["n_docs"], p["base"]) for p in manifest["parts"] if p["n_docs"]]
    index = spark.createDataFrame(some, "part int, n_docs bigint, base bigint")
    if some:
        index = index.repartition(max(1, min(len(some), common.shuffle_partitions(spark))))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(uri)
        for b in batches:
            for r in b.to_pylist():
                name, n = f"part-{r['part']:05d}", r["n_docs"]
                padded = (n + 7) // 8
                if int(store.items(f"{name}.idx", "<i8", 0, 1)[0]) != n:
                    raise RuntimeError(f"{name}.idx is not the manifest's")
                null = store.items(f"{name}.idx", "u1", 8 * (1 + n), 8 * (1 + n) + n).astype(bool)
                for lo in range(0, n, 10_000):
                    hi = min(n, lo + 10_000)
                    who = store.items(f"{name}.idx", "<i8", 1 + lo, 1 + hi)
                    off = np.array(store.items(f"{name}.idx", "<i8", 1 + n + padded + lo, 1 + n + padded + hi + 1))
                    crc, i = [], 0
                    while i < hi - lo:  # some documents' ids at a time
                        j = max(i + 1, int(np.searchsorted(off, off[i] + READ, side="right")) - 1)
                        ids = store.items(f"{name}.bin", kind, int(off[i]), int(off[j]))
                        crc += [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[i:j] - off[i], off[i + 1 : j + 1] - off[i], strict=True)]
                        i = j
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(who), pa.int64(), mask=null[lo:hi]), pa.array(off[:-1] + r["base"], pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return index.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, *, path: str, end_id: int | None) -> DataFrame:
    """Writes the ids into the shared folder and reads the files back."""
    uri = common.new_path(docs.sparkSession, "ids")
    write(docs, uri, path=path, end_id=end_id)
    return read(docs.sparkSession, uri)
