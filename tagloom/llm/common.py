"""What the operators of this subpackage share: the shared folder, shipping, tokens, chunks, routing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one chunk of documents holds before it is worked on; a single longer text is a chunk.
CHUNK_BYTES = 8 << 20
#: The same for work whose results don't depend on how texts are grouped.
SMALL_CHUNK = 3 << 20
#: Documents that one chunk holds at most: their place in it fits in 13 bits.
CHUNK_DOCS = 1 << 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run in one
    process, a temporary one. On a cluster without that setting there is none, which is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = d.get() if d.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tagloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tagloom-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that no plan needs any more: Spark removes them once the JVM has collected what refers to them.

    Twice, as the first round frees what holds the references that the second one clears.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing that is still to run reads it."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tagloom-" in folder:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that workers import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tagloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="tagloom-ship-"), "tagloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.join("tagloom", os.path.relpath(full, root)))
        sc.addPyFile(path)
    sc._tagloom_shipped = True


def crc_mod(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def steady(df: DataFrame, what: str) -> DataFrame:
    """df, written first if its rows come out of a shuffle: then a task that runs again meets its rows in the same order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df, what) if "Exchange" in plan or "Scan ExistingRDD" in plan else df


# ---------------------------------------------------------------- tokens


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts after lower-casing A-Z.

    Returns (codes, offsets, dictionary): the words of text i are dictionary[codes[offsets[i]:offsets[i+1]]].
    Null and empty texts have none.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = parts.flatten()
    off = parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    enc = flat.dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = enc.dictionary
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0 if len(words) else np.zeros(0, bool)
    if not full.all():
        keep = full[codes]
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        codes = codes[keep]
    return codes, off, words


def words_as_written(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``tokens``, but with the case of letters as it is."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    off = parts.offsets.to_numpy().astype(np.int64)
    enc = parts.flatten().dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(enc.dictionary).to_numpy(zero_copy_only=False) > 0 if len(enc.dictionary) else np.zeros(0, bool)
    keep = full[codes]
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[off - off[0]], enc.dictionary


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit (two xorshift-multiply rounds)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(29))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


# ---------------------------------------------------------------- chunks


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches dealt anew so that each holds about ``most`` bytes of text and CHUNK_DOCS rows at most."""
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def out() -> pa.RecordBatch:
        return pa.concat_batches(held) if len(held) > 1 else held[0]

    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + most - size, side="left")) + 1
            stop = min(max(stop, start + 1), b.num_rows, start + CHUNK_DOCS - rows)
            held.append(b.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            rows += stop - start
            start = stop
            if size >= most or rows >= CHUNK_DOCS:
                yield out()
                held, size, rows = [], 0, 0
    if held:
        yield out()
        held = []
    trim()


def trim() -> None:
    """Gives memory that a task has freed back to the system: workers live on, and their executor's memory is counted whole."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def chunk_ids() -> Iterator[int]:
    """Ids of a task's chunks: unique over tasks, the same when a task runs again."""
    from pyspark import TaskContext

    c = TaskContext.get()
    base = (c.partitionId() if c else 0) << 24
    n = 0
    while True:
        yield base + n
        n += 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sent(carried: str, text: str = "text") -> str:
    """Under which name a carried column is sent to Python: the text goes there once, as what is worked on."""
    return "__text" if carried == text else f"kept_{carried}"


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part that a hash falls into when the range of hashes is cut into equal parts: rising with the hash."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length or several as bytes: counts, then the items, each array split in planes of equal bytes.

    Bytes of like weight stand together, which lets the codec of the shuffle shrink sorted or small values.
    """
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        k = a.dtype.itemsize
        out.append(np.array([len(a), k], "<u4").tobytes())
        out.append(np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"), copy=False)).view(np.uint8).reshape(-1, k).T.tobytes() if len(a) else b"")
    return b"".join(out)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    at, out = 4, []
    for kind in kinds:
        n, k = (int(x) for x in np.frombuffer(data, "<u4", 2, at))
        at += 8
        planes = np.frombuffer(data, np.uint8, n * k, at).reshape(k, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1) if n else np.zeros(0, kind))
        at += n * k
    return out


def pack_sorted(h: np.ndarray) -> bytes:
    """Rising 64-bit values as their differences, in as few bytes each as the largest takes."""
    if not len(h):
        return b""
    d = np.diff(h, prepend=U64(0))
    first, d = d[:1], d[1:]
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    planes = np.ascontiguousarray(d.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.array([len(h), width], "<u4").tobytes() + first.astype("<u8").tobytes() + planes.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    n, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
    first = np.frombuffer(data, "<u8", 1, 8)
    full = np.zeros((n - 1, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8, (n - 1) * width, 16).reshape(width, n - 1).T
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([first, full.view("<u8").reshape(-1)]).astype(U64), dtype=U64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.append(start, len(keys)))


# ---------------------------------------------------------------- character n-grams


def char_grams(words: pa.Array, sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of ``<word>`` and, if wanted, the word itself.

    Returns (bucket, word): bucket ids below ``buckets`` (a power of two) and the place of the word each belongs to,
    in no particular order.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = b"<" + b"><".join(words.cast(pa.large_binary()).to_pylist()) + b">"
    lens = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    raw = np.frombuffer(joined, np.uint8).astype(U64)
    owner = np.repeat(np.arange(n), lens)
    ids, of = [], []
    mask = U64(buckets - 1)
    with np.errstate(over="ignore"):
        h = raw + U64(1)
        for k in range(2, max(sizes) + 1):
            if len(raw) < k:
                break
            h = h[:-1] * U64(0x100000001B3) + raw[k - 1 :] + U64(1)
            if k in sizes:
                inside = owner[: len(raw) - k + 1] == owner[k - 1 :]
                ids.append((mix(h[inside] + U64(k)) & mask).astype(np.int64))
                of.append(owner[: len(raw) - k + 1][inside])
        if whole:
            ids.append((mix(hash_words(words, 7)) & mask).astype(np.int64))
            of.append(np.arange(n))
    return np.concatenate(ids), np.concatenate(of)
