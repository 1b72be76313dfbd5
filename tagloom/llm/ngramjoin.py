"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A text's set holds the distinct ``n``-word shingles of its lower-cased words; two documents link when
100 * |intersection| >= percent * |union|. The result is exact, up to equal 64-bit hashes of different shingles.

1. Incidences (hash, document) are dealt by hash, packed by the thousand. Where a hash lies in one document only, it
   cannot add to any overlap and is dropped; the rest goes back to its chunk of documents with its frequency.
2. Size-derived bound, first use: a partner holds at least ceil(percent * size / 100) of a set, so documents that
   link share one of the size - that + 1 rarest hashes of each (the prefix). Documents whose prefix holds only hashes
   of their own are done; of the others only the first by row of each class of equal sets goes on.
3. Near copies first: by ``KEYS`` minima of hashes over its prefix each document joins as many groups, cut into blocks at
   random. Of a block the overlap counts are accumulated by products of incidence slabs, size-derived bounds discard
   pairs, and only a spanning forest of the links leaves the task. Pairs are never listed.
4. What may still be missing lies between different components so far: in prefix hashes whose documents (the posting
   list) belong to several. Documents that such lists connect (a family) are one group if they fit a block, or if fewer
   pairs come of holding those outside the family's largest component against all than of the lists. Of other families,
   each distinct list is a group of its own. Size-derived bound, second use: what two documents hold before
   the first hash that they share isn't shared, so of two that hold much before it (heavy) none links there. Only the
   light ones are held against all, or only those outside the list's largest component, if they are fewer. A list of more than ``LONG`` squared such pairs is split by the second and third hash that
   partners must share (the k-th lies among the size - least overlap + k rarest, for any percent above 100 (k - 1) / k),
   and what is long still is solved by pairs of blocks, which leaves no link out.
5. Components of the forests give each class, and so each document, its component.

Tables that several steps read are written to the shared folder, so a lost executor repeats its tasks only.

Defined results: with fewer than n words the whole sequence is one shingle; null and empty texts have an empty set and
link with nothing; equal texts link; repeated rows count as documents; component_id is the smallest id of the
component (null if none has one); an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

#: Documents of one block, and bytes of its dense slabs of incidences.
BLOCK_DOCS, SLAB = 128, 4096
#: Groups that a document joins by the minima of its prefix; a list of so many documents squared is split no further.
KEYS, LONG = 2, 1024
_MULT = U64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, sorted by hash and then text."""
    codes, off, words = common.tokens(texts)
    if not len(codes):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = common.hash_words(words)[codes]
    lens = np.diff(off)
    doc = np.repeat(np.arange(len(lens)), lens)
    found, of = [], []
    with np.errstate(over="ignore"):
        if len(h) >= n:
            k = h[: len(h) - n + 1].copy()
            for j in range(1, n):
                k = common.mix(k * _MULT + h[j : len(h) - n + 1 + j])
            whole = doc[: len(h) - n + 1] == doc[n - 1 :]
            found.append(k[whole])
            of.append(doc[: len(h) - n + 1][whole])
        for m in range(1, n):  # texts of m words: the sequence as one, told apart by its length
            short = np.flatnonzero(lens == m)
            if len(short):
                k = h[off[short]] + U64(m)
                for j in range(1, m):
                    k = common.mix(k * _MULT + h[off[short] + j])
                found.append(common.mix(k + U64(m)))
                of.append(short)
    h, doc = np.concatenate(found), np.concatenate(of)
    order = np.argsort(doc, kind="stable") if len(found) > 1 else slice(None)
    h, doc = h[order], doc[order]
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return h[keep], doc[keep]


def _signatures(h: np.ndarray, doc: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and two sums over each that stand for its content."""
    n = np.bincount(doc, minlength=count).astype(np.int64)
    order = np.argsort(doc.astype(np.uint16), kind="stable")
    x = h[order]
    start = (np.cumsum(n) - n)[n > 0]
    a, b = np.zeros(count, np.int64), np.zeros(count, np.int64)
    if len(x):
        with np.errstate(over="ignore"):
            a[n > 0] = np.add.reduceat(x, start).view(np.int64)
            b[n > 0] = np.add.reduceat(common.mix(x + U64(1)), start).view(np.int64)
    return n, a, b


def incidences(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """Rows (part, chunk, kind, data): kind 0, a part's incidences of a chunk; kind 1, the chunk's documents."""
    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in zip(common.chunk_ids(), common.chunks(batches, "__text"), strict=False):
            h, doc = shingles(common.column(b, "__text"), n)
            size, a, c = _signatures(h, doc, b.num_rows)
            ids = common.column(b, "doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            head = common.pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, size, a, c)
            part = common.part_of(h, parts)
            cut = np.searchsorted(part, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            data = []
            for p in full:
                i, j = cut[p], cut[p + 1]
                packed = common.pack_sorted(h[i:j])
                data.append(np.array([len(packed)], "<u4").tobytes() + packed + common.pack(doc[i:j].astype(np.uint16)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*full, chunk % parts], pa.int32()), pa.array([chunk] * (len(full) + 1), pa.int64()), pa.array([0] * len(full) + [1], pa.int32()), pa.array([*data, head], pa.binary())], names=["part", "chunk", "kind", "data"]
            )

    return frame.mapInArrow(run, "part int, chunk bigint, kind int, data binary")


def shared_only(rows: DataFrame) -> DataFrame:
    """Rows (chunk, kind, data): of each part what lies in several documents, back to its chunk with its frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: list, kind: int, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([kind] * len(chunk), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "kind", "data"])

        hs, docs, where = [], [], []
        for b in batches:
            for chunk, kind, data in zip(common.column(b, "chunk").to_pylist(), common.column(b, "kind").to_pylist(), common.column(b, "data").to_pylist(), strict=True):
                if kind:
                    yield out([chunk], 1, [data])
                    continue
                k = int(np.frombuffer(data, "<u4", 1)[0])
                hs.append(common.unpack_sorted(data[4 : 4 + k]))
                docs.append(common.unpack(data[4 + k :], "<u2")[0])
                where.append(chunk)
        if not hs:
            return
        order = np.argsort(np.array(where), kind="stable")  # chunks in order, whatever order they arrived in
        names = np.array(where)[order]
        h = np.concatenate([hs[i] for i in order])
        src = np.repeat(np.arange(len(order), dtype=np.int32), [len(hs[i]) for i in order])
        doc = np.concatenate([docs[i] for i in order])
        del hs, docs
        by = np.argsort(h, kind="stable")
        h, src, doc = h[by], src[by], doc[by]
        _, length = common.runs(h)
        df = np.repeat(np.minimum(length, 2**32 - 1).astype(np.uint32), length)
        keep = df > 1
        h, src, doc, df = h[keep], src[keep], doc[keep], df[keep]
        del by, keep, length
        by = np.argsort(src, kind="stable")
        h, src, doc, df = h[by], src[by], doc[by], df[by]
        start, length = common.runs(src)
        for i in range(0, len(start), 64):
            some = [(s, s + m) for s, m in zip(start[i : i + 64], length[i : i + 64], strict=True)]
            yield out([int(names[src[s]]) for s, _ in some], 0, [np.array([len(x := common.pack_sorted(h[s:e]))], "<u4").tobytes() + x + common.pack(doc[s:e], df[s:e]) for s, e in some])
        del h, src, doc, df
        common.trim()

    return rows.mapInArrow(run, "chunk bigint, kind int, data binary")


SETS = "rid bigint, doc_id bigint, size bigint, sig_a bigint, sig_b bigint, live boolean, shared binary, n_shared bigint, quota bigint, prefix array<bigint>"
_SETS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("live", pa.bool_()), ("shared", pa.binary()), ("n_shared", pa.int64()), ("quota", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def sets(rows: DataFrame, percent: int) -> DataFrame:
    """A row each document: its size and signature, and if it may have partners (live) its shared hashes and the rarest of them,
    of which ``quota`` are the prefix and two more serve to split long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hs, docs, dfs, chunk = None, [], [], [], 0
        for b in batches:
            for chunk, kind, data in zip(common.column(b, "chunk").to_pylist(), common.column(b, "kind").to_pylist(), common.column(b, "data").to_pylist(), strict=True):  # noqa: B007
                if kind:
                    head = common.unpack(data, "<i8", "u1", "<i8", "<i8", "<i8")
                    continue
                k = int(np.frombuffer(data, "<u4", 1)[0])
                hs.append(common.unpack_sorted(data[4 : 4 + k]))
                d, f = common.unpack(data[4 + k :], "<u2", "<u4")
                docs.append(d)
                dfs.append(f)
        ids, null, size, a, c = head
        count = len(ids)
        h, doc, df = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((hs, U64), (docs, np.uint16), (dfs, np.uint32)))
        shared = np.bincount(doc, minlength=count)
        quota = size - (-(-percent * size // 100)) + 1 - (size - shared)
        live = (quota > 0) & (size > 0)
        keep = live[doc]
        h, doc, df = h[keep], doc[keep], df[keep]
        by = np.lexsort((h, df, doc))
        h, doc = h[by], doc[by]
        start = np.searchsorted(doc, np.arange(count + 1))
        for lo in range(0, count, 2000):
            hi = min(count, lo + 2000)
            some = [(start[i], start[i + 1], int(quota[i]), bool(live[i])) for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((chunk << 16) + np.arange(lo, hi), pa.int64()), pa.array(ids[lo:hi], pa.int64(), mask=null[lo:hi].astype(bool)), pa.array(size[lo:hi], pa.int64()), pa.array(a[lo:hi], pa.int64()), pa.array(c[lo:hi], pa.int64()), pa.array(live[lo:hi]),
                    pa.array([np.sort(h[s:e]).tobytes() if x else None for s, e, _, x in some], pa.binary()), pa.array(shared[lo:hi], pa.int64()), pa.array(quota[lo:hi], pa.int64()), pa.array([h[s : min(e, s + q + 2)].view(np.int64) if x else None for s, e, q, x in some], pa.list_(pa.int64())),
                ],
                schema=_SETS,
            )

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        common.trim()

    return rows.groupBy("chunk").applyInArrow(whole, SETS)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (a, b): root is the smallest vertex of its component.

    Each round takes the least label among neighbours and jumps to the label of that label; it ends when none changes.
    """
    both = common.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    label = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(label, both.b == label.v).groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label.v == near.a).select("v", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        step = common.written(step, "labels")
        up = step.select(F.col("v").alias("u"), F.col("root").alias("up"))
        new = common.written(step.join(up, step.root == up.u, "left").select("v", F.least("root", F.coalesce("up", "root")).alias("root"), "old"), "labels")
        if new.filter("root <> old").isEmpty():
            return new.select("v", "root")
        label = new.select("v", "root")


def block_links(h: list[np.ndarray], size: np.ndarray, percent: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of documents link: overlaps accumulated over slabs of hashes that several of them hold.

    rows: the places of the documents of interest on one side; all, if not given.
    """
    n = len(h)
    rows = np.arange(n) if rows is None else rows
    flat = np.concatenate(h)
    doc = np.repeat(np.arange(n), [len(x) for x in h])
    by = np.argsort(flat)
    flat, doc = flat[by], doc[by]
    start, length = common.runs(flat)
    several = length > 1
    col = np.repeat(np.cumsum(several) - 1, length)
    keep = np.repeat(several, length)
    col, doc = col[keep], doc[keep]
    exact = np.float32 if size.max(initial=0) < 1 << 24 else np.float64
    over = np.zeros((len(rows), n), exact)
    width = int(col[-1]) + 1 if len(col) else 0
    cut = np.searchsorted(col, np.arange(0, width + SLAB, SLAB))
    for i in range(len(cut) - 1):
        slab = np.zeros((n, min(SLAB, width - i * SLAB)), exact)
        slab[doc[cut[i] : cut[i + 1]], col[cut[i] : cut[i + 1]] - i * SLAB] = 1
        over += slab[rows] @ slab.T  # whole numbers below 2^24, or 2^53: exact
    both = size[rows][:, None] + size[None, :]
    low, high = np.minimum(size[rows][:, None], size[None, :]), np.maximum(size[rows][:, None], size[None, :])
    over = over.astype(np.int64)
    link = (100 * low >= percent * high) & (100 * over >= percent * (both - over))
    link[np.arange(len(rows)), rows] = False
    return link


def forest(link: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: a spanning forest, by union and find."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, r in enumerate(rows.tolist()):
        for j in np.flatnonzero(link[i]).tolist():
            a, b = find(r), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((r, j))
    return out


def _solve(percent: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        rid, rows = t["rid"].to_numpy(), np.flatnonzero(t["side"].to_numpy() == 0)
        if len(rid) < 2 or not len(rows):
            return
        found = forest(block_links([np.frombuffer(x, U64) for x in t["shared"].to_pylist()], t["size"].to_numpy(), percent, rows), rows, len(rid))
        found = [(a, b) for a, b in found if rid[a] != rid[b]]
        if found:
            a, b = (rid[np.array(x)] for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return run


def _links(groups: DataFrame, held: DataFrame, percent: int, parts: int) -> DataFrame:
    """Forests of the groups (x, y, rid, side), those of side 0 against all: sets are joined to the rows of their documents and
    dealt by group."""
    rows = groups.join(held.select("rid", "size", "shared"), "rid").select("x", "y", "rid", "side", "size", "shared")
    # Dealt by both columns, so that a large group's blocks go to different tasks.
    got = rows.repartition(parts, "x", "y").groupBy("x", "y").applyInArrow(_solve(percent), "a bigint, b bigint")
    out = common.written(got, "forest")
    common.release(held.sparkSession)
    return out


def _blocks(groups: DataFrame, block: int) -> DataFrame:
    """Lists (k, rid, asks) of n documents, of which ``few`` ask, as groups of (x, y, rid, side): of large ones, each block of
    those that ask meets each block of all."""
    zero = F.lit(0).cast("bigint")
    small = groups.filter(F.col("n") <= block).select(F.col("k").alias("x"), F.lit(-1).cast("bigint").alias("y"), "rid", (~F.col("asks")).cast("int").alias("side"))
    large = groups.filter(F.col("n") > block).withColumn("rows", F.ceil(F.col("few") / block).cast("bigint")).withColumn("cols", F.ceil(F.col("n") / block).cast("bigint"))

    def own(name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), "k", "rid"), F.col(name))

    every = F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i")
    give = large.select("k", "rid", every, own("cols").alias("j"), F.lit(1).alias("side"))
    ask = large.filter("asks").select("k", "rid", own("rows").alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"))
    return small.unionByName(give.unionByName(ask).select(F.col("k").alias("x"), (F.col("i") * (1 << 31) + F.col("j")).alias("y"), "rid", "side"))


def _mixed(lists: DataFrame) -> DataFrame:
    """Of lists (k, rid, pos, root, heavy), those that may add links between components: lists of several components and not of
    heavy documents alone; of lists that hold the same documents, the one whose hash is the rarest: the first that any two
    of them share there. A missing link has a light document and one outside the list's main component; the fewer ask.
    """
    light = F.sum((~F.col("heavy")).cast("bigint")).alias("light")
    of = lists.groupBy("k", "root").agg(F.count("*").alias("n"), light, F.min(F.struct("rid", "pos")).alias("m"), F.sum(F.xxhash64("rid") % (1 << 40)).alias("u"), F.sum(F.xxhash64(F.lit(1), "rid") % (1 << 40)).alias("v"))
    of = of.groupBy("k").agg(F.sum("n").alias("n"), F.sum("light").alias("light"), F.max(F.struct("n", "root")).alias("main"), F.min("m").alias("m"), F.sum("u").alias("u"), F.sum("v").alias("v")).filter("main.n < n")
    one = of.groupBy("n", F.col("m.rid").alias("m"), "u", "v").agg(F.min_by(F.struct("k", "light", "main"), F.struct("m.pos", "k")).alias("one")).filter("one.light > 0")
    outer = F.col("n") - F.col("one.main.n")
    return one.select("one.k", "n", "m", F.least("one.light", outer).alias("few"), F.when(outer <= F.col("one.light"), F.col("one.main.root")).alias("main"))


def jaccard_components(docs: DataFrame, *, n: int = 4, percent: int = 85, block: int = BLOCK_DOCS, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    common.ship(spark)
    parts = common.shuffle_partitions(spark)
    docs = common.steady(docs.select("doc_id", "text"), "documents")
    every = common.written(sets(shared_only(incidences(docs, n, parts).repartitionById(parts, F.col("part"))), percent), "sets")
    common.release(spark)

    classes = common.written(every.filter("live").groupBy("size", "sig_a", "sig_b").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least")), "classes")
    # Of each class one document goes on, if one of its prefix hashes is another class's too.
    lone = every.filter("live").select("rid", "size", (F.col("size") - F.col("n_shared")).alias("own"), "quota", "prefix").join(classes.select("rid"), "rid", "left_semi")
    at = lone.select("rid", "size", "own", F.posexplode("prefix").alias("pos", "h"), "quota").filter("pos < quota").select("rid", "size", "own", "pos", "h")
    several = at.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    at = common.written(at.join(several, "h"), "prefixes")
    held = every.filter("live")
    common.release(spark)

    minima = at.groupBy("rid").agg(*(F.min(F.xxhash64(F.lit(i), "h")).alias(f"k{i}") for i in range(KEYS)))
    keys = minima.select("rid", F.explode(F.array(*(F.col(f"k{i}") for i in range(KEYS)))).alias("k"))
    near = keys.groupBy("k").agg(F.ceil(F.count("*") / block).cast("bigint").alias("blocks"), F.count("*").alias("n")).filter("n > 1")
    near = keys.join(near, "k").select(F.col("k").alias("x"), F.pmod(F.xxhash64(F.lit("near"), "rid", "k"), F.col("blocks")).alias("y"), "rid", F.lit(0).alias("side"))
    forests = _links(near, held, percent, parts)
    so_far = components(forests)

    def heavy(level: int) -> Column:
        before = F.col("own") + F.col("pos") - (level - 1)  # of a document, before the level-th shared hash, and not shared
        return (2 * percent * before > (100 - percent) * (F.col("size") - before)).alias("heavy")

    placed = at.join(so_far.select(F.col("v").alias("rid"), "root"), "rid", "left")
    placed = placed.select("rid", "size", "own", "pos", F.col("h").alias("k"), F.coalesce("root", "rid").alias("root"), heavy(1))
    lists = common.written(_mixed(placed), "lists")
    if not lists.isEmpty():
        # Those outside of the main component ask, or, where none is named, the light ones.
        asks = F.expr("coalesce(root <> main, not heavy)")
        placed = common.written(placed.join(lists, "k").withColumn("asks", asks), "placed")
        family = components(placed.filter("rid <> m").select(F.col("m").alias("a"), F.col("rid").alias("b")))
        family = family.select(F.col("v").alias("rid"), F.col("root").alias("family"))
        of = placed.select("rid", "root").distinct().join(family, "rid").join(every.select("rid", "n_shared"), "rid")
        sizes = of.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("n_shared").alias("w")).groupBy("family").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "root")).alias("main"))
        # A family is one group if it fits a block, or if its outer documents against all are fewer pairs than those of its lists.
        by_list = lists.join(family, lists.m == family.rid).groupBy("family").agg(F.sum(F.col("n") * F.col("few")).alias("pairs"))
        fits, outer = (F.col("n") <= block) & (F.col("w") <= block << 13), F.col("n") - F.col("main.n")
        sizes = sizes.join(by_list, "family").select("family", "n", outer.alias("few"), F.col("main.root").alias("main"), fits.alias("fits"), (fits | (F.col("n") * outer <= F.col("pairs"))).alias("whole"))
        family = common.written(of.drop("n_shared").join(sizes, "family"), "families")
        as_one = family.filter("whole").select(F.col("family").alias("k"), "rid", (F.col("fits") | (F.col("root") != F.col("main"))).alias("asks"), "few", F.when(F.col("fits"), 0).otherwise(F.greatest(F.col("n"), F.lit(block + 1))).alias("n"))
        rows = placed.join(family.filter("not whole").select("rid"), "rid")
        groups, level, whole = [_blocks(as_one, block)], 1, every.select("rid", "quota", "prefix")
        while True:
            level += 1
            last = level > 3 or percent * level <= 100 * (level - 1)
            short = F.col("n") * F.col("few") <= long * long
            groups.append(_blocks(rows if last else rows.filter(short), block))
            rows = rows.filter(~short)
            if last or rows.isEmpty():
                break
            # The next hash that partners share lies behind this one, among the quota + level - 1 rarest.
            after = F.expr(f"slice(prefix, pos + 2, greatest(int(quota) + {level - 1} - pos - 1, 0))")
            deeper = rows.join(whole, "rid").select("k", "rid", "size", "own", "root", "pos", F.posexplode(after).alias("step", "h"))
            deeper = deeper.select(F.xxhash64("k", "h").alias("k"), "rid", "size", "own", "root", (F.col("pos") + F.col("step") + 1).cast("int").alias("pos"))
            deeper = deeper.select("*", heavy(level))
            rows = common.written(deeper.join(_mixed(deeper), "k").withColumn("asks", asks), "deeper")
        more = groups[0]
        for g in groups[1:]:
            more = more.unionByName(g)
        forests = forests.union(_links(more, held, percent, parts))
        common.discard(placed)
    roots = components(forests)
    named = classes.join(roots.withColumnRenamed("v", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = common.written(named.join(least, "root").select("size", "sig_a", "sig_b", "component"), "named")
    return every.join(named, ["size", "sig_a", "sig_b"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
