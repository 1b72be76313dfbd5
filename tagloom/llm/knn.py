"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors count as integers, floor(scale * x), the shorter of two as if zeros followed. Pivots are rows drawn by hash,
about the square root of the rows and ``most_pivots`` at most; queries and data are grouped by their nearest pivot, and
a pivot's data are cut into bands of distance. One pass sums up each cell (pivot, band): its count, the largest distance
to the pivot, norm and angle, and the k + 1 least distances. For x of the cell of pivot p bounds follow:

    <q, p> - |q| d  <=  <q, x>  <=  min(<q, p> + |q| d, |q| |x| cos(angle(q, p) - angle(x, p))).

The lower bounds of the listed distances, over all cells, give a score that a query's k-th result cannot fall below (one
more is asked for, as the query itself may be listed). A cell whose upper bound is below that for every query of a
block isn't sent there. What is sent is solved locally: blocks of queries against runs of data by matrix products with a
top k for each query; partial results are merged by rank. Results are exact whatever the pivots are.

Queries are cut into blocks by their pivots, data into runs of ``rows`` at most by a hash of their row, so neither a hot
pivot nor equal vectors land in one task; a task holds a block and a run. The vectors are written once to the shared
folder, each row with a number of its own, by which a query's own row is left out.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0 with
all; components of any size count exactly, and a result whose score a long cannot hold raises; ties go to the smaller
id, null ids last; each row that ``queries`` picks is a query of its own, also where ids repeat, and every other row a
candidate; fewer candidates than k give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Blocks of queries at most, so that (block, cell) pairs are at most this times the cells.
MOST_BLOCKS = 1024
#: Bands of distance around a pivot.
BANDS = 8
#: Norms beyond this have no place among the pivots' distances: such rows make a cell that no bound rules out.
WILD = 1e100
SUMMARY = "cell int, n bigint, radius double, norm double, angle double, near array<double>"
_SUMMARY = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("norm", pa.float64()), ("angle", pa.float64()), ("near", pa.list_(pa.float64()))])


def valid(df: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """rid, vec_id, e and ask (whether the row is a query) of the rows that take part."""
    kind = df.schema[embedding].dataType.elementType
    e = df[embedding] if isinstance(kind, T.FloatType | T.DoubleType) else df[embedding].cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    got = df.filter(df[embedding].isNotNull() & F.coalesce(fine, F.lit(False)))
    return got.select(F.monotonically_increasing_id().alias("rid"), df[vec_id].cast("bigint").alias("vec_id"), e.alias("e"), F.coalesce(queries, F.lit(False)).alias("ask"))


def by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) of the rows of each length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(off)
    for k in np.unique(n).tolist():
        at = np.flatnonzero(n == k)
        yield at, flat[off[at][:, None] + np.arange(k)[None, :]]


def exact(row: np.ndarray, scale: int) -> list[int]:
    return [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in row.tolist()]


def products(q: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of rows of raw vectors as integers: in doubles or 64-bit integers where they are exact, else in Python's."""
    m = min(q.shape[1], x.shape[1])
    q, x = q[:, :m], x[:, :m]
    with np.errstate(over="ignore", invalid="ignore"):
        iq, ix = np.floor(q * scale), np.floor(x * scale)
        nq, nx = np.linalg.norm(iq, axis=1), np.linalg.norm(ix, axis=1)
    top = nq.max(initial=0) * nx.max(initial=0)
    if top < 2.0**52:
        return np.rint(iq @ ix.T).astype(np.int64)
    if top < 2.0**62 and max(nq.max(), nx.max()) < 2.0**62:
        return iq.astype(np.int64) @ ix.astype(np.int64).T
    low = np.flatnonzero(nx * nq.max() < 2.0**52)
    out = np.zeros((len(q), len(x)), object)
    if len(low):
        out[:, low] = np.rint(iq @ ix[low].T).astype(np.int64)
    high = np.setdiff1d(np.arange(len(x)), low)
    out[:, high] = np.array([exact(r, scale) for r in q], object).reshape(len(q), m) @ np.array([exact(r, scale) for r in x[high]], object).reshape(len(high), m).T
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def fitting(scores: np.ndarray) -> np.ndarray:
    """Scores of results as 64-bit integers."""
    if scores.dtype == object and any(abs(v) >= 2**63 for v in scores):
        raise OverflowError("a score does not fit in 64 bits")
    return scores.astype(np.int64)


class Pivots:
    """Integer pivots of any lengths, padded with zeros; ``scale``: of the vectors; ``unit``: of the bands' distances."""

    def __init__(self, rows: list[list[float]], scale: int):
        self.scale = scale
        with np.errstate(over="ignore"):
            rows = [r for r in (np.floor(np.asarray(r, np.float64) * scale) for r in rows) if np.linalg.norm(r) < WILD]
        wide = max((len(r) for r in rows), default=0)
        self.at = np.unique(np.array([np.pad(r, (0, wide - len(r))) for r in rows]).reshape(len(rows), wide), axis=0) if rows else np.zeros((1, 0))
        self.norm = np.linalg.norm(self.at, axis=1)
        gaps = np.linalg.norm(self.at - self.at.mean(0), axis=1)
        self.unit = max(1.0, float(np.median(gaps)))

    def measure(self, v: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inner products with the pivots, norms, nearest pivot, distance to it, angle to it) of integer vectors of one length."""
        p, pn = self.at[:first, : v.shape[1]], self.norm[:first]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            n = np.linalg.norm(v, axis=1)
            calm = n < WILD
            dot = np.where(calm[:, None], v, 0)[:, : p.shape[1]] @ p.T
            d = pn[None, :] ** 2 - 2 * dot
            g = d.argmin(1)
            near = np.sqrt(np.maximum(0, n**2 + d[np.arange(len(v)), g])) + 1e-6 * (n + pn[g])
            cos = dot[np.arange(len(v)), g] / (n * pn[g])
            angle = np.where((n > 0) & (pn[g] > 0), np.arccos(np.clip(cos, -1, 1)) + 1e-5, math.pi)
        return dot, n, g, np.where(calm, near, np.inf), angle

    def cells(self, g: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Numbers of cells; rows beyond all measure share the last one."""
        with np.errstate(divide="ignore", invalid="ignore"):
            band = np.clip(np.floor(4 * np.log2(np.maximum(d, 1e-9) / self.unit)) + BANDS - 2, 0, BANDS - 1)
        return np.where(np.isfinite(d), g * BANDS + np.where(np.isfinite(band), band, 0), len(self.at) * BANDS).astype(np.int64)


def _whole(e: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(e * scale)


def placed(vectors: DataFrame, sent, first: int | None = None) -> DataFrame:
    """vectors with ``cell`` (or, of the ``first`` pivots, with ``grp``)."""
    name = "cell" if first is None else "grp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            out = np.zeros(b.num_rows, np.int32)
            for at, e in by_length(common.column(b, "e")):
                _, _, g, d, _ = p.measure(_whole(e, p.scale), first)
                out[at] = p.cells(g, d) if first is None else g
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField(name, T.IntegerType())]))


def summaries(vectors: DataFrame, sent, k: int) -> DataFrame:
    """A row each cell: SUMMARY. A task sends one row a cell, and as many meet in a group as there are tasks."""

    def join(rows: list[tuple]) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for cell, n, radius, norm, angle, near in rows:
            x = by.setdefault(cell, [0, 0.0, 0.0, 0.0, []])
            by[cell] = [x[0] + n, max(x[1], radius), max(x[2], norm), max(x[3], angle), sorted([*x[4], *near])[: k + 1]]
        return pa.RecordBatch.from_pylist([{"cell": c, "n": x[0], "radius": x[1], "norm": x[2], "angle": x[3], "near": x[4]} for c, x in by.items()], _SUMMARY)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, rows = sent.value, []
        for b in batches:
            for _, e in by_length(common.column(b, "e")):
                _, n, g, d, angle = p.measure(_whole(e, p.scale))
                cell = p.cells(g, d)
                by = np.lexsort((d, cell))
                start, length = common.runs(cell[by])
                for a, m in zip(start.tolist(), length.tolist(), strict=True):
                    at = by[a : a + m]
                    rows.append((int(cell[at[0]]), m, float(d[at].max()), float(n[at].max()), float(angle[at].max()), d[at[: k + 1]].tolist()))
            if len(rows) > 20_000:
                rows = [tuple(r.values()) for r in join(rows).to_pylist()]
        yield join(rows)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield join([tuple(r.values()) for b in batches for r in b.to_pylist()])

    return vectors.select("e").mapInArrow(some, SUMMARY).groupBy("cell").applyInArrow(merge, SUMMARY)


class Bounds:
    """What the summaries allow to rule out."""

    def __init__(self, pivots: Pivots, rows: list, k: int):
        rows = sorted(rows, key=lambda r: r["cell"])
        self.p, self.k = pivots, k
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.count = np.array([r["n"] for r in rows], np.int64)
        self.radius, self.norm, self.angle = (np.array([r[c] for r in rows], np.float64) for c in ("radius", "norm", "angle"))
        self.wild = self.cell == len(pivots.at) * BANDS
        self.of = np.minimum(self.cell // BANDS, len(pivots.at) - 1)
        near = [(i, d) for i, r in enumerate(rows) if not self.wild[i] for d in r["near"]]
        self.near_of, self.near = np.array([self.of[i] for i, _ in near], np.int64), np.array([d for _, d in near], np.float64)

    def needed(self, q: np.ndarray) -> np.ndarray:
        """[query, cell]: whether the cell may hold one of the query's k best."""
        dot, n, _, _, _ = self.p.measure(q)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            ball = dot[:, self.of] + n[:, None] * self.radius[None, :]
            turn = np.arccos(np.clip(dot / (n[:, None] * self.p.norm[None, :]), -1, 1))
            turn = np.where(np.isfinite(turn), turn, 0)[:, self.of] - self.angle[None, :]
            cone = n[:, None] * self.norm[None, :] * np.where(turn < math.pi / 2, np.cos(np.maximum(0, turn - 1e-5)), 0)
            high = np.minimum(ball, cone)
            floor = np.full(len(q), -np.inf)
            if len(self.near) > self.k:
                low = dot[:, self.near_of] - n[:, None] * self.near[None, :]
                floor = np.partition(low, low.shape[1] - self.k - 1, axis=1)[:, low.shape[1] - self.k - 1]
            slack = 1e-6 * (np.abs(floor) + n * self.norm[~self.wild].max(initial=0)) + 1
            out = high >= (floor - slack)[:, None]
        return out | self.wild[None, :] | ~np.isfinite(high) | ~(n < WILD)[:, None]


def search(df: DataFrame, queries: Column, *, k: int = 10, scale: int = 1024, pivots: int | None = None, most_pivots: int = 1024, block: int = 4096, rows: int = 1 << 16, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which ``queries`` (of vec_id) holds, its k best other rows.

    report: receives ``share``, the part of all (query, row) pairs that no bound ruled out.
    """
    spark = df.sparkSession
    common.ship(spark)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    vectors = common.written(valid(df, queries), "vectors")
    sizes = vectors.agg(F.count("*").alias("n"), F.sum(F.col("ask").cast("bigint")).alias("q")).first()
    if not sizes["q"]:
        return empty
    pivots = pivots or max(8, min(most_pivots, math.isqrt(sizes["n"])))
    p = Pivots([list(r.e) for r in vectors.orderBy(F.xxhash64(F.lit("pivot"), "rid"), "rid").select("e").limit(pivots).collect()], scale)
    sent = spark.sparkContext.broadcast(p)  # most_pivots vectors at most
    bounds = Bounds(p, summaries(vectors, sent, k).collect(), k)
    rule = spark.sparkContext.broadcast(bounds)  # BANDS * most_pivots cells at most, k + 1 distances each

    size = max(block, -(-sizes["q"] // MOST_BLOCKS))  # so that pairs of blocks and cells stay few enough to send out
    asked = placed(vectors.filter("ask").select("rid", "vec_id", "e"), sent, max(1, min(len(p.at), sizes["q"] // size)))
    held = {r.grp: r["count"] for r in asked.groupBy("grp").count().collect()}
    of = F.element_at(F.create_map(*(F.lit(x) for g, n in held.items() for x in (g, -(-n // size)))), F.col("grp"))
    asked = common.written(asked.withColumn("blk", (F.col("grp") * MOST_BLOCKS + F.pmod(F.xxhash64(F.lit("block"), "rid"), of)).cast("int")).drop("grp"), "queries")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(blk, cell) of what cannot be ruled out for some query."""
        x = rule.value
        for b in batches:
            blk, found = common.column(b, "blk").to_numpy(), set()
            for at, e in by_length(common.column(b, "e")):
                for i in range(0, len(at), 256):
                    qi, c = np.nonzero(x.needed(_whole(e[i : i + 256], scale)))
                    found.update(zip(blk[at[i : i + 256][qi]].tolist(), x.cell[c].tolist(), strict=True))
            yield pa.RecordBatch.from_pydict({"blk": [f[0] for f in found], "cell": [f[1] for f in found]}, pa.schema([("blk", pa.int32()), ("cell", pa.int32())]))

    pairs = common.written(asked.select("blk", "e").mapInArrow(needed, "blk int, cell int").distinct(), "pairs")
    if report is not None:
        cells = spark.createDataFrame([(int(c), int(n)) for c, n in zip(bounds.cell, bounds.count, strict=True)], "cell int, n bigint")
        kept = pairs.join(cells, "cell").join(asked.groupBy("blk").count(), "blk").agg(F.sum(F.col("n") * F.col("count")).alias("x")).first()["x"]
        report["share"] = kept / (sizes["n"] * sizes["q"])
    per_cell = pairs.groupBy("cell").agg(F.collect_list("blk").alias("to"))  # MOST_BLOCKS * cells numbers at most
    runs = -(-sizes["n"] // rows)
    run_of = F.pmod(F.xxhash64(F.lit("run"), "rid"), F.lit(runs)).cast("int")
    left = placed(vectors.select("rid", "vec_id", "e"), sent).join(F.broadcast(per_cell), "cell").select(F.explode("to").alias("blk"), run_of.alias("run"), F.lit(0).alias("kind"), "rid", "vec_id", "e")
    right = asked.select("blk", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(1).alias("kind"), "rid", "vec_id", "e")

    def solve(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        kind, rid, ids = t["kind"].to_numpy(), t["rid"].to_numpy(), t["vec_id"]
        null = ids.is_null().to_numpy()
        rank = np.where(null, np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
        q_at, x_at = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        if not len(q_at) or not len(x_at):
            return
        data = [(x_at[at], e) for at, e in by_length(t["e"].take(pa.array(x_at)))]
        places = np.concatenate([at for at, _ in data])
        order, by_rid = np.argsort(rid[places]), np.sort(rid[places])
        out_q, out_x, out_s = [], [], []
        for at, e in by_length(t["e"].take(pa.array(q_at))):
            for i in range(0, len(at), 64):
                mine = q_at[at[i : i + 64]]
                s = np.concatenate([products(e[i : i + 64], x, scale) for _, x in data], axis=1)
                own = np.searchsorted(by_rid, rid[mine])
                for j, one in enumerate(mine.tolist()):
                    use, score = places, s[j]
                    if own[j] < len(by_rid) and by_rid[own[j]] == rid[one]:
                        use, score = np.delete(places, order[own[j]]), np.delete(score, order[own[j]])
                    top = best(score, rank[use], k) if len(use) else np.zeros(0, np.int64)
                    out_q.append(np.full(len(top), one))
                    out_x.append(use[top])
                    out_s.append(fitting(score[top]))
        q, x, s = (np.concatenate(c).astype(np.int64) for c in (out_q, out_x, out_s))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid[q]), ids.take(pa.array(q)).combine_chunks(), ids.take(pa.array(x)).combine_chunks(), pa.array(s)], names=["rid", "query_id", "vec_id", "score"]
        )

    found = left.unionByName(right).groupBy("blk", "run").applyInArrow(solve, "rid bigint, query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
