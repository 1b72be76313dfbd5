"""All pairs of vectors of at least some cosine, whole and exact.

Vectors go to the cell of their nearest pivot, a cell knows the greatest angle of its members, and two cells whose angle is
too wide for any pair of members never meet. Rows of a cell are dealt to blocks of bounded size, and each two blocks that
may hold a pair meet in one task, as two matrices. On vectors that cluster most blocks never meet; on vectors without any
structure all do, as no exact method can spare them, and the work is blocked products of all rows, from which only the pairs
above the limit come out.

Defined results: vectors that are null, empty, of length zero or hold a null or non-finite component are in no pair; vectors
of different lengths are in none together; equal vectors and repeated ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.components import materialised

#: Pivots of each length of vectors, a sample of this size that goes to the driver; rows of a block.
PIVOTS, BLOCK = 64, 16_384
#: Products of matrices differ from sums in order by less than this; closer ones are summed anew.
NEAR = 1e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    a = np.array(vectors.tolist(), np.float64)
    return a / np.sqrt((a * a).sum(1))[:, None]


def usable(vectors: DataFrame) -> DataFrame:
    """id, embedding (array<double>) and dim of the vectors that can be in a pair."""
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).filter("size(embedding) > 0")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return rows.filter(~bad & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def _cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with cell, the number of their nearest pivot, and angle, that to the pivot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                near = np.clip(_unit(g["embedding"]) @ pivots[dim].T, -1, 1)
                cell = near.argmax(1)
                yield g.assign(cell=cell.astype("int32"), angle=np.arccos(near[np.arange(len(g)), cell]))

    return rows.mapInPandas(run, "id bigint, embedding array<double>, dim int, cell int, angle double")


def plan(stats: list[tuple[int, int, int, float]], pivots: dict[int, np.ndarray], least: float, block: int) -> tuple[dict[tuple[int, int], int], list[tuple[int, int, list[tuple[int, int]]]]]:
    """(blocks of each (dim, cell), for each cell the cells that it must meet: (dim, cell, [(cell, blocks), ...])).

    stats: dim, cell, rows, widest angle. A pair's angle is at least that of the pivots less both cells' widest ones.
    """
    blocks = {(d, c): max(1, -(-n // block)) for d, c, n, _ in stats}
    most = math.acos(max(-1.0, min(1.0, least))) + 1e-7
    meets = []
    for d, c, _, wide in stats:
        angle = np.arccos(np.clip(pivots[d] @ pivots[d][c], -1, 1))
        meets.append((d, c, [(o, blocks[d, o]) for e, o, _, other in stats if e == d and o >= c and angle[o] - wide - other <= most]))
    return blocks, meets


def similar(vectors: DataFrame, least: float, *, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), cosine of all pairs of ``vectors`` (id, embedding) whose cosine is ``least`` or more."""
    spark = vectors.sparkSession
    rows = materialised(usable(vectors), "vectors")
    empty = spark.createDataFrame([], "a bigint, b bigint, cosine double")
    dims = [r.dim for r in rows.select("dim").distinct().collect()]  # lengths of vectors, of which a model has one
    if not dims:
        return empty
    sample = {d: _unit(rows.filter(F.col("dim") == d).orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()["embedding"]) for d in dims}
    placed = materialised(_cells(rows, sample), "cells")
    stats = [tuple(r) for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)), F.max("angle")).collect()]
    blocks, meets = plan(stats, sample, least, block)
    of = spark.createDataFrame([(d, c, n) for (d, c), n in blocks.items()], "dim int, cell int, blocks int")
    # A block meets the later ones of its own cell and all of the cells that may hold a partner; both sides go to the pair.
    pairs = [(d, c, o, m) for d, c, others in meets for o, m in others]
    here = F.broadcast(spark.createDataFrame(pairs, "dim int, cell int, other int, others int"))
    there = F.broadcast(spark.createDataFrame([(d, o, c) for d, c, o, _ in pairs], "dim int, cell int, first int"))
    dealt = placed.join(F.broadcast(of), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("angle")
    left = dealt.join(here, ["dim", "cell"]).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).filter("other > cell or to >= block")
    left = left.select("dim", F.col("cell").alias("c1"), F.col("block").alias("b1"), F.col("other").alias("c2"), F.col("to").alias("b2"), F.lit(True).alias("left"), "id", "embedding")
    first = F.broadcast(of.select("dim", F.col("cell").alias("first"), F.col("blocks").alias("firsts")))
    right = dealt.join(there, ["dim", "cell"]).join(first, ["dim", "first"]).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("firsts") - 1))).filter("first < cell or of < block")
    right = right.select("dim", F.col("first").alias("c1"), F.col("of").alias("b1"), F.col("cell").alias("c2"), F.col("block").alias("b2"), F.lit(False).alias("left"), "id", "embedding")

    def product(f: pd.DataFrame) -> pd.DataFrame:
        one, two = f[f["left"]], f[~f["left"]]
        itself = bool(f["c1"].iloc[0] == f["c2"].iloc[0] and f["b1"].iloc[0] == f["b2"].iloc[0])
        two = one if itself else two
        out: list[pd.DataFrame] = []
        if len(one) and len(two):
            x, y = _unit(one["embedding"]), _unit(two["embedding"])
            ids, others = one["id"].to_numpy(), two["id"].to_numpy()
            for k in range(0, len(x), 1024):
                near = x[k : k + 1024] @ y.T
                i, j = np.nonzero(near >= least - NEAR)
                i = i + k
                if itself:
                    i, j = i[i < j], j[i < j]
                value = near[i - k, j]
                for m in np.flatnonzero(np.abs(value - least) < NEAR):
                    value[m] = _cosine(one["embedding"].iloc[i[m]], two["embedding"].iloc[j[m]])
                good = (value >= least) & (ids[i] != others[j])
                i, j, value = i[good], j[good], value[good]
                out.append(pd.DataFrame({"a": np.minimum(ids[i], others[j]), "b": np.maximum(ids[i], others[j]), "cosine": value}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "cosine": np.zeros(0)})

    return left.unionByName(right).groupBy("dim", "c1", "b1", "c2", "b2").applyInPandas(product, "a bigint, b bigint, cosine double")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    dot = aa = bb = 0.0
    for x, y in zip(a, b, strict=True):
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / (math.sqrt(aa) * math.sqrt(bb))
