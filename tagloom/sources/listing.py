"""Recursive image listing, content hashes and the cache of decoded inputs."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.scalar import IMAGE_SUFFIXES
from tagloom.operators.components import materialised

SCHEMA = "path string, size bigint, mtime double"


def suffixes(given: Iterable[str] | None) -> tuple[str, ...]:
    """Suffixes in lower case with their dot."""
    return IMAGE_SUFFIXES if given is None else tuple(sorted({("" if s.startswith(".") else ".") + s.lower() for s in given if s}))


def resolved(path: str) -> str:
    return os.path.realpath(os.path.expanduser(path))


def inside(path: str, folders: Sequence[str]) -> bool:
    return any(path == f or path.startswith(f.rstrip("/") + "/") for f in folders)


def entries(folder: str, excluded: Sequence[str], kinds: tuple[str, ...]) -> tuple[list[str], list[tuple[str, int, float]]]:
    """(folders below one folder that are entered, its image files as path, size, mtime): nothing whose name starts with a
    dot, nothing excluded, no links to folders. A folder or file that goes or can't be read meanwhile is left out."""
    subs: list[str] = []
    files: list[tuple[str, int, float]] = []
    try:
        with os.scandir(folder) as it:
            for e in it:
                if e.name.startswith(".") or inside(e.path, excluded):
                    continue
                try:
                    if e.is_dir(follow_symlinks=False):
                        subs.append(e.path)
                    elif e.name.lower().endswith(kinds) and e.is_file():
                        st = e.stat()
                        files.append((e.path, st.st_size, st.st_mtime))
                except OSError:
                    continue
    except OSError:
        return [], []
    return sorted(subs), sorted(files)


def walk(root: str, excluded: Sequence[str], kinds: tuple[str, ...]) -> Iterator[str]:
    """Image files below a folder, one folder after the other."""
    left = [root]
    while left:
        subs, files = entries(left.pop(), excluded, kinds)
        yield from (f[0] for f in files)
        left += reversed(subs)


def images(spark: SparkSession, roots: Sequence[str], *, excluded: Sequence[str] = (), extensions: Iterable[str] | None = None, tasks: int = 200, levels: int = 1000) -> DataFrame:
    """path, size, mtime of the images below existing roots; a file below several roots comes as often.

    Level by level: the folders that were found are dealt to ``tasks`` tasks anew, each lists its own, and what they find
    is written before the next level, until no folder is left. So one deep or wide folder takes part in as many tasks as
    any, and neither the driver nor a task holds more than a share of one level. Folders must be visible to all executors.
    """
    kinds, out = suffixes(extensions), [resolved(e) for e in excluded]
    tops = [r for r in map(resolved, roots) if os.path.isdir(r) and not inside(r, out)]
    if not tops:
        return spark.createDataFrame([], SCHEMA)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        of = lambda: pd.DataFrame(rows, columns=["path", "size", "mtime", "deeper"]).astype({"path": object, "size": "Int64", "mtime": "Float64", "deeper": bool})
        for f in frames:
            for folder in f["path"]:
                subs, files = entries(folder, out, kinds)
                rows += [(p, None, None, True) for p in subs] + [(*x, False) for x in files]
                if len(rows) >= 10_000:
                    yield of()
                    rows = []
        yield of()

    found: list[DataFrame] = []
    level = spark.createDataFrame([(r,) for r in tops], "path string")
    for _ in range(levels):
        dealt = level.repartition(tasks) if found else level.repartition(min(len(tops), tasks))
        here = materialised(dealt.mapInPandas(run, f"{SCHEMA}, deeper boolean"), "listing")
        found.append(here.filter("not deeper").select("path", "size", "mtime"))
        level = here.filter("deeper").select("path")
        if level.isEmpty():
            return reduce(DataFrame.union, found)
    raise RuntimeError("folders are nested too deep")


def remote_images(spark: SparkSession, root: str, extensions: Iterable[str] | None = None) -> DataFrame:
    """path, size, mtime, content below a folder of any store that Spark reads (names that start with ``_`` are not seen there)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.filter(F.lower("path").rlike("(" + "|".join("\\" + s for s in suffixes(extensions)) + ")$")).select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"), "content")


def contents(listing: DataFrame) -> DataFrame:
    """file_id (if listed), path, content and sha256 of listed files; null where a file can't be read."""
    keep = [c for c in ("file_id",) if c in listing.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 16):
                part = f.iloc[i : i + 16]
                data = []
                for p in part["path"]:
                    try:
                        with open(p, "rb") as h:
                            data.append(h.read())
                    except OSError:
                        data.append(None)
                yield part[[*keep, "path"]].assign(content=data, sha256=[None if d is None else hashlib.sha256(d).hexdigest() for d in data])

    return listing.select(*keep, "path").mapInPandas(run, ", ".join([*(f"{c} bigint" for c in keep), "path string, content binary, sha256 string"]))


def batch_order(listing: DataFrame) -> DataFrame:
    """Files for inference: by folder, then size, range-partitioned so that a batch holds images of like size."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return listing.withColumn("__d", folder).repartitionByRange("__d", "size").sortWithinPartitions("__d", "size").drop("__d")


def cache_key(listing: DataFrame, side: int, version: int = 1) -> DataFrame:
    """listing with the key under which its decoded input is cached: path, size, time, side and version."""
    return listing.withColumn("key", F.sha2(F.concat_ws("|", "path", "size", F.col("mtime").cast("decimal(20,6)"), F.lit(side), F.lit(version)), 256))


def uncached(listing: DataFrame, cache: DataFrame, side: int, version: int = 1) -> DataFrame:
    return cache_key(listing, side, version).join(cache.select("key"), "key", "left_anti")


def load_metrics(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of loaded files (path, route, seconds): count and seconds by route and by suffix, and the 20 slowest."""
    from tagloom.functions.scalar import suffix

    by = lambda c: rows.groupBy(c).agg(F.count("*").alias("count"), F.sum("seconds").alias("seconds"))
    return by("route"), rows.withColumn("suffix", suffix(F.col("path"))).groupBy("suffix").agg(F.count("*").alias("count"), F.sum("seconds").alias("seconds")), rows.orderBy(F.desc("seconds"), "path").limit(20)
