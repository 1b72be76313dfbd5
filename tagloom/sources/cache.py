"""Caches of what is made from files: Parquet folders by a key of the file's path, size and time and of the form made.

Another size, time, form or version gives another key, so nothing stale is read; a writer that stops midway leaves nothing
that readers see, and rows that two writers made at once are equal, of which one is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import images
from tagloom.sources import listing


def _exists(rows: DataFrame, folder: str) -> bool:
    sc = rows.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)


def through(folder: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """rows (with ``key``) and ``value``: from the cache where it holds the key, else made, added and read back.

    make: rows to (key, value). What can't be made has a null value and is tried again the next time.
    """
    spark = rows.sparkSession
    new = rows.join(spark.read.parquet(folder).select("key"), "key", "left_anti") if _exists(rows, folder) else rows
    make(new.dropDuplicates(["key"])).filter(F.col(value).isNotNull()).select("key", value).write.mode("append").parquet(folder)
    held = spark.read.parquet(folder).join(rows.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return rows.join(held, "key", "left")


def _made(rows: DataFrame, value: str, form: Callable[[bytes], bytes | None]) -> DataFrame:
    """(key, value) of rows (key, path), files read and formed a few at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 16):
                part = f.iloc[i : i + 16]
                out = []
                for p in part["path"]:
                    try:
                        with open(p, "rb") as h:
                            out.append(form(h.read()))
                    except OSError:
                        out.append(None)
                yield pd.DataFrame({"key": part["key"].to_numpy(), value: out})

    return rows.select("key", "path").mapInPandas(run, f"key string, {value} binary")


def inputs(found: DataFrame, folder: str, prepare: Callable[[Sequence[object]], list], side: int, version: int = 1) -> DataFrame:
    """Listed files (path, size, mtime) with a model's input as the bytes of 32-bit floats; null where one is unreadable.

    prepare: a tagger's; ``version`` must change with it.
    """

    def form(data: bytes) -> bytes | None:
        got = prepare([data])[0]
        return None if got is None else np.ascontiguousarray(got, "<f4").tobytes()

    return through(folder, listing.cache_key(found, side, version), lambda rows: _made(rows, "input", form), "input")


def thumbnails(found: DataFrame, folder: str, side: int = 256) -> DataFrame:
    """Listed files (path, size, mtime) with a PNG no side of which exceeds ``side``; null where one is unreadable."""

    def form(data: bytes) -> bytes | None:
        got = images.decode(data, max_side=side)
        return None if got is None else images.encode_png(got)

    return through(folder, found.withColumn("key", images.thumbnail_key_column(side)), lambda rows: _made(rows, "png", form), "png")
