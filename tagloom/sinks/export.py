"""Exports: statistics and clusters as CSV, matching files into a folder, measurements as JSON."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import scalar
from tagloom.operators.ordering import running

# Headers of the exports.
STATS_HEADERS = ("Category", "Tag", "Files", "AvgScore", "MaxScore")
CLUSTER_HEADERS = ("group", "file_id", "path", "size", "width", "height", "keeper", "hamming")


def stats_rows(stats: DataFrame) -> DataFrame:
    """Statistics as they are exported: category names, scores with three decimals."""
    values = (scalar.category_label(F.col("category")), F.col("name"), F.col("files"), scalar.score_text(F.col("avg_score")), scalar.score_text(F.col("max_score")))
    return stats.select(*(v.alias(h) for v, h in zip(values, STATS_HEADERS, strict=True)))


def cluster_rows(clustered: DataFrame) -> DataFrame:
    """Clusters as they are exported, in order; the distance is null where there is none."""
    values = ("group", "id", "path", "size", "width", "height", "is_keeper", "best_hamming")
    return clustered.orderBy("group", "position").select(*(F.col(v).alias(h) for v, h in zip(values, CLUSTER_HEADERS, strict=True)))


def write_csv(rows: DataFrame, path: str) -> str:
    """One CSV file with a byte-order mark, streamed through the driver partition by partition; forces the suffix."""
    import csv

    path = path if path.lower().endswith(".csv") else os.path.splitext(path)[0] + ".csv"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    return path


def write_csv_folder(rows: DataFrame, path: str) -> None:
    """The same rows as a folder of CSV parts, written by the executors."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def destinations(files: DataFrame, folder: str) -> DataFrame:
    """id, path, target: the file's name in the folder; later files of the same name get _2, _3, ... before the suffix."""
    name = scalar.base_name(F.col("path"))
    files = running(files.select("id", "path", name.alias("__name")), [F.col("path").asc(), F.col("id").asc()], {"__n": F.lit(1)}, ["__name"])
    name, n = F.col("__name"), F.col("__n")
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return files.select("id", "path", F.concat(F.lit(folder.rstrip("/") + "/"), F.when(n == 1, name).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))).alias("target"))


def copy_files(targets: DataFrame) -> DataFrame:
    """Copies path to target on the executors; id, target and error (null if copied)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors = []
            for a, b in zip(f["path"], f["target"], strict=True):
                try:
                    os.makedirs(os.path.dirname(b), exist_ok=True)
                    shutil.copy2(a, b)
                    errors.append(None)
                except OSError as e:
                    errors.append(f"{type(e).__name__}: {e.strerror}")
            yield pd.DataFrame({"id": f["id"], "target": f["target"], "error": errors})

    return targets.mapInPandas(run, "id bigint, target string, error string")


def write_json(value: object, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
