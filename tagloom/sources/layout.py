"""How the relations of a catalog are cut into parts, so that a batch rewrites only those that it touches.

Relations that are looked up by one key are cut by its hash; those that are read by ranges (paths below a folder, terms with
a prefix) by ranges of it. A version of a catalog lists the parts of each relation: folder, rows, bytes, least and greatest
key, and of a range where it begins. Ranges lie end to end: one reaches to where the next begins, the first from the start
of all keys, so that every key has a part. A part of a range that has grown over ``most`` rows is cut when it is next
rewritten; parts of a hash keep their number.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "__part"


@dataclass(frozen=True)
class Layout:
    """kind: ``hash`` or ``range``; columns: what the key is made of, a text for ranges."""

    kind: str
    columns: tuple[str, ...]

    def key(self) -> Column:
        """The key of a row. Of several columns the first leads and numbers follow in their order."""
        first, *rest = self.columns
        if self.kind == "hash" or not rest:
            return F.col(first)
        return F.concat(F.col(first), F.lit("\u0001"), *(F.lpad(F.hex(F.col(c)), 16, "0") for c in rest))


LAYOUTS = {
    "files": Layout("range", ("path",)),
    "tags": Layout("hash", ("name",)),
    "file_tags": Layout("hash", ("file_id",)),
    "fts_files": Layout("hash", ("file_id",)),
    "signatures": Layout("hash", ("file_id",)),
    "completions": Layout("hash", ("prefix",)),
    "tag_sums": Layout("hash", ("tag_id",)),
    "postings": Layout("range", ("term", "file_id")),
}


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def range_of(key: Column, lows: Sequence[str]) -> Column:
    """The number of the range that a key falls into: of the last one that begins at or before it."""
    if len(lows) < 2:
        return F.lit(0)
    found = F.lit(0)

    def halves(a: int, b: int) -> Column:
        """Among the ranges from a to b - 1."""
        if b - a == 1:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(key < F.lit(lows[middle]), halves(a, middle)).otherwise(halves(middle, b))

    if len(lows) <= 64:
        found = halves(0, len(lows))
    else:  # one expression for each range would be too many
        starts = F.array(*(F.lit(x) for x in lows))
        found = F.size(F.filter(starts, lambda x: x <= key)) - 1
    return found.cast("int")


def part_of(layout: Layout, held: dict) -> Column:
    """The part of a row in a relation as a version lists it."""
    if layout.kind == "hash":
        return bucket(layout.key(), held["buckets"])
    return range_of(layout.key(), [p["low"] for p in held["parts"]])


def meets(held: dict, low: str, high: str) -> list[int]:
    """Ranges that hold a key from ``low`` up to, not including, ``high``."""
    return [i for i, p in enumerate(held["parts"]) if p["min"] < high and p["max"] >= low]


def below(root: str) -> tuple[str, str]:
    """The least key and the end of the paths below a folder."""
    root = root.rstrip("/")
    return root + "/", root + "0"  # the code point behind the slash


def starting(prefix: str) -> tuple[str, str]:
    """The least key and the end of the texts with a prefix."""
    return prefix, prefix + "\U0010ffff"


def dealt(rows: DataFrame, layout: Layout, held: dict | None, parts: int, most: int) -> DataFrame:
    """rows with PART, a folder's name, shuffled and sorted to be written by it.

    held: the parts that are being rewritten; null for a whole relation.
    """
    if layout.kind == "hash":
        found = rows.withColumn(PART, bucket(layout.key(), held["buckets"] if held else parts))
        return found.hint("rebalance", PART).sortWithinPartitions(PART, *layout.columns)
    if held is None:
        spread = rows.repartitionByRange(parts, *layout.columns)
        return spread.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *layout.columns)
    numbered = rows.withColumn("__range", part_of(layout, held))
    touched = sum(p["rows"] for p in held["parts"] if p.get("touched"))
    many = max(sum(bool(p.get("touched")) for p in held["parts"]), touched // most + 1)
    spread = numbered.repartitionByRange(many, "__range", *layout.columns)
    named = spread.withColumn(PART, F.concat_ws("_", F.col("__range").cast("string"), F.spark_partition_id().cast("string"))).drop("__range")
    return named.sortWithinPartitions(PART, *layout.columns)


def listed(layout: Layout, held: dict | None, made: Iterable[dict], only: Sequence[int] | None, parts: int) -> dict:
    """The parts of a relation after ``made`` (name, path, rows, bytes, min, max) took the place of those in ``only``."""
    made = list(made)
    if layout.kind == "hash":
        kept = {} if held is None or only is None else {p["bucket"]: p for p in held["parts"] if p["bucket"] not in set(only)}
        new = {int(m["name"]): {**{k: v for k, v in m.items() if k != "name"}, "bucket": int(m["name"])} for m in made}
        if only is not None and not set(new) <= set(only):
            raise ValueError("rows lie outside the parts that are rewritten")
        return {"kind": "hash", "buckets": held["buckets"] if held and only is not None else parts, "parts": [v for _, v in sorted({**kept, **new}.items())]}
    out = []
    if held is None or only is None:
        out = [{**{k: v for k, v in m.items() if k != "name"}, "low": m["min"]} for m in sorted(made, key=lambda m: m["min"])]
    else:
        by: dict[int, list[dict]] = {}
        for m in sorted(made, key=lambda m: m["min"]):
            by.setdefault(int(m["name"].split("_")[0]), []).append(m)
        if not set(by) <= set(only):
            raise ValueError("rows lie outside the parts that are rewritten")
        for i, p in enumerate(held["parts"]):
            if i not in set(only):
                out.append(p)
            for k, m in enumerate(by.get(i, [])):
                out.append({**{a: b for a, b in m.items() if a != "name"}, "low": m["min"] if k else p["low"]})
    if out:
        out[0] = {**out[0], "low": ""}
    return {"kind": "range", "parts": out}


def range_number(held: dict, key: str) -> int:
    """As ``range_of``, for one key on the driver."""
    return max(0, bisect_right([p["low"] for p in held["parts"]], key) - 1)
