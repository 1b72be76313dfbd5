"""Scalar functions over Columns: paths, sizes, counts, labels; and the driver-side text helpers of completion."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of categories as shown, suffixes of images.
CATEGORY_LABELS = {0: "general", 1: "artist", 2: "rating", 3: "copyright", 4: "character", 5: "meta"}
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff")


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact value, halves to even."""
    return F.regexp_replace(F.format_number(c.cast("double"), digits), ",", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none or the name starts with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?\.([^./\\]+)$", 1))


def category_label(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for k, v in CATEGORY_LABELS.items() for x in (k, v)))
    return F.coalesce(F.element_at(names, c.cast("int")), c.cast("string"))


def score_text(c: Column) -> Column:
    return fixed(c, 3)


def tag_text(tags: Column, *, scores: bool = True) -> Column:
    """``name (0.00), ...``, or names alone."""
    one = (lambda t: F.concat(t["name"], F.lit(" ("), fixed(t["score"], 2), F.lit(")"))) if scores else (lambda t: t["name"])
    return F.array_join(F.transform(tags, one), ", ")


def human_size(c: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal beyond bytes; a dash for null."""
    v, out = c.cast("double"), None
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        text = F.concat(fixed(v / F.lit(float(1024**power)), 1), F.lit(f" {unit}"))
        out = F.when(v >= 1024**power, text) if out is None else out.when(v >= 1024**power, text)
    return F.when(c.isNull(), "-").otherwise(out.otherwise(F.concat(c.cast("bigint").cast("string"), F.lit(" B"))))


def dimensions(width: Column, height: Column) -> Column:
    return F.when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), "-").otherwise(F.format_string("%d x %d", width.cast("bigint"), height.cast("bigint")))


def time_text(epoch: Column) -> Column:
    return F.when(epoch.isNull(), "-").otherwise(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"))


def compact_count(c: Column) -> Column:
    """1234 as 1.2k, millions as M, billions as B; a zero decimal goes."""
    v, out = c.cast("double"), None
    for least, unit in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
        text = F.concat(F.regexp_replace(fixed(v / least, 1), r"\.0$", ""), F.lit(unit))
        out = F.when(F.abs(v) >= least, text) if out is None else out.when(F.abs(v) >= least, text)
    return F.when(c.isNotNull(), out.otherwise(c.cast("bigint").cast("string")))


def resolution(width: Column, height: Column) -> Column:
    return F.coalesce(width * height, F.lit(0))


def string_list(c: Column) -> Column:
    """A JSON array of strings, or a JSON string, as an array of trimmed, non-blank strings; empty for anything else."""
    parsed = F.coalesce(F.from_json(c, "array<string>"), F.when(F.trim(c).rlike(r'^".*"$'), F.array(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0])))
    return F.coalesce(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def lenient_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double").cast("bigint")


def lenient_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def hidden(relative: Column) -> Column:
    """Whether some component of a relative path starts with a dot."""
    return relative.rlike(r"(^|/)\.[^/]")


def sigmoid_if_needed(scores):
    """Scores of a batch: squashed only if some lie outside [0, 1]. The decision is the batch's, as models expect."""
    import numpy as np

    s = np.asarray(scores, np.float32)
    return s if not s.size or (s.min() >= 0 and s.max() <= 1) else (1 / (1 + np.exp(-s))).astype(np.float32)


# ---------------------------------------------------------------- driver-side text


def token_at(text: str, cursor: int) -> tuple[str, int, int]:
    """The word around the cursor and its bounds, cut at white space and grouping parentheses."""
    cursor = max(0, min(cursor, len(text)))
    start = cursor
    while start and not text[start - 1].isspace():
        start -= 1
    stop = cursor
    while stop < len(text) and not text[stop].isspace():
        stop += 1
    return text[start:stop], start, stop


def completion_prefix(token: str) -> str:
    """What of a word is completed: without a leading ``-`` and group parentheses."""
    return re.sub(r"^-?\(*", "", token) if not re.match(r"^-?\(*$", token) else ""


def replaced(text: str, cursor: int, with_: str) -> tuple[str, int]:
    """Text with the word at the cursor completed, a leading ``-`` kept, and the new cursor after a blank."""
    token, start, stop = token_at(text, cursor)
    head = token[: len(token) - len(completion_prefix(token))]
    new = head + with_ + " "
    tail = text[stop:].lstrip()
    return text[:start] + new + tail, start + len(new)


def export_folder(query: str, at: dt.datetime | None = None) -> str:
    """A folder name: time, and the query with unsafe characters as ``_``, 60 characters at most."""
    at = at or dt.datetime.now()
    safe = re.sub(r"[^\w.-]+", "_", query, flags=re.UNICODE).strip("._")[:60].strip("._")
    return f"{at:%Y%m%d_%H%M%S}_{safe or 'query'}"


def signature(settings: Mapping[str, object]) -> str:
    """A digest of a tagger's name, model and thresholds that changes when any of them does."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()
