"""Score thresholds by category: normalising names, merging defaults, and the Column that applies them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.plans.query import CATEGORY_IDS, CHARACTER, COPYRIGHT, GENERAL

# The default thresholds; -1 stands for every other category.
DEFAULTS = {GENERAL: 0.35, CHARACTER: 0.25, COPYRIGHT: 0.25}
REST = -1


def category_id(value: object) -> int | None:
    """A category from a number, a bool, a name or numeric text; None if it is none of these."""
    if value is None:
        return None
    if isinstance(value, bool | int | float):
        return int(value) if not isinstance(value, float) or math.isfinite(value) else None
    text = str(value).strip().lower()
    if text in CATEGORY_IDS:
        return CATEGORY_IDS[text]
    try:
        return int(float(text))
    except (ValueError, OverflowError):
        return None


def category_id_column(c: Column) -> Column:
    """``category_id`` over text: a name, or a number that is cut to an integer."""
    text = F.lower(F.trim(c.cast("string")))
    named = F.create_map(*(F.lit(x) for k, v in CATEGORY_IDS.items() for x in (k, v)))
    return F.coalesce(F.element_at(named, text), text.try_cast("double").cast("int"))


def _numbers(pairs: Iterable[tuple[object, object]], key) -> dict[int, float]:
    out = {}
    for k, v in pairs:
        try:
            name = key(k)
            if name is not None:
                out[name] = float(v)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            continue
    return out


def for_query(given: Mapping | None) -> dict[int, float] | None:
    """For predicates: None means no test; otherwise the defaults with the given values over them, bad ones skipped."""
    return None if given is None else {**DEFAULTS, REST: 0.0, **_numbers(given.items(), int)}


def for_relevance(given: Mapping | None) -> dict[int, float]:
    return {**DEFAULTS, **_numbers((given or {}).items(), category_id)}


def for_stats(rows: Iterable[tuple[object, object]] = ()) -> dict[int, float]:
    """0 for the six categories, the defaults, and stored rows with integer keys; text keys are skipped."""
    return {**dict.fromkeys(range(6), 0.0), **DEFAULTS, **_numbers(rows, int)}


def stored(rows: Iterable[tuple[object, object]]) -> dict[int, float]:
    """Stored thresholds with names normalised; defaults for what is missing."""
    return {**DEFAULTS, **_numbers(rows, category_id)}


def load(table: DataFrame) -> dict[int, float]:
    """``stored`` of the relation (category, threshold), which has a row a category."""
    return stored((r[0], r[1]) for r in table.select("category", "threshold").collect())


def by_category(category: Column, thresholds: Mapping[int, float], named: Iterable[int] = (GENERAL, CHARACTER, COPYRIGHT)) -> Column:
    """The threshold of a row's category; the value of REST (or 0) for null and for categories beyond ``named``."""
    out = None
    for k in named:
        v = F.lit(float(thresholds.get(k, 0.0)))
        out = F.when(category == k, v) if out is None else out.when(category == k, v)
    rest = F.lit(float(thresholds.get(REST, 0.0)))
    return rest if out is None else out.otherwise(rest)
