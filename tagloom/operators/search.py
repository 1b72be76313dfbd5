"""Ranked, paged, enriched search over the catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import thresholds as thr
from tagloom.plans.compile import links, matching, relevant
from tagloom.plans.query import Expr, positive_terms

# The orders that a caller may name.
ORDERS = {"f.mtime DESC": ("mtime", False), "f.mtime ASC": ("mtime", True), "f.path ASC": ("path", True), "f.path DESC": ("path", False), "f.id ASC": ("id", True), "f.id DESC": ("id", False)}
PAGE = 200


def relevance(file_tags: DataFrame, tags: DataFrame, terms: Sequence[str], thresholds: Mapping | None = None) -> DataFrame:
    """file_id and the sum of scores of links with the named tags that reach their category's threshold."""
    rows = links(file_tags, tags.filter(F.col("name").isin(list(dict.fromkeys(terms)))))
    return rows.filter(relevant(terms, thresholds)).groupBy("file_id").agg(F.sum("score").alias("rel"))


def enriched(page: DataFrame, file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """page with ``tags`` and ``top_tags``: all its tags by descending score, then name."""
    ids = page.select(F.col("id").alias("file_id"))
    few = links(file_tags.join(ids, "file_id", "left_semi"), tags)
    by_score = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name", "score", "category")))
    lists = few.groupBy("file_id").agg(F.transform(by_score, lambda t: F.struct(t["name"].alias("name"), t["score"].alias("score"), t["category"].alias("category"))).alias("tags"))
    none = F.array().cast("array<struct<name:string,score:double,category:int>>")
    out = page.join(lists, page.id == lists.file_id, "left").drop("file_id").withColumn("tags", F.coalesce(F.col("tags"), none))
    return out.withColumn("top_tags", F.col("tags"))


def order_of(order: str, order_by: str | None, ranked: bool) -> list[Column]:
    """The sort, ended by the id so that pages don't overlap."""
    if order_by:
        if order_by.strip() not in ORDERS:
            raise ValueError(f"not an order that search offers: {order_by!r}")
        name, up = ORDERS[order_by.strip()]
        first = [F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_last()]
        return first if name == "id" else [*first, F.col("id").asc()]
    return [*([F.col("relevance").desc()] if ranked else []), F.col("mtime").desc_nulls_last(), F.col("id").asc()]


def _found(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str | Expr | None, thresholds: Mapping | None, test: Column | None) -> DataFrame:
    """What a page shows of matching files before it is cut. Relevance comes from the pass over links that finds them."""
    rows = matching(files, file_tags, tags, query, thresholds, test)
    return rows.select("id", "path", "size", "mtime", "width", "height", F.col("relevance") if test is not None else F.lit(0.0).alias("relevance"))


def search(
    files: DataFrame,
    file_tags: DataFrame,
    tags: DataFrame,
    query: str | Expr | None = "",
    *,
    terms: Sequence[str] | None = None,
    predicate_thresholds: Mapping | None = None,
    relevance_thresholds: Mapping | None = None,
    order: str = "mtime",
    order_by: str | None = None,
    limit: int = PAGE,
    offset: int = 0,
    with_tags: bool = True,
) -> DataFrame:
    """A page of matching present files: id, path, size, mtime, width, height, relevance, tags, top_tags.

    Sorting takes the best limit + offset rows of each partition, and tags are fetched for the page alone. The two
    threshold maps are separate parameters: the predicate's may be None (no test), relevance always has defaults.
    """
    names = [str(t) for t in (terms if terms is not None else positive_terms(query) if isinstance(query, str) else []) if str(t)]
    ranked = bool(names) and (order or "").lower() == "relevance" and not order_by
    sort = order_of(order, order_by, ranked)
    rows = _found(files, file_tags, tags, query, predicate_thresholds, relevant(names, relevance_thresholds) if ranked else None)
    page = rows.orderBy(*sort).offset(max(0, int(offset))).limit(max(0, int(limit)))
    return enriched(page, file_tags, tags).orderBy(*sort) if with_tags else page


def pages(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str, *, chunk: int = PAGE, most: int | None = None, **how) -> Iterator[list]:
    """Page after page until one is short or ``most`` rows came."""
    at = 0
    while most is None or at < most:
        want = chunk if most is None else min(chunk, most - at)
        got = search(files, file_tags, tags, query, limit=want, offset=at, **how).collect()
        if got:
            yield got
        at += len(got)
        if len(got) < want:
            return


def after_key(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str, *, last: tuple[float | None, int] | None = None, limit: int = PAGE) -> DataFrame:
    """The page, by falling mtime and rising id, that follows ``last`` = (mtime, id): no rows are skipped over."""
    rows = matching(files, file_tags, tags, query).filter("mtime is not null")
    if last is not None:
        rows = rows.filter((F.col("mtime") < last[0]) | ((F.col("mtime") == last[0]) & (F.col("id") > last[1])))
    return rows.orderBy(F.desc("mtime"), "id").limit(limit)


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: its order, the last row's sort values with the id at the end, and the catalog's version."""

    order: str
    after: tuple
    version: int | None = None


def _cursor_keys(order_by: str | None, ranked: bool) -> list[tuple[str, Column, bool]]:
    """(name, sort value, rising) of each key. Sums of scores are compared to nine digits, as their last ones depend on the
    order in which a task adds up."""
    if order_by:
        if order_by.strip() not in ORDERS:
            raise ValueError(f"not an order that search offers: {order_by!r}")
        name, up = ORDERS[order_by.strip()]
        return [(name, F.col(name), up)] + ([] if name == "id" else [("id", F.col("id"), True)])
    return [*([("__relevance", F.round("relevance", 9), False)] if ranked else []), ("mtime", F.col("mtime"), False), ("id", F.col("id"), True)]


def _after(keys: list[tuple[str, Column, bool]], values: tuple) -> Column:
    """Rows that come later in the order: nulls stand first where values rise and last where they fall."""
    out = F.lit(False)
    same = F.lit(True)
    for (_, c, rising), v in zip(keys, values, strict=True):
        if rising:
            later = c.isNotNull() if v is None else c > F.lit(v)
        else:
            later = F.lit(False) if v is None else c.isNull() | (c < F.lit(v))
        out = out | (same & later)
        same = same & c.eqNullSafe(F.lit(v))
    return F.coalesce(out, F.lit(False))


def page(
    files: DataFrame,
    file_tags: DataFrame,
    tags: DataFrame,
    query: str = "",
    *,
    cursor: Cursor | None = None,
    version: int | None = None,
    terms: Sequence[str] | None = None,
    predicate_thresholds: Mapping | None = None,
    relevance_thresholds: Mapping | None = None,
    order: str = "mtime",
    order_by: str | None = None,
    limit: int = PAGE,
) -> tuple[list, Cursor | None]:
    """The rows of the page behind ``cursor`` and the next cursor, null if the page was short.

    Pages follow each other by their rows' places in the order, never by an offset: a later page sorts no more rows than the
    first. A cursor belongs to one order and, if versions are given, to one version of the catalog; another one is refused.
    """
    names = [str(t) for t in (terms if terms is not None else positive_terms(query)) if str(t)]
    ranked = bool(names) and (order or "").lower() == "relevance" and not order_by
    keys = _cursor_keys(order_by, ranked)
    kind = ",".join(f"{n}{'+' if up else '-'}" for n, _, up in keys)
    if cursor is not None and (cursor.order, cursor.version) != (kind, version):
        raise ValueError("the cursor is of another order or version")
    rows = _found(files, file_tags, tags, query, predicate_thresholds, relevant(names, relevance_thresholds) if ranked else None)
    if cursor is not None:
        rows = rows.filter(_after(keys, cursor.after))
    sort = [c.asc_nulls_first() if up else c.desc_nulls_last() for _, c, up in keys]
    found = rows.withColumns({f"__key{i}": c for i, (_, c, _) in enumerate(keys)}).orderBy(*sort).limit(max(0, int(limit)))
    got = enriched(found, file_tags, tags).orderBy(*sort).collect()
    last = Cursor(kind, tuple(got[-1][f"__key{i}"] for i in range(len(keys))), version) if got and len(got) == limit else None
    return got, last


def all_pages(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str = "", *, most: int | None = None, limit: int = PAGE, cancelled: Callable[[], bool] = lambda: False, **how) -> Iterator[list]:
    """Page after page by cursors, until one is short, ``most`` rows came or ``cancelled`` says so between two pages."""
    cursor, left = None, most
    while not cancelled() and (left is None or left > 0):
        want = limit if left is None else min(limit, left)
        rows, cursor = page(files, file_tags, tags, query, cursor=cursor, limit=want, **how)
        if rows:
            yield rows
        if cursor is None:
            return
        left = None if left is None else left - len(rows)


def paths(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str, thresholds: Mapping | None = None) -> DataFrame:
    """id and path of the matching files by id."""
    return matching(files, file_tags, tags, query, thresholds).select("id", "path").orderBy("id")


def by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def by_paths(files: DataFrame, file_tags: DataFrame, paths: DataFrame) -> DataFrame:
    """The stored rows of many paths (path) at once, with ``has_tags``: one join each, whatever their number."""
    tagged = file_tags.select(F.col("file_id").alias("__t")).distinct()
    rows = files.join(paths.select("path"), "path", "left_semi").join(tagged, F.col("id") == F.col("__t"), "left")
    return rows.withColumn("has_tags", F.col("__t").isNotNull()).drop("__t")


def with_stored(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str, stored: DataFrame) -> DataFrame:
    """Matching files under the thresholds of the relation (category, threshold)."""
    return matching(files, file_tags, tags, query, thr.load(stored))


def any_files(files: DataFrame) -> bool:
    return not files.limit(1).isEmpty()


def shown_tags(tags: Column, thresholds: Mapping | None = None, floor: float | None = None) -> Column:
    """Of an array of tag structs those that reach their category's threshold, or ``floor`` where one is given (0.1 when copying)."""
    limits = thr.for_relevance(thresholds)
    return F.filter(tags, lambda t: t["score"] >= (F.lit(float(floor)) if floor is not None else thr.by_category(t["category"], limits)))


def within(files: DataFrame, root: str, *, recursive: bool = True) -> DataFrame:
    """Files below a folder: an exact prefix, and for one level no further separator."""
    head = root.rstrip("/") + "/"
    inside = files.filter(F.col("path").startswith(head))
    return inside if recursive else inside.filter(~F.substring("path", len(head) + 1, 1 << 20).contains("/"))


def more_pages(shown: int, page: int = PAGE) -> bool:
    """Whether another page may follow: the last one was full."""
    return shown >= page > 0
