"""From the expression tree to a DataFrame of matching files.

``matching`` makes one pass: links are pruned to those that some leaf can use, one aggregation by file computes a flag
for each leaf, and the boolean expression is evaluated over a left join with files, so that NOT keeps untagged files.
``matching_by_joins`` builds the same from semi and anti joins; tests hold one against the other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import thresholds as thr
from tagloom.plans.query import And, Category, Expr, Not, Or, Score, Tag, leaves, parse


def leaf_test(leaf: Expr, thresholds: Mapping | None) -> Column:
    """The test of a leaf over a link's name, category and score."""
    score = F.col("score")
    if isinstance(leaf, Score):
        return {">=": score >= leaf.value, "<=": score <= leaf.value, "=": score == leaf.value, ">": score > leaf.value, "<": score < leaf.value}[leaf.op]
    limits = thr.for_query(thresholds)
    if isinstance(leaf, Tag):
        test = F.col("name") == leaf.name
        return test if limits is None else test & (score >= thr.by_category(F.col("category"), limits))
    assert isinstance(leaf, Category)
    test = F.col("category") == leaf.id
    return test if limits is None else test & (score >= float(limits.get(leaf.id, 0.0)))


def links(file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """file_id, name, category, score. Catalyst broadcasts tags when statistics say that they are small."""
    return file_tags.join(tags.withColumnRenamed("id", "tag_id"), "tag_id").select("file_id", "name", "category", "score")


def truth(tree: Expr, flag: Mapping[Expr, Column]) -> Column:
    if isinstance(tree, Not):
        return ~truth(tree.of, flag)
    if isinstance(tree, And):
        return truth(tree.left, flag) & truth(tree.right, flag)
    if isinstance(tree, Or):
        return truth(tree.left, flag) | truth(tree.right, flag)
    return flag[tree]


def relevant(terms: Sequence[str], thresholds: Mapping | None) -> Column:
    """Whether a link counts for relevance: it has one of the names and reaches its category's threshold."""
    return F.col("name").isin(list(dict.fromkeys(terms))) & (F.col("score") >= thr.by_category(F.col("category"), thr.for_relevance(thresholds)))


def matching(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str | Expr | None, thresholds: Mapping | None = None, relevance: Column | None = None) -> DataFrame:
    """Present files that the query matches; with ``relevance``, a test of links, also ``relevance``: the sum of scores of the
    links that pass, from the same pass over them."""
    tree = parse(query) if isinstance(query, str) else query
    present = files.filter("is_present = 1")
    if tree is None and relevance is None:
        return present
    found = [] if tree is None else leaves(tree)
    tests = {leaf: leaf_test(leaf, thresholds) for leaf in found}
    wide = relevance is not None or any(not isinstance(x, Score) for x in found)
    rows = links(file_tags, tags) if wide else file_tags
    rows = rows.filter(reduce(lambda a, b: a | b, [*tests.values(), *([relevance] if relevance is not None else [])]))
    names = {leaf: f"__flag{i}" for i, leaf in enumerate(found)}
    sums = [] if relevance is None else [F.sum(F.when(relevance, F.col("score"))).alias("__sum")]
    flags = rows.groupBy(F.col("file_id").alias("__file")).agg(*(F.bool_or(tests[leaf]).alias(n) for leaf, n in names.items()), *sums)
    joined = present.join(flags, present.id == flags["__file"], "left")
    if tree is not None:
        joined = joined.filter(truth(tree, {leaf: F.coalesce(F.col(n), F.lit(False)) for leaf, n in names.items()}))
    own = [present[c] for c in present.columns]
    return joined.select(*own) if relevance is None else joined.select(*own, F.coalesce("__sum", F.lit(0.0)).alias("relevance"))


def matching_by_joins(files: DataFrame, file_tags: DataFrame, tags: DataFrame, query: str | Expr | None, thresholds: Mapping | None = None) -> DataFrame:
    """The same by set algebra over ids of present files."""
    tree = parse(query) if isinstance(query, str) else query
    present = files.filter("is_present = 1")
    if tree is None:
        return present
    ids, rows = present.select("id"), links(file_tags, tags)

    def of(x: Expr) -> DataFrame:
        if isinstance(x, Not):
            return ids.join(of(x.of), "id", "left_anti")
        if isinstance(x, And):
            return of(x.left).join(of(x.right), "id", "left_semi")
        if isinstance(x, Or):
            return of(x.left).union(of(x.right)).distinct()
        return ids.join(rows.filter(leaf_test(x, thresholds)).select(F.col("file_id").alias("id")), "id", "left_semi")

    return present.join(of(tree), "id", "left_semi")
