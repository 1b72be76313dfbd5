"""A text index of documents: for each term the documents that hold it and its places there.

Postings (term, file_id, positions) are a relation like others, cut by ranges of term and document in a catalog, so that a
query reads only the parts of its terms, and a very common term spreads over many parts. Words are those of
``documents.words``: letters and digits in lower case, everything else separates.

A query is a list of clauses that must all hold: a phrase (its words next to each other, in order; one word is a phrase,
too) or a prefix (some word starts with it). Each clause becomes documents, and clauses meet by semi-joins; a phrase meets
its words' postings and intersects places, word by word, in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.documents import words
from tagloom.sources import layout
from tagloom.sources.catalog import Catalog
from tagloom.sources.schema import POSTINGS


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Prefix:
    text: str


Clause = Phrase | Prefix


def postings(documents: DataFrame) -> DataFrame:
    """term, file_id, positions (from 0, rising) of documents (file_id, text).

    Documents are dealt by their id before they fall into words, so that the words of one need no shuffle to meet.
    """
    rows = documents.select("file_id", "text").repartition("file_id").select("file_id", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return rows.groupBy("term", "file_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def delta(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings to add, and (term, file_id) to take away, where documents become others; equal postings are in neither."""
    old, new = postings(before), postings(after)
    on = ["term", "file_id"]
    fresh = new.join(old.withColumnRenamed("positions", "__p"), on, "left").filter("__p is null or __p <> positions").select(*POSTINGS.names)
    lost = old.join(new.select(*on), on, "left_anti").select(*on)
    return fresh, lost


def applied(stored: DataFrame, fresh: DataFrame, lost: DataFrame) -> DataFrame:
    """Postings after a delta."""
    on = ["term", "file_id"]
    return stored.join(fresh.select(*on).union(lost), on, "left_anti").select(*POSTINGS.names).unionByName(fresh.select(*POSTINGS.names))


def terms_of(text: str) -> list[str]:
    """The words of a query's text, as ``documents.words`` has them."""
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{Co}]+", text.lower())


def _phrase(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Documents in which the terms follow each other.

    One pass: the places of each term, moved back by its place in the phrase, are gathered a document, and those that all
    of them share are starts of the phrase. A term that the phrase holds twice counts at each of its places.
    """
    at = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)))
    mine = rows.filter(F.col("term").isin(sorted(set(terms)))).select("file_id", "term", "positions")
    if len(terms) == 1:
        return mine.select("file_id").distinct()
    moved = mine.select("file_id", "positions", F.explode(F.filter(at, lambda x: x["t"] == F.col("term"))).alias("x")).select("file_id", "x.i", F.transform("positions", lambda p: p - F.col("x.i")).alias("starts"))
    held = moved.groupBy("file_id").agg(F.collect_list("starts").alias("all"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms))
    shared = F.aggregate(F.slice("all", 2, len(terms)), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b))
    return held.filter(F.size(shared) > 0).select("file_id")


def matching(rows: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """file_id of the documents that meet every clause. A clause without a word is met by none, and so is no clause at all."""
    found = []
    for c in clauses:
        terms = terms_of(c.text)
        if not terms or isinstance(c, Prefix) and len(terms) > 1:
            return rows.select("file_id").limit(0)
        if isinstance(c, Prefix):
            found.append(rows.filter(F.col("term").startswith(terms[0])).select("file_id").distinct())
        else:
            found.append(_phrase(rows, terms))
    if not found:
        return rows.select("file_id").limit(0)
    return reduce(lambda a, b: a.join(b, "file_id", "left_semi"), found)


def parts_of(catalog: Catalog, clauses: Sequence[Clause]) -> list[int] | None:
    """The parts of a catalog's index that a query reads; null if it has none yet."""
    wanted: set[int] = set()
    for c in clauses:
        for t in terms_of(c.text):
            # Keys are a term and a number behind U+0001: a whole term ends before U+0002.
            low, high = layout.starting(t) if isinstance(c, Prefix) else (t + "\u0001", t + "\u0002")
            got = catalog.between("postings", low, high)
            if got is None:
                return None
            wanted |= set(got)
    return sorted(wanted)


def search(catalog: Catalog, clauses: Sequence[Clause]) -> DataFrame:
    """file_id of matching documents of a catalog, from the parts of the clauses' terms alone."""
    parts = parts_of(catalog, clauses)
    return matching(catalog.read("postings", parts) if parts != [] else catalog.read("postings").limit(0), clauses)


def build(catalog: Catalog) -> str:
    """Indexes all documents of a catalog; from then on batches keep the index."""
    base = catalog.number()
    return catalog.publish({"postings": postings(catalog.read("fts_files"))}, base=base)
