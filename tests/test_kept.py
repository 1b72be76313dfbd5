"""Paging by cursors, completions by prefix and statistics kept by deltas, against the plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import search, stats
from tagloom.plans.fixtures import catalog as derived
from tagloom.sources.catalog import Catalog


@pytest.fixture(scope="module")
def some(spark, sf):
    c = derived(spark, sf)
    few = c.files.filter("id < 400").withColumn("mtime", F.expr("if(id % 9 = 0, null, floor(mtime / 5e7) * 5e7)")).persist()
    yield few, c.file_tags.filter("file_id < 400").persist(), c.tags.persist()


@pytest.mark.parametrize("how", [{"order_by": o} for o in search.ORDERS] + [{"order": "relevance"}, {}])
def test_pages_follow_each_other(some, how):
    files, links, tags = some
    query = "small_ring | blue_bolt | category:artist"
    whole = search.search(files, links, tags, query, limit=10_000, **how).collect()
    got = [r for p in search.all_pages(files, links, tags, query, limit=37, **how) for r in p]
    assert [r.id for r in got] == [r.id for r in whole] and len(got) > 100
    assert all(a.tags == b.tags and abs(a.relevance - b.relevance) < 1e-9 for a, b in zip(got, whole, strict=True))


def test_cursors_are_of_one_order_and_version(some):
    files, links, tags = some
    rows, cursor = search.page(files, links, tags, "", limit=5, version=3)
    assert len(rows) == 5 and search.page(files, links, tags, "", limit=5, version=3, cursor=cursor)[0][0].id != rows[0].id
    for other in ({"version": 4}, {"version": 3, "order_by": "f.path ASC"}):
        with pytest.raises(ValueError):
            search.page(files, links, tags, "", limit=5, cursor=cursor, **other)
    with pytest.raises(ValueError):
        search.page(files, links, tags, "", order_by="1; DROP")
    pages = search.all_pages(files, links, tags, "", limit=10, most=25)
    assert [len(p) for p in pages] == [10, 10, 5]
    asked = []
    pages = search.all_pages(files, links, tags, "", limit=10, cancelled=lambda: len(asked) > 1 or asked.append(1))
    assert len(list(pages)) == 2
    assert search.page(files, links, tags, "nothing_like_it") == ([], None)


def test_completions(spark, tmp_path):
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abAB_é") for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    rows = spark.createDataFrame([(n, rng.choice([None, 1, 1, 5, 9])) for n in names] + [("", 3)], "name string, count bigint")
    table = stats.completion_table(rows, limit=7)
    assert table.groupBy("prefix").count().filter("count > 7").isEmpty()
    cat = Catalog(spark, str(tmp_path / "cat"), parts=8)
    cat.publish({"completions": table})
    for p in ("", "a", "A", "ab", "b_", "é", "zz", names[0], names[-1] + "x"):
        want = [(r.name, r["count"]) for r in stats.complete(rows, p, 7).collect()]
        assert [(r.name, r["count"]) for r in stats.completed_in(cat, p).collect()] == want, p


@pytest.mark.parametrize("seed", range(4))
def test_sums_moved_by_deltas(spark, seed):
    rng = random.Random(seed)
    files = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(40)], "id bigint, is_present int")
    old = {(f, t): rng.choice([0.1, 0.3, 0.9, rng.random()]) for f in range(40) for t in range(12) if rng.random() < 0.3}
    new = {k: v for k, v in old.items() if k[0] % 3}
    new.update({(f, t): rng.choice([0.1, 0.9, 0.95]) for f in range(0, 40, 3) for t in range(5, 14) if rng.random() < 0.2})
    frame = lambda d: spark.createDataFrame([(f, t, s) for (f, t), s in d.items()], "file_id bigint, tag_id bigint, score double")
    here = files.filter("is_present = 1").select(F.col("id").alias("file_id"))
    lost, gained = (frame({k: v for k, v in d.items() if k[0] % 3 == 0}).join(here, "file_id", "left_semi") for d in (old, new))
    asked = []

    def links_of(tags):
        asked.extend(r.tag_id for r in tags.collect())
        return frame(new).join(here, "file_id", "left_semi").join(tags, "tag_id", "left_semi")

    got = stats.moved_sums(stats.tag_sums(frame(old), files), lost, gained, links_of)
    rows = lambda df: sorted((r.tag_id, r.files, r.total, r.top, r.n_top) for r in df.collect())
    assert rows(got) == rows(stats.tag_sums(frame(new), files)) and len(asked) < 12
