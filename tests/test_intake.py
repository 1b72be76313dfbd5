"""The intake's state: retries with timers, files in flight, other writers in between."""

import time

import pytest

from tagloom.operators import tagging
from tagloom.sources import schema
from tagloom.sources.catalog import Catalog
from tagloom.streaming import intake, watch

from .test_operators import draw


class Flaky:
    """Fails for a picture until a file beside it says that it has failed often enough."""

    def __init__(self, notes, often):
        self.notes, self.often = notes, often

    def prepare(self, images_):
        return list(images_)

    def infer(self, batch):
        with open(self.notes, "a") as f:
            f.write("x")
        with open(self.notes) as f:
            if len(f.read()) <= self.often:
                raise RuntimeError("not yet")
        return [[("late", 0.9, 0)] for _ in batch]


def wait_for(query, done, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception() is not None:
            raise query.exception()
        if done():
            return True
        time.sleep(0.5)
    return False


@pytest.mark.parametrize("tries", [5, 2])
def test_a_path_that_fails_twice_is_tagged_at_the_third_try(spark, tmp_path, tries):
    lib, cat, notes = tmp_path / "lib", Catalog(spark, str(tmp_path / "cat"), parts=2), str(tmp_path / "notes")
    draw(lib / "a.png", 1)
    query = watch.watch(cat, str(lib), str(tmp_path / "ck"), lambda: Flaky(notes, 2), "sig", interval="500 milliseconds", tries=tries, wait=1.0)
    try:
        assert wait_for(query, lambda: cat.number() >= 1 and cat.read("files").count() == 1)
        first = cat.read("files").first()
        assert first.tagger_sig in (None, "sig") and first.sha256
        # Another writer's version in between doesn't end the query.
        Catalog(spark, cat.path).publish({"tagger_thresholds": spark.createDataFrame([("general", 0.5)], schema.THRESHOLDS)})
        if tries == 5:
            assert wait_for(query, lambda: cat.read("file_tags").count() == 1)
            assert cat.read("files").first().tagger_sig == "sig" and open(notes).read() == "xxx" and cat.read("signatures").count() == 1
            assert cat.read("tagger_thresholds").count() == 1
        else:
            assert wait_for(query, lambda: open(notes).read() == "xx")
            time.sleep(4)
            assert open(notes).read() == "xx" and cat.read("files").first().tagger_sig is None and query.isActive
    finally:
        query.stop()


def test_attempts():
    model = intake._Made(tagging.DummyTagger)
    bad = intake.attempt(model, None)
    assert bad["error"] == "unreadable" and bad["tags"] is None and set(bad) == set(intake.COLUMNS)
    assert intake._pause(1, 2.0) == 2000 and intake._pause(3, 2.0) == 8000
