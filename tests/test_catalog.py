"""The catalog's parts: batches that rewrite what they touch, the text index, ranges of paths, writers that meet."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tagloom.operators import batches, documents, indexing, maintenance, tagging, textindex
from tagloom.operators.textindex import Phrase, Prefix
from tagloom.plans.fixtures import catalog as derived
from tagloom.sources import layout, schema
from tagloom.sources.catalog import Catalog
from tagloom.streaming import watch

from .test_operators import Broken, draw

TAGGED = "path string, tags array<struct<name:string,score:double,category:int>>, width int, height int"
SEEN = "path string, size bigint, mtime double, sha256 string"


@pytest.fixture(scope="module")
def filled(spark, sf, tmp_path_factory):
    """A catalog of the derived relations with a text index."""
    c = derived(spark, sf)
    cat = Catalog(spark, str(tmp_path_factory.mktemp("catalog")), parts=12)
    rel = {"files": c.files, "tags": c.tags, "file_tags": c.file_tags, "signatures": c.signatures, "fts_files": documents.rebuild(c.files, c.file_tags, c.tags)}
    cat.publish(rel)
    textindex.build(cat)
    return cat


def batch_of(spark, rows, gone=None):
    seen = spark.createDataFrame([(p, 5, 1.0, "new") for p, _ in rows], SEEN)
    tagged = spark.createDataFrame([(p, t, 7, 9) for p, t in rows], TAGGED)
    made = spark.createDataFrame([(p, 3, 4) for p, t in rows if t is not None], "path string, phash_u64 bigint, dhash_u64 bigint")
    return batches.Batch(seen, tagged, "sig", 2.0, made, gone)


def whole(rel, batch, top_k=128):
    """The relations after a batch by the pure functions over whole relations."""
    files = maintenance.upsert_files(rel["files"], batch.seen)
    number = files.select("path", F.col("id").alias("file_id"))
    items = batch.tagged.filter("tags is not null").join(number, "path").select("file_id", "tags", "width", "height", F.lit(batch.signature).alias("tagger_sig"), F.lit(batch.at).alias("tagged_at"))
    out = maintenance.write_batch(files, rel["tags"], rel["file_tags"], rel["fts_files"], items, k=top_k)
    out["files"] = maintenance.mark_retag(out["files"], batch.tagged.filter("tags is null").join(number, "path").select(F.col("file_id").alias("id")))
    out["signatures"] = maintenance.upsert_signatures(rel["signatures"], batch.signatures.join(number, "path").select("file_id", "phash_u64", "dhash_u64"))
    out["postings"] = textindex.postings(out["fts_files"])
    return out


def rows_of(df, name, drop=("created_at",)):
    return sorted((tuple(v for k, v in r.asDict().items() if k not in drop) for r in schema.conformed(df, name).collect()), key=repr)


def test_a_batch_rewrites_only_the_parts_it_touches(spark, filled):
    before = {n: filled.read(n) for n in ("files", "tags", "file_tags", "signatures", "fts_files")}
    path = before["files"].filter("is_present = 1").orderBy("path").first().path
    known = before["tags"].orderBy("name").first()
    rows = [(path, [(known.name, 0.9, known.category), ("quite new", 0.8, 0), (" quite new ", 0.95, 0)]), ("/lib/0/first.png", [("quite new", 0.5, 0)]), ("/zzz/last.png", None), ("/lib/3/empty.png", [])]
    batch = batch_of(spark, rows)
    want = {n: rows_of(df, n) for n, df in whole(before, batch).items()}
    size = filled.written_bytes(filled._version(1)["version"]) + filled.written_bytes(filled._version(2)["version"])
    version = batches.store(filled, batch)
    for n, expected in want.items():
        assert rows_of(filled.read(n), n) == expected, n
    assert filled.written_bytes(version) < 0.5 * size  # of four files in a catalog of 1,500: see the larger one below
    again = batches.store(filled, batch)
    for n, expected in want.items():
        assert rows_of(filled.read(n), n) == expected, n
    assert filled.held("tags") == filled._version(filled.number() - 1)["relations"]["tags"] and filled.written_bytes(again) > 0


def test_one_file_in_a_large_catalog(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("needs the larger tables")
    c = derived(spark, "/root/testdata/sf0.1")
    cat = Catalog(spark, str(tmp_path / "cat"))
    full = cat.publish({"files": c.files, "tags": c.tags, "file_tags": c.file_tags, "signatures": c.signatures, "fts_files": documents.rebuild(c.files, c.file_tags, c.tags)})
    rows = [(c.files.filter("id = 33").first().path, [(r.name, 0.5, r.category) for r in c.tags.orderBy("id").limit(5).collect()])]
    one = batches.store(cat, batch_of(spark, rows))
    assert cat.written_bytes(one) < 0.02 * cat.written_bytes(full)
    assert cat.read("file_tags").filter("file_id = 33").count() == 5 and cat.read("file_tags").count() > 500_000


def test_writers_that_meet_are_merged(spark, filled, monkeypatch):
    """Another writer's version between reading and publishing is merged into, not lost and no failure."""
    other, real, met = Catalog(spark, filled.path, parts=12), Catalog.publish, []

    def meddling(self, changed, *, base=None, only=None):
        if base is not None and len(met) < 2:
            met.append(base)
            real(other, {"tagger_thresholds": spark.createDataFrame([("general", 0.1 * len(met))], schema.THRESHOLDS)})
        return real(self, changed, base=base, only=only)

    monkeypatch.setattr(Catalog, "publish", meddling)
    batches.store(filled, batch_of(spark, [("/lib/meet.png", [("met", 0.7, 0)])]))
    assert len(met) == 2 and filled.read("tagger_thresholds").first().threshold == 0.2 and filled.read("files").filter("path = '/lib/meet.png'").count() == 1


def test_gone_files(spark, filled):
    two = filled.read("files").filter("is_present = 1 and id % 7 = 3").orderBy("id").limit(2).select("path", F.col("id").alias("file_id"))
    ids = [r.file_id for r in two.collect()]
    gone = spark.createDataFrame([tuple(r) for r in two.collect()], "path string, file_id bigint")
    none = batch_of(spark, [])
    batches.store(filled, batches.Batch(none.seen, none.tagged, "sig", 1.0, None, gone), when="2024-01-01 00:00:00")
    assert {(r.is_present, r.deleted_at) for r in filled.read("files").filter(F.col("id").isin(ids)).collect()} == {(0, "2024-01-01 00:00:00")}
    assert filled.read("fts_files").filter(F.col("file_id").isin(ids)).count() == 0 == filled.read("postings").filter(F.col("file_id").isin(ids)).count()
    assert filled.read("file_tags").filter(F.col("file_id").isin(ids)).count() > 0
    batches.store(filled, batches.Batch(none.seen, none.tagged, "sig", 1.0, None, gone), hard=True)
    for n, c in (("files", "id"), ("file_tags", "file_id"), ("signatures", "file_id")):
        assert filled.read(n).filter(F.col(c).isin(ids)).count() == 0


def brute(texts, clauses):
    import regex

    words = {i: regex.findall(r"[\p{L}\p{N}\p{Co}]+", t.lower()) for i, t in texts.items()}
    out = []
    for i, w in words.items():
        good = bool(clauses)
        for c in clauses:
            q = regex.findall(r"[\p{L}\p{N}\p{Co}]+", c.text.lower())
            if isinstance(c, Prefix):
                good &= len(q) == 1 and any(x.startswith(q[0]) for x in w)
            else:
                good &= bool(q) and any(w[k : k + len(q)] == q for k in range(len(w)))
        if good:
            out.append(i)
    return sorted(out)


def test_text_index(spark, filled):
    texts = {r.file_id: r.text for r in filled.read("fts_files").collect()}
    some = " ".join(documents_words(max(texts.values(), key=len))[1:4])
    for clauses in ([Phrase("ring")], [Phrase("Ring blue")], [Phrase("blue ring")], [Prefix("ri")], [Phrase("small"), Prefix("bo")], [Phrase(some)], [Phrase("ring ring")], [Phrase("!!")], [Prefix("two words")], [Prefix("")], [], [Phrase("nowhere")], [Phrase("small ring"), Phrase("blue"), Prefix("re")]):
        assert sorted(r.file_id for r in textindex.search(filled, clauses).collect()) == brute(texts, clauses), clauses
    parts = textindex.parts_of(filled, [Phrase("ring")])
    assert 0 < len(parts) < len(filled.held("postings")["parts"]) / 2
    read = {f.split("__part=")[1].split("/")[0] for f in filled.read("postings", parts).inputFiles()}
    assert len(read) == len(parts)


def documents_words(text):
    return textindex.terms_of(text)


def test_postings_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "a, B-a"), (5, "Ünïcode Ａ 1st"), (6, "b " * 3000)], "file_id bigint, text string")
    got = {(r.term, r.file_id): r.positions for r in textindex.postings(docs).collect()}
    assert got["a", 1] == [0, 2] and got["b", 4] == [1] and got["b", 6] == list(range(3000)) and ("ünïcode", 5) in got and not any(i in (2, 3) for _, i in got)
    ids = lambda *c: sorted(r.file_id for r in textindex.matching(textindex.postings(docs), c).collect())
    assert ids(Phrase("a b a")) == [1, 4] and ids(Phrase("b b b b")) == [6] and ids(Prefix("ün")) == [5] and ids(Phrase("a"), Phrase("b")) == [1, 4]


def test_ranges_are_cut_as_they_grow(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"), parts=4, most=50)
    files = lambda names: schema.conformed(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id bigint, path string"), "files")
    cat.publish({"files": files([f"/a/{i:03d}" for i in range(80)])})
    none = batch_of(spark, [])
    seen = spark.createDataFrame([(f"/a/010-{i:03d}", 1, 1.0, None) for i in range(300)], SEEN)
    batches.store(cat, batches.Batch(seen, none.tagged, "s", 1.0))
    assert max(p["rows"] for p in cat.held("files")["parts"]) > 300
    batches.store(cat, batches.Batch(seen.limit(1), none.tagged, "s", 1.0))
    held = cat.held("files")["parts"]
    assert len(held) > 8 and sum(p["rows"] for p in held) == 380 == cat.read("files").count() and held[0]["low"] == ""
    assert [p["low"] for p in held] == sorted(p["low"] for p in held) and all(a["max"] < b["low"] for a, b in zip(held, held[1:], strict=False))
    assert sorted(r.id for r in cat.read("files").collect()) == list(range(380))
    for p in ("/a/010-150", "/a/000", "/a", "/zzz", "/a/079"):
        n = layout.range_number(cat.held("files"), p)
        assert cat.touched("files", spark.createDataFrame([(p,)], "path string")) == [n]
    with pytest.raises(ValueError):
        cat.publish({"files": files(["/zzz/outside"])}, only={"files": [0]})


def test_a_refresh_reads_the_ranges_of_its_folder(spark, tmp_path):
    lib, cat = tmp_path / "lib", Catalog(spark, str(tmp_path / "cat"), parts=16)
    draw(lib / "m" / "a.png", 1)
    draw(lib / "m" / "b.png", 2)
    root = os.path.realpath(lib)
    other = [(i, f"{root}/{folder}/{i:04d}.png", 1) for folder in ("a", "z") for i in range(1 if folder == "a" else 400, 400 if folder == "a" else 800)]
    cat.publish({"files": schema.conformed(spark.createDataFrame(other, "id bigint, path string, is_present int"), "files")})
    parts = cat.between("files", *layout.below(f"{root}/m"))
    assert len(parts) <= 1
    assert indexing.refresh(cat, str(lib / "m"), tagging.DummyTagger, "sig") == {"queued": 2, "tagged": 2, "missing": 0}
    assert cat.read("files").filter("is_present = 1").count() == 801
    parts = cat.between("files", *layout.below(f"{root}/m"))
    read = cat.read("files", parts)
    assert len(parts) < 4 and read.count() < 200 and read.filter(F.col("path").contains("/m/")).count() == 2
    (lib / "m" / "a.png").unlink()
    before = cat.held("files")["parts"]
    assert indexing.refresh(cat, str(lib / "m"), tagging.DummyTagger, "sig") == {"queued": 0, "tagged": 0, "missing": 1}
    after = cat.held("files")["parts"]
    assert sum(p["path"] not in {q["path"] for q in before} for p in after) <= len(parts)
    assert cat.read("files").filter("is_present = 1").count() == 800  # nothing outside of the folder is missing


def test_what_the_watch_could_not_tag_is_scanned_again(spark, tmp_path):
    lib, cat = tmp_path / "lib", Catalog(spark, str(tmp_path / "cat"), parts=4)
    draw(lib / "a.png", 1)
    assert indexing.run(cat, [str(lib)], tagging.DummyTagger, "sig")["tagged"] == 1
    draw(lib / "a.png", 7)
    os.utime(lib / "a.png", (1, 1))
    batch = watch_batch(spark, lib / "a.png")
    watch.take_in(cat, batch, Broken, "sig")
    found = indexing.scan(cat, [str(lib)], "sig").collect()
    assert [r.needs_tagging for r in found] == [True]
    watch.take_in(cat, batch, tagging.DummyTagger, "sig")
    assert [r.needs_tagging for r in indexing.scan(cat, [str(lib)], "sig").collect()] == [False]


def watch_batch(spark, path):
    data, st = path.read_bytes(), path.stat()
    return spark.createDataFrame([(os.path.realpath(path), st.st_size, st.st_mtime, data)], "path string, size bigint, mtime double, content binary")


def test_ids_are_never_given_twice(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"), parts=4)
    batches.store(cat, batch_of(spark, [("/a", [("x", 0.5, 0)]), ("/b", [("y", 0.5, 0)])]))
    last = cat.read("files").orderBy(F.desc("id")).first()
    gone = spark.createDataFrame([(last.path, last.id)], "path string, file_id bigint")
    none = batch_of(spark, [])
    batches.store(cat, batches.Batch(none.seen, none.tagged, "s", time.time(), None, gone), hard=True)
    batches.store(cat, batch_of(spark, [("/c", [("z", 0.5, 0)])]))
    assert cat.read("files").filter("path = '/c'").first().id == last.id + 1 and sorted(r.id for r in cat.read("tags").collect()) == [1, 2, 3]


def test_vacuum_keeps_what_is_referred_to(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"), parts=2)
    tags = lambda *names: spark.createDataFrame([(i, n, 0) for i, n in enumerate(names)], schema.TAGS)
    first = cat.publish({"tags": tags("a", "b"), "tagger_thresholds": spark.createDataFrame([("general", 0.5)], schema.THRESHOLDS)})
    second = cat.publish({"tags": tags("a", "c")})
    third = cat.publish({"tags": tags("d")})
    assert cat.vacuum() == [] == cat.vacuum(keep=3, older_than=0)  # too young; all three are kept
    assert cat.vacuum(keep=1, older_than=0) == [second]  # the first still holds the thresholds
    assert cat.number() == 3 and [r.name for r in cat.read("tags").collect()] == ["d"] and cat.read("tagger_thresholds").count() == 1
    cat.reset()
    fourth = cat.publish({"tags": tags("e")})
    assert cat.vacuum(keep=1, older_than=0) == [] and {first, third, fourth} <= {p.name for p in (tmp_path / "cat").iterdir()}
