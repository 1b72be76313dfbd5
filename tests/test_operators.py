"""Operators on small fixtures: catalogs, clusters, tagging, images, labels, settings, exports, streams."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import images, scalar
from tagloom.functions import thresholds as thr
from tagloom.operators import documents, duplicates, indexing, maintenance, metrics, search, stats, tagging
from tagloom.sinks import export
from tagloom.sources import cache, config, labels, listing, schema
from tagloom.sources.catalog import Catalog, Conflict
from tagloom.streaming import watch


@pytest.fixture(scope="module")
def small(spark):
    tags = spark.createDataFrame([(1, "plum", 0), (2, "<mark>", 4), (3, "faint", 0), (4, "over_ripe", 0)], schema.TAGS)
    links = spark.createDataFrame([(10, 1, 0.8), (11, 1, 0.6), (10, 2, 0.35), (11, 3, 0.15), (12, 1, 0.95), (11, 4, 0.7)], schema.FILE_TAGS)
    files = schema.conformed(spark.createDataFrame([(10, "/a/A.png", 100, 200.0, 1), (11, "/a/b/B.png", 200, 100.0, 1), (12, "/a/C.png", 300, 50.0, 0), (13, "/z/D.jpg", None, 100.0, 1)], "id long, path string, size long, mtime double, is_present int"), "files")
    return files, tags, links


def test_stats(small):
    files, tags, links = small
    rows = {r.name: (r.files, round(r.avg_score, 3), r.max_score) for r in stats.tag_stats(tags, links, files, thresholds=thr.for_stats([(0, 0.4)])).collect()}
    assert rows == {"plum": (2, 0.7, 0.8), "<mark>": (1, 0.35, 0.35), "over_ripe": (1, 0.7, 0.7)}
    assert [r.name for r in stats.tag_stats(tags, links, files, contains="R_").collect()] == ["over_ripe"]
    assert stats.tag_stats(tags, links, files, limit=1).count() == 1


def test_search_pages(small):
    files, tags, links = small
    rows = search.search(files, links, tags, "").collect()
    assert [r.id for r in rows] == [10, 11, 13] and [t.name for t in rows[0].tags] == ["plum", "<mark>"] and rows[2].tags == []
    assert [r.id for p in search.pages(files, links, tags, "", chunk=2) for r in p] == [10, 11, 13]
    assert [r.relevance for r in search.search(files, links, tags, "plum", order="relevance").collect()] == [0.8, 0.6]
    with pytest.raises(ValueError):
        search.search(files, links, tags, "", order_by="1; DROP")
    assert [r.id for r in search.within(files, "/a", recursive=False).orderBy("id").collect()] == [10, 12]
    assert search.any_files(files) and not search.any_files(files.limit(0)) and search.more_pages(200) and not search.more_pages(199)


def test_documents(small):
    files, tags, links = small
    assert {r.file_id: r.text for r in documents.rebuild(files, links, tags, k=2).collect()} == {10: "plum <mark>", 11: "over_ripe plum"}
    assert documents.rebuild(files, links, tags, k=0).count() == 0
    docs = documents.rebuild(files, links, tags)
    assert [r.file_id for r in documents.phrase(docs, "OVER ripe").collect()] == [11]
    assert documents.phrase(docs, "ripe over").count() == 0 and documents.phrase(docs, "!!").count() == 0


def test_upserts_and_deletes(spark, small):
    files, tags, links = small
    got = {r.path: r for r in maintenance.upsert_files(files, spark.createDataFrame([("/a/C.png", None, 5), ("/new/1", 9, 6), ("/new/0", 8, 7)], "path string, size long, width int")).collect()}
    assert got["/a/C.png"].is_present == 1 and got["/a/C.png"].size is None and got["/a/C.png"].id == 12
    assert (got["/new/0"].id, got["/new/1"].id) == (14, 15)
    twice = spark.createDataFrame([("/n", 1, 0), ("/n", 2, 1)], "path string, size long, seq int")
    assert [r.size for r in maintenance.upsert_files(files, twice).filter("path = '/n'").collect()] == [2]
    items = spark.createDataFrame([(10, [("new", 0.7, 4), (" new ", 0.8, 4)], 5, None, None, 9.0), (11, [], None, 7, "s", None)], "file_id long, tags array<struct<name:string,score:double,category:int>>, width int, height int, tagger_sig string, tagged_at double")
    out = maintenance.write_batch(files, tags, links, documents.rebuild(files, links, tags), items)
    assert sorted((r.file_id, r.tag_id, r.score) for r in out["file_tags"].collect()) == [(10, 5, 0.8), (12, 1, 0.95)]
    assert {r.file_id: r.text for r in out["fts_files"].collect()} == {10: "new"}
    meta = {r.id: (r.width, r.height, r.tagger_sig, r.last_tagged_at) for r in out["files"].collect()}
    assert meta[10] == (5, None, None, 9.0) and meta[11] == (None, 7, "s", None)
    with pytest.raises(ValueError):
        maintenance.write_batch(files, tags, links, documents.rebuild(files, links, tags), items.union(items))


def test_clusters(spark):
    base = 0xFFFFFFFF00000000 - (1 << 64)
    rows = [(1, "/a.png", 1000, base), (2, "/b.png", 2000, base ^ 1), (3, "/c.jpg", 1500, base ^ 2), (4, "/d.png", 1, 0x0F0F), (5, "/e.png", 1, None)]
    files = spark.createDataFrame([(i, p, s, 10, 10, h) for i, p, s, h in rows], "id long, path string, size long, width int, height int, phash long")
    got = duplicates.clusters(files, limit=8).orderBy("group", "position").collect()
    assert [(r.id, r.is_keeper, r.best_hamming) for r in got] == [(2, 1, 1), (3, 0, 1), (1, 0, 1)]
    assert duplicates.without(duplicates.clusters(files), spark.createDataFrame([(2,), (3,)], "id long")).count() == 0
    far = spark.createDataFrame([(1, 0), (2, 0x0001000100010001)], "id long, phash long").withColumn("size", F.lit(1))
    assert duplicates.edges(far, limit=64).count() == 0  # near, but no band is shared
    same = spark.range(50).select("id", F.lit(7).cast("long").alias("phash"), F.lit(1).alias("size"))
    assert duplicates.edges(same).count() == 49
    emb = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 5, [0.0, 1.0]), (3, 5, None), (4, 5, [1.0])], "id long, phash long, embedding array<double>").withColumn("size", F.lit(1))
    assert sorted((r.a, r.b) for r in duplicates.edges(emb, least_cosine=0.9).collect()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


@pytest.mark.parametrize("limit,count,bits", [(0, 4, 16), (4, 4, 16), (8, 4, 16), (20, 4, 16), (3, 2, 20), (5, 8, 8)])
def test_edges_against_brute_force(spark, limit, count, bits):
    """Every pair that shares a band within the limit, once: hashes a few flipped bits apart, of all signs, and copies."""
    rng = np.random.default_rng(limit)
    base = rng.integers(-(2**63), 2**63, 12)
    hashes = [int(h) ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 9)).tolist())) for h in np.repeat(base, 12)]
    files = spark.createDataFrame([(i, h, 100) for i, h in enumerate(hashes)], "id long, phash long, size long")
    m = 2**64 - 1
    band = lambda h: [(h & m) >> b * bits & (1 << bits) - 1 for b in range(count)]
    want = sorted((i, j, d) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if i < j and (d := ((x ^ y) & m).bit_count()) <= limit and any(p == q for p, q in zip(band(x), band(y), strict=True)))
    got = duplicates.edges(files, limit=limit, count=count, bits=bits, ratio=0.5)
    assert sorted(tuple(r) for r in got.collect()) == want and want
    for split in (0, 7):
        assert sorted(tuple(r) for r in duplicates.edges(files, limit=limit, count=count, bits=bits, ratio=0.5, split=split).collect()) == want
    capped = duplicates.edges(files, limit=limit, count=count, bits=bits, ratio=0.5, pair_cap=10**9)
    assert sorted(tuple(r) for r in capped.collect()) == want


def test_parse_hash(spark):
    texts = ["123", "ff", "0xFFFFFFFFFFFFFFFF", "18446744073709551615", "9223372036854775808", "zz", "", None, "11112222333344445555666"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(duplicates.parse_hash(F.col("t"))).collect()]
    assert got == [123, 255, -1, -1, -(2**63), None, None, None, None]
    assert spark.createDataFrame([(bytearray(b"\0" * 7 + b"{"),)], "b binary").select(duplicates.hash_of_bytes(F.col("b"))).first()[0] == 123


def test_hash_columns(spark):
    rows = spark.createDataFrame([(1, "0x10", None), (2, None, bytearray(b"{")), (3, "nope!", None)], "id long, phash string, hash binary")
    assert [(r.id, r.phash) for r in duplicates.from_rows(rows).orderBy("id").collect()] == [(1, 16), (2, 123)]
    with pytest.raises(ValueError):
        duplicates.from_rows(rows.select("id"))
    assert tagging.resolve("dummy") is tagging.DummyTagger
    with pytest.raises(ValueError):
        tagging.resolve("wd")
    assert images.thumbnail_key("/a", 1, 2.0, 64) != images.thumbnail_key("/a", 1, 2.5, 64)


def test_match_clusters(spark):
    m = spark.createDataFrame([(1, 2, True), (2, 3, True), (4, 5, True), (3, 5, False)], "a long, b long, is_duplicate boolean")
    members, matches = duplicates.match_clusters(m)
    assert sorted(tuple(r) for r in members.collect()) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)]
    assert sorted(tuple(r) for r in matches.collect()) == [(1, 1, 2), (1, 2, 3), (4, 4, 5)]


def test_tagging(spark):
    rng = np.random.default_rng(0)
    scores, kinds = rng.random((5, 60)).round(2), rng.integers(0, 6, 60)
    how = {"thresholds": {0: 0.5, 4: 0.2}, "caps": {1: 2, 4: 1}, "top_k": 20, "base_cap": 10}
    rows = [(i, j, f"t{j}", float(s), int(kinds[j])) for i, r in enumerate(scores) for j, s in enumerate(r)]
    df = spark.createDataFrame(rows, "file_id long, position int, name string, score double, category int")
    got = {}
    for r in tagging.capped(df, **how).collect():
        got.setdefault(r.file_id, set()).add(r.position)
    want = {i: {j for j, _ in row} for i, row in enumerate(tagging.post_process(scores, kinds, **how))}
    assert got == want
    minority = tagging.post_process(np.array([[0.9] * 128 + [0.85]]), np.array([0] * 128 + [4]), caps={0: 1, 4: 1}, base_cap=129, top_k=129)
    assert [j for j, _ in minority[0]] == [0, 128]

    class Fragile:
        def prepare(self, images):
            return [None if x == b"bad" else x for x in images]

        def infer(self, batch):
            if b"poison" in batch:
                raise RuntimeError("poison")
            return [[("ok", 0.5, 0)] for _ in batch]

    images_ = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate([b"a", b"bad", b"poison", b"c"])], "file_id long, content binary").coalesce(1)
    done = {r.file_id: (r.tags is not None, r.error) for r in tagging.tag(images_, Fragile).collect()}
    assert done == {0: (True, None), 1: (False, "unreadable"), 2: (False, "poison"), 3: (True, None)}


def test_series_in_numpy_and_spark_agree(spark):
    rng = np.random.default_rng(3)
    names = [labels.Label(f"t{i:02d}", int(rng.integers(0, 6)), None, tuple(f"t{j:02d}" if j < 40 else f"new{j}" for j in rng.integers(0, 50, 2))) for i in range(40)] + [labels.Label("placeholder_9", 5)]
    scores = rng.integers(0, 128, (30, 41)) / 128
    rows = [(i, j, x.name, float(s), x.category) for i, r in enumerate(scores) for j, (x, s) in enumerate(zip(names, r, strict=True))]
    df = spark.createDataFrame(rows, "file_id long, position int, name string, score double, category int")
    for how in ({}, {"thresholds": {4: 0.3, 0: 0.6}, "caps": {4: 2, 3: 3}, "top_k": 9}):
        got = sorted((r.file_id, r.name, r.score, r.category) for r in tagging.with_series(df, labels.frame(spark, names), **how).collect())
        want = sorted((i, n, s, c) for i, row in enumerate(tagging.series_post_process(scores, names, **how)) for n, s, c in row)
        assert got == want and got


class FakeSession:
    """Scores of each picture: its mean level, scaled, for every label in turn."""

    def __init__(self, width, *outputs, shape=("n", 3, 8, 8)):
        out = lambda n, w: type("O", (), {"name": n, "shape": ["n", w], "type": "tensor(float)"})
        self.outputs, self.inputs, self.width, self.seen = [out(n, w) for n, w in outputs], [type("I", (), {"name": "x", "shape": list(shape), "type": "tensor(float)"})], width, None
        self.get_outputs, self.get_inputs = lambda: self.outputs, lambda: self.inputs

    def run(self, names, feed):
        self.seen = feed["x"].shape
        return [np.tile(np.linspace(0.9375, 0.5625, self.width), (len(feed["x"]), 1))]


def test_taggers_by_name(tmp_path, monkeypatch):
    (tmp_path / "m.onnx").write_bytes(b"")
    (tmp_path / "selected_tags.csv").write_text('name,category,ips\nhero,4,"[""Saga""]"\nplain,0,\nodd,0,\n')
    model = str(tmp_path / "m.onnx")
    made = FakeSession(3, ("features", 9), ("prediction", 3))
    tried = []

    def open_(path, providers):
        tried.append([p for p, _ in providers] if isinstance(providers[0], tuple) else providers)
        if tried[-1] == [labels.CUDA]:
            raise RuntimeError("no device")
        return made

    monkeypatch.setattr("onnxruntime.InferenceSession", open_)
    monkeypatch.setattr("onnxruntime.get_available_providers", lambda: [labels.CPU])
    tagger = tagging.resolve("onnx", model, side=8)()
    assert tagger.kind == "series" and tagger.output == "prediction" and tagger.failed == ["CUDAExecutionProvider: no device"] and tried[-2:] == [[labels.CUDA], [labels.CPU]]
    picture = images.encode_png(np.full((20, 10, 3), 200, np.uint8))
    ready = tagger.prepare([picture, b"nothing"])
    assert ready[0].shape == (3, 8, 8) and ready[1] is None
    assert tagger.infer(ready[:1]) == [[("Saga", 0.9375, 3), ("hero", 0.9375, 4), ("plain", 0.75, 0), ("odd", 0.5625, 0)]]
    square = tagging.resolve("onnx", model, kind="square", device="cpu", side=8)()
    assert square.infer(square.prepare([picture])) == [[("hero", 0.9375, 4), ("plain", 0.75, 0), ("odd", 0.5625, 0)]] and made.seen == (1, 3, 8, 8)
    made.outputs = FakeSession(3, ("scores", 4)).outputs
    with pytest.raises(ValueError):
        square = tagging.resolve("onnx", model, kind="square", side=8)()
    with pytest.raises(ValueError):
        tagging.resolve("unknown", model)
    with pytest.raises(FileNotFoundError):
        tagging.resolve("onnx", str(tmp_path / "none" / "m.onnx"))


def test_providers_and_outputs(tmp_path):
    gpu, cpu, rt = labels.CUDA, labels.CPU, labels.TENSORRT
    assert labels.attempts([gpu], [cpu]).attempts == [[cpu]] and f"{cpu} takes over" in labels.attempts([gpu], [cpu]).warnings[0]
    assert labels.attempts(None, [cpu]).attempts == [[gpu], [cpu]] and labels.attempts(None, [cpu]).infos and not labels.attempts(None, [gpu]).infos
    assert labels.attempts([rt, gpu, cpu], [rt, gpu, cpu]).attempts == [[rt, gpu, cpu], [gpu], [cpu]]
    assert labels.attempts([rt, gpu, cpu], [gpu, cpu]).attempts == [[gpu], [cpu]] and labels.attempts([rt, gpu, cpu], [cpu]).attempts == [[cpu]]
    assert [labels.wanted(d) for d in ("CPU", "auto", None, "tensorrt")] == [[cpu], None, None, [rt, gpu, cpu]]
    assert labels.provider_options() == {} and labels.provider_options(engine_cache="/c", half=True, gpu_memory_mb=2) == {rt: {"trt_engine_cache_enable": "True", "trt_engine_cache_path": "/c", "trt_fp16_enable": "True"}, gpu: {"gpu_mem_limit": "2097152"}}
    assert labels.prediction_output([("a", 5), ("prediction", 13461)], 4) == ("prediction", 13461, "series")
    assert labels.prediction_output([("a", 5), ("prediction", 4)], 5) == ("a", 5, "square") and labels.prediction_output([("a", 5), ("logits", 13461)]) == ("logits", 13461, "series")
    assert labels.prediction_output([("a", 5), ("b", 4)], 4) == ("b", 4, "square") and labels.prediction_output([("a", None)]) == ("a", None, "square")
    (tmp_path / "m.onnx").write_bytes(b"")
    told = labels.inspect(str(tmp_path / "m.onnx"), open_=lambda p: FakeSession(1, ("out", 1)))
    assert not told["ok"] and told["width"] == 1 and told["errors"] == ["no label file was found"]
    (tmp_path / "selected_tags.csv").write_text("a,0\nb,4\n")
    told = labels.inspect(str(tmp_path / "m.onnx"), open_=lambda p: FakeSession(2, ("x", 7), ("prediction", 2)))
    assert told["ok"] and (told["output"], told["kind"], told["categories"]) == ("prediction", "series", {0: 1, 4: 1})


def test_phash_by_definition():
    rng = np.random.default_rng(4)
    g = rng.integers(0, 256, (32, 32))
    at = np.arange(32)
    scale = lambda k: np.sqrt((1 if k == 0 else 2) / 32)
    wave = lambda k: scale(k) * np.cos(np.pi * (2 * at + 1) * k / 64)
    low = np.array([[(g * np.outer(wave(u), wave(v))).sum() for v in range(8)] for u in range(8)]).reshape(-1)
    bits = "".join("1" if x > low[1:].mean() else "0" for x in low)
    assert images.phash(np.repeat(g[..., None], 3, -1).astype(np.uint8)) & (2**64 - 1) == int(bits, 2)


def test_images(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((40, 56, 3)) * 255).astype(np.uint8)
    assert (images.decode(images.encode_png(a)) == a).all()
    smooth = np.rint(images.resize(a, 64, 64)).clip(0, 255).astype(np.uint8)
    bright = np.clip(smooth * 1.02, 0, 255).astype(np.uint8)
    dist = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert images.phash(smooth) == images.phash(smooth.copy()) and dist(images.phash(smooth), images.phash(bright)) <= 6
    assert dist(images.dhash(smooth), images.dhash(bright)) <= 6
    assert images.tile_distance(images.tile_hash(smooth), images.tile_hash(smooth)) == 0 and images.mean_error(images.small_grey(smooth), images.small_grey(bright)) < 0.02
    assert images.ssim(smooth, smooth) == pytest.approx(1) and images.ssim(smooth, 255 - smooth) < 0.2
    assert images.decode(b"nothing") is None and images.decode(images.encode_png(a), hard_pixels=10) is None
    assert images.refine(None, a) is None and images.refine(a, a)[2]
    rgba = np.concatenate([a, np.zeros((40, 56, 1), np.uint8)], -1)
    assert (images.over_white(rgba) == 255).all()
    members = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 0)], "cluster long, id long, is_keeper int")
    pics = spark.createDataFrame([(1, bytearray(images.encode_png(smooth))), (2, bytearray(images.encode_png(bright))), (3, bytearray(images.encode_png(255 - smooth)))], "file_id long, content binary")
    assert sorted(r.id for r in images.refine_clusters(members, pics).collect()) == [1, 2]
    assert sorted(r.id for r in images.refine_clusters(members, pics, how="pixels", limit=0.02).collect()) == [1, 2]
    assert images.refined_pairs(spark.createDataFrame([(1, 2), (1, 9)], "a long, b long"), pics).filter("is_duplicate").count() == 1
    assert images.thumbnails(pics, 16).count() == 3 and images.missing_signatures(pics, images.signatures(pics.limit(1))).count() == 2


def test_labels():
    got = labels.parse('﻿# note\nid,tag_id,name,category,count,ips\n1,10,alice,4,5,"[""Series"", "" ""]"\n2,11,,0,3,\n')
    assert [(x.name, x.category, x.ips) for x in got] == [("alice", 4, ("Series",)), ("placeholder_11", 5, ())] and got[0].count == 5
    assert [x.name for x in labels.parse("a\nb")] == ["a", "b"]
    assert [(x.name, x.category) for x in labels.parse("1,x\ny,character")] == [("x", 0), ("y", 4)]
    assert [(x.name, x.category, x.count) for x in labels.parse("7,z,3,9")] == [("z", 3, 9)]
    assert [(x.name, x.placeholder) for x in labels.reordered(labels.parse("a\nb"), {"b": 0, "a": 2})] == [("b", False), ("placeholder_1", True), ("a", False)]


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ("foo,0,10", ("foo", 0, 10, ())),
        ("foo,general,10", ("foo", 0, 10, ())),
        ("foo,4,12.7,\"[\"\"S\"\"]\"", ("foo", 4, 12, ("S",))),
        ("5,foo,character", ("foo", 4, 0, ())),
        ("5,6,foo", ("foo", 0, 0, ())),
        ("5,6,foo,3,9,\"\"\"One\"\"\"", ("foo", 3, 9, ("One",))),
        ("5,6", ("6", 0, 0, ())),
        ("5", ("5", 0, 0, ())),
        (" foo , 2.9 , x ", ("foo", 0, 0, ())),
        ("foo,77", ("foo", 77, 0, ())),
        ("name", ("name", 0, 0, ())),
        ("tag_name,post_count", ("tag_name", 0, 0, ())),
    ],
)
def test_label_rows_without_a_header(row, want):
    """A row is read by its first cells: a name, or one or two numbers before it."""
    got = labels.parse(f"# note\n\n{row}\n , ,\n")
    assert [(x.name, x.category, x.count, x.ips) for x in got] == [want] and not got[0].placeholder


def test_label_headers_and_placeholders():
    assert [(x.name, x.category, x.count) for x in labels.parse("Category,TAG,count\n4,foo,1\nname,tagid\nbar,9")] == [("foo", 4, 1), ("bar", 0, 0)]
    assert [(x.name, x.placeholder, x.category) for x in labels.parse("tag_id,name\n8,\nx,\n3,placeholder_8")] == [("placeholder_8", True, 5), ("placeholder_1", True, 5), ("placeholder_8", False, 0)]
    assert [(x.name, x.placeholder) for x in labels.parse("7,8,,5\n9,,5\nx,,1")] == [("placeholder_7", True), ("placeholder_9", True), ("x", False)]
    assert labels.parse("") == [] == labels.parse("name,count\n")


def test_label_files_are_found(tmp_path):
    model = str(tmp_path / "m.onnx")
    (tmp_path / "accounts.csv").write_text("1,x")
    assert labels.discover(model) is None and labels.discover(None) is None and labels.discover("/nowhere/model.onnx") is None
    for name in ("selected_tags_z.csv", "selected_tags_b.csv", "m.csv", "selected_tags_v3c.csv", "selected_tags_v3.csv", "selected_tags.csv"):
        (tmp_path / name).write_text("x")
        want = "selected_tags_b.csv" if name.startswith("selected_tags_b") else name
        assert labels.discover(model) == str(tmp_path / want)
    assert labels.discover(model, str(tmp_path / "accounts.csv")).endswith("accounts.csv") and labels.discover(model, "/nowhere.csv") is None


def test_real_tags_named_like_placeholders_stay(spark):
    rows = [labels.Label("placeholder_art", 5), labels.Label("placeholder_1", 5, 0, (), True), labels.Label("x", 0)]
    df = spark.createDataFrame([(1, i, x.name, 0.9 - i / 100, x.category) for i, x in enumerate(rows)], "file_id long, position int, name string, score double, category int")
    assert sorted(r.name for r in tagging.with_series(df, labels.frame(spark, rows)).collect()) == ["placeholder_art", "x"]
    assert [n for n, _, _ in tagging.series_post_process(np.array([[0.9, 0.89, 0.88]]), rows)[0]] == ["placeholder_art", "x"]


def test_thresholds_and_scalars(spark):
    assert [thr.category_id(x) for x in (None, True, 3, "Character", " 4 ", "2.9", "x", "", float("nan"))] == [None, 1, 3, 4, 4, 2, None, None, None]
    assert thr.for_query(None) is None and thr.for_query({})[0] == 0.35 and thr.for_query({"x": 1, "4": "0.8"})[4] == 0.8
    assert thr.stored([]) == thr.DEFAULTS and thr.stored([("general", 0.5), ("bad", "x")])[0] == 0.5
    row = spark.range(1).select(scalar.human_size(F.lit(1536)), scalar.compact_count(F.lit(1500)), scalar.compact_count(F.lit(2_000_000)), scalar.suffix(F.lit("/a/b.tar.GZ")), scalar.base_name(F.lit("/a/b.png")), scalar.dimensions(F.lit(None).cast("int"), F.lit(3))).first()
    assert tuple(row) == ("1.5 KB", "1.5k", "2M", "gz", "b.png", "-")
    assert scalar.replaced("foo -ba baz", 6, "bar") == ("foo -bar baz", 9) and scalar.completion_prefix("-(ab") == "ab"
    assert scalar.export_folder("a/b: c").endswith("_a_b_c") and scalar.export_folder("").endswith("_query")
    assert scalar.sigmoid_if_needed([0.2, 0.9]).max() == pytest.approx(0.9) and scalar.sigmoid_if_needed([-5, 5]).min() > 0
    assert scalar.signature({"a": 1}) != scalar.signature({"a": 2})


def test_settings(tmp_path):
    p = str(tmp_path / "s.yaml")
    s = config.Settings(roots=["/x"], top_k=5)
    config.save(s, p)
    assert config.load(p) == s and config.load(str(tmp_path / "none")) == config.Settings()
    (tmp_path / "bad").write_text("top_k: many\nroots: /y\ntagger: {thresholds: {character: 0.9}}")
    got = config.load(str(tmp_path / "bad"))
    assert got.top_k == 128 and got.roots == ["/y"] and got.tagger.thresholds[4] == 0.9


def draw(path, seed):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(images.encode_png((np.random.default_rng(seed).random((16, 16, 3)) * 255).astype(np.uint8)))


def test_listing(spark, tmp_path):
    for i, n in enumerate(("a.png", "_b.PNG", "sub/c.jpg", "sub/.hid/d.png", ".e.png", "out/f.png", "g.txt")):
        draw(tmp_path / n, i)
    got = sorted(r.path[len(str(tmp_path)) + 1 :] for r in listing.images(spark, [str(tmp_path), "/nowhere"], excluded=[str(tmp_path / "out")]).collect())
    assert got == ["_b.PNG", "a.png", "sub/c.jpg"]
    assert listing.images(spark, ["/nowhere"]).count() == 0
    found = listing.images(spark, [str(tmp_path)])
    assert listing.contents(found).filter("sha256 is not null").count() == found.count()
    assert listing.uncached(found, listing.cache_key(found, 448).filter("path like '%a.png'"), 448).count() == found.count() - 1


def test_listing_deals_folders_anew_at_each_level(spark, tmp_path):
    """One top folder with many folders is listed by all tasks; what is listed is what walking finds."""
    for i in range(120):
        folder = tmp_path / "top" / f"{i:03d}"
        folder.mkdir(parents=True)
        (folder / "x.png").write_bytes(b"x" * i)
    deep = tmp_path / "top" / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    (deep / "y.JPG").write_bytes(b"y")
    os.symlink(tmp_path / "top", tmp_path / "top" / "loop")
    found = listing.images(spark, [str(tmp_path / "top")], tasks=8)
    got = {r.path: r.size for r in found.collect()}
    root = os.path.realpath(tmp_path / "top")
    assert sorted(got) == sorted(listing.walk(root, [], listing.suffixes(None))) and len(got) == 121 and got[f"{root}/007/x.png"] == 7
    assert len(found.inputFiles()) >= 8
    assert listing.entries(str(tmp_path / "gone"), [], (".png",)) == ([], [])


def test_index_run_refresh_and_watch(spark, tmp_path):
    lib, cat = tmp_path / "lib", Catalog(spark, str(tmp_path / "cat"))
    draw(lib / "a.png", 1)
    draw(lib / "s" / "b.png", 2)
    assert indexing.run(cat, [str(lib)], tagging.DummyTagger, "sig") == {"scanned": 2, "new": 2, "changed": 0, "missing": 0, "queued": 2, "tagged": 2, "failed": 0}
    again = indexing.run(cat, [str(lib)], tagging.DummyTagger, "sig")
    assert again["queued"] == 0 and again["new"] == 0
    assert cat.read("file_tags").count() == 2 and {r.text for r in cat.read("fts_files").collect()} == {"dummy"}
    (lib / "a.png").unlink()
    draw(lib / "c.png", 3)
    got = indexing.refresh(cat, str(lib), tagging.DummyTagger, "sig")
    assert got == {"queued": 1, "tagged": 1, "missing": 1}
    assert {(r.width, r.height) for r in cat.read("files").filter("is_present = 1").collect()} == {(16, 16)}
    assert sorted((r.path.rsplit("/", 1)[1], r.is_present) for r in cat.read("files").collect()) == [("a.png", 0), ("b.png", 1), ("c.png", 1)]
    draw(lib / "d.png", 4)
    query = watch.watch(cat, str(lib), str(tmp_path / "ck"), tagging.DummyTagger, "sig", once=True)
    query.awaitTermination(120)
    assert cat.read("files").filter("is_present = 1 and width = 16 and height = 16").count() == 3 and cat.read("signatures").count() == 3
    assert cat.reset() and cat.read("files").count() == 0


class Broken:
    def prepare(self, images_):
        return images_

    def infer(self, batch):
        raise RuntimeError("broken")


def test_changed_files_whose_tagging_failed_are_tried_again(spark, tmp_path):
    lib, cat = tmp_path / "lib", Catalog(spark, str(tmp_path / "cat"))
    draw(lib / "a.png", 1)
    draw(lib / "b.png", 2)
    assert indexing.run(cat, [str(lib)], tagging.DummyTagger, "sig")["tagged"] == 2
    draw(lib / "a.png", 7)
    os.utime(lib / "a.png", (1, 1))
    assert indexing.run(cat, [str(lib)], Broken, "sig")["failed"] == 1
    again = indexing.run(cat, [str(lib)], tagging.DummyTagger, "sig")
    assert (again["queued"], again["tagged"]) == (1, 1)
    assert indexing.run(cat, [str(lib)], tagging.DummyTagger, "sig")["queued"] == 0


def test_writers_of_a_catalog(spark, tmp_path):
    """Of two writers that start from one version the second is refused; a fence keeps all but its holder out."""
    one, two = (Catalog(spark, str(tmp_path / "cat")) for _ in range(2))
    tag = lambda name: spark.createDataFrame([(1, name, 0)], "id bigint, name string, category int")
    one.publish({"tags": tag("a")}, base=0)
    with pytest.raises(Conflict):
        two.publish({"tags": tag("b")}, base=0)
    assert not two._create(f"{two.path}/versions/{1:012d}", "x") and [r.name for r in two.read("tags").collect()] == ["a"]
    with one.fence():
        with one.fence():
            one.publish({"tags": tag("c")}, base=1)
        for refused in (lambda: two.publish({"tags": tag("d")}), two.fence().__enter__):
            with pytest.raises(Conflict):
                refused()
    two.publish({"tags": tag("e")})
    assert [r.name for r in one.read("tags").collect()] == ["e"] and one.number() == 3
    (tmp_path / "cat" / ".left-behind").write_text("a writer that stopped before its pointer")
    assert one.number() == 3 and one.reset() and one.number() == 0 and one.read("tags").count() == 0


def test_older_catalogs_are_migrated(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    spark.createDataFrame([(1, "/a", 5)], "id long, path string, size long").write.parquet(str(tmp_path / "cat" / "old" / "files"))
    spark.createDataFrame([(1, "plum")], "rowid int, text string").write.parquet(str(tmp_path / "cat" / "old" / "fts"))
    pointer = lambda n, v: cat._create(f"{cat.path}/versions/{n:012d}", '{"version": "old", "schema": %d, "relations": {"files": "old/files", "fts_files": "old/fts"}}' % v)
    assert pointer(1, 1)
    row = cat.read("files").first()
    assert (row.is_present, row.tagger_sig, row.size) == (1, None, 5) and cat.read("fts_files").first().file_id == 1
    assert cat.migrate() and not cat.migrate() and cat.number() == 2
    assert cat.read("files").first().is_present == 1 and cat.read("files").schema == schema.FILES and cat.read("fts_files").first().text == "plum"
    assert pointer(3, 9)
    with pytest.raises(ValueError):
        cat.read("files")


def test_caches_make_each_thing_once(spark, tmp_path):
    draw(tmp_path / "lib" / "a.png", 1)
    draw(tmp_path / "lib" / "b.png", 2)
    (tmp_path / "lib" / "c.png").write_bytes(b"no picture")
    found = listing.images(spark, [str(tmp_path / "lib")])
    log = tmp_path / "log"

    def prepare(batch):
        with open(log, "a") as f:
            f.write("x" * len(batch))
        return [None if (a := images.decode(x)) is None else images.centre_crop(a, 8) for x in batch]

    where = str(tmp_path / "inputs")
    got = {r.path[-5:]: r.input for r in cache.inputs(found, where, prepare, 8).collect()}
    want = images.centre_crop(images.decode((tmp_path / "lib" / "a.png").read_bytes()), 8)
    assert (np.frombuffer(got["a.png"], "<f4").reshape(3, 8, 8) == want).all() and got["c.png"] is None and got["b.png"] != got["a.png"]
    assert len(log.read_text()) == 3
    draw(tmp_path / "lib" / "b.png", 3)
    os.utime(tmp_path / "lib" / "b.png", (5, 5))
    again = {r.path[-5:]: r.input for r in cache.inputs(listing.images(spark, [str(tmp_path / "lib")]), where, prepare, 8).collect()}
    assert again["a.png"] == got["a.png"] and again["b.png"] != got["b.png"] and len(log.read_text()) == 5
    small = cache.thumbnails(found, str(tmp_path / "thumbs"), 4).collect()
    assert sorted(images.dimensions(r.png) or (0, 0) for r in small) == [(0, 0), (4, 4), (4, 4)]
    one = next(r for r in small if r.path.endswith("a.png"))
    assert one.key == images.thumbnail_key(one.path, one.size, one.mtime, 4)


def test_components_leave_no_tables_behind(spark, tmp_path):
    from tagloom.operators.components import components, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    edges = spark.range(1, 200).selectExpr("id as a", "id + 1 as b")
    assert components(edges).select("root").distinct().count() == 1
    assert len(set(os.listdir(folder)) - before) == 1


def test_running_sums_of_a_large_group(spark):
    from tagloom.operators.ordering import running

    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id % 50 = 0 then 'few' else 'many' end as g", "id * 7919 % 3000 as v")
    got = running(rows, [F.desc("v")], {"n": F.lit(1), "s": F.col("v")}, ["g"]).collect()
    seen = {}
    for r in sorted(got, key=lambda r: -r.v):
        n, s = seen.get(r.g, (0, 0))
        seen[r.g] = n + 1, s + r.v
        assert (r.n, r.s) == seen[r.g]
    assert len(got) == 3000 and len(seen) == 3
    assert running(rows.limit(0), [F.col("v")], {"n": F.lit(1)}).count() == 0


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(0, "tag", 2, 0.7, 0.9)], "category int, name string, files long, avg_score double, max_score double")
    path = export.write_csv(export.stats_rows(rows), str(tmp_path / "x.txt"))
    assert path.endswith("x.csv") and open(path, encoding="utf-8-sig").read().splitlines() == ["Category,Tag,Files,AvgScore,MaxScore", "general,tag,2,0.700,0.900"]
    src = [tmp_path / d / "same.png" for d in "ab"]
    for i, s in enumerate(src):
        draw(s, i)
    targets = export.destinations(spark.createDataFrame([(i, str(s)) for i, s in enumerate(src)], "id long, path string"), str(tmp_path / "out"))
    assert export.copy_files(targets).filter("error is null").count() == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["same.png", "same_2.png"]


def test_metrics(spark):
    s = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.2)], "label int, ssim double")
    got = metrics.calibrate(s, "ssim").first()
    assert got.threshold == 0.8 and got.auc == pytest.approx(5 / 6) and got.average_precision == pytest.approx((1 + 1 + 0.75) / 3)
    r = metrics.nearest_rank(spark.range(1, 11).toDF("v"), "v").first()
    assert (r["mean"], r.p50, r.p95) == (5.5, 5, 10)


def test_empty_catalog(spark):
    files, tags, links = (schema.empty(spark, n) for n in ("files", "tags", "file_tags"))
    assert search.search(files, links, tags, "a -b", order="relevance").count() == 0
    assert stats.tag_stats(tags, links, files).count() == 0 and documents.rebuild(files, links, tags).count() == 0
    assert duplicates.clusters(duplicates.listing(files, schema.empty(spark, "signatures"))).count() == 0


def test_links_of_a_batch_are_dealt_to_as_many_tasks_as_they_need(spark, sf, tmp_path, monkeypatch):
    """Whatever the number of shuffle partitions; a file with half of the rows changes neither links nor the size of tasks."""
    from tagloom.plans import fixtures, registry

    for t in ("part", "orders"):
        os.symlink(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    one = rows.orderBy("l_orderkey", "l_partkey", "l_quantity").limit(1).withColumn("l_quantity", F.lit(None).cast("double"))
    rows.unionByName(one.crossJoin(spark.range(rows.count())).drop("id")).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(tuple(r) for r in fixtures.catalog(spark, str(tmp_path)).file_tags.collect())
    links = fixtures.catalog(spark, str(tmp_path), 400).file_tags
    assert sorted(tuple(r) for r in links.collect()) == want
    sizes = [r["count"] for r in links.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 25 and max(sizes) < 800
    monkeypatch.setattr(registry, "_LINKS_A_TASK", 400)
    plain = registry.queries()["q_write_batch_documents"](spark, str(tmp_path))
    assert plain.rdd.getNumPartitions() > 25
