"""Components by contraction and pairs of vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import cosine, duplicates
from tagloom.operators.components import components


def brute_roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed", range(4))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(rng.choice([60, 150, 220, 400]))]
    edges += [(1000, x) for x in range(1001, 1100)] + [(5, 5), (2000, 2001), (2000, 2001), (2001, 2000), (-7, 3)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.id: r.root for r in got.collect()} == brute_roots(edges) and got.count() == got.select("id").distinct().count()


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).count() == 0


def test_a_long_path_shrinks_each_round(spark):
    """A path in the order of its ids and one in any order, with a hub on it: edges fall by half and more each round."""
    n = 60_000
    ids = list(range(n))
    path = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    hub = spark.range(20_000).selectExpr(f"id + {n} as a", "5 as b")
    sizes: list[int] = []
    got = components(path.union(hub), sizes=sizes)
    assert got.count() == n + 20_000 and got.filter("root <> 0").count() == 0
    assert len(sizes) <= 13 and all(b < 0.6 * a for a, b in zip(sizes, sizes[1:], strict=False))
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame(list(zip(ids[:3000], ids[1:3001], strict=True)), "a bigint, b bigint")
    assert components(rows).filter(f"root <> {min(ids[:3001])}").count() == 0


def brute_pairs(rows, least):
    out = set()
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and i != j and cosine._cosine(a, b) >= least:
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize(("least", "pivots", "block"), [(0.2, 8, 10), (0.9, 8, 4096), (-0.5, 3, 50), (1.0, 4, 7)])
def test_pairs_of_vectors(spark, least, pivots, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.3 * rng.normal(size=6)]) for i in range(90)]
    rows += [(100, [1.0, 2.0]), (101, [2.0, 4.0]), (102, [0.0, 0.0]), (103, None), (104, []), (105, [1.0, None]), (106, [1.0, float("nan")]), (107, [float("inf"), 1.0]), (108, [1.0, -2.0]), (110, rows[0][1]), (111, rows[0][1])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = cosine.similar(df, least, pivots=pivots, block=block).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    want = brute_pairs(rows, least)
    assert {(r.a, r.b) for r in got} == want  # that of 1 as far as sums in order give it
    assert cosine.similar(df.limit(0), least).count() == 0


def test_cells_that_lie_apart_never_meet():
    pivots = {2: np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])}
    blocks, meets = cosine.plan([(2, 0, 10, 0.1), (2, 1, 25, 0.1), (2, 2, 5, 0.1)], pivots, 0.9, 10)
    assert blocks == {(2, 0): 1, (2, 1): 3, (2, 2): 1}
    assert meets == [(2, 0, [(0, 1)]), (2, 1, [(1, 3)]), (2, 2, [(2, 1)])]
    _, meets = cosine.plan([(2, 0, 10, 0.1), (2, 1, 25, 0.8), (2, 2, 5, 0.1)], pivots, 0.5, 10)
    assert meets == [(2, 0, [(0, 1), (1, 3)]), (2, 1, [(1, 3), (2, 1)]), (2, 2, [(2, 1)])]


@pytest.mark.parametrize("seed", range(3))
def test_a_forest_has_the_clusters_and_distances_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    hashes = [0b1, 0b11, 0b111, 0b1111 << 20, (0b1111 << 20) | 1, 1 << 40, (1 << 40) | (1 << 63) - 1 & 0xF0]
    rows = [(i, rng.choice(hashes), rng.choice([None, 0, 100, 150, 240, 1000, 1900, 9000, rng.randrange(1, 20_000)])) for i in range(140)]
    df = spark.createDataFrame(rows, "id bigint, phash bigint, size bigint").repartition(5)
    for ratio in (0.5, 0.9):
        some, every = duplicates.forest(df, limit=4, ratio=ratio), duplicates.edges(df, limit=4, ratio=ratio)
        sets = [{(r.a, r.b, r.hamming) for r in e.collect()} for e in (some, every)]
        assert sets[0] <= sets[1] and len(sets[0]) < len(sets[1])
        assert brute_roots([e[:2] for e in sets[0]]) == brute_roots([e[:2] for e in sets[1]])
        best = [{}, {}]
        for b, found in zip(best, sets, strict=True):
            for x, y, d in found:
                b[x], b[y] = min(d, b.get(x, 99)), min(d, b.get(y, 99))
        assert best[0] == best[1]


def test_ten_thousand_copies_make_a_forest(spark):
    df = spark.range(10_000).select("id", F.lit(7).cast("bigint").alias("phash"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) + 1).alias("size"))
    found = duplicates.forest(df, limit=8, ratio=0.5)
    assert 9_900 < found.count() < 10_000


@pytest.mark.parametrize("ratio", [0.5, 0.9, 1.0, 1.5])
def test_class_edges_say_what_all_pairs_say(spark, ratio):
    """Links found again from classes, their pairs and sizes are those of all pairs; clusters, too."""
    rng = random.Random(5)
    hashes = [0b1, 0b11, 0b111, 0b1111 << 20, (0b1111 << 20) | 1, 1 << 40, (1 << 40) | (1 << 63) - 1 & 0xF0]
    rows = [(i, rng.choice(hashes), rng.choice([None, 0, 100, 150, 200, 240, 1000, 1900, 9000, rng.randrange(1, 20_000)])) for i in range(140)]
    df = spark.createDataFrame(rows, "id bigint, phash bigint, size bigint").repartition(5)
    got = duplicates.class_edges(df, limit=4, ratio=ratio).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    first = {r.b: r.a for r in got if r.member}
    near = {(r.a, r.b): r.hamming for r in got if not r.member}
    size = {i: s or 0 for i, _, s in rows}
    found = set()
    for i in size:
        for j in range(i + 1, len(rows)):
            a, b = sorted((first.get(i, i), first.get(j, j)))
            if (a == b or (a, b) in near) and (not size[i] or not size[j] or min(size[i], size[j]) / max(size[i], size[j]) >= ratio):
                found.add((i, j, near.get((a, b), 0)))
    every = {(r.a, r.b, r.hamming) for r in duplicates.edges(df, limit=4, ratio=ratio).collect()}
    assert found == every
    files = df.select("*", F.concat(F.lit("/f"), "id").alias("path"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    members = duplicates.clusters(files, limit=4, ratio=ratio).collect()
    roots = brute_roots([e[:2] for e in every])
    assert {r.id: r.cluster for r in members} == dict(roots)
    best = {}
    for x, y, d in every:
        best[x], best[y] = min(d, best.get(x, 99)), min(d, best.get(y, 99))
    assert {r.id: r.best_hamming for r in members} == best


@pytest.mark.parametrize(("ratio", "blanks"), [(0.5, 0), (0.5, 2), (0.8, 0), (None, 1)])
def test_runs_of_sizes_give_the_clusters_of_all_pairs(spark, monkeypatch, ratio, blanks):
    """Members, distances and positions as in plain Python; and few links, whose number doesn't grow with copies of a hash."""
    rng = random.Random(11)
    heads = [(i << 48) | ((1 << i % 4) - 1) << 4 | (i // 4) << 20 for i in range(40)] + [5, 7, 15]
    rows = [(i, rng.choice(heads), int(10 ** rng.uniform(2, 9))) for i in range(60)] + [(60 + i, 1 << 62 | 1 << i % 2, int(10 ** rng.uniform(3, 6))) for i in range(120)]
    rows += [(200 + i, h, rng.choice([None, 0, -3])) for i, h in enumerate(rng.sample([h for _, h, _ in rows[:60]], blanks))] + [(300, None, 7)]
    size = {i: s if s and s > 0 else 0 for i, _, s in rows}
    every = []
    for i, p, _ in rows:
        for j, q, _ in rows:
            if i < j and p is not None and q is not None and (d := (p ^ q).bit_count()) <= 4 and any(p >> k & 65535 == q >> k & 65535 for k in (0, 16, 32, 48)):
                if not ratio or not size[i] or not size[j] or min(size[i], size[j]) / max(size[i], size[j]) >= ratio:
                    every.append((i, j, d))
    seen = []
    real = duplicates.components
    monkeypatch.setattr(duplicates, "components", lambda links: seen.append(links.filter("a between 60 and 179 and b between 60 and 179").count()) or real(links))
    files = spark.createDataFrame(rows, "id bigint, phash bigint, size bigint").repartition(3).select("*", F.concat(F.lit("/f"), "id", F.lit(".png")).alias("path"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    members = duplicates.clusters(files, limit=4, ratio=ratio).collect()
    roots = dict(brute_roots([e[:2] for e in every]))
    assert {r.id: r.cluster for r in members} == roots
    best = {}
    for x, y, d in every:
        best[x], best[y] = min(d, best.get(x, 99)), min(d, best.get(y, 99))
    assert {r.id: r.best_hamming for r in members} == best
    raw = {i: s or 0 for i, _, s in rows}
    want, firsts = {}, {}
    for c in set(roots.values()):
        ids = [i for i, r in roots.items() if r == c]
        keeper = min(ids, key=lambda i: (-raw[i], f"f{i}.png", i))
        ids.sort(key=lambda i: (i != keeper, -raw[i], f"f{i}.png", i))
        firsts[c] = (-max(raw[i] for i in ids), f"/f{ids[0]}.png", c)
        want |= {i: (n, int(n == 1)) for n, i in enumerate(ids, 1)}
    assert {r.id: (r.position, r.is_keeper) for r in members} == want
    assert {r.cluster: r.group for r in members} == {c: n for n, c in enumerate(sorted(firsts, key=firsts.get), 1)}
    assert seen[0] < 25  # of the 120 files of two hashes; links of their classes were 58 and 92
