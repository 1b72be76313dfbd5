"""What happens between a tagger's scores and stored links: merging, thresholds, caps, series labels, inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.functions import thresholds as thr
from tagloom.functions.scalar import sigmoid_if_needed
from tagloom.plans.query import CHARACTER, COPYRIGHT, META
from tagloom.sources import labels as label_files
from tagloom.sources.labels import Label

# Score floor, caps of the batched and the per-category models.
FLOOR, TOP_K, BASE_CAP = 0.1, 128, 64
SERIES_THRESHOLDS = {0: 0.4, 4: 0.8, 3: 0.8}
SERIES_CAPS = {0: 128, 4: 10, 3: 10}


def merged(predictions: DataFrame, key: str = "file_id") -> DataFrame:
    """One row a (file, trimmed name): the highest score, the earlier position among equals, with that row's category.

    predictions: key, position, name, score, category. Blank names are dropped.
    """
    rows = predictions.withColumn("name", F.trim("name")).filter("name <> ''")
    best = rows.groupBy(key, "name").agg(F.max_by(F.struct("score", "category"), F.struct("score", -F.col("position"))).alias("b"))
    return best.select(key, "name", "b.score", "b.category")


def capped(predictions: DataFrame, *, thresholds: Mapping[int, float] | None = None, caps: Mapping[int, int] | None = None, floor: float = FLOOR, top_k: int | None = TOP_K, base_cap: int | None = BASE_CAP, key: str = "file_id") -> DataFrame:
    """Predictions at or above floor and threshold; of each file and category the best ``cap``; of each file the best K.

    K is the least of top_k and the greater of base_cap and the sum of caps; None for base_cap sets no overall cap.
    Ties go to the earlier position. predictions: key, position, name, score, category.
    """
    caps = dict(caps or {})
    limit = F.greatest(F.lit(float(floor)), thr.by_category(F.col("category"), thresholds or {}, sorted(k for k in (thresholds or {}) if k >= 0)))
    order = [F.desc("score"), F.asc("position")]
    rows = predictions.filter(F.col("score") >= limit)
    most = None if base_cap is None else max(sum(caps.values()), base_cap)
    if top_k is not None:
        most = top_k if most is None else min(most, top_k)
    if most is not None:
        rows = rows.withColumn("__all", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__all") <= most).drop("__all")
    if caps:
        cap = F.element_at(F.create_map(*(F.lit(x) for k, v in caps.items() for x in (k, int(v)))), F.col("category"))
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key, "category").orderBy(*order))).filter(cap.isNull() | (F.col("__n") <= cap)).drop("__n")
    return rows


def with_series(predictions: DataFrame, labels: DataFrame, *, thresholds: Mapping[int, float] = SERIES_THRESHOLDS, caps: Mapping[int, int] = SERIES_CAPS, floor: float = FLOOR, top_k: int = TOP_K, key: str = "file_id") -> DataFrame:
    """Predictions with series carried over from their characters, re-tested and capped: key, name, score, category.

    predictions: key, name, score, category and, if there is one, position, which breaks ties. labels: name, category, ips
    (the series of a character). Of each file and category the best that pass are candidates; the series of candidate
    characters take the highest of their own score and those characters' scores, and the copyright category. Labels
    that are marked as placeholders (of rows without a name, category 5) are dropped. Of a file the best ``top_k`` stay, by score falling, then name.

    Rows are shuffled once, by file: every step after that works within a file.
    """

    def limit(category: Column) -> Column:
        return F.greatest(F.lit(float(floor)), thr.by_category(category, thresholds, sorted(k for k in thresholds if k >= 0)))

    def cap(category: Column) -> Column:
        most = F.create_map(*(F.lit(x) for k, v in caps.items() for x in (k, min(int(v), top_k)))) if caps else F.lit(None).cast("map<int,int>")
        return F.coalesce(F.element_at(most, category), F.lit(top_k))

    place = F.col("position") if "position" in predictions.columns else F.col("name")
    people = labels.filter(F.col("category") == CHARACTER).groupBy(F.col("name").alias("__who")).agg(F.first("ips").alias("__ips"))
    rows = predictions.select(key, "name", "score", "category", place.alias("__at"), (F.col("score") >= limit(F.col("category"))).alias("__hit")).repartition(key)
    n = F.row_number().over(Window.partitionBy(key, "category", "__hit").orderBy(F.desc("score"), "__at"))
    rows = rows.withColumn("__hit", F.col("__hit") & (n <= cap(F.col("category"))))
    rows = rows.join(people, (F.col("name") == F.col("__who")) & F.col("__hit") & (F.col("category") == CHARACTER), "left")
    series = F.transform(F.coalesce("__ips", F.array().cast("array<string>")), lambda s: F.struct(s.alias("name"), F.col("score").alias("carried"), F.lit(None).cast("double").alias("own"), F.lit(None).cast("struct<score:double,category:int>").alias("hit")))
    hit = F.when(F.col("__hit"), F.struct(F.col("score").cast("double").alias("score"), F.col("category").cast("int").alias("category")))
    itself = F.array(F.struct("name", F.lit(None).cast("double").alias("carried"), F.col("score").cast("double").alias("own"), hit.alias("hit")))
    parts = rows.select(key, F.explode(F.concat(itself, series)).alias("p")).groupBy(key, F.col("p.name").alias("name")).agg(F.max("p.carried").alias("carried"), F.max("p.own").alias("own"), F.max("p.hit").alias("hit"))
    parts = parts.filter("carried is not null or hit is not null")
    best = parts.select(key, "name", F.when(F.col("carried").isNotNull(), F.greatest("carried", "own")).otherwise(F.col("hit.score")).alias("score"), F.when(F.col("carried").isNotNull(), F.lit(COPYRIGHT)).otherwise(F.col("hit.category")).alias("category"))
    best = best.filter((F.trim("name") != "") & (F.col("score") >= limit(F.col("category"))))
    if "placeholder" in labels.columns:
        hidden = labels.filter("placeholder").select(F.col("name").alias("__hidden")).distinct()
        best = best.join(hidden, (F.col("name") == F.col("__hidden")) & (F.col("category") == META), "left_anti")
    order = [F.desc("score"), "name"]
    best = best.withColumn("__n", F.row_number().over(Window.partitionBy(key, "category").orderBy(*order))).filter(F.col("__n") <= cap(F.col("category")))
    return best.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= top_k).drop("__n")


def top_scores(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, falling; equal scores keep their order. Selection before sorting."""
    s = np.asarray(scores)
    if k <= 0 or not s.size:
        return np.zeros(0, np.int64)
    if k < s.size:
        floor = np.partition(s, s.size - k)[s.size - k]
        at = np.flatnonzero(s >= floor)
    else:
        at = np.arange(s.size)
    return at[np.argsort(-s[at], kind="stable")][:k]


def post_process(logits: np.ndarray, categories: np.ndarray, *, thresholds: Mapping[int, float] | None = None, caps: Mapping[int, int] | None = None, floor: float = FLOOR, top_k: int = TOP_K, base_cap: int = BASE_CAP) -> list[list[tuple[int, float]]]:
    """For a batch of score rows the (label, score) pairs that ``capped`` would keep, in NumPy."""
    scores = sigmoid_if_needed(logits)
    limit = np.maximum(floor, [float((thresholds or {}).get(int(c), 0.0)) for c in categories])
    caps = dict(caps or {})
    most = min(top_k, max(sum(caps.values()), base_cap))
    out = []
    for row in np.atleast_2d(scores):
        hits = np.flatnonzero(row >= limit)
        used: dict[int, int] = {}
        kept = []
        for i in hits[top_scores(row[hits], min(most, len(hits)))]:
            c = int(categories[i])
            used[c] = used.get(c, 0) + 1
            if c not in caps or used[c] <= caps[c]:
                kept.append((int(i), float(row[i])))
        out.append(kept)
    return out


def series_post_process(logits: np.ndarray, labels: Sequence[Label], *, thresholds: Mapping[int, float] | None = None, caps: Mapping[int, int] | None = None, floor: float = FLOOR, top_k: int = TOP_K) -> list[list[tuple[str, float, int]]]:
    """For a batch of score rows the (name, score, category) that ``with_series`` would keep, in NumPy."""
    thresholds, caps = SERIES_THRESHOLDS if thresholds is None else thresholds, SERIES_CAPS if caps is None else caps
    kinds = np.array([x.category for x in labels])
    limit = {int(c): max(floor, float(thresholds.get(int(c), 0.0))) for c in {*kinds.tolist(), COPYRIGHT}}
    at = {x.name: i for i, x in enumerate(labels)}
    hidden = {x.name for x in labels if x.placeholder}
    out = []
    for row in np.atleast_2d(sigmoid_if_needed(logits)):
        found: dict[str, tuple[float, int]] = {}
        carried: dict[str, float] = {}
        for c in np.unique(kinds).tolist():
            of = np.flatnonzero((kinds == c) & (row >= limit[c]))
            for i in of[top_scores(row[of], min(caps.get(c, top_k), top_k))]:
                found[labels[i].name] = (float(row[i]), c)
                for s in labels[i].ips if c == CHARACTER else ():
                    carried[s] = max(carried.get(s, 0.0), float(row[i]), float(row[at[s]]) if s in at else 0.0)
        found.update({s: (v, COPYRIGHT) for s, v in carried.items()})
        kept: list[tuple[str, float, int]] = []
        used: dict[int, int] = {}
        for name, (score, c) in sorted(found.items(), key=lambda x: (-x[1][0], x[0])):
            if score < limit[c] or not name.strip() or (c == META and name in hidden) or len(kept) >= top_k or used.get(c, 0) >= min(caps.get(c, top_k), top_k):
                continue
            used[c] = used.get(c, 0) + 1
            kept.append((name, score, c))
        out.append(kept)
    return out


# ---------------------------------------------------------------- taggers


class Tagger(Protocol):
    """What inference needs of a model: prepared inputs of paths or bytes, and predictions of prepared batches."""

    def prepare(self, images: Sequence[object]) -> list[object | None]: ...

    def infer(self, prepared: Sequence[object]) -> list[list[tuple[str, float, int]]]: ...


class DummyTagger:
    """The same tag for every image; makes whole runs possible without a model."""

    def __init__(self, name: str = "dummy", score: float = 0.9, category: int = 0):
        self.one = [(name, score, category)]

    def prepare(self, images: Sequence[object]) -> list[object | None]:
        return list(images)

    def infer(self, prepared: Sequence[object]) -> list[list[tuple[str, float, int]]]:
        return [list(self.one) for _ in prepared]


class OnnxTagger:
    """A classification model through onnxruntime, a score a label: pictures padded to a square, levels 0 to 255.

    ``attempts`` are lists of execution providers, tried in order until one makes a session; ``failed`` says why others didn't.
    """

    kind = "square"

    def __init__(self, path: str, labels: Sequence[Label], *, side: int = 448, attempts: Sequence[Sequence[str]] = (("CPUExecutionProvider",),), options: Mapping[str, Mapping[str, str]] | None = None, **how):
        self.session, self.failed = opened(path, attempts, options)
        outputs = [(x.name, x.shape[-1] if x.shape and isinstance(x.shape[-1], int) else None) for x in self.session.get_outputs()]
        self.output, width, _ = label_files.prediction_output(outputs, len(labels))
        if width is not None and width != len(labels):
            raise ValueError(f"the model gives {width} scores for {len(labels)} labels")
        self.input = self.session.get_inputs()[0]
        self.labels, self.side, self.how = list(labels), side, how

    def prepare(self, images: Sequence[object]) -> list[object | None]:
        from tagloom.functions import images as im

        return [None if x is None else im.padded_square(x, self.side) for x in images]

    def scores(self, prepared: Sequence[object]) -> np.ndarray:
        batch = np.stack(prepared).astype(np.float32)
        shape = self.input.shape
        if batch.shape[-1] == 3 and len(shape) == 4 and shape[1] == 3:
            batch = batch.transpose(0, 3, 1, 2)
        return self.session.run([self.output], {self.input.name: batch})[0]

    def infer(self, prepared: Sequence[object]) -> list[list[tuple[str, float, int]]]:
        kinds = np.array([x.category for x in self.labels])
        return [[(self.labels[i].name, s, self.labels[i].category) for i, s in row] for row in post_process(self.scores(prepared), kinds, **self.how)]


class SeriesTagger(OnnxTagger):
    """A model that also knows which series a character is from: pictures cropped in the middle, series carried over."""

    kind = "series"

    def prepare(self, images: Sequence[object]) -> list[object | None]:
        from tagloom.functions import images as im

        rgb = [im.decode(x) if isinstance(x, bytes | bytearray) else x for x in images]
        return [None if x is None else im.centre_crop(x, self.side) for x in rgb]

    def infer(self, prepared: Sequence[object]) -> list[list[tuple[str, float, int]]]:
        return series_post_process(self.scores(prepared), self.labels, **self.how)


def opened(path: str, attempts: Sequence[Sequence[str]], options: Mapping[str, Mapping[str, str]] | None = None) -> tuple[object, list[str]]:
    """A session by the first list of providers that works, and what went wrong with those before it."""
    import onnxruntime

    failed: list[str] = []
    for some in attempts:
        try:
            return onnxruntime.InferenceSession(path, providers=[(p, dict((options or {}).get(p, {}))) for p in some]), failed
        except Exception as e:  # noqa: BLE001  whatever keeps a provider from starting, the next is tried
            failed.append(f"{', '.join(some)}: {e}")
    raise RuntimeError("no execution provider works: " + "; ".join(failed))


def resolve(name: str, model: str | None = None, tags_csv: str | None = None, *, kind: str = "auto", device: str = "auto", places: Mapping[str, int] | None = None, options: Mapping[str, Mapping[str, str]] | None = None, **how) -> Callable[[], Tagger]:
    """A factory for the named tagger, called once a task: ``dummy``, or ``onnx``, a model with its label file.

    kind: ``square``, ``series``, or ``auto``, which goes by the model's outputs, then by whether labels name series.
    device: ``auto``, ``cpu``, ``cuda`` or ``tensorrt``. places: the labels' order as the model has it.
    """
    if name == "dummy":
        return DummyTagger
    if name not in ("onnx", "wd14-onnx"):
        raise ValueError(f"unknown tagger {name!r}")
    if not model:
        raise ValueError(f"the tagger {name!r} needs a model")
    found = label_files.discover(model, tags_csv)
    if found is None:
        raise FileNotFoundError(f"no label file for {model}")
    names = label_files.load(found)
    names = label_files.reordered(names, places) if places else names
    if kind == "auto":
        kind = label_files.kind_of(model, names)
    made = {"square": OnnxTagger, "series": SeriesTagger}[kind]
    attempts = label_files.attempts(label_files.wanted(device)).attempts
    return lambda: made(model, names, attempts=attempts, options=options, **how)


def _halving(infer: Callable, batch: list, failed: list) -> list:
    """Results of a batch; where it fails, of its halves; None for single images that fail."""
    try:
        return infer(batch)
    except Exception as e:  # noqa: BLE001  any failure of a model is met the same way
        if len(batch) == 1:
            failed.append(str(e))
            return [None]
        m = len(batch) // 2
        return _halving(infer, batch[:m], failed) + _halving(infer, batch[m:], failed)


def tag(images: DataFrame, make: Callable[[], Tagger], *, batch: int = 32, column: str = "content") -> DataFrame:
    """file_id, tags, error, width, height of images (file_id, <column>): the model is made once a task, batches are halved
    on failure. Sizes are those of the file's header, null where it has none."""
    from tagloom.functions.images import dimensions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                ready = model.prepare(list(part[column]))
                at = [j for j, x in enumerate(ready) if x is not None]
                failed: list[str] = []
                got = _halving(model.infer, [ready[j] for j in at], failed) if at else []
                tags: list = [None] * len(part)
                for j, g in zip(at, got, strict=True):
                    tags[j] = None if g is None else [{"name": n, "score": float(s), "category": int(c)} for n, s, c in g]
                why = [None if t is not None else "unreadable" if r is None else failed[0] for t, r in zip(tags, ready, strict=True)]
                sizes = [dimensions(x) or (None, None) for x in part[column]]
                out = pd.DataFrame({"file_id": part["file_id"].to_numpy(), "tags": tags, "error": why})
                yield out.assign(width=pd.array([w for w, _ in sizes], "Int32"), height=pd.array([h for _, h in sizes], "Int32"))

    return images.select("file_id", column).mapInPandas(run, "file_id bigint, tags array<struct<name:string,score:double,category:int>>, error string, width int, height int")


def failures(tagged: DataFrame) -> DataFrame:
    """error, count and a sample of each kind of failure: the least path, or file where rows have no path."""
    sample = "path" if "path" in tagged.columns else "file_id"
    return tagged.filter("error is not null").groupBy("error").agg(F.count("*").alias("count"), F.min(sample).alias("sample"))
