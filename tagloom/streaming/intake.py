"""Tagging of arriving images as keyed state: each path is tried until it succeeds or has failed often enough.

The state of a path is what its file looked like and how often it has failed. While it waits it is in flight: the same
file noticed again changes nothing, another size or time starts anew. A failure sets a timer that doubles each time; when
it fires the file is read from its path again, so what was half written is whole then. State lives in the query's
checkpoint, so that a restart, on other executors, too, goes on where it stopped.

What comes out is a row a path for each thing to store: the first failure (the file is there, its tags are not), success,
and the last failure with its error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.functions import images
from tagloom.operators.tagging import Tagger

STATE = "size bigint, mtime double, tries int"
OUT = "path string, size bigint, mtime double, sha256 string, tags array<struct<name:string,score:double,category:int>>, error string, width int, height int, phash_u64 bigint, dhash_u64 bigint, tries int"
COLUMNS = [x.split(" ")[0] for x in OUT.replace(",score", ";score").replace(",category", ";category").split(", ")]


class _Made:
    """A model that is made once a task, where it is first needed."""

    def __init__(self, make: Callable[[], Tagger]):
        self.make, self.model = make, None

    def __getstate__(self) -> dict[str, Any]:
        return {"make": self.make, "model": None}

    def __call__(self) -> Tagger:
        if self.model is None:
            self.model = self.make()
        return self.model


def attempt(model: Callable[[], Tagger], data: bytes | None) -> dict[str, Any]:
    """tags or error, size of the picture and signatures of one file's contents."""
    out: dict[str, Any] = dict.fromkeys(COLUMNS)
    if data is None:
        return {**out, "error": "unreadable"}
    out["sha256"] = hashlib.sha256(data).hexdigest()
    out["width"], out["height"] = images.dimensions(data) or (None, None)
    picture = images.decode(data)
    if picture is not None:
        out["phash_u64"], out["dhash_u64"] = images.phash(picture), images.dhash(picture)
    try:
        ready = model().prepare([data])[0]
        if ready is None:
            return {**out, "error": "unreadable"}
        out["tags"] = [{"name": n, "score": float(s), "category": int(c)} for n, s, c in model().infer([ready])[0]]
    except Exception as e:  # a tagger may fail in any way: the file is tried again
        out["error"] = str(e) or type(e).__name__
    return out


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def tried(stream: DataFrame, make: Callable[[], Tagger], *, tries: int = 5, wait: float = 60.0) -> DataFrame:
    """The rows to store (see OUT) of a stream of path, size, mtime, content; ``wait``: seconds after the first failure."""
    model = _Made(make)

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (path,) = key
        if state.hasTimedOut:
            size, mtime, failed = state.get
            data = _read(path)
        else:
            size = mtime = data = None
            for f in frames:
                for r in f.itertuples(index=False):
                    if mtime is None or (r.mtime, r.size) >= (mtime, size):
                        size, mtime, data = int(r.size), float(r.mtime), r.content
            failed = 0
            if state.exists and state.get[:2] == (size, mtime):
                # In flight: the timer that was set still holds, but has to be set again to outlast this call.
                state.setTimeoutDuration(_pause(state.get[2], wait))
                return
        got = attempt(model, data)
        failed += got["tags"] is None
        if got["tags"] is not None or failed >= tries:
            if state.exists:
                state.remove()
        else:
            state.update((size, mtime, failed))
            state.setTimeoutDuration(_pause(failed, wait))
        if got["tags"] is not None or failed in (1, tries):
            row = pd.DataFrame([{**got, "path": path, "size": size, "mtime": mtime, "tries": failed}], columns=COLUMNS)
            yield row.astype({c: "Int64" for c in ("size", "width", "height", "phash_u64", "dhash_u64", "tries")})

    return stream.groupBy("path").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _pause(failed: int, wait: float) -> int:
    """Milliseconds until a path that failed so often is tried again."""
    return max(1, int(wait * 1000 * 2 ** max(0, failed - 1)))
