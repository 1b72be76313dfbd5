"""Byte-level BPE by a rank file: encoding and decoding as reductions over a tree of text halves.

Encoding is a monoid: a text is cut in halves until a leaf is short, leaves are encoded match by match, and neighbours
are joined by encoding the text around the seam anew. Two facts prove everything outside that window stable:

* The pattern has no look-behind, so a match depends only on the text from its start on, and the ids of a match only
  on the match. Matches of the left half that were found without reading its end are matches of the whole.
* Once a match of the whole ends where a match of the right half starts, every later match of the right half is a
  match of the whole.

The window starts at the end of the last match that the first fact protects and grows match by match until the second
fact holds, or to the end of the right half. How far a match reads beyond its end is known of the public pattern only,
so any other is refused. Decoding concatenates the bytes of the ids up the same kind of tree.

Defined results: null counts as empty; an empty text has no ids; texts of any length; repeated rows and ids keep a row
each; an empty table gives none; further columns are kept only where ``carry`` names them, those whose names clash with
a result's, in any case, are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Characters of a leaf: ordinary documents go through several levels of the tree.
LEAF = 512
#: Matches whose ids a worker process remembers; beyond that it starts afresh.
MEMORY = 200_000
#: White space of the rank files' library: the Unicode property, without the separators U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_coders: dict[tuple[str, str], Coder] = {}


class Coder:
    """The ranks of one file with one pattern."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import public_tokenizers
        import regex
        import tiktoken

        if pattern != public_tokenizers.PATTERN:
            raise ValueError("the seams of the tree are proven for the public pattern only")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = re.sub(r"(\[\^?[^\]]*)\\s", lambda m: m[1] + SPACE, pattern)
        self.match = regex.compile(inside.replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.space = regex.compile(f"[{SPACE}]*")
        self.leaf, self.joins = max(1, leaf), 0
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for _, ids in self._tree(text, 0, len(text)):
            out += ids
        return out

    def _ids(self, match: str) -> list[int]:
        ids = self.known.get(match)
        if ids is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            ids = self.encoding.encode_ordinary(match)
            if len(match) <= 64:
                self.known[match] = ids
        return ids

    def _tree(self, text: str, a: int, b: int) -> list[tuple[int, list[int]]]:
        """(end, ids) of each match of text[a:b]."""
        if b - a <= self.leaf:
            return [(f.end(), self._ids(f.group())) for f in self.match.finditer(text, a, b)]
        m = (a + b) // 2
        return self._join(text, a, m, b, self._tree(text, a, m), self._tree(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list, right: list) -> list:
        self.joins += 1
        keep = len(left)
        while keep and self._read(text, left[keep - 1][0], m) >= m:
            keep -= 1
        start = left[keep - 1][0] if keep else a
        seam, drop = [], 0
        for f in self.match.finditer(text, start, b):
            end = f.end()
            seam.append((end, self._ids(f.group())))
            while drop < len(right) and right[drop][0] < end:
                drop += 1
            if end == m:
                break
            if drop < len(right) and right[drop][0] == end:
                drop += 1
                break
        del left[keep:]
        left += seam
        left += right[drop:] if drop else right
        return left

    def _read(self, text: str, end: int, m: int) -> int:
        """A place that matching up to ``end`` didn't read beyond: the first character after white space, two more for a suffix such as 're."""
        return self.space.match(text, end, m).end() + 2

    def decode(self, ids: list[int], a: int = 0, b: int | None = None) -> bytes:
        b = len(ids) if b is None else b
        if b - a <= self.leaf:
            return self.encoding.decode_bytes(ids[a:b])
        m = (a + b) // 2
        return self.decode(ids, a, m) + self.decode(ids, m, b)


def coder(path: str, pattern: str) -> Coder:
    key = (path, pattern)
    if key not in _coders:
        _coders[key] = Coder(path, pattern)
    return _coders[key]


def encode(docs: DataFrame, *, path: str, pattern: str, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ids (array<int>) of each text, or with ``digest`` n_tokens and the digests of ids and decoded bytes."""
    common.ship(docs.sparkSession)
    own = {"doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    kept = [c for c in carry if c.lower() not in own]
    frame = docs.select("doc_id", docs["text"].cast("string").alias("__text"), *kept)
    tail = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    schema = docs.sparkSession.createDataFrame([], f"doc_id bigint, {tail}").schema
    for c in kept:
        schema = schema.add(c, frame.schema[c].dataType, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = coder(path, pattern)
        text_of = [str(i) for i in range(k.encoding.n_vocab)]
        for b in common.chunks(batches, "__text", common.SMALL_CHUNK):
            n, first, second, lists = [], [], [], []
            for t in common.column(b, "__text").to_pylist():
                ids = k.encode(t or "")
                if digest:
                    n.append(len(ids))
                    first.append(hashlib.sha256(",".join([text_of[i] for i in ids]).encode()).hexdigest())
                    second.append(hashlib.sha256(k.decode(ids)).hexdigest())
                else:
                    lists.append(ids)
            more = [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())] if digest else [pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), *more, *(common.column(b, c) for c in kept)], names=schema.names)

    return frame.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """doc_id and text of each row of ids; bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""
    common.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = coder(path, pattern)
        for b in batches:
            texts = [None if x is None else k.decode(x).decode("utf-8", "replace") for x in common.column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
