"""Order MinHash fingerprints of documents, whose likeness falls with edit distance and not only with set overlap.

A text's K-mers of code points carry their occurrence numbers. Each of HASHES hash functions selects the two
smallest; these keep their order in the text, and the ordered pair is hashed to 16 bits of the fingerprint. Two
fingerprints are as alike as the share of entries that agree.

`with_edits` also fingerprints an edited text per document: the last third of its code points replaced by the first
ones of the next document in descending id order (after the last: the first). Documents go to sorted ranges, each
task walks its own, and only a range's first and last document meet another task: one row of each per range.

Null text is empty; a text shorter than K is one K-mer; the empty text has a fingerprint of its own. Equal ids are
ordered by a hash of the text, and equal rows by their numbers, so they can spread over ranges too; null ids come last. A
text is looked at as a whole, with about 60 bytes of memory for each code point. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize, narrow, ship_package
from quillmark.llm.textvec import U64, mix

#: Code points of a K-mer, hash functions, and K-mers hashed at once.
K, HASHES, BLOCK = 8, 64, 1 << 14

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROLL = [U64(pow(0xD1342543DE82EF95, e, 1 << 64)) for e in range(K + 1)]
_ROW = np.arange(HASHES)


def numbered_kmers(text: str) -> np.ndarray:
    """64-bit hashes of a text's K-mers with their occurrence numbers, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
    n = len(codes)
    if n == 0:
        return np.empty(0, U64)
    if n < K:
        return mix(np.array([sum(int(c) * int(_ROLL[i + 1]) for i, c in enumerate(codes)) + n & (1 << 64) - 1], U64))
    x = codes[: n - K + 1] * _ROLL[K]
    for k in range(1, K):
        x = x + codes[k : n - K + 1 + k] * _ROLL[K - k]
    x = mix(x)
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    number = np.empty(len(s), U64)
    number[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U64)
    return mix(x + number * U64(0x9E3779B97F4A7C15))


def _smallest(x: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Per hash function the two smallest values among x, and their places counted from `begin`."""
    value = np.full((HASHES, 2), 1 << 32, np.int64)
    place = np.full((HASHES, 2), -1, np.int64)
    for a in range(0, len(x), BLOCK):
        h = ((x[a : a + BLOCK] >> U64(32)).astype(np.uint32)[None, :] ^ _XOR) * _MULTIPLY
        for _ in range(min(2, h.shape[1])):
            at = h.argmin(axis=1)
            v = h[_ROW, at].astype(np.int64)
            h[_ROW, at] = 0xFFFFFFFF
            value, place = _two(value, place, v[:, None], (at + a + begin)[:, None])
    return value, place


def _two(value: np.ndarray, place: np.ndarray, more: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, place = np.concatenate([value, more], axis=1), np.concatenate([place, places], axis=1)
    order = np.lexsort((np.where(place < 0, 1 << 60, place), value), axis=1)[:, :2]
    return np.take_along_axis(value, order, 1), np.take_along_axis(place, order, 1)


def _entries(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The 16-bit hashes of the selected K-mers in text order."""
    place = np.sort(place, axis=1)
    picked = np.where(place >= 0, x[place] if len(x) else U64(0), U64(0))
    return (mix(picked[:, 0] * _ROLL[2] + picked[:, 1] * _ROLL[1]) >> U64(48)).astype(">u2")


def fingerprint(text: str) -> np.ndarray:
    x = numbered_kmers(text)
    return _entries(x, _smallest(x, 0)[1])


def edited_fingerprint(text: str, x: np.ndarray, other: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Fingerprints of a text with K-mers x and of its edited form, and that form. What both begin with is hashed once."""
    m = len(text) // 3
    edited = text[: len(text) - m] + other[:m]
    if len(text) < 3 * K or len(edited) < K:
        return fingerprint(text), edited, fingerprint(edited)
    y = numbered_kmers(edited)
    shared = len(text) - m - K + 1
    front = _smallest(x[:shared], 0)
    own = _two(*front, *_smallest(x[shared:], shared))[1]
    new = _two(*front, *_smallest(y[shared:], shared))[1]
    return _entries(x, own), edited, _entries(y, new)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in _NAMES[2:5]), *((c, pa.float64()) for c in _NAMES[5:])])
_WALK = _TYPES.append(pa.field("kind", pa.int32())).append(pa.field("part", pa.int32())).append(pa.field("text", pa.string()))


def _pair(doc_id: int | None, text: str, following: str, x: np.ndarray, y: np.ndarray | None) -> dict:
    """The result row of a document and the next one's text and fingerprint."""
    own, edited, changed = edited_fingerprint(text, x, following)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": own.tobytes().hex(),
        "edited_fingerprint": changed.tobytes().hex(),
        "near_edited": likeness(own, changed),
        "_own": own,
    }


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all documents of a sorted range but its last; its first and last document go along with their texts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last: tuple | None = None  # id, text and K-mers
    waiting: dict | None = None  # a row that lacks the likeness to the next fingerprint
    for batch in batches:
        rows: list[dict] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            x = numbered_kmers(text)
            if last is None:
                rows.append({"kind": 1, "part": part, "text": text})
            else:
                row = _pair(*last[:2], text, last[2], None)
                if waiting is not None:
                    rows.append(waiting | {"near_next": likeness(waiting["_own"], row["_own"])})
                waiting = row | {"kind": 0, "part": part}
            last = (doc_id, text, x)
        for r in rows:
            r.pop("_own", None)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _WALK)
    if last is not None:
        rows = [{"kind": 2, "part": part, "doc_id": last[0], "text": last[1]}]
        if waiting is not None:
            rows.append(waiting | {"near_next": likeness(waiting["_own"], fingerprint(last[1]))})
            rows[-1].pop("_own")
        yield pa.RecordBatch.from_pylist(rows, _WALK)


def _seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            row = _pair(r["doc_id"], r["text"], r["following"], numbered_kmers(r["text"]), None)
            rows.append(row | {"near_next": likeness(row.pop("_own"), fingerprint(r["following"]))})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _TYPES)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document."""
    ship_package(docs.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("row")]
    rows = narrow(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    walked = materialize(ranges.mapInArrow(_walk, f"{_OUT}, kind int, part int, text string"), "omh-walk")
    heads = walked.where("kind = 1").select("part", F.col("text").alias("following"))
    # one row per range; the range after the last is the first
    parts = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("part").over(parts), F.min("part").over(Window.partitionBy())).alias("next"))
    tails = walked.where("kind = 2").select("part", "doc_id", "text").join(after, "part")
    seams = tails.drop("part").join(heads, F.col("next") == F.col("part")).select("doc_id", "text", "following")
    return walked.where("kind = 0").select(*_NAMES).unionByName(seams.mapInArrow(_seam, _OUT))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hex) of each document."""
    ship_package(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t).tobytes().hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return narrow(docs, id_col, text_col).mapInArrow(each, "doc_id long, fingerprint string")
