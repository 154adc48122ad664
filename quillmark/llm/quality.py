"""Document quality by hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of other signs. Features, hashed to 2**BITS places: token n-grams of
one and two, and n-grams of one to three token shapes (case, digits, the sign run itself, and whether a word repeats
the one before). A document's vector holds square roots of counts, scaled to length one; its score is the sigmoid of
the sparse dot product with the weights. Texts are read whole, both to fit and to score.

Null text is empty; a text without tokens gets the score of the bias alone. Repeated rows get equal scores. Without
usable labels all scores are 0.5. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import narrow, ship_package
from quillmark.llm.ftrl import Ftrl, distinct_per_row, row_sums, sigmoid
from quillmark.llm.labels import MAX_TRAIN, training_rows
from quillmark.llm.textvec import SPACE, U64, WORDY, mix, span_hashes, steps, take_rows, text_bytes

BITS = 18
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERED = np.zeros(256, bool)
_LOWERED[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of texts in a row: features, values, row offsets."""
    rows = len(offsets) - 1
    kind = np.where(SPACE[data], 0, np.where(WORDY[data], 1, 2)).astype(np.int8)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    change = first[: len(data)].copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0), np.zeros(rows + 1, np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    word = kind[starts] == 1
    h = span_hashes(data, starts, ends)

    def some(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[ends] - sums[starts]

    upper, lower, digit = some(_UPPER), some(_LOWERED), some(_DIGIT)
    shape = np.where(digit > 0, 5, np.where((upper > 0) & (lower == 0), np.where(upper > 1, 4, 3), np.where(upper > 0, 2, 1)))
    at = np.flatnonzero(word)
    repeats = np.zeros(len(h), bool)
    repeats[at[1:]] = (h[at[1:]] == h[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
    shape = np.where(word, (shape + 8 * repeats).astype(U64), h)
    mask = U64((1 << BITS) - 1)
    out, of = [mix(h) & mask], [row]
    for x, most, seed in ((h, 2, 101), (shape, 3, 211)):
        gram = x
        if seed == 211:
            out.append(mix(gram + U64(seed)) & mask)
            of.append(row)
        for n in range(2, most + 1):
            gram = mix(gram[:-1] * U64(0x9E3779B97F4A7C15) + x[n - 1 :])
            same = row[n - 1 :] == row[: len(row) - n + 1]
            out.append(mix(gram[same] + U64(seed + n)) & mask)
            of.append(row[n - 1 :][same])
    feature, count, cut = distinct_per_row(np.concatenate(out).astype(np.int64), np.concatenate(of), rows, BITS)
    value = np.sqrt(count)
    norm = np.sqrt(np.maximum(row_sums(value * value, cut), 1.0))
    return feature, value / np.repeat(norm, np.diff(cut)), cut


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", epochs: int = 3, max_rows: int = MAX_TRAIN) -> np.ndarray:
    """Weights, the bias last, fitted in one task on a bounded sample of labelled documents."""
    ship_package(docs.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            if len(rows) >= max_rows:
                continue
            data, offsets = text_bytes(batch.column("text"))
            label = batch.column(label_col).to_pylist()
            for a, b in steps(offsets):
                feature, value, cut = features(*take_rows(data, offsets, a, b))
                rows += [(feature[cut[i] : cut[i + 1]].astype(np.int32), value[cut[i] : cut[i + 1]].astype(np.float32), label[a + i]) for i in range(b - a)]
        rows = rows[:max_rows]
        model = Ftrl(1 << BITS, alpha=0.5, l1=0.02, l2=0.1)
        for _ in range(epochs if rows else 0):
            for feature, value, y in rows:
                model.learn(feature, value, float(y))
        yield pa.RecordBatch.from_arrays([pa.array([model.dense().tobytes()], pa.binary())], names=["weights"])

    sample = training_rows(docs, labels, [label_col], max_rows)
    found = sample.mapInArrow(train, "weights binary").collect()  # one row of a fixed size
    return np.frombuffer(bytes(found[0][0]), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted per document."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of a fixed size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            scores = [np.empty(0)]
            for a, b in steps(offsets):
                feature, value, cut = features(*take_rows(data, offsets, a, b))
                scores.append(sigmoid(row_sums(w[feature] * value, cut) + float(w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    out = narrow(docs, id_col, text_col).mapInArrow(each, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 2 modulo 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
