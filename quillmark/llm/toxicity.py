"""Toxicity by a classifier chain over categories.

Categories are predicted in order; each linear model sees the hashed words and word beginnings of a text and the probabilities of the
categories before it. In training those are out-of-fold predictions, so a later model learns from probabilities as
good as those it will see. Models are logistic regressions with an L1 penalty, trained by follow-the-regularised-
leader; words that say nothing keep the weight zero, hence long clean texts do not drift.

Labels may come as one column per category. Where only an overall label is there (the table `labels`), `weak_labels`
makes category labels for training: a toxic document is of a category if it has one of its seed words. The last link
of the chain is the overall label, learned from `labels.toxic` alone.

Null text is empty; a text without words gets the bias alone and is never rejected. Repeated rows get equal scores. Without usable labels all probabilities
are near 0 and nothing is rejected. Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import give_back_driver, lean, narrow, ship_package, text_or_empty
from quillmark.llm.ftrl import Ftrl, distinct_per_row, row_sums, sigmoid
from quillmark.llm.labels import training_rows
from quillmark.llm.textvec import LOWER, U64, WORDY, mix, span_hashes, steps, take_rows, text_bytes, word_spans

BITS, FOLDS = 20, 4
#: Bytes of word beginnings that are features beside whole words, as inflected words share them; a beginning that stands in
#: so many distinct words of a text is a further feature each.
BEGINNINGS, OFTEN = (4, 5, 6, 7, 8), (2, 4)
#: Documents the chain is fitted on at most, and the probability from which a document is rejected; README says how it was chosen.
MAX_TRAIN, THRESHOLD = 8_000, 0.2
#: Seed words of weak category labels; fixed values.
CATEGORIES = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser"],
    "contempt": ["trash", "scum", "worthless"],
    "disgust": ["disgusting", "pathetic"],
}


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of texts in a row, letter case aside, beginnings of several words, and row
    offsets."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets, WORDY[low])
    rows = len(offsets) - 1
    _, first = np.unique(span_hashes(low, starts, ends) ^ mix(row.astype(U64) + U64(1)), return_index=True)
    starts, ends, row = starts[first], ends[first], row[first]
    out, of = [span_hashes(low, starts, ends)], [row]
    for n in BEGINNINGS:
        at = np.flatnonzero(ends - starts >= n)
        x = mix(span_hashes(low, starts[at], starts[at] + n) + U64(n))
        _, place, count = np.unique(x ^ mix(row[at].astype(U64) + U64(1)), return_index=True, return_counts=True)
        out.append(x[place])
        of.append(row[at][place])
        for least in OFTEN:
            often = place[count >= least]
            out.append(mix(x[often] + U64(least)))
            of.append(row[at][often])
    feature, _, cut = distinct_per_row((np.concatenate(out) >> U64(64 - BITS)).astype(np.int64), np.concatenate(of), rows, BITS)
    return feature, cut


def weak_labels(docs: DataFrame, categories: dict[str, list[str]] = CATEGORIES, label: str = "toxic", text_col: str = "text") -> DataFrame:
    """Adds a 0/1 column per category: labelled toxic, and with a seed word as a word of its own."""
    words = F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return docs.select("*", *((F.arrays_overlap(words, F.array(*map(F.lit, seeds))) & (F.col(label) == 1)).cast("int").alias(c) for c, seeds in categories.items()))


class Chain:
    """Weights per link: over words, over the probabilities before it, and a bias."""

    def __init__(self, links: int, weights: np.ndarray | None = None):
        self.links = links
        self.size = (1 << BITS) + links
        self.weights = np.zeros((links, self.size + 1), np.float32) if weights is None else weights

    def predict(self, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        p = np.zeros((len(cut) - 1, self.links))
        for k, w in enumerate(self.weights):
            p[:, k] = sigmoid(row_sums(w[feature], cut) + p[:, :k] @ w[1 << BITS : (1 << BITS) + k] + float(w[-1]))
        return p


def _train(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, use: np.ndarray, size: int, epochs: int) -> np.ndarray:
    model = Ftrl(size, alpha=0.3, l1=1.0, l2=0.5)
    places = (1 << BITS) + np.arange(before.shape[1])
    ones = [np.ones(len(r)) for r in rows]
    for _ in range(epochs):
        for i in use:
            model.learn(np.concatenate([rows[i], places]), np.concatenate([ones[i], before[i]]), float(y[i]))
    return model.dense()


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, epochs: int | None = None) -> Chain:
    """A chain over the columns of labels; each row holds the distinct features of a text. Without a number of epochs
    there are three, and up to 20 for few rows."""
    n, links = labels.shape
    epochs = epochs or min(20, max(3, 24_000 // max(1, n)))
    chain = Chain(links)
    before = np.zeros((n, links))
    fold = np.arange(n) % FOLDS
    cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
    for k in range(links):
        chain.weights[k] = _train(rows, before[:, :k], labels[:, k], np.arange(n), chain.size, epochs)
        if k + 1 < links:
            for f in range(FOLDS):
                w = _train(rows, before[:, :k], labels[:, k], np.flatnonzero(fold != f), chain.size, epochs)
                p = sigmoid(row_sums(w[flat], cut) + before[:, :k] @ w[1 << BITS : (1 << BITS) + k] + float(w[-1]))
                before[fold == f, k] = p[fold == f]
    return chain


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", categories: dict[str, list[str]] | None = None, max_rows: int = MAX_TRAIN) -> Chain:
    """A chain over the categories and then the overall label, fitted in one task on a bounded sample."""
    categories = CATEGORIES if categories is None else categories
    ship_package(docs.sparkSession)
    columns = [*categories, label]
    links = len(columns)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        y: list[list[int]] = []
        for batch in batches:
            if len(rows) < max_rows:
                data, offsets = text_bytes(batch.column("text"))
                y += list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
                for a, b in steps(offsets):
                    feature, cut = features(*take_rows(data, offsets, a, b))
                    rows += [feature[cut[i] : cut[i + 1]] for i in range(b - a)]
        if not rows:
            return
        chain = fit_rows(rows[:max_rows], np.array(y[:max_rows], float).reshape(-1, links))
        yield pa.RecordBatch.from_arrays([pa.array([chain.weights.tobytes()], pa.binary())], names=["weights"])

    sample = weak_labels(training_rows(docs, labels, [label], max_rows), categories, label).select("text", *columns)
    found = sample.mapInArrow(lean(train), "weights binary").collect()  # one row of a fixed size
    chain = Chain(links)
    if not found:
        chain.weights[:, -1] = -60.0
        return chain
    return Chain(links, np.frombuffer(bytes(found[0][0]), np.float32).reshape(chain.weights.shape))


def score(docs: DataFrame, chain: Chain, names: list[str], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, one probability column per link, and rejected (the last one exceeds the threshold, and the text has words)."""
    rows = _scored(narrow(docs, id_col, text_col), chain, threshold)
    return rows.select("doc_id", *(F.col("p")[k].alias(c) for k, c in enumerate(names)), "rejected")


def _scored(rows: DataFrame, chain: Chain, threshold: float) -> DataFrame:
    """rows with a column `text`, which gives way to p (the probabilities of the links) and rejected."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(chain.weights)  # of a fixed size
    give_back_driver(rows.sparkSession)
    links = chain.links

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(links, shared.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            p, words = [np.empty((0, links))], [np.empty(0, bool)]
            for a, b in steps(offsets):
                feature, cut = features(*take_rows(data, offsets, a, b))
                p.append(own.predict(feature, cut))
                words.append(np.diff(cut) > 0)
            p = np.concatenate(p)
            rejected = pa.array((p[:, -1] > threshold) & np.concatenate(words))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), links).cast(pa.list_(pa.float64()))
            kept = [(c, x) for c, x in zip(batch.schema.names, batch.columns, strict=True) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(x for _, x in kept), lists, rejected], names=[*(c for c, _ in kept), "p", "rejected"])

    schema = rows.drop("text").select("*", F.array(F.lit(0.0)).alias("p"), F.lit(True).alias("rejected")).schema
    return rows.mapInArrow(lean(each), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the chain does not reject, with all their columns, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    rows = rows.withColumn("text", text_or_empty(F.col(names[docs.columns.index(text_col)])))
    return _scored(rows, fit(docs, labels), threshold).where("not rejected").select(*names).toDF(*docs.columns)
