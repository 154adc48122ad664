"""Best-fit packing of documents into sequences of at most a given number of tokens, by pattern packing.

1. Every document is encoded and ends with an end id; only documents longer than a sequence are cut.
2. The histogram of piece lengths (at most `max_tokens` rows, whatever the corpus) comes to the driver.
3. Patterns of two or three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to
   the histogram by non-negative least squares, and rounded down to what is there.
4. The residual counts are packed by best-fit decreasing, also by length and count, never by document.
5. Pieces get ranks within their length (salted by numbers of their own, so that neither a frequent length nor repeated
   rows gather in a task), and each range of ranks belongs to one slot of one pattern.

Null text is an empty document (its end id only); null and repeated doc_ids are packed like any other; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import lean, materialize, narrow, ship_package

#: Pieces of one length that are ranked in one group.
RANK_GROUP = 10_000
#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, max_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillmark.llm.encoding import encoder
        from quillmark.llm.textvec import text_bytes

        enc = encoder(tokenizer_file)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for a, b, ids, at in enc.encode_rows(*text_bytes(batch.column("text"))):
                size = np.diff(at) + 1
                n = -(-size // max_tokens)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_tokens
                length = np.minimum(size[row] - start, max_tokens)
                raw = np.insert(ids, at[1:], end_id).astype("<u4").tobytes()
                begin = 4 * (np.repeat(np.cumsum(size) - size, n) + start)
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                doc_id = batch.column("doc_id").slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return narrow(docs, id_col, text_col).mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _patterns(counts: np.ndarray, most: int) -> np.ndarray:
    """Rows of up to three lengths (0: none) that sum to `most`, of lengths that occur; about `most` * 3 rows."""
    has = np.flatnonzero(counts)
    has = has[(has > 0) & (has < most)]
    rows = [[a, most - a, 0] for a in has if a >= most - a and counts[most - a]]
    for a in has[2 * has > most]:  # what leaves no room for a longer one, so no gap that others need is used up
        rest = most - a
        options = [b for b in has[(2 * has >= rest) & (has < rest)] if counts[rest - b]]
        options.sort(key=lambda b: -min(counts[b], counts[rest - b]))
        rows += [[a, b, rest - b] for b in options[:2]]
    return np.array(rows, np.int64).reshape(-1, 3)


def _fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by multiplicative updates."""
    h = counts.astype(float)
    h[0] = 0
    used = patterns > 0

    def transposed(v: np.ndarray) -> np.ndarray:
        return (v[patterns] * used).sum(axis=1)

    target = transposed(h)
    x = np.where(used, h[patterns], np.inf).min(axis=1) / 3
    for _ in range(rounds):
        fitted = np.bincount(patterns.ravel(), np.repeat(x, 3) * used.ravel(), len(h))
        x = x * target / np.maximum(transposed(fitted), 1e-12)
    return x


def plan_packing(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how many such sequences; counts[l] pieces of each length l <= most.

    The fitted repeats are rounded down at several shares of the fit; the plan of fewest sequences is taken."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    full: list[tuple[tuple[int, ...], int]] = [((most,), int(left[most]))] if left[most] else []
    left[most] = 0
    patterns = _patterns(left, most)
    x = _fit(patterns, left) if len(patterns) else np.empty(0)
    plans = [_plan(left, most, patterns, share * x) for share in (SHARES if len(patterns) else (1.0,))]
    return full + min(plans, key=lambda p: sum(n for _, n in p))


def _plan(counts: np.ndarray, most: int, patterns: np.ndarray, x: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as x says, rounded down to what is there, and best-fit decreasing for the residual."""
    left = counts.copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    for k in np.argsort(-x, kind="stable"):
        lengths = [int(v) for v in patterns[k] if v]
        n = int(min(np.floor(x[k] + 1e-9), min(left[v] // lengths.count(v) for v in lengths)))
        if n > 0:
            plan.append((tuple(lengths), n))
            for v in lengths:
                left[v] -= n
    open_by_space: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []

    def add(space: int, lengths: tuple[int, ...], n: int) -> None:
        if not open_by_space[space]:
            bisect.insort(spaces, space)
        open_by_space[space].append((lengths, n))

    for length in range(most - 1, 0, -1):
        n = int(left[length])
        while n:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                each = most // length
                for per, k in ((each, n // each), (n % each, 1)):
                    if per and k:
                        add(most - per * length, (length,) * per, k)
                n = 0
                break
            space = spaces[i]
            lengths, k = open_by_space[space].pop()
            if not open_by_space[space]:
                spaces.pop(i)
            take = min(n, k)
            if take < k:
                add(space, lengths, k - take)
            add(space - length, (*lengths, length), take)
            n -= take
    return plan + [g for groups in open_by_space.values() for g in groups]


def pack(docs: DataFrame, tokenizer_file: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer_file, end_id, max_tokens, id_col, text_col)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    counts = np.zeros(max_tokens + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # max_tokens rows at most
        counts[length] = n
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence, taken = 0, np.zeros(max_tokens + 1, np.int64)
    for lengths, n in plan_packing(counts, max_tokens):
        offset = 0
        for v in lengths:
            slots[v].append((int(taken[v]), sequence, offset))
            taken[v] += n
            offset += v
        sequence += n
    table = np.array([(v, *s) for v in sorted(slots) for s in slots[v]], np.int64).reshape(-1, 4)
    low, high = np.searchsorted(table[:, 0], np.arange(max_tokens + 1)), np.searchsorted(table[:, 0], np.arange(max_tokens + 1), side="right")
    groups = F.array(*(F.lit(int(-(-n // RANK_GROUP)) or 1) for n in counts))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.get(groups, F.col("length").cast("int")).cast("long")))
    sums = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                row[at] = low[v] + np.searchsorted(table[low[v] : high[v], 1], rank[at], side="right") - 1
            own = table[row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
