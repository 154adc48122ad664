"""Pairs of texts whose vectors of hashed terms are alike, without a row per term or per meeting.

1. Equal texts are one vector, under their smallest id.
2. Buckets are named by their frequency, the rarest 0; how often each occurs is known of all vectors (`dim` numbers).
3. Vectors are dealt to blocks of like numbers of terms, a folder of files each in the shared store.
4. Two blocks meet in one task. Buckets fall into groups by their names; the products of two vectors' lengths in each group
   sum up to no less than their cosine (Cauchy-Schwarz), so matrix products of such lengths, first of few groups, then of
   many, tell which pairs may be alike. No pair is lost; those few are decided on all their terms, in whole numbers.
   Where only links are asked for, pairs that a task's links unite already are not decided.

Vectors that can't be alike, as one would lack too many of the other's terms, don't meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import terms
from quillmark.functions.vector import hashed_terms
from quillmark.operators import cluster
from quillmark.runtime import delete_path, drop_tables, lean, materialize, scratch_path, ship_package

#: Terms of a block; vectors of two blocks that meet in one step; blocks that one task meets.
BLOCK, TILE, EACH = 3_000_000, (512, 4096), 4
#: Groups of buckets at least and at most; then as many for each term of a vector, at most; a step's pairs take more groups from a share of them on.
GROUPS, FINE, DENSE = (64, 2048), (8, 1 << 14), 0.02
#: Numbers of terms are told apart by so many steps to a doubling, and as light are vectors that can't lose a larger share of their terms.
CLASSES, LIGHT = 4, 0.4


def _texts(items: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(id, first) of rows whose text is that of a row of a smaller id, and (first, words) of all other rows."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    keyed = rows.select("id", F.sha2("text", 256).alias("key"))
    same = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    copies = materialize(keyed.join(same, "key").where("id != first").select("id", "first"), "terms-copies")
    return copies, rows.join(copies.select("id"), "id", "left_anti").select(F.col("id").alias("first"), terms.spaced(F.col("text")).alias("words"))


def _vectors(texts: DataFrame, dim: int) -> DataFrame:
    """(first, bucket, n): the buckets of each text in order with their counts; texts without terms are left out."""
    ship_package(texts.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillmark.llm.textvec import steps, take_rows, text_bytes

        for batch in batches:
            if batch.num_rows == 0:
                continue
            data, offsets = text_bytes(batch.column("words"))
            for a, b in steps(offsets, terms.STEP):
                row, bucket, n = terms.counted(*take_rows(data, offsets, a, b), dim)
                at = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                has = np.flatnonzero(np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(np.append(at[has], len(row)).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (bucket, n)]
                yield pa.RecordBatch.from_arrays([batch.column("first").slice(a, b - a).take(pa.array(has)), *lists], names=["first", "bucket", "n"])

    return texts.mapInArrow(lean(make), "first long, bucket array<int>, n array<int>")


def _frequencies(vectors: DataFrame, dim: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("bucket").flatten().to_numpy(), minlength=dim)
        own = np.flatnonzero(total)
        for a in range(0, len(own), 1 << 16):
            part = own[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    found = vectors.select("bucket").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # `dim` rows at most
    out = np.zeros(dim, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, in a row."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def named(bucket: np.ndarray, n: np.ndarray, at: np.ndarray, name: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors in a row that begin `at`: their terms by name, the counts, and how many terms any vector that is alike has at least."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    label = name[bucket]
    order = np.argsort((row << 32) | label)
    label, n = label[order], n[order].astype(np.int64)
    squares = np.add.reduceat(n * n, at[:-1])
    light = np.sort((row << 32) | n)
    whole = np.cumsum((light & 0xFFFFFFFF) ** 2)
    sums = whole - np.repeat(np.concatenate([[0], whole])[at[:-1]], size)
    lost = sums <= (1 - (least - 1e-6) ** 2 + 1e-9) * np.repeat(squares, size)
    return label, n, size - np.bincount(row, lost, minlength=len(size)).astype(np.int64)


def _groups(size: int, most: int = GROUPS[1]) -> int:
    """Groups for vectors of so many terms: a power of two, so that those of fewer groups are made of these."""
    return min(max(1 << max(int(size) - 1, 0).bit_length(), GROUPS[0]), most)


def _close(least: float, groups: int) -> float:
    """Rounded to six digits or summed up as floats, no product that is `least` is less."""
    return least - 2e-5 - groups * 2.0**-24


class Block:
    """Vectors of one block in order of their numbers of terms; `name` in order of frequency."""

    def __init__(self, table: pa.Table, dim: int):
        size = pc.list_value_length(table.column("name")).to_numpy()
        table = (table if (np.diff(size) >= 0).all() else table.take(np.argsort(size, kind="stable"))).combine_chunks()
        one = lambda c: table.column(c).chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type)
        self.ids, self.fewest, self.dim = one("first"), one("fewest").to_numpy(), dim
        lists = one("name")
        self.n, self.at = one("n").flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.size = np.diff(self.at)
        steps = np.cumsum(lists.flatten().to_numpy(), dtype=np.int32)  # names are kept as steps from the one before; differences outlive overflows
        self.name = steps - np.repeat(np.append(np.int32(0), steps)[self.at[:-1]], self.size)
        self.length = np.sqrt(np.add.reduceat(self.n.astype(np.int64) ** 2, self.at[:-1]))
        #: of the vectors from each one on, the least that any needs
        self.needs = np.minimum.accumulate(self.fewest[::-1])[::-1]
        self.levels: dict[int, np.ndarray] = {}

    def lengths(self, groups: int) -> np.ndarray:
        """How long each vector, of length one, is in each group; the most frequent buckets are in groups apart."""
        if not self.levels:
            most = _groups(self.size[-1])
            self.levels[most] = self.grouped(np.arange(len(self.size)), most)
        while groups not in self.levels:
            low = min(self.levels)
            x = self.levels[low]
            self.levels[low // 2] = np.sqrt(x[:, : low // 2] ** 2 + x[:, low // 2 :] ** 2)
        return self.levels[groups]

    def grouped(self, rows: np.ndarray, groups: int) -> np.ndarray:
        out = np.zeros((len(rows), groups), np.float32)
        flat, step = out.reshape(-1), max(1, (1 << 20) // groups)
        for a in range(0, len(rows), step):
            own = rows[a : a + step]
            at = _spans(self.at[own], self.size[own])
            key = np.repeat((a + np.arange(len(own))) * groups, self.size[own]) + (self.dim - 1 - self.name[at]) % groups
            np.add.at(flat, key, (self.n[at] / np.repeat(self.length[own], self.size[own])).astype(np.float32) ** 2)
            flat[key] = np.sqrt(flat[key])
        return out


def meet(mine: Block, other: Block, least: float, links: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors of two blocks that are alike, each pair once (of one block, the first one earlier), and how much; of `links` only
    as many as unite the same."""
    if not len(mine.size) or not len(other.size):
        return
    same = other is mine
    most = min(_groups(mine.size[-1]), _groups(other.size[-1]))
    beyond = 0 if same else len(mine.size)
    root = np.arange(beyond + len(other.size))  # the first vector that each one is united with
    few, dense = GROUPS[0], np.zeros(mine.dim, np.int64)
    for a in range(0, len(mine.size), TILE[0]):
        b = min(a + TILE[0], len(mine.size))
        # those that have as many terms as these need, and need no more than these have
        start, end = np.searchsorted(other.size, mine.fewest[a:b].min()), np.searchsorted(other.needs, mine.size[b - 1], side="right")
        for c in range(max(int(start), a if same else 0), int(end), TILE[1]):
            d = min(c + TILE[1], int(end))
            while True:
                hit = mine.lengths(few)[a:b] @ other.lengths(few)[c:d].T >= _close(least, few)
                found = np.flatnonzero(hit)
                if few == most or len(found) <= DENSE * hit.size:
                    break
                few *= 2
            i, j = np.divmod(found, d - c)
            i, j = i + a, j + c
            stay = (mine.size[i] >= other.fewest[j]) & (other.size[j] >= mine.fewest[i])
            if same:
                stay &= i < j
            i, j = i[stay], j[stay]
            if links:
                stay = root[i] != root[j + beyond]
                i, j = i[stay], j[stay]
            if few < most and len(i):
                stay = _pairwise(mine.lengths(most), other.lengths(most), i, j) >= _close(least, most)
                i, j = i[stay], j[stay]
            few = max(few // 2, GROUPS[0]) if len(found) < DENSE / 40 * hit.size else few  # of the next step
            if len(i):
                stay = _as_matrices(mine, other, i, j, least)
                i, j = i[stay], j[stay]
            if len(i):
                yield from _decide(mine, other, i, j, least, dense, root if links else None)


def _pairwise(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 20) // x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step)])


def _as_matrices(mine: Block, other: Block, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Long texts of a language are alike by its most frequent words, so many are left that only far more groups tell apart."""
    (rows, i), (columns, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    groups = _groups(FINE[0] * max(mine.size[rows[-1]], other.size[columns[-1]]), FINE[1])
    stay, step = np.ones(len(i), bool), (1 << 23) // groups
    for a in range(0, len(rows), step):
        x = None
        for c in range(0, len(columns), step):
            own = np.flatnonzero((i >= a) & (i < a + step) & (j >= c) & (j < c + step))
            if len(own) > max(DENSE * min(step, len(rows) - a) * min(step, len(columns) - c), 64):
                x = mine.grouped(rows[a : a + step], groups) if x is None else x
                stay[own] = (x @ other.grouped(columns[c : c + step], groups).T)[i[own] - a, j[own] - c] >= _close(least, groups)
    return stay


def _decide(mine: Block, other: Block, i: np.ndarray, j: np.ndarray, least: float, dense: np.ndarray, root: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    order = np.argsort(j, kind="stable")
    i, j = i[order], j[order]
    beyond = 0 if other is mine else len(mine.size)
    ks, at = np.unique(j, return_index=True)
    for k, a, b in zip(ks, at, np.append(at[1:], len(j)), strict=True):
        own = i[a:b]
        if root is not None:
            own = own[root[own] != root[k + beyond]]
        if not len(own):
            continue
        x = slice(other.at[k], other.at[k + 1])
        dense[other.name[x]] = other.n[x]
        while len(own):
            take = np.arange(min(16, len(own))) if root is None else np.unique(root[own], return_index=True)[1][:16]  # one of each component
            part, own = own[take], np.delete(own, take)
            size = mine.size[part]
            at_ = _spans(mine.at[part], size)
            product = np.add.reduceat(dense[mine.name[at_]] * mine.n[at_], np.cumsum(size) - size)
            like = np.round(product / (mine.length[part] * other.length[k]), 6)
            hit = like >= least
            if hit.any():
                yield part[hit], np.full(int(hit.sum()), k), like[hit]
                if root is not None:
                    united = np.unique(np.append(root[part[hit]], root[k + beyond]))
                    root[np.isin(root, united)] = united[0]
                    own = own[root[own] != united[0]]
        dense[other.name[x]] = 0


def _named(vectors: DataFrame, name: np.ndarray, least: float) -> DataFrame:
    """(first, name, n, size, fewest, class) of vectors."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                lists = batch.column("bucket")
                at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
                label, n, fewest = named(lists.flatten().to_numpy(), batch.column("n").flatten().to_numpy(), at, name, least)
                size = np.diff(at)
                steps = np.diff(label, prepend=0)
                steps[at[:-1]] = label[at[:-1]]
                kind = 2 * np.floor(CLASSES * np.log2(size)).astype(np.int32) + (fewest < (1 - LIGHT) * size)
                parts = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (steps, n)]
                yield pa.RecordBatch.from_arrays([batch.column("first"), *parts, pa.array(size), pa.array(fewest), pa.array(kind.astype(np.int32))], names=["first", "name", "n", "size", "fewest", "class"])

    return vectors.mapInArrow(lean(make), "first long, name array<int>, n array<int>, size long, fewest long, class int")


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, as many as unite the same: each id but the smallest of a component with that one."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b, label = at[: len(i)], at[len(i) :], np.arange(len(ids))
    while True:
        m, old = np.minimum(label[a], label[b]), label.copy()
        for x in (a, b, old[a], old[b]):
            np.minimum.at(label, x, m)
        label = label[label]
        if (label == old).all():
            break
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[own]], ids[own]


def _read(path: str, block: int, dim: int) -> Block:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/block={block}")) if f.path.endswith(".parquet")]
    return Block(pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read(columns=["first", "name", "n", "fewest"]) for f in sorted(files)]), dim)


def _first_pairs(texts: DataFrame, dim: int, least: float, links: bool) -> tuple[DataFrame, DataFrame]:
    """(i, j, similarity) of different texts, of `links` only as many as unite the same; and the ids (first) of texts with terms."""
    spark = texts.sparkSession
    vectors = materialize(_vectors(texts, dim), "terms-vectors")
    name = np.empty(dim, np.int32)
    name[np.argsort(_frequencies(vectors, dim), kind="stable")] = np.arange(dim, dtype=np.int32)
    rows = materialize(_named(vectors, name, least), "terms-named")
    drop_tables(vectors)
    kinds = rows.groupBy("class").agg(F.sum("size").alias("terms"), F.min("fewest").alias("low"), F.max("size").alias("high")).collect()  # 8 a doubling
    first, parts, low, high, filled = {}, {}, [], [], BLOCK
    for k in sorted(kinds, key=lambda k: (k["class"] % 2, k["class"])):
        new = filled + k["terms"] > BLOCK or kind != k["class"] % 2  # else it shares the block of the class before
        parts[k["class"]] = n = -(-k["terms"] // BLOCK) if new else 1
        first[k["class"]] = len(low) if new else len(low) - 1
        low, high = (low + [k["low"]] * n, high + [k["high"]] * n) if new else (low[:-1] + [min(low[-1], k["low"])], high[:-1] + [max(high[-1], k["high"])])
        filled, kind = (k["terms"] if new else filled + k["terms"]) if n == 1 else BLOCK, k["class"] % 2
    pick = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("class")) if d else F.lit(1)
    dealt = rows.withColumn("block", (pick(first) + F.pmod(F.xxhash64("first"), pick(parts))).cast("int")).drop("class")
    path = scratch_path(spark, "terms-blocks")
    dealt.repartition(max(len(low), 1), "block").sortWithinPartitions("block", "size", "first").write.option("compression", "zstd").partitionBy("block").parquet(path)
    low, high = np.array(low), np.array(high)

    def pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("id").to_pylist():
                q = p + np.flatnonzero((low[p:] <= high[p]) & (low[p] <= high[p:]))
                lists = [q[a : a + EACH].tolist() for a in range(0, len(q), EACH)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(lists), pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["p", "qs"])

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, qs in zip(batch.column("p").to_pylist(), batch.column("qs").to_pylist(), strict=True):
                mine = _read(path, p, dim)
                for q in qs:
                    other = mine if q == p else _read(path, q, dim)
                    kept: list = []
                    for i, j, like in meet(mine, other, least, links):
                        x, y = (b.ids.take(pa.array(k)).to_numpy() for b, k in ((mine, i), (other, j)))
                        x, y = np.minimum(x, y), np.maximum(x, y)
                        if not links:
                            yield made(x, y, like)
                            continue
                        kept.append((x, y))
                        if len(kept) > 4096:
                            kept = [_forest(*map(np.concatenate, zip(*kept, strict=True)))]
                    if kept:
                        x, y = _forest(*map(np.concatenate, zip(*kept, strict=True)))
                        yield made(x, y, np.full(len(x), np.nan))

    def made(x: np.ndarray, y: np.ndarray, like: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(like)], names=["i", "j", "similarity"])

    lists = spark.range(0, len(low), 1, max(1, min(len(low) // 64, 1000))).mapInArrow(pairs_of_blocks, "p int, qs array<int>")
    found = materialize(lists.repartition(max(1, min(4 * len(low), 10_000))).mapInArrow(lean(meet_blocks), "i long, j long, similarity double"), "terms-pairs")
    delete_path(spark, path)
    return found, rows.select("first")


def text_pairs(items: DataFrame, id_col: str, text: Column, dim: int, least: float) -> DataFrame:
    """(i, j, similarity): all pairs i < j of rows whose hashed terms have a cosine of at least `least` (6 digits). Ids are whole numbers."""
    if items.groupBy(id_col).count().where(f"`{id_col}` IS NOT NULL AND count > 1").head(1):  # several rows are one vector
        return cluster.rare_pairs(materialize(hashed_terms(items, id_col, text, dim), "terms"), id_col, least)
    copies, texts = _texts(items, id_col, text)
    found, told = _first_pairs(texts, dim, least, False)
    copies = materialize(copies.join(told, "first", "left_semi"), "terms-told")
    group = copies.unionByName(copies.select(F.col("first").alias("id"), "first").distinct())  # with their firsts
    out = found
    for c in "ij":
        out = out.join(group.select(F.col("first").alias(c), F.col("id").alias("copy")), c, "left").withColumn(c, F.coalesce("copy", c)).drop("copy")
    out = out.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "similarity")
    own = group.select("first", F.col("id").alias("i")).join(group.select("first", F.col("id").alias("j")), "first").where("i < j")
    return out.unionByName(own.select("i", "j", F.lit(1.0).alias("similarity")))


def text_links(items: DataFrame, id_col: str, text: Column, dim: int, least: float) -> DataFrame:
    """(i, j): pairs as of `text_pairs`, or of rows that such pairs unite, as many as have the same components."""
    if items.groupBy(id_col).count().where(f"`{id_col}` IS NOT NULL AND count > 1").head(1):
        return text_pairs(items, id_col, text, dim, least).select("i", "j")
    copies, texts = _texts(items, id_col, text)
    found, told = _first_pairs(texts, dim, least, True)
    return found.select("i", "j").unionByName(copies.join(told, "first", "left_semi").select(F.col("first").alias("i"), F.col("id").alias("j")))
