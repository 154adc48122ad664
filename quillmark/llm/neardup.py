"""Near-duplicate detection: MinHash with tensored banding, then exact verification on full shingle sets.

A document's set holds the distinct runs of five words (fewer words: the whole sequence; none: the empty set).
Two documents are linked when 100 * |intersection| >= 85 * |union|, and components of links form groups.

1. One scan hashes words and shingles, and takes 2 x T x K minima per document: two collections A and B of T
   hashes, each of K minima. Table (i, j) of the T * T tables has the key (A_i, B_j), so T * T tables of 2K minima
   cost 2TK minima, about the square root of what separate tables would take. With T = 16 and K = 3 a pair at the
   threshold of 85 meets in no table with probability 4.8e-7; with the filter below at most about 1.1e-6 are missed.
2. Documents with equal sets become one node (grouped by a 128-bit set hash), so copies are never paired. Nodes have
   numbers of their own, as one id may stand on rows of unlike texts.
3. Nodes that share some A_i meet in one bucket, where tables (i, j) are formed by B_j. Buckets over BUCKET nodes
   are dealt out again by (A_i, B_j); tables still over it are joined as stars, which loses no pair.
   Within tables, pairs that could still reach the threshold by size and by all 2TK minima are united.
4. Components of those are clusters that hold every possible link. Each cluster's documents meet with their whole
   texts and all links are decided on full sets. A cluster too large for a task is cut into blocks: first each block
   is verified in itself and against a few leaders of the cluster; what that unites needs no further comparison, so
   true copies cost in proportion to their number. Only documents of different components then meet, in pairs of blocks.
   Only a spanning forest of the confirmed links leaves a task.
5. Components of confirmed links, joined back to all documents.

Null text counts as empty. Rows without id have no links, no component, and are kept. Rows of one id are one document:
they are linked with each other, whatever their texts. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import drop_tables, lean, materialize, narrow, ship_package
from quillmark.operators.graph import connected_components
from quillmark.llm.textvec import LOWER, SPACE, U64, mix, span_hashes, steps, take_rows, text_bytes, word_spans

#: Hashes in each collection, and minima in each hash.
T, K = 16, 3
#: Nodes of a bucket that one task compares, shingles of a cluster that one task verifies, and leaders of a larger one.
BUCKET, CLUSTER_SHINGLES, LEADERS = 4096, 1_500_000, 4


def agree(percent: int) -> int:
    """Minima of 2 * T * K that agree at least, else a pair is given up: 5.3 standard deviations below the mean of a pair
    at the threshold."""
    p, n = percent / 100, 2 * T * K
    return max(0, math.floor(n * p - 5.3 * math.sqrt(n * p * (1 - p))))


_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, 2 * T * K, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 31, 2 * T * K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROLL = [U64(pow(0xD1342543DE82EF95, e, 1 << 64)) for e in range(64)]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of texts in a row, with repeats, and each text's offsets into them."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets, ~SPACE[low])
    h, n = span_hashes(low, starts, ends), np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    rolled = h * _ROLL[words - 1]
    for k in range(1, words):
        rolled[: len(h) - k] += h[k:] * _ROLL[words - 1 - k]
    # a shingle starts at every word but the last words - 1 of a text; shorter texts have one that is all of it
    at = np.arange(len(h)) - first[row]
    keep = at <= n[row] - words
    short = np.flatnonzero((n > 0) & (n < words))
    for i in short:
        a, b = first[i], first[i + 1]
        keep[a] = True
        rolled[a] = mix(np.array([sum(int(h[a + k]) * int(_ROLL[k + 7]) for k in range(b - a)) & (1 << 64) - 1], U64))[0] + U64(b - a)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    return mix(rolled[keep]), np.concatenate([[0], np.cumsum(size)])


def set_hash(u: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set of shingle hashes."""
    return u.sum(), mix(u ^ U64(0x5851F42D4C957F2D)).sum()


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in steps(offsets):
            x, at = shingle_hashes(*take_rows(data, offsets, a, b), words)
            n = np.zeros(b - a, np.int64)
            h1, h2 = np.zeros(b - a, U64), np.zeros(b - a, U64)
            for i in range(b - a):
                if at[i + 1] > at[i]:
                    u = np.unique(x[at[i] : at[i + 1]])
                    n[i], (h1[i], h2[i]) = len(u), set_hash(u)
            sig = np.zeros((b - a, 2 * T * K), np.uint32)
            full = np.flatnonzero(n)
            if len(full):
                x32 = (x >> U64(32)).astype(np.uint32)
                for r in range(2 * T * K):
                    sig[full, r] = np.minimum.reduceat((x32 ^ _XOR[r]) * _MULTIPLY[r], at[full])
            keys = np.zeros((b - a, 2 * T), U64)
            for k in range(K):
                keys = mix(keys + sig[:, k::K].astype(U64) + U64(k + 1))
            keys = mix(keys + np.arange(2 * T, dtype=U64))  # a table's number is part of its key
            flat = pa.array(keys.view(np.int64).ravel())
            both = pa.FixedSizeListArray.from_arrays(flat, 2 * T).cast(pa.list_(pa.int64()))
            tiny = np.ascontiguousarray((sig >> np.uint32(8)).astype("<u2"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), both, pa.array([s.tobytes() for s in tiny], pa.binary())],
                names=["doc_id", "n", "h1", "h2", "keys", "sig"],
            )


def _unite(label: np.ndarray, x: int, others: np.ndarray) -> None:
    """Gives x, the others and all that has their labels the smallest of these labels."""
    labels = np.unique(np.append(label[others], label[x]))
    label[np.isin(label, labels[1:])] = labels[0]


def _join_bucket(ids: np.ndarray, n: np.ndarray, b: np.ndarray, sig: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a bucket that share a table and may reach the threshold."""
    label, least = np.arange(len(ids)), agree(percent)
    for j in range(b.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        cut = np.flatnonzero(np.diff(b[order, j])) + 1
        for group in np.split(order, cut) if len(cut) else [order]:
            for k in range(len(group) - 1):
                x, rest = group[k], group[k + 1 :]
                rest = rest[(label[rest] != label[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))]
                if len(rest) and len(rest := rest[(sig[rest] == sig[x]).sum(axis=1) >= least]):
                    _unite(label, x, rest)
        if (label == 0).all():
            break
    at = np.flatnonzero((label != np.arange(len(ids))) & (ids != ids[label]))
    return list(zip(ids[at].tolist(), ids[label[at]].tolist(), strict=True))


def _groups(table: pa.Table, columns: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of a table sorted by the columns in which they are equal."""
    change = np.zeros(table.num_rows, bool)
    for c in columns:
        v = table.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    cut = [0, *np.flatnonzero(change).tolist(), table.num_rows]
    yield from zip(cut, cut[1:], strict=False)


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for c in columns:
            v = batch.column(c).to_numpy()
            same &= v == v[-1]
        cut = batch.num_rows if not same.all() else 0
        if cut:
            cut = int(np.flatnonzero(~same)[-1]) + 1
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        elif held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], schema=_EDGES)


def _join_buckets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["bucket"]):
        ids, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        keys = np.array(table.column("keys").combine_chunks().flatten()).reshape(-1, 2 * T)[:, T:]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, 2 * T * K)
        edges: list[tuple[int, int]] = []
        for a, b in _groups(table, ["bucket"]):
            if b - a > 1:
                edges += _join_bucket(ids[a:b], n[a:b], keys[a:b], sig[a:b], percent)
        if edges:
            yield _edge_batch(edges)


def verified_links(ids: list[int], sets: list[np.ndarray], known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets that unite what is not known to be united; known: a number per set,
    equal within components that are known."""
    if len(ids) == 2:
        i = len(np.intersect1d(*sets, assume_unique=True))
        linked = known[0] != known[1] and 100 * i >= percent * (len(sets[0]) + len(sets[1]) - i)
        return [(ids[0], ids[1])] if linked else []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
    first = np.concatenate([[0], np.cumsum(size)])
    _, at, back = np.unique(known, return_index=True, return_inverse=True)
    start = at[back]  # the place of the first one of each component
    label = start.copy()
    for x in range(len(sets) - 1):
        if (label[x:] == label[x]).all():
            continue
        c = code[first[x] : first[x + 1]]
        length = begin[c + 1] - begin[c]
        total = np.cumsum(length)
        at = np.repeat(begin[c] - (total - length), length) + np.arange(total[-1])
        both = np.bincount(posting[at], minlength=len(sets))[x + 1 :]
        hit = (100 * both >= percent * (size[x] + size[x + 1 :] - both)) & (label[x + 1 :] != label[x])
        if hit.any():
            _unite(label, x, x + 1 + np.flatnonzero(hit))
    return [(ids[i], ids[r]) for i, r in enumerate(label.tolist()) if r != start[i]]


_UNIT = ["cluster", "low_own", "low", "high_own", "high"]


def _verify(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, _UNIT):
        node, h1, h2, label = (table.column(c).to_numpy() for c in ("node", "h1", "h2", "label"))
        text = table.column("text").combine_chunks()
        edges: list[tuple[int, int]] = []
        for a, b in _groups(table, _UNIT):
            if len(np.unique(label[a:b])) < 2:
                continue
            ids: list[int] = []
            sets: list[np.ndarray] = []
            known: list[int] = []
            seen: set[int] = set()
            data, offsets = text_bytes(text.slice(a, b - a))
            for c, d in steps(offsets):
                x, cut = shingle_hashes(*take_rows(data, offsets, c, d), words)
                for i in range(d - c):
                    at = a + c + i
                    u = np.unique(x[cut[i] : cut[i + 1]])
                    # rows of the node's id may have other texts; copies of a row come once
                    if int(node[at]) not in seen and tuple(v.astype(np.int64) for v in set_hash(u)) == (h1[at], h2[at]):
                        seen.add(int(node[at]))
                        ids.append(int(node[at]))
                        sets.append(u)
                        known.append(int(label[at]))
            if len(ids) > 1:
                edges += verified_links(ids, sets, np.array(known), percent)
        if edges:
            yield _edge_batch(edges)


def _candidates(own: DataFrame, percent: int) -> DataFrame:
    """Edges between nodes whose components hold every pair that shares a table and may reach the threshold."""
    keyed = own.select("node", F.explode(F.slice("keys", 1, T)).alias("bucket"))
    shared = materialize(keyed.groupBy("bucket").count().where("count > 1"), "neardup-shared")
    met = materialize(keyed.join(shared, "bucket"), "neardup-buckets")
    detail = own.select("node", "n", "keys", "sig")
    small = met.where(F.col("count") <= BUCKET).select("node", "bucket")
    again = met.where(F.col("count") > BUCKET).select("node", "bucket").join(detail.select("node", "keys"), "node")
    again = again.select("node", F.explode(F.transform(F.slice("keys", T + 1, T), lambda k: F.xxhash64("bucket", k))).alias("bucket"))
    sizes = again.groupBy("bucket").agg(F.count("*").alias("count"), F.min("node").alias("dst")).where("count > 1")
    tables = materialize(again.join(sizes, "bucket"), "neardup-tables")
    small = small.unionByName(tables.where(F.col("count") <= BUCKET).select("node", "bucket"))
    stars = tables.where(F.col("count") > BUCKET).select(F.col("node").alias("src"), "dst")
    dealt = small.join(detail, "node").repartition("bucket").sortWithinPartitions("bucket")
    edges = materialize(dealt.mapInArrow(lean(lambda it: _join_buckets(it, percent)), "src long, dst long").union(stars), "neardup-candidates")
    drop_tables(met, tables, shared)
    return edges


def _confirmed(members: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members (node, first_id, h1, h2, n, cluster) of one cluster, confirmed on full sets."""
    weight = members.groupBy("cluster").agg(F.sum("n").alias("weight"))
    blocks = F.ceil(F.col("weight") / CLUSTER_SHINGLES).cast("int")
    members = materialize(members.join(weight.select("cluster", blocks.alias("blocks")), "cluster"), "neardup-members")

    def verify(units: DataFrame, name: str) -> DataFrame:
        dealt = units.join(rows, F.col("first_id") == F.col("doc_id")).select("node", "h1", "h2", "label", *_UNIT, "text")
        dealt = dealt.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
        return materialize(dealt.mapInArrow(lean(lambda it: _verify(it, words, percent)), "src long, dst long"), name)

    def unit(*columns) -> list:
        return ["node", "first_id", "h1", "h2", "label", *(F.lit(c).cast("long").alias(n) if isinstance(c, int) else c.cast("long").alias(n) for c, n in zip(columns, _UNIT, strict=True))]

    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    alone = members.withColumn("label", F.col("node")).withColumn("block", block)
    large = alone.where("blocks > 1")
    least = F.min_by(F.struct("node", "first_id", "h1", "h2", "label"), F.xxhash64("node"))
    leaders = large.groupBy("cluster", F.pmod("block", F.lit(LEADERS))).agg(least.alias("x"), F.max("blocks").alias("blocks"))
    leaders = leaders.select("cluster", "x.*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = alone.select(unit(F.col("cluster"), 0, F.col("block"), 0, F.col("block"))).unionByName(leaders.select(unit(F.col("cluster"), 0, F.col("block"), 0, F.col("block"))))
    links = verify(first, "neardup-links")
    if not members.where("blocks > 1").head(1):
        drop_tables(members)
        return links
    united = connected_components(links, "neardup-united")
    labels = members.where("blocks > 1").join(united, F.col("node") == F.col("id"), "left").withColumn("label", F.coalesce("component", "node")).drop("id", "component", "blocks")
    open_ = labels.groupBy("cluster").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("cluster")
    labels = materialize(labels.join(open_, "cluster"), "neardup-labels")
    # a component too large for a task has blocks of its own, which do not meet each other; the others share blocks
    parts = labels.groupBy("cluster", "label").agg(F.sum("n").alias("w"))
    parts = parts.withColumn("own", F.when(F.col("w") > CLUSTER_SHINGLES, F.col("label")).otherwise(-1))
    shares = parts.groupBy("cluster", "own").agg(F.sum("w").alias("w")).select("cluster", "own", F.ceil(F.col("w") / CLUSTER_SHINGLES).alias("blocks"))
    parts = materialize(parts.drop("w").join(shares, ["cluster", "own"]), "neardup-parts")
    placed = labels.join(parts, ["cluster", "label"]).withColumn("at", F.pmod(F.xxhash64(F.when(F.col("own") < 0, F.col("label")).otherwise(F.col("node"))), F.col("blocks")))
    partners = parts.select("cluster", F.col("own").alias("other"), "blocks").distinct().select("cluster", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other_at"))
    met = placed.join(partners, "cluster").where("own != other or own < 0")
    mine, yours = F.struct(F.col("own"), F.col("at")), F.struct(F.col("other").alias("own"), F.col("other_at").alias("at"))
    met = met.withColumn("x", F.least(mine, yours)).withColumn("y", F.greatest(mine, yours))
    more = verify(met.select(unit(F.col("cluster"), F.col("x.own"), F.col("x.at"), F.col("y.own"), F.col("y.at"))), "neardup-more-links")
    drop_tables(members, united, labels, parts)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its group), kept."""
    ship_package(docs.sparkSession)
    rows = narrow(docs, id_col, text_col)
    signed = materialize(
        rows.mapInArrow(lean(lambda it: _signatures(it, words)), "doc_id long, n long, h1 long, h2 long, keys array<long>, sig binary"), "neardup-signatures"
    )
    usable = signed.where("n > 0 and doc_id is not null")
    # what equal sets have in common is aggregated before the shuffle, so a much-copied text is one row a task
    nodes = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", "keys", "sig")))
    own = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    candidates = _candidates(own, percent)
    clusters = connected_components(candidates, "neardup-clusters")
    slim = own.select("node", "first_id", "h1", "h2", "n")
    members = clusters.select(F.col("id").alias("node"), F.col("component").alias("cluster")).join(slim, "node")
    links = _confirmed(members, rows, words, percent)
    # ids that stand on several sets unite these
    several = materialize(usable.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a != b").select("doc_id"), "neardup-several")
    sets = usable.select("doc_id", "h1", "h2").join(several, "doc_id").distinct().join(own.select("h1", "h2", "node"), ["h1", "h2"])
    same = sets.select("doc_id", F.col("node").alias("src")).join(sets.groupBy("doc_id").agg(F.min("node").alias("dst")), "doc_id").select("src", "dst")
    groups = connected_components(links.unionByName(same), "neardup-groups")
    found = own.select("h1", "h2", "node", "first_id").join(groups, F.col("node") == F.col("id"), "left").select("h1", "h2", "first_id", F.coalesce("component", "node").alias("component"))
    found = materialize(found, "neardup-found")
    least = materialize(found.groupBy("component").agg(F.min("first_id").alias("least")), "neardup-least")
    named = materialize(found.join(least, "component").select("h1", "h2", F.col("least").alias("component")), "neardup-named")
    drop_tables(own, candidates, clusters, several, groups, found, least)
    linked = signed.select("doc_id", "n", "h1", "h2", (F.col("n") > 0).alias("any"))
    out = linked.join(named.withColumn("any", F.lit(True)), ["h1", "h2", "any"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each_group(docs: DataFrame, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which near_duplicates keeps one per group, with all their columns, whatever their names. Rows of
    one id are one document, of which one row stays; rows without id all stay."""
    kept = near_duplicates(docs, words, percent, id_col, text_col).where("kept and doc_id is not null").select("doc_id").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    number, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    found = rows.withColumn("doc_id", number.cast("long")).join(kept, "doc_id")
    # one row of each id is found before the shuffle as well, so a frequent id is a row a task
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(text), text))
    found = found.withColumn("n", one).where("n = 1").select(*names)
    return found.unionByName(rows.where(number.isNull())).toDF(*docs.columns)
