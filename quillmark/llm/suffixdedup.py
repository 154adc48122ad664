"""Removal of repeated passages by a Burrows-Wheeler transform with threshold-bounded interval expansion.

A byte goes when a string of `length` bytes that covers it also starts anywhere else, in the same or another document.

1. Every string of `length` bytes selects the K-byte string of the smallest hash in it (the leftmost of equals), so
   equal strings select equal K-byte strings at the same place in them. The strings of a document that select one
   place are consecutive: together they are a context of at most 2 * length - K bytes. One scan lists the contexts by
   two hashes, of the selected string (h) and of the context's bytes (c); no bytes are moved. Only contexts whose h
   occurs twice in the corpus go on.
2. Contexts of one h are a group, and all starts of an equal string lie in one group, each in exactly one context.
   Equal contexts are one kind with a count, formed before anything meets by h. A group of one kind is repeated
   throughout. Of the other kinds, one copy each is cut from its text.
3. A task joins the kinds of its groups to one string, forms its suffix order to a depth over `length` and its
   Burrows-Wheeler transform, and expands intervals breadth first by backward extension: step l gives every boundary
   between suffixes with exactly l bytes in common. It stops at `length`; suffixes that no boundary parts then have at
   least that much in common.
4. A group of over GROUP kinds is split by halves of the places at which the selected string can lie in a string; the
   bytes that all strings of a half have in common are then part of the group's key. Halving goes on while it must; at
   a single place all strings of a group are equal. So no group is ever cut short.
5. What is repeated in a kind holds for every context of that kind; spans come together per document.

Null text is empty. Rows are told apart by id and text; of rows that are equal in both, each is the other's copy.
Null ids are kept as they are. Extra columns are ignored; an empty table gives no rows. Offsets are bytes, so a kept
text may not be valid UTF-8 (`remove_spans` can widen spans to whole code points). A text of any size is scanned in
steps of about a megabyte. `length` must be from K to MOST_LENGTH, else ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import drop_tables, lean, materialize, narrow, ship_package, text_or_empty
from quillmark.llm.neardup import whole_groups
from quillmark.llm.textvec import U64, mix, span_hashes, steps, take_rows, text_bytes

#: Bytes of a selected string, distinct contexts of a group, and bytes of contexts that are sorted at once.
K, GROUP, CHUNK = 32, 4096, 1 << 20
#: The highest `length`: places and counts of a context take half of what a start leaves of 63 bits.
MOST_LENGTH = 32_000
#: Places that one scanning step tells apart, and starts of strings in a step of a text that is longer than one.
_POSITION_BITS, SEGMENT = 22, 1 << 20


def select_contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts in a row: the row of each context, its first string's start in the text, how many strings it has,
    the selected place after that start, the selected hash, and a hash of place and bytes."""
    n, w = len(data), length - K + 1
    if n < length:
        z = np.empty(0, np.int64)
        return z, z, z, z, np.empty(0, U64), np.empty(0, U64)
    if n >= 1 << _POSITION_BITS:
        raise ValueError("too many bytes for one step")
    at = np.arange(n - K + 1)
    h = span_hashes(data, at, at + K)
    low = (h >> U64(_POSITION_BITS) << U64(_POSITION_BITS)) | at.astype(U64)
    size = 1
    while 2 * size <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    place = (low & U64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    fits = np.zeros(len(place) + 1, np.int64)
    lengths = np.diff(offsets)
    long = lengths >= length
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, offsets[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(fits)[:-1])
    chosen = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    row = np.searchsorted(offsets, begin, side="right") - 1
    place = chosen[first] - begin
    kind = mix(span_hashes(data, begin, begin + count + length - 1) + place.astype(U64))
    return row, begin - offsets[row], count, place, h[chosen[first]], kind


def context_steps(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """select_contexts over texts of any size, in steps; a long text's steps part its starts at fixed places, so equal
    texts have equal contexts."""
    for a, b in steps(offsets):
        own, cut = take_rows(data, offsets, a, b)
        if b - a > 1 or len(own) < 2 * SEGMENT:
            row, *found = select_contexts(own, cut, length)
            yield (row + a, *found)
            continue
        for s in range(0, len(own) - length + 1, SEGMENT):
            part = own[s : s + SEGMENT + length - 1]
            row, start, *found = select_contexts(part, np.array([0, len(part)]), length)
            yield (row + a, start + s, *found)


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of t in the order of the suffixes' first symbols, at least `depth` of them; symbols below 2**9."""
    n = len(t)
    key = np.zeros(n, U64)
    padded = np.concatenate([t.astype(U64), np.zeros(8, U64)])
    for k in range(7):
        key = (key << U64(9)) | padded[k : k + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    done, rank = 7, np.empty(n, np.int32)
    while True:
        sorted_key = key[order]
        step = np.zeros(n, np.int32)
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(step, dtype=np.int32) + 1
        if done >= depth or rank[order[-1]] == n:
            return order
        key = rank.astype(U64) << U64(32)
        key[: n - done] |= rank[done:].astype(U64)
        # only suffixes that are not alone yet are sorted again, each within its group
        again = np.concatenate([step[1:] == 0, [False]]) | np.concatenate([[False], step[1:] == 0])
        at = np.flatnonzero(again)
        order[at] = order[at][np.argsort(key[order[at]], kind="stable")]
        done *= 2


def common_prefix_boundaries(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order, whether it has fewer than `length` symbols in common with the one before.

    Breadth-first backward extension: the queue of step l holds intervals of strings of l symbols; an extension by
    one symbol on the left gives an interval of l + 1, which counts if the boundary at its end was still open. That
    boundary has l symbols in common. Intervals whose end is known already are dropped, so all queues together hold
    at most as many intervals as there are suffixes.
    """
    n = len(t)
    bwt = t[order - 1]
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    last_to_first = np.empty(n, np.int32)
    last_to_first[by_symbol] = np.arange(n, dtype=np.int32)
    first = bwt[by_symbol]
    parted = np.zeros(n + 1, bool)
    parted[0] = parted[n] = True
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    owner = np.empty(n, np.int32)
    # the interval of the empty string: its extensions end where symbols change
    for step in range(length):
        size = high - low
        total = np.cumsum(size, dtype=np.int32)
        which = np.repeat(np.arange(len(low), dtype=np.int32), size)
        at = np.arange(total[-1], dtype=np.int32) - np.repeat(total - size - low, size)
        to = last_to_first[at]
        owner[to] = which
        if len(to) * 16 > n:
            seen = np.zeros(n, bool)
            seen[to] = True
            to = np.flatnonzero(seen).astype(np.int32)
        else:
            to = np.sort(to)
        own, symbol = owner[to], first[to]
        split = np.flatnonzero((to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])) + 1
        low = to[np.concatenate([[0], split])]
        high = to[np.concatenate([split - 1, [len(to) - 1]])] + 1
        if step == 0:
            fresh = np.ones(len(low), bool)  # step 0 also opens the interval that ends the order
        else:
            fresh = ~parted[high]
        low, high = low[fresh], high[fresh]
        parted[high] = True
        if not len(low):
            break
    return parted[:n]


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, the starts in it of strings of `length` bytes that start anywhere else in the contexts."""
    size = np.array([len(c) for c in contexts])
    t = np.zeros(int(size.sum()) + len(contexts), np.uint16)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    t[:] = raw
    t += 1
    t[begin[1:] - 1] = 0  # symbol 0 parts contexts; a string across it is no candidate
    order = suffix_order(t, length + 1)
    parted = common_prefix_boundaries(t, order, length)
    alone = parted & np.append(parted[1:], True)
    repeated = np.zeros(len(t), bool)
    repeated[order[~alone]] = True
    return [np.flatnonzero(repeated[begin[i] : begin[i] + max(0, size[i] - length + 1)]) for i in range(len(contexts))]


def _bits(length: int) -> int:
    return (length - K + 1).bit_length()


_LISTED = "h long, c long, d long, rk long, packed long"


def _list_contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    bits = _bits(length)
    for batch in batches:
        for row, start, count, place, h, c in context_steps(*text_bytes(batch.column("text")), length):
            own = pa.array(row)
            packed = (start << 2 * bits) | (count << bits) | place
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column("d").take(own), batch.column("rk").take(own), pa.array(packed)], names=["h", "c", "d", "rk", "packed"]
            )


_STRINGS = "h long, c long, n int, place int, copies long, kinds long, bytes binary"


def _cut_kinds(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    bits = _bits(length)
    mask = (1 << bits) - 1
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        lists = batch.column("found")
        for i in range(batch.num_rows):
            raw = texts[i].as_py()
            found = lists[i].values
            packed = found.field("packed").to_numpy()
            start, n, place = packed >> 2 * bits, packed >> bits & mask, packed & mask
            ok = np.flatnonzero(start + n + length - 1 <= len(raw))  # all, unless keys of unlike texts agree
            cut = [raw[a:b] for a, b in zip(start[ok].tolist(), (start + n + length - 1)[ok].tolist(), strict=True)]
            h, c, copies, kinds = (found.field(x).take(pa.array(ok)) for x in ("h", "c", "copies", "kinds"))
            yield pa.RecordBatch.from_arrays(
                [h, c, pa.array(n[ok], pa.int32()), pa.array(place[ok], pa.int32()), copies, kinds, pa.array(cut, pa.binary())], names=["h", "c", "n", "place", "copies", "kinds", "bytes"]
            )


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True)) if len(starts) else []


_RUNS = "g long, c long, first int, last int"


def _expand_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of kinds (g, c, copies, bytes) sorted by g: the runs of starts in each kind of strings that are repeated."""
    held: list[pa.Table] = []
    size = 0

    def work() -> pa.RecordBatch:
        table = pa.concat_tables(held)
        contexts = table.column("bytes").to_pylist()
        copies = table.column("copies").to_numpy()
        runs = []
        for i, s in enumerate(repeated_starts(contexts, length)):  # all of a context that has a copy is repeated
            runs += [(i, 0, len(contexts[i]) - length)] if copies[i] > 1 else [(i, *r) for r in _runs(s)]
        at = pa.array([r[0] for r in runs], pa.int64())
        key = [table.column(c).combine_chunks().take(at) for c in ("g", "c")]
        return pa.RecordBatch.from_arrays([*key, pa.array([r[1] for r in runs], pa.int32()), pa.array([r[2] for r in runs], pa.int32())], names=["g", "c", "first", "last"])

    for table in whole_groups(batches, ["g"]):
        groups = np.concatenate([[0], np.flatnonzero(np.diff(table.column("g").to_numpy())) + 1, [table.num_rows]])
        bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("bytes")).to_numpy())])
        a = 0
        for b in groups[1:]:
            if size + bytes_before[b] - bytes_before[a] >= CHUNK:
                held.append(table.slice(a, b - a))
                yield work()
                held, size, a = [], 0, b
        if a < table.num_rows:
            held.append(table.slice(a))
            size += int(bytes_before[-1] - bytes_before[a])
    if held:
        yield work()


def _expanded(kinds: DataFrame, length: int) -> DataFrame:
    """Runs (g, c, first, last) of kinds in groups of at most GROUP."""
    dealt = kinds.select("g", "c", "copies", "bytes").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(lean(lambda it: _expand_groups(it, length)), _RUNS)


def _counted(kinds: DataFrame, key: str) -> DataFrame:
    """Kinds and contexts of each group; a table of its own, so that a join with it can split a frequent key."""
    return kinds.groupBy(key).agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).where("total > 1")


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table (d, rk, spans) of the documents that have any: d is the id or 0, rk a hash of id and text, spans a list
    of (first, last) in bytes, last exclusive; they may overlap. Both sides of every join grow with the corpus, so all
    are shuffled, at every size."""
    if not K <= length <= MOST_LENGTH:
        raise ValueError(f"length must be from {K} to {MOST_LENGTH}")
    ship_package(docs.sparkSession)
    bits = _bits(length)
    start = F.expr(f"shiftright(packed, {2 * bits})")
    rows = _keyed(docs, id_col, text_col).where(F.octet_length("text") >= length).select("d", "rk", "text")
    listed = materialize(rows.mapInArrow(lean(lambda it: _list_contexts(it, length)), _LISTED), "suffix-contexts")
    twice = materialize(listed.groupBy("h").count().where("count > 1").select("h"), "suffix-twice")
    level = materialize(listed.join(twice.hint("merge"), "h"), "suffix-level")
    drop_tables(listed, twice)
    # equal contexts become one kind before anything meets by h
    kinds = materialize(level.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("d", "rk", "packed")).alias("one")), "suffix-kinds")
    sizes = materialize(_counted(kinds, "h"), "suffix-sizes")
    tagged = materialize(kinds.join(sizes.hint("merge"), "h").select("h", "c", "copies", "kinds", "one.*"), "suffix-tagged")
    drop_tables(kinds, sizes)
    whole = tagged.where("kinds = 1").select("h", "c", F.lit(0).alias("first"), (F.expr(f"shiftright(packed, {bits})").bitwiseAND((1 << bits) - 1) - 1).cast("int").alias("last"))
    found = tagged.where("kinds > 1").groupBy("d", "rk").agg(F.collect_list(F.struct("h", "c", "packed", "copies", "kinds")).alias("found"))
    cut = rows.join(found.hint("merge"), ["d", "rk"]).select("text", "found")
    strings = materialize(cut.mapInArrow(lean(lambda it: _cut_kinds(it, length)), _STRINGS), "suffix-strings")
    small = _expanded(strings.where(f"kinds <= {GROUP}").select(F.col("h").alias("g"), "c", "copies", "bytes"), length)
    runs = [materialize(whole.unionByName(small.withColumnRenamed("g", "h")), "suffix-runs")]
    large = strings.where(f"kinds > {GROUP}").select("h", "c", F.lit(0).alias("skip"), F.col("h").alias("g"), "n", "place", "copies", "bytes")
    width, held = length - K + 1, [tagged, strings]
    while width > 1 and large.head(1):
        width = -(-width // 2)
        halves = materialize(_halved(large, width, length), "suffix-halves")
        drop_tables(*held)
        sizes = materialize(_counted(halves.groupBy("g", "part").agg(F.sum("copies").alias("copies")), "g"), "suffix-sizes")
        tagged = materialize(halves.join(sizes.hint("merge"), "g"), "suffix-tagged")
        drop_tables(halves, sizes)
        whole = tagged.where("kinds = 1").select("h", "c", F.col("skip").alias("first"), (F.col("skip") + F.col("n") - 1).alias("last"))
        mixed = tagged.where(f"kinds > 1 and kinds <= {GROUP}")
        kinds = mixed.groupBy("g", "part").agg(F.first("bytes").alias("bytes"), F.sum("copies").alias("copies"))
        inside = _expanded(kinds.withColumnRenamed("part", "c"), length).withColumnRenamed("c", "part")
        inside = mixed.select("h", "c", "skip", "g", "part").join(inside.hint("merge"), ["g", "part"])
        inside = inside.select("h", "c", (F.col("skip") + F.col("first")).alias("first"), (F.col("skip") + F.col("last")).alias("last"))
        runs.append(materialize(whole.unionByName(inside), "suffix-runs"))
        large = tagged.where(f"kinds > {GROUP}").select("h", "c", "skip", "g", "n", "place", "copies", "bytes")
        held = [tagged]
    drop_tables(*held)
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    hit = level.select("h", "c", "d", "rk", start.alias("start")).join(every.hint("merge"), ["h", "c"])
    spans = hit.select("d", "rk", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + length).alias("last")).alias("span"))
    # a table before the lists, as a join that another key follows is split where it is skewed
    spans = materialize(spans, "suffix-spans")
    drop_tables(level, *runs)
    lists = materialize(spans.groupBy("d", "rk").agg(F.collect_set("span").alias("spans")), "suffix-lists")
    drop_tables(spans)
    return lists


def _halved(level: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts cut to the strings whose selected place p - start falls in one range of `width` places, grouped also
    by the bytes that all strings of such a range have in common; `part` tells the kinds of a group apart."""
    ranges = F.sequence(((F.col("place") - F.col("n") + 1) / width).cast("int"), (F.col("place") / width).cast("int"))
    parts = level.select("*", F.explode(ranges).alias("part"))
    # of the places a..b of this part, strings start at p - b .. p - a
    a, b = F.col("part") * width, F.col("part") * width + width - 1
    skip = F.greatest(F.lit(0), F.col("place") - b)
    n = F.least(F.col("n") - 1, F.col("place") - a) - skip + 1
    common = F.expr(f"substring(bytes, place - part * {width} + 1, {length} - {width} + 1)")
    parts = parts.select(
        "h", "c", (F.col("skip") + skip).cast("int").alias("skip"), F.xxhash64("g", "part", common).alias("g"), n.cast("int").alias("n"), (F.col("place") - skip).cast("int").alias("place"), "copies",
        F.expr(f"substring(bytes, greatest(0, place - (part * {width} + {width} - 1)) + 1, least(n - 1, place - part * {width}) - greatest(0, place - (part * {width} + {width} - 1)) + {length})").alias("bytes"),
    )
    return parts.select("*", F.xxhash64("place", "n", "bytes").alias("part"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the key d, rk of each row; `rk` alone would bring spans of another id where hashes agree."""
    return narrow(docs, id_col, text_col).select("*", F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("doc_id", "text").alias("rk"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, maximal spans of rows (first, last)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], axis=1)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_code_points: bool = False) -> DataFrame:
    """doc_id, rk, n_bytes, n_removed, n_spans, kept (binary) per document. With whole_code_points spans shrink to
    code point borders, so that what is kept is valid UTF-8."""
    ship_package(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col).join(spans.hint("merge"), ["d", "rk"], "left").select("doc_id", "rk", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text").cast(pa.large_binary()), batch.column("spans")
            kept, sizes = [], []
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                keep, removed, n = raw, 0, 0
                if lists[i].is_valid:
                    values = lists[i].values
                    runs = merged(np.stack([values.field(c).to_numpy() for c in ("first", "last")], axis=1))
                    if whole_code_points:
                        runs = np.array([[_border(raw, a, 1), _border(raw, b, -1)] for a, b in runs.tolist()])
                    n = len(runs)
                    edges = [0, *runs.ravel().tolist(), len(raw)]
                    keep = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                    removed = len(raw) - len(keep)
                kept.append(keep)
                sizes.append((len(raw), removed, n))
            sizes = np.array(sizes, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), *(pa.array(sizes[:, k].copy()) for k in range(3)), pa.array(kept, pa.binary())], names=["doc_id", "rk", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(lean(remove), "doc_id long, rk long, n_bytes long, n_removed long, n_spans long, kept binary")


def _border(raw: bytes, at: int, step: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", whole_code_points: bool = False) -> DataFrame:
    return remove_spans(docs, repeated_spans(docs, length, id_col, text_col), id_col, text_col, whole_code_points)


def cleaned_rows(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with all their columns, the text without its repeated passages (whole code points), and its
    number of code points anew in size_col. Null texts stay null."""
    spans = repeated_spans(docs, length, id_col, text_col)
    # positions, so that columns of any name go through
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    rows = docs.toDF(*names)
    doc_id, text = F.col(names[docs.columns.index(id_col)]).cast("long"), text_or_empty(F.col(names[at]))
    rows = rows.select("*", F.coalesce(doc_id, F.lit(0)).alias("d"), F.xxhash64(doc_id, text).alias("rk")).join(spans.hint("merge"), ["d", "rk"], "left").select(*names, "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at).cast(pa.large_binary()), batch.column("spans")
            out = []
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                if raw is not None and lists[i].is_valid:
                    values = lists[i].values
                    runs = merged(np.stack([values.field(c).to_numpy() for c in ("first", "last")], axis=1)).tolist()
                    edges = [0, *(e for a, b in runs for e in (_border(raw, a, 1), _border(raw, b, -1))), len(raw)]
                    raw = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append(None if raw is None else raw.decode())
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = rows.mapInArrow(lean(clean), rows.drop("spans").schema)
    if size_col in docs.columns:
        size = docs.columns.index(size_col)
        out = out.withColumn(names[size], F.length(names[at]).cast(docs.schema[size].dataType))
    return out.toDF(*docs.columns)


