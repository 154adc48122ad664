"""Events from items: similarity joins in time bands, then connected components."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions.vector import dot, norm
from quillmark.operators.graph import connected_components
from quillmark.runtime import materialize


#: Pivots that vectors are dealt by at most, vectors that make one more pivot worth while, and vectors of a block, about.
PIVOTS, PER_PIVOT, BLOCK = 64, 500, 1024


def band_pairs(df: DataFrame, id_col: str, ts_col: str, hours: float, extra: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Pairs i < j at most `hours` apart, and equal in the columns `on`: the earlier row of a pair meets the later one in
    its own band of that width or in the next, so each row is in two bands at most."""
    micros = F.unix_micros(ts_col)
    width = int(hours * 3_600_000_000)
    cols, on = [id_col, *(extra or [])], on or []
    band = F.floor(micros / width)
    a = df.select(*(F.col(c).alias(f"{c}_a") for c in cols), *on, micros.alias("t_a"), band.alias("band"))
    b = df.select(*(F.col(c).alias(f"{c}_b") for c in cols), *on, micros.alias("t_b"), F.explode(F.array(band - 1, band)).alias("band"))
    later = (F.col("t_a") < F.col("t_b")) | ((F.col("t_a") == F.col("t_b")) & (F.col(f"{id_col}_a") < F.col(f"{id_col}_b")))
    met = a.join(b, ["band", *on]).where(later & (F.col("t_b") - F.col("t_a") <= width))
    first = F.col(f"{id_col}_a") < F.col(f"{id_col}_b")
    return met.select(*(F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{k}") for c in cols for k, x, y in (("i", "a", "b"), ("j", "b", "a"))), *on)


def _cells(pivots: list[list[float]], reach: float, all_cells: bool) -> Column:
    """Of a unit vector: the cell of its nearest pivot, or all cells that may hold a vector within `reach` of it."""
    import numpy as np

    p = np.array(pivots, np.float64)

    def cells(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        far = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T))
        if not all_cells:
            return pd.Series(far.argmin(axis=1).astype("int64"))
        # a vector at most r away has its own nearest pivot at most 2r further from here than the nearest one is
        near = far <= far.min(axis=1)[:, None] + 2 * reach + 1e-9
        return pd.Series([np.flatnonzero(n).astype("int64") for n in near])

    return F.pandas_udf(cells, "array<long>" if all_cells else "long", F.PandasUDFType.SCALAR)(F.col("u"))


def _products(a: DataFrame, b: DataFrame, keys: list[str], least: float, width: int | None = None) -> DataFrame:
    """(x, y, similarity) of rows (keys, x, u, t) of a and b that agree in the keys, whose inner product of u is at least
    `least` (6 digits) and whose t differ by `width` at most. Rows meet in blocks, as matrices, not one by one."""
    import numpy as np
    import pyarrow as pa

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("n"))
        dealt = df.join(n, keys).withColumn("block", F.pmod(F.xxhash64("x", "u"), F.col("n")))
        lists = dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct("x", "u", "t")).alias("l"))  # a block, bounded
        return lists.select(*keys, F.col("l.x").alias(f"{name}x"), F.flatten("l.u").alias(f"{name}u"), F.col("l.t").alias(f"{name}t"))

    both = blocks(a, "a").join(blocks(b, "b"), keys).drop(*keys)

    def meet(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ax, bx = batch.column("ax")[r].values, batch.column("bx")[r].values
                u, v = (np.array(batch.column(c)[r].values, np.float64).reshape(len(x), -1) for c, x in (("au", ax), ("bu", bx)))
                product = np.round(u @ v.T, 6)
                hit = product >= least
                if width is not None:
                    s, t = (np.array(batch.column(c)[r].values, np.int64) for c in ("at", "bt"))
                    hit &= np.abs(s[:, None] - t[None, :]) <= width
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([ax.take(pa.array(i)), bx.take(pa.array(j)), pa.array(product[i, j])], names=["x", "y", "similarity"])

    schema = a.select("x").schema.add("y", b.schema["x"].dataType).add("similarity", "double")
    return both.mapInArrow(meet, schema)


def similar_pairs(df: DataFrame, id_col: str, vector: str, threshold: float, ts_col: str | None = None, hours: float = 48.0, extra: list[str] | None = None) -> DataFrame:
    """Pairs i < j of vectors with a cosine of at least the threshold (rounded to 6 digits), with a time column only
    those at most `hours` apart: columns of i and j, similarity. Rows without a vector take no part.

    Vectors are dealt to the cells of a bounded sample of them; one meets the cells that may hold something near enough,
    which the triangle inequality tells, so no pair is lost. The sample holds one vector in PER_PIVOT, PIVOTS at most."""
    cols = [id_col, *(extra or [])]
    unit = F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector)))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*cols, *([ts_col] if ts_col else []), unit.alias("u"), F.size(vector).alias("dim"))
    rows = materialize(rows, "similar-vectors")
    shapes = rows.groupBy("dim").count().collect()  # a row per dimension
    out = []
    for dim, n in shapes:
        own = rows.where(F.col("dim") == dim)
        sample = [list(r[0]) for r in own.select("u").orderBy(F.xxhash64("u"), id_col).limit(min(PIVOTS, n // PER_PIVOT + 1)).collect()]
        reach = math.sqrt(max(0.0, 2 - 2 * (threshold - 1e-6)))
        at = own.withColumn("home", _cells(sample, reach, False))
        to = own.withColumn("cell", F.explode(_cells(sample, reach, True)))
        if ts_col:
            micros, width = F.unix_micros(ts_col), int(hours * 3_600_000_000)
            band = F.floor(micros / width)
            at, to = at.withColumns({"t": micros, "band": band}), to.withColumns({"t": micros, "band": F.explode(F.array(band - 1, band, band + 1))})
        keys = ["cell", *(["band"] if ts_col else [])]
        time = [F.col("t")] if ts_col else [F.lit(0).cast("long").alias("t")]
        a = at.select(F.col("home").alias("cell"), *keys[1:], F.struct(*(F.col(c).alias(f"{c}_i") for c in cols)).alias("x"), "u", *time)
        b = to.select("cell", *keys[1:], F.struct(*(F.col(c).alias(f"{c}_j") for c in cols)).alias("x"), "u", *time)
        # i in its own cell meets j wherever that may be near: each pair once, in the cell (and band) of its smaller id
        met = _products(a, b, keys, threshold, width if ts_col else None)
        out.append(met.select("x.*", "y.*", "similarity").where(F.col(f"{id_col}_i") < F.col(f"{id_col}_j")).select(*(f"{c}_{k}" for c in cols for k in "ij"), "similarity"))
    if not out:
        return df.sparkSession.createDataFrame([], ", ".join(f"{c}_{k} {df.schema[c].dataType.simpleString()}" for c in cols for k in "ij") + ", similarity double")
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def dense_pairs(df: DataFrame, id_col: str, vector: str, threshold: float, ts_col: str | None = None, hours: float = 48.0) -> DataFrame:
    """Pairs of vectors with a cosine of at least the threshold; with a time column only pairs in its band."""
    return similar_pairs(df, id_col, vector, threshold, ts_col, hours)


def sparse_pairs(weights: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Pairs of sparse unit vectors (id, bucket, weight) by an inverted index: only rows that share a bucket meet, and
    their products are summed before the shuffle. Buckets in fewer rows cost less, so hash to many where rows are many."""
    i = weights.select(F.col(id_col).alias("i"), "bucket", F.col("weight").alias("a"))
    j = weights.select(F.col(id_col).alias("j"), "bucket", F.col("weight").alias("b"))
    met = i.join(j, "bucket").where("i < j")
    sums = met.groupBy("i", "j").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("similarity"))
    return sums.where(F.col("similarity") >= threshold)


def rare_pairs(weights: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Pairs of sparse unit vectors (id, bucket, weight) as sparse_pairs finds them, by an inverted index of their rarest buckets; for many buckets.

    Of a vector's buckets, the most frequent ones whose part is shorter than the threshold are no meeting place: two
    vectors that share none of their other buckets have a smaller product (the rest of one of them times a unit vector).
    Pairs that meet are decided on all their buckets."""
    frequency = weights.groupBy("bucket").agg(F.count("*").alias("df"))
    often = Window.partitionBy(id_col).orderBy(F.desc("df"), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    rest = weights.join(frequency, "bucket").withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(often))
    # half a unit of the sixth digit, which rounding may add, and what sums may be off by
    rare = rest.where(F.col("rest") >= max(threshold - 1e-6, 0.0) ** 2).select(F.col(id_col).alias("i"), "bucket")
    met = rare.join(rare.withColumnRenamed("i", "j"), "bucket").where("i < j").select("i", "j").distinct()
    a = weights.select(F.col(id_col).alias("i"), "bucket", F.col("weight").alias("a"))
    b = weights.select(F.col(id_col).alias("j"), "bucket", F.col("weight").alias("b"))
    sums = met.join(a, "i").join(b, ["j", "bucket"]).groupBy("i", "j").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("similarity"))
    return sums.where(F.col("similarity") >= threshold)


def event_clusters(items: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of items by components of pairs, and the bridge (event_id, raw_item_id) of their items."""
    member = materialize(components(pairs, items, "id").select(F.col("component").alias("event_id"), F.col("id").alias("raw_item_id")), "event-items")
    return _events(items, member), member


def components(pairs: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, component) of all nodes; those without a pair are components of their own."""
    found = connected_components(pairs.select(F.col(pairs.columns[0]).alias("src"), F.col(pairs.columns[1]).alias("dst")), "clusters")
    return nodes.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cluster_events(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events of items (id, source_name, source_tier, title, content, published_at, fetched_at) by components of pairs:
    event_id (smallest item), title, summary, first_seen_at, last_seen_at, tier_1_anchor, items."""
    return event_clusters(items, pairs)[0]


def _events(items: DataFrame, member: DataFrame) -> DataFrame:
    ts = F.coalesce("published_at", "fetched_at")
    member = member.join(items.withColumn("ts", ts), F.col("raw_item_id") == F.col("id"))
    best: Column = F.struct("source_tier", -F.unix_micros("ts"), "id")
    out = member.groupBy("event_id").agg(
        F.min_by(F.struct("title", "content"), best).alias("r"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"),
        F.bool_or(F.col("source_tier") <= 2).alias("tier_1_anchor"), F.count("*").alias("num_items"),
    )
    return out.select("event_id", X.event_title(F.col("r.title"), F.col("r.content")).alias("title"), X.event_summary(F.col("r.content")).alias("summary"), "first_seen_at", "last_seen_at", "tier_1_anchor", "num_items")


def representative(items: DataFrame, key: str) -> DataFrame:
    ts = F.coalesce("published_at", "fetched_at")
    return items.groupBy(key).agg(F.min_by("id", F.struct("source_tier", -F.unix_micros(ts), "id")).alias("representative"))


def nearest(queries: DataFrame, items: DataFrame, key: str, most: float, k: int, but: DataFrame | None = None) -> DataFrame:
    """Per query (key, centroid) the k items (id, embedding) at a cosine distance under `most`, without the pairs (key, id)
    in `but`. Both sides are dealt by a bounded sample of the items, as in similar_pairs, and meet only where the triangle
    inequality allows a distance under `most`."""
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / norm(F.col(c)))
    q = queries.where(F.size("centroid") > 0).select(key, unit("centroid").alias("u"), F.size("centroid").alias("dim"))
    x = materialize(items.where(F.size("embedding") > 0).select("id", unit("embedding").alias("u"), F.size("embedding").alias("dim")), "nearest-items")
    found = None
    for dim, n in x.groupBy("dim").count().collect():  # a row per dimension
        own = x.where(F.col("dim") == dim)
        sample = [list(r[0]) for r in own.select("u").orderBy(F.xxhash64("u"), "id").limit(min(PIVOTS, n // PER_PIVOT + 1)).collect()]
        reach = math.sqrt(max(0.0, 2 * (most + 1e-6)))
        zero = F.lit(0).cast("long").alias("t")
        a = q.where(F.col("dim") == dim).withColumn("cell", F.explode(_cells(sample, reach, True))).select("cell", F.struct(key).alias("x"), "u", zero)
        b = own.withColumn("cell", _cells(sample, reach, False)).select("cell", F.struct("id").alias("x"), "u", zero)
        met = _products(a, b, ["cell"], 1 - most - 2e-6).select("x.*", "y.*", F.round(1 - F.col("similarity"), 6).alias("distance")).where(F.col("distance") < most)
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = queries.select(key, F.lit(None).alias("id").cast(items.schema["id"].dataType), F.lit(0.0).alias("distance")).limit(0)
    if but is not None:
        found = found.join(but.select(key, "id"), [key, "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
