"""Dense and hashed vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.lexicons import STOP_WORDS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The Euclidean length; 1 for zero vectors, so that they are like nothing."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def to_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(s: Column) -> Column:
    return F.from_json(s, "array<double>")


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, scaled to length one."""
    means = df.select(key, F.posexplode(vector)).groupBy(key, "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))
    return whole.select(key, F.transform("centroid", lambda x: x / norm(F.col("centroid"))).alias("centroid"))


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0), lambda t: ~t.isin(*STOP_WORDS))


def hashed_terms(df: DataFrame, id_col: str, text: Column, dim: int = 1024) -> DataFrame:
    """(id, bucket, weight): uni- and bigrams in `dim` buckets by md5, counts scaled to length one per id."""
    words = df.select(F.col(id_col), tokens(text).alias("t"))
    grams = F.concat("t", F.when(F.size("t") > 1, F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>")))
    bucket = F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("long") % dim
    counts = words.select(id_col, F.explode(grams).alias("gram")).groupBy(id_col, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    lengths = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(lengths, id_col).select(id_col, "bucket", (F.col("n") / F.col("length")).alias("weight"))
