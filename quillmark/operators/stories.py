"""Stories: duplicates, images, and the rendered edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions.lexicons import JUNK_HOSTS, JUNK_URL_PARTS
from quillmark.operators.cluster import similar_pairs
from quillmark.runtime import drop_tables, materialize

#: Similarities from which stories may be one, for pairs with events on the ground, and without a judge; fixed values.
SAME, SAME_GROUND, SAME_UNJUDGED = 0.80, 0.87, 0.92


def story_pairs(stories: DataFrame, base: float = SAME, ground: float = SAME_GROUND) -> DataFrame:
    """Pairs of stories (story_id, unit vector u, is_ground) with each pair's own threshold; the smaller id first."""
    pairs = similar_pairs(stories, "story_id", "u", min(base, ground), extra=["is_ground"])
    both = pairs.select(F.col("story_id_i").alias("i"), F.col("story_id_j").alias("j"), "similarity", F.when(F.col("is_ground_i") | F.col("is_ground_j"), ground).otherwise(base).alias("threshold"))
    return both.where("similarity >= threshold")


def judged(pairs: DataFrame, verdicts: DataFrame | None = None, least: float = SAME_UNJUDGED) -> DataFrame:
    """Of pairs (i, j, similarity) those that are one story: by verdicts (i, j, same), without one by their similarity."""
    if verdicts is None:
        return pairs.where(F.col("similarity") >= least)
    said = verdicts.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "same").groupBy("i", "j").agg(F.bool_or("same").alias("same"))
    return pairs.join(said, ["i", "j"], "left").where(F.coalesce("same", F.col("similarity") >= least)).drop("same")


def greedy_dedup(pairs: DataFrame, stories: DataFrame, least: float = SAME_UNJUDGED, verdicts: DataFrame | None = None) -> DataFrame:
    """(dropped, kept): pairs in descending similarity that are one story; each with both stories still there drops the one
    of lower importance (nulls lowest; of equals the second). Rounds decide all pairs that come first for both of their
    stories at once, which is the same as one after another and needs no single task."""
    rank = stories.select("story_id", F.coalesce("importance_score", F.lit(-1e18)).alias("importance"))
    open_ = judged(pairs, verdicts, least).select("i", "j", "similarity")
    open_ = open_.join(rank.select(F.col("story_id").alias("i"), F.col("importance").alias("a")), "i").join(rank.select(F.col("story_id").alias("j"), F.col("importance").alias("b")), "j")
    left, done = materialize(open_, "greedy-pairs"), []
    while left.head(1):
        key = F.struct(-F.col("similarity"), "i", "j")
        ends = left.select(F.explode(F.array("i", "j")).alias("s"), key.alias("k"))
        first = ends.groupBy("s").agg(F.min("k").alias("k"))
        fi, fj = (first.select(F.col("s").alias(c), F.col("k").alias(f"k_{c}")) for c in "ij")
        ready = left.join(fi, "i").join(fj, "j").where((F.col("k_i") == key) & (F.col("k_j") == key))
        drop = F.when(F.col("a") < F.col("b"), F.col("i")).otherwise(F.col("j"))
        decided = materialize(ready.select(drop.alias("dropped"), F.when(F.col("a") < F.col("b"), F.col("j")).otherwise(F.col("i")).alias("kept")), "greedy-round")
        done.append(decided)
        gone = decided.select(F.col("dropped").alias("i")).distinct()
        # the dropped story's other pairs go; the pair itself goes with it
        rest = materialize(left.join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti"), "greedy-pairs")
        drop_tables(left)
        left = rest
    out = done[0] if done else left.select(F.col("i").alias("dropped"), F.col("j").alias("kept"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def image_score(index: Column, width: Column, height: Column, caption: Column) -> Column:
    long = F.least(F.length(caption), F.lit(100))
    base = 10 - 0.3 * F.least(index, F.lit(20)) + 0.001 * F.coalesce(width, F.lit(0)) + 0.001 * F.coalesce(height, F.lit(0))
    return base + F.when(F.length(caption) > 0, 3 + 0.02 * long).otherwise(0.0)


def large_enough(width: Column, height: Column) -> Column:
    return (width.isNull() | (width >= 300)) & (height.isNull() | (height >= 200))


def is_junk_url(url: Column) -> Column:
    """Empty, inline, with a part that marks page furniture, or on a host that allows no links."""
    low = F.lower(url)
    part = F.exists(F.array(*map(F.lit, JUNK_URL_PARTS)), lambda p: low.contains(p))
    return F.coalesce((url == "") | url.startswith("data:") | part | X.url_host(url).isin(*JUNK_HOSTS), F.lit(True))


def top_images(candidates: DataFrame, k: int = 3) -> DataFrame:
    """candidates (story_id, seq, url, score): best first, one per normalised URL, k a story, ordinals from 0."""
    key = X.normalise_image_url(F.col("url"))
    best = F.row_number().over(Window.partitionBy("story_id", "url_key").orderBy(F.desc("score"), "seq"))
    one = candidates.withColumn("url_key", key).withColumn("n", best).where("n = 1")
    ordinal = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("score"), "seq")) - 1
    return one.withColumn("ordinal", ordinal).where(F.col("ordinal") < k).select("story_id", "ordinal", "url", "score")


def citations(cited: DataFrame, key: str) -> DataFrame:
    """cited (key, at, name, url): `[name](url)` of distinct names in order of their first place."""
    n = F.row_number().over(Window.partitionBy(key, "name").orderBy("at"))
    one = cited.withColumn("n", n).where("n = 1").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.format_string("[%s](%s)", "name", "url").alias("c")))).alias("l"))
    return one.select(key, F.array_join(F.transform("l", lambda x: x["c"]), ", ").alias("citations"))
