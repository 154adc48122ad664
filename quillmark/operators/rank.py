"""Features, importance score and selection of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import lexicons
from quillmark.functions import text as X

LISTS = {"policy": lexicons.POLICY, "ground": lexicons.GROUND, "region": lexicons.REGION, "downweight": lexicons.DOWNWEIGHT}


def _mask(text: Column, words: tuple[str, ...]) -> Column:
    """A bit per keyword that is in the text, letter case aside; at most 63."""
    pairs = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(1 << i).cast("long").alias("bit")) for i, w in enumerate(words)))
    # the lower-cased text is bound once, not once a keyword
    bits = F.transform(F.array(F.lower(text)), lambda t: F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + F.when(F.contains(t, x["w"]), x["bit"]).otherwise(0)))
    return F.element_at(bits, 1)


def _named(mask: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w, i: F.getbit(mask, i) == 1)


def event_features(items: DataFrame, now: Column, lists: dict[str, tuple[str, ...]] | None = None, key: str = "event_id") -> DataFrame:
    """Features per event of items (key, id, source_name, source_tier, title, content, ts): counts, the keywords of
    each list that any item has (sorted) and their number, and the hours since the last item.

    Keywords are found in each item's title and content, between blanks, as bits; only the bits of an event meet, never
    its texts, so an event may have any number of items."""
    lists = lists or LISTS
    tier = F.col("source_tier")
    text = F.concat(F.lit(" "), F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")), F.lit(" "))
    masks = {name: [words[a : a + 63] for a in range(0, len(words), 63)] for name, words in lists.items()}
    marked = items.select(key, "source_name", "source_tier", "ts", *(_mask(text, part).alias(f"{name}_{k}") for name, parts in masks.items() for k, part in enumerate(parts)))
    grouped = marked.groupBy(key).agg(
        F.count("*").alias("num_items"), F.countDistinct("source_name").alias("distinct_sources"),
        *(F.countDistinct(F.when(tier == n, F.col("source_name"))).alias(f"tier{n}_sources") for n in (1, 2, 3)),
        F.bool_and(tier == 3).alias("signal_only"), F.max("ts").alias("last_ts"),
        *(F.bit_or(f"{name}_{k}").alias(f"{name}_{k}") for name, parts in masks.items() for k in range(len(parts))),
    )
    found = {name: F.array_sort(F.array_distinct(F.concat(*(_named(F.col(f"{name}_{k}"), part) for k, part in enumerate(parts))))) for name, parts in masks.items()}
    grouped = grouped.select("*", *(words.alias(f"{name}_matched") for name, words in found.items())).drop(*(f"{name}_{k}" for name, parts in masks.items() for k in range(len(parts))))
    hits = [F.size(f"{name}_matched").alias(f"{name}_hits") for name in lists]
    anchor = (F.col("tier1_sources") > 0) | (F.col("tier2_sources") > 0)
    hours = F.greatest(F.lit(0.0), X.hours_between(now, F.col("last_ts")))
    return grouped.select("*", *hits, anchor.alias("tier_1_anchor"), F.round(hours, 6).alias("recency_hours")).drop("last_ts")


def importance_score(recency_window: float = 48.0) -> Column:
    """The score from the columns of event_features."""
    c, least = F.col, F.least
    t1, t2, t3 = c("tier1_sources") > 0, c("tier2_sources") > 0, c("tier3_sources") > 0
    ground, region, h = c("ground_hits"), c("region_hits"), c("recency_hours")
    when = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0.0))
    terms = [
        F.when(t1, 2.5).when(t2, 1.5).otherwise(0.0),
        0.9 * least(c("distinct_sources"), F.lit(8)),
        0.5 * least(c("tier1_sources"), F.lit(4)),
        0.5 * least(c("tier2_sources"), F.lit(4)),
        0.5 * least(c("policy_hits"), F.lit(5)),
        0.8 * least(ground, F.lit(5)),
        F.when(region >= 3, 3.0).when(region == 0, -4.0).otherwise(0.0),
        when(~t1 & (c("tier2_sources") >= 2) & (ground >= 1), 2.5),
        when(t3 & (t1 | t2), 1.0),
        when(t1 & ~t2 & (ground == 0) & (c("distinct_sources") <= 2), -1.5),
        F.when(ground >= 1, F.when(h <= 24, 3 * (1 - h / 24)).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - h / recency_window)),
        -0.7 * least(c("downweight_hits"), F.lit(6)),
        when(c("signal_only"), -3.0),
        when((c("distinct_sources") == 1) & ~c("tier_1_anchor"), -1.0),
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.round(F.greatest(F.lit(0.0), total), 6)


def select_top(scored: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """The n best anchored events with a positive score; ties by id as text."""
    return scored.where(F.col("tier_1_anchor") & (F.col("score") > 0)).orderBy(F.desc("score"), F.col(key).cast("string")).limit(n)


def with_status(events: DataFrame, selected: DataFrame, key: str = "event_id") -> DataFrame:
    """selected events get that status; others that had it go back to candidate; published and rejected ones stay."""
    s = selected.select(key, F.lit(True).alias("__selected"))
    open_ = F.col("status").isin("candidate", "selected")
    status = F.when(open_ & F.col("__selected").isNotNull(), "selected").when(F.col("status") == "selected", "candidate").otherwise(F.col("status"))
    return events.join(s, key, "left").withColumn("status", status).drop("__selected")


def promote_next(events: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """The next n candidates by stored score."""
    ok = (F.col("status") == "candidate") & F.col("tier_1_anchor") & (F.col("importance_score") > 0)
    return events.where(ok).orderBy(F.desc("importance_score"), key).limit(n)


def topup_batch(deficit: Column) -> Column:
    return F.least(F.greatest(deficit * 2, F.lit(5)), F.lit(15))
