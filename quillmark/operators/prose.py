"""Text about events as columns: contexts, offline reports and debates, fact lists, digests, time contexts.

Relations: docs (event_id, id, source_name, source_tier, source_url, title, text) and claims (event_id, idx,
claim_text, source_ids array<string>, ...). An event's own lists are gathered per event; they are what its text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X

# Wordings that results must equal.
TIER_NAMES = ("primary", "wire", "signal")
NO_CLAIMS = "This story is reconstructed from the ingested sources; no verified claims are available."
NO_FACTS = "- (no sourced facts available)"
NOTHING_REPORTED = "No sourced facts were reported."
LIMITED = "Background is limited to what these sources report; no outside information has been added."
SIDES = ("What is being reported", "Why it remains unverified")
SUMMARIZES = "The reporting summarizes what the cited outlets say:\n"
UNCONFIRMED = (
    "No primary or official source has confirmed this account; it rests on %d non-primary outlet(s) (%s). Until an official record "
    "corroborates it, treat the specifics above as unverified reporting rather than established fact."
)
INDEPENDENT = "The outlets above are independent of one another, and cross-source corroboration is itself a form of verification even without a government statement."
ALONE = "This account depends on a single outlet; treat with caution."
REPEATED = "Independent outlets can still repeat one another; without a primary source (%s), the underlying claim remains uncorroborated by any official record."
CONCLUSION = (
    "Both sides accept the outlets summarized above. What is contested is whether %d independent non-primary outlet(s) constitute sufficient "
    "corroboration in the absence of an official record. Until a primary source confirms the specifics, treat this as reporting rather than established fact."
)
UNDATED = "The event's date is unknown; do not invent one. Prefer present-tense framing without a date in the headline."
FUTURE = "future-stamped source (do not surface as 'today')"
LONG_DATE = "EEEE, dd MMMM yyyy"


def with_citations(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds outlets (sorted distinct names) and links (`[name](url)` by first place) of the known sources of each claim."""
    known = docs.select("event_id", F.col("id").cast("string").alias("sid"), "source_name", F.coalesce("source_url", F.lit("")).alias("url"))
    used = claims.select("event_id", "idx", F.posexplode("source_ids").alias("at", "sid")).join(known, ["event_id", "sid"])
    named = used.groupBy("event_id", "idx", "source_name").agg(F.min(F.struct("at", "url")).alias("first"))
    link = F.struct(F.col("first.at").alias("at"), F.format_string("[%s](%s)", "source_name", "first.url").alias("link"))
    lists = named.groupBy("event_id", "idx").agg(F.array_sort(F.collect_set("source_name")).alias("outlets"), F.array_sort(F.collect_list(link)).alias("found"))
    none = F.array().cast("array<string>")
    out = claims.join(lists, ["event_id", "idx"], "left")
    return out.withColumns({"outlets": F.coalesce("outlets", none), "links": F.coalesce(F.transform("found", lambda x: x["link"]), none)}).drop("found")


def per_event(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per event that has docs: its counts and lists of docs, and its cited claims in order (`claims`)."""
    tier = F.col("source_tier")
    doc = F.struct(tier.alias("tier"), F.col("source_name").alias("name"), F.coalesce("source_url", F.lit("")).alias("url"), F.col("id").cast("string").alias("id"))
    of_docs = docs.groupBy("event_id").agg(
        F.count("*").alias("n_docs"), *(F.count_if(tier == k + 1).alias(f"n_{name}") for k, name in enumerate(TIER_NAMES)),
        F.array_sort(F.collect_set("source_name")).alias("outlets"), F.array_sort(F.collect_list(doc)).alias("docs"),
    )
    claim = F.struct("idx", "claim_text", "verified", "tier_1_backed", "note", "outlets", "links")
    of_claims = with_citations(claims, docs).groupBy("event_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    joined = of_docs.join(of_claims, "event_id", "left")
    kind = "array<struct<idx:int,claim_text:string,verified:boolean,tier_1_backed:boolean,note:string,outlets:array<string>,links:array<string>>>"
    return joined.withColumn("claims", F.coalesce(F.col("claims").cast(kind), F.array().cast(kind)))


def _joined(names: Column) -> Column:
    return F.array_join(names, ", ")


def local_context() -> Column:
    """Over a row of per_event: how many docs of which tiers, and the first six outlets."""
    tiers = _joined(F.array_compact(F.array(*(F.when(F.col(f"n_{t}") > 0, F.format_string("%d %s", F.col(f"n_{t}"), F.lit(t))) for t in sorted(TIER_NAMES)))))
    n = F.size("outlets")
    named = F.concat(_joined(F.slice("outlets", 1, 6)), F.when(n > 6, " and others").otherwise(""))
    head = F.format_string("This story is reconstructed from %d source item(s) (%s) across %d outlet(s): %s. ", F.col("n_docs"), tiers, n, named)
    return F.concat(head, F.lit(LIMITED))


def local_report(title: Column, claims: Column) -> Column:
    """The title and up to eight claims with their outlets, as paragraphs."""
    cited = F.transform(F.slice(claims, 1, 8), lambda c: F.format_string("%s (%s).", F.regexp_replace(c["claim_text"], r"\.+$", ""), _joined(c["outlets"])))
    return F.when(F.size(claims) == 0, NO_CLAIMS).otherwise(F.array_join(F.concat(F.array(F.trim(F.coalesce(title, F.lit("")))), cited), "\n\n"))


def local_debate(claims: Column) -> Column:
    """Over a row of per_event: four turns and a conclusion."""
    points = F.array_join(F.transform(claims, lambda c: F.format_string("- %s (%s)", c["claim_text"], _joined(c["outlets"]))), "\n")
    n = F.size("outlets")
    primary = _joined(F.transform(F.filter("docs", lambda d: d["tier"] == 1), lambda d: d["name"]))
    turns = (
        (SIDES[0], F.concat(F.lit(SUMMARIZES), F.when(points == "", NOTHING_REPORTED).otherwise(points))),
        (SIDES[1], F.format_string(UNCONFIRMED, n, _joined(F.col("outlets")))),
        (SIDES[0] + " (rebuttal)", F.when(n > 1, INDEPENDENT).otherwise(ALONE)),
        (SIDES[1] + " (closing)", F.format_string(REPEATED, F.when(primary == "", "none available").otherwise(primary))),
        ("Bottom line", F.format_string(CONCLUSION, n)),
    )
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"**{side}:** "), said) for side, said in turns))


def facts_block(claims: Column, marked: bool = False) -> Column:
    """A line per claim with its outlets; marked adds which are backed by a primary source."""
    outlets = lambda c: F.when(F.size(c["outlets"]) == 0, "none").otherwise(_joined(c["outlets"]))
    backed = lambda c: F.when(c["tier_1_backed"] & F.lit(marked), " [tier-1 backed]").otherwise("")
    lines = F.transform(claims, lambda c: F.concat(F.format_string("- %s (sources: %s)", c["claim_text"], outlets(c)), backed(c)))
    return F.when(F.size(claims) == 0, NO_FACTS).otherwise(F.array_join(lines, "\n"))


def source_digest(docs: DataFrame, most: int = 8, budget: int = 900) -> DataFrame:
    """(event_id, digest): an event's docs of the best tiers, then longest texts, cleaned and cut to a budget."""
    text = F.coalesce("text", F.lit(""))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("source_tier", -F.length(text), F.col("id").cast("string")))
    body = F.coalesce(X.strip_boilerplate(F.trim(text)), F.lit(""))
    body = F.when(F.length(body) > budget, F.concat(F.substring(body, 1, budget), F.lit(" ..."))).otherwise(body)
    tier = F.element_at(F.array(*map(F.lit, TIER_NAMES)), F.col("source_tier").cast("int"))
    head = F.format_string("[SOURCE id=%s name=%s tier=%s]", F.col("id").cast("string"), "source_name", tier)
    block = F.concat_ws("\n", head, F.trim(F.coalesce("title", F.lit(""))), body)
    top = docs.withColumn("rank", rank).where(F.col("rank") <= most).select("event_id", "rank", block.alias("block"))
    return top.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("digest"))


def time_context(now: Column, first_seen: Column, earliest: Column) -> Column:
    """What today is and when an event was first reported, by calendar days; unknown and future dates say so."""
    at = F.coalesce(earliest, first_seen)
    days = F.datediff(now.cast("date"), at.cast("date"))
    ago = F.format_string(" (%d days ago)", days)
    when = (
        F.when(at > now, FUTURE).when(days == 0, "today").when(days == 1, "yesterday").when(days <= 6, F.concat(F.date_format(at, "EEEE"), ago))
        .when(days <= 30, F.concat(F.date_format(at, "dd MMMM"), ago)).otherwise(F.format_string("%s — archive piece (%d days ago)", F.date_format(at, "dd MMMM yyyy"), days))
    )
    reported = F.format_string("This event was first reported: %s (%s).", F.date_format(at, LONG_DATE), when)
    return F.concat_ws("\n", F.lit("TIME CONTEXT"), F.format_string("TODAY IS %s.", F.date_format(now, LONG_DATE)), F.when(at.isNull(), UNDATED).otherwise(reported))
