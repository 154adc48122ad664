"""Whole runs: building stories of all selected events at once, and publishing with bounded top-up passes.

Relations: events (event_id, title, summary, first_seen_at, last_seen_at, importance_score, tier_1_anchor, status) and
docs (event_id, id, source_name, source_tier, source_url, title, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import vector as V
from quillmark.functions.lexicons import CONTROVERSY, GROUND
from quillmark.operators import audit, claims, cluster, rank
from quillmark.operators.stories import SAME, SAME_GROUND, SAME_UNJUDGED, greedy_dedup
from quillmark.runtime import materialize

#: Hours, cosine distance and number of official answers that an event may get; fixed values.
RESPONSE_HOURS, RESPONSE_DISTANCE, RESPONSES = 48, 0.35, 3
PASSES = 3


def modes(docs: DataFrame, words: tuple[str, ...] = CONTROVERSY) -> DataFrame:
    """(event_id, hits, mode): distinct keywords in any doc of an event; without one a report, else a debate."""
    text = F.concat_ws(" ", "title", "text")
    hits = docs.select("event_id", F.explode_outer(X.keyword_hits(text, words)).alias("word")).groupBy("event_id").agg(F.countDistinct("word").alias("hits"))
    return hits.withColumn("mode", F.when(F.col("hits") < 1, "report").otherwise("debate"))


def responses(events: DataFrame, docs: DataFrame, items: DataFrame, now: Column, most: float = RESPONSE_DISTANCE) -> DataFrame:
    """Docs that answer an event: the nearest recent official items outside it, by the centroid of its own embeddings.

    items (id, source_name, source_tier, source_url, title, content, fetched_at, embedding). Titles tell the hours between event and answer."""
    own = docs.select("event_id", F.col("id").cast("string").alias("id"))
    x = items.withColumn("id", F.col("id").cast("string"))
    centre = V.centroids(own.join(x.where("embedding is not null").select("id", "embedding"), "id"), "event_id", "embedding")
    recent = x.where("source_tier = 1 and embedding is not null").where(F.col("fetched_at") >= now - F.expr(f"INTERVAL {RESPONSE_HOURS} HOURS"))
    best = cluster.nearest(centre, recent.select("id", "embedding"), "event_id", most, RESPONSES, but=own)
    found = best.select("event_id", "id").join(x, "id").join(events.select("event_id", "last_seen_at"), "event_id")
    gap = F.coalesce(F.format_string("[response %sh from main event] ", X.signed_gap(F.col("fetched_at"), F.col("last_seen_at"))), F.lit("[official response] "))
    title = F.substring(F.concat(gap, F.trim(F.coalesce("title", F.lit("")))), 1, 280)
    return found.select(
        "event_id", "id", F.concat("source_name", F.lit("-response")).alias("source_name"), F.lit(1).alias("source_tier"),
        F.coalesce("source_url", F.lit("")).alias("source_url"), title.alias("title"), F.trim(F.coalesce("content", F.lit(""))).alias("text"),
    )


def with_responses(events: DataFrame, docs: DataFrame, items: DataFrame, now: Column, words: tuple[str, ...] = CONTROVERSY) -> DataFrame:
    """Docs and, for events with a sign of controversy, the official answers to them."""
    contested = modes(docs, words).where("hits >= 1").select("event_id")
    return with_more(docs, responses(events, docs.join(contested, "event_id", "left_semi"), items, now))


def with_more(docs: DataFrame, *more: DataFrame) -> DataFrame:
    """Docs and further ones (official answers, research), all of them."""
    columns = ["event_id", F.col("id").cast("string").alias("id"), "source_name", F.col("source_tier").cast("int").alias("source_tier"), "source_url", "title", "text"]
    out = docs.select(*columns)
    for m in more:
        out = out.unionByName(m.select(*columns))
    return out


def build_parts(
    events: DataFrame, docs: DataFrame, words: tuple[str, ...] = CONTROVERSY, verdicts: DataFrame | None = None, items: DataFrame | None = None, now: Column | None = None,
    answers: DataFrame | None = None, cuts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stories of all events that have docs, and their claims: official answers (with items and a clock), claims,
    verification, verdicts where given, the editor's cut where given, mode, audit, markdown.

    answers (event_id, answer): what a model drafted; events without usable drafts get the offline claims. cuts (event_id,
    contradicted, unsupported): places among an event's claims that the editor cuts, the latter within bounds."""
    own = docs.join(events.select("event_id"), "event_id", "left_semi")
    moded = events.drop("mode").join(modes(own, words), "event_id")
    if items is not None and now is not None:
        own = materialize(with_responses(events, own, items, now, words), "story-docs")
    drafted = claims.local_claims(own).select("event_id", F.col("ordinal").alias("idx"), "claim_text", F.array("source_id").alias("source_ids"))
    if answers is not None:
        given = materialize(claims.drafts(answers, own), "story-drafts")
        drafted = given.unionByName(drafted.join(given.select("event_id"), "event_id", "left_anti"))
    checked = audit.verify(drafted, own)
    if verdicts is not None:
        checked = audit.demote(checked, verdicts)
    if cuts is not None:
        checked = edited(checked, cuts)
    return audit.assemble(moded, checked, own), checked


def build_stories(events: DataFrame, docs: DataFrame, words: tuple[str, ...] = CONTROVERSY, verdicts: DataFrame | None = None, **how) -> DataFrame:
    """The stories of build_parts."""
    return build_parts(events, docs, words, verdicts, **how)[0]


def edited(checked: DataFrame, cuts: DataFrame) -> DataFrame:
    """Verified claims without those that the editor cuts; places count an event's claims that have a source."""
    none = F.array().cast("array<int>")
    sourced = checked.where(F.size("source_ids") > 0)
    at = F.row_number().over(Window.partitionBy("event_id").orderBy("idx")) - 1
    marked = sourced.withColumn("at", at).join(cuts.select("event_id", F.coalesce("contradicted", none).alias("c"), F.coalesce("unsupported", none).alias("u")), "event_id", "left")
    flags = marked.select(
        F.col("event_id").alias("story_id"), F.col("at").alias("idx"), "verified", "tier_1_backed",
        F.coalesce(F.array_contains("c", F.col("at")), F.lit(False)).alias("contradicted"), F.coalesce(F.array_contains("u", F.col("at")), F.lit(False)).alias("unsupported"),
    )
    gone = claims.soft_cut(flags).where("cut").select(F.col("story_id").alias("event_id"), F.col("idx").alias("at"))
    cut = marked.join(gone, ["event_id", "at"], "left_semi").select("event_id", "idx")
    # a cut claim counts as one without a source, so it is counted in the notes
    return checked.join(cut.withColumn("__cut", F.lit(True)), ["event_id", "idx"], "left").withColumn("source_ids", F.when(F.col("__cut"), F.array().cast("array<string>")).otherwise(F.col("source_ids"))).drop("__cut")


def build_batch(events: DataFrame, docs: DataFrame, failed: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stories of a batch, with stubs for events that failed (event_id, reason); their claims; and one row of counts:
    candidates, built, approved, rejected, debates, skipped (events without docs) and failed."""
    bad = failed if failed is not None else events.sparkSession.createDataFrame([], f"event_id {events.schema['event_id'].dataType.simpleString()}, reason string")
    bad = bad.join(events.select("event_id"), "event_id", "left_semi")
    told, checked = build_parts(events.join(bad.select("event_id"), "event_id", "left_anti"), docs, **how)
    built = materialize(told, "batch-built")
    stories = built.unionByName(audit.failure_stubs(bad), allowMissingColumns=True)
    n = events.agg(F.count("*").alias("candidates")).crossJoin(audit.run_summary(built)).crossJoin(bad.agg(F.count("*").alias("failed")))  # one row each
    return stories, checked, n.select("candidates", "built", "approved", "rejected", "debates", (F.col("candidates") - F.col("built") - F.col("failed")).alias("skipped"), "failed")


def drop_duplicates(stories: DataFrame, least: float = SAME_UNJUDGED, verdicts: DataFrame | None = None, ground_words: tuple[str, ...] = GROUND) -> DataFrame:
    """Approved stories that say the same are rejected in favour of the one of higher importance. A pair is looked at from
    0.80 on, from 0.87 on if either tells of events on the ground; verdicts (i, j, same) decide it, without one `least`."""
    s = stories.withColumn("story_id", F.col("event_id"))
    live = s.where("editor_approved")
    told = F.concat_ws(". ", "headline", "dek")
    weights = materialize(V.hashed_terms(live, "story_id", told, 1 << 20), "story-terms")
    ground = live.select("story_id", (F.size(X.keyword_hits(F.concat(F.lit(" "), told, F.lit(" ")), ground_words)) > 0).alias("g"))
    pairs = cluster.rare_pairs(weights, "story_id", SAME)
    pairs = pairs.join(ground.select(F.col("story_id").alias("i"), F.col("g").alias("gi")), "i").join(ground.select(F.col("story_id").alias("j"), F.col("g").alias("gj")), "j")
    pairs = pairs.where(F.col("similarity") >= F.when(F.col("gi") | F.col("gj"), SAME_GROUND).otherwise(SAME)).select("i", "j", "similarity")
    gone = greedy_dedup(pairs, live, least, verdicts)
    return audit.reject_duplicates(s, gone).select(*stories.columns)


def publish(events: DataFrame, docs: DataFrame, top: int = 25, target: int = 20, words: tuple[str, ...] = CONTROVERSY) -> DataFrame:
    """Stories of the best events; while fewer than target are approved, up to three passes promote more candidates.

    Only the number of approved stories reaches the driver. Each pass builds the events it has promoted and nothing else."""
    scored = events.withColumn("score", F.col("importance_score"))
    chosen = rank.select_top(scored.where(F.col("status").isin("candidate", "selected")), top)
    state = materialize(rank.with_status(events, chosen), "publish-events")

    def built(fresh: DataFrame) -> DataFrame:
        return build_stories(fresh, docs, words).join(events.select("event_id", "importance_score"), "event_id")

    stories = materialize(drop_duplicates(materialize(built(state.where("status = 'selected'")), "publish-built")), "publish-stories")
    for _ in range(PASSES):
        approved = stories.where("editor_approved").count()
        if approved >= target:
            break
        batch = min(max(2 * (target - approved), 5), 15)
        more = materialize(rank.promote_next(state.join(stories.select("event_id"), "event_id", "left_anti"), batch), "publish-promoted")
        if not more.head(1):
            break
        promoted = more.select("event_id", F.lit("selected").alias("__status"))
        state = materialize(state.join(promoted, "event_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status"), "publish-events")
        stories = materialize(drop_duplicates(materialize(stories.unionByName(built(more)), "publish-built")), "publish-stories")
    return stories
