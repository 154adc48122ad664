"""From drafted claims to audited stories: verdicts, approval, notes, markdown, and what happens to stories later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.prose import local_context, local_debate, local_report, per_event

# Wordings that results must equal.
CONTRADICTS, UNSUPPORTED = "contradicts cited source", "not supported by cited source"
NO_SOURCE, ONE_SIGNAL, ONE_SOURCE = "no valid source", "single unverified social/signal source", "single-source, no primary anchor"
AS_DEBATE = "> No primary or official source backs this event; it is presented as a fact-based debate rather than as confirmed reporting."
SAME_STORY = 'deduped: same story as "%s" — dropped in favour of higher-ranked version'


def verdict_indexes(raw: Column, key: str) -> Column:
    """The indexes under a key of a verdict in JSON; of a bare list all are `contradicted`. What is no number is left out."""
    v = F.try_parse_json(raw)
    listed = F.try_variant_get(v, "$", "array<string>")
    found = F.coalesce(listed if key == "contradicted" else F.lit(None).cast("array<string>"), F.try_variant_get(v, f"$.{key}", "array<string>"))
    numbers = F.transform(F.filter(found, lambda x: x.rlike(r"^-*\d+$")), lambda x: x.try_cast("int"))
    return F.array_distinct(F.array_compact(F.coalesce(numbers, F.array().cast("array<int>"))))


def verify(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims with their known source ids only, n_sources, tier_1_backed, verified and note."""
    known = docs.select("event_id", F.col("id").cast("string").alias("sid"), "source_name", "source_tier").dropDuplicates(["event_id", "sid"])
    used = claims.select("event_id", "idx", F.posexplode("source_ids").alias("at", "sid")).join(known, ["event_id", "sid"])
    agg = used.groupBy("event_id", "idx").agg(
        F.countDistinct("source_name").alias("n_sources"), F.bool_or(F.col("source_tier") == 1).alias("tier_1_backed"), F.bool_and(F.col("source_tier") == 3).alias("signal"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "sid"))), lambda x: x["sid"]).alias("source_ids"),
    )
    n, primary = F.coalesce("n_sources", F.lit(0)), F.coalesce("tier_1_backed", F.lit(False))
    ok = primary | (n >= 2)
    note = F.when(n == 0, NO_SOURCE).when(ok, "").when(F.col("signal"), ONE_SIGNAL).otherwise(ONE_SOURCE)
    out = claims.drop("source_ids").join(agg, ["event_id", "idx"], "left")
    ids = F.coalesce("source_ids", F.array().cast("array<string>"))
    return out.select("event_id", "idx", "claim_text", ids.alias("source_ids"), n.alias("n_sources"), primary.alias("tier_1_backed"), ok.alias("verified"), note.alias("note"))


def demote(claims: DataFrame, verdicts: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Takes back verification by verdicts (event_id, contradicted, unsupported: places among the event's verified claims).

    Contradicted ones always; of the unsupported, not primary-backed ones the first floor(n * fraction), but one fewer
    where nothing would stay verified."""
    event = Window.partitionBy("event_id")
    none = F.array().cast("array<int>")
    v = verdicts.select("event_id", F.coalesce("contradicted", none).alias("__c"), F.coalesce("unsupported", none).alias("__u"))
    place = F.when(F.col("verified"), F.count_if("verified").over(event.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    x = claims.join(v, "event_id", "left").withColumns({"__at": place, "__n": F.count_if("verified").over(event)})
    hard = F.coalesce(F.col("verified") & F.array_contains("__c", F.col("__at")), F.lit(False))
    soft = F.coalesce(F.col("verified") & F.array_contains("__u", F.col("__at")) & ~hard & ~F.col("tier_1_backed"), F.lit(False))
    x = x.withColumns({"__hard": hard, "__soft": soft})
    rank = F.count_if("__soft").over(event.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__rank", rank).withColumn("__soft", F.col("__soft") & (F.col("__rank") <= F.floor(F.col("__n") * fraction)))
    left = F.count_if(F.col("verified") & ~F.col("__hard") & ~F.col("__soft")).over(event)
    x = x.withColumn("__soft", F.col("__soft") & ~((left == 0) & (F.col("__rank") == 1)))
    why = F.when(F.col("__hard"), CONTRADICTS).when(F.col("__soft"), UNSUPPORTED)
    note = F.when(why.isNull(), F.col("note")).when(F.coalesce("note", F.lit("")) == "", why).otherwise(F.concat_ws("; ", "note", why))
    return x.withColumns({"verified": F.col("verified") & why.isNull(), "note": note}).select(*claims.columns)


def _section(head: str, lines: Column, empty: str | None = None) -> Column:
    """A headed list and a blank line; without lines the empty text, or nothing at all."""
    shown = F.concat(F.array(F.lit(head)), lines, F.array(F.lit("")))
    other = F.array().cast("array<string>") if empty is None else F.array(F.lit(head), F.lit(empty), F.lit(""))
    return F.when(F.size(lines) > 0, shown).otherwise(other)


def _prose(head: str, text: Column) -> Column:
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(text != "", F.array(F.lit(head), text, F.lit(""))).otherwise(F.array().cast("array<string>"))


def assemble(events: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Stories of events (event_id, title, summary, mode[, context, perspective]) that have docs; texts that are not
    given are the offline ones. Claims without sources are cut; one that stays approves the story."""
    given = {c: F.col(c) if c in events.columns else F.lit(None).cast("string") for c in ("context", "perspective")}
    e = events.select("event_id", F.coalesce("title", F.lit("")).alias("title"), "summary", "mode", *(c.alias(f"given_{k}") for k, c in given.items()))
    x = e.join(per_event(claims.where(F.size("source_ids") > 0), docs), "event_id")
    counts = claims.groupBy("event_id").agg(F.count_if(F.size("source_ids") <= 0).alias("n_cut"))
    x = x.join(counts, "event_id", "left").withColumns({"n_cut": F.coalesce("n_cut", F.lit(0)), "n": F.size("claims"), "good": F.filter("claims", lambda c: c["verified"]), "flagged": F.filter("claims", lambda c: ~c["verified"])})
    debate = F.col("mode") == "debate"
    summary = F.when(F.col("summary") != "", F.col("summary"))
    first = lambda c: F.get(c, F.lit(0))["claim_text"]
    dek = F.when(debate, F.format_string("Contested: %d outlet(s), no primary source.", F.size("outlets"))).otherwise(F.coalesce(summary, first(F.col("good")), first(F.col("claims")), F.col("title")))
    context = F.coalesce("given_context", local_context())
    perspective = F.coalesce("given_perspective", F.when(debate, local_debate(F.col("claims"))))
    x = x.withColumns({"dek": dek, "context": context, "perspective": perspective})

    bullet = lambda c: F.concat(F.lit("- "), c["claim_text"], F.lit(" — "), F.array_join(c["links"], ", "))
    points, known = F.transform("claims", bullet), F.transform("good", bullet)
    doubtful = F.transform("flagged", lambda c: F.concat(bullet(c), F.lit(" _("), F.coalesce(c["note"], F.lit("")), F.lit(")_")))
    argued = F.when(F.trim(F.coalesce("perspective", F.lit(""))) == "", "_No debate could be constructed._").otherwise(F.trim("perspective"))
    as_debate = F.concat(F.array(F.lit(AS_DEBATE), F.lit(""), F.lit("## Debate"), argued, F.lit("")), _section("## Reported points (sourced, unverified)", points, "- _No sourced points._"), _prose("## Context", F.col("context")))
    as_report = F.concat(
        _section("## What we know", known, "- _No claims cleared verification._"), _section("## Flagged — single-source / unverified", doubtful),
        _prose("## Context", F.col("context")), _prose("## Perspectives", F.col("perspective")),
    )
    listed = F.transform("docs", lambda d: F.format_string("- [%s](%s) — tier %d", d["name"], d["url"], d["tier"].cast("int")))
    head = F.array(F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("*"), "dek", F.lit("*")), F.lit(""))
    body = F.concat(F.trim(F.array_join(F.concat(head, F.when(debate, as_debate).otherwise(as_report), F.array(F.lit("## Sources")), listed), "\n")), F.lit("\n"))

    approved = F.col("n") >= 1
    notes = F.concat_ws(
        "; ", F.concat(F.lit("mode="), "mode"), F.when(F.col("n_cut") > 0, F.format_string("cut %d unsupported/unsourced claim(s)", "n_cut")),
        F.when(~debate & (F.size("flagged") > 0), F.format_string("%d claim(s) single-source (kept, marked)", F.size("flagged"))),
        F.when(debate & approved, F.format_string("presented as debate on %d sourced point(s)", "n")).when(debate, "rejected: no sourced points to debate")
        .when(approved, F.format_string("approved on %d sourced claim(s) (%d cross-source verified)", F.col("n"), F.size("good"))).otherwise("rejected: no sourced claims survived hallucination audit"),
    )
    report = local_report(F.col("title"), F.col("claims"))
    final = F.when(~debate & approved, report).otherwise(body)
    trace = F.to_json(F.struct(
        "mode", (F.col("n_primary") > 0).alias("has_primary"), F.col("n_docs").alias("n_sources"),
        F.struct(F.size("good").alias("verified"), F.size("flagged").alias("flagged"), F.size(F.filter("claims", lambda c: c["tier_1_backed"])).alias("tier_1_backed")).alias("verifier"),
        "context", F.coalesce("perspective", F.lit("")).alias("perspective"), F.struct(approved.alias("approved"), notes.alias("notes")).alias("editor"),
    ))
    return x.select(
        "event_id", F.col("title").alias("headline"), "dek", final.alias("body_markdown"), body.alias("audited_markdown"), "mode", F.col("n").alias("n_claims"), F.size("good").alias("n_verified"),
        approved.alias("editor_approved"), notes.alias("editor_notes"), trace.alias("agent_trace"),
    )


def failure_stubs(failed: DataFrame) -> DataFrame:
    """Rejected stories without text for events (event_id, reason) that could not be built."""
    blank = F.lit("")
    return failed.select("event_id", blank.alias("headline"), blank.alias("dek"), blank.alias("body_markdown"), F.lit(False).alias("editor_approved"), F.concat(F.lit("crew failed: "), F.substring("reason", 1, 400)).alias("editor_notes"), F.to_json(F.struct(F.substring("reason", 1, 400).alias("failure_reason"))).alias("agent_trace"))


def reject_duplicates(stories: DataFrame, dropped: DataFrame) -> DataFrame:
    """Stories (story_id, headline, editor_approved, editor_notes), those in dropped (dropped, kept) no longer approved,
    with a note behind a bar that names the story kept."""
    named = dropped.join(stories.select(F.col("story_id").alias("kept"), F.col("headline").alias("__as")), "kept").groupBy(F.col("dropped").alias("story_id")).agg(F.min("__as").alias("__as"))
    gone = F.col("__as").isNotNull()
    note = F.concat(F.coalesce(F.concat("editor_notes", F.lit(" | ")), F.lit("")), F.format_string(SAME_STORY, "__as"))
    out = stories.join(named, "story_id", "left")
    return out.withColumns({"editor_approved": F.col("editor_approved") & ~gone, "editor_notes": F.when(gone, note).otherwise(F.col("editor_notes"))}).select(*stories.columns)


def repair(stories: DataFrame, checks: DataFrame) -> DataFrame:
    """Stories (story_id, headline, dek, editor_approved, editor_notes) after checks of whether headline and body agree.

    checks (story_id, coherent, reason, error, new_headline, new_dek, rewrite_error, coherent_again, reason_again,
    error_again): agreeing stories and those whose check or rewrite failed stay; an empty rewrite drops the story; a
    rewrite stays if the second check says so or fails, else the story is dropped. Adds `outcome`."""
    x = stories.join(checks, "story_id", "left")
    empty = (F.coalesce("new_headline", F.lit("")) == "") | (F.coalesce("new_dek", F.lit("")) == "")
    seen = F.col("coherent").isNotNull() | F.col("error").isNotNull()
    outcome = (
        F.when(~seen, "unchecked").when(F.col("error").isNotNull(), "error").when(F.col("coherent"), "coherent").when(F.col("rewrite_error").isNotNull(), "error")
        .when(empty, "dropped empty").when(F.col("error_again").isNotNull(), "rewritten unchecked").when(F.coalesce("coherent_again", F.lit(False)), "rewritten").otherwise("dropped")
    )
    reason = F.coalesce("reason", F.lit(""))
    note = (
        F.when(F.col("outcome") == "dropped empty", F.concat(F.lit("COHERENCE: dropped — rewrite empty; original: "), reason))
        .when(F.col("outcome") == "rewritten unchecked", F.concat(F.lit("COHERENCE: headline rewritten (re-check errored); original: "), reason))
        .when(F.col("outcome") == "rewritten", F.concat(F.lit("COHERENCE: headline rewritten to match body; original mismatch: "), reason))
        .when(F.col("outcome") == "dropped", F.concat(F.lit("COHERENCE: dropped — rewrite still incoherent ("), F.coalesce("reason_again", F.lit("")), F.lit("); original mismatch: "), reason))
    )
    new, gone = F.col("outcome").startswith("rewritten"), F.col("outcome").startswith("dropped")
    x = x.withColumn("outcome", outcome).withColumn("__note", F.substring(note, 1, 300))
    changed = {
        "headline": F.when(new, F.col("new_headline")).otherwise(F.col("headline")), "dek": F.when(new, F.col("new_dek")).otherwise(F.col("dek")),
        "editor_approved": F.col("editor_approved") & ~gone, "editor_notes": F.when(F.col("__note").isNull(), F.col("editor_notes")).otherwise(F.concat(F.coalesce("editor_notes", F.lit("")), F.lit("; "), "__note")),
    }
    return x.withColumns(changed).select(*stories.columns, F.split_part("outcome", F.lit(" "), F.lit(1)).alias("outcome"))


def run_summary(stories: DataFrame) -> DataFrame:
    """One row of counts: built, approved, rejected, debates."""
    ok = F.coalesce("editor_approved", F.lit(False))
    return stories.agg(F.count("*").alias("built"), F.count_if(ok).alias("approved"), F.count_if(~ok).alias("rejected"), F.count_if(F.col("mode") == "debate").alias("debates"))
