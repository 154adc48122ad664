"""Queries of building, auditing and publishing stories over the sample tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import audit, prose
from quillmark.plans import adapters as A
from quillmark.plans import newsroom
from quillmark.plans.registry import query
from quillmark.sources import threads

WORDS = ("thenti", "scum")


def _docs(spark, d) -> DataFrame:
    joined = A.event_items(spark, d).join(A.raw_items(spark, d), F.col("raw_item_id") == F.col("id"))
    return joined.select("event_id", F.col("id").cast("string").alias("id"), "source_name", "source_tier", "source_url", "title", F.col("content").alias("text"))


def _events(spark, d) -> DataFrame:
    return A.events(spark, d).withColumns({"title": F.concat(F.lit("Event "), F.col("event_id").cast("string")), "summary": F.lit(None).cast("string")})


def _claims(spark, d) -> DataFrame:
    """One claim per item, which cites itself, the next item and one that does not exist."""
    n = F.col("raw_item_id")
    ids = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(n.cast("string"), (n + 1).cast("string"), F.lit("none")))
    return A.event_items(spark, d).select("event_id", n.cast("int").alias("idx"), F.concat(F.lit("Claim "), n.cast("string"), F.lit(".")).alias("claim_text"), ids.alias("source_ids"))


#: The claims above, their known sources, and what verification says of them.
_VERIFIED = """, cl AS (SELECT event_id, raw_item_id AS idx, 'Claim ' || raw_item_id || '.' AS claim_text FROM event_items),
us AS (SELECT c.event_id, c.idx, r.* FROM cl c JOIN event_items e ON e.event_id = c.event_id AND e.raw_item_id IN (c.idx, c.idx + 1) JOIN raw_items r ON r.id = e.raw_item_id WHERE c.idx % 5 <> 0),
ag AS (SELECT event_id, idx, count(DISTINCT source_name) AS n, bool_or(source_tier = 1) AS p, bool_and(source_tier = 3) AS g, list_sort(list(DISTINCT source_name)) AS outlets FROM us GROUP BY 1, 2),
ve AS (SELECT cl.*, coalesce(n, 0) AS n_sources, coalesce(p, FALSE) AS tier_1_backed, coalesce(p, FALSE) OR coalesce(n, 0) >= 2 AS verified,
  CASE WHEN n IS NULL THEN 'no valid source' WHEN p OR n >= 2 THEN '' WHEN g THEN 'single unverified social/signal source' ELSE 'single-source, no primary anchor' END AS note,
  coalesce(outlets, []) AS outlets FROM cl LEFT JOIN ag USING (event_id, idx))
"""


@query(_VERIFIED + "SELECT event_id, idx, n_sources, tier_1_backed, verified, note FROM ve")
def verify_claims(spark, d):
    return audit.verify(_claims(spark, d), _docs(spark, d)).select("event_id", "idx", "n_sources", "tier_1_backed", "verified", "note")


@query(_VERIFIED + """, po AS (SELECT *, count(*) FILTER (verified) OVER (PARTITION BY event_id) AS m, CASE WHEN verified THEN count(*) FILTER (verified) OVER (PARTITION BY event_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 END AS pos FROM ve),
s AS (SELECT *, coalesce(verified AND pos = 0 AND event_id % 3 = 0, FALSE) AS hard, coalesce(verified AND pos IN (0, 1, 2) AND NOT (pos = 0 AND event_id % 3 = 0) AND NOT tier_1_backed AND event_id % 2 = 0, FALSE) AS s0 FROM po),
r AS (SELECT *, count(*) FILTER (s0) OVER (PARTITION BY event_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS k FROM s),
f AS (SELECT *, s0 AND k <= floor(m * 0.5) AS s1 FROM r), l AS (SELECT *, count(*) FILTER (verified AND NOT hard AND NOT s1) OVER (PARTITION BY event_id) AS alive FROM f),
z AS (SELECT *, s1 AND NOT (alive = 0 AND k = 1) AS soft FROM l)
SELECT event_id, idx, verified AND NOT hard AND NOT soft AS verified, CASE WHEN hard THEN 'contradicts cited source' WHEN soft THEN 'not supported by cited source' ELSE note END AS note FROM z""")  # fmt: skip
def demote_claims(spark, d):
    e = _events(spark, d)
    raw = F.concat(F.lit('{"contradicted": ['), F.when(F.col("event_id") % 3 == 0, "0").otherwise('"x"'), F.lit('], "unsupported": ['), F.when(F.col("event_id") % 2 == 0, "0, 1, 2").otherwise(""), F.lit("]}"))
    verdicts = e.select("event_id", audit.verdict_indexes(raw, "contradicted").alias("contradicted"), audit.verdict_indexes(raw, "unsupported").alias("unsupported"))
    return audit.demote(audit.verify(_claims(spark, d), _docs(spark, d)), verdicts).select("event_id", "idx", "verified", "note")


@query("""SELECT event_id, coalesce(max(CASE WHEN contains(lower(title || ' ' || content), 'thenti') THEN 1 END), 0) + coalesce(max(CASE WHEN contains(lower(title || ' ' || content), 'scum') THEN 1 END), 0) AS hits,
  CASE WHEN bool_or(contains(lower(title || ' ' || content), 'thenti') OR contains(lower(title || ' ' || content), 'scum')) THEN 'debate' ELSE 'report' END AS mode FROM event_items JOIN raw_items ON raw_item_id = id GROUP BY 1""")  # fmt: skip
def story_modes(spark, d):
    return newsroom.modes(_docs(spark, d), WORDS)


def _per_event(spark, d) -> DataFrame:
    docs = _docs(spark, d)
    return prose.per_event(audit.verify(_claims(spark, d), docs), docs)


@query("""SELECT event_id, 'This story is reconstructed from ' || count(*) || ' source item(s) (' || concat_ws(', ', CASE WHEN count(*) FILTER (source_tier = 1) > 0 THEN count(*) FILTER (source_tier = 1) || ' primary' END,
  CASE WHEN count(*) FILTER (source_tier = 3) > 0 THEN count(*) FILTER (source_tier = 3) || ' signal' END, CASE WHEN count(*) FILTER (source_tier = 2) > 0 THEN count(*) FILTER (source_tier = 2) || ' wire' END)
  || ') across ' || count(DISTINCT source_name) || ' outlet(s): ' || array_to_string(list_slice(list_sort(list(DISTINCT source_name)), 1, 6), ', ') || CASE WHEN count(DISTINCT source_name) > 6 THEN ' and others' ELSE '' END
  || '. Background is limited to what these sources report; no outside information has been added.' AS context FROM event_items JOIN raw_items ON raw_item_id = id GROUP BY 1""")  # fmt: skip
def context_sentences(spark, d):
    return _per_event(spark, d).select("event_id", prose.local_context().alias("context"))


@query(_VERIFIED + """SELECT event_id, string_agg('- ' || claim_text || ' (sources: ' || CASE WHEN len(outlets) = 0 THEN 'none' ELSE array_to_string(outlets, ', ') END || ')' || CASE WHEN tier_1_backed THEN ' [tier-1 backed]' ELSE '' END, chr(10) ORDER BY idx) AS facts FROM ve GROUP BY 1""")
def fact_blocks(spark, d):
    return _per_event(spark, d).select("event_id", prose.facts_block(F.col("claims"), marked=True).alias("facts"))


@query(_VERIFIED + """, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY idx) AS n FROM ve)
SELECT event_id, 'Event ' || event_id || chr(10) || chr(10) || string_agg(rtrim(claim_text, '.') || ' (' || array_to_string(outlets, ', ') || ').', chr(10) || chr(10) ORDER BY idx) AS report FROM k WHERE n <= 8 GROUP BY 1""")
def offline_reports(spark, d):
    title = F.concat(F.lit("Event "), F.col("event_id").cast("string"))
    return _per_event(spark, d).select("event_id", prose.local_report(title, F.col("claims")).alias("report"))


@query("""SELECT event_id, 'TIME CONTEXT' || chr(10) || 'TODAY IS Wednesday, 03 January 2024.' || chr(10) || 'This event was first reported: ' || strftime(seen, '%A, %d %B %Y') || ' (' ||
  CASE WHEN seen > TIMESTAMP '2024-01-03 12:00:00' THEN 'future-stamped source (do not surface as ''today'')' WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days <= 6 THEN strftime(seen, '%A') || ' (' || days || ' days ago)'
  WHEN days <= 30 THEN strftime(seen, '%d %B') || ' (' || days || ' days ago)' ELSE strftime(seen, '%d %B %Y') || ' — archive piece (' || days || ' days ago)' END || ').' AS block
  FROM (SELECT *, date_diff('day', CAST(seen AS DATE), DATE '2024-01-03') AS days FROM (SELECT event_id, first_seen_at - to_days(CAST(event_id % 50 AS INTEGER)) AS seen FROM events))""")  # fmt: skip
def time_contexts(spark, d):
    at = F.col("first_seen_at") - F.make_dt_interval(days=(F.col("event_id") % 50).cast("int"))
    return A.events(spark, d).select("event_id", prose.time_context(F.lit(A.NOW).cast("timestamp"), F.lit(None).cast("timestamp"), at).alias("block"))


@query("""SELECT story_id, headline, CASE WHEN story_id % 4 = 0 AND story_id > 3 THEN FALSE ELSE editor_approved END AS editor_approved,
  CASE WHEN story_id % 4 = 0 AND story_id > 3 THEN CASE WHEN story_id % 8 = 0 THEN 'mode=report | ' ELSE '' END || 'deduped: same story as "Story 3" — dropped in favour of higher-ranked version' WHEN story_id % 8 = 0 THEN 'mode=report' END AS editor_notes FROM stories""")  # fmt: skip
def reject_duplicates(spark, d):
    s = A.stories(spark, d).select("story_id", "headline", "editor_approved", F.when(F.col("story_id") % 8 == 0, "mode=report").alias("editor_notes"))
    return audit.reject_duplicates(s, s.where("story_id % 4 = 0 and story_id > 3").select(F.col("story_id").alias("dropped"), F.lit(3).cast("long").alias("kept")))


@query("""SELECT story_id, k, CASE WHEN k IN (4, 5) THEN 'new' ELSE headline END AS headline, editor_approved AND k NOT IN (3, 6) AS editor_approved,
  CASE k WHEN 3 THEN 'n; COHERENCE: dropped — rewrite empty; original: off' WHEN 4 THEN 'n; COHERENCE: headline rewritten (re-check errored); original: off' WHEN 5 THEN 'n; COHERENCE: headline rewritten to match body; original mismatch: off'
    WHEN 6 THEN 'n; COHERENCE: dropped — rewrite still incoherent (still); original mismatch: off' ELSE 'n' END AS editor_notes,
  ['coherent', 'error', 'error', 'dropped', 'rewritten', 'rewritten', 'dropped', 'unchecked'][k + 1] AS outcome FROM (SELECT *, story_id % 8 AS k FROM stories)""")  # fmt: skip
def coherence_repair(spark, d):
    k = F.col("story_id") % 8
    s = A.stories(spark, d).select("story_id", "headline", F.lit("d").alias("dek"), "editor_approved", F.lit("n").alias("editor_notes"), k.alias("k"))
    new = F.when(k >= 4, "new").otherwise("")
    checks = s.where("k < 7").select(
        "story_id", F.when(k != 1, k == 0).alias("coherent"), F.lit("off").alias("reason"), F.when(k == 1, "down").alias("error"), new.alias("new_headline"), new.alias("new_dek"),
        F.when(k == 2, "down").alias("rewrite_error"), (k == 5).alias("coherent_again"), F.lit("still").alias("reason_again"), F.when(k == 4, "down").alias("error_again"),
    )
    return audit.repair(s, checks).drop("dek")


@query("""SELECT event_id, FALSE AS editor_approved, 'crew failed: ' || repeat('x', CAST(least(event_id, 400) AS INTEGER)) AS editor_notes FROM events WHERE status = 'rejected'""")
def failure_stubs(spark, d):
    failed = A.events(spark, d).where("status = 'rejected'").select("event_id", F.repeat(F.lit("x"), F.col("event_id").cast("int")).alias("reason"))
    return audit.failure_stubs(failed).select("event_id", "editor_approved", "editor_notes")


@query()
def source_digests(spark, d):
    return prose.source_digest(_docs(spark, d))


@query()
def build_stories(spark, d):
    return newsroom.build_stories(_events(spark, d).where("status = 'selected'"), _docs(spark, d), WORDS)


@query()
def publish_topup(spark, d):
    return newsroom.publish(_events(spark, d), _docs(spark, d), words=WORDS)


@query()
def thread_pages(spark, d):
    from quillmark.runtime import ship_package

    ship_package(spark)
    return A.table(spark, d, "pages").select("page_id", threads.plain_host(F.col("url")).alias("url"), threads.extract_thread(F.col("html"), F.col("url")).alias("text"))
