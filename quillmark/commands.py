"""The engine's commands over a store of snapshots; `python -m quillmark` runs them.

A clock comes in as a Column, and what a network would answer as folders: feeds (one file per feed), pages (url, html),
redirects (url, target), searches (query, rank, url, title), images (url, content_type, content)."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import Settings
from quillmark.functions import text as X
from quillmark.functions.lexicons import CONTROVERSY
from quillmark.operators import audit, editions, rank, tables
from quillmark.plans import newsroom, stages
from quillmark.runtime import materialize, ship_package
from quillmark.sources import catalogue
from quillmark.store import STATUSES, Store


def sources(spark: SparkSession) -> DataFrame:
    return catalogue.catalogue(spark).select("source_name", "source_tier", "kind", "feed_url").orderBy("source_tier", "source_name")


def ingest(store: Store, fetched: DataFrame, now: Column, source: str | None = None, tier: int | None = None) -> tuple[int, int]:
    """Adds the items of fetched feeds (feed_url, xml) that are new by source and address; returns (inserted, skipped)."""
    if tier not in (None, 1, 2, 3):
        raise ValueError("tier must be 1, 2 or 3")
    own = catalogue.catalogue(store.spark, tier=tier, name=source)
    if source is not None and not own.head(1):
        raise ValueError(f"unknown source: {source}")
    items = materialize(catalogue.scan(own, fetched).withColumn("fetched_at", now), "ingest-items")
    old = store["raw_items"]
    new = tables.insert_if_absent(old, items, ["source_name", "source_url"], [F.col("published_at"), F.xxhash64("title", "content")])
    # numbers of items are hashes of what makes them one
    new = materialize(new.withColumn("id", F.shiftrightunsigned(F.xxhash64("source_name", "source_url"), 1)), "ingest-new")
    inserted = new.count()
    if inserted:
        store["raw_items"] = old.unionByName(new, allowMissingColumns=True)
    return inserted, items.count() - inserted


def status(store: Store) -> dict[str, DataFrame]:
    x = store["raw_items"]
    return {
        "total": x.agg(F.count("*").alias("items"), F.count("embedding").alias("embedded")),
        "by_tier": x.groupBy("source_tier").agg(F.count("*").alias("items")).orderBy("source_tier"),
        "by_source": x.groupBy("source_name", "source_tier").agg(F.count("*").alias("items"), F.max("fetched_at").alias("last_fetched")).orderBy("source_tier", "source_name"),
    }


def embed(store: Store, settings: Settings, limit: int = 1_000_000, source_names: list[str] | None = None, ask=None) -> None:
    store["raw_items"] = stages.embed(store["raw_items"], settings, ask, source_names, limit)


def cluster(store: Store, settings: Settings, source_names: list[str] | None = None) -> int:
    """Adds events of items that are in none; returns how many."""
    events, bridge = stages.cluster_stage(store["raw_items"], store["event_items"], settings, source_names)
    events = materialize(events, "cluster-events")
    made = events.count()
    if made:
        store["events"] = store["events"].unionByName(events.drop("num_items"), allowMissingColumns=True)
        store["event_items"] = store["event_items"].unionByName(bridge)
    return made


def rank_events(store: Store, settings: Settings, now: Column) -> dict:
    events, counts = stages.rank_stage(store["events"], store["event_items"], store["raw_items"], settings, now)
    said = counts.head().asDict()
    store["events"] = events
    return said


def scrape(store: Store, pages: DataFrame, now: Column, redirects: DataFrame | None = None, force: bool = False) -> dict:
    items, counts = stages.fetch_stage(store["raw_items"], store["event_items"], store["events"], pages, now, redirects, force)
    said = counts.head().asDict()
    store["raw_items"] = items
    return said


def pipeline(store: Store, settings: Settings, now: Column, pages: DataFrame | None = None, top: int | None = None) -> dict:
    """Embed, cluster, rank, and fetch where pages are given."""
    settings = dataclasses.replace(settings, select_top_n=top) if top else settings
    embed(store, settings)
    said = {"events": cluster(store, settings)} | rank_events(store, settings, now)
    return said | (scrape(store, pages, now) if pages is not None else {})


def events(store: Store, limit: int = 15, status: str | None = None) -> DataFrame:
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    shown = store["events"] if status is None else store["events"].where(F.col("status") == status)
    top = shown.orderBy(F.desc_nulls_last("importance_score"), F.desc("last_seen_at"), "event_id").limit(limit)
    members = store["event_items"].join(top.select("event_id"), "event_id").join(store["raw_items"].select(F.col("id").alias("raw_item_id"), "source_name"), "raw_item_id")
    counts = members.groupBy("event_id").agg(F.count("*").alias("items"), F.countDistinct("source_name").alias("sources"))
    listed = top.join(counts, "event_id", "left").select("event_id", "title", "importance_score", "status", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("sources", F.lit(0)).alias("sources"), "last_seen_at")
    return listed.orderBy(F.desc_nulls_last("importance_score"), F.desc("last_seen_at"), "event_id")


def recent(store: Store, limit: int = 10, source: str | None = None) -> DataFrame:
    x = store["raw_items"] if source is None else store["raw_items"].where(F.col("source_name") == source)
    return x.orderBy(F.desc("fetched_at"), "id").limit(limit).select("id", "source_name", "source_tier", "title", "source_url", "fetched_at")


def needing_stories(store: Store, force: bool = False, limit: int | None = None, event_id: int | None = None) -> DataFrame:
    """Selected events without a story (with force, with one too), the most important first; or the one asked for."""
    e = store["events"]
    e = e.where(F.col("event_id") == event_id) if event_id is not None else e.where("status = 'selected'")
    if not force:
        e = e.join(store["stories"].select("event_id"), "event_id", "left_anti")
    earliest = store["event_items"].join(store["raw_items"].select(F.col("id").alias("raw_item_id"), "published_at"), "raw_item_id").groupBy("event_id").agg(F.min("published_at").alias("earliest"))
    e = e.join(earliest, "event_id", "left")
    return e if limit is None else e.orderBy(F.desc_nulls_last("importance_score"), "event_id").limit(limit)


def event_docs(store: Store) -> DataFrame:
    x = store["raw_items"].select(F.col("id").alias("raw_item_id"), "source_name", "source_tier", "source_url", "title", X.best_text(F.col("full_content"), F.col("content")).alias("text"))
    return store["event_items"].join(x, "raw_item_id").withColumnRenamed("raw_item_id", "id")


def build(store: Store, now: Column, force: bool = False, limit: int | None = None, event_id: int | None = None, failed: DataFrame | None = None, **how) -> dict:
    """Builds and stores the stories of events that need one; returns counts."""
    work = materialize(needing_stories(store, force, limit, event_id), "build-work")
    docs = event_docs(store).withColumn("id", F.col("id").cast("string"))
    how = {"words": CONTROVERSY} | how
    made, checked, counts = newsroom.build_batch(work, docs, failed, **how)
    made = materialize(made.select("event_id", "headline", "dek", "body_markdown", "editor_approved", "editor_notes", "agent_trace"), "build-stories")
    _save(store, made, materialize(checked.where(F.size("source_ids") > 0), "build-claims"), now)
    return counts.head().asDict()


def _save(store: Store, made: DataFrame, checked: DataFrame, now: Column) -> None:
    """Stories replace those of their events, with their claims and sources."""
    fresh = made.select(F.col("event_id").alias("story_id"), "*", now.alias("created_at"))
    number = F.shiftrightunsigned(F.xxhash64("event_id", "idx"), 1)
    told = checked.select(number.alias("claim_id"), F.col("event_id").alias("story_id"), "claim_text", "verified", "tier_1_backed", F.col("idx").alias("ordinal"))
    cited = checked.select(number.alias("claim_id"), F.explode("source_ids").alias("raw_item_id")).withColumn("raw_item_id", F.col("raw_item_id").try_cast("long")).where("raw_item_id is not null")
    gone = store["claims"].join(fresh.select("story_id"), "story_id", "left_semi").select("claim_id")
    store["claim_sources"] = tables.delete_cascade(store["claim_sources"], materialize(gone, "build-gone"), "claim_id").unionByName(cited)
    store["claims"] = tables.replace_children(store["claims"], told, "story_id", fresh)
    store["stories"] = tables.upsert(store["stories"], fresh, ["event_id"])


def list_stories(store: Store, limit: int = 15, approved_only: bool = False) -> DataFrame:
    s = store["stories"].where("editor_approved") if approved_only else store["stories"]
    top = s.orderBy(F.desc("created_at"), "story_id").limit(limit)
    n = store["claims"].join(top.select("story_id"), "story_id", "left_semi").groupBy("story_id").agg(F.count("*").alias("claims"))
    return top.join(n, "story_id", "left").select("story_id", "headline", "editor_approved", F.coalesce("claims", F.lit(0)).alias("claims"), "editor_notes", "created_at").orderBy(F.desc("created_at"), "story_id")


def show(store: Store, event_id: int) -> DataFrame:
    """The story of one event."""
    return store["stories"].where(F.col("event_id") == event_id).select("story_id", "headline", "dek", "body_markdown", "editor_approved", "editor_notes")


def edition(store: Store, now: Column, approved_only: bool = True) -> DataFrame:
    s = store["stories"].where("editor_approved") if approved_only else store["stories"]
    s = s.join(store["events"].select("event_id", "importance_score"), "event_id", "left")
    told = editions.claim_outlets(store["claims"], store["claim_sources"], store["raw_items"])
    lines = editions.story_lines(s, told, store["story_images"], editions.social_posts(store["event_items"], store["raw_items"]))
    return editions.edition(materialize(lines, "edition-stories"), now)


def write_edition(store: Store, now: Column, folder: str, date: str, approved_only: bool = True) -> str:
    path = f"{folder.rstrip('/')}/edition-{date}.md"
    editions.write_edition(edition(store, now, approved_only), path)
    return path


def edition_date(path: str) -> str | None:
    """The date in an edition's file name."""
    found = re.search(r"edition-(\d{4}-\d{2}-\d{2})\.md$", path.rstrip("/"))
    return found.group(1) if found else None


def copy_edition(spark: SparkSession, path: str, images: str, site: str) -> list[str]:
    """Copies an edition and its folder of images below a site folder, replacing what is there; returns the new paths.
    Without that folder nothing is copied."""
    date = edition_date(path)
    if date is None:
        raise ValueError(f"not an edition: {path}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target = place(site)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        return []
    done = []
    for source, to in ((path, f"{site.rstrip('/')}/edition-{date}.md"), (f"{images.rstrip('/')}/{date}", f"{site.rstrip('/')}/images/{date}")):
        p, q = place(source), place(to)
        if p.getFileSystem(conf).exists(p):
            fs.delete(q, True)
            fs.mkdirs(q.getParent())
            jvm.org.apache.hadoop.fs.FileUtil.copy(p.getFileSystem(conf), p, fs, q, False, conf)
            done.append(to)
    return done


def enrich(
    store: Store, pages: DataFrame, searched: DataFrame | None = None, redirects: DataFrame | None = None, fetched: DataFrame | None = None, verdicts: DataFrame | None = None,
    date: str = "", root: str | None = None,
) -> dict:
    """Images of approved stories; with fetched answers (url, content_type, content) they are written below root, with
    verdicts (image_url, verdict, duplicate_of, caption) sorted out."""
    ship_package(store.spark)
    live = store["stories"].where("editor_approved").select("story_id", "headline")
    cited = store["claims"].join(store["claim_sources"], "claim_id").join(store["raw_items"].where("source_tier <= 2").select(F.col("id").alias("raw_item_id"), "source_name", "source_url"), "raw_item_id")
    rows, counts = stages.image_stage(live, cited, pages, searched, redirects, date=date)
    if fetched is not None:
        if root is not None:
            stages.write_images(rows, fetched, root)
        rows = stages.download_images(rows, fetched)
    else:
        rows = rows.withColumn("local_path", F.lit(None).cast("string"))
    if verdicts is not None:
        named = rows.withColumn("image_id", F.concat_ws("|", F.col("story_id").cast("string"), "source_url"))
        v = verdicts.join(rows.select("story_id", F.col("source_url").alias("image_url")), "image_url")
        v = v.select(F.concat_ws("|", F.col("story_id").cast("string"), "image_url").alias("image_id"), "verdict", F.concat_ws("|", F.when(F.col("duplicate_of").isNotNull(), F.col("story_id").cast("string")), "duplicate_of").alias("duplicate_of"), "caption")
        kept = tables.apply_verdicts(named.select("image_id", "story_id", "ordinal", "caption"), v)
        rows = named.drop("ordinal", "caption", "story_id").join(kept, "image_id").drop("image_id")
    store["story_images"] = tables.replace_children(store["story_images"], rows.select(*store["story_images"].columns), "story_id", live)
    return counts.head().asDict()


def coherence(store: Store, checks: DataFrame) -> DataFrame:
    """Repairs approved stories with a body by checks (see operators.audit.repair); returns the count of each outcome."""
    s = store["stories"]
    looked_at = s.where(F.col("editor_approved") & (F.length("body_markdown") > 200))
    fixed = materialize(audit.repair(looked_at, checks.join(looked_at.select("story_id"), "story_id", "left_semi")), "coherence")
    store["stories"] = tables.upsert(s, fixed.drop("outcome"), ["story_id"])
    return fixed.groupBy("outcome").agg(F.count("*").alias("stories"))


def publish(store: Store, settings: Settings, now: Column, fetched: DataFrame | None = None, pages: DataFrame | None = None, wipe: bool = True, limit: int | None = None, verdicts: DataFrame | None = None) -> dict:
    """A whole run: empty tables (unless kept), ingest, embed, cluster, rank, fetch, build, and up to three passes that
    promote more candidates while too few stories are approved. Nothing is ranked anew inside the loop."""
    if wipe:
        store.truncate()
    said: dict = {}
    if fetched is not None:
        said["inserted"], said["skipped"] = ingest(store, fetched, now)
    said |= pipeline(store, settings, now, pages)

    def dedup() -> int:
        s = store["stories"].join(store["events"].select("event_id", "importance_score"), "event_id", "left")
        store["stories"] = materialize(newsroom.drop_duplicates(s, verdicts=verdicts), "publish-dedup").drop("importance_score")
        return store["stories"].where("editor_approved").count()

    said["passes"] = 0
    said |= build(store, now, limit=limit)
    approved = dedup()
    while approved < settings.min_final_stories and said["passes"] < newsroom.PASSES:
        batch = min(max(2 * (settings.min_final_stories - approved), 5), 15)
        more = materialize(rank.promote_next(store["events"], batch).select("event_id", F.lit("selected").alias("status")), "publish-promoted")
        if not more.head(1):
            break
        store["events"] = tables.update_where_found(store["events"], more, ["event_id"], ["status"])
        if pages is not None:
            scrape(store, pages, now)
        build(store, now)
        approved = dedup()
        said["passes"] += 1
    return said | {"approved": approved}
