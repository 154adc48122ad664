"""The stages between feeds and stories as functions of whole tables: embed, cluster, rank, fetch, images, research.

What a network would answer comes in as tables: pages (url, html) that were fetched, redirects (url, target), and search
results. Items: id, source_name, source_tier, source_url, title, content, published_at, fetched_at, embedding[,
full_content, full_content_fetched_at].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import Settings
from quillmark.functions import text as X
from quillmark.operators import cluster, embeddings, rank, stories, tables
from quillmark.runtime import materialize, ship_package
from quillmark.sources import feeds, threads

#: Search results looked at, documents kept, and characters of a body, least and most, of one research.
RESEARCH_URLS, RESEARCH_DOCS, RESEARCH_LEAST, RESEARCH_MOST = 5, 3, 200, 3000
#: Articles of an image search, and images of each.
SEARCH_ARTICLES, SEARCH_IMAGES, SEARCH_ENOUGH = 5, 2, 6


def embed(items: DataFrame, settings: Settings, ask=None, sources: list[str] | None = None, limit: int | None = 1_000_000) -> DataFrame:
    """Items with vectors of their title and content where they had none."""
    return embeddings.embed_stage(items, embeddings.get_backend(settings, ask), X.embed_text(F.col("title"), F.col("content")), sources, limit)


def unclustered(items: DataFrame, event_items: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Embedded items that are in no event yet."""
    rows = items.where("embedding is not null").join(event_items.select(F.col("raw_item_id").alias("id")), "id", "left_anti")
    return rows.where(F.col("source_name").isin(*sources)) if sources else rows


def cluster_stage(items: DataFrame, event_items: DataFrame, settings: Settings, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """New candidate events of items that are in none, and the bridge rows (event_id, raw_item_id): similar items within
    the window are linked, and links chain. An event's number is its smallest item's."""
    fresh = materialize(unclustered(items, event_items, sources).withColumn("ts", F.coalesce("published_at", "fetched_at")), "cluster-items")
    pairs = materialize(cluster.similar_pairs(fresh, "id", "embedding", settings.cluster_similarity, "ts", settings.cluster_window_hours), "cluster-pairs")
    events, bridge = cluster.event_clusters(fresh, pairs.select("id_i", "id_j"))
    return events.withColumn("status", F.lit("candidate")), bridge


def rank_stage(events: DataFrame, event_items: DataFrame, items: DataFrame, settings: Settings, now: Column) -> tuple[DataFrame, DataFrame]:
    """Events with new scores, anchors and statuses, and one row of counts: scored, selected, demoted. Published and
    rejected events are left as they are."""
    open_ = events.where(F.col("status").isin("candidate", "selected"))
    members = event_items.join(open_.select("event_id"), "event_id").join(items, F.col("raw_item_id") == F.col("id"))
    scored = rank.event_features(members.withColumn("ts", F.coalesce("published_at", "fetched_at")), now)
    scored = materialize(scored.select("event_id", F.col("tier_1_anchor").alias("anchor"), rank.importance_score().alias("score")), "rank-scores")
    chosen = rank.select_top(scored.withColumnRenamed("anchor", "tier_1_anchor"), settings.select_top_n)
    new = rank.with_status(events, chosen).join(scored, "event_id", "left")
    score, anchor = F.coalesce("score", "importance_score") if "importance_score" in events.columns else F.col("score"), F.coalesce("anchor", "tier_1_anchor")
    out = new.withColumns({"importance_score": score.cast("float"), "tier_1_anchor": anchor}).drop("score", "anchor")
    left = events.select("event_id", F.col("status").alias("before")).join(out.select("event_id", "status"), "event_id")
    demoted = F.count_if((F.col("before") == "selected") & (F.col("status") == "candidate"))
    counts = left.agg(F.count_if(F.col("status").isin("candidate", "selected")).alias("scored"), F.count_if(F.col("status") == "selected").alias("selected"), demoted.alias("demoted"))
    return out, counts


def resolved(urls: Column, redirects: DataFrame | None, df: DataFrame) -> DataFrame:
    """df with `url`: where a redirect leads, else the URL itself."""
    rows = df.withColumn("__from", urls)
    if redirects is None:
        return rows.withColumnRenamed("__from", "url")
    to = redirects.groupBy(F.col("url").alias("__from")).agg(F.min("target").alias("__to"))
    return rows.join(to, "__from", "left").withColumn("url", F.coalesce(X.blank_to_null(F.col("__to")), F.col("__from"))).drop("__from", "__to")


def pending_fetch(items: DataFrame, event_items: DataFrame, events: DataFrame, force: bool = False) -> DataFrame:
    """Items of selected events without a body; with force, with one too."""
    chosen = event_items.join(events.where("status = 'selected'").select("event_id"), "event_id", "left_semi")
    rows = items.join(chosen.select(F.col("raw_item_id").alias("id")), "id", "left_semi")
    return rows if force else rows.where("full_content is null")


def fetch_stage(
    items: DataFrame, event_items: DataFrame, events: DataFrame, pages: DataFrame, now: Column, redirects: DataFrame | None = None, force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Items with bodies from fetched pages (url, html), and one row of counts. Hosts behind paywalls, pages that were not
    fetched and pages without text get the empty body, so they are not asked for again."""
    ship_package(pages.sparkSession)
    rows = resolved(F.col("source_url"), redirects, pending_fetch(items, event_items, events, force).select("id", "source_url"))
    one = pages.groupBy(F.col("url").alias("page_url")).agg(F.min("html").alias("html"))
    rows = rows.withColumn("host", X.url_host(F.col("url"))).withColumn("paywalled", X.is_paywalled(F.col("host")))
    plain = threads.plain_host(F.col("url"))
    rows = rows.join(one, (F.col("url") == F.col("page_url")) & ~F.col("paywalled"), "left").withColumn("social", X.is_social_host(F.col("host")))
    body = F.when(F.col("html").isNull(), "").when(F.col("social"), threads.extract_thread(F.col("html"), plain)).otherwise(feeds.extract_body(F.col("html")))
    fetched = materialize(rows.select("id", F.coalesce(body, F.lit("")).alias("full_content"), "paywalled", "social", F.col("html").isNull().alias("missing")), "fetched")
    news = fetched.select("id", "full_content", now.alias("full_content_fetched_at"))
    has = F.col("full_content") != ""
    failed = ~F.col("paywalled") & (F.col("missing") | (F.col("social") & ~has))
    counts = fetched.agg(
        F.count("*").alias("pending"), F.count_if(has).alias("scraped"), F.count_if(~F.col("paywalled") & ~failed & ~has).alias("empty"),
        F.count_if(failed).alias("failed"), F.count_if("paywalled").alias("paywalled"),
    )
    return tables.update_where_found(items, news, ["id"], ["full_content", "full_content_fetched_at"]), counts


def image_stage(
    live: DataFrame, sources: DataFrame, pages: DataFrame, searched: DataFrame | None = None, redirects: DataFrame | None = None, folder: str = "images", date: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Rows of story_images, and one row of counts.

    live: approved stories (story_id, headline). sources: their cited ones (story_id, source_name, source_url). Only a
    story whose sources have no image takes those of a search: searched (query, rank, url) holds the articles found for
    `functions.text.headline_query` of a headline; paywalled ones are skipped, each gives two, and articles after the
    sixth image are not looked at. The best three of a story stay, one per normalised URL."""
    ship_package(pages.sparkSession)
    ids = pages.groupBy("url").agg(F.min("html").alias("html")).withColumn("page_id", F.xxhash64("url"))
    found = materialize(feeds.image_candidates(ids.select("page_id", "url", "html")).join(ids.select("page_id", F.col("url").alias("article_url")), "page_id"), "image-candidates")
    cited = resolved(F.col("source_url"), redirects, sources.select("story_id", "source_name", "source_url").distinct())
    own = cited.join(live.select("story_id"), "story_id", "left_semi").join(found.withColumnRenamed("url", "image"), F.col("url") == F.col("article_url"))
    own = own.select("story_id", "image", "caption", X.humanise(F.col("source_name")).alias("credit"), "article_url", "score", F.struct("source_name", "article_url", "at").alias("seq"), F.lit("primary").alias("via"))
    every = own
    if searched is not None:
        bare = live.join(own.select("story_id"), "story_id", "left_anti").withColumn("query", X.headline_query(F.col("headline")))
        hits = resolved(F.col("found_url"), redirects, bare.join(searched.withColumnRenamed("url", "found_url"), "query").where(F.col("rank") <= SEARCH_ARTICLES))
        hits = hits.where(~X.is_paywalled(X.url_host(F.col("url")))).join(found.withColumnRenamed("url", "image"), F.col("url") == F.col("article_url"))
        place = F.row_number().over(Window.partitionBy("story_id", "rank", "article_url").orderBy("at"))
        hits = hits.withColumn("k", place).where(F.col("k") <= SEARCH_IMAGES)
        before = F.count("*").over(Window.partitionBy("story_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
        hits = hits.withColumn("before", before).where(F.col("before") < SEARCH_ENOUGH)
        every = own.unionByName(hits.select(
            "story_id", "image", "caption", X.outlet_from_host(X.url_host(F.col("url"))).alias("credit"), "article_url", "score",
            F.struct(F.format_string("%09d", "rank").alias("source_name"), "article_url", "at").alias("seq"), F.lit("fallback").alias("via"),
        ))
    best = stories.top_images(every.withColumnRenamed("image", "url")).select("story_id", "ordinal", F.col("url").alias("image"))
    kept = every.join(best, ["story_id", "image"])
    one = kept.groupBy("story_id", "ordinal", "image").agg(F.min_by(F.struct("caption", "credit", "article_url", "via"), F.struct(-F.col("score"), F.col("seq"))).alias("x"))
    name = F.concat(F.lit(f"{folder}/{date}/" if date else f"{folder}/"), F.col("story_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string"), F.lit("-"), X.url_hash(F.col("image")), X.extension(F.col("image")))
    rows = materialize(one.select("story_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("image").alias("source_url"), name.alias("target_path"), "x.caption", "x.credit", "x.article_url", "x.via"), "story-images")
    per = rows.groupBy("story_id").agg(F.max("via").alias("via"))
    n = live.select("story_id").distinct().join(per, "story_id", "left")
    counts = n.agg(F.count("*").alias("stories"), F.count("via").alias("with_images"), F.count_if(F.col("via") == "primary").alias("primary_hits"), F.count_if(F.col("via") == "fallback").alias("fallback_hits"))
    return rows.drop("via"), counts


def download_images(rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """story_images with local_path: their target where the fetched answer (url, content_type, content) is an image."""
    good = fetched.where(F.lower("content_type").contains("image") & (F.octet_length("content") > 0)).select(F.col("url").alias("source_url"), F.lit(True).alias("__ok")).distinct()
    return rows.join(good, "source_url", "left").withColumn("local_path", F.when(F.col("__ok"), F.col("target_path"))).drop("__ok", "target_path")


def write_images(rows: DataFrame, fetched: DataFrame, root: str) -> int:
    """Writes the images that were fetched below a root that all executors mount; returns how many."""
    both = download_images(rows, fetched).where("local_path is not null").join(fetched.select(F.col("url").alias("source_url"), "content").dropDuplicates(["source_url"]), "source_url")

    def save(parts):
        import os

        import pandas as pd

        for pdf in parts:
            for path, content in zip(pdf["local_path"], pdf["content"], strict=True):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{target}.part", target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return both.select("local_path", "content").mapInPandas(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def research(turns: DataFrame, results: DataFrame, pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Docs for the queries that debate turns (event_id, turn) ask for: event_id, id, source_name, source_tier,
    source_url, title, text. results (query, rank, url, title) are search results; of the first five those that are
    behind no paywall and have a body of 200 characters, three a query."""
    ship_package(pages.sparkSession)
    asked = turns.select("event_id", X.research_query(F.col("turn")).alias("query")).where("query is not null").distinct()
    hits = resolved(F.col("found_url"), redirects, asked.join(results.withColumnRenamed("url", "found_url"), "query").where(F.col("rank") <= RESEARCH_URLS))
    one = pages.groupBy(F.col("url").alias("page_url")).agg(F.min("html").alias("html"))
    read = hits.where(~X.is_paywalled(X.url_host(F.col("url")))).join(one, F.col("url") == F.col("page_url")).withColumn("body", feeds.extract_body(F.col("html")))
    n = F.row_number().over(Window.partitionBy("event_id", "query").orderBy("rank", "url"))
    best = read.where(F.length("body") >= RESEARCH_LEAST).withColumn("n", n).where(F.col("n") <= RESEARCH_DOCS)
    return best.select(
        "event_id", F.concat(F.lit("research-"), F.sha1(F.concat_ws("|", F.col("event_id").cast("string"), "query", "url"))).alias("id"), F.concat(F.lit("research:"), F.substring("query", 1, 60)).alias("source_name"),
        F.lit(2).alias("source_tier"), F.col("url").alias("source_url"), F.substring(F.coalesce(X.blank_to_null(F.col("title")), F.col("query")), 1, 280).alias("title"), F.substring("body", 1, RESEARCH_MOST).alias("text"),
    )
