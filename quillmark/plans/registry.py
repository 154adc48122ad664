"""Every query of the engine's own operators over the sample tables, with its DuckDB oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import lexicons
from quillmark.functions import text as X
from quillmark.functions import vector as V
from quillmark.operators import claims as C
from quillmark.operators import cluster, rank, stories, tables, termpairs
from quillmark.plans.adapters import NOW, PRELUDE, SAMPLE_WORDS
from quillmark.plans import adapters as A
from quillmark.runtime import materialize
from quillmark.sources import feeds

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: The keyword lists, and words that occur in the sample texts.
LISTS = {name: (*words, *more) for (name, words), more in zip(rank.LISTS.items(), (SAMPLE_WORDS[:3], SAMPLE_WORDS[3:6], SAMPLE_WORDS[:6], SAMPLE_WORDS[6:]), strict=True)}


def query(oracle: str | None = None):
    """Registers a function as a query; the oracle continues the common prelude unless it starts with WITH."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle if oracle.lstrip().startswith("WITH") else PRELUDE + oracle
        return f

    return add


def _load() -> None:
    from quillmark.plans import stage_queries, story_queries  # these register their queries and need this module first

    assert stage_queries and story_queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_top_n(spark, sf_dir)


def _now():
    return F.lit(NOW).cast("timestamp")


# listings and counts


@query("SELECT count(*) AS items, count(published_at) AS dated FROM raw_items")
def status_total(spark, d):
    return A.raw_items(spark, d).agg(F.count("*").alias("items"), F.count("published_at").alias("dated"))


@query("SELECT source_tier, count(*) AS items FROM raw_items GROUP BY 1")
def status_by_tier(spark, d):
    return A.raw_items(spark, d).groupBy("source_tier").agg(F.count("*").alias("items"))


@query("SELECT source_name, source_tier, count(*) AS items, max(fetched_at) AS last_fetched FROM raw_items GROUP BY 1, 2")
def status_by_source(spark, d):
    return A.raw_items(spark, d).groupBy("source_name", "source_tier").agg(F.count("*").alias("items"), F.max("fetched_at").alias("last_fetched"))


@query("""SELECT e.event_id, importance_score, status, (SELECT count(*) FROM event_items b WHERE b.event_id = e.event_id) AS items,
  (SELECT count(DISTINCT source_name) FROM event_items b JOIN raw_items r ON b.raw_item_id = r.id WHERE b.event_id = e.event_id) AS sources
  FROM events e WHERE status IN ('candidate', 'selected') ORDER BY importance_score DESC NULLS LAST, last_seen_at DESC, e.event_id LIMIT 15""")  # fmt: skip
def events_listing(spark, d):
    top = A.events(spark, d).where(F.col("status").isin("candidate", "selected")).orderBy(F.desc_nulls_last("importance_score"), F.desc("last_seen_at"), "event_id").limit(15)
    members = A.event_items(spark, d).join(A.raw_items(spark, d).select("id", "source_name"), F.col("raw_item_id") == F.col("id"))
    counts = members.groupBy("event_id").agg(F.count("*").alias("items"), F.countDistinct("source_name").alias("sources"))
    return top.join(counts, "event_id", "left").select("event_id", "importance_score", "status", "items", "sources")


@query("SELECT id, source_name, title, fetched_at FROM raw_items WHERE source_name = 'src3' ORDER BY fetched_at DESC, id LIMIT 10")
def recent_items(spark, d):
    return A.raw_items(spark, d).where("source_name = 'src3'").orderBy(F.desc("fetched_at"), "id").limit(10).select("id", "source_name", "title", "fetched_at")


@query("SELECT event_id, min(published_at) AS earliest FROM event_items JOIN raw_items ON raw_item_id = id GROUP BY 1")
def earliest_pub(spark, d):
    return _members(spark, d).groupBy("event_id").agg(F.min("published_at").alias("earliest"))


@query("SELECT event_id, source_name, count(*) AS n FROM event_items JOIN raw_items ON raw_item_id = id WHERE source_tier = 3 GROUP BY 1, 2")
def signal_counts(spark, d):
    return _members(spark, d).where("source_tier = 3").groupBy("event_id", "source_name").agg(F.count("*").alias("n"))


@query("""SELECT claim_id, coalesce(list_sort(list(DISTINCT source_name) FILTER (source_name IS NOT NULL)), []) AS outlets
  FROM claims LEFT JOIN claim_sources USING (claim_id) LEFT JOIN raw_items ON raw_item_id = id GROUP BY 1""")  # fmt: skip
def array_agg_outlets(spark, d):
    named = A.claims(spark, d).join(A.claim_sources(spark, d), "claim_id", "left").join(A.raw_items(spark, d).select("id", "source_name"), F.col("raw_item_id") == F.col("id"), "left")
    return named.groupBy("claim_id").agg(F.sort_array(F.collect_set("source_name")).alias("outlets"))


@query("""SELECT event_id, count(*) FILTER (source_tier = 1) AS t1, count(*) FILTER (source_tier = 2) AS t2, count(*) FILTER (source_tier = 3) AS t3,
  array_to_string(list_slice(list_sort(list(DISTINCT source_name)), 1, 6), ', ') AS outlets FROM event_items JOIN raw_items ON raw_item_id = id GROUP BY 1""")  # fmt: skip
def tier_histogram(spark, d):
    return _members(spark, d).groupBy("event_id").agg(*(F.count_if(F.col("source_tier") == t).alias(f"t{t}") for t in (1, 2, 3)), F.array_join(F.slice(F.array_sort(F.collect_set("source_name")), 1, 6), ", ").alias("outlets"))


def _members(spark, d) -> DataFrame:
    return A.event_items(spark, d).join(A.raw_items(spark, d), F.col("raw_item_id") == F.col("id"))


# scans


@query("SELECT id, title FROM raw_items WHERE published_at IS NULL AND source_name IN ('src1', 'src2', 'src10', 'src0') ORDER BY fetched_at LIMIT 1000000")
def pending_embedding(spark, d):
    return A.raw_items(spark, d).where(F.col("published_at").isNull() & F.col("source_name").isin("src1", "src2", "src10", "src0")).orderBy("fetched_at").limit(1_000_000).select("id", "title")


@query("SELECT id, coalesce(published_at, fetched_at) AS ts FROM raw_items LEFT JOIN embeddings ON vec_id = id WHERE vec_id IS NULL")
def unembedded_anti(spark, d):
    return A.raw_items(spark, d).join(A.table(spark, d, "embeddings"), F.col("vec_id") == F.col("id"), "left_anti").select("id", F.coalesce("published_at", "fetched_at").alias("ts"))


@query("""SELECT id, coalesce(published_at, fetched_at) AS ts FROM raw_items JOIN embeddings ON vec_id = id LEFT JOIN event_items ON raw_item_id = id
  LEFT JOIN events e ON e.event_id = event_items.event_id AND status <> 'rejected' WHERE e.event_id IS NULL""")  # fmt: skip
def unclustered_anti(spark, d):
    """Embedded items that are in no event which still counts."""
    embedded = A.raw_items(spark, d).join(A.table(spark, d, "embeddings").select("vec_id"), F.col("vec_id") == F.col("id"))
    taken = A.event_items(spark, d).join(A.events(spark, d).where("status <> 'rejected'"), "event_id", "left_semi")
    return embedded.join(taken, F.col("raw_item_id") == F.col("id"), "left_anti").select("id", F.coalesce("published_at", "fetched_at").alias("ts"))


@query("SELECT DISTINCT id, source_url FROM raw_items JOIN event_items ON raw_item_id = id JOIN events USING (event_id) WHERE status = 'selected' AND published_at IS NOT NULL")
def pending_fetch_semi(spark, d):
    chosen = A.event_items(spark, d).join(A.events(spark, d).where("status = 'selected'"), "event_id", "left_semi")
    return A.raw_items(spark, d).where("published_at is not null").join(chosen, F.col("raw_item_id") == F.col("id"), "left_semi").select("id", "source_url")


@query("""SELECT e.event_id, e.importance_score FROM events e LEFT JOIN stories s ON s.event_id = e.event_id AND s.editor_approved WHERE s.story_id IS NULL AND status IN ('selected', 'candidate')
  ORDER BY e.importance_score DESC NULLS LAST, e.event_id LIMIT 40""")  # fmt: skip
def needing_stories_anti(spark, d):
    open_ = A.events(spark, d).where("status in ('selected', 'candidate')").join(A.stories(spark, d).where("editor_approved"), "event_id", "left_anti")
    return open_.orderBy(F.desc_nulls_last("importance_score"), "event_id").limit(40).select("event_id", "importance_score")


@query("""SELECT id, source_name FROM raw_items r WHERE source_tier = 1 AND fetched_at >= TIMESTAMP '2024-01-03 12:00:00' - INTERVAL 48 HOURS
  AND NOT EXISTS (SELECT 1 FROM event_items b JOIN events e USING (event_id) WHERE b.raw_item_id = r.id AND status = 'selected')""")  # fmt: skip
def not_exists_response(spark, d):
    recent = A.raw_items(spark, d).where((F.col("source_tier") == 1) & (F.col("fetched_at") >= _now() - F.expr("INTERVAL 48 HOURS")))
    return recent.join(A.event_items(spark, d).join(A.events(spark, d).where("status = 'selected'"), "event_id", "left_semi"), F.col("raw_item_id") == F.col("id"), "left_anti").select("id", "source_name")


@query("""SELECT story_id, headline, coalesce(e.importance_score, 0) AS importance, e.status FROM stories s LEFT JOIN events e USING (event_id) WHERE editor_approved""")
def approved_stories(spark, d):
    e = A.events(spark, d).select("event_id", F.col("importance_score").alias("score"), "status")
    return A.stories(spark, d).where("editor_approved").join(e, "event_id", "left").select("story_id", "headline", F.coalesce("score", F.lit(0.0)).alias("importance"), "status")


@query("""SELECT DISTINCT story_id, source_name, source_url FROM claims JOIN claim_sources USING (claim_id) JOIN raw_items ON raw_item_id = id WHERE source_tier <= 2""")
def story_sources(spark, d):
    cited = A.claims(spark, d).join(A.claim_sources(spark, d), "claim_id").join(A.raw_items(spark, d).where("source_tier <= 2"), F.col("raw_item_id") == F.col("id"))
    return cited.select("story_id", "source_name", "source_url").distinct()


# changes of tables


@query("""SELECT source_name, source_url, id FROM (SELECT *, row_number() OVER (PARTITION BY source_name, source_url ORDER BY id) AS k FROM (
    SELECT source_name, CASE WHEN id % 3 = 0 THEN source_url ELSE 'https://new.example.com/' || id // 2 END AS source_url, id FROM raw_items) b
  WHERE NOT EXISTS (SELECT 1 FROM raw_items r WHERE r.source_name = b.source_name AND r.source_url = b.source_url)) WHERE k = 1""")  # fmt: skip
def insert_if_absent(spark, d):
    old = A.raw_items(spark, d)
    url = F.when(F.col("id") % 3 == 0, F.col("source_url")).otherwise(F.concat(F.lit("https://new.example.com/"), F.expr("id DIV 2").cast("string")))
    return tables.insert_if_absent(old, old.select("source_name", url.alias("source_url"), "id"), ["source_name", "source_url"], [F.col("id")])


@query("""SELECT story_id, event_id, headline || ' (new)' AS headline FROM stories WHERE editor_approved
  UNION ALL SELECT -event_id - 1, -event_id - 1, 'Fresh ' || event_id FROM events
  UNION ALL SELECT story_id, event_id, headline FROM stories WHERE NOT editor_approved""")  # fmt: skip
def upsert_story(spark, d):
    """Approved stories are written anew, and every event has a further one."""
    old = A.stories(spark, d).select("story_id", "event_id", "headline")
    news = A.stories(spark, d).where("editor_approved").select("story_id", "event_id", F.concat("headline", F.lit(" (new)")).alias("headline"))
    other = (-F.col("event_id") - 1).alias("event_id")
    fresh = A.events(spark, d).select(other.alias("story_id"), other, F.concat(F.lit("Fresh "), F.col("event_id").cast("string")).alias("headline"))
    return tables.upsert(old, news.unionByName(fresh), ["event_id"])


@query("""SELECT claim_id, story_id FROM claims WHERE story_id % 2 <> 0 UNION ALL SELECT claim_id + 1000000, story_id FROM claims WHERE story_id % 2 = 0 AND claim_id % 2 = 0""")
def replace_children(spark, d):
    old = A.claims(spark, d).select("claim_id", "story_id")
    fresh = old.where("story_id % 2 = 0 and claim_id % 2 = 0").withColumn("claim_id", F.col("claim_id") + 1_000_000)
    return tables.replace_children(old, fresh, "story_id", A.stories(spark, d).where("story_id % 2 = 0"))


@query("""SELECT claim_id, story_id, row_number() OVER (PARTITION BY story_id ORDER BY claim_id) - 1 AS ordinal FROM claims WHERE claim_id % 3 <> 0""")
def repack_ordinals(spark, d):
    kept = A.claims(spark, d).where("claim_id % 3 <> 0").select("claim_id", "story_id", F.col("claim_id").alias("ordinal"))
    return tables.repack_ordinals(kept, "story_id", "ordinal", "claim_id").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("""SELECT id, CASE WHEN quality = 0 THEN '' ELSE coalesce(content, '-') END AS body FROM raw_items LEFT JOIN labels ON id = doc_id""")
def store_body(spark, d):
    items = A.raw_items(spark, d).select("id", F.coalesce("content", F.lit("-")).alias("body"))
    news = A.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"), F.lit("").alias("body"))
    return tables.update_where_found(items, news, ["id"], ["body"])


# text


@query("SELECT id, left(CASE WHEN trim(title) <> '' AND trim(content) <> '' THEN trim(title) || chr(10) || chr(10) || trim(content) WHEN trim(title) <> '' THEN trim(title) ELSE trim(content) END, 2000) AS embed_text FROM raw_items")
def build_text(spark, d):
    return A.raw_items(spark, d).select("id", X.embed_text(F.col("title"), F.col("content")).alias("embed_text"))


@query("""SELECT id, unnest(list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')) AS sentence FROM raw_items""")  # fmt: skip
def sentence_split(spark, d):
    return A.raw_items(spark, d).select("id", F.explode(X.sentences(F.col("content"))).alias("sentence"))


@query("SELECT id, len(regexp_extract_all(content, '(?i)(all rights reserved|advertisement|sign in|licensed under)')) > 0 AS hit, regexp_matches(content, '(?i)all rights reserved') AS chrome FROM raw_items")
def boilerplate_filter(spark, d):
    wide = F.col("content").rlike("(?i)(all rights reserved|advertisement|sign in|licensed under)")
    return A.raw_items(spark, d).select("id", wide.alias("hit"), X.is_boilerplate(F.col("content")).alias("chrome"))


@query()
def strip_boilerplate(spark, d):
    return A.raw_items(spark, d).select("id", X.strip_boilerplate(F.col("content")).alias("body"))


@query("""SELECT DISTINCT n, array_to_string(list_transform(string_split(n, '_'), lambda p: CASE WHEN lower(p) IN ('pib', 'ap') THEN upper(p) ELSE upper(p[1]) || lower(p[2:]) END), ' ') AS outlet
  FROM (SELECT CASE source_tier WHEN 1 THEN 'pib_' ELSE 'the_' END || source_name AS n FROM raw_items)""")  # fmt: skip
def humanise_outlet(spark, d):
    n = A.raw_items(spark, d).select(F.concat(F.when(F.col("source_tier") == 1, "pib_").otherwise("the_"), "source_name").alias("n")).distinct()
    return n.select("n", X.humanise(F.col("n")).alias("outlet"))


@query("""SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(content), '[^\\p{L}\\p{N} _-]', '', 'g'), '[ _-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM raw_items""")
def slugify(spark, d):
    return A.raw_items(spark, d).select("id", X.slug(F.col("content")).alias("slug"))


@query("""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, (host = 'example.com' OR host LIKE '%.example.com') AS on_site, regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '/+$', '') AS plain, left(sha1(url), 12) AS hash,
  CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.png$') THEN '.png' ELSE '.jpg' END AS ext FROM p""")  # fmt: skip
def url_parts(spark, d):
    u = F.col("url")
    host = X.url_host(u)
    return A.table(spark, d, "pages").select("page_id", host.alias("host"), X.is_social_host(host, "example.com").alias("on_site"), F.lower(X.normalise_image_url(u)).alias("plain"), X.url_hash(u).alias("hash"), X.extension(u).alias("ext"))


@query("""SELECT id, coalesce(nullif(array_to_string(list_slice(list_filter(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9''-]{1,}'), lambda w: lower(w) NOT IN (%s)), 1, 8), ' '), ''), trim(content)) AS q FROM raw_items"""
       % ", ".join(f"'{w}'" for w in lexicons.HEADLINE_STOP_WORDS))
def headline_query(spark, d):
    return A.raw_items(spark, d).select("id", X.headline_query(F.col("content")).alias("q"))


@query()
def page_bodies(spark, d):
    from quillmark.runtime import ship_package

    ship_package(spark)
    return A.table(spark, d, "pages").select("page_id", feeds.extract_body(F.col("html")).alias("body"))


@query()
def html_candidates(spark, d):
    from quillmark.runtime import ship_package

    ship_package(spark)
    return feeds.image_candidates(A.table(spark, d, "pages"))


# time


@query("""SELECT id, CASE WHEN fetched_at > n THEN 'future' WHEN date_diff('day', fetched_at, n) = 0 THEN 'today' WHEN date_diff('day', fetched_at, n) = 1 THEN 'yesterday'
  WHEN date_diff('day', fetched_at, n) <= 6 THEN strftime(fetched_at, '%A') ELSE strftime(fetched_at, '%d %B %Y') END AS day FROM (SELECT *, TIMESTAMP '2024-01-03 12:00:00' AS n FROM raw_items)""")  # fmt: skip
def relative_day_bucket(spark, d):
    return A.raw_items(spark, d).select("id", X.relative_day(_now(), F.col("fetched_at")).alias("day"))


@query("""SELECT event_id, printf('%+d', CAST(trunc(date_diff('microsecond', last_seen_at, TIMESTAMP '2024-01-01 08:00:00') / 3.6e9) AS BIGINT)) AS gap,
  round(greatest(0.0, date_diff('microsecond', last_seen_at, TIMESTAMP '2024-01-03 12:00:00') / 3.6e9), 6) AS hours FROM events""")  # fmt: skip
def gap_hours(spark, d):
    gap = X.signed_gap(F.lit("2024-01-01 08:00:00").cast("timestamp"), F.col("last_seen_at"))
    return A.events(spark, d).select("event_id", gap.alias("gap"), F.round(F.greatest(F.lit(0.0), X.hours_between(_now(), F.col("last_seen_at"))), 6).alias("hours"))


@query("""WITH x AS (SELECT 1) SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def window_counts(spark, d):
    from quillmark.streaming.ingest import window_counts as counts

    return counts(A.table(spark, d, "events")).withColumn("total", F.round("total", 6))


# vectors


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM v""")  # fmt: skip
def vector_norm(spark, d):
    return A.table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)
SELECT a.vec_id AS vec_id_i, b.vec_id AS vec_id_j, round(list_dot_product(a.e, b.e), 6) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.e, b.e), 6) >= 0.35""")  # fmt: skip
def cosine_pairs(spark, d):
    return cluster.dense_pairs(A.table(spark, d, "embeddings"), "vec_id", "embedding", 0.35)


@query("""WITH p AS (SELECT label, vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
s AS (SELECT m.label, p.vec_id AS id, round(1 - sum(m.x / n.n * p.x) / sqrt(sum(p.x * p.x)), 6) AS distance FROM m JOIN n USING (label) JOIN p ON p.pos = m.pos GROUP BY 1, 2, n.n)
SELECT * FROM (SELECT label, id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS rank FROM s WHERE distance < 0.95) WHERE rank <= 3""")  # fmt: skip
def centroid_topk(spark, d):
    e = A.table(spark, d, "embeddings")
    near = cluster.nearest(V.centroids(e, "label", "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), "label", 0.95, 3)
    return near.select("label", "id", "distance", F.col("rank").cast("long").alias("rank"))


#: Of whole texts; with few buckets every two texts would share some.
_BUCKETS = 1 << 20
_TF = """t AS (SELECT id, list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}'), lambda w: w NOT IN (%s)) AS t FROM raw_items),
g AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda k: t[k] || ' ' || t[k + 1]))) AS gram FROM t),
c AS (SELECT id, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) %% 1048576 AS bucket, count(*) AS n FROM g GROUP BY 1, 2),
w AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM c)""" % ", ".join(f"'{w}'" for w in lexicons.STOP_WORDS)  # fmt: skip


@query(", " + _TF + " SELECT id, bucket, round(weight, 9) AS weight FROM w")
def feature_hash_tf(spark, d):
    return V.hashed_terms(A.raw_items(spark, d), "id", F.col("content"), _BUCKETS).select("id", "bucket", F.round("weight", 9).alias("weight"))


@query(", " + _TF + """ SELECT a.id AS i, b.id AS j, round(sum(a.weight * b.weight), 6) AS similarity FROM w a JOIN w b ON a.bucket = b.bucket AND a.id < b.id GROUP BY 1, 2 HAVING round(sum(a.weight * b.weight), 6) >= 0.9""")
def sparse_cosine_pairs(spark, d):
    return _text_pairs(spark, d)


def _text_pairs(spark, d) -> DataFrame:
    return termpairs.text_pairs(A.raw_items(spark, d), "id", F.col("content"), _BUCKETS, 0.9)


def _text_links(spark, d) -> DataFrame:
    return termpairs.text_links(A.raw_items(spark, d), "id", F.col("content"), _BUCKETS, 0.9)


@query("""SELECT a.event_id AS i, b.event_id AS j FROM events a JOIN events b ON a.event_id < b.event_id AND abs(date_diff('microsecond', a.last_seen_at, b.last_seen_at)) <= 1800000000""")
def band_self_join(spark, d):
    return cluster.band_pairs(A.events(spark, d), "event_id", "last_seen_at", 0.5).select(F.col("event_id_i").alias("i"), F.col("event_id_j").alias("j"))


_COMPONENTS = ", " + _TF.replace("t AS (SELECT id", "RECURSIVE_MARK t AS (SELECT id", 1).replace("RECURSIVE_MARK ", "") + """,
p AS (SELECT a.id AS i, b.id AS j FROM w a JOIN w b ON a.bucket = b.bucket AND a.id < b.id GROUP BY 1, 2 HAVING round(sum(a.weight * b.weight), 6) >= 0.9),
b AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r AS (SELECT id, id AS c FROM raw_items UNION SELECT b.j, r.c FROM r JOIN b ON b.i = r.id)
"""  # fmt: skip


@query((PRELUDE.replace("WITH raw_items", "WITH RECURSIVE raw_items", 1) + _COMPONENTS + " SELECT id, min(c) AS component FROM r GROUP BY 1"))
def connected_components(spark, d):
    return cluster.components(_text_links(spark, d), A.raw_items(spark, d), "id")


@query(PRELUDE.replace("WITH raw_items", "WITH RECURSIVE raw_items", 1) + _COMPONENTS + """, m AS (SELECT id, min(c) AS event_id FROM r GROUP BY 1),
k AS (SELECT m.event_id, x.*, coalesce(published_at, fetched_at) AS ts, row_number() OVER (PARTITION BY m.event_id ORDER BY source_tier, coalesce(published_at, fetched_at) DESC, x.id) AS k FROM m JOIN raw_items x USING (id))
SELECT event_id, max(CASE WHEN k = 1 THEN left(trim(title), 280) END) AS title, max(CASE WHEN k = 1 THEN left(trim(content), 500) END) AS summary,
  min(ts) AS first_seen_at, max(ts) AS last_seen_at, bool_or(source_tier <= 2) AS tier_1_anchor, count(*) AS num_items FROM k GROUP BY 1""")  # fmt: skip
def cluster_events(spark, d):
    return cluster.cluster_events(A.raw_items(spark, d), _text_links(spark, d))


@query("SELECT event_id, raw_item_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY source_tier, coalesce(published_at, fetched_at) DESC, id) AS k FROM event_items JOIN raw_items ON raw_item_id = id) WHERE k = 1")
def representative_argmin(spark, d):
    return cluster.representative(_members(spark, d), "event_id")


# ranking


def _features(spark, d) -> DataFrame:
    return rank.event_features(_members(spark, d).withColumn("ts", F.coalesce("published_at", "fetched_at")), _now(), LISTS)


def _hits(words) -> str:
    quoted = ["'{}'".format(w.replace("'", "''")) for w in words]
    return f"list_filter([{', '.join(quoted)}], lambda w: contains(blob, w))"


_FEATURES = f""", i0 AS (SELECT event_id, r.*, ' ' || lower(coalesce(title, '') || ' ' || coalesce(content, '')) || ' ' AS blob FROM event_items JOIN raw_items r ON raw_item_id = id),
i1 AS (SELECT event_id, {", ".join(f"{_hits(w)} AS {n}" for n, w in LISTS.items())} FROM i0),
h0 AS (SELECT event_id, {", ".join(f"list_sort(list_distinct(flatten(list({n})))) AS {n}_matched" for n in LISTS)} FROM i1 GROUP BY 1),
f0 AS (SELECT event_id, count(*) AS num_items, count(DISTINCT source_name) AS distinct_sources, {", ".join(f"count(DISTINCT CASE WHEN source_tier = {t} THEN source_name END) AS tier{t}_sources" for t in (1, 2, 3))},
  bool_and(source_tier = 3) AS signal_only, round(greatest(0.0, date_diff('microsecond', max(coalesce(published_at, fetched_at)), TIMESTAMP '{NOW}') / 3.6e9), 6) AS recency_hours FROM i0 GROUP BY 1),
f AS (SELECT event_id, num_items, distinct_sources, tier1_sources, tier2_sources, tier3_sources, signal_only, {", ".join(f"{n}_matched, len({n}_matched) AS {n}_hits" for n in LISTS)},
  tier1_sources > 0 OR tier2_sources > 0 AS tier_1_anchor, recency_hours FROM f0 JOIN h0 USING (event_id)),
s AS (SELECT event_id, tier_1_anchor, round(greatest(0.0,
  CASE WHEN tier1_sources > 0 THEN 2.5 WHEN tier2_sources > 0 THEN 1.5 ELSE 0 END + 0.9::DOUBLE * least(distinct_sources, 8) + 0.5::DOUBLE * least(tier1_sources, 4) + 0.5::DOUBLE * least(tier2_sources, 4)
  + 0.5::DOUBLE * least(policy_hits, 5) + 0.8::DOUBLE * least(ground_hits, 5) + CASE WHEN region_hits >= 3 THEN 3 WHEN region_hits = 0 THEN -4 ELSE 0 END
  + CASE WHEN tier1_sources = 0 AND tier2_sources >= 2 AND ground_hits >= 1 THEN 2.5 ELSE 0 END + CASE WHEN tier3_sources > 0 AND (tier1_sources > 0 OR tier2_sources > 0) THEN 1 ELSE 0 END
  - CASE WHEN tier1_sources > 0 AND tier2_sources = 0 AND ground_hits = 0 AND distinct_sources <= 2 THEN 1.5 ELSE 0 END
  + CASE WHEN ground_hits >= 1 THEN CASE WHEN recency_hours <= 24 THEN 3 * (1 - recency_hours / 24) ELSE 0 END ELSE greatest(0.0, 1 - recency_hours / 48) END
  - 0.7::DOUBLE * least(downweight_hits, 6) - CASE WHEN signal_only THEN 3 ELSE 0 END
  - CASE WHEN distinct_sources = 1 AND NOT (tier1_sources > 0 OR tier2_sources > 0) THEN 1 ELSE 0 END), 6) AS score FROM f)
"""  # fmt: skip


@query(_FEATURES + "SELECT * FROM f")
def event_features(spark, d):
    return _features(spark, d)


@query(_FEATURES + "SELECT event_id, tier_1_anchor, score FROM s")
def importance_score(spark, d):
    return _features(spark, d).select("event_id", "tier_1_anchor", rank.importance_score().alias("score"))


@query(_FEATURES + "SELECT event_id, score FROM s WHERE tier_1_anchor AND score > 0 ORDER BY score DESC, CAST(event_id AS VARCHAR) LIMIT 25")
def select_top_n(spark, d):
    return rank.select_top(importance_score(spark, d), 25).select("event_id", "score")


@query(_FEATURES + """, t AS (SELECT event_id FROM s WHERE tier_1_anchor AND score > 0 ORDER BY score DESC, CAST(event_id AS VARCHAR) LIMIT 25)
SELECT e.event_id, CASE WHEN status IN ('candidate', 'selected') AND t.event_id IS NOT NULL THEN 'selected' WHEN status = 'selected' THEN 'candidate' ELSE status END AS status FROM events e LEFT JOIN t USING (event_id)""")  # fmt: skip
def demote_set(spark, d):
    return rank.with_status(A.events(spark, d), select_top_n(spark, d)).select("event_id", "status")


@query("SELECT event_id, importance_score FROM events WHERE status = 'candidate' AND tier_1_anchor AND importance_score > 0 ORDER BY importance_score DESC, event_id LIMIT 15")
def promote_next(spark, d):
    return rank.promote_next(A.events(spark, d), 15).select("event_id", "importance_score")


@query("SELECT event_id, least(greatest(2 * (event_id % 12), 5), 15) AS batch FROM events")
def topup_batch(spark, d):
    return A.events(spark, d).select("event_id", rank.topup_batch(F.col("event_id") % 12).alias("batch"))


@query("SELECT id, CASE WHEN contains(lower(content), 'thenti') OR contains(lower(content), 'scum') THEN 'debate' ELSE 'report' END AS mode FROM raw_items")
def mode_decision(spark, d):
    return A.raw_items(spark, d).select("id", C.mode(F.col("content"), ("thenti", "scum")).alias("mode"))


# claims and stories


@query("""SELECT event_id, id, k AS rank FROM (SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY source_tier, -length(content), id) AS k FROM event_items JOIN raw_items ON raw_item_id = id) WHERE k <= 8""")
def prompt_sources_topk(spark, d):
    r = F.row_number().over(Window.partitionBy("event_id").orderBy("source_tier", -F.length("content"), "id"))
    return _members(spark, d).select("event_id", "id", r.cast("long").alias("rank")).where("rank <= 8")


_LOCAL_CLAIMS = PRELUDE.replace("WITH raw_items", "WITH RECURSIVE raw_items", 1) + f""", se AS (SELECT event_id, source_tier, CAST(id AS VARCHAR) AS id, unnest(x) AS s, unnest(range(len(x))) AS pos FROM (
  SELECT event_id, id, source_tier, list_filter(list_transform(string_split(regexp_replace(trim(content), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS x
  FROM event_items JOIN raw_items ON raw_item_id = id)),
fi AS (SELECT event_id, source_tier, id, arg_min(s, pos) AS s, min(pos) AS pos FROM se WHERE length(s) BETWEEN 40 AND 320 AND NOT regexp_matches(s, '{X.BOILERPLATE_PATTERN}') GROUP BY event_id, source_tier, id, lower(s)),
ca AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY source_tier, id, pos) AS k FROM fi),
fo AS (SELECT DISTINCT event_id, 0::BIGINT AS k, CAST([] AS STRUCT(s VARCHAR, id VARCHAR)[]) AS got FROM ca UNION ALL
  SELECT fo.event_id, ca.k, CASE WHEN len(got) < 14 AND len(list_filter(got, lambda y: y.id = ca.id)) < 3 AND len(list_filter(got, lambda y: lower(y.s) = lower(ca.s))) = 0 THEN list_append(got, {{'s': ca.s, 'id': ca.id}}) ELSE got END
  FROM fo JOIN ca ON ca.event_id = fo.event_id AND ca.k = fo.k + 1),
la AS (SELECT event_id, arg_max(got, k) AS got FROM fo GROUP BY 1)
SELECT event_id, CAST(unnest(range(len(got))) AS INTEGER) AS ordinal, unnest(got).s AS claim_text, unnest(got).id AS source_id FROM la"""


@query(_LOCAL_CLAIMS)
def local_claims(spark, d):
    return C.local_claims(_members(spark, d).select("event_id", "id", "source_tier", F.col("content").alias("text")))


@query("""SELECT claim_id, coalesce(n, 0) AS n_sources, coalesce(p, FALSE) AS tier_1_backed, coalesce(p, FALSE) OR coalesce(n, 0) >= 2 AS verified,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no valid source' WHEN p OR n >= 2 THEN '' WHEN g THEN 'single unverified social/signal source' ELSE 'single-source, no primary anchor' END AS note
  FROM claims LEFT JOIN (SELECT claim_id, count(DISTINCT source_name) AS n, bool_or(source_tier = 1) AS p, bool_and(source_tier = 3) AS g FROM claim_sources JOIN raw_items ON raw_item_id = id GROUP BY 1) USING (claim_id)""")  # fmt: skip
def verify_floor(spark, d):
    named = A.claim_sources(spark, d).join(A.raw_items(spark, d), F.col("raw_item_id") == F.col("id")).select("claim_id", "source_name", "source_tier")
    return C.verify_floor(A.claims(spark, d), named)


@query(""", c AS (SELECT story_id, claim_id AS idx, verified, claim_id % 9 = 0 AS tier_1_backed, claim_id % 13 = 0 AS contradicted, claim_id % 3 > 0 AS unsupported, count(*) OVER (PARTITION BY story_id) AS n FROM claims),
x AS (SELECT *, unsupported AND NOT contradicted AND NOT tier_1_backed AND n >= 2 AS soft FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY story_id, soft ORDER BY verified, idx) AS k FROM x),
m AS (SELECT *, contradicted OR (soft AND k <= floor(n * 0.5)) AS cut FROM r),
l AS (SELECT *, count(*) FILTER (verified AND NOT cut) OVER (PARTITION BY story_id) AS alive, min(CASE WHEN verified AND NOT contradicted THEN idx END) OVER (PARTITION BY story_id) AS first FROM m)
SELECT story_id, idx, cut AND NOT coalesce(alive = 0 AND idx = first, FALSE) AS cut FROM l""")  # fmt: skip
def soft_cut_cap(spark, d):
    c = A.claims(spark, d).select("story_id", F.col("claim_id").alias("idx"), "verified", (F.col("claim_id") % 9 == 0).alias("tier_1_backed"), (F.col("claim_id") % 13 == 0).alias("contradicted"), (F.col("claim_id") % 3 > 0).alias("unsupported"))
    return C.soft_cut(c)


_U = """, u AS (SELECT vec_id AS id, label % 2 = 0 AS g, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS e FROM embeddings)
"""


def _vector_stories(spark, d) -> DataFrame:
    e = A.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("story_id"), (F.col("label") % 2 == 0).alias("is_ground"), F.transform("embedding", lambda x: x.cast("double") / V.norm(F.col("embedding"))).alias("u"), (F.col("vec_id") % 7).cast("double").alias("importance_score"))


@query(_U + """SELECT a.id AS i, b.id AS j, round(list_dot_product(a.e, b.e), 6) AS similarity, CASE WHEN a.g OR b.g THEN 0.40 ELSE 0.33 END::DOUBLE AS threshold FROM u a JOIN u b ON a.id < b.id
  WHERE round(list_dot_product(a.e, b.e), 6) >= CASE WHEN a.g OR b.g THEN 0.40 ELSE 0.33 END""")  # fmt: skip
def pair_threshold_dedup(spark, d):
    return stories.story_pairs(_vector_stories(spark, d), 0.33, 0.40)


@query()
def greedy_dedup(spark, d):
    s = _vector_stories(spark, d)
    return stories.greedy_dedup(stories.story_pairs(s, 0.33, 0.40), s, 0.33)


@query(""", c AS (SELECT event_id AS story_id, id AS seq, regexp_replace(source_url, '[?].*', '') AS key, source_url AS url, round(10 - 0.3::DOUBLE * least(id % 25, 20) + 0.001::DOUBLE * (id % 900), 6) AS score FROM event_items JOIN raw_items ON raw_item_id = id),
o AS (SELECT *, row_number() OVER (PARTITION BY story_id, key ORDER BY score DESC, seq) AS n FROM c)
SELECT * FROM (SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, seq) - 1 AS ordinal, url, score FROM o WHERE n = 1) WHERE ordinal < 3""")  # fmt: skip
def image_top3(spark, d):
    score = F.round(stories.image_score(F.col("id") % 25, (F.col("id") % 900).cast("int"), F.lit(None).cast("int"), F.lit("")), 6)
    c = _members(spark, d).select(F.col("event_id").alias("story_id"), F.col("id").alias("seq"), F.col("source_url").alias("url"), score.alias("score"))
    return stories.top_images(c).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("""SELECT story_id, string_agg('[' || source_name || '](' || url || ')', ', ' ORDER BY pos) AS citations FROM (
  SELECT story_id, source_name, arg_min(source_url, claim_id) AS url, min(claim_id) AS pos FROM claims JOIN raw_items ON claim_id = id GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def citation_lists(spark, d):
    cited = A.claims(spark, d).join(A.raw_items(spark, d), F.col("claim_id") == F.col("id")).select("story_id", F.col("claim_id").alias("at"), F.col("source_name").alias("name"), F.col("source_url").alias("url"))
    return stories.citations(cited, "story_id")


@query("""SELECT row_number() OVER (ORDER BY importance_score DESC NULLS LAST, story_id) AS n, headline, lower(replace(headline, ' ', '-')) AS anchor FROM stories WHERE editor_approved""")
def edition_toc(spark, d):
    n = F.row_number().over(Window.orderBy(F.desc_nulls_last("importance_score"), "story_id"))
    return A.stories(spark, d).where("editor_approved").select(n.cast("long").alias("n"), "headline", X.slug(F.col("headline")).alias("anchor"))


@query("""WITH x AS (SELECT 1) SELECT event_id, coalesce(json_extract_string(props, '$.page'), '-') AS page, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_path_defaults(spark, d):
    v = F.try_parse_json("props")
    return A.table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.page", "string"), F.lit("-")).alias("page"), F.try_variant_get(v, "$.k", "int").alias("k"))


@query()
def salvage_json(spark, d):
    from quillmark.runtime import ship_package

    ship_package(spark)
    noisy = F.concat(F.lit('Sure! {"claims": [{"text": "'), F.regexp_replace("text", r'[\\"\p{Cntrl}]', " "), F.lit('", "source_ids": [1]}, {"text": "cut'))
    return A.table(spark, d, "conversations").select("conv_id", "turn", C.salvage_json(noisy).alias("objects"))
