"""Queries of the stages, listings and editions over the sample tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import Settings
from quillmark.functions import text as X
from quillmark.functions.lexicons import HEADLINE_STOP_WORDS, PAYWALLED_HOSTS
from quillmark.operators import claims as C
from quillmark.operators import editions, tables
from quillmark.plans import adapters as A
from quillmark.plans import newsroom, registry, stages
from quillmark.plans.registry import _TF, query
from quillmark.runtime import materialize, ship_package
from quillmark.sources import catalogue
from quillmark.streaming.ingest import sessions

#: Of the sample's vectors, few are as alike as texts of one event.
SAMPLE_SIMILARITY = 0.45


def _embedded(spark, d) -> DataFrame:
    return A.raw_items(spark, d).join(A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


_EMBEDDED = """, it AS (SELECT r.*, coalesce(published_at, fetched_at) AS ts, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM raw_items r LEFT JOIN embeddings ON vec_id = id)
"""


@query(_EMBEDDED + "SELECT id, title FROM it WHERE e IS NULL ORDER BY fetched_at, id LIMIT 1000000")
def embed_pending(spark, d):
    from quillmark.operators.embeddings import pending

    return pending(_embedded(spark, d)).select("id", "title")


@query(", " + _TF.replace("lower(content)", "lower(embed_text)").replace("FROM raw_items)", """FROM (SELECT id, left(CASE WHEN trim(coalesce(title, '')) <> '' AND trim(coalesce(content, '')) <> '' THEN trim(title) || chr(10) || chr(10) || trim(content)
  WHEN trim(coalesce(title, '')) <> '' THEN trim(title) ELSE trim(coalesce(content, '')) END, 2000) AS embed_text FROM raw_items WHERE id NOT IN (SELECT vec_id FROM embeddings)))""", 1).replace("1048576", "1024")
       + " SELECT id, bucket, CAST(floor(weight / min(weight) OVER (PARTITION BY id) * 100 + 0.3137) AS DOUBLE) AS weight FROM w UNION ALL SELECT vec_id, unnest(range(len(embedding))), CAST(unnest(embedding) AS DOUBLE) FROM embeddings JOIN raw_items ON id = vec_id")
def embed_stage(spark, d):
    """Items without a vector get one of hashed terms, the others keep theirs; as (id, place, value), of new ones without zeros and in
    hundredths of the least value."""
    old = _embedded(spark, d)
    new = stages.embed(old.withColumn("known", F.col("embedding").isNotNull()), Settings(embedding_backend="local"), limit=None)
    least = F.array_min(F.filter("embedding", lambda x: x != 0)).cast("double")
    # a step of its own: beside posexplode it would be computed for each place
    rows = new.select("id", "known", F.when(~F.col("known"), least).alias("least"), "embedding").select("id", "known", "least", F.posexplode("embedding").alias("bucket", "x"))
    x = F.col("x").cast("double")
    value = F.when(F.col("known"), x).otherwise(F.floor(x / F.col("least") * 100 + 0.3137).cast("double"))
    return rows.where("known or x != 0").select("id", F.col("bucket").cast("long").alias("bucket"), value.alias("weight"))


_CLUSTERED = f"""{_EMBEDDED.replace(", it AS", ", RECURSIVE_MARK it AS")}, un AS (SELECT id, ts, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM it WHERE e IS NOT NULL),
p AS (SELECT a.id AS i, b.id AS j FROM un a JOIN un b ON a.id < b.id AND abs(date_diff('microsecond', a.ts, b.ts)) <= 172800000000 AND round(list_dot_product(a.u, b.u), 6) >= {SAMPLE_SIMILARITY}),
b AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p), r AS (SELECT id, id AS c FROM un UNION SELECT b.j, r.c FROM r JOIN b ON b.i = r.id),
m AS (SELECT id, min(c) AS event_id FROM r GROUP BY 1)
""".replace("RECURSIVE_MARK ", "")
_RECURSIVE = A.PRELUDE.replace("WITH raw_items", "WITH RECURSIVE raw_items", 1)


def _clustered(spark, d):
    none = A.event_items(spark, d).limit(0)
    return stages.cluster_stage(_embedded(spark, d), none, Settings(cluster_similarity=SAMPLE_SIMILARITY))


@query(_RECURSIVE + _CLUSTERED + """, k AS (SELECT m.event_id, x.*, coalesce(published_at, fetched_at) AS ts, row_number() OVER (PARTITION BY m.event_id ORDER BY source_tier, coalesce(published_at, fetched_at) DESC, x.id) AS k FROM m JOIN raw_items x USING (id))
SELECT event_id, max(CASE WHEN k = 1 THEN left(trim(title), 280) END) AS title, min(ts) AS first_seen_at, max(ts) AS last_seen_at, bool_or(source_tier <= 2) AS tier_1_anchor, count(*) AS num_items, 'candidate' AS status FROM k GROUP BY 1""")  # fmt: skip
def cluster_stage(spark, d):
    """Events of embedded items: cosine and 48 hours in one join, links chained."""
    return _clustered(spark, d)[0].select("event_id", "title", "first_seen_at", "last_seen_at", "tier_1_anchor", "num_items", "status")


@query(_RECURSIVE + _CLUSTERED + "SELECT event_id, id AS raw_item_id FROM m")
def cluster_bridge(spark, d):
    return _clustered(spark, d)[1]


@query(_EMBEDDED + """, un AS (SELECT id, ts, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM it WHERE e IS NOT NULL)
SELECT a.id AS id_i, b.id AS id_j, round(list_dot_product(a.u, b.u), 6) AS similarity FROM un a JOIN un b ON a.id < b.id AND abs(date_diff('microsecond', a.ts, b.ts)) <= 7200000000 WHERE round(list_dot_product(a.u, b.u), 6) >= 0.35""")  # fmt: skip
def window_cosine_pairs(spark, d):
    from quillmark.operators.cluster import similar_pairs

    return similar_pairs(_embedded(spark, d).withColumn("ts", F.coalesce("published_at", "fetched_at")), "id", "embedding", 0.35, "ts", 2.0)


@query(f"""{_EMBEDDED}, c AS (SELECT event_id, pos, avg(x) AS x FROM (SELECT event_id, unnest(range(len(e))) AS pos, unnest(e) AS x FROM event_items JOIN it ON id = raw_item_id WHERE e IS NOT NULL) GROUP BY 1, 2),
n AS (SELECT event_id, list(x ORDER BY pos) AS v, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
rec AS (SELECT * FROM it WHERE source_tier = 1 AND e IS NOT NULL AND fetched_at >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 48 HOURS),
ds AS (SELECT n.event_id, id, round(1 - list_dot_product(v, e) / n / sqrt(list_dot_product(e, e)), 6) AS distance FROM n, rec WHERE NOT EXISTS (SELECT 1 FROM event_items b WHERE b.event_id = n.event_id AND b.raw_item_id = rec.id)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, CAST(id AS VARCHAR)) AS k FROM ds WHERE distance < 0.98)
SELECT event_id, CAST(id AS VARCHAR) AS id, source_name || '-response' AS source_name, left('[response ' || printf('%+d', CAST(trunc(date_diff('microsecond', last_seen_at, fetched_at) / 3.6e9) AS BIGINT)) || 'h from main event] ' || trim(coalesce(title, '')), 280) AS title
FROM k JOIN it USING (id) JOIN events USING (event_id) WHERE k <= 3""")  # fmt: skip
def official_responses(spark, d):
    """The nearest official items outside an event, by its centroid."""
    events, docs = A.events(spark, d), A.event_items(spark, d).withColumnRenamed("raw_item_id", "id")
    return newsroom.responses(events, docs, _embedded(spark, d), F.lit("2024-01-02 12:00:00").cast("timestamp"), most=0.98).select("event_id", "id", "source_name", "title")


@query(f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://www.reuters.com/x/' || page_id WHEN page_id % 4 = 1 THEN 'https://Old.Reddit.com/r/x/' || page_id ELSE url END AS url FROM pages),
h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM u)
SELECT page_id, url, host IN ({", ".join(f"'{h}'" for h in PAYWALLED_HOSTS)}) AS paywalled, host = 'reddit.com' OR host LIKE '%.reddit.com' AS social FROM h""")  # fmt: skip
def fetch_plan(spark, d):
    """Where each page's address leads by a table of redirects, and how it would be fetched."""
    p = A.table(spark, d, "pages")
    k = F.col("page_id") % 4
    to = F.when(k == 0, F.concat(F.lit("https://www.reuters.com/x/"), F.col("page_id").cast("string"))).when(k == 1, F.concat(F.lit("https://Old.Reddit.com/r/x/"), F.col("page_id").cast("string")))
    redirects = p.select(F.concat(F.lit("r:"), F.col("page_id").cast("string"), F.lit(":"), "url").alias("url"), F.coalesce(to, F.col("url")).alias("target"))
    rows = stages.resolved(F.concat(F.lit("r:"), F.col("page_id").cast("string"), F.lit(":"), F.col("url")), redirects, p.select("page_id", F.col("url").alias("own")).withColumnRenamed("own", "url"))
    host = X.url_host(F.col("url"))
    return rows.select("page_id", "url", X.is_paywalled(host).alias("paywalled"), X.is_social_host(host).alias("social"))


def _page_items(spark, d):
    """Items whose addresses are those of the sample pages, all in selected events."""
    p = A.table(spark, d, "pages")
    now = F.lit(A.NOW).cast("timestamp")
    items = p.select(F.col("page_id").alias("id"), F.lit("src").alias("source_name"), F.lit(2).alias("source_tier"), F.col("url").alias("source_url"), F.lit("t").alias("title"), F.lit("c").alias("content"), now.alias("fetched_at"), F.lit(None).cast("string").alias("full_content"), F.lit(None).cast("timestamp").alias("full_content_fetched_at"))
    bridge = p.select(F.expr("page_id DIV 3").alias("event_id"), F.col("page_id").alias("raw_item_id"))
    return items, bridge, bridge.select("event_id", F.lit("selected").alias("status")).distinct()


@query()
def fetch_stage(spark, d):
    items, bridge, events = _page_items(spark, d)
    pages = A.table(spark, d, "pages").select("url", "html")
    return stages.fetch_stage(items, bridge, events, pages, F.lit(A.NOW).cast("timestamp"))[0].select("id", "full_content", "full_content_fetched_at")


@query()
def image_stage(spark, d):
    items, bridge, events = _page_items(spark, d)
    live = events.select(F.col("event_id").alias("story_id"), F.concat(F.lit("Story "), F.col("event_id").cast("string")).alias("headline"))
    sources = bridge.join(items, F.col("raw_item_id") == F.col("id")).select(F.col("event_id").alias("story_id"), "source_name", "source_url")
    return stages.image_stage(live, sources, A.table(spark, d, "pages").select("url", "html"), date="2024-01-03")[0]


@query()
def research_docs(spark, d):
    """Every page is a search result of the query that its event's debate asks for."""
    items, bridge, events = _page_items(spark, d)
    turns = events.select("event_id", F.concat(F.lit("No more is known.  RESEARCH: what about "), F.col("event_id").cast("string")).alias("turn"))
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("raw_item_id"))
    results = bridge.join(items, F.col("raw_item_id") == F.col("id")).select(F.concat(F.lit("what about "), F.col("event_id").cast("string")).alias("query"), n.alias("rank"), F.col("source_url").alias("url"), "title")
    return stages.research(turns, results, A.table(spark, d, "pages").select("url", "html"))


_CITED = """, ou AS (SELECT claim_id, list_sort(list(DISTINCT source_name)) AS outlets FROM claim_sources JOIN raw_items ON raw_item_id = id GROUP BY 1),
nice AS (SELECT n, array_to_string(list_transform(list_filter(string_split(replace(n, '-', '_'), '_'), lambda p: p <> ''), lambda p: upper(p[1]) || lower(p[2:])), ' ') AS nice FROM (SELECT DISTINCT source_name AS n FROM raw_items))
"""


@query(_CITED + "SELECT story_id, list_sort(list(DISTINCT nice)) AS outlets FROM claims JOIN claim_sources USING (claim_id) JOIN raw_items ON raw_item_id = id JOIN nice ON n = source_name GROUP BY 1")
def edition_outlets(spark, d):
    told = editions.claim_outlets(A.claims(spark, d), A.claim_sources(spark, d), A.raw_items(spark, d))
    return told.groupBy("story_id").agg(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("outlets")), X.humanise))).alias("outlets"))


def _signals(spark, d):
    items = A.raw_items(spark, d).withColumn("source_name", F.concat(F.lit("reddit_"), "source_name"))
    return editions.social_posts(A.event_items(spark, d), items)


@query("""SELECT event_id, CAST(sum(n) AS BIGINT) AS posts, '*Public discussion: ' || sum(n) || ' Reddit ' || CASE WHEN sum(n) = 1 THEN 'post' ELSE 'posts' END || ' in this event''s cluster (' || string_agg('r/' || source_name, ', ' ORDER BY source_name) || ') — surfaced as signal, not cited as fact.*' AS discussion
  FROM (SELECT event_id, source_name, count(*) AS n FROM event_items JOIN raw_items ON raw_item_id = id WHERE source_tier = 3 GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def post_sums(spark, d):
    return editions.discussions(_signals(spark, d)).select("event_id", "posts", "discussion")


def _edition_stories(spark, d) -> DataFrame:
    mode = F.when(F.col("story_id") % 3 == 0, "debate").otherwise("report")
    trace = F.to_json(F.struct(mode.alias("mode"), (F.col("story_id") % 5).alias("n_sources"), F.struct((F.col("story_id") % 2).alias("verified")).alias("verifier"), F.concat(F.lit("Context "), F.col("story_id").cast("string")).alias("context")))
    body = F.when(F.col("story_id") % 2 == 0, F.concat(F.lit("Body "), F.col("story_id").cast("string")))
    return A.stories(spark, d).select("*", F.when(F.col("story_id") % 4 > 0, "A dek.").alias("dek"), body.alias("body_markdown"), trace.alias("agent_trace"), F.lit(A.NOW).cast("timestamp").alias("created_at"))


@query(_CITED + """, cl AS (SELECT story_id, claim_id, '- Claim ' || claim_id || '. — *' || coalesce((SELECT string_agg(nice, ', ' ORDER BY o) FROM (SELECT unnest(outlets) AS o) JOIN nice ON n = o), 'unattributed') || '*' || CASE WHEN claim_id % 7 = 0 THEN ' _(primary-source backed)_' ELSE '' END AS line
  FROM claims LEFT JOIN ou USING (claim_id)),
ll AS (SELECT story_id, string_agg(line, chr(10) ORDER BY claim_id) AS lines, count(*) AS n FROM cl GROUP BY 1),
so AS (SELECT story_id, string_agg(nice, ', ' ORDER BY nice) AS names FROM (SELECT DISTINCT story_id, nice FROM claims JOIN claim_sources USING (claim_id) JOIN raw_items ON raw_item_id = id JOIN nice ON n = source_name) GROUP BY 1),
st AS (SELECT *, row_number() OVER (ORDER BY importance_score DESC NULLS LAST, story_id) AS i, story_id % 3 = 0 AS debate FROM stories)
SELECT i AS n, story_id, chr(10) || '---' || chr(10) || chr(10) || '## ' || i || '. ' || headline || chr(10) || chr(10) || CASE WHEN story_id % 4 > 0 THEN '*A dek.*' || chr(10) || chr(10) ELSE '' END
  || '> ' || CASE WHEN debate THEN 'DEBATE' ELSE 'REPORT' END || CASE WHEN story_id % 5 > 0 THEN '  ·  ' || story_id % 5 || ' sources' ELSE '' END || '  ·  ' || ll.n || ' claim(s) kept' || CASE WHEN debate THEN '' ELSE '  ·  ' || story_id % 2 || ' verified' END || chr(10) || chr(10)
  || '### Context' || chr(10) || chr(10) || 'Context ' || story_id || chr(10) || chr(10)
  || CASE WHEN debate THEN '### Sourced points' || chr(10) || chr(10) || lines || chr(10) || chr(10) WHEN story_id % 2 = 0 THEN '### Report' || chr(10) || chr(10) || 'Body ' || story_id || chr(10) || chr(10) ELSE '### What we know' || chr(10) || chr(10) || lines || chr(10) || chr(10) END
  || '**Sources:** ' || names || chr(10) AS markdown
FROM st JOIN ll USING (story_id) JOIN so USING (story_id)""")  # fmt: skip
def edition_stories(spark, d):
    """Each story of an edition as its markdown."""
    told = editions.claim_outlets(A.claims(spark, d), A.claim_sources(spark, d), A.raw_items(spark, d))
    told = told.select("story_id", F.col("claim_id").alias("ordinal"), F.concat(F.lit("Claim "), F.col("claim_id").cast("string"), F.lit(".")).alias("claim_text"), (F.col("claim_id") % 7 == 0).alias("tier_1_backed"), "outlets")
    lines = editions.story_lines(_edition_stories(spark, d), told)
    return lines.select(F.col("n").cast("long").alias("n"), "story_id", F.array_join("lines", "\n").alias("markdown"))


_STORY_SQL = registry._ORACLES["edition_stories"].removeprefix(A.PRELUDE)
_APPROVED = _STORY_SQL.replace("FROM stories)", "FROM stories WHERE editor_approved)").replace("'- Claim ' || claim_id || '. — *'", "'- Claim ' || claim_id || ' — *'").replace("CASE WHEN claim_id % 7 = 0 THEN ' _(primary-source backed)_' ELSE '' END", "''").replace("SELECT i AS n,", ", md AS (SELECT i AS n, headline, CASE WHEN debate THEN 'debate' ELSE 'report' END AS mode, event_id,", 1) + """),
po AS (SELECT event_id, '*Public discussion: ' || sum(n) || ' Reddit ' || CASE WHEN sum(n) = 1 THEN 'post' ELSE 'posts' END || ' in this event''s cluster (' || string_agg('r/' || source_name, ', ' ORDER BY source_name) || ') — surfaced as signal, not cited as fact.*' AS said
  FROM (SELECT event_id, source_name, count(*) AS n FROM event_items JOIN raw_items ON raw_item_id = id WHERE source_tier = 3 GROUP BY 1, 2) GROUP BY 1)
"""  # fmt: skip


@query(_APPROVED + f"""SELECT '# Daily Edition' || chr(10) || chr(10) || '*Autonomous, fact-checked newsletter · Wednesday, 03 January 2024 · ' || count(*) || ' stor' || CASE WHEN count(*) = 1 THEN 'y' ELSE 'ies' END || '*' || chr(10) || chr(10)
  || '## In this edition' || chr(10) || chr(10) || string_agg(n || '. [' || headline || '](#' || n || '-' || lower(replace(headline, ' ', '-')) || ') — _' || mode || '_', chr(10) ORDER BY n) || chr(10) || chr(10)
  || string_agg(markdown || CASE WHEN said IS NOT NULL THEN chr(10) || said || chr(10) ELSE '' END, chr(10) ORDER BY n) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '{editions.FOOTER}' AS markdown
  FROM md LEFT JOIN po USING (event_id)""")  # fmt: skip
def edition_text(spark, d):
    """The whole edition as one text."""
    return edition_markdown(spark, d).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("markdown"))


@query()
def edition_markdown(spark, d):
    """All lines of the edition of approved stories."""
    told = editions.claim_outlets(A.claims(spark, d), A.claim_sources(spark, d), A.raw_items(spark, d))
    told = told.select("story_id", F.col("claim_id").alias("ordinal"), F.concat(F.lit("Claim "), F.col("claim_id").cast("string")).alias("claim_text"), F.lit(False).alias("tier_1_backed"), "outlets")
    lines = editions.story_lines(_edition_stories(spark, d).where("editor_approved"), told, None, _signals(spark, d))
    return editions.edition(materialize(lines, "edition-stories"), F.lit(A.NOW).cast("timestamp"))


@query("""SELECT source_name, source_tier, feed_url LIKE 'https://news.google.com/rss/search?q=%' AS search, max_entries FROM (VALUES
  ('pib', 1, 'https://news.google.com/rss/search?q=', 50), ('supreme_court', 1, 'https://news.google.com/rss/search?q=', 50), ('rbi', 1, 'https://news.google.com/rss/search?q=', 50), ('prs_india', 1, 'https://news.google.com/rss/search?q=', 50),
  ('reuters_india', 2, 'https://news.google.com/rss/search?q=', 50), ('ap_india', 2, 'https://news.google.com/rss/search?q=', 50), ('the_hindu', 2, 'https://news.google.com/rss/search?q=', 50), ('indian_express', 2, 'https://news.google.com/rss/search?q=', 50),
  ('reddit_news', 3, 'https://old.reddit.com', 30), ('reddit_cities', 3, 'https://old.reddit.com', 30), ('reddit_topical', 3, 'https://old.reddit.com', 30), ('google_news_india', 3, 'https://news.google.com/rss/search?q=', 100)) v(source_name, source_tier, feed_url, max_entries)""")  # fmt: skip
def source_catalogue(spark, d):
    return catalogue.catalogue(spark).select("source_name", "source_tier", F.col("feed_url").startswith(catalogue.SEARCH + "?q=").alias("search"), "max_entries")


@query(f"""SELECT story_id, array_to_string(list_slice(list_filter(regexp_extract_all(headline, '[A-Za-z][A-Za-z0-9''-]{{1,}}'), lambda w: lower(w) NOT IN ({", ".join(f"'{w}'" for w in HEADLINE_STOP_WORDS)})), 1, 8), ' ') AS query FROM stories""")
def image_search_queries(spark, d):
    return A.stories(spark, d).select("story_id", X.headline_query(F.col("headline")).alias("query"))


def _images(spark, d) -> DataFrame:
    """Three images a story, in an order of their own."""
    return A.stories(spark, d).select("story_id", F.posexplode(F.array(*map(F.lit, "abc"))).alias("at", "k")).select("story_id", (2 - F.col("at")).alias("ordinal"), F.concat(F.lit("https://i.example.com/"), F.col("story_id").cast("string"), "k").alias("source_url"), F.col("k").alias("caption"))


_IMAGES = """, im AS (SELECT story_id, 2 - pos AS ordinal, 'https://i.example.com/' || story_id || k AS source_url, k AS caption FROM stories, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(pos, k))
"""


@query(_IMAGES + "SELECT story_id, list(source_url ORDER BY ordinal) AS urls FROM im GROUP BY 1")
def story_images_by_ordinal(spark, d):
    listed = _images(spark, d).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_url"))).alias("x"))
    return listed.select("story_id", F.col("x.source_url").alias("urls"))


@query(_IMAGES + "SELECT story_id, headline, list(caption ORDER BY ordinal) AS captions FROM im JOIN stories USING (story_id) WHERE editor_approved GROUP BY 1, 2")
def images_with_story(spark, d):
    both = _images(spark, d).join(A.stories(spark, d).where("editor_approved").select("story_id", "headline"), "story_id")
    listed = both.groupBy("story_id", "headline").agg(F.array_sort(F.collect_list(F.struct("ordinal", "caption"))).alias("x"))
    return listed.select("story_id", "headline", F.col("x.caption").alias("captions"))


@query(_IMAGES + """, k AS (SELECT story_id, source_url, ordinal, row_number() OVER (PARTITION BY story_id ORDER BY ordinal) - 1 AS n FROM im WHERE caption <> 'c')
SELECT story_id, source_url, ordinal, n FROM k WHERE ordinal <> n""")
def moved_ordinals(spark, d):
    left = _images(spark, d).where("caption <> 'c'").withColumn("old", F.col("ordinal"))
    return tables.repack_ordinals(left, "story_id", "ordinal", "source_url").where("old <> ordinal").select("story_id", "source_url", F.col("old").alias("ordinal"), F.col("ordinal").cast("long").alias("n"))


@query(_IMAGES + "SELECT story_id, ordinal, source_url FROM im WHERE NOT EXISTS (SELECT 1 FROM stories s WHERE s.story_id = im.story_id AND editor_approved) UNION ALL SELECT story_id, 0, 'https://new.example.com/' || story_id FROM stories WHERE editor_approved")
def replace_images(spark, d):
    live = A.stories(spark, d).where("editor_approved")
    fresh = live.select("story_id", F.lit(0).alias("ordinal"), F.concat(F.lit("https://new.example.com/"), F.col("story_id").cast("string")).alias("source_url"))
    return tables.replace_children(_images(spark, d).select("story_id", "ordinal", "source_url"), fresh, "story_id", live)


@query("SELECT story_id, headline, editor_approved, (SELECT count(*) FROM claims c WHERE c.story_id = s.story_id) AS claims FROM stories s ORDER BY importance_score DESC NULLS LAST, story_id LIMIT 15")
def stories_listing(spark, d):
    top = A.stories(spark, d).orderBy(F.desc_nulls_last("importance_score"), "story_id").limit(15)
    n = A.claims(spark, d).groupBy("story_id").agg(F.count("*").alias("claims"))
    return top.join(n, "story_id", "left").select("story_id", "headline", "editor_approved", F.coalesce("claims", F.lit(0)).alias("claims"))


@query("SELECT story_id, length(body) AS size FROM (SELECT story_id, repeat('x', CAST(story_id % 400 AS INTEGER)) AS body, editor_approved FROM stories) WHERE editor_approved AND length(body) > 200")
def coherence_scan(spark, d):
    s = A.stories(spark, d).withColumn("body", F.repeat(F.lit("x"), (F.col("story_id") % 400).cast("int")))
    return s.where(F.col("editor_approved") & (F.length("body") > 200)).select("story_id", F.length("body").cast("long").alias("size"))


@query("SELECT e.event_id, e.last_seen_at, s.headline FROM events e LEFT JOIN stories s USING (event_id) WHERE event_id = 2")
def point_lookup(spark, d):
    return A.events(spark, d).where("event_id = 2").select("event_id", "last_seen_at").join(A.stories(spark, d).select("event_id", "headline"), "event_id", "left")


@query("SELECT event_id, CAST(floor(date_diff('microsecond', first_seen_at, TIMESTAMP '2024-01-01 06:30:00') / 3.6e9) AS BIGINT) AS hours, first_seen_at > TIMESTAMP '2024-01-01 06:30:00' AS future FROM events")
def event_age_hours(spark, d):
    now = F.lit("2024-01-01 06:30:00").cast("timestamp")
    return A.events(spark, d).select("event_id", F.floor(X.hours_between(now, F.col("first_seen_at"))).alias("hours"), (F.col("first_seen_at") > now).alias("future"))


@query("SELECT id, source_name FROM raw_items WHERE source_name LIKE 'src1%' AND source_name <> ALL (['src1', 'src12']) AND id NOT IN (SELECT claim_id FROM claims WHERE verified)")
def like_and_not_in(spark, d):
    x = A.raw_items(spark, d).where(F.col("source_name").like("src1%") & ~F.col("source_name").isin("src1", "src12"))
    return x.join(A.claims(spark, d).where("verified"), F.col("claim_id") == F.col("id"), "left_anti").select("id", "source_name")


@query("""WITH o AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM g GROUP BY user_id, s""")  # fmt: skip
def chained_sessions(spark, d):
    """Events of a user that follow one another within ten minutes."""
    return sessions(A.table(spark, d, "events"), "user_id", "ts", "10 minutes")


@query("""SELECT count(*) FILTER (fresh) AS inserted, count(*) FILTER (NOT fresh) AS skipped FROM (SELECT row_number() OVER (PARTITION BY source_name, source_url ORDER BY id) = 1 AND NOT EXISTS (SELECT 1 FROM raw_items r WHERE r.source_name = b.source_name AND r.source_url = b.source_url) AS fresh
  FROM (SELECT source_name, CASE WHEN id % 3 = 0 THEN source_url ELSE 'https://new.example.com/' || id // 2 END AS source_url, id FROM raw_items) b)""")  # fmt: skip
def insert_counts(spark, d):
    """How many rows of a batch are new, and how many are there already or stand twice in it."""
    old = A.raw_items(spark, d)
    url = F.when(F.col("id") % 3 == 0, F.col("source_url")).otherwise(F.concat(F.lit("https://new.example.com/"), F.expr("id DIV 2").cast("string")))
    batch = old.select("source_name", url.alias("source_url"), "id")
    new = tables.insert_if_absent(old, batch, ["source_name", "source_url"], [F.col("id")]).agg(F.count("*").alias("inserted"))
    return new.crossJoin(batch.agg(F.count("*").alias("all"))).select("inserted", (F.col("all") - F.col("inserted")).alias("skipped"))  # one row each


@query(""", cl AS (SELECT event_id, raw_item_id AS k FROM event_items)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS idx, 'Claim ' || k AS claim_text, [CAST(k AS VARCHAR)] AS source_ids FROM cl WHERE k % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k) <= 14""")  # fmt: skip
def drafts_from_answers(spark, d):
    """Answers with a claim per item; every third one cites an unknown id. Some are fenced, some are cut off at the end."""
    n = F.col("raw_item_id")
    source = F.when(n % 3 == 0, F.lit("unknown")).otherwise(n.cast("string"))
    one = F.to_json(F.struct(F.concat(F.lit("Claim "), n.cast("string")).alias("text"), F.array(source, source, F.lit("none")).alias("source_ids")))
    per = A.event_items(spark, d).groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw_item_id", one.alias("o")))), lambda x: x["o"]), ", ").alias("list"))
    k = F.col("event_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit('{"claims": ['), "list", F.lit("]}"))).when(k == 1, F.concat(F.lit("<think>so</think> Sure:\n```json\n["), "list", F.lit("]\n```")))
        .when(k == 2, F.concat(F.lit('{"claims": ['), "list", F.lit(', {"text": "Cut'))).otherwise(F.concat(F.lit("["), "list", F.lit("]")))
    )
    ship_package(spark)
    return C.drafts(per.select("event_id", answer.alias("answer")), A.event_items(spark, d).select("event_id", F.col("raw_item_id").alias("id"))).withColumn("idx", F.col("idx").cast("long"))


@query("""SELECT count(*) AS candidates, count(*) - count(*) FILTER (status = 'rejected') AS built, count(*) FILTER (status = 'rejected') AS failed FROM events""")
def batch_counts(spark, d):
    """Counts of a batch of which the rejected events fail."""
    from quillmark.plans.story_queries import WORDS, _docs, _events

    e = _events(spark, d)
    counts = newsroom.build_batch(e, _docs(spark, d), e.where("status = 'rejected'").select("event_id", F.lit("down").alias("reason")), words=WORDS)[2]
    return counts.select("candidates", "built", "failed")
