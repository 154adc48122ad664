import pytest
from pyspark.sql import functions as F

from quillmark.functions import lexicons
from quillmark.functions import text as X
from quillmark.functions import vector as V
from quillmark.operators import claims, cluster, rank, stories, tables
from quillmark.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, X.humanise(lit("pib_delhi-desk"))) == "PIB Delhi Desk"
    assert one(spark, X.slug(lit("  Hello, World -- again! "))) == "hello-world-again"
    assert one(spark, X.url_host(lit("HTTPS://WWW.Example.com:80/a?b"))) == "www.example.com"
    assert one(spark, X.normalise_image_url(lit("HTTPS://Cdn.Example.com:80/A/b.jpg/?w=1#x"))) == "https://cdn.example.com:80/A/b.jpg"
    assert one(spark, X.pick_from_srcset(lit("a.jpg 300w, b.jpg 900w, c.jpg 900w"))) == "b.jpg"
    assert one(spark, X.embed_text(lit("T"), lit(""))) == "T"
    assert one(spark, X.event_title(lit(""), lit(None).cast("string"))) == "Untitled event"
    assert one(spark, X.is_boilerplate(lit("A design in blue"))) is True  # no left border, on purpose
    assert one(spark, X.edition_date(lit("out/edition-2024-01-03.md"))) == "2024-01-03"
    assert one(spark, X.append_note(lit(""), lit("b"))) == "b"
    assert one(spark, X.dimension(lit("300px"))) == 300
    assert one(spark, X.feed_time(lit("Mon, 01 Jan 2024 10:00:00 +0530")).cast("string")) == "2024-01-01 04:30:00"
    assert one(spark, X.feed_time(lit("no date"))) is None


def test_strip_boilerplate(spark):
    text = "\n\nFirst line. Subscribe now.\n\n\nSecond.\n(source, 2024)\nAdvertisement"
    assert one(spark, X.strip_boilerplate(F.lit(text))) == "First line.\n\nSecond."
    assert one(spark, X.strip_boilerplate(F.lit(""))) == ""


def test_lexicons():
    assert [len(x) for x in (lexicons.POLICY, lexicons.DOWNWEIGHT, lexicons.GROUND, lexicons.REGION, lexicons.CONTROVERSY)] == [44, 42, 47, 85, 64]


@pytest.mark.parametrize("tier, expected", [(1, 0.879167), (2, 1.379167)])
def test_importance_of_a_lone_item(spark, tier, expected):
    items = spark.sql(f"select 1L event_id, 1L id, 'a' source_name, {tier} source_tier, 'Cabinet clears bill' title, 'policy' content, timestamp'2024-01-01 11:00:00' ts")
    f = rank.event_features(items, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert f.select(rank.importance_score()).head()[0] == expected


def test_clusters_chain_over_the_window(spark):
    rows = [(0, [1.0, 0.0, 0.0], 0), (1, [0.9, 0.44, 0.0], 1), (2, [0.7, 0.71, 0.0], 2), (3, [1.0, 0.0, 0.0], 100), (4, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, h int").withColumn("ts", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("h")))
    pairs = cluster.dense_pairs(df, "id", "v", 0.8, "ts", 48)
    found = {r.id: r.component for r in cluster.components(pairs, df, "id").collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_vector_codec(spark):
    assert one(spark, V.from_text(F.lit("[1.5,2]"))) == [1.5, 2.0]
    assert one(spark, V.to_text(F.array(F.lit(1.5), F.lit(2.0)))) == "[1.5,2.0]"
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_local_claims_pick_what_a_cap_had_skipped(spark):
    s = [f"Sentence number {i} is long enough to be picked by the fold." for i in range(6)]
    docs = spark.createDataFrame([(1, 1, 1, " ".join(s[:5])), (1, 2, 2, " ".join([s[0], s[3], s[5]]))], "event_id long, id long, source_tier int, text string")
    got = [(r.ordinal, r.claim_text, r.source_id) for r in claims.local_claims(docs).orderBy("ordinal").collect()]
    assert got == [(0, s[0], "1"), (1, s[1], "1"), (2, s[2], "1"), (3, s[3], "2"), (4, s[5], "2")]


def test_local_claims_read_on_after_repeated_lines(spark):
    a, b, c = (f"Sentence {x} is long enough to be picked by the fold of claims." for x in "abc")
    docs = spark.createDataFrame([(1, 1, 1, " ".join([a, a.upper()] * 12 + [b, c])), (2, 1, 1, a), (2, 2, 2, " ".join([a] * 20 + [b]))], "event_id long, id long, source_tier int, text string")
    got = sorted((r.event_id, r.ordinal, r.claim_text, r.source_id) for r in claims.local_claims(docs).collect())
    assert got == [(1, 0, a, "1"), (1, 1, b, "1"), (1, 2, c, "1"), (2, 0, a, "1"), (2, 1, b, "2")]


def test_noisy_json():
    assert claims.first_json('x ```json {"a": "}"} ```') == '{"a": "}"}'
    assert claims.first_json("none {") is None
    assert claims.salvaged_objects('{"claims": [{"text": "a"}, {"text": "b", "n": {"k": 1}}, {"text": "c') == ['{"text": "a"}', '{"n": {"k": 1}, "text": "b"}']


def test_greedy_dedup(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.98), (3, 4, 0.97)], "i long, j long, similarity double")
    s = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 1.0), (4, None)], "story_id long, importance_score double")
    assert sorted(map(tuple, stories.greedy_dedup(pairs, s).collect())) == [(2, 1), (4, 3)]


def test_verdicts(spark):
    images = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 1, "b"), (3, 1, 2, "c"), (4, 1, 3, "d")], "image_id long, story_id long, ordinal int, caption string")
    v = spark.createDataFrame([(1, "DROP", None, None), (3, "KEEP", 2, None), (4, "KEEP", 99, "new"), (9, "DROP", None, None)], "image_id long, verdict string, duplicate_of long, caption string")
    assert sorted((r.image_id, r.ordinal, r.caption) for r in tables.apply_verdicts(images, v).collect()) == [(2, 0, "b"), (4, 1, "new")]


def test_rss(spark):
    xml = """<rss><channel><title>t</title><item><title>One</title><link>http://a/1</link><description>&lt;p&gt;Body &amp;amp; more&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><category>x</category></item>
    <item><title>No link</title></item><item><title>Two</title><link>http://a/2</link></item></channel></rss>"""
    df = spark.createDataFrame([("s", 1, "http://a", xml)], "source_name string, source_tier int, feed_url string, xml string")
    got = feeds.parse_rss(df).orderBy("source_url").collect()
    assert [(r.source_url, r.content) for r in got] == [("http://a/1", "Body & more"), ("http://a/2", "Two")]


def test_atom_and_full_content(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title type="html">One</title><id>i1</id><link rel="self" href="http://a/s"/><link rel="alternate" href="http://a/1"/>
    <summary>Teaser</summary><content type="html">&lt;p&gt;Whole body&lt;/p&gt;</content><updated>2024-01-01T10:00:00Z</updated><category term="x"/><author><name>Ann</name></author></entry>
    <entry><title>Two</title><link href="http://a/2"/><summary>Only teaser</summary><published>2024-01-02T10:00:00Z</published></entry></feed>"""
    rss = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>R</title><link>http://r/1</link><description>Short</description><content:encoded><![CDATA[<p>All of it</p>]]></content:encoded></item></channel></rss>"""
    df = spark.createDataFrame([("a", 1, "u", atom), ("r", 1, "u", rss)], "source_name string, source_tier int, feed_url string, xml string")
    got = feeds.parse_rss(df).withColumn("at", F.col("published_at").cast("string")).orderBy("source_url").collect()
    assert [(r.source_url, r.title, r.content, r["at"]) for r in got] == [("http://a/1", "One", "Whole body", "2024-01-01 10:00:00"), ("http://a/2", "Two", "Only teaser", "2024-01-02 10:00:00"), ("http://r/1", "R", "All of it", None)]
    assert got[0].raw_data == '{"feed_url":"u","entry_id":"i1","author":"Ann","tags":["x"]}'


def test_images(spark):
    html = '<meta property="og:image" content="/l.jpg"><img src="/l.jpg" alt="lead"><img src="b.jpg" width="100" height="50"><figure><img data-src="c.jpg" width="900"><figcaption>Cap <b>x</b></figcaption></figure><img src="logo.png">'
    got = feeds.image_candidates(spark.createDataFrame([(1, "http://h/p/", html)], "page_id long, url string, html string")).orderBy("at").collect()
    assert [(r.url, r.caption, r.score) for r in got] == [("http://h/l.jpg", "lead", 100.0), ("http://h/p/c.jpg", "Cap x", 10 - 0.6 + 0.9 + 3 + 0.02 * 5)]


def test_source_registry(spark):
    feeds.register_source("unit", 1, "http://a")
    with pytest.raises(ValueError):
        feeds.register_source("unit", 1, "http://a")
    assert feeds.get_source("unit")["tier"] == 1 and feeds.all_sources(spark).count() == 1


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss/>")
    spark.dataSource.register(feeds.FeedFiles)
    assert spark.read.format("feed_files").option("paths", f"{tmp_path}/a.xml,{tmp_path}/none.xml").load().count() == 1


def test_streams(spark, tmp_path):
    from quillmark.streaming.ingest import ingest_once, read_table_stream, run_once

    df = spark.createDataFrame([("s", "u", 1), ("s", "u", 2), ("s", "v", 3)], "source_name string, source_url string, m int")
    df = df.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("m")))
    df.write.parquet(str(tmp_path / "in"))
    run_once(ingest_once(read_table_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "c"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
