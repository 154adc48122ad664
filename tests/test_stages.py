"""Stages, editions, the store and its commands on small fixtures."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quillmark import commands, config
from quillmark.functions import text as X
from quillmark.operators import claims, cluster, editions, embeddings, rank, stories
from quillmark.plans import newsroom, stages
from quillmark.sources import catalogue
from quillmark.store import Store

NOW = "2026-01-03 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def at(hours):
    return datetime.datetime(2026, 1, 3, 12) - datetime.timedelta(hours=hours)


@pytest.mark.parametrize("hours", [None, 5.0])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, hours):
    import random

    monkeypatch.setattr(cluster, "PER_PIVOT", 10)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(3 * (i % 4 == k), 1) for k in range(4)], at(rng.random() * 40)) for i in range(120)]
    rows += [(500, [0.0] * 4, at(1)), (501, None, at(1)), (502, [], at(1)), (503, rows[0][1], rows[0][2]), (504, [1.0, 2.0], at(1)), (505, [2.0, 4.0], at(2))]
    df = spark.createDataFrame(rows, "id long, v array<double>, ts timestamp")
    for least in (0.3, 0.95):
        expected = {}
        for i, a, s in rows:
            for j, b, t in rows:
                if i < j and a and b and len(a) == len(b) and (hours is None or abs((s - t).total_seconds()) <= hours * 3600):
                    n = [math.sqrt(sum(x * x for x in v)) or 1.0 for v in (a, b)]
                    sim = round(sum(x * y for x, y in zip(a, b, strict=True)) / n[0] / n[1], 6)
                    if sim >= least:
                        expected[(i, j)] = sim
        got = cluster.similar_pairs(df, "id", "v", least, *(("ts", hours) if hours else ())).collect()
        assert len(got) == len(expected) and all(abs(expected[(r.id_i, r.id_j)] - r.similarity) < 2e-6 for r in got)
    assert cluster.similar_pairs(df.limit(0), "id", "v", 0.5).count() == 0


def test_band_pairs_equal_brute_force(spark):
    rows = [(i, at((i * 7919) % 100 / 3)) for i in range(60)] + [(100, at(3)), (101, at(3))]
    got = cluster.band_pairs(spark.createDataFrame(rows, "id long, ts timestamp"), "id", "ts", 2.0).collect()
    expected = sorted((i, j) for i, s in rows for j, t in rows if i < j and abs((s - t).total_seconds()) <= 7200)
    assert sorted((r.id_i, r.id_j) for r in got) == expected


def test_nearest_without_own_items(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "event_id long, centroid array<double>")
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.2]), ("c", [1.0, 0.4]), ("d", [-1.0, 0.0])], "id string, embedding array<double>")
    own = spark.createDataFrame([(1, "a")], "event_id long, id string")
    got = cluster.nearest(q, items, "event_id", 0.35, 1, but=own).collect()
    assert [(r.event_id, r.id, r.rank) for r in got] == [(1, "b", 1)]


def test_events_chain_beyond_the_window(spark):
    """Links hold within 48 hours, inclusive; chains of them may be longer."""
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "a", 3, "t1", "c1", at(200), v), (2, "a", 2, "", "c2", at(152), v), (3, "b", 1, None, "c3", at(110), v), (4, "b", 1, "t4", "c4", at(20), v), (5, "b", 3, "t5", "", at(20), w), (6, "c", 3, "t6", "c6", at(20), None)]
    items = spark.createDataFrame([(i, s, n, "u", t, c, p, at(0), e) for i, s, n, t, c, p, e in rows], "id long, source_name string, source_tier int, source_url string, title string, content string, published_at timestamp, fetched_at timestamp, embedding array<double>")
    none = spark.createDataFrame([], "event_id long, raw_item_id long")
    events, bridge = stages.cluster_stage(items, none, config.Settings())
    got = {r.event_id: r for r in events.collect()}
    assert sorted(map(tuple, bridge.collect())) == [(1, 1), (1, 2), (1, 3), (4, 4), (5, 5)] and set(got) == {1, 4, 5}
    assert (got[1].title, got[1].summary, got[1].first_seen_at, got[1].last_seen_at, got[1].tier_1_anchor) == ("c3", "c3", at(200), at(110), True)
    assert (got[5].title, got[5].summary, got[5].tier_1_anchor, got[5].status) == ("t5", None, False, "candidate")
    later = stages.unclustered(items, bridge, ["b", "c"])
    assert later.count() == 0


def test_embedding_backends(spark):
    items = spark.createDataFrame([(1, "s", "one", "two three", None), (2, "s", None, "", None), (3, "t", "x", "y", [9.0])], "id long, source_name string, title string, content string, embedding array<float>").withColumn("fetched_at", now())
    got = {r.id: r.embedding for r in stages.embed(items, config.Settings(embedding_backend="local")).collect()}
    assert len(got[1]) == 1024 and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and set(got[2]) == {0.0} and got[3] == [9.0]
    settings = config.load({"EMBEDDING_KEY": "k", "SELECT_TOP_N": "7", "CLUSTER_SIMILARITY": "0.5"})
    assert settings.select_top_n == 7 and settings.cluster_similarity == 0.5 and settings.has_embedding_key() and not config.is_real_key("sk-...")
    remote = stages.embed(items, settings, ask=lambda texts: [[float(len(t))] for t in texts], sources=["s"])
    assert {r.id: r.embedding for r in remote.collect()} == {1: [14.0], 2: [0.0], 3: [9.0]}
    assert embeddings.get_backend(config.Settings()).name == "local"
    with pytest.raises(ValueError):
        embeddings.get_backend(config.Settings(embedding_backend="other"))


def test_hashed_backend_tries_again(spark):
    def ask(texts, state=[0]):  # noqa: B006
        state[0] += 1
        if state[0] % 2:
            raise OSError("down")
        return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)
    assert embeddings.RemoteModel(ask, batch=1, tries=2, pause=0).embed(rows).count() == 2


def test_fetch_stage(spark):
    urls = ["https://a.example.com/x", "https://www.ft.com/x", "https://wrap.example.com/1", "https://b.example.com/none", "https://b.example.com/empty", "https://www.reddit.com/r/x/1"]
    items = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(urls)] + [(9, urls[0], "old", None)], "id long, source_url string, full_content string, full_content_fetched_at timestamp")
    bridge = items.select(F.lit(1).alias("event_id"), F.col("id").alias("raw_item_id"))
    events = spark.createDataFrame([(1, "selected")], "event_id int, status string")
    pages = spark.createDataFrame([(urls[0], "<p>Body a</p>"), (urls[1], "<p>secret</p>"), ("https://c.example.com/real", "<p>Body c</p>"), (urls[4], "<nav>x</nav>"), (urls[5], "<html></html>")], "url string, html string")
    redirects = spark.createDataFrame([(urls[2], "https://c.example.com/real")], "url string, target string")
    out, counts = stages.fetch_stage(items, bridge, events, pages, now(), redirects)
    assert {r.id: r.full_content for r in out.collect()} == {0: "Body a", 1: "", 2: "Body c", 3: "", 4: "", 5: "", 9: "old"}
    assert counts.head().asDict() == {"pending": 6, "scraped": 2, "empty": 1, "failed": 2, "paywalled": 1}
    assert stages.pending_fetch(out, bridge, events).count() == 0 and stages.pending_fetch(out, bridge, events, force=True).count() == 7


def test_image_stage(spark):
    big = '<img src="/{0}.jpg" width="900" height="600" alt="{0}">'
    pages = spark.createDataFrame([
        ("https://s.example.com/1", "<meta property='og:image' content='/logo.png'><meta name='twitter:image' content='https://i.example.com/lead.jpg'><meta property='og:description' content='Told'>" + big.format("a") + '<img src="/a.jpg?w=2" width="950">' + big.format("b") + big.format("c") + '<img srcset="/small.jpg 300w, /large.jpg 1200w">'),
        ("https://f.example.com/2", big.format("f1") + big.format("f2") + big.format("f3")), ("https://www.ft.com/3", big.format("paid")),
    ], "url string, html string")
    live = spark.createDataFrame([(1, "One"), (2, "Two of a kind"), (3, "None")], "story_id long, headline string")
    sources = spark.createDataFrame([(1, "the_hindu", "https://s.example.com/1"), (2, "ap_india", "https://s.example.com/none")], "story_id long, source_name string, source_url string")
    searched = spark.createDataFrame([("Two kind", 1, "https://www.ft.com/3"), ("Two kind", 2, "https://f.example.com/2"), ("One", 1, "https://f.example.com/2")], "query string, rank int, url string")
    rows, counts = stages.image_stage(live, sources, pages, searched, date="2026-01-03")
    got = {(r.story_id, r.ordinal): r for r in rows.collect()}
    assert counts.head().asDict() == {"stories": 3, "with_images": 2, "primary_hits": 1, "fallback_hits": 1}
    assert [(k, got[k].source_url, got[k].caption, got[k].credit) for k in sorted(got)] == [
        ((1, 0), "https://i.example.com/lead.jpg", "Told", "The Hindu"), ((1, 1), "https://s.example.com/a.jpg", "a", "The Hindu"), ((1, 2), "https://s.example.com/b.jpg", "b", "The Hindu"),
        ((2, 0), "https://f.example.com/f1.jpg", "f1", "F"), ((2, 1), "https://f.example.com/f2.jpg", "f2", "F"),
    ]
    fetched = spark.createDataFrame([("https://f.example.com/f1.jpg", "image/jpeg", bytearray(b"x")), ("https://f.example.com/f2.jpg", "text/html", bytearray(b"x"))], "url string, content_type string, content binary")
    paths = {r.source_url: r.local_path for r in stages.download_images(rows, fetched).collect()}
    assert paths["https://f.example.com/f1.jpg"].startswith("images/2026-01-03/2-0-") and paths["https://f.example.com/f2.jpg"] is None


def test_images_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "u", "images/d/1.jpg")], "story_id long, ordinal int, source_url string, target_path string")
    fetched = spark.createDataFrame([("u", "image/png", bytearray(b"abc"))], "url string, content_type string, content binary")
    assert stages.write_images(rows, fetched, str(tmp_path)) == 1
    assert (tmp_path / "images/d/1.jpg").read_bytes() == b"abc"


def test_junk_urls(spark):
    urls = ["", None, "data:image/png;x", "https://a.com/Logo.png", "https://a.com/silicon.jpg", "https://pbs.twimg.com/x.jpg", "https://a.com/blank.jpg", "https://a.com/x/ads/1.jpg"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(stories.is_junk_url(F.col("u"))).collect()]
    assert got == [True, True, True, True, False, True, False, True]


def test_research(spark):
    turns = spark.createDataFrame([(1, 'So.  RESEARCH: "water\n levels" '), (2, "no research: here"), (3, "RESEARCH: x")], "event_id long, turn string")
    long = "<p>" + "word " * 60 + "</p>"
    results = spark.createDataFrame([("water\n levels".replace("\n ", " "), k, f"https://e.example.com/{k}", None) for k in range(1, 8)], "query string, rank int, url string, title string")
    pages = spark.createDataFrame([(f"https://e.example.com/{k}", long if k != 2 else "<p>short</p>") for k in range(1, 8)], "url string, html string")
    got = stages.research(turns, results, pages).orderBy("source_url").collect()
    assert [(r.event_id, r.source_url[-1], r.source_tier, r.title, r.source_name) for r in got] == [(1, k, 2, "water levels", "research:water levels") for k in "134"]
    said = spark.createDataFrame([("A.  RESEARCH: foo bar",), ("plain ",)], "t string").select(X.strip_research(F.col("t"))).collect()
    assert [r[0] for r in said] == ["A.", "plain "]


def test_drafts(spark):
    from quillmark.runtime import ship_package

    ship_package(spark)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "event_id long, id string")
    answers = [
        (1, '<think>{"claims": []}</think>```json\n{"claims": [{"text": " One ", "source_ids": ["b", "a", "b", "x"]}, {"text": "", "source_ids": ["a"]}, {"text": "Subscribe now", "source_ids": ["a"]}, 7, {"text": "No source"}]}\n```'),
        (2, '[{"text": "Two", "source_item_ids": ["c"]}, {"text": "Thr'), (3, "no json"), (4, None),
    ]
    got = claims.drafts(spark.createDataFrame(answers, "event_id long, answer string"), docs).orderBy("event_id").collect()
    assert [(r.event_id, r.idx, r.claim_text, r.source_ids) for r in got] == [(1, 0, "One", ["b", "a"]), (2, 0, "Two", ["c"])]
    many = '{"claims": [' + ", ".join('{"text": "Claim %d", "source_ids": ["a"]}' % k for k in range(20)) + "]}"
    assert claims.drafts(spark.createDataFrame([(1, many)], "event_id long, answer string"), docs).count() == 14


def test_editors_cut_and_batch(spark):
    text = " ".join(f"Sentence number {k} tells of something that happened today." for k in range(4))
    docs = spark.createDataFrame([(1, "a", "x", 2, "u", "t", text), (2, "b", "y", 2, "u", "t", text)], "event_id long, id string, source_name string, source_tier int, source_url string, title string, text string")
    events = spark.createDataFrame([(1, "E1", "S", 1.0), (2, "E2", None, 2.0), (3, "E3", None, 3.0), (4, "E4", None, 4.0)], "event_id long, title string, summary string, importance_score double")
    cuts = spark.createDataFrame([(1, [0], [1, 2])], "event_id long, contradicted array<int>, unsupported array<int>")
    out, checked, counts = newsroom.build_batch(events, docs, spark.createDataFrame([(4, "down"), (9, "other")], "event_id long, reason string"), cuts=cuts)
    got = {r.event_id: r for r in out.collect()}
    assert "cut 2 unsupported/unsourced claim(s)" in got[1].editor_notes and got[2].n_claims == 3 and got[1].n_claims == 1
    assert got[4].editor_notes == "crew failed: down" and not got[4].editor_approved
    assert counts.head().asDict() == {"candidates": 4, "built": 2, "approved": 2, "rejected": 0, "debates": 0, "skipped": 1, "failed": 1}


def test_duplicates_by_verdict(spark):
    rows = [(1, "Dam opens its gates after rain", "Water levels rise in the valley", 5.0, True, None), (2, "Dam opens its gates after rain", "Water levels rise in the valleys", 7.0, True, None), (3, "Other words entirely", "Nothing shared", 1.0, True, None)]
    s = spark.createDataFrame(rows, "event_id long, headline string, dek string, importance_score double, editor_approved boolean, editor_notes string")
    kept = lambda **how: {r.event_id for r in newsroom.drop_duplicates(s, **how).where("editor_approved").collect()}
    verdict = lambda same: spark.createDataFrame([(2, 1, same)], "i long, j long, same boolean")
    assert kept() == {1, 2, 3} and kept(verdicts=verdict(True)) == {2, 3} and kept(verdicts=verdict(False)) == {1, 2, 3}


def test_edition(spark):
    trace = '{"mode": "report", "n_sources": 3, "verifier": {"verified": 1}, "context": "Known so far."}'
    s = spark.createDataFrame([(1, 11, "Low", "Dek.", None, trace, 1.0, True), (2, 12, "Top: one", None, "Body text.", "not json", 9.0, True), (3, 13, "Argued", "", None, '{"mode": "debate", "perspective": "A. B."}', None, True)],
                              "story_id long, event_id long, headline string, dek string, body_markdown string, agent_trace string, importance_score double, editor_approved boolean").withColumn("created_at", now())
    told = spark.createDataFrame([(1, 1, "Second.", False, ["pib"]), (1, 0, "First.", True, ["the_hindu", "ap_india"]), (1, 2, "Subscribe now", False, []), (3, 0, "Point.", False, [])], "story_id long, ordinal int, claim_text string, tier_1_backed boolean, outlets array<string>")
    images = spark.createDataFrame([(1, 1, "u2", None, None, "AP", None), (1, 0, "u1", "images/1.jpg", "Cap [x]", "The Hindu", "http://a")], "story_id long, ordinal int, source_url string, local_path string, caption string, credit string, article_url string")
    signals = spark.createDataFrame([(11, "reddit_news", 2), (11, "reddit_cities", 1), (11, "google_news_india", 5), (12, "reddit_news", 1)], "event_id long, source_name string, n long")
    text = "\n".join(r.text for r in editions.edition(editions.story_lines(s, told, images, signals), now()).orderBy("line_no").collect())
    head, *parts = text.split("\n---\n")
    assert head.startswith("# Daily Edition\n\n*Autonomous, fact-checked newsletter · Saturday, 03 January 2026 · 3 stories*")
    assert "1. [Top: one](#1-top-one) — _report_\n2. [Low](#2-low) — _report_\n3. [Argued](#3-argued) — _debate_" in head
    assert "### Report\n\nBody text.\n" in parts[0] and "1 Reddit post in" in parts[0] and "> REPORT  ·  0 claim(s) kept" in parts[0]
    low = parts[1]
    assert "## 2. Low\n\n*Dek.*\n\n![Cap  x ](images/1.jpg)\n\n<sub>*Cap [x] — Photo via [The Hindu](http://a)*</sub>\n\n> REPORT  ·  3 sources  ·  2 claim(s) kept  ·  1 verified\n" in low
    assert "### Context\n\nKnown so far.\n\n### What we know\n\n- First. — *The Hindu, AP India* _(primary-source backed)_\n- Second. — *PIB*\n" in low
    assert "![Low](u2)\n\n<sub>*Photo via AP*</sub>" in low and "**Sources:** AP India, PIB, The Hindu" in low and "3 Reddit posts in this event's cluster (r/cities, r/news)" in low
    assert "### The debate\n\nA. B.\n\n### Sourced points\n\n- Point. — *unattributed*" in parts[2] and "**Sources" not in parts[2]
    empty = [r.text for r in editions.edition(editions.story_lines(s.limit(0), told), now()).orderBy("line_no").collect()]
    assert empty[2].endswith("0 stories*") and empty[-1] == editions.NO_STORIES


def test_keywords_of_an_event_are_those_of_its_items(spark):
    rows = [(1, "a", 1, "Cabinet clears bill", "policy", at(1)), (1, "b", 3, "x", "india FIR 1", at(2)), (2, "c", 2, None, None, at(3))]
    items = spark.createDataFrame([(e, i, s, n, t, c, p) for i, (e, s, n, t, c, p) in enumerate(rows)], "event_id long, id int, source_name string, source_tier int, title string, content string, ts timestamp")
    got = {r.event_id: r for r in rank.event_features(items, now()).collect()}
    assert got[1].policy_matched == ["bill", "cabinet", "policy"] and got[1].ground_matched == ["fir "] and got[1].region_hits == 1 and got[2].policy_hits == 0


def test_catalogue(spark):
    rows = {r.source_name: r for r in catalogue.catalogue(spark).collect()}
    assert len(rows) == 12 and rows["pib"].feed_url.startswith("https://news.google.com/rss/search?q=site%3Apib.gov.in+when%3A1d&hl=en-IN")
    assert rows["prs_india"].feed_url.count("when%3A7d") == 1 and rows["reddit_news"].feed_url.endswith(".rss")
    assert catalogue.catalogue(spark, tier=3).count() == 4
    with pytest.raises(ValueError):
        catalogue.catalogue(spark, rows=catalogue.SOURCES * 2)


def feed(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{u}</link><description>{d}</description><pubDate>{p}</pubDate></item>" for t, u, d, p in items) + "</channel></rss>"


def test_commands(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"))
    address = {r.source_name: r.feed_url for r in catalogue.catalogue(spark).collect()}
    day = "Sat, 03 Jan 2026 09:00:00 GMT"
    body = "The high court of india ordered an inquiry into the clash near the river today."
    story = lambda n: ("River clash inquiry ordered by court", f"https://{n}.example.com/a", body, day)
    feeds = spark.createDataFrame([
        (address["rbi"], feed(("Repo rate policy stays", "https://rbi.example.com/1", "The policy rate in india stays where it was, the bank said in a notification.", day))),
        (address["the_hindu"], feed(story("hindu"), story("hindu"))), (address["ap_india"], feed(story("ap"))), ("https://unknown", feed(story("x"))),
    ], "feed_url string, xml string")
    assert commands.ingest(store, feeds, now()) == (3, 1) and commands.ingest(store, feeds, now(), tier=2) == (0, 3)
    with pytest.raises(ValueError):
        commands.ingest(store, feeds, now(), source="nobody")
    assert commands.status(store)["total"].head().items == 3
    said = commands.pipeline(store, config.Settings(embedding_backend="local"), now())
    assert (said["events"], said["selected"]) == (2, 2)
    assert [(r.items, r.sources, r.status) for r in commands.events(store, status="selected").collect()] == [(2, 2, "selected"), (1, 1, "selected")]
    assert commands.recent(store, source="rbi").count() == 1 and commands.cluster(store, config.Settings()) == 0
    pages = spark.createDataFrame([("https://ap.example.com/a", f"<p>{body} {body}</p>")], "url string, html string")
    assert commands.scrape(store, pages, now()) == {"pending": 3, "scraped": 1, "empty": 0, "failed": 2, "paywalled": 0}
    assert commands.build(store, now(), words=("clash",))["built"] == 2 and commands.build(store, now())["candidates"] == 0
    top = commands.list_stories(store).collect()
    assert len(top) == 2 and all(r.claims >= 1 for r in top)
    event = commands.events(store).head().event_id
    assert commands.show(store, event).head().headline and commands.build(store, now(), force=True, event_id=event)["built"] == 1
    assert store["claims"].count() == store["claims"].select("claim_id").distinct().count() and store["stories"].count() == 2
    checks = spark.createDataFrame([(event, False, "off", None, "", "", None, None, None, None)], "story_id long, coherent boolean, reason string, error string, new_headline string, new_dek string, rewrite_error string, coherent_again boolean, reason_again string, error_again string")
    commands.coherence(store, checks)
    assert commands.enrich(store, pages)["stories"] >= 1
    path = commands.write_edition(store, now(), str(tmp_path / "out"), "2026-01-03")
    (tmp_path / "site").mkdir()
    assert commands.edition_date(path) == "2026-01-03" and commands.copy_edition(spark, path, str(tmp_path / "out/images"), str(tmp_path / "site")) == [str(tmp_path / "site/edition-2026-01-03.md")]
    assert commands.copy_edition(spark, path, "x", str(tmp_path / "nowhere")) == []
    assert commands.publish(store, config.Settings(embedding_backend="local", min_final_stories=9), now(), feeds)["inserted"] == 3
    from quillmark.__main__ import main

    main(["--store", str(tmp_path / "store"), "--now", NOW, "events"], spark)
    main(["--store", str(tmp_path / "store"), "--now", NOW, "edition", "--print"], spark)
    assert "# Daily Edition" in capsys.readouterr().out


def test_feeds_in_any_store(spark, tmp_path):
    (tmp_path / "a.xml").write_text(feed(("T", "https://x/1", "D", "")))
    paths = spark.createDataFrame([("feed:a", str(tmp_path / "a.xml"))], "feed_url string, path string")
    assert [r.feed_url for r in catalogue.read_feeds(spark, paths).collect()] == ["feed:a"]


def test_local_vectors_equal_hashed_terms(spark):
    import hashlib
    import re
    from collections import Counter

    from quillmark.functions.lexicons import STOP_WORDS

    texts = ["", None, "a", "The cat, and the CAT-food é3 x y2", "ÄÖ straße 日本 ½ _x", "q" * 60 + " " + "z" * 54 + " " + "y" * 55 + " " + "ab" * 12, " ".join(f"w{i % 97}" for i in range(3000))]
    rows = [(i, "s" if i % 2 else "t", t, i, None) for i, t in enumerate(texts)] + [(99, "s", "cat", 99, [1.0])]
    items = spark.createDataFrame(rows, "id long, source_name string, content string, fetched_at long, embedding array<float>")
    for dim in (1024, 1000):
        new = embeddings.embed_stage(items, embeddings.HashedTerms(dim), F.col("content"), limit=None)
        got = {r.id: r.embedding for r in new.collect()}
        assert got.pop(99) == [1.0] and "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
        for i, t in enumerate(texts):
            w = [x for x in re.findall(r"\w{2,}", (t or "").lower()) if x not in STOP_WORDS]
            n = Counter(int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % dim for g in [*w, *map(" ".join, zip(w, w[1:], strict=False))])
            length = sum(x * x for x in n.values()) ** 0.5
            assert len(got[i]) == dim and all(abs(got[i][k] - (n[k] / length if n[k] else 0.0)) < 1e-7 for k in range(dim)), i
    some = {r.id: r.embedding for r in embeddings.embed_stage(items, embeddings.HashedTerms(), F.col("content"), ["s"], limit=None).collect()}
    assert [i for i in range(7) if some[i] is None] == [0, 2, 4, 6] and some[3] == {r.id: r.embedding for r in embeddings.embed_stage(items, embeddings.HashedTerms(), F.col("content")).collect()}[3]
