"""Building, auditing and publishing stories on fixtures."""

from pyspark.sql import functions as F

from quillmark.operators import audit, models, prose
from quillmark.plans import newsroom
from quillmark.sources.threads import thread_text

DOC = "event_id long, id string, source_name string, source_tier int, source_url string, title string, text string"
LONG = "The council voted on the plan for the new line in the north of the city. "


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def events(spark, n=1):
    rows = [(k, f"Title {k}", None, 10.0 - k, True, "candidate") for k in range(n)]
    return spark.createDataFrame(rows, "event_id long, title string, summary string, importance_score double, tier_1_anchor boolean, status string")


def test_report_and_debate(spark):
    d = docs(spark, [(0, "a", "pib", 1, "u1", "t", LONG), (0, "b", "ap", 2, None, None, None), (1, "c", "x", 3, "u3", "t", "A protest was held by many people in the old town today.")])
    out = {r.event_id: r for r in newsroom.build_stories(events(spark, 3), d, ("protest",)).collect()}
    assert set(out) == {0, 1}
    assert out[0].mode == "report" and out[0].body_markdown == f"Title 0\n\n{LONG.strip()[:-1]} (pib)."
    assert "## What we know\n- " + LONG.strip() + " — [pib](u1)\n" in out[0].audited_markdown and out[0].audited_markdown.endswith("- [ap]() — tier 2\n")
    assert out[0].editor_notes == "mode=report; approved on 1 sourced claim(s) (1 cross-source verified)"
    assert out[1].mode == "debate" and out[1].dek == "Contested: 1 outlet(s), no primary source." and "treat with caution" in out[1].body_markdown
    assert "presented as debate on 1 sourced point(s)" in out[1].editor_notes


def test_no_claims_are_rejected(spark):
    [r] = newsroom.build_stories(events(spark), docs(spark, [(0, "a", "pib", 1, "u", None, "short")]), ("zzz",)).collect()
    assert not r.editor_approved and "_No claims cleared verification._" in r.body_markdown and r.dek == "Title 0"
    assert not newsroom.build_stories(events(spark), docs(spark, []), ("zzz",)).collect()


def test_verdicts_take_back_verification(spark):
    c = spark.createDataFrame([(1, i, f"c{i}", ["a"], 1, False, True, "") for i in range(3)], "event_id long, idx int, claim_text string, source_ids array<string>, n_sources long, tier_1_backed boolean, verified boolean, note string")

    def after(raw):
        v = spark.createDataFrame([(1, raw)], "event_id long, raw string")
        v = v.select("event_id", audit.verdict_indexes(F.col("raw"), "contradicted").alias("contradicted"), audit.verdict_indexes(F.col("raw"), "unsupported").alias("unsupported"))
        return [r.verified for r in audit.demote(c, v).orderBy("idx").collect()]

    assert after("[1]") == [True, False, True]
    assert after('{"contradicted": ["2", "x"], "unsupported": [0, 1, 9]}') == [False, True, False]
    assert after('{"contradicted": [1, 2], "unsupported": [0]}') == [True, False, False]
    assert after("no json") == [True] * 3 == after(None)


def test_topup_promotes_until_target(spark):
    n = 12
    rows = [(k, f"d{k}", f"s{k}", 1, "u", "t", " ".join(f"word{k}{j}" for j in range(9)) + " ends here now." if k % 2 else "short") for k in range(n)]
    out = newsroom.publish(events(spark, n), docs(spark, rows), top=2, target=4, words=("zzz",)).collect()
    assert sum(r.editor_approved for r in out) >= 4 and len({r.event_id for r in out}) == len(out)


def test_responses_name_the_gap(spark):
    e = events(spark).withColumn("last_seen_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    items = spark.createDataFrame(
        [("a", "x", 2, "u", "t", "c", "2026-01-01 00:00:00", [1.0, 0.0]), ("b", "pib", 1, "u", "Answer", "c", "2026-01-01 05:30:00", [0.9, 0.1]), ("c", "pib", 1, "u", "Old", "c", "2025-12-01 00:00:00", [1.0, 0.0]), ("d", "pib", 1, "u", "Far", "c", "2026-01-01 05:00:00", [0.0, 1.0])],
        "id string, source_name string, source_tier int, source_url string, title string, content string, at string, embedding array<double>",
    ).withColumn("fetched_at", F.to_timestamp("at"))
    got = newsroom.responses(e, docs(spark, [(0, "a", "x", 2, "u", "t", "c")]), items, F.lit("2026-01-01 12:00:00").cast("timestamp")).collect()
    assert [(r.id, r.source_name, r.title) for r in got] == [("b", "pib-response", "[response +5h from main event] Answer")]


def test_time_context_and_digest(spark):
    stamp = lambda s: F.lit(s).cast("timestamp")
    one = spark.range(1).select(prose.time_context(stamp("2026-07-30 10:00:00"), stamp(None), stamp("2026-07-29 23:00:00")).alias("a"), prose.time_context(stamp("2026-07-30 10:00:00"), stamp(None), stamp(None)).alias("b")).first()
    assert one.a == "TIME CONTEXT\nTODAY IS Thursday, 30 July 2026.\nThis event was first reported: Wednesday, 29 July 2026 (yesterday)."
    assert "unknown" in one.b
    [r] = prose.source_digest(docs(spark, [(0, "b", "ap", 2, "u", "T", "x" * 1000), (0, "a", "pib", 1, "u", None, None)])).collect()
    assert r.digest == "[SOURCE id=a name=pib tier=primary]\n\n\n\n[SOURCE id=b name=ap tier=wire]\nT\n" + "x" * 900 + " ..."


def test_thread_pages():
    comment = '<div class="thing comment"><a class="author">{a}</a><span class="score unvoted" title="{s}">{s} points</span><div class="usertext-body"><p>{t}</p></div><div class="child"><div class="thing comment"><div class="usertext-body">nested</div></div></div></div>'
    page = '<title>Post : sub</title><div class="thing link"><a class="title" href="https://x.org/a">Post</a><div class="expando"><div class="usertext-body"><p>Self <b>text</b></p></div></div></div><div class="sitetable nestedlisting">'
    page += comment.format(a="ann", s="5", t="first<br>line") + comment.format(a="b", s="1", t="[deleted]") + comment.format(a="c", s="2", t="y" * 900) + "</div>"
    assert thread_text(page, "https://z") == "Post\n\nSelf text\n\nLinked URL: https://x.org/a\n\nTop comments:\n[u/ann | 5] first line\n\n[u/c | 2] " + "y" * 800 + "..."
    assert thread_text(None) == thread_text("") == ""


class Echo:
    name = "echo"

    def complete(self, system, prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]


def test_backends(spark):
    from pyspark import cloudpickle
    import sys

    from quillmark.runtime import ship_package

    ship_package(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = spark.createDataFrame([("good",), ("bad",)], "p string").repartition(2, "p")
    for p in ("good", "bad"):
        [r] = models.answered(rows.where(F.col("p") == p).coalesce(1), F.col("p"), Echo(), pause=lambda k: 0).collect()
        assert (r.answer, r.error) == (("GOOD", None) if p == "good" else (None, "ValueError: no"))
    assert models.answered(rows, F.col("p"), None).where("answer is not null or error is not null").count() == 0
    assert models.route({"default": Echo()}, "judge").name == "echo" and models.route({}, "judge") is None


def test_page_text_keeps_blocks_outside_chrome():
    from quillmark.sources.feeds import page_text

    page = "<nav><p>menu</p></nav><h1>Head</h1><p>One <b>two</b>\n three &amp; four</p><script>x()</script><footer><p>foot</p></footer><p></p>"
    assert page_text(page) == "Head\n\nOne two three & four"
    assert page_text(None) == page_text("") == ""


def test_duplicates_and_repairs_of_empty_tables(spark):
    s = spark.createDataFrame([], "story_id long, headline string, dek string, editor_approved boolean, editor_notes string")
    assert audit.reject_duplicates(s, spark.createDataFrame([], "dropped long, kept long")).count() == 0
    checks = "story_id long, coherent boolean, reason string, error string, new_headline string, new_dek string, rewrite_error string, coherent_again boolean, reason_again string, error_again string"
    assert audit.repair(s, spark.createDataFrame([], checks)).count() == 0
