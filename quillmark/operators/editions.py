"""The rendered edition: contents, stories with badges, images, claims, sources and public discussion.

Relations: stories (story_id, event_id, headline, dek, body_markdown, agent_trace, importance_score, created_at,
editor_approved), claims (story_id, ordinal, claim_text, tier_1_backed, outlets), images (story_id, ordinal, source_url,
local_path, caption, credit, article_url), signals (event_id, source_name, n). Each story's lines are one expression;
only an edition's stories, never their sources, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X

# Wordings of an edition.
SUBTITLE = "*Autonomous, fact-checked newsletter · %s · %d stor%s*"
NO_STORIES = "_No stories yet — build some first._"
NO_CLAIMS = "- _No claims cleared the editor._"
FOOTER = (
    "*Every claim above was extracted from source material, verified against its citations, and audited for hallucination. "
    "Items marked DEBATE are stories where the sources themselves show opposition, criticism or contest — presented as an actual "
    "back-and-forth debate, with each side arguing only from what the sources support.*"
)
DISCUSSION = "*Public discussion: %d Reddit %s in this event's cluster (%s) — surfaced as signal, not cited as fact.*"
SOCIAL = "reddit"


def claim_outlets(claims: DataFrame, claim_sources: DataFrame, items: DataFrame) -> DataFrame:
    """claims with `outlets`, the sorted distinct source names that each one cites; empty without sources."""
    named = claim_sources.join(items.select(F.col("id").alias("raw_item_id"), "source_name"), "raw_item_id")
    found = named.groupBy("claim_id").agg(F.sort_array(F.collect_set("source_name")).alias("outlets"))
    return claims.join(found, "claim_id", "left").withColumn("outlets", F.coalesce("outlets", F.array().cast("array<string>")))


def social_posts(event_items: DataFrame, items: DataFrame) -> DataFrame:
    """(event_id, source_name, n) of the signal items in each event."""
    return event_items.join(items.where("source_tier = 3").select(F.col("id").alias("raw_item_id"), "source_name"), "raw_item_id").groupBy("event_id", "source_name").agg(F.count("*").alias("n"))


def discussions(signals: DataFrame) -> DataFrame:
    """(event_id, posts, discussion): the sum of posts on social sources, and the line that tells of it."""
    rows = signals.where(F.col("source_name").startswith(SOCIAL))
    per = rows.groupBy("event_id").agg(F.sum("n").alias("posts"), F.array_sort(F.collect_set("source_name")).alias("names"))
    subs = F.array_join(F.transform("names", lambda s: F.concat(F.lit("r/"), F.regexp_replace(s, "^reddit_", ""))), ", ")
    return per.select("event_id", "posts", F.format_string(DISCUSSION, F.col("posts"), F.when(F.col("posts") == 1, "post").otherwise("posts"), subs).alias("discussion"))


def _lines(*parts: Column | str) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _if(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast("array<string>"))


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _image(x: Column, headline: Column) -> Column:
    """An image and, if anything is known of it, its caption and credit."""
    caption, credit, article = (_text(x[c]) for c in ("caption", "credit", "article_url"))
    alt = F.regexp_replace(F.coalesce(X.blank_to_null(x["caption"]), headline, F.lit("")), r"[\[\]]", " ")
    via = F.when((credit != "") & (article != ""), F.concat(F.lit("Photo via ["), credit, F.lit("]("), article, F.lit(")"))).when(credit != "", F.concat(F.lit("Photo via "), credit))
    bits = F.concat_ws(" — ", X.blank_to_null(caption), via)
    shown = _lines(F.concat(F.lit("!["), alt, F.lit("]("), F.coalesce(X.blank_to_null(x["local_path"]), x["source_url"]), F.lit(")")), "")
    return F.concat(shown, _if(bits != "", _lines(F.concat(F.lit("<sub>*"), bits, F.lit("*</sub>")), "")))


def _claim(c: Column) -> Column:
    outlets = F.array_join(F.transform(c["outlets"], X.humanise), ", ")
    return F.concat(F.lit("- "), F.trim(c["claim_text"]), F.lit(" — *"), F.coalesce(X.blank_to_null(outlets), F.lit("unattributed")), F.lit("*"), F.when(c["tier_1_backed"], " _(primary-source backed)_").otherwise(""))


def story_lines(stories: DataFrame, claims: DataFrame, images: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """(n, story_id, headline, mode, lines, outlets): the approved or otherwise given stories in order of importance
    (nulls last, newer ones first, then by id), each with its markdown lines."""
    order = Window.orderBy(F.desc_nulls_last("importance_score"), F.desc("created_at"), "story_id")  # an edition's stories
    v = F.try_parse_json(F.col("agent_trace"))
    read = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    s = stories.withColumn("v", v).select(
        F.row_number().over(order).alias("n"), "story_id", "event_id", "headline", "dek", "body_markdown", F.coalesce(read("$.mode", "string"), F.lit("report")).alias("mode"),
        read("$.n_sources", "int").alias("n_sources"), read("$.verifier.verified", "int").alias("n_verified"), X.strip_boilerplate(_text(read("$.context", "string"))).alias("context"),
        X.strip_boilerplate(_text(read("$.perspective", "string"))).alias("perspective"), X.strip_boilerplate(_text(F.col("body_markdown"))).alias("body"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "claim_text", "tier_1_backed", "outlets")))
    per = claims.groupBy("story_id").agg(ordered.alias("all_claims"))
    kinds = claims.schema["claim_text"], claims.schema["ordinal"]
    empty_claims = F.array().cast(f"array<struct<ordinal:{kinds[1].dataType.simpleString()},claim_text:string,tier_1_backed:boolean,outlets:array<string>>>")
    x = s.join(per, "story_id", "left").withColumn("all_claims", F.coalesce("all_claims", empty_claims))
    x = x.withColumn("claims", F.filter("all_claims", lambda c: ~X.is_boilerplate(F.coalesce(c["claim_text"], F.lit("")))))
    x = x.withColumn("outlets", F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("all_claims", lambda c: c["outlets"])), X.humanise))))
    kept = "array<struct<ordinal:int,source_url:string,local_path:string,caption:string,credit:string,article_url:string>>"
    if images is None:
        x = x.withColumn("images", F.array().cast(kept))
    else:
        shown = images.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("int").alias("ordinal"), "source_url", "local_path", "caption", "credit", "article_url"))).cast(kept).alias("images"))
        x = x.join(shown, "story_id", "left").withColumn("images", F.coalesce("images", F.array().cast(kept)))
    x = x.join(discussions(signals), "event_id", "left") if signals is not None else x.withColumn("discussion", F.lit(None).cast("string"))

    debate, headline = F.col("mode") == "debate", F.col("headline")
    badges = F.concat_ws(
        "  ·  ", F.upper("mode"), F.when(F.col("n_sources") > 0, F.format_string("%d sources", "n_sources")), F.format_string("%d claim(s) kept", F.size("claims")),
        F.when(~debate & F.col("n_verified").isNotNull(), F.format_string("%d verified", "n_verified")),
    )
    listed = F.when(F.size("claims") > 0, F.transform("claims", _claim)).otherwise(_lines(NO_CLAIMS))
    context = _if(F.col("context") != "", _lines("### Context", "", F.col("context"), ""))
    as_debate = F.concat(context, _if(F.col("perspective") != "", _lines("### The debate", "", F.col("perspective"), "")), _lines("### Sourced points", ""), listed, _lines(""))
    as_report = F.concat(context, F.when(F.coalesce("body", F.lit("")) != "", _lines("### Report", "", F.col("body"), "")).otherwise(F.concat(_lines("### What we know", ""), listed, _lines(""))))
    further = F.flatten(F.transform(F.slice("images", F.lit(2), F.greatest(F.size("images") - 1, F.lit(0))), lambda i: _image(i, headline)))
    lines = F.concat(
        _lines("", "---", "", F.format_string("## %d. %s", F.col("n"), headline), ""), _if(_text(F.col("dek")) != "", _lines(F.concat(F.lit("*"), _text(F.col("dek")), F.lit("*")), "")),
        _if(F.size("images") > 0, _image(F.get("images", F.lit(0)), headline)), _lines(F.concat(F.lit("> "), badges), ""), F.when(debate, as_debate).otherwise(as_report), further,
        _if(F.size("outlets") > 0, _lines(F.concat(F.lit("**Sources:** "), F.array_join("outlets", ", ")), "")), _if(F.col("discussion").isNotNull(), _lines(F.col("discussion"), "")),
    )
    return x.select("n", "story_id", "headline", "mode", "outlets", lines.alias("lines"))


def edition(told: DataFrame, now: Column, title: str = "Daily Edition") -> DataFrame:
    """(line_no, text): the whole edition from story_lines."""
    spark = told.sparkSession
    count = told.agg(F.count("*").cast("int").alias("stories"))
    subtitle = F.format_string(SUBTITLE, F.date_format(now, "EEEE, dd MMMM yyyy"), F.col("stories"), F.when(F.col("stories") == 1, "y").otherwise("ies"))
    head = F.concat(_lines(f"# {title}", "", subtitle, ""), F.when(F.col("stories") == 0, _lines(NO_STORIES)).otherwise(_lines("## In this edition", "")))
    first = count.select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.posexplode(head).alias("at", "text"))
    anchor = X.slug(F.format_string("%d. %s", "n", "headline"))
    toc = told.select(F.lit(1).alias("part"), "n", F.lit(0).alias("at"), F.format_string("%d. [%s](#%s) — _%s_", F.col("n"), F.col("headline"), anchor, F.col("mode")).alias("text"))
    body = told.select(F.lit(3).alias("part"), "n", F.posexplode("lines").alias("at", "text"))
    some = count.where("stories > 0")
    gap = some.select(F.lit(2).alias("part"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit("").alias("text"))
    last = some.select(F.lit(4).alias("part"), F.lit(0).alias("n"), F.posexplode(_lines("", "---", "", FOOTER)).alias("at", "text"))
    rows = spark.createDataFrame([], "part int, n int, at int, text string")
    for x in (first, toc, gap, body, last):
        rows = rows.unionByName(x)
    return rows.select(F.row_number().over(Window.orderBy("part", "n", "at")).alias("line_no"), "text")


def write_edition(lines: DataFrame, path: str) -> None:
    """One text file of the lines, in order."""
    lines.orderBy("line_no").select(F.coalesce("text", F.lit("")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
