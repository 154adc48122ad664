"""Claims: extraction, corroboration, capped cuts, and the mode of a story."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions.lexicons import CONTROVERSY

PER_DOC, PER_EVENT = 3, 14


def local_claims(docs: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, ordinal, claim_text, source_id): docs (key, id, source_tier, text) in order of (tier, id as text); of each the
    first sentences of 40 to 320 characters that are no chrome and not picked yet, three a doc and 14 an event.

    What is picked depends on what was, so an event's candidate sentences (already filtered) are folded in order."""
    found = docs.select(key, "source_tier", F.col("id").cast("string").alias("source_id"), F.posexplode(X.sentences(F.trim("text"))).alias("at", "s"))
    found = found.where(F.length("s").between(40, 320) & ~X.is_boilerplate(F.col("s")))
    # a sentence counts where it stands first; of those a doc can use no more than three and those that others have picked
    found = found.groupBy(key, "source_tier", "source_id", F.lower("s").alias("low")).agg(F.min("at").alias("at"), F.min_by("s", "at").alias("s"))
    first = Window.partitionBy(key, "source_tier", "source_id").orderBy("at")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= PER_DOC + PER_EVENT).drop("low")
    empty = F.array().cast("array<struct<s:string,id:string>>")

    def pick(state: Column, x: Column) -> Column:
        of_doc = F.size(F.filter(state, lambda y: y["id"] == x["source_id"]))
        seen = F.exists(state, lambda y: F.lower(y["s"]) == F.lower(x["s"]))
        ok = (of_doc < PER_DOC) & (F.size(state) < PER_EVENT) & ~seen
        return F.when(ok, F.concat(state, F.array(F.struct(x["s"].alias("s"), x["source_id"].alias("id"))))).otherwise(state)

    ordered = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_tier", "source_id", "at", "s"))).alias("all"))
    picked = ordered.select(key, F.posexplode(F.aggregate("all", empty, pick)).alias("ordinal", "c"))
    return picked.select(key, "ordinal", F.col("c.s").alias("claim_text"), F.col("c.id").alias("source_id"))


def verify_floor(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims (claim_id), sources (claim_id, source_name, source_tier) of known ids only: verified when one is primary or
    two outlets differ."""
    agg = sources.groupBy("claim_id").agg(F.countDistinct("source_name").alias("n_sources"), F.bool_or(F.col("source_tier") == 1).alias("primary"), F.bool_and(F.col("source_tier") == 3).alias("signal"))
    j = claims.join(agg, "claim_id", "left")
    n, p = F.coalesce("n_sources", F.lit(0)), F.coalesce("primary", F.lit(False))
    note = F.when(n == 0, "no valid source").when(p | (n >= 2), "").when(F.col("signal"), "single unverified social/signal source").otherwise("single-source, no primary anchor")
    return j.select("claim_id", n.alias("n_sources"), p.alias("tier_1_backed"), (p | (n >= 2)).alias("verified"), note.alias("note"))


def soft_cut(claims: DataFrame, fraction: float = 0.5) -> DataFrame:
    """claims (story_id, idx, verified, tier_1_backed, contradicted, unsupported): contradicted ones go; of the
    unsupported, not primary-backed ones at most floor(n * fraction), unverified first, then by index; stories of one
    claim are spared; where all verified ones would go, the first one that is not contradicted stays."""
    story = Window.partitionBy("story_id")
    soft = F.col("unsupported") & ~F.col("contradicted") & ~F.col("tier_1_backed")
    ranked = claims.withColumn("n", F.count("*").over(story)).withColumn("soft", soft & (F.col("n") >= 2))
    rank = F.row_number().over(Window.partitionBy("story_id", "soft").orderBy("verified", "idx"))
    cut = F.col("contradicted") | (F.col("soft") & (F.col("r") <= F.floor(F.col("n") * fraction)))
    marked = ranked.withColumn("r", rank).withColumn("cut", cut)
    left = F.count_if(F.col("verified") & ~F.col("cut")).over(story)
    first = F.min(F.when(F.col("verified") & ~F.col("contradicted"), F.col("idx"))).over(story)
    restored = marked.withColumn("back", (left == 0) & (F.col("idx") == first))
    return restored.select("story_id", "idx", (F.col("cut") & ~F.coalesce("back", F.lit(False))).alias("cut"))


def mode(text: Column, words: tuple[str, ...] = CONTROVERSY) -> Column:
    return F.when(F.size(X.keyword_hits(text, words)) < 1, "report").otherwise("debate")


def first_json(text: str | None, only_first: bool = False) -> str | None:
    """The first complete JSON object or array in noisy text, or null; strings and escapes are respected. With only_first,
    null if what begins first is not complete.

    A value is tried only where a bracket could begin one: after it comes a quote, a bracket, a digit or a literal."""
    import json
    import re

    decoder = json.JSONDecoder()
    raw = text or ""
    for found in re.finditer(r"\{(?=\s*[\"}])|\[(?=\s*[\"\[\]{\-0-9tfnNI])", raw):
        try:
            value, _ = decoder.raw_decode(raw, found.start())
        except ValueError:
            if only_first:
                return None
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def salvaged_objects(text: str | None) -> list[str]:
    """Complete JSON objects that have a `text`, as cut-off answers hold them."""
    import json

    decoder, out, at, raw = json.JSONDecoder(), [], 0, text or ""
    while (at := raw.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(raw, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict) and value.get("text"):
            out.append(json.dumps(value, ensure_ascii=False, sort_keys=True))
            at = end
        else:
            at += 1
    return out


def extract_json(text: Column, only_first: bool = False) -> Column:
    """first_json of a text. JSON that reads as it stands stays inside Spark; only noisy text goes to Python."""
    plain = F.try_parse_json(text)
    whole = F.when(plain.isNotNull() & F.trim(text).rlike(r"(?s)^[\[{]"), F.to_json(plain))
    noisy = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else first_json(t, only_first)), "string", F.PandasUDFType.SCALAR)(F.when(whole.isNull(), text))
    return F.coalesce(whole, noisy)


def salvage_json(text: Column) -> Column:
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(salvaged_objects)

    return F.pandas_udf(each, "array<string>", F.PandasUDFType.SCALAR_ITER)(text)


def drafts(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(event_id, idx, claim_text, source_ids) of model answers (event_id, answer): the objects under `claims` or of a bare
    list, of an answer that was cut off the complete ones. Ids (`source_ids` or `source_item_ids`) must be those of the
    event's docs, each once, in order; claims without one, without text, or of page chrome go; the first PER_EVENT stay."""
    json = extract_json(X.strip_reasoning(F.col("answer")), only_first=True)
    v = F.try_parse_json(F.col("json"))
    item = "array<variant>"
    read = answers.select("event_id", "answer", json.alias("json")).withColumn("v", v)
    listed = F.coalesce(F.try_variant_get("v", "$.claims", item), F.try_variant_get("v", "$", item))
    cut = F.transform(salvage_json(F.when(F.col("listed").isNull(), F.col("answer"))), lambda t: F.try_parse_json(t))
    read = read.withColumn("listed", listed).withColumn("items", F.coalesce("listed", cut, F.array().cast(item)))
    rows = read.select("event_id", F.posexplode("items").alias("at", "x"))
    ids = F.coalesce(F.try_variant_get("x", "$.source_ids", "array<string>"), F.try_variant_get("x", "$.source_item_ids", "array<string>"), F.array().cast("array<string>"))
    rows = rows.select("event_id", "at", F.trim(F.try_variant_get("x", "$.text", "string")).alias("claim_text"), ids.alias("ids"))
    rows = rows.where((F.col("claim_text") != "") & ~X.is_boilerplate(F.col("claim_text")))
    known = docs.select("event_id", F.col("id").cast("string").alias("id")).distinct()
    cited = rows.select("event_id", "at", "claim_text", F.posexplode("ids").alias("k", "id")).join(known, ["event_id", "id"])
    whole = cited.groupBy("event_id", "at", "claim_text").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda y: y["id"])).alias("source_ids"))
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("at")) - 1
    return whole.withColumn("idx", n).where(F.col("idx") < PER_EVENT).select("event_id", "idx", "claim_text", "source_ids")
