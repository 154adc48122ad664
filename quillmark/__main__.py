"""`python -m quillmark --store FOLDER COMMAND ...`: the engine's commands; tables are shown, counts printed as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmark import commands
from quillmark.config import load
from quillmark.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmark")
    p.add_argument("--store", default="./store", help="folder of the tables")
    p.add_argument("--now", help="the clock, as a time stamp; the real one if left out")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [sub.choices[name].add_argument(*o[0], **o[1]) for o in options] if sub.add_parser(name) else None
    flag = lambda n: ((n,), {"action": "store_true"})
    num = lambda n, d=None: ((n,), {"type": int, "default": d})
    txt = lambda n, **k: ((n,), k)
    add("sources")
    add("ingest", txt("--feeds", required=True, help="Parquet or JSON of feed_url, xml"), txt("--source"), ((("--tier"),), {"type": int, "choices": (1, 2, 3)}))
    add("status")
    add("embed", num("--limit", 1_000_000), num("--batch-size", 128))
    add("cluster", ((("--similarity"),), {"type": float}), ((("--window-hours"),), {"type": float}))
    add("rank", num("--top"))
    add("scrape", txt("--pages", required=True), txt("--redirects"), flag("--force"))
    add("pipeline", num("--top"), flag("--skip-scrape"), txt("--pages"))
    add("events", num("--limit", 15), txt("--status"))
    add("recent", num("--limit", 10), txt("--source"))
    add("build", flag("--force"), num("--limit"), num("--event-id"))
    add("list", num("--limit", 15), flag("--approved"), flag("--all"))
    add("show", (("event_id",), {"type": int}))
    add("edition", flag("--all"), txt("--out"), txt("--date"), flag("--print"))
    add("enrich", txt("--pages", required=True), txt("--searches"), txt("--redirects"), txt("--images"), txt("--verdicts"), txt("--date", default=""), txt("--root"))
    add("coherence", txt("--checks", required=True))
    add("publish", txt("--feeds"), txt("--pages"), flag("--skip-wipe"), num("--limit"), txt("--out"), txt("--date"), txt("--site"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    import dataclasses

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, settings = Store(spark, a.store), load()
    now = F.lit(a.now).cast("timestamp") if a.now else F.current_timestamp()

    def table(path: str | None):
        if path is None:
            return None
        return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)

    show = lambda df: df.show(1000, truncate=80)
    say = lambda x: print(json.dumps(x))
    match a.command:
        case "sources":
            show(commands.sources(spark))
        case "ingest":
            inserted, skipped = commands.ingest(store, table(a.feeds), now, a.source, a.tier)
            say({"inserted": inserted, "skipped": skipped})
        case "status":
            for df in commands.status(store).values():
                show(df)
        case "embed":
            commands.embed(store, settings, a.limit)
        case "cluster":
            changed = {k: v for k, v in (("cluster_similarity", a.similarity), ("cluster_window_hours", a.window_hours)) if v is not None}
            say({"events": commands.cluster(store, dataclasses.replace(settings, **changed))})
        case "rank":
            say(commands.rank_events(store, dataclasses.replace(settings, select_top_n=a.top) if a.top else settings, now))
        case "scrape":
            say(commands.scrape(store, table(a.pages), now, table(a.redirects), a.force))
        case "pipeline":
            say(commands.pipeline(store, settings, now, None if a.skip_scrape else table(a.pages), a.top))
        case "events":
            show(commands.events(store, a.limit, a.status))
        case "recent":
            show(commands.recent(store, a.limit, a.source))
        case "build":
            say(commands.build(store, now, a.force, a.limit, a.event_id))
        case "list":
            show(commands.list_stories(store, a.limit, a.approved and not a.all))
        case "show":
            for r in commands.show(store, a.event_id).collect():
                print(r.body_markdown)
        case "edition":
            if a.out:
                say({"edition": commands.write_edition(store, now, a.out, a.date or str(spark.range(1).select(now.cast("date")).head()[0]), not a.all)})
            if a.print or not a.out:
                print("\n".join(r.text for r in commands.edition(store, now, not a.all).orderBy("line_no").collect()))
        case "enrich":
            say(commands.enrich(store, table(a.pages), table(a.searches), table(a.redirects), table(a.images), table(a.verdicts), a.date, a.root))
        case "coherence":
            show(commands.coherence(store, table(a.checks)))
        case "publish":
            said = commands.publish(store, settings, now, table(a.feeds), table(a.pages), not a.skip_wipe, a.limit)
            if a.out:
                said["edition"] = commands.write_edition(store, now, a.out, a.date or str(spark.range(1).select(now.cast("date")).head()[0]))
                if a.site:
                    said["copied"] = commands.copy_edition(spark, said["edition"], f"{a.out}/images", a.site)
            say(said)


if __name__ == "__main__":
    main()
