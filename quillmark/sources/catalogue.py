"""The catalogue of sources: official ones (tier 1), wires (2) and signals (3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.sources import feeds

SEARCH = "https://news.google.com/rss/search"
#: Entries of a search feed at most, where a source names no other number; fixed value.
SEARCH_ENTRIES = 50
# Name, tier, kind, query or feed address, window of a search, entries.
SOURCES = (
    ("pib", 1, "search", "site:pib.gov.in", "1d", SEARCH_ENTRIES),
    ("supreme_court", 1, "search", 'site:sci.gov.in OR "supreme court of india"', "1d", SEARCH_ENTRIES),
    ("rbi", 1, "search", "site:rbi.org.in", "1d", SEARCH_ENTRIES),
    ("prs_india", 1, "search", "site:prsindia.org", "7d", SEARCH_ENTRIES),
    ("reuters_india", 2, "search", "site:reuters.com India", "1d", SEARCH_ENTRIES),
    ("ap_india", 2, "search", "site:apnews.com India", "1d", SEARCH_ENTRIES),
    ("the_hindu", 2, "search", "site:thehindu.com", "1d", SEARCH_ENTRIES),
    ("indian_express", 2, "search", "site:indianexpress.com", "1d", SEARCH_ENTRIES),
    ("reddit_news", 3, "feed", "https://old.reddit.com/r/india+indianews+IndiaSpeaks/.rss", None, 30),
    ("reddit_cities", 3, "feed", "https://old.reddit.com/r/mumbai+delhi+bangalore+chennai+kolkata+kerala+hyderabad/.rss", None, 30),
    ("reddit_topical", 3, "feed", "https://old.reddit.com/r/IndianEconomy+IndianAcademia+IndianDefence+geopolitics/.rss", None, 30),
    ("google_news_india", 3, "search", "India", "1d", 100),
)
SCHEMA = "source_name string, source_tier int, kind string, address string, window string, max_entries int"


def feed_address(kind: Column, address: Column, window: Column) -> Column:
    """Where a source's feed is: its address, or that of a search for it."""
    searches = [F.when(window == w, X.query_url(SEARCH, address, w)) for w in ("1d", "7d")]
    return F.when(kind == "feed", address).otherwise(F.coalesce(*searches, X.query_url(SEARCH, address, "")))


def catalogue(spark: SparkSession, rows=SOURCES, tier: int | None = None, name: str | None = None) -> DataFrame:
    """Sources with their feed_url, of one tier or name if given; a name that stands twice is an error."""
    names = [r[0] for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("a source is registered twice")
    out = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    out = out.withColumn("feed_url", feed_address(F.col("kind"), F.col("address"), F.col("window")))
    if tier is not None:
        out = out.where(F.col("source_tier") == tier)
    return out if name is None else out.where(F.col("source_name") == name)


def scan(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Raw items of sources (catalogue) from fetched feeds (feed_url, xml): of each its first max_entries entries. Sources
    whose feed was not fetched, or does not read, give none."""
    known = sources.join(fetched.select("feed_url", "xml"), "feed_url")
    counts = [r[0] for r in sources.select("max_entries").distinct().collect()]  # few numbers of the catalogue
    parts = [feeds.parse_rss(known.where(F.col("max_entries") == n), n) for n in counts]
    out = parts[0] if parts else feeds.parse_rss(known, 1)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_feeds(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(feed_url, xml) of feed files in any store that Spark reads; paths (feed_url, path)."""
    listed = [r[0] for r in paths.select("path").distinct().collect()]  # one per source
    if not listed:
        return spark.createDataFrame([], "feed_url string, xml string")
    files = spark.read.option("wholetext", True).text(listed).select(F.col("value").alias("xml"), F.regexp_replace(F.input_file_name(), "^[a-z0-9]+:/*", "/").alias("file"))
    return files.join(paths.withColumn("file", F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^/*", "/")), "file").select("feed_url", "xml")
