"""Feeds and pages as sources: RSS text parsed by Spark's own XML reader, pages by a vectorised HTML parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmark.functions import text as X

ITEM = (
    "struct<title:string,link:string,guid:string,description:string,`content:encoded`:array<string>,pubDate:string,`dc:date`:string,author:string,category:array<string>>"
)
ENTRY = (
    "struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,content:array<string>,summary:string,published:string,updated:string,created:string,"
    "author:struct<name:string>,category:array<struct<_term:string>>>"
)
FEED = f"struct<channel:struct<title:string,item:array<{ITEM}>>,entry:array<{ENTRY}>>"


def _item(e: Column) -> Column:
    """An RSS item in the form of all entries."""
    return F.struct(
        e["title"].alias("title"), e["link"].alias("link"), e["guid"].alias("id"), e["content:encoded"].alias("full"), e["description"].alias("teaser"),
        F.array(e["pubDate"], e["dc:date"], F.lit(None).cast("string")).alias("dates"), e["author"].alias("author"), e["category"].alias("tags"),
    )


def _entry(e: Column) -> Column:
    """An Atom entry in the form of all entries; its link is the first alternate one."""
    link = F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    return F.struct(
        e["title"].alias("title"), link.alias("link"), e["id"].alias("id"), e["content"].alias("full"), e["summary"].alias("teaser"),
        F.array(e["published"], e["updated"], e["created"]).alias("dates"), e["author"]["name"].alias("author"), F.transform(e["category"], lambda c: c["_term"]).alias("tags"),
    )


def parse_rss(feeds: DataFrame, max_entries: int = 100) -> DataFrame:
    """feeds (source_name, source_tier, feed_url, xml) of RSS or Atom to raw items: the first entries, those with a link;
    content is the full one, else the summary, else the title; entries without any are left out."""
    read = feeds.select("source_name", "source_tier", "feed_url", F.explode(F.array(F.from_xml("xml", FEED))).alias("feed"))
    both = F.coalesce(F.transform("feed.channel.item", _item), F.transform("feed.entry", _entry))
    entries = read.select("source_name", "source_tier", "feed_url", F.posexplode(F.slice(both, 1, max_entries)).alias("at", "e"))
    title = F.trim(F.coalesce(F.col("e.title"), F.lit("")))
    full = html_to_text(F.array_join(F.col("e.full"), "\n\n"))
    body = html_to_text(F.coalesce(F.col("e.teaser"), F.lit("")))
    content = F.coalesce(X.blank_to_null(full), X.blank_to_null(body), X.blank_to_null(title))
    raw = F.to_json(F.struct("feed_url", F.col("e.id").alias("entry_id"), F.col("e.author").alias("author"), F.coalesce(F.filter("e.tags", lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("tags")))
    published = F.coalesce(*(X.feed_time(F.col("e.dates")[k]) for k in range(3)))
    out = entries.select("source_name", "source_tier", F.trim("e.link").alias("source_url"), title.alias("title"), content.alias("content"), published.alias("published_at"), raw.alias("raw_data"))
    return out.where("source_url is not null and source_url != '' and content is not null")


def html_to_text(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return X.squeeze(plain)


class _Body(HTMLParser):
    """Text of paragraphs and headings outside navigation, asides, footers and scripts."""

    SKIP = {"script", "style", "nav", "footer", "aside", "header", "form", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip, self.block = 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in ("p", "h1", "h2", "h3", "li", "blockquote"):
            self.block = True
            self.parts.append("")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        self.block = self.block and tag not in ("p", "h1", "h2", "h3", "li", "blockquote", "article", "body")

    def handle_data(self, data):
        if self.block and not self.skip:
            self.parts[-1] += data


def page_text(html: str | None) -> str:
    p = _Body()
    p.feed(html or "")
    return "\n\n".join(t for t in (" ".join(x.split()) for x in p.parts) if t)


def extract_body(html: Column) -> Column:
    return F.pandas_udf(lambda pages: pages.map(page_text), "string", F.PandasUDFType.SCALAR)(html)


class _Images(HTMLParser):
    META = ("og:image", "og:image:secure_url", "twitter:image")
    TOLD = ("og:description", "twitter:description")

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.lead, self.told, self.images, self.figure, self.caption = base, {}, {}, [], 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("property") or a.get("name")) in self.META and a.get("content"):
            self.lead.setdefault(a.get("property") or a.get("name"), urljoin(self.base, a["content"].strip()))
        elif tag == "meta" and (a.get("property") or a.get("name")) in self.TOLD and a.get("content"):
            self.told.setdefault(a.get("property") or a.get("name"), a["content"].strip()[:300])
        elif tag == "figure":
            self.figure = len(self.images)
        elif tag == "figcaption":
            self.caption = ""
        elif tag == "img":
            src = a.get("src") or a.get("data-src") or a.get("data-original") or a.get("data-lazy-src") or ""
            self.images.append({"src": src, "srcset": a.get("srcset") or a.get("data-srcset"), "width": a.get("width"), "height": a.get("height"), "caption": a.get("alt") or a.get("title") or ""})

    def handle_endtag(self, tag):
        if tag == "figcaption" and self.caption is not None:
            for image in self.images[self.figure :]:
                image["caption"] = " ".join(self.caption.split()) or image["caption"]
            self.caption = None

    def handle_data(self, data):
        if self.caption is not None:
            self.caption += data


def largest(srcset: str | None) -> str | None:
    """The URL of the largest width; the first one of equals."""
    rated = []
    for at, part in enumerate((srcset or "").split(",")):
        words = part.split()
        if words:
            width = words[1][:-1] if len(words) > 1 and words[1].endswith("w") else ""
            rated.append((-int(width) if width.isdecimal() else 0, at, words[0]))
    return min(rated)[2] if rated else None


CANDIDATES = "page_id long, at int, is_lead boolean, url string, width string, height string, caption string"


def image_candidates(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to image candidates in page order: page_id, at, url, width, height, caption, score; the
    page's lead image first with score 100. Junk and small images are left out."""
    from quillmark.operators.stories import image_score, is_junk_url, large_enough

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                p = _Images(url or "")
                p.feed(html or "")
                leads = [p.lead[m] for m in _Images.META if m in p.lead]
                told = next((p.told[m] for m in _Images.TOLD if m in p.told), "")
                # all of them, as the first one may be junk; what the page says of itself is the caption
                rows += [(page, k - len(leads), True, lead, None, None, told or next((i["caption"] for i in p.images if i["caption"] and urljoin(url or "", i["src"]) == lead), "")) for k, lead in enumerate(leads)]
                for k, i in enumerate(p.images):
                    src = largest(i["srcset"]) or i["src"].strip()
                    rows.append((page, k, False, urljoin(url or "", src) if src else "", i["width"], i["height"], i["caption"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(scan, CANDIDATES)
    w, h = X.dimension(F.col("width")), X.dimension(F.col("height"))
    caption = F.substring("caption", 1, 300)
    out = found.select("page_id", "at", "is_lead", F.col("url"), w.alias("width"), h.alias("height"), caption.alias("caption"))
    out = out.where(~is_junk_url(F.col("url")) & large_enough(F.col("width"), F.col("height")))
    lead = out.where("is_lead").groupBy("page_id").agg(F.min_by("url", "at").alias("lead"), F.min("at").alias("lead_at"))
    rest = out.join(lead, "page_id", "left").where("CASE WHEN is_lead THEN at = lead_at ELSE lead IS NULL OR url != lead END")
    score = F.when(F.col("is_lead"), 100.0).otherwise(image_score(F.col("at"), F.col("width"), F.col("height"), F.col("caption")))
    return rest.select("page_id", "at", "url", "width", "height", "caption", F.round(score, 6).alias("score"))


#: Sources by name; registering a name twice is an error.
_REGISTRY: dict[str, dict] = {}


def register_source(name: str, tier: int, feed_url: str, max_entries: int = 100) -> None:
    if name in _REGISTRY:
        raise ValueError(f"source {name} is registered already")
    if tier not in (1, 2, 3):
        raise ValueError("tier must be 1, 2 or 3")
    _REGISTRY[name] = {"name": name, "tier": tier, "feed_url": feed_url, "max_entries": max_entries}


def get_source(name: str) -> dict:
    return _REGISTRY[name]


def all_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(s.values()) for s in _REGISTRY.values()], "name string, tier int, feed_url string, max_entries int")


class FeedFiles(DataSource):
    """`spark.read.format("feed_files").option("paths", "a.xml,b.xml")`: one row (path, xml) per feed file, one partition
    each; a file that can't be read gives no row."""

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return "path string, xml string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options.get("paths", "").split(","))


class _FeedReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = [p for p in paths if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        try:
            with open(partition.value, encoding="utf-8", errors="replace") as f:
                yield (partition.value, f.read())
        except OSError:
            return
