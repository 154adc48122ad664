"""Text, URL and date expressions. Each takes and returns Columns and stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.lexicons import ACRONYMS, BOILERPLATE, HEADLINE_STOP_WORDS, PAYWALLED_HOSTS

BOILERPLATE_PATTERN = "(?i)(" + "|".join(BOILERPLATE) + ")"
SENTENCE_END = r"(?<=[.!?])\s+"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def embed_text(title: Column, content: Column, most: int = 2000) -> Column:
    """Title, blank line, content where both have text, else the one that has; cut to `most` characters."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    return F.substring(F.when((t != "") & (c != ""), F.concat(t, F.lit("\n\n"), c)).when(t != "", t).otherwise(c), 1, most)


def best_text(full: Column, content: Column) -> Column:
    return F.coalesce(blank_to_null(F.trim(full)), F.trim(content), F.lit(""))


def event_title(title: Column, content: Column) -> Column:
    return F.substring(F.trim(F.coalesce(blank_to_null(title), blank_to_null(content), F.lit("Untitled event"))), 1, 280)


def event_summary(content: Column) -> Column:
    return blank_to_null(F.substring(F.trim(content), 1, 500))


def humanise(name: Column) -> Column:
    """Parts between `_` and `-`: acronyms in capitals, others capitalised; a name without parts is itself or unknown."""
    parts = F.filter(F.split(name, "[_-]"), lambda p: p != "")
    nice = F.transform(parts, lambda p: F.when(F.lower(p).isin(*ACRONYMS), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))))
    return F.when(F.size(parts) > 0, F.array_join(nice, " ")).otherwise(F.coalesce(blank_to_null(name), F.lit("unknown")))


def slug(heading: Column) -> Column:
    kept = F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N} _-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "[ _-]+", "-"), "^-+|-+$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def outlet_from_host(host: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"^m\.", "")
    named = F.initcap(F.regexp_replace(F.element_at(F.split(plain, r"\."), 1), "-", " "))
    return F.when(plain.contains("."), named).otherwise(F.coalesce(blank_to_null(plain), F.lit("source")))


def is_paywalled(host: Column) -> Column:
    return F.lower(host).isin(*PAYWALLED_HOSTS)


def is_social_host(host: Column, domain: str = "reddit.com") -> Column:
    return (host == domain) | host.endswith("." + domain)


def normalise_image_url(url: Column) -> Column:
    """Without query and fragment, scheme and host in lower case, no slash at the end."""
    base = F.regexp_replace(url, "[?#].*$", "")
    head = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(base, F.length(head) + 1, F.lit(1 << 20))), "/+$", "")


def url_hash(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 12)


def extension(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"(?i)(\.(jpe?g|png|webp|gif|avif))$", 1))
    return F.coalesce(blank_to_null(found), F.lit(".jpg"))


def query_url(base: str, query: Column, when: str = "1d", lang: str = "en", country: str = "IN") -> Column:
    terms = F.concat(query, F.lit(f" when:{when}")) if when else query
    return F.concat(F.lit(f"{base}?q="), F.url_encode(terms), F.lit(f"&hl={lang}-{country}&gl={country}&ceid="), F.url_encode(F.lit(f"{country}:{lang}")))


def headline_query(headline: Column, most: int = 8) -> Column:
    """The first words of a headline that say something; the headline itself where there are none."""
    words = F.filter(F.regexp_extract_all(headline, F.lit(r"[A-Za-z][A-Za-z0-9'-]{1,}"), 0), lambda w: ~F.lower(w).isin(*HEADLINE_STOP_WORDS))
    return F.coalesce(blank_to_null(F.array_join(F.slice(words, 1, most), " ")), F.trim(headline))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), squeeze), lambda s: s != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_boilerplate(text: Column) -> Column:
    return text.rlike(BOILERPLATE_PATTERN)


def strip_boilerplate(text: Column) -> Column:
    """Drops sentences of page chrome and lines that are citations only; at most one blank line in a row, none first."""
    def clean(line: Column) -> Column:
        kept = F.filter(F.split(line, SENTENCE_END), lambda s: (F.trim(s) != "") & ~is_boilerplate(s))
        return F.array_join(F.transform(kept, lambda s: F.trim(s)), " ")

    blank = F.lit("\u0001")  # a line that was blank, as opposed to one that became empty
    lines = F.transform(F.split(text, "\n"), lambda l: F.when(F.trim(l) == "", blank).otherwise(clean(l)))
    lines = F.filter(lines, lambda l: (l != "") & ~l.rlike(r"^[\s•*–-]*(\([^)]*\)[\s,;]*)*$") | (l == blank))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\u0001(\n\u0001)*", "\u0001")
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(joined, "^(\u0001\n?)+", ""), "\u0001", ""))
    return F.when(text.isNull() | (text == ""), text).otherwise(cleaned)


def strip_reasoning(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think(ing)?>.*?</think(ing)?>", ""))


def research_query(text: Column) -> Column:
    """What follows a RESEARCH: directive (in capitals) to the end, on one line, without quotes and full stops around it;
    null under six characters."""
    found = F.trim(F.regexp_extract(text, r"(?s)\bRESEARCH\s*:\s*(.+)", 1))
    found = F.regexp_replace(F.regexp_replace(found, r"""^["'`]+|["'`]+$""", ""), r"\.+$", "")
    found = squeeze(found)
    return F.when(F.length(found) >= 6, found)


def strip_research(text: Column) -> Column:
    cut = F.regexp_replace(text, r"(?s)\s*\bRESEARCH\s*:.*", "")
    return F.when(text.rlike(r"\bRESEARCH\s*:"), F.regexp_replace(cut, r"\s+$", "")).otherwise(text)


def edition_date(path: Column) -> Column:
    return blank_to_null(F.regexp_extract(path, r"edition-(\d{4}-\d{2}-\d{2})\.md$", 1))


def pick_from_srcset(srcset: Column) -> Column:
    """The URL of the largest width; the first one of equals."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")
    rated = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.regexp_extract(p, r"\s(\d+)w$", 1).try_cast("int"), F.lit(0)).alias("w"), (-i).alias("at"), F.regexp_extract(p, r"^(\S+)", 1).alias("url")))
    return F.array_max(rated)["url"]


def dimension(value: Column) -> Column:
    return F.regexp_extract(value, r"^(\d+)", 1).try_cast("int")


def append_note(note: Column, suffix: Column, separator: str = "; ") -> Column:
    return F.concat_ws(separator, blank_to_null(note), suffix)


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """The distinct keywords that are in a text as substrings, letter case aside, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def signed_gap(later: Column, earlier: Column) -> Column:
    """Hours, cut toward zero, with their sign."""
    return F.format_string("%+d", hours_between(later, earlier).cast("int"))


def relative_day(now: Column, then: Column) -> Column:
    days = F.datediff(now.cast("date"), then.cast("date"))
    return (
        F.when(then > now, "future").when(days == 0, "today").when(days == 1, "yesterday")
        .when(days <= 6, F.date_format(then, "EEEE")).when(days <= 30, F.date_format(then, "dd MMMM yyyy")).otherwise("archive")
    )


def feed_time(text: Column) -> Column:
    """RFC 822 or ISO 8601 time stamps; those without a zone are UTC; null where neither reads."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")), plain.try_cast("timestamp"))
