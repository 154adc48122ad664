"""Pages of discussion threads: title, text of the post, linked address, and the first comments that answer it directly."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments that are kept, their characters, and texts of comments that are gone; fixed values.
COMMENTS, COMMENT_CHARS, GONE = 8, 800, ("[deleted]", "[removed]")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Thread(HTMLParser):
    """Keeps the open elements with their classes; a text belongs to the innermost post or comment around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset[str]]] = []
        self.title, self.post, self.link = [], [], ""
        self.comments: list[dict] = []

    def _comment_depth(self) -> int:
        return sum({"thing", "comment"} <= c for _, c in self.open)

    def _inside(self, *classes: str) -> bool:
        return any(set(classes) <= c for _, c in self.open)

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        classes = frozenset(found.get("class", "").split())
        if tag == "div" and {"thing", "comment"} <= classes and self._comment_depth() == 0 and self._inside("sitetable", "nestedlisting"):
            self.comments.append({"text": [], "author": [], "score": []})
        depth = self._comment_depth()
        if tag == "a" and "title" in classes and self._inside("link", "thing") and not self.link:
            self.link = found.get("href", "")
        if depth == 1 and tag == "span" and {"score", "unvoted"} <= classes and found.get("title") and not self.comments[-1]["score"]:
            self.comments[-1]["score"] = [found["title"]]
        if tag not in _VOID:
            self.open.append((tag, classes))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if not data.strip() or not self.open:
            return
        said, depth = " ".join(data.split()), self._comment_depth()
        if self.open[-1][0] == "title":
            self.title.append(said)
        elif depth == 1 and self.comments:
            inner = self.open[-1][1]
            if self._inside("usertext-body"):
                self.comments[-1]["text"].append(said)
            elif "author" in inner:
                self.comments[-1]["author"].append(said)
            elif {"score", "unvoted"} <= inner and not self.comments[-1]["score"]:
                self.comments[-1]["score"].append(said)
        elif depth == 0 and self._inside("link", "thing") and self._inside("expando") and self._inside("usertext-body"):
            self.post.append(said)


def thread_text(html: str | None, url: str | None = None) -> str:
    """What a thread says; empty for null or empty pages."""
    p = _Thread()
    p.feed(html or "")
    title = " ".join(p.title)
    parts = [title.rsplit(" : ", 1)[0].strip(), " ".join(p.post)]
    if p.link.startswith("http") and p.link != url:
        parts.append(f"Linked URL: {p.link}")
    said = []
    for c in p.comments:
        text = " ".join(c["text"])
        if not text or text in GONE:
            continue
        if len(text) > COMMENT_CHARS:
            text = text[:COMMENT_CHARS].rstrip() + "..."
        said.append(f"[u/{' '.join(c['author']) or 'unknown'} | {' '.join(c['score'])}] {text}")
    if said:
        parts.append("Top comments:\n" + "\n\n".join(said[:COMMENTS]))
    return "\n\n".join(x for x in parts if x)


def extract_thread(html: Column, url: Column) -> Column:
    return F.pandas_udf(lambda pages, urls: pages.combine(urls, thread_text), "string", F.PandasUDFType.SCALAR)(html, url)


def plain_host(url: Column) -> Column:
    """The address of the same thread as a page that needs no scripts."""
    return F.regexp_replace(url, r"://(?:www\.)?reddit\.com/", "://old.reddit.com/")
