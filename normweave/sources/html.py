"""Listings and bodies in HTML."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import keep_first
from ..functions.text import blank, squeeze, strip
from ..operators.etl import clean_name, extract_key
from ..operators.temporal import revision_date


@F.pandas_udf(T.StringType())
def unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references resolved; no built-in function does this."""
    for s in parts:
        yield s.map(lambda x: None if x is None else html.unescape(x))


#: Fixed value: lines that belong to the page and not to the text.
NOISE = r"AJAX|조문목록|체크박스|return false|\.gif|\.png|javascript:"


def html_to_text(document: Column, noise: str | None = NOISE) -> Column:
    """Lines of text: no scripts and styles, references resolved before tags go, no blank or noise lines, no lone signs."""
    bare = F.regexp_replace(blank(document), r"(?is)<(script|style)[^>]*>.*?</\1>", "\n")
    resolved = F.when(bare.contains("&"), unescape(F.when(bare.contains("&"), bare))).otherwise(bare)
    lines = F.transform(F.split(F.regexp_replace(resolved, "<[^>]+>", "\n"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"), strip)
    kept = F.filter(lines, lambda x: (x != "") & ((F.length(x) > 1) | x.rlike(r"(?U)^[\p{L}\p{N}]$")))
    return F.array_join(F.filter(kept, lambda x: ~x.rlike(noise)) if noise else kept, "\n")


class _Tree(HTMLParser):
    """Links of a listing with the folders that they stand in."""

    def __init__(self, root: str):
        super().__init__(convert_charrefs=True)
        self.root, self.depth, self.folders, self.link, self.rows = root, 0, {}, None, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "ul" and (self.depth or given.get("id") == self.root):
            self.depth += 1
        elif tag == "a" and self.depth:
            self.link = [given.get("href") or "", given.get("onclick") or "", ""]

    def handle_data(self, data):
        if self.link:
            self.link[2] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            href, onclick, text = self.link
            self.link = None
            name = " ".join(text.split())
            if href.strip().lower() in ("#", "#none") and name and "key=" not in onclick:
                self.folders[self.depth] = name
            else:
                self.rows.append((name, self.folders.get(1, "미분류"), href, onclick))
        elif tag == "ul" and self.depth:
            self.folders.pop(self.depth, None)
            self.depth -= 1


_LINKS = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("name", "folder", "href", "onclick")]))


def listing(documents: DataFrame, root: str = "treeData") -> DataFrame:
    """documents (doc, html) as rules (doc, key, name, division, link): the first of each key, in the order of the page."""

    @F.pandas_udf(_LINKS)
    def links(pages: pd.Series) -> pd.Series:
        def one(page):
            tree = _Tree(root)
            tree.feed(page or "")
            return [dict(zip(("name", "folder", "href", "onclick"), r)) for r in tree.rows]

        return pages.map(one)

    found = documents.select("doc", F.posexplode(links("html")).alias("place", "l"))
    keyed = found.withColumn("key", F.coalesce(extract_key(F.col("l.href")), extract_key(F.col("l.onclick")))).where("key is not null")
    rows = keyed.select("doc", "place", "key", clean_name(F.col("l.name")).alias("name"), clean_name(F.col("l.folder")).alias("division"), F.when(extract_key(F.col("l.href")).isNotNull(), F.col("l.href")).otherwise(F.col("l.onclick")).alias("link"))
    return keep_first(rows, ["doc", "key"], [F.col("place")])


def version_links(documents: DataFrame, rule_name: str) -> DataFrame:
    """documents (doc, html) as versions (doc, place, key, label, revised_on) of the links that name a rule."""
    pattern = r"(?is)<a\b([^>]*)>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all(blank(F.col("html")), F.lit(pattern), 1).alias("a"), F.regexp_extract_all(blank(F.col("html")), F.lit(pattern), 2).alias("t"))
    rows = documents.select("doc", F.posexplode(both).alias("place", "x"))
    label = squeeze(F.regexp_replace(F.col("x.t"), "<[^>]+>", " "))
    named = rows.select("doc", "place", extract_key(F.col("x.a")).alias("key"), label.alias("label")).where(F.col("key").isNotNull() & F.col("label").contains(rule_name))
    return keep_first(named, ["doc", "key"], [F.col("place")]).withColumn("revised_on", revision_date(F.col("label")))
