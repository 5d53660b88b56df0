"""Competitor listings and page links from HTML (TXT4, TXT5, FLT11).

Blocks (listing containers, the pagination) are found by one pass over a page's
tags (``functions/markup.py``) in Arrow batches; a block carries what it holds
and nothing else of its page. Names, prices, references and links of the blocks
are DataFrame expressions. Tags and attribute names are case-insensitive,
attributes may be in either kind of quotes, blocks may span lines. An unclosed
block reaches to the end of the page.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.functions import markup
from tillstar.session import ship_package

# Fixed values of the listing extraction.
NAME_PREFIXES = ("Promo: ", "Best Deal: ")
CURRENCY = "DZD"
REF_RE = r"Ref:\s*P-\d+"
PRICE_TEXT_RE = r"\d+\s*DZD"
PRICE_RE = r"(\d+)\s*DZD"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

_HIDDEN_RE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_TAG_RE = r"(?s)<[^>]*>"


#: How a page marks its listings; the first rule that a page satisfies holds.
CONTAINERS = (
    lambda b: "col-" in b.classes,
    lambda b: "card" in b.classes.split(),
    lambda b: "product" in b.classes,
)
#: Without a marked container, the blocks that hold these texts.
NEEDED = ("Ref:", CURRENCY)
#: How a page marks its pagination, in order.
PAGINATION = (
    lambda b: b.name == "div" and "pagination" in b.classes,
    lambda b: b.name == "ul" and "pagination" in b.classes.split(),
)
LABEL_RE = r"Previous|Next"
_AROUND = ("div", "ul", "nav")


def visible(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN_RE, "")


def _unescape(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def texts(html: Column) -> Column:
    """The text between tags, as an array."""
    return F.transform(F.split(html, _TAG_RE), _unescape)


def blocks(pages: DataFrame, find: Callable[[str], Iterable[markup.Block]], *keep: str) -> DataFrame:
    """(keep..., place, block): what each block that ``find`` sees in a page's
    visible HTML holds, numbered by place. One row of pages at a time."""
    ship_package(pages.sparkSession)
    base = pages.select(*keep, visible(F.col("html")).alias("_v"))
    schema = base.drop("_v").schema.add("place", T.IntegerType()).add("block", T.StringType())

    def run(batches):
        for b in batches:
            at, place, inner = [], [], []
            for k, page in enumerate(b.column("_v").to_pylist()):
                for n, x in enumerate(find(page)):
                    at.append(k)
                    place.append(n)
                    inner.append(page[x.start:x.end])
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(place, pa.int32()), pa.array(inner, pa.string())], names=schema.names)
    return base.mapInArrow(run, schema)


def containers(pages: DataFrame) -> DataFrame:
    """(page_id, place, block): the listing containers of each page."""
    def find(page):
        return markup.marked(markup.fold(page, ("div",)), CONTAINERS, NEEDED)
    return blocks(pages, find, "page_id")


def _first(block: Column, pattern: str) -> Column:
    return F.get(F.regexp_extract_all(block, F.lit(pattern), 1), 0)


def _joined(html: Column) -> Column:
    return F.array_join(F.transform(texts(html), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), "")


def listings(pages: DataFrame) -> DataFrame:
    """TXT4: (page_id, position, competitor_product_name, competitor_price,
    product_reference, currency). The name is the first link that holds a text
    and nothing else, or the first heading, or the first link with a class; the
    price is the last one. Blocks without both are dropped (FLT11)."""
    b, t = F.col("block"), F.col("_t")
    link = _first(b, r"""(?is)<a\b[^>]*\bhref\s*=\s*(?:"[^"]+"|'[^']+')[^>]*>((?:\s*<\w+[^>]*>)*[^<]*[^<\s][^<]*(?:</\w+\s*>\s*)*)</a\s*>""")
    heading = _first(b, r"(?is)<h[2-5]\b[^>]*>(.*?)</h[2-5]\s*>")
    classed = _first(b, r"(?is)<a\b[^>]*\bclass\s*=[^>]*>(.*?)</a\s*>")
    name = _joined(F.coalesce(link, heading, classed))
    for p in NAME_PREFIXES:
        name = F.replace(name, F.lit(p), F.lit(""))
    priced = F.array_join(F.filter(t, lambda x: x.rlike(PRICE_TEXT_RE)), "")
    prices = F.regexp_extract_all(priced, F.lit(PRICE_RE), 1)
    out = containers(pages).withColumn("_t", texts(b)).select(
        "page_id", "place", F.regexp_replace(name, r"^\s+|\s+$", "").alias("competitor_product_name"),
        F.element_at(F.when(F.size(prices) > 0, prices), -1).cast("double").alias("competitor_price"),
        F.regexp_replace(F.get(F.filter(t, lambda x: x.rlike(REF_RE)), 0), r"^\s+|\s+$", "").alias("product_reference"),
        F.lit(CURRENCY).alias("currency"))
    kept = out.where("competitor_product_name <> '' AND competitor_price > 0")
    # a page's listings are few and come from one row of it
    rows = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", "competitor_product_name", "competitor_price", "product_reference", "currency"))).alias("l"))
    return rows.select("page_id", F.posexplode("l").alias("position", "r")).select("page_id", "position", *(
        f"r.{c}" for c in ("competitor_product_name", "competitor_price", "product_reference", "currency")))


# ------------------------------------------------------------- pagination

ANCHOR_RE = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a\s*>"""

def pagination_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, html): inner HTML of each page's pagination block, where it
    has one: the first div whose class mentions pagination, or else the first ul
    of that class; or else the innermost div, ul or nav around the first
    "Previous" or "Next"."""
    label = re.compile(LABEL_RE)

    def find(page):
        folded = markup.fold(page, _AROUND)
        found = next((b for rule in PAGINATION for b in folded.blocks if rule(b)), None) or markup.innermost(folded, label)
        return [found] if found else []
    return blocks(pages, find, "page_id", "url").select("page_id", "url", F.col("block").alias("html"))


def tag_blocks(pages: DataFrame, tag: str) -> DataFrame:
    """(page_id, url, place, html): inner HTML of each block of a tag."""
    def find(page):
        return markup.fold(page, (tag,)).blocks
    return blocks(pages, find, "page_id", "url").withColumnRenamed("block", "html")


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, position, href, text): every anchor with a target."""
    group = lambda k: F.regexp_extract_all(html, F.lit(ANCHOR_RE), k)
    z = pages.select("page_id", "url", F.posexplode(F.arrays_zip(
        group(1).alias("d"), group(2).alias("s"), group(3).alias("t"))).alias("position", "z"))
    return z.select("page_id", "url", F.col("position").cast("int").alias("position"),
                    F.concat("z.d", "z.s").alias("href"),
                    F.regexp_replace(F.regexp_replace("z.t", _TAG_RE, ""), r"^\s+|\s+$", "").alias("text"))


def join_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(
        p == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
        .when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
