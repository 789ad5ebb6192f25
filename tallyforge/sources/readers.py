"""Sources: registry and card JSONL, CSV with byte-order mark, sitemaps, captured product pages."""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPERTY = "struct<property_id:bigint,property_code:string,property_name:string,property_type:string,value:string,value_flat:string,unit:string>"
REGISTRY_DDL = (
    "id bigint, name string, article string, brand string, model string, category_path string, category_id string, url string, active boolean, "
    f"price decimal(18,4), currency string, properties array<{PROPERTY}>, raw_data string, snapshot_hash string"
)
CARD_DDL = (
    "supplier_code string, external_id string, sku string, name string, url string, http_status int, price decimal(18,4), old_price decimal(18,4), quantity decimal(18,4), currency string, "
    "availability_raw string, availability string, description string, brand string, manufacturer string, "
    "properties array<struct<name:string,value:string,unit:string,position:int>>, media array<struct<media_type:string,url:string,title:string,position:int,is_primary:boolean>>, "
    "options array<struct<name:string,position:int,values:array<struct<value:string,target_url:string,selected:boolean,position:int>>>>, "
    "categories array<struct<name:string,url:string,position:int>>, alias_urls array<string>"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry snapshot; malformed lines fail the read."""
    return spark.read.schema(REGISTRY_DDL).option("mode", "FAILFAST").json(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD_DDL).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all text; a byte-order mark before the first name is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def matching_context(registry: DataFrame, article_codes: dict[str, str]) -> DataFrame:
    """Registry rows as matching products: inactive ones left out, properties as a map, supplier articles by code.

    article_codes: property code to supplier code.
    """
    rows = registry.filter(~F.col("active").eqNullSafe(False))
    filled = F.filter(F.coalesce("properties", F.array().cast(f"array<{PROPERTY}>")), lambda p: F.coalesce(p["value_flat"], F.lit("")) != "")
    unit = lambda p: F.when((F.coalesce(p["unit"], F.lit("")) != "") & ~p["value_flat"].contains(p["unit"]), F.concat(p["value_flat"], F.lit(" "), p["unit"])).otherwise(p["value_flat"])
    names = F.array_distinct(F.transform(filled, lambda p: p["property_name"]))
    last = F.transform(names, lambda n: F.struct(n, unit(F.element_at(F.filter(filled, lambda p: p["property_name"] == n), -1))))
    of = lambda code: F.transform(F.filter(filled, lambda p: p["property_code"] == code), lambda p: p["value_flat"])
    ids = F.create_map(*[x for code, supplier in sorted(article_codes.items()) for x in (F.lit(supplier), of(code))]) if article_codes else F.create_map().cast("map<string,array<string>>")
    return rows.select(
        F.col("id").alias("key"), "name", F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("model", F.lit("")).alias("model"), F.lit("").alias("supplier_article"),
        F.coalesce("article", F.lit("")).alias("manufacturer_article"), F.coalesce("category_path", F.lit("")).alias("category"), F.map_from_entries(last).alias("properties"),
        F.lit("").alias("supplier_code"), F.map_filter(ids, lambda _, v: F.size(v) > 0).alias("identifiers"), F.lit("").alias("kind"),
    )


def article_coverage(registry: DataFrame, prefix: str = "ARTIKUL_") -> DataFrame:
    """Per namespace of supplier articles: values, products, and articles that several products hold."""
    rows = registry.select("id", F.explode("properties").alias("p")).filter(F.col("p.property_code").startswith(prefix) & (F.coalesce("p.value_flat", F.lit("")) != ""))
    pairs = rows.select(F.col("p.property_code").alias("namespace"), F.col("p.value_flat").alias("article"), "id")
    per = pairs.groupBy("namespace", "article").agg(F.countDistinct("id").alias("n"))
    return per.groupBy("namespace").agg(F.sum("n").alias("values"), F.count_if(F.col("n") > 1).alias("repeated_articles")).orderBy("namespace")


def sitemap_urls(maps: DataFrame, order: str, xml: str = "xml") -> DataFrame:
    """(url, kind, first) of sitemap documents: each location once, with the place of its first appearance.

    order numbers the documents. kind is sitemap for the entries of an index, which name further
    documents to read, and url for pages; sort by first to have the order of appearance.
    """
    def found(tag: str) -> Column:
        return F.transform(F.expr(f"xpath({xml}, \"//*[local-name()='{tag}']/*[local-name()='loc']/text()\")"), lambda x: F.trim(x))

    parts = [maps.select(F.col(order).alias("_o"), F.posexplode(found(tag)).alias("_p", "url"), F.lit(tag).alias("kind")) for tag in ("sitemap", "url")]
    rows = parts[0].unionByName(parts[1]).filter("url <> ''")
    return rows.groupBy("url", "kind").agg(F.min(F.struct("_o", "_p")).alias("first"))


def read_replay(spark: SparkSession, path: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(items, problems) of the stored answers of a paginated source: JSON lines of page, total and items.

    item: DDL of an item with an id. Problems are totals that pages disagree on, a number of items that
    isn't the total, and ids that come twice: with any of them the capture is not whole.
    """
    pages = spark.read.schema(f"page bigint, total bigint, items array<struct<{item}>>").option("mode", "FAILFAST").json(path)
    items = pages.select(F.explode("items").alias("x")).select("x.*")
    counted = pages.agg(F.min("total").alias("least"), F.max("total").alias("most"), F.sum(F.size("items")).alias("n"))
    problems = counted.select(F.explode(F.array_compact(F.array(
        F.when(F.col("least") != F.col("most"), F.concat(F.lit("TOTALS_DIFFER:"), "least", F.lit("-"), "most")), F.when(F.coalesce("n", F.lit(0)) != F.coalesce("most", F.lit(0)), F.concat(F.lit("ITEMS_NOT_TOTAL:"), F.coalesce("n", F.lit(0)))),
    ))).alias("problem"))
    twice = items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("REPEATED_ID:"), F.col("id").cast("string")).alias("problem"))
    return items, problems.unionByName(twice)


def rebuild_cards(products: DataFrame, children: dict[str, DataFrame], key: str = "product_id", order: str = "position") -> DataFrame:
    """Cards from tables: each child table as an array of structs in order, one join per table; [] where a product has none."""
    for name, child in children.items():
        columns = [order, *[c for c in child.columns if c not in (key, order)]]
        lists = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        products = products.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return products


def supplement(registry: DataFrame, extra: DataFrame, fields: tuple[str, ...], key: str = "id", stamp: str = "snapshot_hash") -> DataFrame:
    """The registry with fields filled from extra where it has none, and a new hash of each row; rows without extra stay."""
    more = extra.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    rows = registry.join(more, key, "left")
    made = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in fields}
    rows = rows.select(*[made.get(c, F.col(c)).alias(c) for c in registry.columns])
    hashed = F.sha2(F.to_json(F.struct(*sorted(c for c in registry.columns if c != stamp)), {"ignoreNullFields": "false"}), 256)
    return rows.withColumn(stamp, hashed)


def packaged_views(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The CSV files of a package as read-only views of the same names."""
    tables = {name: read_csv(spark, f"{folder}/{name}.csv") for name in names}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tables


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL is http or https, of one of the hosts or below it, and no address of a private network."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    known = F.lit(False)
    for name in hosts:
        known = known | (host == name) | host.endswith(f".{name}")
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[)")
    return F.coalesce(known & (host != "") & ~private, F.lit(False))


def merge_discoveries(left: DataFrame, right: DataFrame) -> DataFrame:
    """url and the union of the collections both sides found it in."""
    a, b = left.select("url", F.col("collections").alias("_a")), right.select("url", F.col("collections").alias("_b"))
    nothing = F.array().cast("array<string>")
    return a.join(b, "url", "fullouter").select("url", F.array_sort(F.array_distinct(F.concat(F.coalesce("_a", nothing), F.coalesce("_b", nothing)))).alias("collections"))


def normalize_url(url: Column, host: str | None = None, tracking: tuple[str, ...] = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "yclid", "gclid", "fbclid", "ref")) -> Column:
    """https, host in lower case without www., single slashes, no fragment, no tracking parameters.

    With `host`, URLs of other hosts stay as they are.
    """
    shape = r"^(?i)(https?)://(?:www\.)?([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    where, path = F.lower(F.regexp_extract(url, shape, 2)), F.regexp_replace(F.regexp_extract(url, shape, 3), "/{2,}", "/")
    query = F.filter(F.split(F.regexp_extract(url, shape, 4), "&"), lambda q: (q != "") & ~F.lower(F.substring_index(q, "=", 1)).isin(*tracking))
    made = F.concat(F.lit("https://"), where, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    known = (where != "") if host is None else (where == host)
    return F.when(known, made).otherwise(url)


class _Page(HTMLParser):
    """Title, heading, links, images, breadcrumb, JSON-LD and microdata of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.links, self.images, self.blocks = "", "", [], [], []
        self.props: dict[str, str] = {}
        self._in: list[str] = []
        self._want: tuple[str, str] | None = None

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
        elif tag == "img" and found.get("src"):
            self.images.append(found["src"])
        if tag == "script" and found.get("type", "").lower() == "application/ld+json":
            self.blocks.append("")
            self._in.append("ld")
        elif tag in ("title", "h1"):
            self._in.append(tag)
        if name := found.get("itemprop"):
            value = found.get("content") or (found.get("href") if tag in ("a", "link") else None)
            if value:
                self.props.setdefault(name, value)
            else:
                self._want = (name, tag)

    def handle_endtag(self, tag):
        if self._in and tag in (self._in[-1], "script" if self._in[-1] == "ld" else ""):
            self._in.pop()
        if self._want and tag == self._want[1]:
            self._want = None

    def handle_data(self, data):
        if self._in:
            if self._in[-1] == "ld":
                self.blocks[-1] += data
            elif self._in[-1] == "title":
                self.title += data
            else:
                self.heading += data
        if self._want and data.strip():
            self.props.setdefault(self._want[0], " ".join(data.split()))


def _product_of(blocks: list[str]) -> dict:
    """The first JSON-LD object of type Product, wherever it is nested; an empty dict if none parses."""
    stack = []
    for block in blocks:
        try:
            stack.append(json.loads(block))
        except ValueError:
            continue
    while stack:
        item = stack.pop(0)
        if isinstance(item, list):
            stack = item + stack
        elif isinstance(item, dict):
            kinds = item.get("@type")
            if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                return item
            stack += [v for v in item.values() if isinstance(v, dict | list)]
    return {}


_TEXTS = T.ArrayType(T.StringType())
PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "heading", "sku", "brand", "price", "currency", "availability")]
    + [T.StructField("links", _TEXTS), T.StructField("images", _TEXTS), T.StructField("signals", T.IntegerType()), T.StructField("page_type", T.StringType())]
)


@F.pandas_udf(PAGE)
def parse_page(pages: pd.Series) -> pd.DataFrame:
    """A captured page as a card: JSON-LD first, then microdata; the page type from its signals."""
    rows = []
    for page in pages:
        found = _Page()
        found.feed(page or "")
        ld = _product_of(found.blocks)
        offer = ld.get("offers") or {}
        offer = offer[0] if isinstance(offer, list) and offer else offer if isinstance(offer, dict) else {}
        brand = ld.get("brand")
        brand = brand.get("name") if isinstance(brand, dict) else brand
        text = lambda *values: next((unescape(str(v)).strip() for v in values if v not in (None, "")), None)
        sku, price = text(ld.get("sku"), found.props.get("sku")), text(offer.get("price"), found.props.get("price"))
        state = text(offer.get("availability"), found.props.get("availability"))
        state = re.sub(r"^https?://schema\.org/", "", state) if state else None
        heading = " ".join(found.heading.split())
        signals = sum(bool(x) for x in (ld, sku, price, state, brand or found.props.get("brand"), found.images, "itemtype" in (page or ""), found.props))
        kind = "product" if heading and signals >= 2 else "category" if heading and len(found.links) >= 10 else "other"
        rows.append((" ".join(found.title.split()), heading, sku, text(brand, found.props.get("brand")), price, text(offer.get("priceCurrency"), found.props.get("priceCurrency")), state, found.links, found.images, signals, kind))
    return pd.DataFrame(rows, columns=PAGE.names)
