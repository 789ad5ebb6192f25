"""Product pages of one layout as strict records: a page becomes an array of nodes, the rest are columns.

nodes_of() is the only Python: it reads a page once and gives its marked elements in document order, each
with its tag, classes, attributes, whole text and the last node inside it. Everything else filters that array.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import availability_of, first_match, let, price_of, squeeze, unit_of_name
from tallyforge.sources.readers import normalize_url

#: The classes of the layout's parts.
PARTS = {
    "main": ["c-catalog-element"], "article": ["catalog-element-article-value"], "gallery": ["catalog-element-gallery-pictures"], "price": ["catalog-element-price-current"], "any_price": ["catalog-element-price-current", "catalog-element-price"],
    "old_price": ["catalog-element-price-base", "catalog-element-price-discount-old"], "stock": ["catalog-element-quantity", "catalog-element-quantity-value-text"], "property": ["catalog-element-properties-detail-item"],
    "property_name": ["catalog-element-properties-detail-item-name"], "property_value": ["catalog-element-properties-detail-item-value"], "crumbs": ["breadcrumb-wrapper"], "package": ["catalog-element-complect"],
    "related_name": ["catalog-products-viewed-name-wrapper"], "related_price": ["catalog-products-viewed-price"], "card": ["catalog-section-item"], "category": ["c-catalog-section"],
}
#: Names of the properties that hold brand and manufacturer; kinds of documents by a word of their title.
BRAND_NAMES, MAKER_NAMES = ("бренд", "торговая марка"), ("производитель", "изготовитель")
DOCUMENTS = {"passport": "паспорт", "manual": "инструкц", "certificate": "сертификат", "catalog": "каталог"}
_KEPT = frozenset("h1 a img li iframe video source link".split())
_ATTRS = frozenset("itemprop itemtype content href src rel data-id data-role data-item data-compare-id data-data data-original data-src title alt".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NODE = T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()),
])


class _Nodes(HTMLParser):
    """Marked elements in document order; an end tag closes what was left open inside its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attrs):
        known = {k: v or "" for k, v in attrs if k in _ATTRS}
        classes = next((v for k, v in attrs if k == "class" and v), "").split()
        node = None
        if tag in _KEPT or known or classes:
            node = {"at": len(self.found), "last": len(self.found), "tag": tag, "classes": classes, "attrs": known, "text": len(self.pieces)}
            self.found.append(node)
        if tag in _VOID:
            self._close(node)
        else:
            self.open.append((tag, node))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                name, node = self.open.pop()
                self._close(node)
                if name == tag:
                    return

    def handle_data(self, data):
        if data.strip() and not any(t in ("script", "style") for t, _ in self.open[-1:]):
            self.pieces.append(data)

    def _close(self, node):
        if node:
            node["last"], node["text"] = len(self.found) - 1, " ".join(" ".join(self.pieces[node["text"] :]).split())

    def nodes(self) -> list[dict]:
        while self.open:
            self._close(self.open.pop()[1])
        return self.found


@F.pandas_udf(T.ArrayType(NODE))
def nodes_of(pages: pd.Series) -> pd.Series:
    """The marked elements of a page; none of an empty one."""
    def read(page: str | None) -> list[dict]:
        parser = _Nodes()
        parser.feed(page or "")
        parser.close()
        return parser.nodes()

    return pages.map(read)


def _some(nodes: Column, part: str) -> Column:
    return F.filter(nodes, lambda n: F.arrays_overlap(n["classes"], F.array(*map(F.lit, PARTS[part]))))


def _where(nodes: Column, attr: str, *values: str) -> Column:
    return F.filter(nodes, lambda n: F.coalesce(F.try_element_at(n["attrs"], F.lit(attr)).isin(*values), F.lit(False)) if values else F.map_contains_key(n["attrs"], F.lit(attr)))


def _inside(nodes: Column, scope: Column) -> Column:
    """Nodes inside a node; all where there is no such node."""
    return F.filter(nodes, lambda n: scope.isNull() | ((n["at"] > scope["at"]) & (n["at"] <= scope["last"])))


def _first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def _attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _section(nodes: Column, name: str) -> Column:
    """Nodes inside the sections of a name; none where there is no such section."""
    sections = _where(nodes, "data-id", name)
    return F.filter(nodes, lambda n: F.exists(sections, lambda s: (n["at"] > s["at"]) & (n["at"] <= s["last"])))


def _filled(text: Column) -> Column:
    return F.nullif(squeeze(text), F.lit(""))


def _numbered(items: Column, *names: str) -> Column:
    return F.transform(items, lambda x, i: F.struct((i + 1).alias("position"), *[x[n].alias(n) for n in names]))


def with_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with their nodes, the node of the main part, and the nodes to look for facts in."""
    rows = pages.withColumn("nodes", nodes_of(F.col(html)))
    rows = rows.withColumn("main", _first(_some(F.col("nodes"), "main")))
    return rows.withColumn("scope", _inside(F.col("nodes"), F.col("main")))


def page_evidence(rows: DataFrame) -> Column:
    """A struct of a page's flags, how many of the eight supporting ones hold, and its type.

    A product has a heading, the main part and two supporting flags at least; a category a heading and a list of products or sections.
    """
    nodes, scope, main = F.col("nodes"), F.col("scope"), F.col("main")
    has = lambda found: F.size(found) > 0
    flags = {
        "article": has(_some(scope, "article")), "gallery": has(_some(scope, "gallery")), "price": has(_some(scope, "any_price")) | has(_where(scope, "itemprop", "price")), "availability": has(_some(scope, "stock")),
        "description": has(_where(_section(scope, "description"), "itemprop", "description")) | has(_where(_where(scope, "data-id", "description"), "data-role", "section.content.item")), "properties": has(_where(scope, "data-id", "properties")),
        "controls": has(_where(scope, "data-compare-id")) | has(_where(scope, "data-item")), "internal_id": internal_id(scope, main).isNotNull(),
    }
    support = sum((flag.cast("int") for flag in flags.values()), F.lit(0))
    heading = F.exists(nodes, lambda n: n["tag"] == "h1")
    lists = has(_some(nodes, "category")) | has(_some(nodes, "card"))
    kind = F.when(heading & main.isNotNull() & (support >= 2), "product").when(heading & lists, "category").otherwise("other")
    return F.struct(*[flag.alias(f"has_{name}") for name, flag in flags.items()], heading.alias("has_heading"), main.isNotNull().alias("has_main"), support.alias("support"), kind.alias("page_type"))


def internal_id(scope: Column, main: Column) -> Column:
    """The product's number of the shop: of the first data record that has one, else of its controls."""
    records = F.concat(F.transform(scope, lambda n: _attr(n, "data-data")), F.array(_attr(main, "data-data")))
    of_records = F.transform(records, lambda r: F.get_json_object(r, "$.id"))
    of_controls = F.flatten(F.transform(scope, lambda n: F.array(_attr(n, "data-compare-id"), _attr(n, "data-item"))))
    return _first(F.filter(F.concat(of_records, of_controls), lambda x: F.coalesce(x.rlike("^[0-9]+$"), F.lit(False))))


def product_record(url: str = "url") -> list[Column]:
    """The columns of a page's record, for rows of with_nodes()."""
    nodes, scope, main = F.col("nodes"), F.col("scope"), F.col("main")
    heading = _first(F.filter(nodes, lambda n: n["tag"] == "h1"))["text"]
    canonical = _attr(_first(_where(F.filter(nodes, lambda n: n["tag"] == "link"), "rel", "canonical")), "href")
    pairs = F.transform(_some(_section(nodes, "properties"), "property"), lambda p: F.struct(
        _filled(_first(_some(_inside(nodes, p), "property_name"))["text"]).alias("name"), squeeze(_first(_some(_inside(nodes, p), "property_value"))["text"]).alias("value"),
    ))
    known = F.array_distinct(F.filter(pairs, lambda p: p["name"].isNotNull() & p["value"].isNotNull()))
    named = lambda names: _first(F.reverse(F.filter(known, lambda p: F.lower(p["name"]).isin(*names))))["value"]
    price_node = F.coalesce(_first(_some(scope, "price")), _first(_where(scope, "itemprop", "price")))
    price_text = _filled(F.coalesce(F.nullif(_attr(price_node, "content"), F.lit("")), price_node["text"]))
    price, old = price_of(price_text), price_of(_first(_some(scope, "old_price"))["text"])
    stock = _filled(_first(_some(scope, "stock"))["text"])
    crumbs = _first(F.reverse(_some(nodes, "crumbs")))
    links = lambda found: F.filter(found, lambda n: (n["tag"] == "a") & (F.coalesce(_attr(n, "href"), F.lit("")) != ""))
    path = F.filter(F.transform(F.filter(_inside(nodes, crumbs), lambda n: n["tag"] == "a"), lambda n: F.struct(_filled(n["text"]).alias("name"), normalize_url(_attr(n, "href")).alias("url"))), lambda c: c["name"].isNotNull() & ~c["name"].eqNullSafe(heading))
    gallery = _some(nodes, "gallery")
    pictures = F.filter(nodes, lambda n: F.exists(gallery, lambda g: (n["at"] > g["at"]) & (n["at"] <= g["last"])))
    sources = F.transform(pictures, lambda n: F.coalesce(_attr(n, "href"), _attr(n, "data-original"), _attr(n, "data-src"), _attr(n, "src")))
    images = F.array_distinct(F.transform(F.filter(sources, lambda u: F.coalesce(u.contains("/upload/") & ~F.lower(u).contains("no_photo"), F.lit(False))), lambda u: normalize_url(u)))
    kind = lambda n: first_match([(F.lower(F.coalesce(_filled(n["text"]), _attr(n, "href"))).contains(word), F.lit(name)) for name, word in DOCUMENTS.items()], "document")
    documents = F.array_distinct(F.transform(F.filter(links(nodes), lambda n: F.lower(_attr(n, "href")).rlike(r"\.(pdf|docx?|xlsx?)($|\?)")), lambda n: F.struct(normalize_url(_attr(n, "href")).alias("url"), _filled(n["text"]).alias("title"), kind(n).alias("kind"))))
    videos = F.array_distinct(F.transform(F.filter(nodes, lambda n: n["tag"].isin("iframe", "video", "source") & (F.coalesce(_attr(n, "src"), F.lit("")) != "")), lambda n: normalize_url(_attr(n, "src"))))
    package = F.array_distinct(F.filter(F.transform(F.filter(_section(nodes, "complect"), lambda n: n["tag"] == "li"), lambda n: _filled(n["text"])), lambda x: x.isNotNull()))

    def related(section: str, name: str) -> Column:
        found = F.filter(links(_section(nodes, section)), lambda n: _attr(n, "href").contains("/catalog/"))
        made = F.transform(found, lambda n: F.struct(
            F.lit(name).alias("kind"), F.coalesce(_filled(_first(_some(_inside(nodes, n), "related_name"))["text"]), _filled(_attr(n, "title"))).alias("name"), normalize_url(_attr(n, "href")).alias("url"),
            price_of(_first(_some(_inside(nodes, n), "related_price"))["text"]).alias("price"),
        ))
        return F.filter(made, lambda r: r["name"].isNotNull())

    state = let(stock, lambda text: availability_of(text))
    number = internal_id(scope, main)
    own_url = F.coalesce(normalize_url(canonical), normalize_url(F.col(url)))
    return [
        F.coalesce(number, own_url).alias("external_id"), F.when(number.isNotNull(), "internal_product_id").otherwise("canonical_url").alias("external_id_type"), _filled(_first(_some(nodes, "article"))["text"]).alias("sku"),
        _filled(heading).alias("name"), named(BRAND_NAMES).alias("brand"), named(MAKER_NAMES).alias("manufacturer"), own_url.alias("canonical_url"), price_text.alias("price_raw"), price.alias("price"),
        F.when(~old.eqNullSafe(price), old).alias("old_price"), F.coalesce(_attr(_first(_where(nodes, "itemprop", "priceCurrency")), "content"), F.lit("RUB")).alias("currency"),
        stock.alias("availability_raw"), state["state"].alias("availability"), state["stock"].alias("quantity"), _filled(_first(_where(nodes, "itemprop", "description"))["text"]).alias("description"),
        F.transform(known, lambda p, i: F.struct((i + 1).alias("position"), p["name"].alias("name"), p["value"].alias("value"), unit_of_name(p["name"]).alias("unit"))).alias("properties"),
        _numbered(F.when(crumbs.isNotNull(), path), "name", "url").alias("categories"), images.alias("images"), _numbered(documents, "url", "title", "kind").alias("documents"), videos.alias("videos"),
        package.alias("package"), F.concat(related("accessories", "accessory"), related("related", "related")).alias("relations"),
    ]
