"""Captured pages as a source: sitemaps, listings and product pages to rows.

Bodies come as a column of a DataFrame (read with ``spark.read.text(wholetext=True)`` or from Parquet).
What a pattern can find stays in SQL; nested mark-up is read with the standard library's parser over
Arrow batches.  A page that can't be read gives a row with an ``error``, never an exception.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of a sitemap, of a product's path, and of secrets that captures must not keep.
LOC = r"<loc>\s*([^<\s]+)\s*</loc>"
PRODUCT_PATH = re.compile(r"/\d{3,}$")
SECRETS = {
    "bearer": r"(?i)bearer\s+[a-z0-9._~+/-]{16,}=*",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    "key": r"(?i)(?:api[_-]?key|secret|token)[\"'=:\s]{1,4}[a-z0-9_-]{16,}",
    "aws": r"AKIA[0-9A-Z]{16}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "cookie": r"(?i)(?:phpsessid|sessionid)=[a-z0-9]{8,}",
}
VOID = {"meta", "link", "img", "br", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


def sitemap_locs(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """(keep..., pos, loc) of every address of a sitemap or an index of sitemaps."""
    return df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(body), F.lit(LOC), F.lit(1))).alias("pos", "loc"))


def is_sitemap_index(body: Column) -> Column:
    return body.rlike(r"(?i)<sitemapindex[\s>]")


def child_sitemaps(df: DataFrame, body: str, key: str) -> DataFrame:
    """(key, loc) to read next of each index: its first product.xml, or all its children if there is none."""
    locs = sitemap_locs(df.where(is_sitemap_index(F.col(body))), body, key)
    best = locs.groupBy(key).agg(F.min_by("loc", F.when(F.col("loc").rlike(r"(?i)/product\.xml$"), F.col("pos"))).alias("product"), F.bool_or(F.col("loc").rlike(r"(?i)/product\.xml$")).alias("has"))
    return locs.join(best, key).where("not has or loc = product").select(key, "loc").distinct()


def path_allowed(url: Column, allow: list[str] = (), contains: list[str] = (), deny: list[str] = ()) -> Column:
    """First path segment in ``allow``, path with one of ``contains``, whole address with none of ``deny``; empty lists allow all."""
    path = F.lower(F.try_parse_url(url, F.lit("PATH")))
    ok = F.lit(True)
    if allow:
        ok = ok & F.coalesce(F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(0)).isin([a.lower() for a in allow]), F.lit(False))
    if contains:
        ok = ok & F.coalesce(F.exists(F.array(*[F.lit(c.lower()) for c in contains]), lambda c: F.contains(path, c)), F.lit(False))
    if deny:
        ok = ok & ~F.exists(F.array(*[F.lit(d) for d in deny]), lambda d: F.contains(url, d))
    return ok


def redacted(text: Column) -> tuple[Column, Column]:
    """The text with secrets blanked, and how many there were."""
    n = F.lit(0)
    for name, pattern in SECRETS.items():
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text, n


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.text, self.children = tag, attrs, up, [], []

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            yield c
            yield from c.walk()

    def said(self) -> str:
        return "".join(x if isinstance(x, str) else x.said() for x in self.text)

    def within(self, test) -> bool:
        up = self.up
        while up is not None:
            if test(up):
                return True
            up = up.up
        return False


class Tree(HTMLParser):
    """A forgiving element tree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.text.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.up or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.text.append(data)


def product_links(html: str, base: str) -> list[str]:
    """Product addresses of a listing fragment: links in product cards, on the same host, ending in a number."""
    out: list[str] = []
    host = urlsplit(base).netloc
    for a in Tree(html).root.walk():
        if a.tag != "a" or "href" not in a.attrs or not a.within(lambda n: n.tag == "article" and n.attrs.get("id", "").startswith("proid-")):
            continue
        try:
            u = urlsplit(urljoin(base, a.attrs["href"]))
        except ValueError:
            continue
        link = urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path, "", ""))
        if u.netloc.lower() == host and PRODUCT_PATH.search(u.path) and link not in out:
            out.append(link)
    return out


def listing_links(df: DataFrame, body: str, base: str, *keep: str) -> DataFrame:
    """(keep..., pos, link) of every product link of listing pages."""

    @F.pandas_udf("array<string>")
    def links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, b in batches:
            yield pd.Series([product_links(h, x) if h and x else [] for h, x in zip(html, b, strict=True)])

    found = df.select(*keep, links(F.col(body), F.col(base)).alias("_links"))
    return found.select(*keep, F.posexplode("_links").alias("pos", "link"))


def first_seen_pages(links: DataFrame, category: str, page: str, link: str) -> DataFrame:
    """(category, page, link) of a paginated walk: each link where it comes first, up to the first page that adds none."""
    from pyspark.sql import Window

    first = links.groupBy(category, link).agg(F.min(page).alias(page))
    new = first.groupBy(category, page).agg(F.count("*").alias("n"))
    pages = links.select(category, page).distinct().join(new, [category, page], "left")
    stop = F.min(F.when(F.col("n").isNull(), F.col(page))).over(Window.partitionBy(category))
    kept = pages.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).select(category, page)
    return first.join(kept, [category, page], "left_semi").select(category, page, link)


PRODUCT = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("title", "brand", "sku", "image_url", "price_raw", "old_price_raw", "currency", "description")],
        T.StructField("sizes", T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("in_stock", T.BooleanType()), T.StructField("gtin", T.StringType())]))),
        T.StructField("error", T.StringType()),
    ]
)


def _failed(error: str) -> dict:
    return dict.fromkeys(PRODUCT.names) | {"sizes": [], "error": error}


def microdata_product(html: str) -> dict:
    """A product page with schema.org microdata; lists outside the product's scope don't count."""
    scope = next((n for n in Tree(html).root.walk() if n.attrs.get("itemtype", "").endswith("schema.org/Product")), None)
    if scope is None:
        return _failed("no product")
    prop: dict[str, str] = {}
    brand, sizes, old, listed = None, [], None, False
    in_brand = lambda n: n.attrs.get("itemprop") == "brand"
    for n in scope.walk():
        name = n.attrs.get("itemprop")
        value = " ".join((n.attrs.get("content") or n.attrs.get("href") or n.said()).split())
        if name == "name" and n.within(in_brand):
            brand = brand or value
        elif name and value:
            prop.setdefault(name, value)
        if n.tag == "ul" and "sizes" in n.classes():
            listed = True
        if n.tag == "li" and "data-product-size" in n.attrs and n.within(lambda x: "sizes" in x.classes()):
            raw = n.attrs["data-product-size"].strip()
            if raw and raw not in [s["raw"] for s in sizes]:
                sizes.append({"raw": raw, "in_stock": "disabled" not in n.classes(), "gtin": n.attrs.get("data-combination-code") or None})
        if "line-through" in n.classes() and n.within(lambda x: "old-price" in x.classes()) and (m := re.search(r"[\d.,]+", n.said())):
            old = old or m[0]
    title = " ".join(x for x in (brand, prop.get("name")) if x)
    error = None
    if not title or not prop.get("price"):
        error = "no title" if not title else "no price"
    elif not sizes:
        error = "sold out" if listed and prop.get("availability", "").lower().endswith("outofstock") else "no sizes"
    return {"title": title or None, "brand": brand, "sku": prop.get("sku"), "image_url": prop.get("image"), "price_raw": prop.get("price"), "old_price_raw": old, "currency": "EUR" if prop.get("priceCurrency") == "EUR" else "BAM", "description": prop.get("description"), "sizes": sizes, "error": error}


def _lenient(text: str):
    """JSON whose strings may hold raw control characters."""
    try:
        return json.loads(text, strict=False)
    except ValueError:
        return None


def json_ld_product(html: str) -> dict:
    """A product page with a JSON-LD product and a list of size attributes."""
    tree = Tree(html)
    data = None
    for n in tree.root.walk():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            got = _lenient(n.said())
            for x in got if isinstance(got, list) else [got]:
                if isinstance(x, dict) and x.get("@type") == "Product":
                    data = data or x
    sizes, old = [], []
    for n in tree.root.walk():
        if n.tag == "li" and "data-productsize-name" in n.attrs and n.within(lambda x: "product-attributes" in x.classes()) and not n.within(lambda x: "product-item" in x.classes()):
            off = "disabled" in n.classes()
            sizes.append({"raw": n.attrs["data-productsize-name"].strip(), "in_stock": not off, "gtin": None if off else n.attrs.get("data-combination-code") or None})
            old.append(n.attrs.get("data-productsize-oldprice"))
    if data is None:
        gone = any(n.tag == "button" and "disabled" in n.classes() and "nije dostupan" in n.said().lower() for n in tree.root.walk())
        return _failed("sold out" if gone and sizes and not any(s["in_stock"] for s in sizes) else "no product")
    offers = data.get("offers") or {}
    offers = offers[0] if isinstance(offers, list) and offers else offers
    brand = data.get("brand")
    brand = brand.get("name") if isinstance(brand, dict) else brand
    image = data.get("image")
    price = offers.get("price")
    number = lambda x: float(str(x).replace(",", ".")) if re.fullmatch(r"\d+([.,]\d+)?", str(x)) else None
    higher = [v for v in map(number, old) if v is not None and number(price) is not None and v > number(price)]
    return {"title": data.get("name"), "brand": brand, "sku": data.get("sku"), "image_url": image[0] if isinstance(image, list) and image else image if isinstance(image, str) else None, "price_raw": None if price is None else str(price), "old_price_raw": f"{max(higher):.2f}" if higher else None, "currency": "EUR" if offers.get("priceCurrency") == "EUR" else "BAM", "description": data.get("description"), "sizes": sizes, "error": None if data.get("name") and price is not None and sizes else "incomplete"}


def _found(data, key: str) -> Iterator:
    """Every value under ``key``, however deep."""
    if isinstance(data, dict):
        if key in data:
            yield data[key]
        for v in data.values():
            yield from _found(v, key)
    elif isinstance(data, list):
        for v in data:
            yield from _found(v, key)


def script_product(html: str) -> dict:
    """A product page whose data stands in script configurations: sizes, prices, gallery, brand variables."""
    tree = Tree(html)
    scripts = [n for n in tree.root.walk() if n.tag == "script"]
    configs = [x for n in scripts if n.attrs.get("type") == "text/x-magento-init" and (x := _lenient(n.said())) is not None]
    config = next((c for x in configs for c in _found(x, "jsonConfig") if isinstance(c, dict)), None)
    title = next((" ".join(n.said().split()) for n in tree.root.walk() if n.tag == "h1"), None)
    if config is None or not title:
        return _failed("no product")
    said = "".join(n.said() for n in scripts if "type" not in n.attrs)
    variable = lambda name: m[1] if (m := re.search(rf'var\s+{name}\s*=\s*"([^"]*)"', said)) and m[1] else None
    prices = config.get("prices") or {}
    amount = lambda k: (prices.get(k) or {}).get("amount")
    final, old = amount("finalPrice"), amount("oldPrice")
    attributes = config.get("attributes") or []
    attributes = attributes.values() if isinstance(attributes, dict) else attributes
    labels = [str(o.get("label", "")).strip() for a in attributes if a.get("code") == "size" for o in a.get("options") or []]
    gallery = [p for x in configs for g in _found(x, "mage/gallery/gallery") if isinstance(g, dict) for p in g.get("data") or []]
    pictures = [p["img"] for p in sorted(gallery, key=lambda p: not p.get("isMain")) if p.get("img")]
    sizes = [{"raw": x, "in_stock": True, "gtin": None} for x in dict.fromkeys(labels) if x]
    error = "no price" if final is None else None if sizes else "sold out"
    dear = old is not None and final is not None and old > final
    return {"title": title, "brand": variable("productBrand"), "sku": None, "image_url": pictures[0] if pictures else None, "price_raw": None if final is None else f"{final:.2f}", "old_price_raw": f"{old:.2f}" if dear else None, "currency": "BAM", "description": variable("productGender"), "sizes": sizes, "error": error}


#: Platform -> reader of its product pages.
READERS = {"microdata": microdata_product, "json_ld": json_ld_product, "script": script_product}


def product_pages(df: DataFrame, body: str, platform: str, *keep: str) -> DataFrame:
    """(keep..., product fields..., error) of each page, read by its platform; an unknown platform is an error."""
    schema = T.StructType([*[df.schema[k] for k in keep], *PRODUCT.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for html, kind in zip(pdf[body], pdf[platform], strict=True):
                read = READERS.get(kind)
                try:
                    rows.append(_failed("unknown platform") if read is None else read(html) if html else _failed("empty"))
                except (ValueError, AttributeError, TypeError, RecursionError):
                    rows.append(_failed("broken"))
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), pd.DataFrame(rows, columns=PRODUCT.names)], axis=1)

    return df.select(*dict.fromkeys([*keep, body, platform])).mapInPandas(run, schema)


LISTING = "struct<total: int, products: array<struct<id: bigint, name: string, sku: string, price: double, original_price: double, brand: struct<name: string>, options: array<struct<size: string, eu_size: string, available: boolean>>>>>"


def json_products(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """(keep..., total, product fields..., options) of JSON listings; SQL only."""
    d = df.select(*keep, F.from_json(F.col(body), LISTING).alias("j"))
    return d.select(*keep, F.col("j.total").alias("total"), F.inline("j.products"))


def is_last_page(page: Column, per_page: Column, total: Column, found: Column) -> Column:
    return (found == 0) | (page * per_page >= total)
