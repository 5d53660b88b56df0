"""Star-schema build from the driver tables, materialised once per session.

Mapping (driver table -> star):
* Fact_Sales   : lineitem JOIN orders on the order key; date = order date,
                 product = part key, store = supplier key, customer = customer
                 key, revenue = extended price * (1 - discount) (exact DECIMAL).
* Dim_Product  : part (name, brand as subcategory, type as category, retail
                 price as unit price, cost = price * COST_RATIO), review
                 sentiment from ``documents``, competitor price from a
                 catalogue derived from ``part``.
* Dim_Store    : supplier JOIN nation JOIN region; the monthly target comes
                 from a target sheet derived from supplier balances.
* Dim_Customer : customer JOIN nation JOIN region.
* Dim_Date     : distinct order dates.
* Marketing    : a spend sheet derived per (category, month) of the sales.
* Shipping     : a five-row rate sheet per region (joined on the customer's
                 region after normalising both sides).

The fact is written denormalised (dimension attributes copied in) and
partitioned by year, so every dashboard query is a single scan with pushed-down
filters and no join. ``in_star`` marks rows that an inner join with the date,
store and product dimensions keeps; ``customer_known`` the same for customers.
"""

from __future__ import annotations

import os
import threading
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions.dates import date_attributes
from tillstar.functions.money import MONEY
from tillstar.operators import clean, dims, facts, matching, sentiment
from tillstar.session import delete, release, scratch_path
from tillstar.sources import buckets
from tillstar.sources.tables import DRIVER_TABLES, table_path, literal_table, read_table

# Fixed values of our mapping (both the Spark build and the SQL oracle use them).
COST_RATIO = "0.70"            # unit cost = retail price * ratio
COMPETITOR_FACTOR = "0.95"     # competitor price = lowest retail price of the name * factor
TARGET_MONTH = "1995-01"       # month of the derived target sheet
SHIPPING_SHEET = (             # raw rate sheet: region, cost per unit (dirty on purpose)
    (" Africa ", "12.50"),
    ("AMERICA", "20"),
    ("AMERICA", "20"),
    ("asia", "15.75"),
    ("Europe", "18.0"),
    ("Middle East ", "9.5"),
    ("Atlantis", "n/a"),
)


# Stand-in sentiment words for the synthetic driver corpus (fixed values of our
# mapping): the generated documents hold almost no real sentiment words, so a
# few frequent corpus tokens carry valences and act as boosters; the corpus's
# own negations ("pas", "nicht", "no") are already in the negation list.
CORPUS_LEXICON = sentiment.DEFAULT_LEXICON + (
    ("with", 1.2), ("for", 0.8), ("that", -0.6), ("was", -0.9), ("der", 0.7),
    ("und", 0.5), ("que", -0.5), ("les", 0.6), ("des", -0.4), ("el", 0.3),
)
CORPUS_BOOSTERS_UP = sentiment.BOOSTERS_UP + ("this",)
CORPUS_BOOSTERS_DOWN = sentiment.BOOSTERS_DOWN + ("by",)
CORPUS_PHRASES = sentiment.DEFAULT_PHRASES + (
    ("of the", 0.9), ("in the", -0.7), ("the in", 0.4), ("the of the", 1.1), ("with the", -0.3), ("was the", 0.0),
)


@dataclass
class Warehouse:
    """Paths of the materialised star tables."""

    spark: SparkSession
    root: str
    timings: dict[str, float] = field(default_factory=dict)
    row_counts: dict[str, int] = field(default_factory=dict)
    _frames: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def table(self, name: str) -> DataFrame:
        """The written table; the DataFrame (and its file index, i.e. the
        partition listing) is created once and shared by every query."""
        df = self._frames.get(name)
        if df is None:
            df = self.spark.read.parquet(self.path(name))
            self._frames[name] = df
        return df

    def derived(self, name: str, make) -> DataFrame:
        """A table that ``make()`` derives from the star, written once."""
        with _LOCK:
            if name not in self._frames:
                make().write.mode("overwrite").parquet(self.path(name))
            return self.table(name)

    @property
    def fact(self) -> DataFrame:
        return self.table("fact_sales")

    @property
    def star(self) -> DataFrame:
        """Fact rows an inner join with date, store and product keeps."""
        return self.fact.where(F.col("in_star"))


_CACHE: dict[tuple, Warehouse] = {}
_LOCK = threading.RLock()


def _input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Length and time of each input table's files, so that a changed table is
    not answered from an earlier build."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for name in DRIVER_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            files = fs.listStatus(path)
            state.append((name, tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    return tuple(state)


def session_key(spark: SparkSession, sf_dir: str) -> tuple:
    path = sf_dir if "://" in sf_dir else os.path.abspath(sf_dir)
    try:
        return spark.sparkContext.applicationId, path, _input_state(spark, sf_dir)
    except Exception:  # Spark Connect: no SparkContext on the client
        return str(id(spark)), path, ()


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The session's materialised star for ``sf_dir`` (built on first use)."""
    key = session_key(spark, sf_dir)
    with _LOCK:  # concurrent callers share one build
        wh = _CACHE.get(key)
        if wh is None:
            wh = build_warehouse(spark, sf_dir)
            _CACHE[key] = wh
    return wh


# --------------------------------------------------------------------------
# Inputs derived from the driver tables
# --------------------------------------------------------------------------

def products_from_part(part: DataFrame) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("subcategory_name"),
        F.col("p_type").alias("category_name"),
        price.alias("unit_price"),
        F.round(price * F.lit(COST_RATIO).cast("decimal(4,2)"), 2)
        .cast("decimal(12,2)").alias("unit_cost"))


def reviews_from_documents(documents: DataFrame, n_products) -> DataFrame:
    """Review = document; product = doc_id mod #products, rating 1..5.
    ``n_products`` is an int or a Column (e.g. a scalar subquery)."""
    n = n_products if isinstance(n_products, Column) else F.lit(n_products)
    return documents.select(
        F.col("doc_id").alias("review_id"),
        F.pmod(F.col("doc_id"), n).alias("product_id"),
        (F.lit(1) + F.pmod(F.col("doc_id"), F.lit(5))).cast("double").alias("rating"),
        F.col("text").alias("review_text"))


def competitor_catalogue(part: DataFrame) -> DataFrame:
    """One listing per product name (upper-cased), priced below our lowest."""
    return (part.groupBy("p_name")
            .agg(F.min(F.col("p_retailprice").cast("decimal(12,2)")).alias("_p"))
            .select(F.upper("p_name").alias("competitor_product_name"),
                    F.round(F.col("_p") * F.lit(COMPETITOR_FACTOR).cast("decimal(4,2)"), 2)
                    .cast("double").alias("competitor_price"),
                    F.xxhash64("p_name").alias("ordinal")))


FUZZY_SUFFIX = " xl"   # alteration of the fuzzy-matching catalogue


def fuzzy_catalogue(part: DataFrame) -> DataFrame:
    """Listings whose names differ from ours (a suffix), so every match has
    to be found by the fuzzy pass; same prices as :func:`competitor_catalogue`."""
    return (competitor_catalogue(part)
            .withColumn("competitor_product_name",
                        F.concat(F.col("competitor_product_name"), F.lit(FUZZY_SUFFIX))))


LISTINGS_A_PAGE = 12   # parts on a listing page
PAGES_LINKED = 3       # pages a listing page links to


def listing_pages(part: DataFrame) -> DataFrame:
    """Shop pages that list our parts, LISTINGS_A_PAGE to a page, in the shapes
    that real pages come in: by page number, containers are ``col-`` blocks,
    cards, product blocks or bare blocks; names stand in links, headings or
    classed links; prices are the last of two; every seventh part has none. The
    pagination is a block over several lines, one with nested blocks, a list, a
    navigation named by its labels, or a block in single quotes."""
    no = F.floor(F.col("p_partkey") / LISTINGS_A_PAGE).cast("long")
    kind, k = F.pmod(no, F.lit(4)), F.col("p_partkey")
    name = F.replace(F.replace(F.col("p_name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    dinar = F.floor("p_retailprice").cast("long").cast("string")
    price = F.when(k % 7 == 0, "<p>on request</p>").otherwise(
        F.concat(F.lit("<p><s>99999 DZD</s>\n <b>"), dinar, F.lit(" DZD</b></p>")))
    title = (F.when(k % 3 == 0, F.concat(F.lit("<a href='/p/"), k.cast("string"), F.lit("'>Promo: "), name, F.lit("</a>")))
             .when(k % 3 == 1, F.concat(F.lit("<H3 class=t>\n"), name, F.lit("</H3>")))
             .otherwise(F.concat(F.lit("<a class='n'><i>"), name, F.lit("</i></a>"))))
    inner = F.concat(title, F.lit("<div><span>Ref: P-"), k.cast("string"), F.lit("</span></div>"), price)
    opening = (F.when(kind == 0, "<div class=\"x col-md-4\">").when(kind == 1, "<div\n class='card'>")
               .when(kind == 2, "<DIV class=\"product-box\">").otherwise("<div>"))
    rows = (part.where("p_name IS NOT NULL AND p_retailprice IS NOT NULL")
            .select(no.alias("page_id"), k.alias("k"), F.concat(opening, inner, F.lit("</div>")).alias("b"))
            .groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "b"))).alias("l")))
    p = F.col("page_id")
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(PAGES_LINKED)), lambda i: F.concat(
        F.lit("<a href=\"../list?page="), (p + i).cast("string"), F.lit("\">\n"), i.cast("string"), F.lit("</a>"))), " ")
    shape = F.pmod(p, F.lit(5))
    nav = (F.when(shape == 0, F.concat(F.lit("<div class=\"pagination\">\n"), links, F.lit("\n</div>")))
           .when(shape == 1, F.concat(F.lit("<div class='my-pagination'><div>1</div>"), links, F.lit("</div>")))
           .when(shape == 2, F.concat(F.lit("<ul class=\"pagination\"><li>"), links, F.lit("</li></ul>")))
           .when(shape == 3, F.concat(F.lit("<nav><span>Previous</span>"), links, F.lit("<b>Next</b></nav>")))
           .otherwise(F.concat(F.lit("<DIV Class='a pagination b'>"), links, F.lit("</DIV>"))))
    # a page without a container class must not be split at other blocks
    return rows.select(
        "page_id", F.concat(F.lit("https://shop.example.com/a/b/"), p.cast("string")).alias("url"),
        F.concat(F.lit("<html><script>var t='<div class=\"col-1\">5 DZD';</script><a href=\"/x\">7</a>"), nav,
                 F.array_join(F.transform("l", lambda r: r["b"]), "\n"), F.lit("</html>")).alias("html"))


def geography(spark, sf_dir) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
            .select(F.col("n_nationkey").alias("nationkey"),
                    F.col("n_name").alias("city_name"), F.col("r_name").alias("region")))


def stores_from_supplier(supplier: DataFrame, geo: DataFrame) -> DataFrame:
    return (supplier.join(geo, supplier.s_nationkey == geo.nationkey, "left")
            .select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"),
                    "city_name", "region"))


def target_sheet(supplier: DataFrame) -> DataFrame:
    """Raw monthly target sheet (text cells) for suppliers with a positive balance."""
    return (supplier.where(F.col("s_acctbal") > 0)
            .select(F.lit(TARGET_MONTH).alias("month"),
                    F.concat(F.lit("Store_"), F.col("s_suppkey").cast("string")).alias("store_id"),
                    F.format_number(F.col("s_acctbal"), 2).alias("target_revenue"),
                    F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Manager"))
                    .alias("manager_name")))


def customers_from_customer(customer: DataFrame, geo: DataFrame) -> DataFrame:
    return (customer.join(geo, customer.c_nationkey == geo.nationkey, "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_name").alias("customer_name"), "city_name", "region"))


def shipping_sheet(spark: SparkSession) -> DataFrame:
    return literal_table(spark, SHIPPING_SHEET, "region_name string, shipping_cost string")


def marketing_sheet(cat_months: DataFrame) -> DataFrame:
    """Raw spend sheet: one or two campaigns per (category, month); campaigns
    start after a category's first month of sales, so those months have none.
    Cells are text, categories upper-cased and padded as a spreadsheet would
    hold them. ``cat_months`` is the small (category, month) totals table."""
    idx = F.year("month") * 12 + F.month("month")
    cl = F.length("category")
    first = cat_months.groupBy("category").agg(F.min("month").alias("_first"))
    rows = (cat_months.join(first, "category")
            .where(F.col("month") > F.col("_first"))
            .withColumn("campaign", F.explode(F.sequence(F.lit(1), F.lit(1) + F.pmod(idx, F.lit(2))))))
    usd = F.lit(500) + F.pmod(idx * 37 + cl * 101 + F.col("campaign") * 13, F.lit(4000))
    return rows.select(
        F.date_format("month", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit(" "), F.upper("category"), F.lit(" ")).alias("category"),
        usd.cast("string").alias("marketing_cost_usd"))


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderdate"]
_BUCKETED: dict[tuple, dict[str, DataFrame]] = {}


def order_tables(spark: SparkSession, sf_dir: str, bucketed: bool = False) -> dict[str, DataFrame]:
    """``lineitem`` and ``orders`` with the columns the fact needs. ``bucketed``
    copies by order key are written once for a state of the inputs; from then on
    every build and query joins them without an exchange."""
    key = session_key(spark, sf_dir)
    with _LOCK:
        if key in _BUCKETED:
            return _BUCKETED[key]
        lineitem = read_table(spark, sf_dir, "lineitem", LINE_COLUMNS, spread=not bucketed)
        orders = read_table(spark, sf_dir, "orders", ORDER_COLUMNS)
        if not bucketed:
            return {"lineitem": lineitem, "orders": orders}
        _BUCKETED[key] = buckets.colocated({"lineitem": (lineitem, "l_orderkey"), "orders": (orders, "o_orderkey")})
        return _BUCKETED[key]


def sales_from_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    li = lineitem.select(*LINE_COLUMNS)
    od = orders.select(*ORDER_COLUMNS)
    return (li.join(od, li.l_orderkey == od.o_orderkey, "inner")
            .select(F.col("l_orderkey").alias("order_key"),
                    F.col("l_linenumber").alias("line_number"),
                    F.to_date("o_orderdate").alias("full_date"),
                    F.col("l_partkey").alias("product_id"),
                    F.col("l_suppkey").alias("store_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("l_quantity").cast("int").alias("quantity"),
                    (price * (F.lit(1) - disc)).cast(MONEY).alias("total_revenue")))


# --------------------------------------------------------------------------
# Build
# --------------------------------------------------------------------------

_TIMINGS: dict[str, float] = {}


@contextmanager
def _step(name: str):
    t = time.perf_counter()
    try:
        yield
    finally:
        _TIMINGS[name] = round(time.perf_counter() - t, 3)


_ROWS: dict[str, int] = {}


def _write(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write a table; its row count is observed during the write (no extra pass)."""
    from pyspark.sql import Observation
    obs = Observation(os.path.basename(path))
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    _ROWS[os.path.basename(path)] = int(obs.get.get("rows", 0))
    return df.sparkSession.read.parquet(path)


def build_dimensions(spark: SparkSession, sf_dir: str, root: str) -> dict[str, DataFrame]:
    part = read_table(spark, sf_dir, "part",
                      ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    products = products_from_part(part)
    with _step("sentiment"):
        # number of products as a scalar subquery (no separate driver job)
        n_products = F.greatest(part.agg(F.count(F.lit(1))).scalar(), F.lit(1))
        docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True,
                          key="doc_id")
        senti = sentiment.analyze_sentiment(
            reviews_from_documents(docs, n_products),
            CORPUS_LEXICON,
            CORPUS_BOOSTERS_UP, CORPUS_BOOSTERS_DOWN, phrases=CORPUS_PHRASES)
        senti = _write(senti, os.path.join(root, "product_review_stats"))
    with _step("dim_product"):
        matches = matching.match_competitors(products, competitor_catalogue(part))
        gaps = matching.price_gap(products.select("product_id", "unit_price"), matches)
        dim_product = _write(dims.build_dim_product(products, senti, gaps),
                             os.path.join(root, "dim_product"))

    t_geo = time.perf_counter()
    geo = geography(spark, sf_dir)
    supplier = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    targets = clean.clean_targets(target_sheet(supplier))
    totals = _write(dims.store_target_totals(targets), os.path.join(root, "store_target_totals"))
    dim_store = _write(dims.build_dim_store(stores_from_supplier(supplier, geo), totals),
                       os.path.join(root, "dim_store"))

    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey"])
    dim_customer = _write(dims.build_dim_customer(customers_from_customer(customer, geo)),
                          os.path.join(root, "dim_customer"))
    _TIMINGS["dim_store_customer"] = round(time.perf_counter() - t_geo, 3)
    return {"dim_product": dim_product, "dim_store": dim_store, "dim_customer": dim_customer}


def build_fact(spark: SparkSession, sf_dir: str, root: str, d: dict[str, DataFrame]) -> DataFrame:
    inputs = order_tables(spark, sf_dir)
    # The order join is the largest shuffle of the build; both the totals pass
    # and the fact pass need its result, so it is computed once and written.
    with _step("sales_join"):
        sales = _write(sales_from_orders(**inputs), os.path.join(root, "sales"))

    prod = d["dim_product"].select(
        "product_id", "product_name", "subcategory_name", "category_name", "unit_cost",
        F.col("avg_sentiment").alias("sentiment_score"), "competitor_price",
        F.lit(True).alias("_p"))
    store = d["dim_store"].select(
        "store_id", "store_name", F.col("city_name").alias("store_city"),
        F.col("region").alias("store_region"), "monthly_target", "annual_target",
        F.lit(True).alias("_s"))
    cust = d["dim_customer"].select(
        "customer_id", "customer_name", F.col("city_name").alias("customer_city"),
        F.col("region").alias("customer_region"), F.lit(True).alias("_c"))
    ship = clean.clean_shipping(shipping_sheet(spark))
    ship = (ship.groupBy("region_name").agg(F.max("shipping_cost").alias("shipping_rate"))  # of two rates the higher
            .withColumnRenamed("region_name", "_ship_region"))

    enriched = (sales.join(prod, "product_id", "left")
                .join(cust, "customer_id", "left")
                # the rate sheet is a fixed literal of a handful of rows
                .join(F.broadcast(ship), F.lower(F.trim(F.col("customer_region")))
                      == F.col("_ship_region"), "left")
                .join(store, "store_id", "left")
                .withColumn("category", F.lower(F.trim("category_name")))
                .withColumn("month", F.trunc("full_date", "month")))

    # Totals need only revenue, date and category: a narrow plan of its own
    # (sales JOIN product category), not the fully enriched rows.
    narrow = (sales.select("product_id", "full_date", "total_revenue")
              .join(prod.select("product_id", "category_name"), "product_id", "left")
              .select(F.lower(F.trim("category_name")).alias("category"),
                      F.trunc("full_date", "month").alias("month"), "total_revenue"))
    with _step("category_month_totals"):
        totals = facts.category_month_revenue(narrow)
        totals = _write(totals, os.path.join(root, "category_month_revenue"))
        spend = clean.spend_per_category_month(
            clean.harmonize_currency(clean.clean_marketing(marketing_sheet(totals))))
        spend = _write(spend, os.path.join(root, "marketing_spend"))
        cm = totals.join(spend, ["category", "month"], "left")
        cm = facts.bounded_broadcast(cm)

    fact = facts.profit_columns(facts.allocate_marketing(enriched, cm))
    attrs = date_attributes(F.col("full_date"))
    fact = fact.select(
        "order_key", "line_number",
        *[c.alias(n) for n, c in attrs.items() if n != "full_date"], "full_date",
        F.col("month").alias("month_start"),
        "product_id", "store_id", "customer_id", "quantity",
        "total_revenue", "product_cost", "gross_profit", "shipping_cost",
        "marketing_cost", "net_profit", "category",
        "product_name", "subcategory_name", "category_name", "sentiment_score",
        "competitor_price", "store_name", "store_city", "store_region",
        "monthly_target", "annual_target", "customer_name", "customer_city",
        "customer_region",
        (F.coalesce("_p", F.lit(False)) & F.coalesce("_s", F.lit(False))
         & F.col("full_date").isNotNull()).alias("in_star"),
        F.coalesce("_c", F.lit(False)).alias("customer_known"))
    # Rows sorted by date inside each year folder: parquet min/max statistics on
    # full_date then let date-range filters skip row groups, not just years.
    # The partitioned write sorts by year anyway; the extra key rides along.
    fact = fact.sortWithinPartitions("year", "full_date")
    with _step("fact_write"):
        fact = _write(fact, os.path.join(root, "fact_sales"), partition_by="year")
        delete(spark, os.path.join(root, "sales"))      # the fact holds all of it
        release(spark)
        return fact


def build_warehouse(spark: SparkSession, sf_dir: str, root: str | None = None) -> Warehouse:
    root = root or scratch_path(spark, "warehouse")
    _TIMINGS.clear()
    _ROWS.clear()
    d = build_dimensions(spark, sf_dir, root)
    fact = build_fact(spark, sf_dir, root, d)
    with _step("dim_date_roi"):
        _write(dims.build_dim_date(fact), os.path.join(root, "dim_date"))
        _write(facts.marketing_roi_monthly(fact), os.path.join(root, "marketing_roi"))
    return Warehouse(spark, root, dict(_TIMINGS), dict(_ROWS))
