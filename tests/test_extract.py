"""HTML listing / link extraction (TXT4, TXT5) and invoice parsing (TXT6-TXT9)."""
from helpers import rows
from tillstar.operators import extract

PAGE = """<html><body>
<div class="row">
 <div class="col-md-4"><div class="card">
   <a href="/p/1">Promo: Dell XPS 13 5G</a>
   <p>Ref: P-1001</p>
   <p><span>250000 DZD</span> <span>242700 DZD</span></p>
 </div></div>
 <div class="col-md-4"><div class="card">
   <h3>Best Deal: HP Victus 15</h3>
   <p>119700 DZD</p>
 </div></div>
 <div class="col-md-4"><div class="card">
   <a href="/p/3">Samsung S23 Ultra</a>
   <p>Ref: P-1003</p>
   <p>Prix sur demande</p>
 </div></div>
</div>
<div class="pagination"><a href="?page=1">1</a><a href="?page=2">2</a><a href="?page=3">3</a><a href="?page=2">2</a><a href="/next">Next</a></div>
<a href="/about">7</a>
</body></html>"""


def _pages(spark):
    return spark.createDataFrame([(1, "https://shop.example.com/catalog?page=1", PAGE)],
                                 "page_id long, url string, html string")


def test_listings(spark):
    got = rows(extract.competitor_listings(_pages(spark)),
               "competitor_product_name", "competitor_price", "product_reference", "currency")
    # promo prefix removed, the last of two prices wins, missing price dropped, missing ref NULL
    assert got == [("Dell XPS 13 5G", 242700.0, "Ref: P-1001", "DZD"),
                   ("HP Victus 15", 119700.0, None, "DZD")]
    stats = extract.price_stats(extract.competitor_listings(_pages(spark))).first()
    assert (stats["products"], stats["avg_price"], stats["min_price"], stats["max_price"]) == \
        (2, 181200.0, 119700.0, 242700.0)


def test_links_only_from_pagination_block(spark):
    got = rows(extract.page_links(_pages(spark)), "page_number", "page_url")
    assert got == [(2, "https://shop.example.com/catalog?page=2"),
                   (3, "https://shop.example.com/catalog?page=3")]


def test_url_join(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([
        ("http://a.com/x/y.html?q=1#f", "z.html", "http://a.com/x/z.html"),
        ("http://a.com/x/y.html", "/root", "http://a.com/root"),
        ("http://a.com", "p", "http://a.com/p"),
        ("http://a.com/x/y", "https://b.org/", "https://b.org/"),
        ("http://a.com/x/y", "//c.net/k", "http://c.net/k"),
        ("http://a.com/x/y?q=1", "?q=2", "http://a.com/x/y?q=2"),
        ("http://a.com/x/y#a", "#b", "http://a.com/x/y#b"),
    ], "base string, href string, want string")
    out = df.select((extract.url_join(F.col("base"), F.col("href")) == F.col("want")).alias("ok"))
    assert all(r["ok"] for r in out.collect())


INVOICES = [
    ("a.jpg", "FACTURE\nDate: 2022-09-22\nRef: ORD-5073\nClient ID: C1001\nNom: Sami Oukil\n"
              "Produit Qte Prix Total\nHP Victus 15 2 125000 250000"),
    ("b.jpg", "Date: 2022-02-20\nClient ID: C1003\nNom: Meriem Bouzid\nMacBook Alr M2 1 195000 195000"),
    ("c.jpg", "Client ID: C1025\nNom: Houda Mekki\nDate: 2022-10-27 Ref ORD-7940\n"
              "iPhone 14 Pro 3 230000 690000"),
    ("d.jpg", "Date: 2022-02-27\nRef: ORD-3931\nClient ID: C1002\nNom: Sofiane Khelifa\n"
              "Dell XPS 13 5 260000 520000"),
    ("e.jpg", "Facture 2022-06-01\nClient: C1004\nAmine Rahmani\nSamsung S23 Ultra\n"
              "Quantite: 3\nPrix: 185000"),
    ("f.jpg", "2022-03-15\nORD-1111\nC1050\nNom: Lina Haddad\nHP Victus 16\n"
              "Qte 2  Prix 150000  Total 300000"),
    ("g.jpg", None),
]


def test_invoices(spark):
    df = spark.createDataFrame(INVOICES, "source_file string, text string")
    got = {r["source_file"]: tuple(r[c] for c in extract.INVOICE_FIELDS)
           for r in extract.parse_invoices(df).collect()}
    assert got["a.jpg"] == ("2022-09-22", "ORD-5073", "C1001", "Sami Oukil", "HP Victus 15",
                            2, 125000.0, 250000.0)
    # missing order reference, OCR typo kept from the product line
    assert got["b.jpg"] == ("2022-02-20", None, "C1003", "Meriem Bouzid", "MacBook Alr M2",
                            1, 195000.0, 195000.0)
    # name on the line after the client id line
    assert got["c.jpg"] == ("2022-10-27", "ORD-7940", "C1025", "Houda Mekki", "iPhone 14 Pro",
                            3, 230000.0, 690000.0)
    # quantity contradicting the total is repaired: round(520000 / 260000) = 2
    assert got["d.jpg"] == ("2022-02-27", "ORD-3931", "C1002", "Sofiane Khelifa", "Dell XPS 13",
                            2, 260000.0, 520000.0)
    # fallbacks: id pattern, two-word name line, known product, first small and
    # only large number (total), unit price derived from it
    assert got["e.jpg"] == ("2022-06-01", None, "C1004", "Amine Rahmani", "Samsung S23 Ultra",
                            1, 185000.0, 185000.0)
    # two large numbers -> unit price and total; quantity repaired from them
    assert got["f.jpg"] == ("2022-03-15", "ORD-1111", "C1050", "Lina Haddad", "HP Victus 16",
                            2, 150000.0, 300000.0)
    assert "g.jpg" not in got                      # no text: no record
    s = extract.invoice_summary(extract.parse_invoices(df)).first()
    assert (s["invoices"], s["total_revenue"]) == (6, 2140000.0)


def test_longest_text(spark):
    df = spark.createDataFrame([("a", "short"), ("a", "the longest text"), ("b", "x")],
                               "source_file string, text string")
    assert rows(extract.longest_text(df)) == [("a", "the longest text"), ("b", "x")]
