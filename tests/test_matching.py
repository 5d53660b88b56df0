"""Competitor matching (TXT2) and price gaps (TXT3): golden excerpts and a
brute-force comparison on a small fixture."""
from helpers import rows
from tillstar.functions import fuzzy
from tillstar.operators import matching


def test_weighted_score():
    assert fuzzy.weighted_score("Dell XPS 13", "Dell XPS 13 5G") > 80
    assert fuzzy.weighted_score("dell xps 13", "DELL XPS 13") == 100
    assert fuzzy.weighted_score("HP Victus 15", "iPhone 14 Pro") <= 80
    assert fuzzy.weighted_score(None, "x") == 0


def test_longest_common_subsequence():
    import random
    rng = random.Random(2)

    def plain(a, b):
        prev = [0] * (len(b) + 1)
        for ca in a:
            cur = [0]
            for j, cb in enumerate(b, 1):
                cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
            prev = cur
        return prev[-1]
    for n in (0, 1, 5, 40, 90):
        for _ in range(60):
            a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, n))) for _ in "ab")
            assert fuzzy._lcs(a, b) == plain(a, b)


def test_golden_gaps(spark):
    products = spark.createDataFrame([
        (1, "HP Victus 15", 125000.0), (2, "Dell XPS 13", 260000.0),
        (3, "Mouse X", 24000.0), (4, "Unknown Gadget", 999.0), (5, None, 1.0),
    ], "product_id long, product_name string, unit_price double")
    catalogue = spark.createDataFrame([
        ("hp victus 15", 119700.0, 0), ("Dell XPS 13 5G", 242700.0, 1),
        ("Mouse X", 24200.0, 2), ("mouse x", 1.0, 3),
    ], "competitor_product_name string, competitor_price double, ordinal long")
    m = matching.match_competitors(products, catalogue)
    got = rows(matching.price_gap(products, m), "product_id", "competitor_price",
               "price_difference", "price_difference_pct")
    assert got == [(1, 119700.0, 5300.0, 4.43), (2, 242700.0, 17300.0, 7.13),
                   (3, 24200.0, -200.0, -0.83), (4, None, None, None), (5, None, None, None)]


def test_against_brute_force(spark):
    names = ["samsung galaxy s23", "iphone 14 pro", "macbook air m2", "dell xps 13",
             "hp victus 16", "lenovo legion 5", "asus rog strix", "sony wh 1000"]
    cat = ["Samsung Galaxy S23 Ultra", "Apple iPhone 14 Pro", "MacBook Air M2 2022",
           "Dell XPS13", "HP Victus 16 Gaming", "Legion 5 Pro", "ROG Strix G15",
           "Sony WH-1000XM5", "Samsung Galaxy S23 Ultra"]
    products = spark.createDataFrame(list(enumerate(names)), "product_id long, product_name string")
    catalogue = spark.createDataFrame([(c, float(100 + i), i) for i, c in enumerate(cat)],
                                      "competitor_product_name string, competitor_price double, ordinal long")
    got = {r["product_id"]: (r["matched_name"], r["match_score"])
           for r in matching.match_competitors(products, catalogue, block_rows=3).collect()}
    cands = list(enumerate(cat))
    for pid, n in enumerate(names):
        ordinal, score = fuzzy.best_match(n, cands)
        if score > 80:
            assert got[pid] == (cat[ordinal], score)
        else:
            assert pid not in got


def test_fuzzy_query_against_brute_force(spark):
    """The registered fuzzy query on the smallest driver tables equals a
    brute-force best match computed in plain Python."""
    import os

    import pytest

    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables not present")
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect()
    from tillstar.plans.star import FUZZY_SUFFIX, fuzzy_catalogue
    names = sorted({r["p_name"] for r in part})
    got = {r["product_id"]: (r["matched_name"], r["match_score"])
           for r in E.queries()["competitor_matches_fuzzy"](spark, sf).collect()}
    order = {r["n"]: r["o"] for r in fuzzy_catalogue(spark.read.parquet(f"{sf}/part.parquet"))
             .selectExpr("competitor_product_name AS n", "ordinal AS o").collect()}
    cands = [(order[n.upper() + FUZZY_SUFFIX], n.upper() + FUZZY_SUFFIX) for n in names]
    known = {}
    for r in part:
        if r["p_name"] not in known:
            known[r["p_name"]] = fuzzy.best_match(r["p_name"], cands)
        ordinal, score = known[r["p_name"]]
        if score > 80:
            assert got[r["p_partkey"]] == (dict(cands)[ordinal], score)
        else:
            assert r["p_partkey"] not in got


def test_bound_never_drops_a_match():
    import random
    rng = random.Random(4)
    words = ["dell", "xps", "13", "pro", "max", "a", "galaxy", "s23", "ultra", "lg", "gram", "x"]
    for _ in range(4000):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        b = list(a if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))))
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice("abcdx 13")
        b = "".join(b)
        s = fuzzy.weighted_score(a, b)
        assert not (s > 80 and fuzzy._hopeless(fuzzy._parts(a), fuzzy._parts(b), 80)), (a, b, s)


def test_long_names_tie_by_ordinal(spark):
    """Two long names that differ in one character round to 100 as well."""
    long_ = "product " * 30
    products = spark.createDataFrame([(1, long_ + "x")], "product_id long, product_name string")
    catalogue = spark.createDataFrame([(long_ + "x", 9.0, 1), (long_ + "y", 5.0, 0)],
                                      "competitor_product_name string, competitor_price double, ordinal long")
    got = matching.match_competitors(products, catalogue).first()
    assert (got["matched_name"], got["match_score"], got["competitor_price"]) == (long_ + "y", 100, 5.0)


def _altered(rng, n):
    """Names that resemble each other in all ways the score knows."""
    words = ["dell", "xps", "13", "pro", "max", "galaxy", "s23", "ultra", "lenovo", "legion", "gram", "x", "wireless", "mouse"]
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(["", "a", "e", " ", "13", "-"])
            t = "".join(t) or "z"
            if rng.random() < 0.3:
                t = " ".join(reversed(t.split()))
        out.append(t)
    return out


def test_index_equals_all_pairs(spark):
    """Scores, ties and prices over random names, for two thresholds; far fewer
    pairs are scored than there are."""
    import random
    rng = random.Random(11)
    names, cat = _altered(rng, 260), _altered(rng, 240)
    products = spark.createDataFrame(list(enumerate(names)), "product_id long, product_name string")
    catalogue = spark.createDataFrame([(c, float(i), i) for i, c in enumerate(cat)],
                                      "competitor_product_name string, competitor_price double, ordinal long")
    score = {(n, c): fuzzy.weighted_score(n, c) for n in set(names) for c in set(cat)}
    for threshold in (80, 90, 60):
        want = {}
        for i, n in enumerate(names):
            s, o = max(((score[n, c], -k) for k, c in enumerate(cat)))
            if s > threshold:
                want[i] = (cat[-o], s)
        got = {r["product_id"]: (r["matched_name"], r["match_score"])
               for r in matching.match_competitors(products, catalogue, threshold, block_rows=100).collect()}
        assert got == want


def test_candidates_hold_every_match(spark):
    """No pair above the threshold is missing, but for those that a common word
    alone brings; the pairs are few among names of a large vocabulary."""
    import random
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(2, 4))) for _ in range(400)]
    a = [x for x in base if fuzzy.plain(x)]
    b = [y for y in ((x[:k] + rng.choice(letters) + x[k + 1:]).strip() for x in a for k in [rng.randrange(len(x))]) if fuzzy.plain(y)]
    frame = lambda x: spark.createDataFrame([(t,) for t in sorted(set(x))], "text string")
    got = {tuple(r) for r in matching.candidates(frame(a), frame(b), 80).collect()}
    for x in set(a):
        for y in set(b):
            if (x, y) not in got:
                assert fuzzy.weighted_score(x, y) <= 80 or set(x.split()) & set(y.split()) and fuzzy.weighted_score(x, y) == fuzzy.WORD_FLOOR
    assert len(got) < 0.05 * len(set(a)) * len(set(b))
