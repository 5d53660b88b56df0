"""TXT2/TXT3: match products to a competitor catalogue and compute price gaps.

Semantics: for each product name, the catalogue entry with the highest
weighted fuzzy score wins if the score is strictly above the threshold (80);
ties go to the earliest catalogue entry (lowest ``ordinal``). The price is the
one of the first catalogue row carrying the winning (lower-cased) name.

Plan:
1. The catalogue gets its ordinals once, in a written table. Names and entries
   of one processed text are one text, the entry with its lowest ordinal.
2. Exact pass: an equi-join on the processed name. Equal names score 100. A
   different name can only round to 100 when the two are 200 characters long or
   more together, so names of up to EXACT_LENGTH characters are done then.
3. Candidates for the rest come from a join of three-letter grams
   (``candidates``): a pair above the threshold shares one, as follows from the
   lengths (``functions/fuzzy.py``).
   Only such pairs are scored. Pairs of one word in common and of lengths far
   apart all score the same by that word alone; for them the lowest ordinal of
   each word and length is enough.
4. Texts that the proof doesn't hold for (a repeated word or blank, or a single
   character) are searched in blocks, each (block, salt) in its own task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.functions import fuzzy
from tillstar.functions.money import money
from tillstar.session import materialize, ship_package

THRESHOLD = 80
BLOCK_ROWS = 2000
#: Equal processed names of up to this length can't be tied by another name.
EXACT_LENGTH = 98


def _processed(c):
    """Same processing as fuzzy.process, as a native Column."""
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]|_", " ")))


def _catalogue(catalogue: DataFrame) -> DataFrame:
    cols = catalogue.columns
    if "ordinal" not in cols:
        catalogue = catalogue.withColumn("ordinal", F.monotonically_increasing_id())
    return catalogue.select(
        F.col("competitor_product_name"), F.col("competitor_price").cast("double"),
        F.col("ordinal").cast("long"))


def _price_by_name(cat: DataFrame) -> DataFrame:
    """First price (lowest ordinal) per lower-cased name."""
    return (cat.groupBy(F.lower("competitor_product_name").alias("_lname"))
            .agg(F.min_by("competitor_price", "ordinal").alias("competitor_price")))


def match_competitors(products: DataFrame, catalogue: DataFrame,
                      threshold: int = THRESHOLD,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """products(product_id, product_name) x catalogue(competitor_product_name,
    competitor_price[, ordinal]) -> (product_id, matched_name, match_score,
    competitor_price). Unmatched products are absent."""
    ship_package(products.sparkSession)
    cat = materialize(_catalogue(catalogue).where(F.col("competitor_product_name").isNotNull()), "catalogue")
    prods = products.select("product_id", "product_name").where(
        F.col("product_name").isNotNull())

    cat_keys = (cat.groupBy(_processed(F.col("competitor_product_name")).alias("_key"))
                .agg(F.min_by("competitor_product_name", "ordinal").alias("matched_name")))
    names = prods.select("product_name").distinct().withColumn("_key", _processed(F.col("product_name")))
    short = (F.col("_key") != "") & (F.length("_key") <= EXACT_LENGTH)
    names = materialize(names.join(cat_keys, "_key", "left").withColumn(
        "matched_name", F.when(short, F.col("matched_name"))).drop("_key"), "match_names")
    exact = names.where("matched_name IS NOT NULL").withColumn("match_score", F.lit(100))
    rest = _texts(names.where("matched_name IS NULL").select(F.col("product_name").alias("raw")), "match_rest")
    entries = _texts(cat.select(F.col("competitor_product_name").alias("raw"), "ordinal"), "match_entries")

    keys = rest.select("text", "indexed").distinct()
    texts = entries.groupBy("text", "indexed").agg(F.min("ordinal").alias("ordinal"))
    if threshold < fuzzy.LEAST_INDEXED:
        scored = _in_blocks(keys, texts, threshold, block_rows)
    else:
        a, b = keys.where("indexed"), texts.where("indexed")
        scored = (_scored(candidates(a, b, threshold).join(b.select(F.col("text").alias("entry"), "ordinal"), "entry"), threshold)
                  .unionByName(_by_word(a, b, threshold))
                  .unionByName(_in_blocks(keys.where("NOT indexed"), texts, threshold, block_rows))
                  .unionByName(_in_blocks(a, texts.where("NOT indexed"), threshold, block_rows)))
    best = (scored.groupBy("text")
            .agg(F.max(F.struct(F.col("match_score").alias("s"), (-F.col("ordinal")).alias("o"))).alias("b"))
            .select("text", F.col("b.s").alias("match_score"), (-F.col("b.o")).alias("ordinal")))
    found = (best.join(cat.select("ordinal", F.col("competitor_product_name").alias("matched_name")), "ordinal")
             .join(rest.select("text", F.col("raw").alias("product_name")), "text")
             .select("product_name", "matched_name", "match_score"))
    matched = prods.join(exact.unionByName(found), "product_name").select("product_id", "matched_name", "match_score")
    return (matched.withColumn("_lname", F.lower("matched_name"))
            .join(_price_by_name(cat), "_lname", "left").drop("_lname"))


def _texts(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``text``, the processed ``raw``, and whether the gram index
    holds for it. Empty texts match nothing and go."""
    schema = T.StructType(list(rows.schema.fields)).add("text", T.StringType()).add("indexed", T.BooleanType())

    def run(frames):
        for f in frames:
            f["text"] = [fuzzy.process(x) for x in f["raw"]]
            f["indexed"] = [fuzzy.plain(x) for x in f["text"]]
            yield f
    return materialize(rows.mapInPandas(run, schema).where("text <> ''"), name)


def _grams(texts: DataFrame, size: int) -> DataFrame:
    """(text, gram) of the texts, each different gram once."""
    def run(frames):
        for f in frames:
            f["gram"] = [fuzzy.grams(x, size) for x in f["text"]]
            yield f
    return texts.select("text").mapInPandas(run, "text string, gram array<string>").select("text", F.explode("gram").alias("gram"))


def candidates(names: DataFrame, entries: DataFrame, threshold: int) -> DataFrame:
    """(text, entry): all pairs of indexed texts that can score above
    ``threshold``, but for those of a common word alone that :func:`_by_word`
    has. They share a gram of three letters; of lengths PARTIAL_MIN_LEN_RATIO
    apart, a tiny text and a longer one share one of two."""
    least = fuzzy.tiny(threshold)
    small = F.length("text") < least
    side = lambda df: df.withColumnRenamed("text", "entry")
    found = _grams(names, 3).join(side(_grams(entries, 3)), "gram").select("text", "entry")
    reach = F.length("text") < least * fuzzy.LONG_LEN_RATIO
    for a, b in ((small, reach), (reach, small)):
        found = found.unionByName(_grams(names.where(a), 2).join(side(_grams(entries.where(b), 2)), "gram").select("text", "entry"))
    sa, sb = F.length("text"), F.length("entry")
    return found.where(F.greatest(sa, sb) <= fuzzy.LONG_LEN_RATIO * F.least(sa, sb)).distinct()


def _scored(pairs: DataFrame, threshold: int) -> DataFrame:
    def run(frames):
        for f in frames:
            f["match_score"] = [fuzzy.score_above(a, b, threshold) for a, b in zip(f["text"], f["entry"])]
            yield f[f["match_score"] > threshold][["text", "ordinal", "match_score"]]
    return pairs.mapInPandas(run, "text string, ordinal long, match_score int")


def _by_word(names: DataFrame, entries: DataFrame, threshold: int) -> DataFrame:
    """The score that a common word gives texts of lengths far apart, with the
    lowest ordinal of such entries: one row a word and length of entries."""
    floor = fuzzy.WORD_FLOOR
    if floor <= threshold:
        return _empty_scores(names)
    word = F.explode(F.split("text", " "))
    first = (entries.select(word.alias("word"), F.length("text").alias("sb"), "ordinal")
             .groupBy("word", "sb").agg(F.min("ordinal").alias("ordinal")))
    ratio = F.greatest("sa", "sb") / F.least("sa", "sb")
    return (names.select("text", word.alias("word"), F.length("text").alias("sa")).join(first, "word")
            .where((ratio >= fuzzy.PARTIAL_MIN_LEN_RATIO) & (ratio <= fuzzy.LONG_LEN_RATIO))
            .groupBy("text").agg(F.min("ordinal").alias("ordinal")).withColumn("match_score", F.lit(floor)))


def _empty_scores(names: DataFrame) -> DataFrame:
    return names.where(F.lit(False)).select("text", F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("match_score"))


def _in_blocks(names: DataFrame, entries: DataFrame, threshold: int, block_rows: int) -> DataFrame:
    """All ``names`` against all ``entries``, in blocks."""
    spark = names.sparkSession
    n, m = names.count(), entries.count()
    if not n or not m:
        return _empty_scores(names)
    n_blocks = -(-m // block_rows)
    n_salts = max(-(-n // block_rows), -(-spark.sparkContext.defaultParallelism // n_blocks))
    # named partitions, which adaptive execution doesn't merge: scoring is slow, not large
    tasks = min(n_blocks * n_salts, 4 * max(spark.sparkContext.defaultParallelism,
                                            int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = (names.select("text", F.pmod(F.xxhash64("text"), F.lit(n_salts)).cast("int").alias("_s"))
            .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    right = (entries.select("ordinal", F.col("text").alias("entry"),
                            F.pmod(F.xxhash64("ordinal"), F.lit(n_blocks)).cast("int").alias("_b"))
             .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1)))))
    keys = ("_b", "_s")
    return (left.repartition(tasks, *keys).groupBy(*keys)
            .cogroup(right.repartition(tasks, *keys).groupBy(*keys))
            .applyInPandas(_scorer(threshold), "text string, ordinal long, match_score int"))


def _scorer(threshold):
    def run(names: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        cands = fuzzy.prepare(zip(entries["ordinal"], entries["entry"]))
        rows = [(n, *fuzzy.best_above(n, cands, threshold)) for n in names["text"]]
        rows = [r for r in rows if r[1] is not None]
        return pd.DataFrame(rows, columns=["text", "ordinal", "match_score"]).astype(
            {"ordinal": "int64", "match_score": "int32"})
    return run


def price_gap(products: DataFrame, matches: DataFrame) -> DataFrame:
    """TXT3: competitor price, our price - competitor, gap % of competitor."""
    m = matches.select("product_id", "competitor_price")
    out = products.join(m, "product_id", "left")
    diff = F.col("unit_price").cast("double") - F.col("competitor_price")
    return out.withColumns({
        "price_difference": money(diff),
        "price_difference_pct": money(F.try_divide(diff, F.col("competitor_price")) * 100.0),
    })
