"""TXT1: lexicon-and-rule sentiment scoring, all native Spark.

Method (Hutto & Gilbert, ICWSM 2014): every token found in a valence lexicon
contributes its valence; a booster word among the three preceding tokens adds
or removes a fixed amount (decaying with distance), a negation among them flips
and damps the valence; a contrastive "but" halves what precedes it and
amplifies what follows; "!" and "?" amplify the sum; the sum ``s`` is squashed
to ``s / sqrt(s^2 + alpha)``. "least" before a word flips it, "never so" and
"never this" strengthen what follows instead of flipping it, "without doubt"
leaves it. A phrase of the phrase table counts as one word at its first token:
it has the phrase's valence, and its tokens have none of their own; of phrases
that overlap the longer one holds, then the earlier. Text is lower-cased first,
so capitalisation rules never apply.

Plan: tokens are exploded (narrow) and matched once against a size-checked
broadcast table of words (token -> valence / booster / negation / but, or begins
a phrase). Word n-grams are built behind that match only, at tokens that begin a
phrase, and looked up in the broadcast phrases; only the hits (plus one anchor
row per review) are shuffled to group by review; overlapping
phrases are told apart by range windows of a few tokens, the other rules per
review over its sorted hit list with higher-order functions, each step linear
in the hits.
All arithmetic is DECIMAL, so results do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.functions.money import money
from tillstar.sources.tables import literal_table

# Fixed values of the method (published constants).
BOOSTER_INCREMENT = "0.293"
NEGATION_SCALAR = "-0.74"
ALPHA = 15.0
BOOSTER_DECAY = ("1.00", "0.95", "0.90")  # distance 1, 2, 3
BUT_BEFORE = "0.5"
BUT_AFTER = "1.5"
EXCLAMATION_STEP = "0.292"
EXCLAMATION_MAX = 4
QUESTION_STEP = "0.18"
QUESTION_CAP = "0.96"

NEVER_SO_SCALAR = "1.25"
INTENSE = ("so", "this")         # behind "never"
LEAST_EXEMPT = ("at", "very")    # before "least"

# Phrases of the method with a valence of their own.
DEFAULT_PHRASES = (
    ("the shit", 3.0), ("the bomb", 3.0), ("bad ass", 1.5), ("bus stop", 0.0), ("yeah right", -2.0),
    ("kiss of death", -1.5), ("to die for", 3.0), ("beating heart", 3.1), ("broken heart", -2.9),
)
MAX_PHRASE_WORDS = 3

# Our word lists (the lexicon itself is an input table).
NEGATIONS = (
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor",
    "nowhere", "cannot", "without", "ne", "pas", "jamais", "nicht", "kein",
    "nunca",
)
BOOSTERS_UP = (
    "very", "really", "extremely", "absolutely", "so", "too", "totally",
    "completely", "incredibly", "highly", "truly", "especially",
    "exceptionally", "remarkably", "particularly", "most", "more", "tres",
    "très", "sehr", "muy",
)
BOOSTERS_DOWN = (
    "slightly", "barely", "somewhat", "hardly", "little", "marginally",
    "less", "partly", "scarcely", "occasionally", "peu", "etwas", "poco",
)

# Our default lexicon (token, valence on a -4..4 scale).
DEFAULT_LEXICON = (
    ("good", 1.9), ("great", 3.1), ("excellent", 3.2), ("amazing", 2.8),
    ("love", 3.2), ("loved", 2.9), ("like", 1.5), ("nice", 1.8),
    ("happy", 2.7), ("perfect", 2.7), ("best", 3.2), ("fast", 1.0),
    ("recommend", 1.5), ("satisfied", 1.8), ("reliable", 1.6),
    ("fine", 0.8), ("ok", 0.9), ("cheap", 0.4), ("solid", 1.3),
    ("bad", -2.5), ("terrible", -2.9), ("awful", -2.9), ("poor", -2.1),
    ("worst", -3.1), ("hate", -2.7), ("broken", -1.9), ("slow", -1.1),
    ("disappointed", -1.9), ("disappointing", -2.2), ("problem", -1.7),
    ("expensive", -0.9), ("useless", -2.1), ("defective", -2.0),
    ("return", -0.4), ("refund", -0.8), ("noisy", -1.1),
    ("bon", 1.9), ("bien", 1.6), ("mauvais", -2.4), ("gut", 1.9),
    ("schlecht", -2.4), ("bueno", 1.9), ("malo", -2.4),
)

LEXICON_BROADCAST_MAX_ROWS = 1_000_000

_ACC = "decimal(30,12)"


def lexicon_frame(spark: SparkSession, entries=DEFAULT_LEXICON) -> DataFrame:
    return literal_table(spark, [(t, float(v)) for t, v in entries], "token string, valence double")


def rule_words(boosters_up=BOOSTERS_UP, boosters_down=BOOSTERS_DOWN, negations=NEGATIONS):
    """(token, boost, negation, but) rows of the fixed word lists."""
    return ([(w, 1, False, False) for w in boosters_up]
            + [(w, -1, False, False) for w in boosters_down]
            + [(w, None, True, False) for w in negations]
            + [("but", None, False, True)])


def rule_table(spark: SparkSession, lexicon: DataFrame, boosters_up=BOOSTERS_UP,
               boosters_down=BOOSTERS_DOWN, negations=NEGATIONS) -> DataFrame:
    """token -> (valence, boost +1/-1, negation flag, but flag)."""
    words = rule_words(boosters_up, boosters_down, negations)
    fixed = literal_table(spark, words, "token string, boost int, neg boolean, is_but boolean")
    fixed = fixed.groupBy("token").agg(
        F.max("boost").alias("boost"), F.max("neg").alias("neg"),
        F.max("is_but").alias("is_but"))
    lex = (lexicon.select(F.lower(F.trim("token")).alias("token"),
                          F.col("valence").cast("decimal(8,4)").alias("valence"))
           .where(F.col("token").isNotNull() & (F.col("valence") != 0))
           .groupBy("token").agg(F.max("valence").alias("valence")))
    return (lex.join(fixed, "token", "full_outer")
            .withColumns({"neg": F.coalesce("neg", F.lit(False)),
                          "is_but": F.coalesce("is_but", F.lit(False))}))


# A token is a whitespace-separated word with leading characters that are not
# letters/digits and trailing characters that are not letters/digits/apostrophes
# removed. One split does it: the delimiter absorbs such edges around the
# whitespace, and the text's own edges are stripped first.
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}']+$"
_DELIM = r"[^\p{L}\p{N}']*\s+[^\p{L}\p{N}]*"


RULE_SCHEMA = "token string, valence decimal(8,4), boost int, neg boolean, is_but boolean"


def local_rule_table(spark: SparkSession, entries=DEFAULT_LEXICON, boosters_up=BOOSTERS_UP,
                     boosters_down=BOOSTERS_DOWN, negations=NEGATIONS) -> tuple[DataFrame, int]:
    """The rule table of a literal lexicon, merged on the driver (it is a
    handful of words) and returned as a JVM local relation with its row
    count, which is the proven size bound for the broadcast. A token listed
    twice keeps its largest valence (as in :func:`rule_table`)."""
    from decimal import Decimal
    rules: dict[str, list] = {}
    for token, valence in entries:
        t = str(token).strip().lower()
        v = Decimal(str(valence)).quantize(Decimal("0.0001"))
        if t and v != 0 and (t not in rules or v > rules[t][0]):
            rules[t] = [v, None, False, False]
    for w, boost, neg, is_but in rule_words(boosters_up, boosters_down, negations):
        r = rules.setdefault(w, [None, None, False, False])
        if boost is not None:
            r[1] = boost if r[1] is None else max(r[1], boost)
        r[2] = r[2] or neg
        r[3] = r[3] or is_but
    rows = [(t, *r) for t, r in sorted(rules.items())]
    return literal_table(spark, rows, RULE_SCHEMA), len(rows)


def tokenize(text: Column) -> Column:
    """Lower-cased whitespace tokens with edge punctuation stripped."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), _EDGES, "")
    return F.array_remove(F.split(t, _DELIM), "")


def _count_char(text: Column, ch: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def _neighbour(hits: Column, j: Column, pos: Column, k: int) -> Column:
    """The hit exactly ``k`` tokens before position ``pos`` (hits are sorted
    by position, so it can only be one of the three preceding hits)."""
    cands = [F.get(hits, j - d) for d in (1, 2, 3)]
    expr = None
    for c in cands:
        cond = c.isNotNull() & (c["pos"] == pos - k)
        expr = F.when(cond, c) if expr is None else expr.when(cond, c)
    return expr


def _token_valence(hits: Column, h: Column, j: Column) -> Column:
    """Valence of hit ``h`` (index ``j``) after booster and negation rules.

    For distance k = 1, 2, 3 in turn: a booster adds its decayed step in the
    direction of the current valence, then a negation multiplies by the
    negation scalar (so an earlier flip changes the direction of a later
    booster). Folded with ``aggregate`` so the expression stays linear.
    """
    ctx = []
    for k, decay in zip((1, 2, 3), BOOSTER_DECAY):
        n = _neighbour(hits, j, h["pos"], k)
        step = (F.lit(BOOSTER_INCREMENT).cast("decimal(6,3)")
                * F.lit(decay).cast("decimal(4,2)"))
        bstep = F.when(n.isNotNull() & n["valence"].isNull() & n["boost"].isNotNull(),
                       n["boost"].cast("decimal(2,0)") * step).otherwise(F.lit(0))
        flip = F.lit(NEGATION_SCALAR) if k == 1 else (
            F.when(h[f"x{k}"] == 1, F.lit(NEVER_SO_SCALAR)).when(h[f"x{k}"] == 2, F.lit("1")).otherwise(F.lit(NEGATION_SCALAR)))
        nmult = F.when(n.isNotNull() & F.coalesce(n["neg"], F.lit(False)), flip).otherwise(F.lit("1"))
        ctx.append(F.struct(bstep.cast("decimal(12,6)").alias("b"),
                            nmult.cast("decimal(4,2)").alias("n")))
    least = F.when(h["least"], F.lit(NEGATION_SCALAR)).otherwise(F.lit("1"))
    ctx.append(F.struct(F.lit(0).cast("decimal(12,6)").alias("b"), least.cast("decimal(4,2)").alias("n")))
    v0 = F.when(h["boost"].isNull(), h["valence"]).cast(_ACC)
    return F.aggregate(
        F.array(*ctx), v0,
        lambda acc, c: ((acc + F.signum(acc).cast("decimal(2,0)") * c["b"]) * c["n"]).cast(_ACC))


def _known_phrases(phrases: DataFrame) -> DataFrame:
    """(_p, _v): each phrase once, with its largest valence."""
    return (phrases.select(F.lower(F.trim("phrase")).alias("_p"), F.col("valence").cast("decimal(8,4)").alias("_v"))
            .groupBy("_p").agg(F.max("_v").alias("_v")))


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= LEXICON_BROADCAST_MAX_ROWS else df


def _with_phrases(tokens: DataFrame, known: DataFrame | None, n_known: int = 0) -> DataFrame:
    """``tokens`` with the longest phrase that begins at each (p_len, p_val):
    a join of their token n-grams with the phrase table, by length."""
    if known is None:
        return tokens.withColumns({"p_len": F.lit(None).cast("int"), "p_val": F.lit(None).cast("decimal(8,4)")})
    out, lens, vals = tokens, [], []
    for k in range(MAX_PHRASE_WORDS, 1, -1):
        side = known.select(F.col("_p").alias(f"_g{k}"), F.col("_v").alias(f"_v{k}"))
        out = out.join(_bounded(side, n_known), f"_g{k}", "left")
        lens.append(F.when(F.col(f"_v{k}").isNotNull(), F.lit(k)))
        vals.append(F.col(f"_v{k}"))
    return out.withColumns({"p_len": F.coalesce(*lens), "p_val": F.coalesce(*vals)})


def _phrases_held(hits: DataFrame, review: list[str]) -> DataFrame:
    """The hits of each review with their phrases in force: a phrase that no better
    one overlaps gives its first token its valence and silences all its tokens.
    Phrases are short, so only those that begin a few tokens away are looked at."""
    order = Window.partitionBy(*review).orderBy("pos")
    lens = range(2, MAX_PHRASE_WORDS + 1)

    def begins(flag: Column, first: int, last: int) -> Column:
        """Whether a hit with ``flag`` is ``first`` to ``last`` tokens from this one."""
        return F.coalesce(F.max(flag).over(order.rangeBetween(first, last)), F.lit(False))

    def better(n: int) -> Column:
        found = begins(F.col("p_len") == n, 1 - n, -1) if n > 1 else F.lit(False)
        for m in range(n + 1, MAX_PHRASE_WORDS + 1):
            found = found | begins(F.col("p_len") == m, 1 - m, n - 1)
        return found
    beaten = None
    for n in lens:
        beaten = F.when(F.col("p_len") == n, better(n)) if beaten is None else beaten.when(F.col("p_len") == n, better(n))
    held = hits.withColumn("_held", F.when(~beaten, F.col("p_len")))
    inside, starts = F.lit(False), begins(F.col("_held").isNotNull(), 0, 0)
    for n in lens:
        inside = inside | begins(F.col("_held") == n, 1 - n, 0)
    held = held.withColumns({"_inside": inside, "_starts": starts})
    free = ~F.col("_inside")
    return held.withColumns({
        "valence": F.when(F.col("_starts"), F.col("p_val")).when(free, F.col("valence")),
        "boost": F.when(free, F.col("boost")), "neg": F.col("neg") & free, "is_but": F.col("is_but") & free,
    }).drop("_held", "_inside", "_starts")


def phrase_frame(spark: SparkSession, entries=DEFAULT_PHRASES) -> DataFrame:
    return literal_table(spark, [(t, float(v)) for t, v in entries], "phrase string, valence double")


def score_reviews(reviews: DataFrame, rules: DataFrame, *, id_col: str = "review_id",
                  text_col: str = "review_text",
                  keep: tuple[str, ...] = ("product_id", "rating"),
                  n_rules: int | None = None, phrases: DataFrame | None = None,
                  n_phrases: int | None = None) -> DataFrame:
    """Per-review compound score in [-1, 1], rounded to 2 digits (DECIMAL).

    Output: ``id_col``, ``keep`` columns, ``sentiment_score``. ``n_rules`` and
    ``n_phrases`` are the known sizes of ``rules`` and ``phrases`` (counted here
    when not given). ``phrases``: (phrase, valence), of two to MAX_PHRASE_WORDS
    tokens.
    """
    if n_rules is None:
        n_rules = rules.count()
    known = None
    words, n_words = rules.withColumn("_begins", F.lit(False)), n_rules
    if phrases is not None:
        n_phrases = phrases.count() if n_phrases is None else n_phrases
        known = _known_phrases(phrases)
        begins = known.select(F.substring_index("_p", " ", 1).alias("token"), F.lit(True).alias("_begins")).distinct()
        words, n_words = rules.join(begins, "token", "full_outer"), n_rules + n_phrases

    base = reviews.select(
        F.col(id_col), *[F.col(c) for c in keep],
        F.least(_count_char(F.col(text_col), "!"), F.lit(EXCLAMATION_MAX)).alias("_excl"),
        _count_char(F.col(text_col), "?").alias("_qm"),
        tokenize(F.col(text_col)).alias("_toks"),
    )
    exploded = base.select(id_col, *keep, "_excl", "_qm", "_toks", F.posexplode_outer("_toks").alias("pos", "token"))
    neg_pattern = F.coalesce(F.col("token").endswith("n't"), F.lit(False))
    matched = (exploded.join(_bounded(words, n_words), "token", "left")
               .withColumn("neg", F.coalesce(F.col("neg"), F.lit(False)) | neg_pattern)
               .withColumn("is_but", F.coalesce(F.col("is_but"), F.lit(False)))
               .withColumn("_begins", F.coalesce(F.col("_begins"), F.lit(False))))
    by_rule = F.col("valence").isNotNull() | F.col("boost").isNotNull() | F.col("neg") | F.col("is_but")
    anchor = F.col("pos").isNull() | (F.col("pos") == 0)
    matched = matched.where(by_rule | F.col("_begins") | anchor)
    # the tokens before each one that is left, and the n-grams that may be phrases
    before = [F.get("_toks", F.col("pos") - k) for k in (1, 2, 3)]
    one = lambda k, *words: F.coalesce(before[k - 1].isin(*words), F.lit(False))
    never = lambda k, so: (F.when(one(k, "never") & so(*INTENSE), 1)
                           .when(one(k, "without") & so("doubt"), 2).otherwise(0))
    grams = [F.when(F.col("_begins") & (F.size("_toks") >= F.col("pos") + k),
                    F.array_join(F.slice("_toks", F.col("pos") + 1, k), " ")).alias(f"_g{k}")
             for k in range(2, MAX_PHRASE_WORDS + 1)]
    review = [id_col, *keep, "_excl", "_qm"]
    matched = matched.select(
        *review, "pos", "valence", "boost", "neg", "is_but", never(2, lambda *w: one(1, *w)).alias("x2"),
        never(3, lambda *w: one(1, *w) | one(2, *w)).alias("x3"),
        (one(1, "least") & ~one(2, *LEAST_EXEMPT)).alias("least"), *(grams if known is not None else []))
    joined = _with_phrases(matched, known, n_phrases)
    is_hit = by_rule | F.col("p_len").isNotNull()
    hits = joined.where(is_hit | anchor)
    hits = hits.withColumns({"_hit": is_hit, "_own": F.struct("valence", "boost", "neg", "is_but")})
    if known is not None:
        hits = _phrases_held(hits, review)
    # of hits at one place (reviews that share a key) the order is that of the words' own rules
    per_review = hits.groupBy(*review).agg(
        F.array_sort(F.collect_list(F.when(F.col("_hit"), F.struct(
            F.col("pos").cast("int").alias("pos"), F.col("_own"), F.col("x2"), F.col("x3"), F.col("least"),
            F.col("p_len"), F.col("p_val"), F.col("valence"), F.col("boost"), F.col("neg"), F.col("is_but"))))
        ).alias("_hits"))

    hits_c = F.col("_hits")
    per_review = per_review.withColumn("_but", F.array_min(F.transform(
        F.filter(hits_c, lambda h: h["is_but"]), lambda h: h["pos"])))
    but_pos = F.col("_but")
    raw = F.transform(hits_c, lambda h, j: F.when(
        h["valence"].isNotNull(), _token_valence(hits_c, h, j)))
    but_factor = lambda p: (
        F.when(but_pos.isNull() | (p == but_pos), F.lit("1.0"))
        .when(p < but_pos, F.lit(BUT_BEFORE)).otherwise(F.lit(BUT_AFTER))
        .cast("decimal(2,1)"))
    per_review = per_review.withColumn("_vals", F.transform(raw, lambda v, j: (
        v * but_factor(F.get(hits_c, j)["pos"])).cast(_ACC)))
    per_review = per_review.withColumn("_total", F.aggregate(
        F.col("_vals"), F.lit(0).cast(_ACC),
        lambda acc, x: (acc + F.coalesce(x, F.lit(0).cast(_ACC))).cast(_ACC)))
    total = F.col("_total")

    qm = F.col("_qm")
    punct = (F.col("_excl").cast("decimal(4,0)") * F.lit(EXCLAMATION_STEP).cast("decimal(4,3)")
             + F.when(qm <= 1, F.lit(0))
             .when(qm <= 3, qm.cast("decimal(4,0)") * F.lit(QUESTION_STEP).cast("decimal(3,2)"))
             .otherwise(F.lit(QUESTION_CAP).cast("decimal(3,2)"))).cast(_ACC)
    s = (F.when(total > 0, total + punct).when(total < 0, total - punct)
         .otherwise(total)).cast("double")
    compound = s / F.sqrt(s * s + F.lit(ALPHA))
    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), compound))
    score = F.round(compound.cast("decimal(38,6)"), 2).cast("decimal(5,2)")
    return per_review.select(id_col, *keep, score.alias("sentiment_score"))


def product_sentiment(scored: DataFrame) -> DataFrame:
    """Per product: mean score, mean rating (2 digits) and review count.

    Reviews without a product are dropped (as a pandas group-by drops NULL
    keys); the count includes reviews with empty text (they score 0)."""
    return (scored.where(F.col("product_id").isNotNull())
            .groupBy("product_id")
            .agg(money(F.sum("sentiment_score").cast("double") / F.count(F.lit(1)))
                 .alias("avg_sentiment"),
                 money(F.avg(F.col("rating").cast("double"))).alias("avg_rating"),
                 F.count(F.lit(1)).alias("review_count")))


def analyze_sentiment(reviews: DataFrame, lexicon=None,
                      boosters_up=BOOSTERS_UP, boosters_down=BOOSTERS_DOWN,
                      negations=NEGATIONS, phrases=None) -> DataFrame:
    """TXT1 end to end: reviews(review_id, product_id, rating, review_text)
    -> (product_id, avg_sentiment, avg_rating, review_count).

    ``lexicon``: a DataFrame (token, valence), or literal (token, valence)
    pairs, or None for the default lexicon. ``phrases``: a DataFrame (phrase,
    valence), or literal pairs, or None for the method's own phrases."""
    spark = reviews.sparkSession
    n_phrases = None
    if not isinstance(phrases, DataFrame):
        entries = list(DEFAULT_PHRASES if phrases is None else phrases)
        phrases, n_phrases = phrase_frame(spark, entries), len(entries)
    if isinstance(lexicon, DataFrame):
        rules, n = rule_table(spark, lexicon, boosters_up, boosters_down, negations), None
    else:
        rules, n = local_rule_table(spark, lexicon if lexicon is not None else DEFAULT_LEXICON,
                                    boosters_up, boosters_down, negations)
    reviews = reviews.withColumn("rating", F.col("rating").try_cast(T.DoubleType()))
    return product_sentiment(score_reviews(reviews, rules, n_rules=n, phrases=phrases, n_phrases=n_phrases))
