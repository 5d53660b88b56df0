"""Lexicon-and-rule sentiment (TXT1) on literal reviews."""
from helpers import rows
from tillstar.operators import sentiment as S


def _scores(spark, texts):
    df = spark.createDataFrame([(i, 1, 3.0, t) for i, t in enumerate(texts)],
                               "review_id long, product_id long, rating double, review_text string")
    rules = S.rule_table(spark, S.lexicon_frame(spark))
    out = {r["review_id"]: float(r["sentiment_score"])
           for r in S.score_reviews(df, rules, phrases=S.phrase_frame(spark)).collect()}
    return [out[i] for i in range(len(texts))]


def test_rules(spark):
    got = _scores(spark, [
        "This is good",            # 1.9 / sqrt(1.9^2 + 15)
        "not good",                # negation flips and damps
        "very good!!",             # booster + exclamation
        None, "", "   ",           # empty -> 0
        "good but terrible",       # contrastive but
        "I don't love it, it is extremely bad??",
        "...Good...",              # edge punctuation stripped, lower-cased
        "kind words only",         # no lexicon word
    ])
    assert got == [0.44, -0.34, 0.58, 0.0, 0.0, 0.0, -0.66, -0.82, 0.44, 0.0]


def test_product_aggregate(spark):
    df = spark.createDataFrame([
        (1, 10, 5.0, "good"), (2, 10, None, "bad"), (3, 10, 4.0, ""), (4, None, 1.0, "good"),
    ], "review_id long, product_id long, rating double, review_text string")
    got = rows(S.analyze_sentiment(df))
    # mean of (0.44, -0.54, 0.0) = -0.0333 -> -0.03; rating mean skips NULL
    assert got == [(10, -0.03, 4.5, 3)]


def test_local_rules_equal_distributed_rules(spark):
    lex = (("good", 1.9), ("Good ", 2.5), ("very", 1.0), ("zero", 0.0), ("bad", -2.5))
    local, n = S.local_rule_table(spark, lex)
    dist = S.rule_table(spark, S.lexicon_frame(spark, lex))
    cols = ("token", "valence", "boost", "neg", "is_but")
    assert n == local.count()
    assert rows(local, *cols) == rows(dist.select(*cols), *cols)


def _compound(v):
    return round(v / (v * v + 15) ** 0.5, 2)


def test_least_never_so_and_without_doubt(spark):
    good, bad = 1.9, -2.5
    so = 1.9 + 0.293
    got = _scores(spark, [
        "the least good", "at least good", "very least good", "least good",
        "never so good", "never this good", "never so very good", "never good", "so never good",
        "without doubt good", "without a doubt good", "without good", "least bad"])
    very = 1.9 + 0.293 + 0.293 * 0.95
    assert got == [_compound(x) for x in (
        good * -0.74, good, good + 0.293 * 0.95, good * -0.74,
        so * 1.25, good * 1.25, very * 1.25, good * -0.74, (good * -0.74) - 0.293 * 0.95,
        good, good, good * -0.74, bad * -0.74)]


def test_phrases(spark):
    got = _scores(spark, ["a kiss of death", "very bad ass", "not to die for", "bus stop good", "yeah right, good",
                          "broken heart", "a broken part", "Kiss, of -- DEATH!", "bad"])
    assert got == [_compound(x) for x in (
        -1.5, 1.5 + 0.293, 3.0 * -0.74, 1.9, -2.0 + 1.9, -2.9, -1.9, -1.5 - 0.292, -2.5)]


def test_longer_and_earlier_phrases_hold(spark):
    df = spark.createDataFrame([(1, 1, 3.0, "x a b c y"), (2, 1, 3.0, "a b a"), (3, 1, 3.0, "b c d")],
                               "review_id long, product_id long, rating double, review_text string")
    phrases = S.phrase_frame(spark, (("a b", 1.0), ("a b c", 2.0), ("b c", 3.0), ("b a", -3.0), ("c d", -1.0)))
    rules = S.rule_table(spark, S.lexicon_frame(spark, (("c", 9.0), ("a", 9.0), ("d", 4.0))))
    got = {r["review_id"]: float(r["sentiment_score"]) for r in S.score_reviews(df, rules, phrases=phrases).collect()}
    assert got == {1: _compound(2.0), 2: _compound(1.0 + 9.0), 3: _compound(3.0 + 4.0)}


def test_long_reviews_full_of_phrases(spark):
    import time
    # 4,000 phrases in one review: work that grows with their square or cube doesn't end here
    df = spark.createDataFrame([(1, 1, 3.0, "a b c d " * 2000 + "good"), (2, 1, 3.0, "a b a b a")],
                               "review_id long, product_id long, rating double, review_text string")
    phrases = S.phrase_frame(spark, (("a b", 1.0), ("c d", -1.0)))
    rules = S.rule_table(spark, S.lexicon_frame(spark))
    t = time.perf_counter()
    got = {r["review_id"]: float(r["sentiment_score"]) for r in S.score_reviews(df, rules, phrases=phrases).collect()}
    assert got == {1: _compound(1.9), 2: _compound(2.0)}
    assert time.perf_counter() - t < 60


def test_overlapping_phrases_by_brute_force(spark):
    import random
    rnd = random.Random(5)
    table = {"a b": 1.0, "b a": -2.0, "a a b": 0.5, "b b b": 1.5, "b a a": -0.7, "c c": 3.0, "c a": 0.3}
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(150)]
    want = []
    for t in texts:
        words, found = t.split(), []
        for i in range(len(words)):
            for k in (3, 2):
                if " ".join(words[i:i + k]) in table and i + k <= len(words):
                    found.append((i, k))
                    break
        held = [(i, k) for i, k in found if not any(
            j < i + k and i < j + m and (m > k or m == k and j < i) for j, m in found)]
        at = {i: table[" ".join(words[i:i + k])] for i, k in held}
        inside = {x for i, k in held for x in range(i, i + k)}
        s = sum(at.get(i, 0 if i in inside or w != "a" else 0.9) for i, w in enumerate(words))
        want.append(_compound(s))
    df = spark.createDataFrame([(i, 1, 3.0, t) for i, t in enumerate(texts)],
                               "review_id long, product_id long, rating double, review_text string")
    rules = S.rule_table(spark, S.lexicon_frame(spark, (("a", 0.9),)))
    out = S.score_reviews(df, rules, phrases=S.phrase_frame(spark, table.items())).collect()
    got = {r["review_id"]: float(r["sentiment_score"]) for r in out}
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 0.0101      # halves round apart


def test_only_hits_are_shuffled(spark):
    df = spark.createDataFrame([(1, 1, 3.0, "yeah right, not so good"), (2, 1, 3.0, "kiss of death")],
                               "review_id long, product_id long, rating double, review_text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # as for tables whose size the planner can't see
    try:
        out = S.score_reviews(df, S.rule_table(spark, S.lexicon_frame(spark)), phrases=S.phrase_frame(spark))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["review_id"]: float(r["sentiment_score"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = plan[:plan.index("Generate posexplode")]      # what the tokens pass on their way up
    assert "SortMergeJoin" not in above and above.count("BroadcastHashJoin") == 3
    assert got == {1: _compound(-2.0 + (1.9 + 0.293) * -0.74), 2: _compound(-1.5)}
