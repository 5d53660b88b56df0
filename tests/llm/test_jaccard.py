import random

import numpy as np
from corpus import corpus, frame, lower, space_words, twins, words

from tillstar.llm import jaccard as J


def shingles(t, k):
    w = space_words(lower(t))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (rows[i][0], rows[j][0]) and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                par[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        comp[r] = d if comp.get(r) is None else min(comp[r], d if d is not None else comp[r])
    return [(rows[i][0], len(sets[i]), comp[find(i)]) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=str)


def test_matches_brute_force(spark):
    rows = corpus() + [(None, corpus()[3][1])]
    for k, num, den in ((4, 85, 100), (5, 80, 100), (2, 75, 100)):
        got = J.near_duplicates(frame(spark, rows), words=k, num=num, den=den).select("id", "n_shingles", "component_id")
        assert order(map(tuple, got.collect())) == order(brute(rows, k, num, den))


def test_large_group_of_near_copies_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "HEAVY_IN_BATCH", 2)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):      # unlinked versions of one text, pairs of them linked
        w = list(base)
        for _ in range(6):
            w[rng.randrange(60)] = f"x{i}-{rng.random()}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "end"]))]
    got = J.near_duplicates(frame(spark, rows, False), words=2, num=80, den=100).select("id", "n_shingles", "component_id")
    assert order(map(tuple, got.collect())) == order(brute(rows, 2, 80, 100))


def test_tree_drops_only_what_cannot_link():
    rng = np.random.default_rng(0)
    sets = [set(rng.integers(0, 300, rng.integers(5, 80)).tolist()) for _ in range(150)]
    sets += [set(list(s)[1:]) for s in sets[:60]]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), J.SIG_BITS), bool)
    for i, s in enumerate(sets):
        bits[i, [x * 7919 % J.SIG_BITS for x in s]] = True
    sig = np.packbits(bits, axis=1).view(np.uint64)
    tree = J.Tree(sig, n, np.arange(len(n)))
    found = {(int(a), int(b)) for i, j in J.traverse(tree, tree, 80, 100) for a, b in zip(i, j)}
    want = {(i, j) for j in range(len(sets)) for i in range(j)
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want and want <= found
    assert len(found) < len(sets) * (len(sets) - 1) / 8


def test_empty_table_and_stage(spark):
    assert J.near_duplicates(frame(spark, [])).collect() == []
    rows = corpus() + [(None, "some text of a null id"), (None, "some text of a null id")]
    kept = J.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    comp = {d: c for d, n, c in brute(rows, 5, 80, 100) if n}
    want = sorted(({d for d, c in comp.items() if d == c and d is not None}
                   | {d for d, n, _ in brute(rows, 5, 80, 100) if not n}), key=str)
    got = [r.doc_id for r in kept.collect()]
    assert sorted((d for d in got if d is not None), key=str) == want
    assert got.count(None) == 2
    assert words(1, random.Random(1))


def test_one_row_stays_of_each_group_under_one_id(spark):
    rng = random.Random(61)
    a, b, c = (words(60, rng) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (6, a + " more"), (7, c), (8, c), (9, b + " end"), (9, words(60, rng))]
    kept = J.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a), (5, b), (7, c), (9, rows[7][1])])


def test_of_repeated_rows_the_same_one_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, f"s{k}") for k in range(8)]
    kept = {tuple(tuple(r) for r in J.keep_one(spark.createDataFrame(x, "doc_id long, text string, source string")
                                                     .repartition(n)).collect())
            for x, n in ((rows, 1), (rows[::-1], 3), (rows[4:] + rows[:4], 5))}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_texts_made_to_collide_do_not_link(spark):
    rows = list(enumerate([x for n in (1024, 2048, 4096) for x in twins(n)]))
    got = J.near_duplicates(frame(spark, rows)).select("id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(6)]


def test_forest_joins_what_its_pairs_join():
    rng = random.Random(4)
    comp = np.array([rng.randrange(1000) * 7 for _ in range(60)])
    pairs = [(rng.choice(comp), rng.choice(comp)) for _ in range(45)]
    forest, kept = J.Forest(comp), []
    for s in range(0, 45, 9):
        x, y = map(np.array, zip(*pairs[s:s + 9]))
        kept += [pairs[s + k] for k in forest.take(x, y)]

    def parts(edges):
        of = {c: {c} for c in set(comp)}
        for a, b in edges:
            both = of[a] | of[b]
            for c in both:
                of[c] = both
        return {frozenset(v) for v in of.values()}
    assert parts(kept) == parts(pairs) and len(kept) == len(set(comp)) - len(parts(pairs))
