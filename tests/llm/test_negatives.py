"""Hard negatives against brute force over all pairs."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstar.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, cell string, id string, q string"


def brute(rows, every, positives=5, wanted=3, least=50, most=95):
    pts = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        pts.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in pts:
        if i % every:
            continue
        near = sorted((-dot(v, w), j) for j, m, w in pts if m == label and j != i)[:positives]
        far = sorted((-dot(v, w), j) for j, m, w in pts if m != label)
        for s, j in near:
            fit = [(t, k) for t, k in far if least * -s <= 100 * -t <= most * -s][:wanted]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def sample(seed, n=260, d=7):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), [rng.gauss(0, 1) + (3 if c == i % 5 else 0) for c in range(d)]) for i in range(n)]
    rows += [(i, rng.randrange(2), [1.0] * d) for i in range(n, n + 120)]                   # a hot vector
    rows += [(i, rng.randrange(3), [float(rng.randrange(-1, 2)) for _ in range(d)]) for i in range(n + 120, n + 200)]  # ties
    rows += rows[:9] + [(10, 3, [0.5] * d), (20, 1, [0.25] * d)]                            # repeated rows and ids
    rows += [(900, None, [1.0] * d), (910, 1, None), (920, 1, [1.0] * (d - 1) + [float("nan")]), (930, 1, [None] + [1.0] * (d - 1)),
             (940, 1, [float("inf")] * d), (None, 1, [1.0] * d), (950, 1, []), (960, 2, [1.0, 2.0]), (970, 77, [9.0] * d),
             (-30, 1, [2.0] * d), (980, 1, [0.0] * d)]
    return rows


@pytest.mark.parametrize("seed, per_cell, share", [(1, 2, 40), (2, 40, 9), (3, 10 ** 6, 10 ** 6)])
def test_equals_brute_force(spark, monkeypatch, seed, per_cell, share):
    monkeypatch.setattr(negatives, "FIRST_CELLS", 2)
    rows = sample(seed)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(df, F.col("id") % 10 == 0, rows_per_cell=per_cell, sample=share)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_other_windows(spark):
    rows = sample(4, n=90, d=1)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("id") % 5 == 0, positives=2, negatives=9, least=0, most=100, rows_per_cell=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 2, 9, 0, 100)


def test_no_rows_no_anchors_and_large_components(spark):
    df = spark.createDataFrame([(1, 1, [1.0], "x", "y", "z")], SCHEMA)
    assert negatives.mine(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert negatives.mine(df, F.col("id") % 50 == 0).collect() == []
    assert negatives.mine(df, F.col("id") == 1).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(spark.createDataFrame([(50, 1, [1e30], "x", "y", "z")], SCHEMA), F.col("id") % 50 == 0).collect()


def test_products_past_53_bits():
    a = np.array([[(1 << 23) - 1] * 64, [1 - (1 << 23)] * 64], float)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in a] for r in a]
    assert negatives._products(a, a).tolist() == want


def test_heap_gives_all_cells_by_falling_bound():
    rng = np.random.default_rng(1)
    index = negatives.Index([np.zeros((9, 2)), np.zeros((7, 2))])
    index.cells = set(range(0, 63, 2))
    a, b = rng.normal(size=9).round(1), rng.normal(size=7).round(1)
    got = list(index.walk(a, b))
    assert sorted(i * 7 + j for _, i, j in got) == sorted(index.cells)
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)
    assert all(s == a[i] + b[j] for s, i, j in got)


def test_queries_in_batches(spark, monkeypatch):
    monkeypatch.setattr(negatives, "FIRST_CELLS", 2)
    monkeypatch.setattr(negatives, "BATCH_QUERIES", 9)
    rows = sample(6)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("id") % 10 == 0, rows_per_cell=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_visits_are_not_broadcast(spark, monkeypatch):
    plans, plain = [], negatives.common.map_batches

    def seen(df, fn, schema):
        if "cell" in df.columns and "ids" in df.columns:
            plans.append(df._jdf.queryExecution().toString())
        assert "binary" not in schema or "cell" not in schema or schema.startswith("cell long, d1")
        return plain(df, fn, schema)
    monkeypatch.setattr(negatives.common, "map_batches", seen)
    rows = sample(7, n=120)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    negatives.mine(df, F.col("id") % 10 == 0, rows_per_cell=20).collect()
    assert plans and all("SortMergeJoin" in p for p in plans)
