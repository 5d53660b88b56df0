"""Hard-negative mining over an inverted multi-index.

Vectors are cut in two halves with a codebook each (k-means on a bounded
sample); a pair of codes is a cell, and every row is in one. For a query, a
half's code bounds that half of the score from above: the query's half times
the centroid, plus its length times the code's radius (over all its rows). The
multi-sequence heap gives a query's cells by falling sum of the two bounds. A
window wants the best rows between two scores, of the query's label or of the
others; it is certified, and the walk of its query ends, once it is full and no
cell that is left can beat its last row, or none can reach its lower end. So
results are exact, whatever the sample; only the number of visits depends on it.

The walk is done in rounds of Spark jobs with four times as many cells in each:
the tasks walk blocks of queries, join the visits with the cells' rows (in
blocks of about BLOCK_ROWS), score block by block as matrix products, and keep
the best of each window. A visit names its block of queries only; the blocks
themselves, of BATCH_QUERIES queries at most, are broadcast, and more queries are
searched batch by batch. Only they, codebooks, radii and the list of cells (at
most MAX_CODES squared) go through the driver.

Of rows that are equal in label and vector only as many as a window wants are
kept, those of least id: others can never come before them. So one vector that
holds a third of all rows costs nothing, and is one query.

Rows with a null id, label or vector, or with a component that is null or not
finite, take no part. Rows equal in id, label and vector are one row; an
anchor's other rows are those of another id. Shorter vectors are filled up with
zeros. A component beyond MAX_COMPONENT is an error, since scores would pass 64
bits. Empty tables, or no anchors, give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that codebooks are fitted on.
SAMPLE = 20_000
MAX_CODES = 256
ROWS_PER_CELL = 512
BLOCK_ROWS = 512
#: Queries scored at once.
QUERY_BLOCK = 128
#: Queries whose blocks are broadcast at once: some 500 bytes each for 64 components.
BATCH_QUERIES = 1 << 15
#: Cells a query visits in the first round; four times as many in each next.
FIRST_CELLS = 4
MAX_COMPONENT = 1 << 23
_NONE = -(1 << 62)


def quantise(rows: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """(id, label, v: int32 little-endian components floor(256 x)) of the rows
    that take part, different ones."""
    x = F.col(vector)
    usable = x.isNotNull() & F.col(vec_id).isNotNull() & label.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(usable).select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
                                     x.cast("array<double>").alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0          # one row

    def run(b):
        x = b.column("x")
        flat = np.floor(256 * x.flatten().to_numpy(zero_copy_only=False))
        if len(flat) and np.abs(flat).max() >= MAX_COMPONENT:
            raise ValueError(f"components of {MAX_COMPONENT >> 8} or more would give scores past 64 bits")
        out = np.zeros((b.num_rows, width), "<i4")
        size = np.diff(x.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("label"), pa.array([r.tobytes() for r in out], pa.binary())],
            names=["id", "label", "v"])
    return common.map_batches(rows, run, "id long, label long, v binary")


def _matrix(v) -> np.ndarray:
    """Vectors of a binary column or list as a float64 matrix."""
    v = v.to_pylist() if isinstance(v, (pa.Array, pa.Scalar)) else v
    return np.frombuffer(b"".join(v), "<i4").reshape(len(v), -1).astype(np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids; the empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


class Index:
    """Codebooks, radii and cells: what the walk needs, on each worker."""

    def __init__(self, books: list[np.ndarray]):
        self.books, self.half = books, books[0].shape[1]
        self.radii = [np.zeros(len(b)) for b in books]
        self.cells: set[int] = set()

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.half], x[:, self.half:]]

    def code(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(code, distance to its centroid) by half."""
        out = []
        for part, book in zip(self.halves(x), self.books):
            at = _nearest(part, book)
            out.append((at, np.sqrt(((part - book[at]) ** 2).sum(1))))
        return out

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(greatest, least) half score of each query with each code, a little
        wider than the sums' rounding."""
        out = []
        for part, book, radius in zip(self.halves(x), self.books, self.radii):
            mid = part @ book.T
            reach = np.sqrt((part ** 2).sum(1))[:, None] * radius
            slack = 1e-9 * (np.abs(mid) + reach) + 1e-6
            out.append((mid + reach + slack, mid - reach - slack))
        return out

    def walk(self, high1: np.ndarray, high2: np.ndarray):
        """(bound, code, code) of the cells that have rows, by falling bound:
        the multi-sequence heap over the two sorted halves."""
        o1, o2 = np.argsort(-high1, kind="stable"), np.argsort(-high2, kind="stable")
        a, b, width = high1[o1].tolist(), high2[o2].tolist(), len(o2)
        o1, o2 = o1.tolist(), o2.tolist()
        heap, given = [(-(a[0] + b[0]), 0, 0)], set()
        while heap:
            s, i, j = heapq.heappop(heap)
            given.add((i, j))
            # a pair enters once both pairs before it are out
            if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in given):
                heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
            if j + 1 < width and (i == 0 or (i - 1, j + 1) in given):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if o1[i] * width + o2[j] in self.cells:
                yield -s, o1[i], o2[j]


def build(rows: DataFrame, sample: int = SAMPLE, rows_per_cell: int = ROWS_PER_CELL) -> tuple[Index | None, DataFrame]:
    """(the index, blocks of rows: cell, ids, labels, vs) of ``rows`` (id,
    label, v); (None, ...) without rows. Every row is in one block."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("v", "id")).limit(sample).select("v").toArrow().column("v").to_pylist()   # bounded
    if not first:
        return None, rows
    x = _matrix(first)
    k = int(min(MAX_CODES, max(1, round((rows.count() / rows_per_cell) ** 0.5))))
    half = (x.shape[1] + 1) // 2
    index = Index([kmeans(x[:, :half], k), kmeans(x[:, half:], k)])
    given = spark.sparkContext.broadcast(index)

    def run(b):
        (i, di), (j, dj) = given.value.code(_matrix(b.column("v")))
        yield pa.RecordBatch.from_arrays(
            [pa.array((i * len(given.value.books[1]) + j).astype(np.int64)), pa.array(di), pa.array(dj), *b.columns],
            names=["cell", "d1", "d2", "id", "label", "v"])
    coded = common.cut(common.map_batches(rows, run, "cell long, d1 double, d2 double, id long, label long, v binary"),
                       "negatives-rows")
    # one row a cell, MAX_CODES squared at most
    cells = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2"))
    width = len(index.books[1])
    for r in cells.collect():
        index.cells.add(r.cell)
        for radius, code, d in ((index.radii[0], r.cell // width, r.d1), (index.radii[1], r.cell % width, r.d2)):
            radius[code] = max(radius[code], d)
    part = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
    blocks = (coded.join(cells.select("cell", "n"), "cell").withColumn("part", part)
              .groupBy("cell", "part").agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
              .select("cell", F.col("rows.id").alias("ids"), F.col("rows.label").alias("labels"),
                      F.col("rows.v").alias("vs")))
    return index, common.cut(blocks, "negatives-blocks")


_BLOCK = "b long, q array<long>, ql array<long>, qv array<binary>, w array<array<long>>, lo array<array<long>>, hi array<array<long>>"
_VISIT = "cell long, b long, n array<int>"


def search(index: Index, blocks: DataFrame, queries: DataFrame, wanted: int, same: bool) -> DataFrame:
    """(q, w, s, id): the best ``wanted`` rows of each window, by falling score
    ``s`` and rising id. ``queries``: q, label, v and ``windows``, an array of
    (w, lo, hi): rows of the query's label (``same``) or of the others whose
    score is between lo and hi."""
    spark = queries.sparkSession
    known = spark.sparkContext.broadcast(index)
    batches = max(1, -(-queries.count() // BATCH_QUERIES))
    out = None
    for k in range(batches):
        part = queries if batches == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(batches)) == k)
        best = _search(index, known, blocks, part, wanted, same)
        out = best if out is None else out.unionByName(best)
    return out


def _search(index: Index, known, blocks: DataFrame, queries: DataFrame, wanted: int, same: bool) -> DataFrame:
    spark = queries.sparkSession
    best, done, size = None, 0, FIRST_CELLS
    while done < len(index.cells):
        todo = queries if best is None else _narrowed(queries, best, wanted)
        asked = common.cut(todo.mapInArrow(_query_blocks, _BLOCK), "negatives-asked")
        visits = common.cut(common.map_batches(asked, _visitor(known, done, size), _VISIT), "negatives-visits")
        if visits.isEmpty():
            break
        # visits compress so well that their files look small enough to be broadcast; they grow with queries times cells
        met = visits.hint("merge").join(blocks, "cell").join(F.broadcast(asked), "b")
        hits = common.map_batches(met, _scorer(wanted, same), "q long, w long, s long, id long")
        best = common.cut(_top(hits if best is None else hits.unionByName(best), wanted), "negatives-best")
        done, size = done + size, size * 4
    if best is None:
        best = spark.createDataFrame([], "q long, w long, s long, id long")
    return best


def _top(hits: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("q", "w").orderBy(F.desc("s"), "id")
    return hits.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= wanted).drop("_at")


def _narrowed(queries: DataFrame, best: DataFrame, wanted: int) -> DataFrame:
    """Queries whose full windows begin at their last row's score."""
    full = (best.groupBy("q", "w").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s")).where(F.col("n") >= wanted)
            .groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("_full")))
    raised = F.transform("windows", lambda x: F.struct(
        x["w"].alias("w"), F.greatest(x["lo"], F.try_element_at("_full", x["w"])).alias("lo"), x["hi"].alias("hi")))
    return queries.join(full, "q", "left").select("q", "label", "v", raised.alias("windows"))


def _query_blocks(batches):
    """Blocks of QUERY_BLOCK queries that have windows, with a number each."""
    b = TaskContext.get().partitionId() << 32
    for batch in batches:
        batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("windows")), 0), 0))
        for at in range(0, batch.num_rows, QUERY_BLOCK):
            part = batch.slice(at, QUERY_BLOCK)
            windows = part.column("windows").to_pylist()
            field = lambda name: pa.array([[w[name] for w in ws] for ws in windows], pa.list_(pa.int64()))
            one = lambda x: pa.array([x.to_pylist()], pa.list_(x.type))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int64()), *map(one, (part.column("q"), part.column("label"), part.column("v"))),
                 *(one(field(name)) for name in ("w", "lo", "hi"))], names=["b", "q", "ql", "qv", "w", "lo", "hi"])
            b += 1


def _visitor(known, done: int, size: int):
    """Of each query the cells from the ``done``-th to the ``size`` next, as far
    as a window can gain by them: one row a cell and block of queries, with the
    queries' places in the block."""
    def run(batch):
        index = known.value
        width = len(index.books[1])
        for b, v, lo, hi in zip(*(batch.column(c) for c in ("b", "qv", "lo", "hi"))):
            (high1, low1), (high2, low2) = index.bounds(_matrix(v.as_py()))
            visits: dict[int, list[int]] = {}
            for n, (least, most) in enumerate(zip(map(min, lo.as_py()), map(max, hi.as_py()))):
                for step, (bound, i, j) in enumerate(index.walk(high1[n], high2[n])):
                    if bound < least or step >= done + size:
                        break
                    if step >= done and low1[n, i] + low2[n, j] <= most:
                        visits.setdefault(i * width + j, []).append(n)
            if visits:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(visits), pa.int64()), pa.array([b.as_py()] * len(visits), pa.int64()),
                     pa.array(list(visits.values()), pa.list_(pa.int32()))], names=["cell", "b", "n"])
    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats where no sum can pass 2^53."""
    most = np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0))
    if most < 2.0 ** 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _scorer(wanted: int, same: bool):
    def run(b):
        get = {c: b.column(c) for c in ("ids", "labels", "vs", "n", "q", "ql", "qv", "w", "lo", "hi")}
        for n in range(b.num_rows):
            asked = get["n"][n].as_py()
            of = lambda c: [x[i] for x in [get[c][n].as_py()] for i in asked]  # noqa: B023, E731
            ids, labels = np.array(get["ids"][n].as_py()), np.array(get["labels"][n].as_py())
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], labels[order]
            s = _products(_matrix(of("qv")), _matrix(get["vs"][n].as_py())[order])
            fits = np.array(of("ql"))[:, None] == labels
            fits = fits if same else ~fits
            q, w, lo, hi = map(of, ("q", "w", "lo", "hi"))
            out = []
            for k in range(max(map(len, w))):
                has = [m for m in range(len(q)) if len(w[m]) > k]
                low, high = (np.array([x[m][k] for m in has])[:, None] for x in (lo, hi))
                t = np.where(fits[has] & (s[has] >= low) & (s[has] <= high), s[has], _NONE)
                if t.shape[1] > wanted:
                    last = np.partition(t, t.shape[1] - wanted, axis=1)[:, t.shape[1] - wanted]
                    t = np.where(t >= last[:, None], t, _NONE)
                row, col = np.nonzero(t > _NONE)
                o = np.lexsort((col, -t[row, col], row))
                row, col = row[o], col[o]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[rank < wanted], col[rank < wanted]
                out.append((np.array([q[m] for m in has], np.int64)[row],
                            np.array([w[m][k] for m in has], np.int64)[row], t[row, col], ids[col]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["q", "w", "s", "id"])
    return run


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", label: Column | str = "label",
         vector: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         sample: int = SAMPLE, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). Anchors are the rows where ``anchors`` (a condition on
    ``id``) holds; positives: the first ``positives`` other rows of the label;
    for each, the first ``negatives`` rows of other labels with ``least`` to
    ``most`` percent of the positive's score."""
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    points = common.cut(quantise(rows, vec_id, label, vector), "negatives-points")
    wanted = max(positives + 1, negatives)
    order = Window.partitionBy("label", "v").orderBy("id")
    first = (points.withColumn("_at", F.dense_rank().over(order)).where(F.col("_at") <= wanted)
             .select("id", "label", "v").distinct())
    index, blocks = build(common.cut(first, "negatives-first"), sample, rows_per_cell)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    asked = points.where(anchors).distinct()
    queries = common.cut(asked.select("label", "v").distinct().orderBy("label", "v")
                         .select(F.monotonically_increasing_id().alias("q"), "label", "v"), "negatives-queries")
    if index is None or queries.isEmpty():
        return spark.createDataFrame([], out)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(_NONE + 1).alias("lo"), F.lit(-_NONE).alias("hi")))
    near = search(index, blocks, queries.withColumn("windows", everything), positives + 1, True)
    near = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "id"))).alias("near"))
    asked = asked.join(queries, ["label", "v"]).select("id", "q").join(near, "q")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, positives)
    pairs = common.cut(asked.select("q", F.col("id").alias("anchor_id"), F.explode(others).alias("p"))
                       .select("q", "anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.s")).alias("positive_score")),
                       "negatives-pairs")
    # all windows of a query: at most positives + 1 different scores
    s = F.col("positive_score")
    ends = F.struct(s.alias("w"), (-F.floor(-s * least / F.lit(100).cast("decimal(3,0)"))).cast("long").alias("lo"),
                    F.floor(s * most / F.lit(100).cast("decimal(3,0)")).cast("long").alias("hi"))
    windows = (pairs.select("q", ends.alias("w")).distinct().where("w.lo <= w.hi")
               .groupBy("q").agg(F.sort_array(F.collect_list("w")).alias("windows")))
    found = search(index, blocks, queries.join(windows, "q"), negatives, False)
    ranked = (found.groupBy("q", F.col("w").alias("positive_score"))
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "id"))).alias("rows")))
    return (pairs.join(ranked, ["q", "positive_score"])
            .select("anchor_id", "positive_id", "positive_score", F.posexplode("rows").alias("at", "row"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("row.id").alias("negative_id"), "positive_score", (-F.col("row.s")).alias("negative_score")))


#: The contract's labels: every seventh row has the next one.
LABEL_SQL = "CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END"


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"),
                F.col("id") % 50 == 0, label=F.expr(LABEL_SQL))


OP11_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, {LABEL_SQL} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, a.label AS al, a.e AS ae, o.vec_id AS other, o.label AS ol,
         list_inner_product(a.e, o.e)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE ol = al AND other <> anchor
      QUALIFY row_number() OVER (PARTITION BY anchor, al, ae ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.al, p.ae, p.other, p.score ORDER BY s.score DESC, s.other)::INTEGER AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND s.al = p.al AND s.ae = p.ae AND s.ol <> s.al
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
