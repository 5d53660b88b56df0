"""Benchmark decontamination with training suffix arrays.

Each shard of training text (a chunk of documents inside a task) gets a suffix
array over its words; every suffix of the benchmark is binary-searched in it,
which gives the range of training positions that agree with it in ``n`` words,
hence all longest verbatim matches and their locations. A document is removed
when enough of its words lie in such matches.

The suffix array is sparse without loss: a training suffix that doesn't begin
with a short word sequence of the benchmark can't match a benchmark window, so
it is left out before sorting.

The benchmark goes to the tasks in blocks of at most BLOCK_BYTES of text; the
documents are read once for each block, whatever the size of the benchmark.
Null and empty texts and items have no words: no hits, no windows. An item of
fewer than ``n`` words is one window. Repeated items count by their id, items
with a null id as "null". Repeated documents are judged each on its own. Empty
tables: no hits, or an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import kernels as K

WINDOW = 13
#: Contaminated: SHARE * hit words >= words.
SHARE = 20
BLOCK_BYTES = 8 << 20
_SPANS = T.ArrayType(T.StructType().add("s", "long").add("e", "long"))


def _word_hashes(texts: pa.Array):
    """(hashes, row) of the words of all texts, chunk by chunk."""
    for c in K.chunks(texts):
        c = c.lower()
        s, e, doc = c.words(K.ALNUM_WORDS)
        yield c, c.hash_words(s, e, K.ALNUM_WORDS), doc


class Benchmark:
    """The suffixes of one block of items, cut to windows of ``n`` words."""

    def __init__(self, ids: list[str], texts: list[str | None], n: int):
        self.n = n
        self.ids = np.array(ids, object)
        rows, hashes, base = [], [], 0
        for c, h, doc in _word_hashes(pa.array(texts, pa.large_string())):
            rows.append(doc + base)
            hashes.append(h)
            base += c.n
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        doc = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        size = np.bincount(doc, minlength=len(ids))
        _, wdoc, pos = K.windows(words, doc, n, len(ids), short=True)
        self.length = np.minimum(size[wdoc], n)      # words of each window
        self.item = wdoc
        self.keys = {}                               # by length: byte keys, sorted, and their items
        for m in np.unique(self.length):
            at = np.flatnonzero(self.length == m)
            key = _keys(words, pos[at], int(m))
            o = np.argsort(key, kind="stable")
            self.keys[int(m)] = (key[o], wdoc[at][o])
        # what a matching training suffix begins with
        self.lead = int(min([4, *self.keys])) if self.keys else 0
        self.leads = np.unique(_lead(words, pos, self.lead)) if self.keys else np.zeros(0, np.uint64)


def _keys(words: np.ndarray, pos: np.ndarray, m: int) -> np.ndarray:
    """``m`` words from each position as one byte string that sorts like them."""
    take = words[np.minimum(pos[:, None] + np.arange(m), max(len(words) - 1, 0))]
    return np.ascontiguousarray(take.astype(">u8")).view(f"S{8 * m}").ravel()


def _lead(words: np.ndarray, pos: np.ndarray, m: int) -> np.ndarray:
    h = np.zeros(len(pos), np.uint64)
    for j in range(m):
        h = h * np.uint64(0xD1342543DE82EF95) + words[pos + j]
    return K.mix(h)


def matches(words: np.ndarray, doc: np.ndarray, n_docs: int, bench: Benchmark):
    """All occurrences of benchmark windows in a shard: (first word, words, item)."""
    empty = (np.zeros(0, np.int64),) * 3
    if not bench.keys or len(words) < bench.lead:
        return empty
    last = np.searchsorted(doc, np.arange(n_docs), "right")[doc]   # end of the word's document
    start = np.arange(len(words) - bench.lead + 1)
    lead = _lead(words, start, bench.lead)
    i = np.searchsorted(bench.leads, lead)
    start = start[bench.leads[np.minimum(i, len(bench.leads) - 1)] == lead]
    start = start[start + bench.lead <= last[start]]
    out = []
    for m, (keys, items) in bench.keys.items():
        suffixes = start[start + m <= last[start]]
        key = _keys(words, suffixes, m)
        order = np.argsort(key, kind="stable")       # the shard's suffix array
        key, suffixes = key[order], suffixes[order]
        lo, hi = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        found = np.flatnonzero(hi > lo)
        reps = (hi - lo)[found]
        at = np.repeat(lo[found], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out.append((suffixes[at], np.full(len(at), m), np.repeat(items[found], reps)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _blocks(benchmark: DataFrame, item: str, text: str):
    """The items in blocks of at most BLOCK_BYTES of text."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), text)
    for i, t in rows.toLocalIterator():
        if ids and size + len(t or "") * 4 > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t or "") * 4
    yield ids, texts


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
         item: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """``keep`` of each document, ``_d_words``, ``_d_spans`` (array of (first
    word, end word) of its longest verbatim matches, merged) and ``_d_items``
    (the items that match, as strings)."""
    spark = docs.sparkSession
    kept = docs.select(*keep, F.col(text).alias("_d_text"))
    schema = (kept.drop("_d_text").schema.add("_d_words", "long")
              .add("_d_spans", _SPANS).add("_d_items", T.ArrayType(T.StringType())))
    blocks = [spark.sparkContext.broadcast(Benchmark(i, t, n)) for i, t in _blocks(benchmark, item, item_text)]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n_words, spans, items = [], [], []
            for c, words, doc in _word_hashes(b.column("_d_text")):
                size = np.bincount(doc, minlength=c.n)
                first = np.concatenate(([0], np.cumsum(size)))
                hit = np.zeros(len(words) + 1, np.int64)
                named = [set() for _ in range(c.n)]
                for bench in blocks:
                    s, m, who = matches(words, doc, c.n, bench.value)
                    np.add.at(hit, s, 1)
                    np.add.at(hit, s + m, -1)
                    pairs = np.unique(np.stack([doc[s], who]), axis=1) if len(s) else np.zeros((2, 0), int)
                    for d, k in pairs.T:
                        named[d].add(bench.value.ids[k])
                on = (np.cumsum(hit[:-1]) > 0).astype(np.int8)
                edge = np.zeros(len(words) + 1, np.int8)
                edge[1:] = on
                edge[first] = 0
                a = np.flatnonzero((on == 1) & (edge[:-1] == 0))
                nxt = np.append(on, 0)[1:]
                nxt[first[1:][first[1:] > 0] - 1] = 0
                z = np.flatnonzero((on == 1) & (nxt == 0)) + 1
                lists = [[] for _ in range(c.n)]
                for d, x, y in zip(doc[a], a, z):
                    lists[d].append({"s": int(x - first[d]), "e": int(y - first[d])})
                n_words.append(size)
                spans += lists
                items += [sorted(x) for x in named]
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(len(keep))]
                + [pa.array(np.concatenate(n_words).astype(np.int64)),
                   pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                   pa.array(items, pa.list_(pa.string()))], names=schema.names)
    return kept.mapInArrow(run, schema)


def _n_hit():
    return F.aggregate("_d_spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def contaminated():
    return (F.size("_d_items") > 0) & (SHARE * _n_hit() >= F.col("_d_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows."""
    return hits(docs, benchmark, docs.columns, text).where(~contaminated()).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hits(common.table(spark, sf_dir, "documents", "doc_id", "text"),
               common.table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id"])
    return out.select(
        "doc_id", F.col("_d_words").alias("n_words"), _n_hit().alias("n_hit"),
        F.size("_d_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_d_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))


OP9_SQL = """
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
dw AS (
  SELECT r, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM d),
bw AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
    SELECT item, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i
    FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bwin),
dwin AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
    SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
hit AS (SELECT r, i, dwin.m, item FROM dwin JOIN bwin USING (m, win)),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (
    SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d JOIN dw USING (r) LEFT JOIN n_hit USING (r) LEFT JOIN its USING (r)
"""
