"""Suffix-array dedup: removes every byte covered by a ``width``-byte string
that also starts anywhere else, in the same text or another.

Suffixes are dealt to tasks by anchors. A window of ``width`` bytes is anchored
at its least hashed k-mer (the leftmost of equals), so equal windows have equal
anchors, and the windows of one anchor form one region of text. Equal regions
are counted, with map-side combine, and kept once; regions with an anchor of
their own can't repeat. The different regions of one anchor meet in one task,
which builds a suffix array by two-stage sorting: only the suffixes smaller than
their successors are sorted directly, the others are induced from them by one
scan over the buckets of first bytes. Neighbours in it whose common prefix is at
least ``width`` are repeats.

An anchor with more than MAX_REGIONS different regions (a passage at whose edge
every document goes on differently) is too much for one task: its windows are
counted by their hash instead, which needs no group at all.

Strings are judged on the input. Matches never cross texts; null is the empty
text; texts under ``width`` bytes lose nothing to themselves. Repeated rows are
copies: all of them go, if long enough. Ids may repeat or be null. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import kernels as K

WIDTH = 400
SEED = 32
MAX_REGIONS = 1024
#: Bytes of regions sorted together; whole anchors, so somewhat more. A suffix
#: that is sorted directly takes width + 40 bytes or so meanwhile.
SORT_BYTES = 1 << 19


def _text_hash(c: K.Chunk) -> np.ndarray:
    """Class of each text: equal texts, equal classes."""
    size = np.diff(c.offsets)
    return K.mix(c.hash_spans(c.offsets[:-1], c.offsets[1:]) ^ K.mix(size.astype(np.uint64))).view(np.int64)


def anchors(c: K.Chunk, width: int, seed: int):
    """Runs of windows with one anchor: (document, first window, last window,
    anchor), positions within the chunk."""
    n = len(c.data)
    span = width - seed + 1                      # k-mers in a window
    if n < width:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - seed + 1)
    h = c.hash_spans(at, at + seed)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h & ~((np.uint64(1) << bits) - np.uint64(1))) | at.astype(np.uint64)
    least = K.sliding_min(key, span)
    start = np.arange(n - width + 1)
    doc = c.doc_of(start)
    ok = start + width <= c.offsets[doc + 1]
    start, doc = start[ok], doc[ok]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    pos = (least[ok] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1]))))
    end = np.append(new[1:], len(start)) - 1
    return doc[new], start[new], start[end], pos[new]


def _first_pass(src: DataFrame, width: int, seed: int) -> DataFrame:
    """Kind 0: (id, class, bytes, digest) of each row. Kind 1: (id, class, from,
    to, anchor, region) of each run of windows; copies in a batch once."""
    names = ["kind", "id", "cls", "a", "b", "anchor", "region", "sha"]

    def run(b):
        ids = b.column("_x_id")
        seen = set()
        for c in K.chunks(b.column("_x_text")):
            cls, size = _text_hash(c), np.diff(c.offsets)
            raw = c.data.tobytes()
            sha = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(c.offsets[:-1], c.offsets[1:])]
            z = np.zeros(c.n, np.int64)
            part = ids.slice(c.rows.start, c.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(z.astype(np.int32)), part, pa.array(cls), pa.array(z), pa.array(size.astype(np.int64)),
                 pa.array(z), pa.array(z), pa.array(sha, pa.string())], names=names)
            fresh = np.zeros(c.n, bool)
            fresh[[i for i, x in enumerate(cls.tolist()) if not (x in seen or seen.add(x))]] = True
            doc, a, e, p = anchors(c, width, seed)
            ok = fresh[doc]
            doc, a, e, p = doc[ok], a[ok], e[ok], p[ok]
            mark = c.hash_spans(p, p + seed)
            region = K.mix(c.hash_spans(a, e + width) ^ K.mix(((p - a) * (1 << 32) + (e - a)).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(doc), np.int32)), part.take(pa.array(doc)), pa.array(cls[doc]),
                 pa.array(a - c.offsets[doc]), pa.array(e - c.offsets[doc]),
                 pa.array(mark.view(np.int64)), pa.array(region.view(np.int64)), pa.nulls(len(doc), pa.string())],
                names=names)
    return common.map_batches(src, run, "kind int, id long, cls long, a long, b long, anchor long, region long, sha string")


def two_stage_sort(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` (uint8 + 1, closed by a 0), exact to ``depth``."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    # a suffix is smaller than its successor if the next different byte is larger
    nz = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(nz[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.where(nxt < n - 1, step[np.minimum(nxt, n - 2)] > 0, False)
    small[-1] = True
    raw = text.astype(">u2").tobytes() if text.max() > 255 else text.astype(np.uint8).tobytes()
    unit = 2 if text.max() > 255 else 1
    direct = np.flatnonzero(small).tolist()
    direct.sort(key=lambda i: raw[i * unit:(i + depth) * unit])          # the only sorting by content
    direct = np.array(direct, np.int64)
    first = text[direct]
    cut = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []
    for c in np.unique(text):
        ready = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        rows = [ready]
        while len(ready):                                                # runs of one byte
            p = ready[ready > 0] - 1
            ready = p[(text[p] == c) & ~small[p]]
            rows.append(ready)
        rows.append(direct[cut[c]:cut[c + 1]])
        bucket = np.concatenate(rows)
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[(text[p] > c) & ~small[p]]
        if len(p):
            p = p[np.argsort(text[p], kind="stable")]
            at = np.flatnonzero(np.concatenate(([True], text[p][1:] != text[p][:-1])))
            for s, e in zip(at, np.append(at[1:], len(p))):
                induced[text[p[s]]].append(p[s:e])
    return np.concatenate(out)


def repeats(regions: list[bytes], width: int) -> list[np.ndarray]:
    """Of each region the window starts whose window also starts elsewhere in
    these regions."""
    sizes = np.array([len(r) for r in regions])
    raw = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = raw.astype(np.uint16) + 1
    text[begin[1:] - 1] = 0
    sa = two_stage_sort(text, width)
    valid = np.zeros(len(text), bool)
    for s, n in zip(begin[:-1], sizes):
        valid[s:s + max(0, n - width + 1)] = True
    sa = sa[valid[sa]]
    h = K.Chunk(raw, np.array([0, len(raw)]), slice(0, 1)).hash_spans(sa, sa + width)
    same = np.concatenate(([False], h[1:] == h[:-1], [False]))           # common prefix of width or more
    hit = np.sort(sa[same[1:] | same[:-1]])
    cuts = np.searchsorted(hit, begin)
    return [hit[cuts[i]:cuts[i + 1]] - begin[i] for i in range(len(regions))]


def _runs(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    end = np.append(new[1:], len(starts)) - 1
    return [{"s": int(s), "e": int(e)} for s, e in zip(starts[new], starts[end])]


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _sorted_repeats(regions: DataFrame, width: int) -> DataFrame:
    """(anchor, region, spans of window starts) by suffix arrays."""
    def work(rows):
        keys, texts = [], []
        for anchor, region, text in rows:
            keys.append((anchor, region))
            texts.append(text)
        got = [(k, _runs(x)) for k, x in zip(keys, repeats(texts, width))]
        got = [g for g in got if g[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in got], pa.int64()), pa.array([k[1] for k, _ in got], pa.int64()),
             pa.array([s for _, s in got], _SPANS)], names=["anchor", "region", "spans"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for row in zip(b.column("anchor").to_pylist(), b.column("region").to_pylist(), b.column("bytes").to_pylist()):
                if last is not None and row[:2] == last:
                    continue
                if size >= SORT_BYTES and row[0] != last[0]:
                    yield work(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
                last = row[:2]
        if rows:
            yield work(rows)
    return (regions.repartition("anchor").sortWithinPartitions("anchor", "region")
            .mapInArrow(run, "anchor long, region long, spans array<struct<s:long,e:long>>"))


def _counted_repeats(regions: DataFrame, width: int) -> DataFrame:
    """The same, by counting window hashes."""
    def run(b):
        for c in K.chunks(b.column("bytes").cast(pa.binary()).cast(pa.large_binary()).view(pa.large_string())):
            size = np.diff(c.offsets) - width + 1
            doc = np.repeat(np.arange(c.n), size)
            s = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            at = c.offsets[doc] + s
            pick = lambda k: b.column(k).to_numpy()[c.rows][doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pick("anchor")), pa.array(pick("region")), pa.array(s.astype(np.int64)),
                 pa.array(c.hash_spans(at, at + width).view(np.int64))], names=["anchor", "region", "s", "h"])
    rows = common.map_batches(regions.dropDuplicates(["anchor", "region"]), run, "anchor long, region long, s long, h long")
    often = rows.groupBy("anchor", "h").count().where("count > 1").select("anchor", "h")
    return rows.join(often, ["anchor", "h"]).select(
        "anchor", "region", F.array(F.struct(F.col("s"), F.col("s").alias("e"))).alias("spans"))


def _merge(spans: list, width: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED):
    """(rows, spans, source). rows: (id, class, bytes, digest) of each row. spans:
    the repeated byte ranges of each class of equal texts that has any, not yet
    merged (more copies of a text are not counted here)."""
    common.prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("_x_id"), F.col(text).alias("_x_text"))
    first = common.cut(_first_pass(src, width, seed), "suffix")
    rows = first.where("kind = 0").select("id", "cls", F.col("b").alias("bytes"), "sha")
    runs = first.where("kind = 1").select("anchor", "region", "id", "cls", "a", "b")
    kinds = common.cut(runs.groupBy("anchor", "region").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "cls", "a", "b")).alias("w")), "regions")
    multi = (kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("t")).where("t > 1").drop("t"))
    kinds = common.cut(kinds.join(multi, "anchor"), "regions")

    # the text of each region, from one row that has it
    wanted = (kinds.where("d > 1").select("w.id", "w.cls", F.struct("anchor", "region", "d", "w.a", "w.b").alias("r"))
              .groupBy("id", "cls").agg(F.collect_list("r").alias("rs")))

    def extract(b):
        for c in K.chunks(b.column("_x_text")):
            cls, raw = _text_hash(c), c.data.tobytes()
            out = []
            for i, (want, rs) in enumerate(zip(b.column("cls").to_pylist()[c.rows], b.column("rs").to_pylist()[c.rows])):
                if want == cls[i]:                   # an id may stand for other texts too
                    o = int(c.offsets[i])
                    out += [(r["anchor"], r["region"], r["d"], raw[o + r["a"]:o + r["b"] + width]) for r in rs]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "region", "d", "bytes"])
    texts = common.probably_in(src, "_x_id", wanted.select("id"))
    joined = wanted.join(texts, wanted["id"].eqNullSafe(texts["_x_id"])).select("cls", "rs", "_x_text")
    regions = common.cut(common.map_batches(joined, extract, "anchor long, region long, d long, bytes binary"), "texts")
    found = (_sorted_repeats(regions.where(F.col("d") <= MAX_REGIONS).drop("d"), width)
             .unionByName(_counted_repeats(regions.where(F.col("d") > MAX_REGIONS).drop("d"), width)))
    whole = kinds.where("c > 1").select("anchor", "region", F.array(F.struct(
        F.lit(0).cast("long").alias("s"), (F.col("w.b") - F.col("w.a")).alias("e"))).alias("spans"))
    spans = (runs.join(whole.unionByName(found), ["anchor", "region"])
             .select("cls", F.explode(F.transform("spans", lambda x: F.struct(
                 (F.col("a") + x["s"]).alias("s"), (F.col("a") + x["e"] + width).alias("e")))).alias("x"))
             .groupBy("cls").agg(F.collect_set("x").alias("spans")))
    return rows, spans, src


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each row of ``docs``: (id, n_bytes, n_removed, n_spans,
    kept_sha256, spans), the spans being the removed byte ranges."""
    rows, spans, src = repeated_spans(docs, id_col, text, width)
    copies = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    state = common.cut(rows.join(copies, "cls").join(spans, "cls", "left")
                       .withColumn("all", F.expr(f"copies > 1 AND bytes >= {width}")), "state")
    span_type = "array<struct<s:long,e:long>>"
    same = state.where("NOT all AND spans IS NULL").select(
        "id", F.col("bytes").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast(span_type).alias("spans"))
    gone = state.where("all").select(
        "id", F.col("bytes").alias("n_bytes"), F.col("bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(b""), 256).alias("kept_sha256"),
        F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("bytes").alias("e"))).alias("spans"))

    def strip(b):
        n, gone_, count, sha, kept, ids = [], [], [], [], [], []
        for c in K.chunks(b.column("_x_text")):
            cls, raw = _text_hash(c), c.data.tobytes()
            for i, (want, rs) in enumerate(zip(b.column("cls").to_pylist()[c.rows], b.column("spans").to_pylist()[c.rows])):
                if want != cls[i]:
                    continue
                o, end = int(c.offsets[i]), int(c.offsets[i + 1])
                cut = _merge([(r["s"], r["e"]) for r in rs], width)
                h, at = hashlib.sha256(), 0
                for s, e in cut:
                    h.update(raw[o + at:o + s])
                    at = e
                h.update(raw[o + at:end])
                ids.append(c.rows.start + i)
                n.append(end - o)
                gone_.append(sum(e - s for s, e in cut))
                count.append(len(cut))
                sha.append(h.hexdigest())
                kept.append([{"s": s, "e": e} for s, e in cut])
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.array(gone_, pa.int64()),
             pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, _SPANS)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    # classes of one row, so that no id meets a text of its own twice
    some = state.where("NOT all AND spans IS NOT NULL").select("id", "cls", "spans")
    texts = common.probably_in(src, "_x_id", some.select("id"))
    joined = some.join(texts, some["id"].eqNullSafe(texts["_x_id"])).select("id", "cls", "spans", "_x_text")
    part = common.map_batches(joined, strip, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span_type}")
    return same.unionByName(gone).unionByName(part)
