"""N-gram Jaccard join with signature trees.

A text's set is its distinct word shingles. Two texts link when the Jaccard
similarity of their sets reaches num/den; the join finds, without loss, all
links that decide which documents belong together.

1. Texts with equal sets are one class; only classes are compared.
2. Each class goes to some subtrees of the forest of signature trees. Order all
   shingles by one global order, frequent ones last. If a = |x - y| and
   b = |y - x|, each of those a + b shingles parts at most one pair of
   neighbouring shared shingles, so among the first 2(1 - t)|x| + 2 shingles of
   x there are two neighbours that are shared and neighbours in y too. One
   subtree for each such pair of neighbours therefore brings every link
   together, and hardly anything else.
3. A first round links each class to a leader of its subtrees, the class that is
   in the largest ones, checked exactly. Subtrees whose classes are all connected
   are done.
4. In the others, nodes hold the OR of their classes' shingle bitmaps and the
   range of their sizes. Two trees are traversed together, and a pair of nodes
   is dropped when the most overlap it allows is below the least overlap a link
   of its sizes needs, or when its classes are connected already. What remains
   at the leaves is checked exactly on the whole sets. In the first FORESTS
   rounds a task hands on only pairs that form a forest over the components, as
   most of them link; the last round hands on every pair still apart. Only
   subtrees with a pair not handed on come to the next round.

A subtree of more than BLOCK classes is cut into blocks, and pairs of blocks
are traversed, each by its own task. Shingles are 47-bit hashes.

Null and empty texts and texts without a word have an empty set and link with
nothing, nor do rows with a null id; their component is their own id. Repeated
rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from . import kernels as K

WORDS, NUM, DEN = 5, 80, 100
#: Shingles placed last in the global order. Any order gives the same links.
HEAVY = 1 << 16
#: Documents of a batch that make a shingle a candidate for that.
HEAVY_IN_BATCH = 8
SALT = 64
SIG_BITS = 2048
LEAF, FAN = 8, 8
BLOCK = 2048
#: Node pairs looked at together.
FRONT = 1 << 14
#: Rounds that hand on a forest. Any number gives the same components.
FORESTS = 2
_TOKEN_BITS = 47
_TOP = np.uint64(1 << _TOKEN_BITS)


def shingle_sets(chunk: K.Chunk, k: int, heavy: np.ndarray | None = None):
    """(shingles, documents) of the chunk, distinct and in the global order
    within each document. ``heavy``: shingles that come last, the rarest first."""
    c = chunk.lower()
    s, e, doc = c.words(K.SPACE_WORDS)
    h, wdoc, _ = K.windows(c.hash_words(s, e, K.SPACE_WORDS), doc, k, c.n, short=True)
    tok = h >> np.uint64(64 - _TOKEN_BITS)
    if heavy is not None and len(heavy):
        order = np.argsort(heavy)
        i = np.minimum(np.searchsorted(heavy, tok, sorter=order), len(heavy) - 1)
        tok = np.where(heavy[order[i]] == tok, _TOP | order[i].astype(np.uint64), tok)
    key = np.sort((wdoc.astype(np.uint64) << np.uint64(48)) | tok)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64)


def _set_hash(tok, doc, n_docs):
    size = np.bincount(doc, minlength=n_docs)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(tok + np.uint64(1)))))
    first = np.concatenate(([0], np.cumsum(size)))
    total = run[first[1:]] - run[first[:-1]]
    return K.mix(total ^ K.mix(size.astype(np.uint64))).view(np.int64), size


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def _signatures(tok, doc, n_docs):
    bits = np.zeros(n_docs * SIG_BITS, bool)
    bits[doc * SIG_BITS + (tok & np.uint64(SIG_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _first_pass(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: of each document (kind 0: id, set hash, size,
    signature), and of shingles frequent in a batch (kind 1: id, count)."""
    def run(b):
        ids, hashes, sizes, sigs, seen = b.column(0), [], [], [], []
        for c in K.chunks(b.column(1)):
            tok, doc = shingle_sets(c, k)
            h, n = _set_hash(tok, doc, c.n)
            hashes.append(h)
            sizes.append(n)
            sigs.append(_signatures(tok, doc, c.n))
            seen.append(tok)
        sizes = np.concatenate(sizes)
        step = SIG_BITS // 8
        sig = _binary(np.concatenate(sigs), np.arange(len(sizes) + 1) * step)
        names = ["kind", "id", "fp", "n", "sig"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(sizes), np.int32)), ids, pa.array(np.concatenate(hashes)),
             pa.array(sizes.astype(np.int64)), sig], names=names)
        tok, count = np.unique(np.concatenate(seen), return_counts=True)
        often = count >= HEAVY_IN_BATCH
        m = int(often.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, np.int32)), pa.array(tok[often].astype(np.int64)), pa.array(np.zeros(m, np.int64)),
             pa.array(count[often].astype(np.int64)), pa.nulls(m, pa.binary())], names=names)
    return common.map_batches(docs, run, "kind int, id long, fp long, n long, sig binary")


def _subtrees(docs: DataFrame, k: int, num: int, den: int, heavy) -> DataFrame:
    """(key, fp, late): the subtrees of each class; ``late`` if both shingles
    of the key are frequent ones."""
    least = -(-num // (den - num)) if den > num else 1 << 60     # smaller sets link with their equals only

    def run(b):
        hot, seen = heavy.value, np.zeros(0, np.int64)
        for c in K.chunks(b.column(0)):
            tok, doc = shingle_sets(c, k, hot)
            own = np.where(tok >= _TOP, hot[np.minimum(tok & (_TOP - np.uint64(1)), max(len(hot), 1) - 1).astype(np.int64)],
                           tok) if len(hot) else tok
            fp, n = _set_hash(own, doc, c.n)
            new = np.zeros(c.n, bool)
            new[np.unique(fp, return_index=True)[1]] = True
            new &= ~np.isin(fp, seen) & (n >= least)
            seen = np.concatenate((seen, fp[new]))
            first = np.concatenate(([0], np.cumsum(n)))
            reach = np.minimum(2 * (den - num) * n // den + 2, n)
            at = np.arange(len(tok)) - first[doc]
            i = np.flatnonzero((at + 1 < reach[doc]) & new[doc])
            key = K.mix(tok[i] * np.uint64(3) + K.mix(tok[i + 1] if len(i) else tok[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(fp[doc[i]]), pa.array(tok[i] >= _TOP)],
                names=["key", "fp", "late"])
    return common.map_batches(docs, run, "key long, fp long, late boolean")


def _whole_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(fp, shingles as 5-byte words) of the classes ``reps`` (id, fp). Of the 47
    bits of a shingle 40 tell those of two texts apart."""
    def run(b):
        want = b.column("fp").to_numpy()
        done = 0
        for c in K.chunks(b.column("_j_text")):
            tok, doc = shingle_sets(c, k)
            fp, n = _set_hash(tok, doc, c.n)
            ok = fp == want[done:done + c.n]       # an id may stand for other texts too
            done += c.n
            five = np.ascontiguousarray(tok[ok[doc]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[ok]), _binary(five.ravel(), np.concatenate(([0], np.cumsum(n[ok] * 5))))],
                names=["fp", "toks"])
    texts = common.probably_in(docs, "_j_id", reps.select("id"))
    both = texts.select(F.col("_j_id").alias("id"), "_j_text").join(reps, "id")
    return common.map_batches(both.select("fp", "_j_text"), run, "fp long, toks binary").dropDuplicates(["fp"])


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int, extra: tuple = ()) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets; ``extra`` columns go along."""
    def words(raw):
        x = np.zeros((len(raw) // 5, 8), np.uint8)
        x[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        return x.view("<u8").ravel()

    def run(b):
        keep, last, x = [], None, None
        for a_id, ta, tb in zip(b.column("a").to_pylist(), b.column("ta"), b.column("tb")):
            if a_id != last:
                last, x = a_id, words(ta.as_py())
            y = words(tb.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield b.select(["a", "b", *extra]).filter(pa.array(keep, pa.bool_()))
    full = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("toks").alias("ta")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("toks").alias("tb")), "b")
            .select("a", "b", *extra, "ta", "tb"))
    return common.map_batches(full, run, ", ".join(f"{c} long" for c in ("a", "b", *extra)))


class Tree:
    """A signature tree over rows sorted by size: ``levels[0]`` are the rows."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, comp: np.ndarray):
        slack = n - np.bitwise_count(sig).sum(1).astype(np.int64)    # shingles beyond one a bit
        self.levels = [(sig, n, n, slack, comp, np.ones(len(n), bool))]
        self.kids = []
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            sig, lo, hi, slack, comp, one = self.levels[-1]
            at = np.arange(0, len(lo), width)
            first = np.minimum.reduceat(comp, at)
            same = (first == np.maximum.reduceat(comp, at)) & np.logical_and.reduceat(one, at)
            self.levels.append((np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at), first, same))
            self.kids.append((at, np.append(at[1:], len(lo))))
            width = FAN


def _possible(x, i, y, j, num, den):
    """Which node pairs may hold a link between classes not yet connected."""
    sx, lx, hx, kx, cx, ox = (v[i] for v in x)
    sy, ly, hy, ky, cy, oy = (v[j] for v in y)
    most = np.bitwise_count(sx & sy).sum(1).astype(np.int64) + np.minimum(kx, ky)
    most = np.minimum(most, np.minimum(hx, hy))
    return ((most * (num + den) >= num * (lx + ly)) & (hx * den >= num * ly) & (hy * den >= num * lx)
            & ~(ox & oy & (cx == cy)))


def traverse(a: Tree, b: Tree, num: int, den: int):
    """Row pairs (i of a, j of b) that dual traversal can't rule out; with
    ``a is b`` each unordered pair once."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    stack = [(la, lb, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        u, v, i, j = stack.pop()
        if len(i) > FRONT:
            stack += [(u, v, i[s:s + FRONT], j[s:s + FRONT]) for s in range(0, len(i), FRONT)]
            continue
        ok = _possible(a.levels[u], i, b.levels[v], j, num, den) if not (a is b and u == v == la) else np.ones(1, bool)
        if a is b and u == v:
            ok &= (i < j) if u == 0 else (i <= j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if u == v == 0:
            yield i, j
            continue
        if u >= v:
            i, j = _open(a.kids[u - 1], i, j)
            u -= 1
            if a is b:
                j, i = _open(b.kids[v - 1], j, i)
                v -= 1
        else:
            j, i = _open(b.kids[v - 1], j, i)
            v -= 1
        stack.append((u, v, i, j))


def _open(kids, i, other):
    lo, hi = kids
    reps = (hi - lo)[i]
    at = np.repeat(lo[i], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    return at, np.repeat(other, reps)


class Forest:
    """Of the pairs seen so far those that join two components not yet joined."""

    def __init__(self, comp: np.ndarray):
        self.names = np.unique(comp)
        self.root = np.arange(len(self.names))

    def take(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the component pairs (x, y) that become edges."""
        x, y = np.searchsorted(self.names, x), np.searchsorted(self.names, y)
        at, kept = np.arange(len(x)), []
        while True:
            u, v = self.root[x[at]], self.root[y[at]]
            apart = u != v
            at, u, v = at[apart], u[apart], v[apart]
            if not len(at):
                return np.concatenate(kept) if kept else at
            # each tree is hung below one smaller neighbour: no cycles
            high, one = np.unique(np.maximum(u, v), return_index=True)
            kept.append(at[one])
            up = np.arange(len(self.root))
            up[high] = np.minimum(u, v)[one]
            while (up[up] != up).any():
                up = up[up]
            self.root = up[self.root]


def _tree_join(rows: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Pairs of classes that the trees can't rule out, with their components:
    (a, b, ca, cb, null). With ``forest`` those only that join components within
    a task, and (null, null, null, null, key) for the subtrees that have others.
    ``rows``: (key, lo, hi, side, fp, n, comp, sig), grouped by (key, lo, hi)."""
    def group(t):
        side, n, comp, fp = (t[c] for c in ("side", "n", "comp", "fp"))
        halves = [np.arange(len(n))] if side.min() == side.max() else [np.flatnonzero(side == s) for s in (side.min(), side.max())]
        trees = [Tree(t["sig"][h], n[h], comp[h]) for h in halves]
        for i, j in traverse(trees[0], trees[-1], num, den):
            i, j = halves[0][i], halves[-1][j]
            yield fp[i], fp[j], comp[i], comp[j], t["key"][i]

    def found(t):
        cut = np.flatnonzero(np.concatenate(([True], (t["key"][1:] != t["key"][:-1]) | (t["lo"][1:] != t["lo"][:-1])
                                             | (t["hi"][1:] != t["hi"][:-1]), [True])))
        size = np.diff(cut)
        crossed = t["lo"] != t["hi"]
        # groups of two are a root with two leaves: all at once
        two = cut[:-1][(size == 2) & ~crossed[cut[:-1]]]
        if len(two):
            flat = (t["sig"], t["n"], t["n"], t["n"] - np.bitwise_count(t["sig"]).sum(1).astype(np.int64), t["comp"],
                    np.ones(len(t["n"]), bool))
            ok = _possible(flat, two, flat, two + 1, num, den)
            two = two[ok]
            yield t["fp"][two], t["fp"][two + 1], t["comp"][two], t["comp"][two + 1], t["key"][two]
        for s, e in zip(cut[:-1], cut[1:]):
            if e - s < 2 or (e - s == 2 and not crossed[s]) or (crossed[s] and t["side"][s:e].min() == t["side"][s:e].max()):
                continue
            yield from group({c: v[s:e] for c, v in t.items()})

    def flush(t):
        trees, got, later = Forest(t["comp"]), [], [np.zeros(0, np.int64)]
        for *pairs, key in found(t):
            if forest:
                edges = np.zeros(len(key), bool)
                edges[trees.take(*pairs[2:])] = True
                later.append(np.unique(key[~edges]))
                pairs = [v[edges] for v in pairs]
            got.append(pairs)
        if not got:
            return None
        later = np.unique(np.concatenate(later))
        x, y, cx, cy = (np.concatenate([g[k] for g in got]) for k in range(4))
        swap = x > y
        ends = np.stack([np.where(swap, y, x), np.where(swap, x, y), np.where(swap, cy, cx), np.where(swap, cx, cy)])
        ends = ends[:, np.lexsort(ends[1::-1])]
        new = np.concatenate((np.ones(min(1, len(x)), bool), (np.diff(ends[:2], axis=1) != 0).any(0)))
        none = pa.nulls(len(later), pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(pa.concat_arrays([pa.array(v), none]) for v in ends[:, new]),
             pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(later)])], names=["a", "b", "ca", "cb", "key"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = {c: b.column(c).to_numpy() for c in ("key", "lo", "hi", "side", "fp", "n", "comp")}
            t["sig"] = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(-1, SIG_BITS // 64)
            if held is not None:
                t = {c: np.concatenate((held[c], t[c])) for c in t}
            # the last group may go on in the next batch; a group has 2 BLOCK rows or so
            change = (t["key"][1:] != t["key"][:-1]) | (t["lo"][1:] != t["lo"][:-1]) | (t["hi"][1:] != t["hi"][:-1])
            at = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            if at and (out := flush({c: v[:at] for c, v in t.items()})):
                yield out
            held = {c: v[at:] for c, v in t.items()}
        if held is not None and (out := flush(held)):
            yield out
    return (rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "fp")
            .mapInArrow(run, "a long, b long, ca long, cb long, key long"))


def _open_rows(members: DataFrame, comp: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows of the subtrees with classes of several components, once for each
    pair of blocks that they belong to."""
    known = members.select("key", "fp").join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("comp"))
    known = common.cut(known, "known")
    open_keys = (known.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"),
                                          F.count(F.lit(1)).alias("size")).where("c1 <> c2"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    return (known.join(open_keys, "key").withColumn("side", side)
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"),
                    "side", "fp", "comp").join(sigs, "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS,
                    num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each row of ``docs``: (id, n_shingles, component_id, fp, root),
    fp being the class of its set and root the group: two groups may have one
    component_id, if the id stands for several texts."""
    if not 4 * num >= 3 * den or num > den:
        raise ValueError("the similarity must be 0.75 to 1")
    common.prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("_j_id"), F.col(text).alias("_j_text"))
    first = common.cut(_first_pass(src, words), "jaccard")
    base = first.where("kind = 0").select("id", "fp", "n", "sig")
    top = (first.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "id").limit(HEAVY).collect())       # at most HEAVY shingles
    heavy = docs.sparkSession.sparkContext.broadcast(np.array([r[0] for r in reversed(top)], np.uint64))

    keys = _subtrees(src.where("_j_id IS NOT NULL").select("_j_text"), words, num, den, heavy)
    keys = keys.withColumn("salt", F.when(F.col("late"), F.pmod("fp", F.lit(SALT))).otherwise(0))
    w = W.partitionBy("key", "salt")
    members = common.cut(
        keys.withColumn("lo", F.min("fp").over(w)).withColumn("hi", F.max("fp").over(w))
        .withColumn("size", F.count(F.lit(1)).over(w)).where("late or lo <> hi")
        .select("key", "salt", "fp", "size").dropDuplicates(["key", "salt", "fp"]), "members")
    # a subtree's leader is the class that is in the largest subtrees
    weight = members.groupBy("fp").agg(F.avg("size").alias("w"))
    members = common.cut(
        members.join(weight, "fp").withColumn("lead", F.max(F.struct("w", "fp")).over(w)["fp"])
        .select("key", "fp", "lead"), "members")

    reps = (base.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"))
            .join(members.select("fp").distinct(), "fp", "left_semi"))
    reps = common.cut(reps, "reps")
    sets = common.cut(_whole_sets(src, reps, words), "sets")

    # first round: each class with the leader that it shares most subtrees with
    stars = (members.where("fp <> lead").groupBy("fp", "lead").count()
             .groupBy("fp").agg(F.max(F.struct("count", F.col("lead").alias("lead"))).alias("m"))
             .select(F.col("m.lead").alias("a"), F.col("fp").alias("b")))
    comp = common.components(common.cut(_linked(stars, sets, num, den), "links"), "first")

    # then the trees, over subtrees that hold more than one component
    sigs = common.cut(base.join(reps, ["fp", "id"], "left_semi").dropDuplicates(["fp"]).select("fp", "n", "sig"), "sigs")
    for turn in range(FORESTS + 1):
        found = common.cut(_tree_join(_open_rows(members, comp, sigs), num, den, turn < FORESTS), "found")
        pairs = found.where("a IS NOT NULL").drop("key").dropDuplicates(["a", "b"])
        members = members.join(found.where("a IS NULL").select("key").distinct(), "key", "left_semi")
        links = common.cut(_linked(pairs, sets, num, den, ("ca", "cb")), "links")
        if links.isEmpty():
            continue
        more = common.components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "further")
        more = more.select(F.col("node").alias("root"), F.col("root").alias("further"))
        comp = common.cut(
            comp.join(more, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            .unionByName(more.join(comp, more["root"] == comp["node"], "left_anti")
                         .select(F.col("root").alias("node"), F.col("further").alias("root"))).distinct(), "comp")

    linked = F.expr("n > 0 AND id IS NOT NULL")
    named = (base.where(linked).groupBy("fp").agg(F.min("id").alias("id"))
             .join(comp.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "id", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    final = named.join(least, "root").select("fp", "component_id", "root")
    return (base.where(linked).join(final, "fp").select("id", F.col("n").alias("n_shingles"), "component_id", "fp", "root")
            .unionByName(base.where(~linked).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "fp",
                                                    F.col("fp").alias("root"))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS,
             num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the
    least id, of its repetitions one (by a hash of all its columns, so the same in
    every run). Rows without a word and rows with a null id
    link with nothing and stay."""
    cols, schema = docs.columns, docs.schema
    rows = near_duplicates(docs, id_col, text, words, num, den)
    # one text of each group; an id may stand for texts of several groups
    stay = (rows.where("n_shingles > 0 AND id IS NOT NULL AND id = component_id")
            .groupBy("root").agg(F.min("id").alias("id"), F.min("fp").alias("fp"))
            .groupBy("id").agg(F.collect_set("fp").alias("fp")))
    stay = common.cut(stay.select(F.col("id").alias("_k_id"), F.col("fp").alias("_k_fp")), "stay")
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_k_key", F.col(id_col).cast("long"))
    known = named.join(stay, named["_k_key"] == stay["_k_id"], "left").drop("_k_id")

    def run(b):
        keep, want = [], b.column("_k_fp").to_pylist()
        for c in K.chunks(b.column(text)):
            fp, n = _set_hash(*shingle_sets(c, words), c.n)
            # an id may stand for several texts, told apart by their class
            keep += [m == 0 or f in (w or ()) for f, m, w in zip(fp.tolist(), n.tolist(), want[c.rows])]
        yield b.select(cols).filter(pa.array(keep, pa.bool_()))
    one = F.row_number().over(W.partitionBy("_k_key", F.xxhash64(text)).orderBy(F.xxhash64(*cols), *cols))
    found = common.map_batches(known.withColumn("_k_n", one).where("_k_n = 1 OR _k_fp IS NULL").select(*cols, "_k_fp"),
                               run, schema)
    return found.unionByName(docs.where(F.col(id_col).isNull()))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs, words=4, num=85, den=100).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.x, p.y FROM p JOIN s a ON a.doc_id = p.x JOIN s b ON b.doc_id = p.y
      WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS root FROM s
          UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""
