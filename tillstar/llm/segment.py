"""SentencePiece encoding and decoding with sampled segmentations.

A text's segmentations into pieces of a given vocabulary form a lattice. Gumbel
top-k gives ``k`` distinct segmentations, without replacement, in proportion to
their probability: every segmentation has its log probability perturbed by
Gumbel noise, and perturbed A-star search finds the k largest without listing
them. A node (a beginning of the text in pieces) stands for all segmentations
that begin so; its bound is the largest perturbed score among them, sampled top
down: one child inherits it, the others' noise is drawn below it. The exact log
mass of what can follow (backward sums over the lattice) is the heuristic.

No piece crosses from a letter to a blank, so the lattice of a text is a chain
of lattices of its blank-led words; equal words share theirs. Walking the best
branch and bounding all branches that leave it is done for all texts of a chunk
at once.

Each sample has its log probability, its perturbed score, and the log of its
inclusion score 1 - exp(-exp(logp - kappa)), kappa being the (k+1)-th perturbed
score, so that sums over samples weighted by 1 / inclusion are unbiased.

Pieces come from a model file (a parameter), whose scores are merge ranks; a
piece's probability follows Zipf's law in its rank. Characters without a piece
become their UTF-8 bytes. Decoding is exact: texts may hold anything, the blank
mark itself included. The noise is seeded by the row's key and the place in the
text: a lost task's rows come out the same, equal rows have equal samples.

Null is the empty text: its one segmentation is the mark that begins every text.
A text with fewer than ``k`` segmentations gets them all, with inclusion 1 (log 0). A
null key counts as 0. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import kernels as K

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 17
CHUNK_BYTES = 1 << 19
#: Nodes of words that a worker keeps, of some 220 bytes each; the later half goes when it is full.
NODES = 1 << 19
MARK = 0x2581
#: Exponent of the pieces' probabilities: the smaller, the more varied the samples.
ALPHA = 0.3
#: Added to a piece's merge rank in Zipf's law.
ZIPF_SHIFT = 10.0
_LITERAL_MARK = 0x7FFFFFFF          # the blank mark as a character of the text
_ALMOST = np.float32(1 - 2.0 ** -24)
_MULT = 0x9E3779B97F4A7C15


class Pieces:
    """The vocabulary: pieces by length and hash, log probabilities, bytes."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int]):
        """``pieces``: (id, text, merge rank); ``byte_ids``: of the 256 bytes."""
        self.byte_ids = np.array(byte_ids, np.int32)
        self.max_len = max(len(p) for _, p, _ in pieces)
        rank = np.array([r for _, _, r in pieces])
        mass = np.log(np.sum(1 / (rank + ZIPF_SHIFT)) + 256 / (rank.max() + ZIPF_SHIFT))
        self.byte_logp = float(-np.log(rank.max() + ZIPF_SHIFT) - mass)
        self.text = {i: p.replace(chr(MARK), " ").encode() for i, p, _ in pieces}
        self.text |= {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        self.by_id = [self.text.get(i, b"") for i in range(max(self.text) + 1)]
        self.coded = pa.array(self.by_id, pa.large_binary())
        self.nodes: Nodes | None = None         # of the words met in this process
        self.tables = {}
        for n in range(1, self.max_len + 1):
            own = [(i, p, r) for i, p, r in pieces if len(p) == n]
            if not own:
                continue
            cps = np.frombuffer("".join(p for _, p, _ in own).encode("utf-32-le"), np.uint32)
            at = np.arange(0, len(cps), n)
            h = K.Spans(cps).hash(at, at + n)
            o = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[h >> np.uint64(48)] = True
            self.tables[n] = (seen, h[o], np.array([i for i, _, _ in own], np.int32)[o],
                              -np.log(np.array([r for _, _, r in own])[o] + ZIPF_SHIFT) - mass)
        # beginnings of n characters of longer pieces, by the high bits of their hash
        self.begun = {}
        for n in range(1, self.max_len):
            own = sorted({p[:n] for _, p, _ in pieces if len(p) > n})
            at = np.arange(0, len(own) * n, n)
            h = K.Spans(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)).hash(at, at + n)
            self.begun[n] = np.zeros(1 << 20, bool)
            self.begun[n][h >> np.uint64(44)] = True

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        rank = iter(range(n))
        return cls([(i, m.id_to_piece(i), next(rank)) for i in range(n)
                    if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))], byte_ids)

    def decode(self, ids) -> str:
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8")[1:]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """:meth:`decode` of each, at once."""
        cut = np.cumsum([0, *map(len, ids)])
        got = self.coded.take(pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        at = np.frombuffer(got.buffers()[1], np.int64)[got.offset + cut].tolist()
        raw = got.buffers()[2].to_pybytes() if got.buffers()[2] is not None else b""
        return [raw[a:b].decode("utf-8")[1:] for a, b in zip(at[:-1], at[1:])]


def _uniform(key: np.ndarray, place, salt: int) -> np.ndarray:
    """In (0, 1), by the row's key and a place in its text."""
    h = K.mix(key + K.mix(np.asarray(place).astype(np.uint64) * np.uint64(64) + np.uint64(salt)))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


def _gumbel(u):
    return -np.log(-np.log(u))


def _below(bound, value):
    """Gumbel noise conditioned on staying below ``bound``."""
    return -np.logaddexp(-bound, -value)


class Nodes:
    """Lattices of different words, kept from chunk to chunk: one node for each
    place in a word and one for its end. ``logp[node, n - 1]``: of the piece of n
    characters; ``rest``: log mass of what can follow; ``upto``: how far each of
    its pieces reaches into (0, 1)."""

    def __init__(self, pieces: Pieces, room: int):
        self.pieces, self.used = pieces, 0
        self.key, self.base = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.left, self.char = np.zeros(room, np.int64), np.zeros(room, np.uint32)
        self.logp = np.empty((room, pieces.max_len), np.float32)
        self.ids = np.empty((room, pieces.max_len), np.int32)
        self.upto = np.empty((room, pieces.max_len), np.float32)
        self.rest = np.zeros(room)

    def find(self, key: np.ndarray) -> np.ndarray:
        """First node of each word, -1 if it isn't here."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.base[at], -1)

    def make_room(self) -> None:
        """The words met first, the frequent ones among them, stay in half of it."""
        kept = self.base < len(self.left) // 2
        self.used = int(self.base[~kept].min(initial=self.used))
        self.key, self.base = self.key[kept], self.base[kept]

    def add(self, key: np.ndarray, s: np.ndarray, n: np.ndarray, x: np.ndarray, raw: np.ndarray, spans: K.Spans) -> None:
        """New words: ``n`` characters from ``s`` on each."""
        base = self.used + np.cumsum(n + 1) - (n + 1)
        total = int((n + 1).sum())
        new = slice(self.used, self.used + total)
        which = np.repeat(np.arange(len(n)), n + 1)
        off = np.arange(new.start, new.stop) - base[which]
        left = n[which] - off                           # characters to the word's end
        place = s[which] + off                          # a node's character
        self.left[new], self.char[new] = left, x[np.minimum(place, len(x) - 1)]
        logp, ids = self.logp[new], self.ids[new]
        logp[:], ids[:], self.upto[new] = -np.inf, -1, 1
        inner = np.flatnonzero(left > 0)
        at = inner
        for m in range(1, self.pieces.max_len + 1):
            at = at[left[at] >= m]
            if not len(at):
                break
            begin = place[at]
            h = spans.hash(begin, begin + m)
            here = at
            if m < self.pieces.max_len:
                at = at[self.pieces.begun[m][h >> np.uint64(44)]]
            if m not in self.pieces.tables:
                continue
            seen, hashes, own, lp = self.pieces.tables[m]
            some = seen[h >> np.uint64(48)]
            here, h = here[some], h[some]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            ok = hashes[k] == h
            logp[here[ok], m - 1], ids[here[ok], m - 1] = ALPHA * lp[k[ok]], own[k[ok]]
        # characters without a piece: their bytes; one byte is one id, more are -1
        lone = inner[np.isneginf(logp[inner, 0])]
        cp = np.where(x[place[lone]] == _LITERAL_MARK, MARK, raw[place[lone]])
        logp[lone, 0] = (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF).astype(int)) * ALPHA * self.pieces.byte_logp
        ascii_ = cp < 0x80
        ids[lone[ascii_], 0] = self.pieces.byte_ids[cp[ascii_]]
        self._backward(new, left)
        self.used = new.stop
        self.key, self.base = np.concatenate((self.key, key)), np.concatenate((self.base, base))
        o = np.argsort(self.key)
        self.key, self.base = self.key[o], self.base[o]

    def _backward(self, new: slice, left: np.ndarray) -> None:
        self.rest[new] = 0
        width = self.pieces.max_len
        order = np.argsort(left.astype(np.int32), kind="stable") + new.start
        cuts = np.searchsorted(self.left[order], np.arange(1, (int(left.max()) if len(left) else 0) + 2))
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
            rows, m = order[a:b], min(r, width)
            mass = self.logp[rows, :m] + self.rest[rows[:, None] + np.arange(1, m + 1)]
            top = mass.max(1)
            run = np.cumsum(np.exp(mass - top[:, None]), axis=1)
            self.rest[rows] = top + np.log(run[:, -1])
            self.upto[rows, :m] = run / run[:, -1:]


class Lattice:
    """Lattices of a few texts. A word is a place where a lattice starts; equal
    words share nodes, and those of the chunks before stay with ``pieces`` as
    long as there is room for NODES of them."""

    def __init__(self, texts: list[str], pieces: Pieces):
        self.pieces = pieces
        # a mark before each text, then one encoding of all
        size = np.array([len(t) + 1 for t in texts])
        self.offsets = np.concatenate(([0], np.cumsum(size)))
        raw = np.frombuffer("".join(x for t in texts for x in (chr(MARK), t)).encode("utf-32-le"), np.uint32)
        x = raw.copy()
        x[raw == MARK] = _LITERAL_MARK
        x[raw == 0x20] = MARK
        x[self.offsets[:-1]] = MARK
        blank = x == MARK
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        head[self.offsets[:-1]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(x))
        self.word_at = start
        self.word_doc = np.searchsorted(self.offsets, start, "right") - 1
        spans = K.Spans(x)
        key, first, kind = np.unique(spans.hash(start, end), return_index=True, return_inverse=True)
        size = (end - start)[first]
        nodes = pieces.nodes = pieces.nodes or Nodes(pieces, NODES)
        new = np.flatnonzero(nodes.find(key) < 0)
        if nodes.used + int((size[new] + 1).sum()) > len(nodes.left):
            nodes.make_room()
            new = np.flatnonzero(nodes.find(key) < 0)
        if nodes.used + int((size[new] + 1).sum()) > len(nodes.left):
            nodes, new = Nodes(pieces, int((size + 1).sum())), np.arange(len(key))      # this chunk's alone
        nodes.add(key[new], start[first[new]], size[new], x, raw, spans)
        self.word_node = nodes.find(key)[kind]
        self.left, self.logp, self.ids, self.rest, self.upto, self.char = (
            nodes.left, nodes.logp, nodes.ids, nodes.rest, nodes.upto, nodes.char)

    def share(self, node, n) -> np.ndarray:
        """Log probability of the pieces of ``n`` characters, given their nodes."""
        return self.logp[node, n - 1] + self.rest[node + n] - self.rest[node]

    def walk(self, words: np.ndarray, skip: np.ndarray, keys: np.ndarray, salt: int):
        """Sample the words on from ``skip`` characters: (word, node, length) of
        each piece, in order."""
        node = self.word_node[words] + skip
        live = np.flatnonzero(self.left[node] > 0)
        got, count = [], np.zeros(len(words), np.int64)
        while len(live):
            at = node[live]
            w = words[live]
            doc = self.word_doc[w]
            place = self.word_at[w] + (at - self.word_node[w]) - self.offsets[doc]
            u = _uniform(keys[doc], place, salt).astype(np.float32)
            n = 1 + (np.minimum(u, _ALMOST)[:, None] > self.upto[at]).sum(1)
            got.append((live, at, n))
            count[live] += 1
            node[live] = at + n
            live = live[self.left[node[live]] > 0]
        start = np.cumsum(count) - count
        out = np.zeros((2, int(count.sum())), np.int64)
        step = np.zeros(len(words), np.int64)
        for live, at, n in got:
            k = start[live] + step[live]
            out[0, k], out[1, k] = at, n
            step[live] += 1
        return np.repeat(words, count), out[0], out[1]

    def piece_ids(self, word, node, n) -> np.ndarray:
        ids = self.ids[node, n - 1]
        bad = np.flatnonzero(ids < 0)
        if not len(bad):
            return ids
        parts, here = [], 0
        for i in bad:
            c = self.char[node[i]]
            raw = chr(MARK if c == _LITERAL_MARK else int(c)).encode()
            parts += [ids[here:i], self.pieces.byte_ids[list(raw)]]
            here = i + 1
        return np.concatenate([*parts, ids[here:]])


class _Path:
    """One sampled segmentation: its pieces, and the bound of all that leaves it
    at each of them (only from ``since`` on; the rest belongs to its parent)."""

    def __init__(self, word, node, n, share, since, score, opened):
        self.word, self.node, self.n = word, node, n
        self.share, self.since, self.score, self.open = share, since, score, opened
        self.logp = float(share.sum())
        self.taken: dict[int, list[int]] = {}

    def logp_before(self, at: int) -> float:
        return float(self.share[:at].sum())


def _leaving(share, cut, before, bound, noise):
    """Bounds of what leaves the paths at each of their pieces, for paths laid end
    to end (``cut``): the log mass before a piece, less the piece's own share."""
    size = np.diff(cut)
    run = np.concatenate(([0.0], np.cumsum(share)))
    mass = run[:-1] - np.repeat(run[cut[:-1]] - before, size)
    with np.errstate(divide="ignore"):
        mass += np.log1p(-np.minimum(np.exp(share), 1.0))
    mass[share > -1e-12] = -np.inf
    return _below(np.repeat(bound, size), mass + noise)


def top_k(lat: Lattice, keys: np.ndarray, k: int) -> list[tuple[list[_Path], float]]:
    """For each text its ``k`` best perturbed segmentations, best first, and the
    score of the next one (-inf if there is none)."""
    docs = len(lat.offsets) - 1
    roots = _gumbel(_uniform(keys, np.zeros(docs), 63))
    paths: list[list[_Path]] = [[] for _ in range(docs)]
    word, node, n = lat.walk(np.arange(len(lat.word_at)), np.zeros(len(lat.word_at), np.int64), keys, 0)
    share = lat.share(node, n)
    doc = lat.word_doc[word]
    place = lat.word_at[word] + (node - lat.word_node[word]) - lat.offsets[doc]
    noise = _gumbel(_uniform(keys[doc], place, 32))
    cut = np.searchsorted(doc, np.arange(docs + 1))
    opened = _leaving(share, cut, np.zeros(docs), roots, noise)
    for d in range(docs):
        s = slice(cut[d], cut[d + 1])
        paths[d].append(_Path(word[s], node[s], n[s], share[s], 0, roots[d], opened[s]))
    words_to = np.searchsorted(lat.word_doc, np.arange(docs), "right")
    kappa = [-np.inf] * docs
    for r in range(1, k + 1):
        forks = []
        for d in range(docs):
            if len(paths[d]) < r:
                continue
            best = max(((p.open.max(), i, int(p.open.argmax())) for i, p in enumerate(paths[d]) if len(p.open)),
                       default=(-np.inf, 0, 0))
            if r == k or best[0] == -np.inf:
                kappa[d] = float(best[0])
                continue
            forks.append((d, *best))
        if not forks:
            continue
        words, skips, tails = [], [], []
        for d, score, i, j in forks:
            p = paths[d][i]
            at = p.since + j
            used = p.taken.setdefault(at, [int(p.n[at])])
            w = int(p.word[at])
            spot = int(lat.word_at[w] + p.node[at] - lat.word_node[w] - lat.offsets[d])     # in the text
            here = int(p.node[at])
            fits = np.arange(1, min(lat.logp.shape[1], int(lat.left[here])) + 1)
            row = lat.share(np.full(len(fits), here), fits)
            row[[m - 1 for m in used]] = -np.inf
            whole = np.exp(row)
            u = float(_uniform(keys[d:d + 1], [spot + (len(used) << 36) + (i << 44)], 33)[0])
            m = 1 + int(min(np.searchsorted(np.cumsum(whole), u * whole.sum()), len(row) - 1))
            while not np.isfinite(row[m - 1]):
                m -= 1
            used.append(m)
            # what is left at this node stays open, below the score just taken
            row[m - 1] = -np.inf
            before = p.logp_before(at)
            left = np.exp(row).sum()
            g = float(_gumbel(_uniform(keys[d:d + 1], [spot + (len(used) << 36) + (i << 44)], 42))[0])
            p.open[j] = _below(score, before + np.log(left) + g) if left > 1e-300 else -np.inf
            end = int(words_to[d])
            words.append(np.arange(w, end))
            skip = np.zeros(end - w, np.int64)
            skip[0] = p.node[at] + m - lat.word_node[w]
            skips.append(skip)
            tails.append((d, score, p, at, m))
        word, node, n = lat.walk(np.concatenate(words), np.concatenate(skips), keys, r)
        doc = lat.word_doc[word]
        place = lat.word_at[word] + (node - lat.word_node[word]) - lat.offsets[doc]
        noise = _gumbel(_uniform(keys[doc], place, 50 + r % 12))
        whose = np.array([t[0] for t in tails])
        begin, end = np.searchsorted(doc, whose), np.searchsorted(doc, whose, "right")
        share = lat.share(node, n)
        forked = [float(lat.share(p.node[at:at + 1], np.array([m]))[0]) for _, _, p, at, m in tails]
        opened = _leaving(share, np.append(begin, len(doc)),
                          np.array([p.logp_before(at) + f for (_, _, p, at, _), f in zip(tails, forked)]),
                          np.array([t[1] for t in tails]), noise)
        for (d, score, p, at, m), b, e, f in zip(tails, begin, end, forked):
            join = lambda a, x, y: np.concatenate((a[:at], [x], y[b:e])).astype(a.dtype)
            paths[d].append(_Path(join(p.word, p.word[at], word), join(p.node, p.node[at], node), join(p.n, m, n),
                                  join(p.share, f, share), at + 1, score, opened[b:e]))
    return [(p, kp) for p, kp in zip(paths, kappa)]


_SAMPLE = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("logp", pa.float64()),
                              ("score", pa.float64()), ("log_inclusion", pa.float64()), ("sha256", pa.string()),
                              ("exact", pa.bool_())]))
_SAMPLE_SQL = ("array<struct<ids:array<int>,n_pieces:long,logp:double,score:double,log_inclusion:double,"
               "sha256:string,exact:boolean>>")


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x < -30:
        return float(x)
    return float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def sample_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int, with_ids: int | None = None):
    """The samples of each text, best first, with their ids (a caller that needs
    fewer names how many). ``exact``: decoding gives the text back."""
    lat = Lattice(texts, pieces)
    found = top_k(lat, keys, k)
    ids = [lat.piece_ids(p.word, p.node, p.n) for paths, _ in found for p in paths]
    decoded = zip(ids, pieces.decode_all(ids))
    out = []
    for text, (paths, kappa) in zip(texts, found):
        rows = []
        for i, p in enumerate(paths):
            own, back = next(decoded)
            rows.append({"ids": own if with_ids is None or i < with_ids else own[:0], "n_pieces": len(own), "logp": p.logp,
                         "score": float(p.score), "log_inclusion": _log_inclusion(p.logp - kappa),
                         "sha256": hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), "exact": back == text})
        out.append(rows)
    return out


def encode(docs: DataFrame, key: str, keep: list[str], text: str = "text", k: int = SAMPLES, with_ids: int | None = None,
           seed: int = SEED, model_path: str = MODEL_PATH) -> DataFrame:
    """``keep`` and ``_s_samples``: an array of up to ``k`` samples, best first,
    all with their ids unless ``with_ids`` says of how many."""
    common.prepare(docs.sparkSession)
    kept = docs.select(*keep, F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_s_key"), F.col(text).alias("_s_text"))
    schema = kept.select(*keep).schema
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))     # a vocabulary: bounded

    def run(b):
        keys = K.mix(b.column("_s_key").to_numpy().view(np.uint64) + np.uint64(seed * _MULT % (1 << 64)))
        texts = b.column("_s_text")
        for c in K.chunks(texts, CHUNK_BYTES):
            got = sample_texts([t or "" for t in texts.slice(c.rows.start, c.n).to_pylist()], keys[c.rows],
                               shared.value, k, with_ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(i).slice(c.rows.start, c.n) for i in range(len(keep))] + [pa.array(got, _SAMPLE)],
                names=[*keep, "_s_samples"])
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return common.map_batches(kept, run, f"{out}, _s_samples {_SAMPLE_SQL}")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    s = F.col("_s_samples")
    each = lambda f: F.transform(s, lambda x: x[f])
    return encode(docs, "doc_id", ["doc_id"]).select(
        "doc_id", F.size(s).cast("long").alias("n_samples"), each("ids").alias("ids"), each("n_pieces").alias("n_pieces"),
        F.transform(each("logp"), lambda x: F.round(x, 6)).alias("logp"),
        F.transform(each("log_inclusion"), lambda x: F.round(x, 6)).alias("log_inclusion"),
        each("sha256").alias("ids_sha256"), F.forall(each("exact"), lambda x: x).alias("round_trip"))
