"""Language identification with a blended-spectrum presence string kernel.

k(x, y) = |grams shared| / sqrt(|grams of x| |grams of y|), the grams being the
distinct byte n-grams of ORDERS of the letters-and-spaces form of a text,
hashed to SLOTS places (a hashed presence kernel is a kernel too). Landmarks of
the training sample give a Nystrom map; one-versus-rest kernel ridge regression
is solved in that map. A batch's scores are presence rows times landmark rows,
scaled, times the weights; as that is linear in the presence rows, landmarks and
weights are multiplied once, and each batch needs one matrix product.

The classifier is fitted on a bounded sample of every language: about PER_LANG
documents of each, or less if there are so many languages that SAMPLE is passed,
but never less than LEAST (or all, where there are fewer), chosen by a hash of
the document id. Landmarks grow with the languages. Prediction reads whole texts.

Null texts and texts without a letter are ``und`` with score 0, as are all
texts if there is nothing to learn from. Equal scores go to the first language
by name. Repeated rows get equal predictions. Empty tables: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import kernels as K

ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 15
PER_LANG, SAMPLE, LEAST = 300, 19200, 20
LANDMARKS = 256
#: Landmarks of a language: up to as many, while they are 2048 at most, then two.
MARKS = 8
RIDGE = 1e-2
#: Sharpens ridge scores into a share between 0 and 1.
SHARPNESS = 8.0
#: Documents in one matrix product.
BLOCK = 64

# one class for everything that isn't a letter byte: a blank
_FORM = np.full(256, 0x20, np.uint8)
_FORM[0x80:] = np.arange(0x80, 0x100)
_FORM[0x61:0x7B] = np.arange(0x61, 0x7B)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def presence(chunk: K.Chunk) -> np.ndarray:
    """(documents, SLOTS) of 0 and 1: the grams in each document."""
    x = _FORM[chunk.data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)       # runs of blanks are one
    keep[chunk.offsets[:-1][chunk.offsets[:-1] < len(x)]] = True
    doc = np.repeat(np.arange(chunk.n), np.diff(chunk.offsets))[keep]
    x = x[keep].astype(np.uint32) + np.uint32(1)
    out = np.zeros((chunk.n, SLOTS), np.uint8)
    h = np.zeros(len(x), np.uint32)
    for k in range(max(ORDERS)):
        if len(x) <= k:
            break
        h = h[:len(x) - k] * np.uint32(0x01000193) + x[k:] * _MULT[k]
        if k + 1 in ORDERS:
            same = doc[:len(x) - k] == doc[k:]
            slot = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS.bit_length() + 1)
            out[doc[:len(slot)][same], slot[same]] = 1
    return out


class Model:
    """Labels and the (SLOTS, languages) weights of presence rows."""

    def __init__(self, labels: list[str], weights: np.ndarray):
        self.labels, self.weights = labels, weights

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> "Model":
        labels = sorted(set(langs))
        if not labels:
            return cls([], np.zeros((SLOTS, 0), np.float32))

        def rows(texts):
            """(presence rows, their norms), BLOCK texts at once."""
            for c in _few(pa.array(texts, pa.large_string())):
                r = presence(c)
                yield r.astype(np.float32), np.sqrt(np.maximum(r.sum(1, dtype=np.float64), 1))[:, None]
        # landmarks in turn from each language
        seen: dict[str, int] = {}
        place = [seen[x] for x in langs if not seen.update({x: seen.get(x, -1) + 1})]
        turn = np.argsort(place, kind="stable")
        marks = turn[:max(LANDMARKS, min(MARKS * len(labels), 2048), 2 * len(labels))]
        m = np.concatenate([(r / s).astype(np.float32) for r, s in rows([texts[i] for i in marks])])
        k_mm = (m @ m.T).astype(np.float64)
        vals, vecs = np.linalg.eigh(k_mm)
        good = vals > 1e-6 * vals.max()
        to_map = vecs[:, good] / np.sqrt(vals[good])          # Nystrom: k(x, marks) @ to_map
        phi = np.concatenate([(r @ m.T) / s @ to_map for r, s in rows(texts)])
        y = np.where(np.array(langs)[:, None] == np.array(labels)[None], 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + RIDGE * len(y) * np.eye(phi.shape[1]), phi.T @ y)
        return cls(labels, (m.T.astype(np.float64) @ (to_map @ w)).astype(np.float32))

    def predict(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(label index, score) of each document of the chunk."""
        rows = presence(chunk).astype(np.float32)
        raw = (rows @ self.weights) / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
        p = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best].astype(np.float64)


def sample(docs: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], list[str]]:
    """The bounded training sample of the labelled rows of ``docs``."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(lang).count().collect()             # one row a language, as in the model
    if not counts:
        return [], []
    per = min(PER_LANG, max(LEAST, SAMPLE // len(counts)))
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, per / n)) for name, n in counts], "_g_l string, _g_share double")
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    # languages that are taken whole first, then all others alike
    rows = (known.select(draw.alias("d"), F.col(text).alias("_g_text"), F.col(lang).alias("_g_lang"))
            .join(F.broadcast(shares), F.col("_g_lang") == F.col("_g_l")).where("d < _g_share")
            .orderBy(F.col("_g_share") < 1, F.col("d") / F.col("_g_share"), "_g_lang", "_g_text")
            .limit(2 * per * len(counts)).select("_g_text", "_g_lang").collect())
    return [r[0] for r in rows], [r[1] for r in rows]


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``_g_lang`` and ``_g_score``."""
    kept = docs.select(*keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_g_any"),
                       F.col(text).alias("_g_text"))
    schema = kept.select(*keep).schema.add("_g_lang", "string").add("_g_score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)   # SLOTS floats a language

    def run(b):
        best, score = [], []
        m = shared.value
        for c in _few(b.column("_g_text")):
            k, s = m.predict(c) if m.labels else (np.zeros(c.n, int), np.zeros(c.n))
            best.append(k)
            score.append(s)
        letters = np.array(b.column("_g_any").to_pylist(), bool) & bool(m.labels)
        names = np.array([*m.labels, "und"], object)
        yield pa.RecordBatch.from_arrays(
            [b.column(k) for k in range(len(keep))]
            + [pa.array(names[np.where(letters, np.concatenate(best), len(m.labels))], pa.string()),
               pa.array(np.where(letters, np.concatenate(score), 0.0))], names=schema.names)
    return common.map_batches(kept, run, schema)


def _few(text):
    """Chunks of at most BLOCK documents."""
    for i in range(0, len(text), BLOCK):
        yield from K.chunks(text.slice(i, BLOCK))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = Model.fit(*sample(docs.where(~held), "doc_id", "text", "lang"))
    return predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", F.col("_g_lang").alias("lang_pred"), F.col("_g_score").alias("score"))
