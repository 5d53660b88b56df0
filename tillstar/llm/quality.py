"""Quality rules by weak supervision.

Each rule votes for a text (+1), against it (-1) or abstains (0). Expectation
maximisation over all votes estimates how often each rule is right, without
labels, and a text's verdict is its posterior probability of being good, not
the conjunction of all rules. Votes are counted by pattern on the cluster; the
driver sees only the pattern table, at most 3^rules rows.

Null and empty texts have no words and fail the base. Repeated rows are judged
each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import kernels as K

MIN_WORDS = 50
EM_ROUNDS = 50
#: Bounds of a rule's accuracy on bad and on good texts. A bad text is often bad
#: in one way only, so rules may be wrong on most bad texts; the thresholds are
#: such that a rule votes against one good text in 200 at most, which also keeps
#: good and bad from swapping.
LEAST_ACCURACY, MOST_ACCURACY = np.array([[0.02], [0.995]]), np.array([[0.99], [0.9999]])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ALPHA = _UPPER.copy()
_ALPHA[0x61:0x7B] = True

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_alpha", "n_marks")


_LINE = np.ones(256, bool)
_LINE[10] = False


def measure(chunk: K.Chunk) -> list[np.ndarray]:
    """The features of each document of the chunk, in the order of FEATURES."""
    n, data = chunk.n, chunk.data
    count = lambda table: _between(table[data], chunk.offsets)
    s, e, doc = chunk.words(K.SPACE_WORDS)
    n_words = np.bincount(doc, minlength=n)
    word_chars = _between(((data & 0xC0) != 0x80) & K.SPACE_WORDS[data], chunk.offsets)
    # lines: those with a word, less the different ones
    ls, le, ldoc = chunk.lines()
    wordy = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ldoc = ldoc[wordy]
    key = chunk.codes(ls, le, _LINE)[1][wordy] * n + ldoc
    first = np.unique(key, return_index=True)[1]
    n_dup = np.bincount(ldoc, minlength=n) - np.bincount(ldoc[first], minlength=n)
    # words in a 3-word window that occurs twice or more in its document
    h, wdoc, pos = K.windows(K.mix(chunk.codes(s, e, K.SPACE_WORDS)[1].astype(np.uint64) + np.uint64(1)), doc, 3, n, short=False)
    cover = np.zeros(len(s) + 3, np.int64)
    if len(h):
        h = K.mix(h ^ K.mix(wdoc.astype(np.uint64)))
        _, inv, c = np.unique(h, return_inverse=True, return_counts=True)
        p = pos[c[inv] > 1]
        for j in range(3):
            cover[p + j] = 1
    n_repeat = K.per_doc(cover[:len(s)], doc, n)
    return [n_words, word_chars, count(_SYMBOL), n_dup, n_repeat, count(_UPPER), count(_ALPHA),
            _between(data == 0x21, chunk.offsets)]


def _between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, and the features of its whole text as
    ``_f_<name>`` (so that no column of the input clashes)."""
    kept = docs.select(*keep, F.col(text).alias("_f_text"))
    schema = kept.drop("_f_text").schema
    for f in FEATURES:
        schema = schema.add(f"_f_{f}", "long")

    def run(b):
        cols = [[] for _ in FEATURES]
        for c in K.chunks(b.column("_f_text")):
            for got, new in zip(cols, measure(c)):
                got.append(new)
        yield pa.RecordBatch.from_arrays(
            [b.column(k) for k in range(len(keep))] + [pa.array(np.concatenate(c).astype(np.int64)) for c in cols],
            names=schema.names)
    return common.map_batches(kept, run, schema)


def _vote(good, bad):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, F.Column]:
    """One column of -1, 0 or 1 for each rule."""
    f = {n: F.col(f"_f_{n}") for n in FEATURES}
    words = F.greatest(f["n_words"], F.lit(1))
    mean = f["word_chars"] / words
    share = lambda x, by: x / F.greatest(by, F.lit(1))
    return {
        "length": _vote(f["n_words"] >= 50, f["n_words"] < 20),
        "word_length": _vote((mean >= 2.5) & (mean <= 12), (mean < 2) | (mean > 16)),
        "symbols": _vote(share(f["n_symbols"], words) <= 0.02, share(f["n_symbols"], words) > 0.2),
        "dup_lines": _vote(share(f["n_dup_lines"], words) <= 0.01, share(f["n_dup_lines"], words) > 0.04),
        "repeats": _vote(share(f["n_repeat_words"], words) <= 0.15, share(f["n_repeat_words"], words) > 0.4),
        "capitals": _vote(share(f["n_upper"], f["n_alpha"]) <= 0.15, share(f["n_upper"], f["n_alpha"]) > 0.4),
        "marks": _vote(share(f["n_marks"], words) <= 0.05, share(f["n_marks"], words) > 0.3),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Posterior probability of good for each vote pattern.

    patterns: (p, rules) of -1, 0, 1; counts: rows with the pattern. The
    model: rules are independent given the truth, and a rule that doesn't
    abstain is right with its own probability for good and for bad texts."""
    up, down = patterns == 1, patterns == -1
    post = np.where(down.any(1), 0.1, 0.9)       # to begin with: no vote against
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])      # of bad, of good
        right = np.stack([weight[0] @ down, weight[1] @ up])
        acc = (right + [[0.5], [5.0]]) / (weight @ (up | down) + [[1.0], [5.5]])
        acc = np.clip(acc, LEAST_ACCURACY, MOST_ACCURACY)
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.05, 0.95))
        good = np.log(prior) + up @ np.log(acc[1]) + down @ np.log1p(-acc[1])
        bad = np.log1p(-prior) + down @ np.log(acc[0]) + up @ np.log1p(-acc[0])
        post = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
    return post


def _code() -> F.Column:
    return sum((c + 1) * 3 ** i for i, c in enumerate(votes().values())).cast("int")


def posteriors(coded: DataFrame) -> DataFrame:
    """(_f_code, _f_posterior) of the vote patterns of ``coded``, fitted on all
    its rows."""
    rules = len(votes())
    seen = coded.groupBy("_f_code").count().collect()      # at most 3^rules rows
    codes = np.array([r[0] for r in seen], np.int64)
    patterns = np.stack([codes // 3 ** i % 3 - 1 for i in range(rules)], 1)
    post = fit(patterns, np.array([r[1] for r in seen], float)) if len(codes) else []
    return coded.sparkSession.createDataFrame(
        [(int(c), float(p)) for c, p in zip(codes, post)], "_f_code int, _f_posterior double")


def _verdict(rows: DataFrame, known: DataFrame) -> DataFrame:
    failed = (F.col("_f_n_words") < MIN_WORDS) | (100 * F.col("_f_n_repeat_words") > 50 * F.col("_f_n_words"))
    return (rows.join(F.broadcast(known), "_f_code").drop("_f_code")
            .withColumn("_f_base_failed", failed)
            .withColumn("_f_kept", ~failed & (F.col("_f_posterior") >= 0.5)))


def judge(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` (short columns) plus the features, ``_f_base_failed``,
    ``_f_posterior`` and ``_f_kept``. Texts are measured once."""
    rows = common.cut(features(docs, keep, text).withColumn("_f_code", _code()), "quality")
    return _verdict(rows, posteriors(rows))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rejected rows. Texts are measured twice instead of
    being moved or written: once for the fit, once for the verdict."""
    common.prepare(docs.sparkSession)
    known = posteriors(features(docs, [], text).select(_code().alias("_f_code")))
    rows = features(docs, docs.columns, text).withColumn("_f_code", _code())
    return _verdict(rows, known).where("_f_kept").select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return out.select("doc_id", *(F.col(f"_f_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
        F.round("_f_posterior", 6).alias("posterior"))
