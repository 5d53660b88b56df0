import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus import corpus, frame, twins

from tillstar.llm import suffix_dedup as S


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(x[s:s + width] for x in texts for s in range(len(x) - width + 1))
    out = []
    for (d, _), x in zip(rows, texts):
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - width + 1):
            if seen[x[s:s + width]] > 1:
                gone[s:s + width] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(x) else 0
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [256, 1])        # by suffix arrays; by counting
def test_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MAX_REGIONS", most)
    monkeypatch.setattr(S, "SORT_BYTES", 2000)
    rows = corpus(7) + [(None, corpus(7)[3][1]), (None, None), (5, "another text of the same id" * 30)]
    got = S.dedup(frame(spark, rows)).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 400)


def test_empty_table(spark):
    assert S.dedup(frame(spark, [])).collect() == []


def test_two_stage_sort_is_a_suffix_array():
    rng = random.Random(5)
    for alphabet in ("ab", "abcdefgh", "a"):
        for n in (1, 2, 50, 400):
            raw = np.frombuffer("".join(rng.choice(alphabet) for _ in range(n)).encode(), np.uint8)
            text = np.append(raw.astype(np.uint16) + 1, 0).astype(np.uint16)
            want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
            assert S.two_stage_sort(text, len(text)).tolist() == want


@pytest.mark.parametrize("most", [256, 1])
def test_texts_made_to_collide(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MAX_REGIONS", most)
    one, two = twins()
    rows = [(1, one), (2, two), (3, "c" + one[:600]), (4, "x" + two[300:] + "y"), (5, one[:399])]
    got = S.dedup(frame(spark, rows)).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 400)
