import hashlib
import math
from itertools import product

import numpy as np
from corpus import corpus, frame

from tillstar.llm import kernels as K
from tillstar.llm import segment as S

TOY = [(300, "a", 5.0), (301, "b", 6.0), (302, "ab", 1.0), (303, "▁", 4.0), (304, "▁a", 2.0), (305, "ba", 3.0), (306, "bab", 7.0)]


def toy():
    return S.Pieces(TOY, list(range(256)))


def all_segmentations(text):
    x, known = "▁" + text.replace(" ", "▁"), {p for _, p, _ in TOY}

    def go(i):
        if i == len(x):
            yield ()
        for n in range(1, 4):
            if i + n <= len(x) and x[i:i + n] in known:
                yield from ((x[i:i + n], *r) for r in go(i + n))
    return list(go(0))


def test_samples_follow_the_law_without_replacement():
    text, pieces, n, k = "abab ab", toy(), 4000, 3
    segs = all_segmentations(text)
    lat = S.Lattice([text] * n, pieces)
    lp = {p: None for _, p, _ in TOY}
    one = S.Lattice(["abab"], pieces)
    assert one.logp.shape[0]
    by_id = {i: p for i, p, _ in TOY}
    mass = math.log(sum(1 / (r + S.ZIPF_SHIFT) for _, _, r in TOY) + 256 / (7 + S.ZIPF_SHIFT))
    lp = {p: S.ALPHA * (-math.log(r + S.ZIPF_SHIFT) - mass) for _, p, r in TOY}
    law = np.exp([sum(lp[p] for p in s) for s in segs])
    law /= law.sum()
    place = {s: i for i, s in enumerate(segs)}
    keys = K.mix(np.arange(n).astype(np.uint64) + np.uint64(99))
    first, second, total = np.zeros(len(segs)), np.zeros(len(segs)), 0.0
    for paths, kappa in S.top_k(lat, keys, k):
        ids = [place[tuple(by_id[i] for i in lat.piece_ids(p.word, p.node, p.n).tolist())] for p in paths]
        assert len(set(ids)) == k
        scores = [p.score for p in paths]
        assert scores == sorted(scores, reverse=True) and kappa <= scores[-1]
        assert all(abs(p.logp - math.log(law[i])) < 1e-5 for p, i in zip(paths, ids))
        first[ids[0]] += 1
        second[ids[1]] += 1
        total += sum(law[i] / math.exp(S._log_inclusion(p.logp - kappa)) for p, i in zip(paths, ids))
    want2 = [sum(law[j] * law[i] / (1 - law[j]) for j in range(len(law)) if j != i) for i in range(len(law))]
    assert np.abs(first / n - law).max() < 0.03 and np.abs(second / n - want2).max() < 0.03
    assert abs(total / n - 1) < 0.05


def test_all_segmentations_when_few():
    pieces = toy()
    (paths, kappa), = S.top_k(S.Lattice(["ab"], pieces), np.array([5], np.uint64), 50)
    assert len(paths) == len(all_segmentations("ab")) and kappa == -np.inf


def test_round_trip_of_anything():
    pieces = S.Pieces.load(S.MODEL_PATH)
    texts = ["", " ", "  a ", "▁", "a▁ b", "\x00\n\t", "é🎉\U0010ffff", "x" * 5000, *("".join(p) for p in product(" ▁a", repeat=3))]
    for rows, t in zip(S.sample_texts(texts, np.arange(len(texts)).astype(np.uint64), pieces, 3, 3), texts):
        assert rows and all(r["exact"] and pieces.decode(r["ids"]) == t for r in rows)
        assert len({tuple(r["ids"]) for r in rows}) == len(rows)


def test_rows_are_the_same_in_any_chunk(spark, monkeypatch):
    rows = corpus()
    df = frame(spark, rows + [(None, "null id")])
    whole = S.encode(df, "doc_id", ["doc_id", "n"], k=2).collect()
    monkeypatch.setattr(S, "CHUNK_BYTES", 500)
    again = S.encode(df.repartition(5), "doc_id", ["doc_id", "n"], k=2).collect()
    plain = lambda rows: sorted((str(r.doc_id), r.n, [(s.ids, s.sha256, round(s.logp, 6), round(s.score, 6))
                                                      for s in r._s_samples]) for r in rows)
    assert plain(whole) == plain(again)
    assert all(s.exact for r in whole for s in r._s_samples)
    assert S.encode(frame(spark, []), "doc_id", ["doc_id"]).collect() == []


def test_all_samples_keep_their_ids(spark):
    rows = [(1, "a few words"), (2, "Ünïcode \U0001f389 a few"), (3, None), (4, "")]
    df = frame(spark, rows)
    pieces = S.Pieces.load(S.MODEL_PATH)
    for r in S.encode(df, "doc_id", ["doc_id"]).collect():
        assert len(r._s_samples) == (1 if r.doc_id > 2 else S.SAMPLES)
        for s in r._s_samples:
            ids = np.array(s.ids, "<i4")
            assert len(ids) == s.n_pieces and hashlib.sha256(ids.tobytes()).hexdigest() == s.sha256
            assert pieces.decode(s.ids) == (dict(rows)[r.doc_id] or "")


def test_op7_returns_the_ids(spark, tmp_path):
    frame(spark, [(1, "a few words"), (2, "more of them")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op7(spark, str(tmp_path)).collect()
    assert [[len(i) for i in r.ids] for r in got] == [r.n_pieces for r in got] and all(len(r.ids) == S.SAMPLES for r in got)


def test_words_kept_between_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(400)}é{rng.integers(9)}" for _ in range(40)) for _ in range(30)]
    keys = np.arange(len(texts)).astype(np.uint64)
    plain = lambda rows: [[(r["sha256"], round(r["logp"], 9), round(r["score"], 9)) for r in x] for x in rows]
    want = plain(S.sample_texts(texts, keys, S.Pieces.load(S.MODEL_PATH), 2))
    for room in (1, 500, 4000, 1 << 18):
        monkeypatch.setattr(S, "NODES", room)
        pieces, got = S.Pieces.load(S.MODEL_PATH), []
        for _ in range(2):
            got = [x for i in range(0, 30, 4) for x in plain(S.sample_texts(texts[i:i + 4], keys[i:i + 4], pieces, 2))]
        assert got == want
