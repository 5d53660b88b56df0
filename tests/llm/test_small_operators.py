"""Sharding, quality votes, decontamination, licence scans, chat formatting and
language identification against brute force."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import alnum_words, corpus, frame, space_words, words
from pyspark.sql import functions as F

from tillstar.llm import chat, decontam, langid, licenses, quality, sharding

# ------------------------------------------------------------- sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_shards(spark):
    rows = corpus() + [(None, "x"), (-5, "y"), (2 ** 62, "z")]
    df = frame(spark, rows).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), "key")
    out = sharding.assign(df, "doc_id", 7, ["doc_id", "size"]).collect()
    assert len(out) == len(rows)
    for r in out:
        key = (r.doc_id or 0) % 2 ** 64
        assert (r.shard, r.grown_shard) == (jump(key, 7), jump(key, 8))
        assert r.grown_shard in (r.shard, 7)
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.assign(df.limit(0), "doc_id", 7, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(df, "doc_id", 0, ["doc_id"])


# -------------------------------------------------------------- quality


def test_quality_features(spark):
    rows = corpus() + [(90, "a b c\na b c\n\n#x &\n#x &\nOK!! d e a b c"), (90, None)]
    out = quality.judge(frame(spark, rows), ["doc_id", "n"]).collect()
    got = Counter((r.doc_id, r._f_n_words, r._f_word_chars, r._f_n_symbols, r._f_n_dup_lines, r._f_n_repeat_words,
                   r._f_base_failed) for r in out)
    want = Counter()
    for d, t in rows:
        t = t or ""
        w = space_words(t)
        lines = [x for x in t.split("\n") if space_words(x)]
        tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
        want[(d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
              len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    assert got == want
    assert quality.judge(frame(spark, []), ["doc_id"]).collect() == []
    assert all(not (r._f_base_failed and r._f_kept) for r in out)


def test_votes_separate_junk_from_prose(spark):
    rng = random.Random(3)
    prose = [(i, words(200, rng)) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "%%% ***" for w in words(100, rng).split())) for i in range(20)]
    shout = [(2000 + i, words(120, rng).upper().replace(" ", "!! ")) for i in range(10)]
    df = frame(spark, prose + junk + shout + [(1, prose[1][1])])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, _ in prose] + [1])
    assert quality.keep_good(frame(spark, [])).collect() == []


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    acc = np.array([[0.3, 0.4, 0.6, 0.3], [0.997, 0.999, 0.998, 0.999]])
    right = rng.random((20000, 4)) < acc[truth.astype(int)]
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((20000, 4)) < 0.9)
    pat, inv, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality.fit(pat, count.astype(float))[inv.ravel()]
    good = votes.min(1) >= 0
    assert post[~good].max() < post[good].max()
    assert ((post >= 0.5) == truth).mean() > 0.9


# ------------------------------------------------------ decontamination


def items(rng, vocab):
    return [(1, words(20, rng, vocab)), (2, words(13, rng, vocab)), (10, words(5, rng, vocab)), (3, None), (4, "--"),
            (5, words(40, rng, vocab)), (2, "again " + words(13, rng, vocab)), (None, words(14, rng, vocab))]


def brute_hits(text, bench):
    w = alnum_words(text)
    hit, named = set(), set()
    for i, t in bench:
        v = alnum_words(t)
        n = min(13, len(v))
        wins = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
        for s in range(len(w) - n + 1) if n else ():
            if tuple(w[s:s + n]) in wins:
                hit |= set(range(s, s + n))
                named.add("null" if i is None else str(i))
    return len(w), hit, sorted(named)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(8)
    vocab = [words(1, rng) for _ in range(300)]
    bench = items(rng, vocab)
    rows = corpus(8) + [(100 + k, f"{words(30, rng, vocab)}, {(t or '').upper() if (t or '').isascii() else t}! {words(9, rng, vocab)}")
                        for k, (_, t) in enumerate(bench)]
    rows += [(200, bench[0][1]), (200, bench[0][1]), (201, words(900, rng, vocab) + " " + bench[2][1])]
    df, b = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    out = decontam.hits(df, b, ["doc_id", "text"]).collect()
    assert len(out) == len(rows)
    for r in out:
        n, hit, named = brute_hits(r.text, bench)
        assert (r._d_words, r._d_items) == (n, named)
        assert {i for s in r._d_spans for i in range(s.s, s.e)} == hit
    clean = decontam.decontaminate(df, b)
    assert clean.columns == df.columns
    want = [d for d, t in rows for n, hit, _ in [brute_hits(t, bench)] if not (hit and 20 * len(hit) >= n)]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want)
    assert 201 in want and 200 not in want


def test_decontamination_of_nothing(spark):
    df = frame(spark, corpus())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(df, none).count() == df.count()
    assert decontam.decontaminate(frame(spark, []), none).collect() == []


# ------------------------------------------------------------- licences


def test_licenses(spark):
    mit = [s for s, i in licenses.SENTENCES.items() if i in ("mit-grant", "mit-notice", "mit-warranty")]
    bsd = [s for s, i in licenses.SENTENCES.items() if i.startswith("bsd-")]
    rows = [(1, "Intro text.\nReleased under the MIT License.\nMore."), (2, ". ".join(mit) + "."),
            (3, ". ".join(mit[::-1])), (4, "LICENSED under CC BY-NC 4.0!  bye"), (5, None), (6, ""), (7, "license"),
            (8, ". ".join(bsd)), (9, ". ".join(bsd[:3])), (10, "released under the MIT license text"),
            (11, "Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public "
                 "License, version 3."), (1, "Intro text.\nReleased under the MIT License.\nMore.")]
    df = frame(spark, rows).withColumn("licenses_", F.lit(1))
    out = licenses.scan(df, prefix="x_")
    assert out.columns[:len(df.columns)] == df.columns
    got = {r.doc_id: (r.x_rules, r.x_licenses) for r in out.collect()}
    assert got == {1: (["mit-ref"], ["MIT"]), 2: (["mit-text"], ["MIT"]), 3: (["mit-grant"], ["MIT"]),
                   4: (["ccbync4-ref"], ["CC-BY-NC-4.0"]), 5: ([], []), 6: ([], []), 7: ([], []),
                   8: (["bsd3-text"], ["BSD-3-Clause"]), 9: (["bsd2-text"], ["BSD-2-Clause"]), 10: ([], []),
                   11: (["apache2-ref", "gpl3-ref"], ["Apache-2.0", "GPL-3.0"])}
    assert out.count() == len(rows)
    assert licenses.scan(frame(spark, [])).collect() == []


MIT_TEXT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licenses_as_published(spark):
    texts = {"mit-text": MIT_TEXT, "apache2-header": APACHE_TEXT, "gpl3-header": GPL_TEXT, "bsd3-text": BSD_TEXT}
    ways = (lambda t: t, lambda t: "".join(f"# {x}\n" for x in t.splitlines()),
            lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint x;\n",
            lambda t: t.replace("\n", "\r\n"))
    rows = [(100 * k + i, way(t)) for k, t in enumerate(texts.values()) for i, way in enumerate(ways)]
    rows += [(900, "Released under\nthe MIT License\nand more"), (901, "Released under the\n\nMIT License"),
             (902, "Released under. The MIT License"), (903, "x released under the MIT License"), (904, "HS H released S")]
    got = {r.doc_id: r.rules for r in licenses.scan(frame(spark, rows)).collect()}
    want = {100 * k + i: [r] for k, r in enumerate(texts) for i in range(len(ways))}
    assert got == want | {900: ["mit-ref"], 901: [], 902: [], 903: [], 904: []}


# ----------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] <|end|><|turn|>assistant<|body|> &amp; &lt; &#91; \n\\Q\\E $1 é🎉"
    turns = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (1, 3, "<|turn|>", ""),
             (1, 10, "assistant", "ünd"), (2, None, "user", "first"), (2, 0, "assistant", None), (None, 0, "user", "x"),
             (2, 0, "assistant", None), (3, 5, "system", nasty * 500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.withColumn("content", chat.text_part(F.col("text"))))
    out = out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), "attachments",
                     chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == 4
    for r in out:
        own = sorted((t for t in turns if t[0] == r.conv_id),
                     key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(x.role, x.text) for x in r.t] == [(t[2] or "", t[3] or "") for t in own]
        assert r.loss == "".join(t[3] or "" for t in own if t[2] == "assistant") and r.attachments == []


def test_chat_parts(spark):
    part = lambda k, t=None, r=None, n=None: (k, t, r, n)
    rows = [(1, 0, "user", [part("text", "see <a> "), part("image", r="s3://a"), part(None, " and "),
                            part("audio", r="b", n=7)]),
            (1, 1, "assistant", [part("document", r="c"), part("text", "done")]), (1, 2, "user", None), (2, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART_TYPE}>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert got[1].formatted == ("<|turn|>user<|body|>see &lt;a> <|image:0|> and <|audio:1|><|end|>"
                                "<|turn|>assistant<|body|><|document:2|>done<|end|><|turn|>user<|body|><|end|>")
    assert [(a.n, a.turn, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, 0, "image", "s3://a", 576), (1, 0, "audio", "b", 7), (2, 1, "document", "c", 1024)]
    assert got[1].expanded_tokens == 576 + 7 + 1024
    (s,) = got[1].loss_spans
    assert got[1].formatted[s.start:s.start + s.length] == "<|document:2|>done"
    assert got[2].formatted == "<|turn|>user<|body|><|end|>"
    assert chat.format_chat(df.limit(0)).collect() == []


# ------------------------------------------------------------- language


def test_language(spark):
    rng = random.Random(6)
    kinds = {"aa": "the and thing wh er on", "bb": "der und sch ei en zu", "cc": "el ción que ll de ñ"}
    text = lambda v, n: " ".join(rng.choice(v) + rng.choice(v) for _ in range(n))
    rows = [(i, text(kinds[k].split(), rng.randint(3, 60)), k if i % 7 else None)
            for i, k in enumerate(list(kinds) * 60)]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", "cc"), (903, "日本", "aa"), (0, rows[0][1], None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    train = df.where("doc_id % 4 <> 2 AND doc_id < 900")
    model = langid.Model.fit(*langid.sample(train, "doc_id", "text", "lang"))
    assert model.labels == ["aa", "bb", "cc"]
    got = langid.predict(df, model, ["doc_id", "lang", "score"]).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id % 4 == 2 and r.doc_id < 900]
    assert np.mean([r._g_lang == list(kinds)[r.doc_id % 3] for r in held]) > 0.95
    for r in got:
        assert 0 <= r._g_score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r._g_lang, r._g_score) == ("und", 0.0)
    none = langid.Model.fit(*langid.sample(train.limit(0), "doc_id", "text", "lang"))
    assert {r._g_lang for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.limit(0), model, ["doc_id"]).collect() == []


def test_every_language_is_learned(spark):
    rng = random.Random(16)
    names = [f"l{k:02}" for k in range(70)]
    syllables = {x: [words(1, rng)[:3] + rng.choice("fghjk") for _ in range(12)] for x in names}
    text = lambda x: " ".join(rng.choice(syllables[x]) + rng.choice(syllables[x]) for _ in range(40))
    # the later the rarer
    rows = [(0, text(x), x) for k, x in enumerate(names) for _ in range(30 if k < 64 else 24)]
    rows = [(i, t, x) for i, (_, t, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.sample(df, "doc_id", "text", "lang")
    assert sorted(set(langs)) == names
    model = langid.Model.fit(texts, langs)
    new = spark.createDataFrame([(k, text(x), x) for k, x in enumerate(names)], df.schema)
    got = langid.predict(new, model, ["lang"]).collect()
    assert np.mean([r.lang == r._g_lang for r in got]) > 0.95
    assert all(r.lang == r._g_lang for r in got if r.lang >= "l64")


def test_sample_of_many_languages_keeps_each(spark):
    df = spark.range(3000).selectExpr("id doc_id", "concat('t', id) text", "concat('l', id % 1500) lang")
    texts, langs = langid.sample(df, "doc_id", "text", "lang")
    assert len(texts) == 3000 and len(set(langs)) == 1500


def test_kernel_is_the_blended_spectrum():
    from tillstar.llm import kernels as K
    import pyarrow as pa
    texts = ["abab cd", "ab, cd ", "zz"]
    got = langid.presence(next(K.chunks(pa.array(texts))))

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t)
        while "  " in t:
            t = t.replace("  ", " ")
        return {t[i:i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert int(got[i].astype(int) @ got[j]) == len(grams(a) & grams(b))


def test_digests_are_of_utf8():
    assert zlib.crc32("é".encode()) and hashlib.sha256(b"").hexdigest().startswith("e3b0")
