"""A small corpus with everything that may go wrong in it."""
import random
import re

UP = {c: c + 32 for c in range(65, 91)}


def words(n, rng, vocab=None):
    return " ".join(rng.choice(vocab) if vocab else "".join(rng.choice("abcdeéoñtß") for _ in range(rng.randint(1, 9)))
                    for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text): random texts, exact and near copies, shared passages,
    nulls, empty and very long texts, repeated rows, a null id."""
    rng = random.Random(seed)
    vocab = [words(1, rng) for _ in range(400)]
    out, passage = [], words(90, rng, vocab)
    for i in range(n):
        t = words(rng.randint(1, 120), rng, vocab)
        if i % 5 == 1:
            t = out[rng.randrange(len(out))][1]
        if i % 5 == 2:
            w = (out[rng.randrange(len(out))][1] or "x").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 6 == 3:
            t = f"{t}\n{passage}. {words(10, rng, vocab)}"
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "ONE word"), (n + 4, "one WORD"), (n + 5, "a b c d " * 300),
            (n + 6, words(9000, rng, vocab) + "\n" + passage), (n + 7, "é🎉\x00 ▁x"), out[3], out[3], (n + 8, "x" * 1500)]
    return out


def lower(t):
    return (t or "").translate(UP)


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


#: Column names that operators use themselves.
CLASH = ("id", "key", "fp", "n", "cls", "kind", "lo", "sig", "a", "b", "words", "comp")


def frame(spark, rows, extra=True):
    cols = CLASH if extra else ()
    data = [(*r, *(f"{c}{r[0]}" for c in cols)) for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string" + "".join(f", {c} string" for c in cols))


def twins(n=1024):
    """Two different texts that a polynomial hash modulo 2^64 can't tell apart:
    a Thue-Morse word and its complement."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))
