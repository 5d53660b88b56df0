"""Weighted fuzzy string score (0..100), pure Python, used inside Arrow batches.

Written from the published definition of the score.

The score is the maximum of: the indel similarity of the processed strings;
token-sorted and token-set variants (weighted 0.95); and, when one string is at
least 1.5x longer than the other, the best partial alignment of the shorter
one inside the longer one (weighted 0.9, or 0.6 beyond 8x). Strings are
processed by replacing every non-alphanumeric character with a space,
lower-casing and trimming.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter

_NON_ALNUM = re.compile(r"(?ui)\W|_")

# Fixed values of the score.
UNBASE_SCALE = 0.95
PARTIAL_SCALE = 0.90
LONG_PARTIAL_SCALE = 0.60
PARTIAL_MIN_LEN_RATIO = 1.5
LONG_LEN_RATIO = 8.0


def process(s: str | None) -> str:
    if s is None:
        return ""
    return _NON_ALNUM.sub(" ", str(s)).lower().strip()


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as
    the bits of one integer: a zero bit is a place where the length grows."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for c in a:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """Indel similarity: 2 * LCS / (len(a) + len(b))."""
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 2.0 * _lcs(a, b) / total


def _pct(x: float) -> int:
    return int(round(100 * x))


def ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return _pct(similarity(a, b))


def partial_ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    blocks = difflib.SequenceMatcher(None, short, long_, autojunk=False).get_matching_blocks()
    best = 0.0
    for i, j, _n in blocks:
        start = max(j - i, 0)
        window = long_[start:start + len(short)]
        r = similarity(short, window)
        if r > 0.995:
            return 100
        best = max(best, r)
    return _pct(best)


def _sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def _token_set_parts(a: str, b: str) -> tuple[str, str, str]:
    ta, tb = set(a.split()), set(b.split())
    sect = " ".join(sorted(ta & tb))
    ab = (sect + " " + " ".join(sorted(ta - tb))).strip()
    ba = (sect + " " + " ".join(sorted(tb - ta))).strip()
    return sect.strip(), ab, ba


def token_sort(a: str, b: str, partial: bool = False) -> int:
    f = partial_ratio if partial else ratio
    return f(_sorted_tokens(a), _sorted_tokens(b))


def token_set(a: str, b: str, partial: bool = False) -> int:
    f = partial_ratio if partial else ratio
    sect, ab, ba = _token_set_parts(a, b)
    return max(f(sect, ab), f(sect, ba), f(ab, ba))


def weighted_score(a_raw: str | None, b_raw: str | None) -> int:
    a, b = process(a_raw), process(b_raw)
    if not a or not b:
        return 0
    base = ratio(a, b)
    len_ratio = max(len(a), len(b)) / min(len(a), len(b))
    if len_ratio < PARTIAL_MIN_LEN_RATIO:
        return int(round(max(base,
                             token_sort(a, b) * UNBASE_SCALE,
                             token_set(a, b) * UNBASE_SCALE)))
    scale = LONG_PARTIAL_SCALE if len_ratio > LONG_LEN_RATIO else PARTIAL_SCALE
    return int(round(max(base,
                         partial_ratio(a, b) * scale,
                         token_sort(a, b, partial=True) * UNBASE_SCALE * scale,
                         token_set(a, b, partial=True) * UNBASE_SCALE * scale)))


#: What texts of lengths from PARTIAL_MIN_LEN_RATIO to LONG_LEN_RATIO apart score
#: at least by a word in common (it is found whole in the longer text).
WORD_FLOOR = int(round(100 * UNBASE_SCALE * PARTIAL_SCALE))


def plain(text: str) -> bool:
    """Two characters or more, single blanks and no repeated word, so that the
    variants of a processed text are orders of the same words."""
    words = text.split()
    return len(text) > 1 and len(set(words)) == len(words) and " ".join(words) == text


def grams(text: str, size: int) -> list[str]:
    """The different grams of ``size`` letters of " text ", in its own order of
    words and in sorted order."""
    both = (f" {text} ", f" {_sorted_tokens(text)} ")
    return sorted({t[i:i + size] for t in both for i in range(len(t) - size + 1)})


# Deleting a character takes three 3-letter grams at most, inserting one takes
# two. " text " has as many grams as the text has characters, so texts of lengths a
# and b with a common subsequence of L characters share at least
# a - 3 (a - L) - 2 (b - L) = 5 L - 2 (a + b) of them. A similarity s means
# L = s (a + b) / 2, so there is one from s > 0.8 on. The token-set part can also
# compare common words alone, and a common word has a gram of its own. The partial
# parts compare the shorter text with a window of the longer one of w characters:
# the a - 2 grams inside, less the same, leave 5 L - 2 (a + w) - 2, where w is at
# least L and so s a / (2 - s).

#: From this threshold on, texts up to PARTIAL_MIN_LEN_RATIO apart share a gram.
LEAST_INDEXED = 80


def tiny(threshold: int) -> int:
    """Texts of fewer characters needn't share a 3-letter gram with a longer one
    that holds them; a 2-letter gram they do, by the same count: 3 L - a - w - 1."""
    s = (threshold + 0.5) / 100 / PARTIAL_SCALE - 0.005     # as a rounded percentage
    if s >= 1:
        return 0
    return math.floor(2 / ((2.5 * s - 2) * 2 / (2 - s)) + 1e-9) + 1


def score_above(a: str, b: str, threshold: int) -> int:
    """The score of two processed texts, or 0 if a bound shows that it isn't
    above ``threshold``."""
    return 0 if _hopeless(_parts(a), _parts(b), threshold) else weighted_score(a, b)


def best_match(name: str | None, candidates: list[tuple[int, str]]) -> tuple[int | None, int]:
    """(ordinal, score) of the best candidate; ties go to the lowest ordinal."""
    if name is None:
        return None, 0
    best_ord, best_score = None, -1
    for ordinal, cand in candidates:
        s = weighted_score(name, cand)
        if s > best_score or (s == best_score and best_ord is not None and ordinal < best_ord):
            best_ord, best_score = ordinal, s
    return best_ord, max(best_score, 0)


def prepare(entries) -> list[tuple]:
    """Catalogue entries with what :func:`best_above` needs of them."""
    return [(int(o), c, *_parts(c)) for o, c in entries]


def _parts(raw: str):
    p = process(raw)
    tokens = p.split()
    # repeated blanks or words make a variant shorter than the string itself
    return p, Counter(p), set(tokens), len(set(tokens)) == len(tokens) and " ".join(tokens) == p


def _hopeless(a, b, threshold: int) -> bool:
    """Whether every part of the score is at most ``threshold``, by the
    characters in common. All parts compare strings made of the same characters
    as the names (a window of the longer one in the partial parts), unless a word
    is shared, so their similarity is at most that of the character counts."""
    pa, ca, ta, plain_a = a
    pb, cb, tb, plain_b = b
    if not pa or not pb:
        return True
    short, long_ = sorted((len(pa), len(pb)))
    if long_ / short > LONG_LEN_RATIO:
        # the full ratio is below 2/9 then, the partial parts are scaled
        return threshold >= 100 * LONG_PARTIAL_SCALE
    if not (plain_a and plain_b) or ta & tb:
        return False
    common = sum((ca & cb).values())
    whole = _pct(2 * common / (short + long_))
    if long_ / short < PARTIAL_MIN_LEN_RATIO:
        return whole <= threshold
    return max(whole, _pct(2 * common / (short + common)) * PARTIAL_SCALE if common else 0) <= threshold


def best_above(name: str, entries: list[tuple], threshold: int) -> tuple[int | None, int]:
    """(ordinal, score) of the best entry scoring above ``threshold``; ties go to
    the lowest ordinal; (None, 0) if there is none."""
    own, best = _parts(name), (None, 0)
    for ordinal, raw, *parts in entries:
        if _hopeless(own, parts, threshold):
            continue
        s = weighted_score(name, raw)
        if s > threshold and (s > best[1] or s == best[1] and ordinal < best[0]):
            best = (ordinal, s)
    return best
