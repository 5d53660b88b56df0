"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised with marks at its sentence ends, blank lines and line
breaks. A known licence sentence counts where it stands between two marks; line
breaks (with the comment signs after them), colons and semicolons may fall
inside it, so that wrapped texts match, sentence ends and blank lines may not.
The sequence of identifiers is matched against ordered rules: a rule's
identifiers must occur in its order, other sentences may stand between. A rule whose identifiers are part of a longer matching rule
of the same licence adds nothing.

``n_sentences`` counts the pieces between sentence ends and line breaks, as
OP10_SQL does. That SQL also looks up each such piece alone; it gives the same
licences except for sentences that go over a line break, colon or semicolon.

Null and empty texts have no sentences and no licence. Repeated rows are
scanned each on its own; no row is grouped or moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Known licence sentences, normalised (lower case, other
# characters as single blanks), by identifier.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "spdx license identifier apache 2 0": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "spdx license identifier gpl 3 0 only": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "ccbync4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-ref",
    "licensed under cc by 4 0": "ccby4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all rights reserved": "all-rights-reserved",
}
# Ordered rules (name, licence, identifiers in order).
RULES = (
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("mit-ref", "MIT", ("mit-ref",)),
    ("apache2-header", "Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy", "apache2-warranty")),
    ("apache2-ref", "Apache-2.0", ("apache2-ref",)),
    ("gpl3-header", "GPL-3.0", ("gpl3-grant", "gpl-warranty")),
    ("gpl3-grant", "GPL-3.0", ("gpl3-grant",)),
    ("gpl3-ref", "GPL-3.0", ("gpl3-ref",)),
    ("ccbync4-ref", "CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("ccby4-ref", "CC-BY-4.0", ("ccby4-ref",)),
    ("bsd3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("all-rights-reserved", "LicenseRef-All-Rights-Reserved", ("all-rights-reserved",)),
)
#: Licences that forbid or condition commercial reuse.
RESTRICTED = ("GPL-3.0", "CC-BY-NC-4.0", "LicenseRef-All-Rights-Reserved")
#: A rule whose licence is a special case of another's.
IMPLIED = {"bsd2-text": "bsd3-text"}

_CUT = r"([.!?;:])[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _covered(name: str) -> str | None:
    """The longer rule whose match makes this one redundant, if any."""
    _, lic, ids = next(r for r in RULES if r[0] == name)
    longer = [r[0] for r in RULES if r[1] == lic and len(r[2]) > len(ids) and set(ids) <= set(r[2])]
    return IMPLIED.get(name, longer[0] if longer else None)


def _pattern(ids: tuple[str, ...]) -> str:
    """Matches the identifiers in order in a sequence with a blank around each."""
    return " " + " (.* )?".join(ids) + " "


def sentences(text):
    """Array of normalised sentences of a text column."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _CUT, "$1\n"), "\n")
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " ")))


def _marked(text):
    """A text normalised, H at sentence ends and blank lines, S at other line
    breaks, colons and semicolons: letters that small-lettered text hasn't."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for what, mark in ((r"[.!?][\x20\x09-\x0D]+", " H "), (r"\n[^a-z0-9H\n]*(?=\n)", " H "),
                       (r"[;:][\x20\x09-\x0D]+|\n", " S "), ("[^a-z0-9HS]+", " ")):
        t = F.regexp_replace(t, what, mark)
    return F.concat(F.lit("H "), t, F.lit(" H"))


def known_sentences(text):
    """Array of the known sentences in a text column, in text order."""
    one = "|".join(s.replace(" ", " (?:S )*+") for s in sorted(SENTENCES, key=len, reverse=True))
    found = F.regexp_extract_all(_marked(text), F.lit(f"(?<=[HS] {{1,2}})(?:{one})(?= {{1,2}}[HS])"), F.lit(0))
    return F.transform(found, lambda s: F.replace(s, F.lit("S "), F.lit("")))


def scan(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus ``<prefix>n_sentences``, ``<prefix>sentence_ids`` (in text
    order), ``<prefix>rules`` and ``<prefix>licenses`` (in rule order)."""
    by_id: dict[str, list[str]] = {}
    for s, i in SENTENCES.items():
        by_id.setdefault(i, []).append(s)

    def name(s):
        out = None
        for i, ss in by_id.items():
            out = F.when(s.isin(*ss), i) if out is None else out.when(s.isin(*ss), i)
        return out
    ids, seq = F.col("_l_ids"), F.col("_l_seq")
    hit = {r: seq.rlike(_pattern(i)) for r, _, i in RULES}
    own = [F.when(hit[r] & ~(hit[c] if (c := _covered(r)) else F.lit(False)), r) for r, _, _ in RULES]
    lic = F.create_map(*(F.lit(x) for r, n, _ in RULES for x in (r, n)))
    rules = F.filter(F.array(*own), lambda x: x.isNotNull())
    known = known_sentences(F.col(text))
    out = (docs.withColumn("_l_s", F.filter(sentences(F.col(text)), lambda s: s != ""))
           .withColumn("_l_ids", F.transform(known, name))
           .withColumn("_l_seq", F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" ")))
           .withColumn("_l_rules", rules))
    return out.select(
        *docs.columns, F.size("_l_s").cast("long").alias(f"{prefix}n_sentences"), ids.alias(f"{prefix}sentence_ids"),
        F.col("_l_rules").alias(f"{prefix}rules"),
        F.array_distinct(F.transform("_l_rules", lambda r: lic[r])).alias(f"{prefix}licenses"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    out = scan(docs)
    return out.select(
        "doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_license_sentences"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join("rules", " ").alias("rules"), F.array_join("licenses", " ").alias("licenses"),
        F.arrays_overlap("licenses", F.array(*map(F.lit, RESTRICTED))).alias("restricted"))


def _sql() -> str:
    name = " ".join(f"WHEN s = '{s}' THEN '{i}'" for s, i in SENTENCES.items())
    hit = ", ".join(f"regexp_matches(seq, '{_pattern(i)}') AS h{k}" for k, (_, _, i) in enumerate(RULES))
    at = {r: k for k, (r, _, _) in enumerate(RULES)}
    own = {r: f"h{at[r]}" + (f" AND NOT h{at[c]}" if (c := _covered(r)) else "") for r in at}
    join = lambda xs: "concat_ws(' ', " + ", ".join(xs) + ")"
    lics = list(dict.fromkeys(n for _, n, _ in RULES))
    of = lambda n: "(" + " OR ".join(f"({own[r]})" for r, m, _ in RULES if m == n) + ")"
    return f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(
      regexp_replace(coalesce(text, ''), '{_CUT}', '\\1\n', 'g'), chr(10)),
      lambda x: trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s
  FROM documents),
i AS (
  SELECT doc_id, len(s) AS n, list_filter(list_transform(s, lambda s: CASE {name} END), lambda x: x IS NOT NULL) AS ids FROM s),
q AS (SELECT *, ' ' || array_to_string(ids, ' ') || ' ' AS seq FROM i),
h AS (SELECT *, {hit} FROM q)
SELECT doc_id, n::BIGINT AS n_sentences, len(ids)::BIGINT AS n_license_sentences,
  array_to_string(ids, ' ') AS sentence_ids,
  {join(f"CASE WHEN {c} THEN '{r}' END" for r, c in own.items())} AS rules,
  {join(f"CASE WHEN {of(n)} THEN '{n}' END" for n in lics)} AS licenses,
  {" OR ".join(of(n) for n in RESTRICTED)} AS restricted
FROM h
"""


OP10_SQL = _sql()
