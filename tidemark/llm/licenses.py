"""Licence recognition by sentence rules, on DataFrame functions alone.

Texts are normalised to words with marks where a sentence must end (. ! ?) and where it
may (line breaks, ; and :). Known licence sentences are sought from mark to mark, so
notices wrapped at any column, or in comments, are found as well as those on one line.
They are mapped to identifiers, and the sequence of identifiers of a document is matched
against ordered rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ORNAMENT, SPACES

# Sentences of public licence notices, normalised, by a one-letter identifier.
SENTENCES = {
    "a": "released under the mit license",
    "b": "licensed under the mit license",
    "c": "this project is licensed under the mit license",
    "d": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "e": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "f": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "g": "licensed under the apache license version 2 0",
    "h": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "i": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "j": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "k": "see the license for the specific language governing permissions and limitations under the license",
    "l": "this work is licensed under the gnu general public license version 3",
    "m": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "n": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "o": "see the gnu general public license for more details",
    "p": "licensed under cc by nc 4 0",
    "q": "licensed under cc by 4 0",
    "r": "this work is licensed under a creative commons attribution 4 0 international license",
    "s": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "t": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "u": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "v": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "w": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Rules in order of precedence: (rule, licence, identifiers in the order in which they must follow one another, others may stand between).
RULES = (
    ("mit-text", "MIT", "def"), ("mit-grant", "MIT", "d"), ("mit-release", "MIT", "a"), ("mit-notice", "MIT", "b"), ("mit-project", "MIT", "c"),
    ("apache-header", "Apache-2.0", "hijk"), ("apache-short", "Apache-2.0", "h"), ("apache-notice", "Apache-2.0", "g"),
    ("gpl-header", "GPL-3.0", "mno"), ("gpl-short", "GPL-3.0", "m"), ("gpl-notice", "GPL-3.0", "l"),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "p"), ("cc-by-nc-work", "CC-BY-NC-4.0", "s"), ("cc-by-notice", "CC-BY-4.0", "q"), ("cc-by-work", "CC-BY-4.0", "r"),
    ("bsd-3-text", "BSD-3-Clause", "tuvw"), ("bsd-2-text", "BSD-2-Clause", "tuv"),
)
#: Short notices in words of their own: (expression over normalised words, identifier that it counts as).
_WORK, _SEE = "this (?:software|project|program|work|code|package|library|file) is ", "(?: see (?:the )?license(?: file)?(?: txt| md)?(?: for (?:more )?(?:details|information))?)?"
SHORT = (
    (f"(?:{_WORK})?(?:released|distributed) under (?:the terms of )?the mit license{_SEE}", "a"),
    (f"(?:{_WORK})?licensed under (?:the terms of )?the mit license{_SEE}", "b"),
    (f"(?:{_WORK})?(?:released|distributed|licensed) under (?:the terms of )?the apache license(?: version)? 2 0{_SEE}", "g"),
)
#: Each known sentence holds one of these, so texts without any are not cut up at all.
ANCHORS = ("license", "copyright", "warranty", "permission", "redistribution", "cc by", "cc-by")


#: Marks in normalised text: a sentence ends; a sentence may end.
STOP, BREAK = "\x01", "\x02"


def marked(text: Column) -> Column:
    """Words of a-z and 0-9, one space, BREAK or STOP between any two, STOP at both ends.

    STOP stands for . ! or ? before white space, BREAK for a line break, or ; or : before white space.
    """
    plain = F.translate(F.lower(F.regexp_replace(text, ORNAMENT, "")), STOP + BREAK, "  ")
    stops = F.regexp_replace(plain, rf"[.!?][{SPACES}]+", STOP)
    breaks = F.regexp_replace(stops, rf"\n|[;:](?=[{SPACES}]|$)", BREAK)
    words = F.concat(F.lit(STOP), F.regexp_replace(breaks, f"[^a-z0-9{STOP}{BREAK}]+", " "), F.lit(STOP))
    stops = F.regexp_replace(words, f"[ {BREAK}]*+{STOP}[ {STOP}{BREAK}]*+", STOP)
    return F.regexp_replace(stops, f" ?{BREAK}[ {BREAK}]*+", BREAK)


_LONGEST = sorted(SENTENCES.values(), key=len, reverse=True)


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; of those that begin at one place the longest."""
    gap = f"[ {BREAK}]"
    # A short form that goes on ("see license") is longer than the fixed sentence that it begins with.
    any_of = "|".join([*(s for s in _LONGEST if len(s) > 60), *(s for s, _ in SHORT), *(s for s in _LONGEST if len(s) <= 60)]).replace(" ", gap)
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<=[{STOP}{BREAK}])(?:{any_of})(?=[{STOP}{BREAK}])"), F.lit(0))
    known = F.create_map(*(F.lit(x) for ident, s in SENTENCES.items() for x in (s, ident)))

    def identify(s: Column) -> Column:
        s = F.translate(s, BREAK, " ")
        return F.coalesce(F.element_at(known, s), *(F.when(s.rlike(f"^{e}$"), F.lit(i)) for e, i in SHORT))

    return F.transform(found, identify)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, identifiers, rules, licenses: one row per document.

    ``identifiers`` is the sequence of known sentences, one letter each; ``rules`` and
    ``licenses`` are comma-joined, in the order of RULES and of names; empty where none
    match. n_sentences counts the known ones. Of the rules of one licence the first that
    matches counts. Null text counts as empty; repeated rows are each scanned; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    anchored = reduce(lambda a, b: a | b, (F.lower(text).contains(a) for a in ANCHORS), text.rlike(ORNAMENT))  # ornaments may hide an anchor
    rows = docs.select("doc_id", F.when(anchored, F.array_join(known_sentences(text), "")).otherwise("").alias("identifiers"))
    picks, by = [], {}
    for name, license_, ids in RULES:
        hit = F.col("identifiers").rlike(".*".join(ids))
        before = by.get(license_)
        picks.append(F.when(hit if before is None else hit & ~before, F.struct(F.lit(name).alias("rule"), F.lit(license_).alias("license"))))
        by[license_] = hit if before is None else before | hit
    matched = F.when(F.col("identifiers") != "", F.array_compact(F.array(*picks)))
    return rows.select("doc_id", F.length("identifiers").cast("long").alias("n_sentences"), "identifiers", matched.alias("m")).select(
        "doc_id", "n_sentences", "identifiers", F.coalesce(F.array_join("m.rule", ","), F.lit("")).alias("rules"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("m.license")), ","), F.lit("")).alias("licenses"))


def _oracle() -> str:
    """The same scan as SQL. RE2 has no look-around: marks are doubled, so that each of two neighbours has one of its own."""
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, s in SENTENCES.items()) + "}"
    gap = f"(?: |{BREAK}{BREAK})"
    alternatives = "|".join([*(s for s in _LONGEST if len(s) > 60), *(s for s, _ in SHORT), *(s for s in _LONGEST if len(s) <= 60)]).replace(" ", gap)
    short = " ".join(f"WHEN regexp_full_match(y, '{e}') THEN '{i}'" for e, i in SHORT)
    named = f"coalesce(element_at({known}, y)[1], CASE {short} END)"
    by, rules, names = {}, [], []
    for name, license_, ids in RULES:
        hit = f"regexp_matches(identifiers, '{'.*'.join(ids)}')"
        other = by.get(license_)
        cond = hit if other is None else f"({hit} AND NOT ({other}))"
        rules.append(f"CASE WHEN {cond} THEN '{name}' END")
        names.append(f"CASE WHEN {hit} THEN '{license_}' END")
        by[license_] = hit if other is None else f"{other} OR {hit}"
    return f"""
WITH plain AS (
  SELECT doc_id, translate(lower(regexp_replace(coalesce(text, ''), '{ORNAMENT}', '', 'g')), '{STOP}{BREAK}', '  ') AS t FROM documents),
ends AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[.!?][{SPACES}]+', '{STOP}', 'g'), '\\n|[;:]([{SPACES}])|[;:]$', '{BREAK}\\1', 'g') AS t FROM plain),
words AS (SELECT doc_id, '{STOP}' || regexp_replace(t, '[^a-z0-9{STOP}{BREAK}]+', ' ', 'g') || '{STOP}' AS t FROM ends),
marked AS (
  SELECT doc_id, replace(replace(regexp_replace(regexp_replace(t, '[ {BREAK}]*{STOP}[ {STOP}{BREAK}]*', '{STOP}', 'g'), ' ?{BREAK}[ {BREAK}]*', '{BREAK}', 'g'),
    '{BREAK}', '{BREAK}{BREAK}'), '{STOP}', '{STOP}{STOP}') AS t FROM words),
found AS (
  SELECT doc_id, list_transform(regexp_extract_all(t, '[{STOP}{BREAK}]({alternatives})[{STOP}{BREAK}]', 1), lambda x: replace(x, '{BREAK}{BREAK}', ' ')) AS s FROM marked),
ids AS (
  SELECT doc_id, coalesce(list_aggregate(list_filter(list_transform(s, lambda y: {named}), lambda y: y IS NOT NULL), 'string_agg', ''), '') AS identifiers
  FROM found)
SELECT doc_id, length(identifiers) AS n_sentences, identifiers,
  coalesce(list_aggregate(list_filter([{', '.join(rules)}], lambda y: y IS NOT NULL), 'string_agg', ','), '') AS rules,
  coalesce(list_aggregate(list_sort(list_distinct(list_filter([{', '.join(names)}], lambda y: y IS NOT NULL))), 'string_agg', ','), '') AS licenses
FROM ids"""


ORACLE = _oracle()
