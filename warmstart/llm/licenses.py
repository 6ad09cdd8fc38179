"""License scans: a positional index of rare licence words.

For every licence template the words with the highest IDF over all documents are indexed with their
positions (``RARE`` per template). A file's occurrences of indexed words look up the postings; occurrences that point to
the same start of the same template (file position minus template position) support that start, and starts with
enough support are aligned word by word. A template's label is given when at least ``MIN_SCORE`` of its words are in place and
its mandatory key phrases are there in full. Everything but the document frequencies is computed within
the row by array functions, so no document is shuffled and no hot word matters.

The index goes into the plan as literals: its size follows the template list (a parameter), not the corpus.

Defined results: a null text is empty; without words every count is 0, positions are null, labels are the empty
string and the score is 0; repeated rows get equal results; very long texts are taken whole, their words being one array; other
columns are passed through (``scan`` is the name of the result, so the caller's table must have none); on an
empty table the index falls back to template words in alphabetical order.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmstart.llm.common import ascii_lower, fresh, let

# Fixed value: words of the licence scan.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count by themselves, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
RARE, MIN_SUPPORT, MIN_SCORE = 4, 0.5, 0.8


@dataclass(frozen=True)
class Template:
    """Words of a notice; ``keys`` are phrases of it that must be there in full. A label may have several templates, told
    apart by ``form``."""

    label: str
    text: str
    keys: tuple[str, ...]
    form: str = ""

    @property
    def name(self) -> str:
        return f"{self.label} {self.form}".strip()

    @property
    def words(self) -> list[str]:
        return split(self.text)


def split(text: str) -> list[str]:
    return re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def _header(label: str, licence: str, version: str) -> Template:
    """The usual header of a source file under a GNU licence."""
    body = f"GNU {licence} General Public License as published by the Free Software Foundation"
    return Template(label, f"under the terms of the {body}, either version {version} of the License",
                    (body, f"either version {version} of the license"), "header")


#: Short notices of common public licences.
TEMPLATES = [
    Template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("affero general public license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                    "hereby granted", ("permission to use copy modify",)),
    Template("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3", ("lesser general public license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("released into the public domain",)),
    Template("mit", "Released under the MIT License", ("the mit license",), "notice"),
    _header("gpl-2.0", "", "2"),
    _header("gpl-3.0", "", "3"),
    _header("lgpl-2.1", "Lesser", "2.1"),
    _header("lgpl-3.0", "Lesser", "3"),
    _header("agpl-3.0", "Affero", "3"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORDS), 0)


def document_frequencies(words: DataFrame, templates: list[Template]) -> dict[str, int]:
    """Documents of ``words`` (words array) that hold each template word; one row a template word is collected."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    return {r["w"]: r["count"] for r in words.select(F.explode(held).alias("w")).groupBy("w").count().collect()}


def rare_index(templates: list[Template], frequency: dict[str, int]) -> dict[str, list[tuple[str, int]]]:
    """For every template name the (word, position) entries of its ``RARE`` rarest words; ties in alphabetical order."""
    out = {}
    for t in templates:
        rare = sorted(set(t.words), key=lambda w: (frequency.get(w, 0), w))[:RARE]
        out[t.name] = [(w, i) for i, w in enumerate(t.words) if w in rare]
    return out


def _places(words: Column, phrase: list[str]) -> Column:
    """All places where the phrase's words stand one after another."""
    def fits(i: Column) -> Column:
        ok = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            ok = ok & (F.get(words, i + k) == w)
        return ok

    last = F.size(words) - len(phrase)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fits)).otherwise(
        F.array().cast("array<int>"))


def _starts(hits: Column, entries: list[tuple[str, int]]) -> Column:
    """Starts that enough index entries agree on, from (w, at) occurrences: each entry supports a start once."""
    def of(word: str, place: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["at"] - place)

    need = max(1, math.ceil(len(entries) * MIN_SUPPORT))

    def agreed(starts: Column) -> Column:
        last = F.size(starts) - need
        same = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                        lambda i: F.get(starts, i) == F.get(starts, i + need - 1))
        return F.when(last >= 0, F.array_distinct(F.transform(same, lambda i: F.get(starts, i)))).otherwise(
            F.array().cast("array<int>"))

    return let(F.sort_array(F.flatten(F.array(*(of(w, p) for w, p in entries)))), agreed)


def _best(words: Column, starts: Column, t: Template) -> Column:
    """Largest share of template words in place, over the starts at which the key phrases are complete; 0 if none."""
    lit = F.array(*(F.lit(w) for w in t.words))
    keyed = sorted({p + k for key in map(split, t.keys) for p in range(len(t.words)) if t.words[p:p + len(key)] == key
                    for k in range(len(key))})

    def share(s: Column) -> Column:
        same = F.filter(F.sequence(F.lit(0), F.lit(len(t.words) - 1)),
                        lambda j: F.when(s + j >= 0, F.get(words, s + j)) == F.get(lit, j))
        key = F.size(F.filter(same, lambda j: j.isin(keyed)))
        return F.when(key == len(keyed), F.size(same) / F.lit(len(t.words))).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def scan(docs: DataFrame, text_col: str = "text", out: str = "scan", templates: list[Template] | None = None) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = TEMPLATES if templates is None else templates
    frequency = document_frequencies(docs.select(words_of(F.col(text_col)).alias("words")), templates)
    index = rare_index(templates, frequency)
    w, p, h, s, b = fresh(docs, "__words", "__places", "__hits", "__found", "__base")
    rows = docs.withColumn(w, words_of(F.col(text_col)))
    words, none = F.col(w), F.array().cast("array<int>")
    low = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = []
    for phrase in PHRASES:
        there = F.lit(True)
        for x in split(phrase):
            there = there & low.contains(x)
        base.append(F.when(there, _places(words, split(phrase))).otherwise(none).alias(phrase.replace(" ", "_")))
    indexed = sorted({x for entries in index.values() for x, _ in entries})
    at = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda x: x["w"].isin(indexed))
    rows = rows.withColumn(p, F.struct(*base)).withColumn(h, at)
    hits, found = F.col(h), []
    for t in templates:
        score = F.when(F.size(hits) > 0, _best(words, _starts(hits, index[t.name]), t)).otherwise(0.0)
        found.append(F.struct(F.lit(t.label).alias("label"), score.alias("score")))
    rows = rows.withColumn(s, F.array(*found) if found else F.array().cast("array<struct<label:string,score:double>>"))
    names = [F.when(F.size(F.col(p)[x.replace(" ", "_")]) > 0, label) for x, label in PHRASES.items()]
    rows = rows.withColumn(b, F.filter(F.array(*names), lambda x: x.isNotNull()))
    each = F.flatten(F.array(*(F.col(p)[x.replace(" ", "_")] for x in PHRASES)))
    more = F.transform(F.filter(s, lambda x: x["score"] >= MIN_SCORE), lambda x: x["label"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    top = F.coalesce(F.array_max(F.transform(s, lambda x: x["score"])), F.lit(0.0))
    return rows.select(*docs.columns, F.struct(
        F.size(words).cast("long").alias("n_words"), F.size(each).cast("long").alias("n_base"),
        F.array_min(each).cast("long").alias("first_word"), F.array_max(each).cast("long").alias("last_word"),
        join(F.col(b)).alias("base_labels"), join(F.concat(F.col(b), more)).alias("labels"), top.alias("score")).alias(out))
