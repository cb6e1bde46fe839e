"""Licences in texts by a positional index of rare words.

The index holds the words of licence templates with their postings (template, position). A word's rarity is its inverse
document frequency over all documents, counted in a pass of its own. In a file, each template's rarest words that the file
has are looked up; each occurrence votes for the place where the template would begin, and where several words agree on a
place, nearly so for texts with words added or left out, the template is laid there: the share of its rarity that stands
at its relative position is its score. It is taken when the score is high enough and each of its mandatory key phrases
stands inside, word by word. Key phrases are found alike: at the places of their rarest word, the others are intersected
by relative position, so every place is found.

Defined results: a null text is an empty one; texts without words have no licence and a score of 0; very long texts are
read whole, a batch of a few texts at a time; repeated rows and null ids are rows; an empty table gives an empty result;
places that tie in votes go to the earlier one. Only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common

#: Words of UTF-8 bytes with A-Z in lower case: digits, letters, and all beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The rarest words of a template that are looked up, the share of them that must agree, and the least score.
LOOKUPS, AGREE, LEAST = 12, 0.5, 0.75


@dataclass(frozen=True)
class Template:
    """A licence's text or notice, and the phrases without which it isn't that licence."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases that are counted word by word wherever they stand.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# The public wording of licences and their notices.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("bsd-2", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    Template("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name", "without specific prior written permission")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 2 1")),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",)),
    Template("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license", "version 3")),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license version 3",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
)


def words(raw: bytes) -> list[bytes]:
    return WORD.findall(raw.lower())  # of bytes: A-Z only


class Index:
    """Postings of templates and phrases by word, and each word's rarity."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE):
        self.labels, self.base = [t.label for t in templates], [label for _, label in base]
        texts = [words(t.text.encode()) for t in templates]
        keys = [[words(k.encode()) for k in t.keys] for t in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in (*texts, *(k for ks in keys for k in ks), *(words(p.encode()) for p, _ in base)) for w in x}))}
        ids = lambda x: np.array([self.vocabulary[w] for w in x])
        self.texts, self.keys = [ids(x) for x in texts], [[tuple(ids(k)) for k in ks] for ks in keys]
        self.phrases = [tuple(ids(words(p.encode()))) for p, _ in base]
        self.postings = [{w: np.flatnonzero(x == w) for w in set(x.tolist())} for x in self.texts]
        self.rarity = np.ones(len(self.vocabulary))

    def weighed(self, n: int, counts: dict[int, int]) -> Index:
        """With words' rarity from n documents, of which counts have them."""
        held = np.zeros(len(self.vocabulary))
        for w, c in counts.items():
            held[w] = c
        self.rarity = np.log((n + 1) / (held + 1)) + 1e-3  # a word in every document still counts a little
        return self

    def places(self, phrase: tuple[int, ...], at: np.ndarray, where: dict[int, np.ndarray]) -> np.ndarray:
        """Every start of a phrase: from its rarest word on, the others by relative position."""
        order = sorted(range(len(phrase)), key=lambda j: (-self.rarity[phrase[j]], j))
        starts = where.get(phrase[order[0]], np.empty(0, dtype=np.int64)) - order[0]
        starts = starts[(starts >= 0) & (starts <= len(at) - len(phrase))]
        for j in order[1:]:
            starts = starts[at[starts + j] == phrase[j]]
        return starts

    def laid(self, t: int, at: np.ndarray, where: dict[int, np.ndarray]) -> list[tuple[int, float]]:
        """(start, score) of places where template t stands, by its rarest words in the file, before key phrases."""
        text, held = self.texts[t], [w for w in self.postings[t] if w in where]
        looked = sorted(held, key=lambda w: (-self.rarity[w], w))[:LOOKUPS]
        mass = self.rarity[text]
        if mass[np.isin(text, held)].sum() < LEAST * mass.sum():
            return []
        slack = max(2, len(text) // 8)
        votes = [np.unique((where[w][:, None] - self.postings[t][w][None, :]).ravel()) for w in looked]
        begins = np.unique(np.concatenate(votes))
        agree = np.zeros(len(begins), dtype=np.int64)
        for v in votes:
            after = np.searchsorted(v, begins - slack)
            agree += (after < len(v)) & (v[np.minimum(after, len(v) - 1)] <= begins + slack)
        enough = agree >= max(1, AGREE * min(LOOKUPS, len(self.postings[t])))
        begins, agree = begins[enough], agree[enough]
        if not len(begins):
            return []
        # of neighbours, which mean the same place, the one most words agree on
        order = np.lexsort((begins, -agree, begins // (slack + 1)))
        begins = begins[order][np.unique((begins // (slack + 1))[order], return_index=True)[1]]
        score = np.zeros(len(begins))
        padded = np.full(len(at) + 2 * (slack + len(text)), -1, dtype=np.int32)
        padded[slack + len(text) : slack + len(text) + len(at)] = at
        for some in np.array_split(np.arange(len(begins)), -(-len(begins) // 4096)):
            here = np.clip(begins[some, None] + np.arange(len(text))[None, :] + slack + len(text), slack, len(padded) - slack - 1)
            stands = np.zeros(here.shape, dtype=bool)
            for shift in range(-slack, slack + 1):
                stands |= padded[here + shift] == text[None, :]
            score[some] = (stands * mass[None, :]).sum(1) / mass.sum()
        return [(int(b), float(min(s, 1.0))) for b, s in zip(begins, score, strict=True) if s >= LEAST]

    def found(self, raw: bytes) -> tuple[int, list[tuple[str, bool, int, int, float]]]:
        """How many words a text has, and its places (label, base, start, end, score)."""
        said = words(raw)
        get = self.vocabulary.get
        at = np.fromiter((get(w, -1) for w in said), dtype=np.int32, count=len(said))
        hits = np.flatnonzero(at >= 0)
        if not len(hits):
            return len(said), []
        order = hits[np.argsort(at[hits], kind="stable")]
        kinds, begin = np.unique(at[order], return_index=True)
        where = dict(zip(kinds.tolist(), np.split(order, begin[1:]), strict=True))
        out = [(label, True, int(s), int(s) + len(p), 1.0) for p, label in zip(self.phrases, self.base, strict=True) for s in self.places(p, at, where)]
        for t, label in enumerate(self.labels):
            keys = [(k, self.places(k, at, where)) for k in self.keys[t]] if all(w in where for k in self.keys[t] for w in k) else [((), [])]
            if not all(len(s) for _, s in keys):  # a mandatory phrase is missing from the whole file
                continue
            n, slack = len(self.texts[t]), max(2, len(self.texts[t]) // 8)
            for start, score in self.laid(t, at, where):
                inside = [s[np.searchsorted(s, start - slack) :][:1] for _, s in keys]
                if all(len(i) and i[0] + len(k) <= start + n + slack for i, (k, _) in zip(inside, keys, strict=True)):
                    out.append((label, False, max(0, start), min(len(at), start + n), score))
        return len(said), out


def counted(docs: DataFrame, index: Index) -> tuple[int, dict[int, int]]:
    """How many documents there are, and how many hold each word of the index; tasks send a row a word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(index.vocabulary), dtype=np.int64), 0
        for b in common.sliced(batches, 64):
            for raw in b.column("raw"):
                n += 1
                for w in set(words(raw.as_py())) & index.vocabulary.keys():
                    held[index.vocabulary[w]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *some], pa.int32()), "n": pa.array([n, *held[some]], pa.int64())})

    rows = docs.select("raw").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop(-1, 0), counts


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places): places are array<struct<label, base, start, end, score>>, in words from 0, end exclusive."""
    raw = common.corpus(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("raw"))
    index = Index(templates, base)
    index.weighed(*counted(raw, index))
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    fields = kind.value_type.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 64):
            got = [index.found(x.as_py()) for x in b.column("raw")]
            places = [[dict(zip(fields, p, strict=True)) for p in sorted(ps, key=lambda p: (p[2], p[3], p[0], not p[1]))] for _, ps in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array(places, kind)], ["doc_id", "n_words", "places"])

    return raw.mapInArrow(run, "doc_id long, n_words long, places array<struct<label:string,base:boolean,start:bigint,end:bigint,score:double>>")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best place's; 0 without any)."""
    places, base = F.col("places"), F.filter("places", lambda p: p["base"])
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        _joined(base["label"]).alias("base_labels"), _joined(places["label"]).alias("labels"), F.coalesce(F.array_max(places["score"]), F.lit(0.0)).alias("score"),
    )
