"""License scans by a positional index of rare words (operator 13).

Short fixed phrases (``BASE``) are looked for as they are.  Notices and licence texts
(``TEMPLATES``), which files quote with words put in, left out or changed, are found by
an index of their words with positions:

1. A pass over the texts counts in how many files each licence word stands, and keeps
   the positions of licence words of the files that hold all words of the mandatory
   key phrases of some template (no other file can get a label).
2. For each such template a file's ``rare`` words of the highest IDF are looked up.
   A posting and an occurrence give the place at which the template would begin;
   places that agree but for ``slack`` words are intersected, and those that enough
   of the words share are candidates.
3. A candidate counts if all key phrases stand in its span, word by word, and the
   template words found there weigh at least ``least`` of all by IDF.  That share is
   the score; a base phrase scores 1.

Word statistics cover all files; what reaches the driver is one count for each word
of the templates, a fixed list.

Edge cases: a null or empty text has no word, no label and score 0; a null id keeps its
row; repeated rows give equal rows; of words with equal IDF the first in the alphabet
is looked up; very long texts are read whole, one a batch; an empty table gives an empty
result.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import bound_batches, slices

# The base phrases, then licence notices as their owners publish them, each with its key phrases.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
        ["permission is hereby granted free of charge", "without restriction", "copyright notice and this permission notice"],
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        ["apache license", "version 2", "in compliance with the license"],
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["apache license", "2 0"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public license", "version 2"]),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ["gnu general public license", "free software foundation", "version 3"],
    ),
    (
        "gpl-2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        ["gnu general public license", "free software foundation", "version 2"],
    ),
    (
        "lgpl-3",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ["gnu lesser general public license", "version 3"],
    ),
    (
        "bsd-3",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.""",
        ["redistribution and use in source and binary forms", "neither the name of"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
        ["with or without fee", "permission notice appear in all copies"],
    ),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ["mozilla public license", "2 0"],
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc", "4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa", "4 0"]),
    ("cc-by", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        ["creative commons attribution noncommercial", "4 0"],
    ),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        ["creative commons attribution sharealike", "4 0"],
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0"]),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain.",
        ["unencumbered software", "public domain"],
    ),
]

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | str) -> list[bytes]:
    """A-Z in lower case; runs of letters, digits and all that is not ASCII."""
    return (text.encode() if isinstance(text, str) else text).translate(_WORDS).split()


def runs(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The places of ids at which a phrase stands."""
    at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        at = at[ids[at + k] == word]
    return at


@dataclass
class Template:
    label: str
    words: np.ndarray
    keys: list[np.ndarray]
    needed: np.ndarray  # the different words of the key phrases


@dataclass
class Index:
    """The words of all phrases and templates, as numbers in alphabetical order."""

    place: dict[bytes, int]
    base: list[tuple[str, np.ndarray]]
    templates: list[Template]

    @classmethod
    def of(cls, base: dict[str, str], templates: list[tuple[str, str, list[str]]]) -> Index:
        texts = [*base, *(t for _, t, _ in templates), *(k for _, _, keys in templates for k in keys)]
        place = {w: n for n, w in enumerate(sorted({w for t in texts for w in words_of(t)}))}

        def ids(text: str) -> np.ndarray:
            return np.array([place[w] for w in words_of(text)], np.int64)

        made = [Template(label, ids(text), [ids(k) for k in keys], np.unique(np.concatenate([ids(k) for k in keys]))) for label, text, keys in templates]
        return cls(place, [(label, ids(phrase)) for phrase, label in base.items()], made)


def _read(rows: DataFrame, index: Index, id_kind: str) -> DataFrame:
    """One pass over the texts: a row per file, and in the end of each task one of its counts (files and those with each word)."""
    fields = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.list_(pa.string())}
    fields |= {"at": pa.list_(pa.int64()), "word": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}

    def scan(text: bytes, files: np.ndarray) -> list:
        words = words_of(text)
        get = index.place.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        hits = np.flatnonzero(ids >= 0)
        here = np.zeros(len(index.place) + 1, bool)
        here[ids[hits]] = True
        files[:-1] += here[:-1]
        files[-1] += 1
        found = [(label, runs(ids, phrase)) for label, phrase in index.base if here[phrase].all()]
        places = np.concatenate([np.empty(0, np.int64), *(p for _, p in found)])
        ends = [places.min(), places.max()] if len(places) else [None, None]
        may = any(here[t.needed].all() for t in index.templates)
        kept = [hits, ids[hits].astype(np.int32)] if may else [None, None]
        return [len(words), len(places), *ends, sorted({label for label, p in found if len(p)}), *kept, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = np.zeros(len(index.place) + 1, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for part in slices(batch, "text"):
                made = [scan(t, files) for t in part.column("text").to_pylist()]
                columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(fields.values())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", *fields])
        if kind is not None:
            columns = [pa.array([files if name == "counts" else None], t) for name, t in fields.items()]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *columns], names=["id", *fields])

    ddl = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, at array<long>, word array<int>, counts array<long>"
    return rows.mapInArrow(run, f"id {id_kind}, {ddl}")


def candidates(at: np.ndarray, word: np.ndarray, template: np.ndarray, idf: np.ndarray, rare: int, slack: int) -> list[tuple[int, int]]:
    """Spans of a file (first and last place of the template's beginning) on which enough of its rarest words of the template agree."""
    held = np.intersect1d(word, template)
    if not len(held):
        return []
    chosen = held[np.lexsort((held, -idf[held]))][:rare]
    places, votes = [], []
    for w in chosen:
        begins = (at[word == w][:, None] - np.flatnonzero(template == w)).ravel()
        places.append(begins)
        votes.append(np.full(len(begins), w))
    places, votes = np.concatenate(places), np.concatenate(votes)
    found = []
    for shift in (0, slack):  # two grids, so that places within slack share a cell of one
        cells = (places + shift) // (2 * slack)
        each = np.unique(np.stack([cells, votes]), axis=1)[0]
        cell, agree = np.unique(each, return_counts=True)
        for c in cell[agree >= (len(chosen) + 1) // 2].tolist():
            begins = places[cells == c]
            found.append((int(begins.min()), int(begins.max())))
    return sorted(set(found))


def matched(at: np.ndarray, word: np.ndarray, template: Template, idf: np.ndarray, rare: int, slack: int) -> float:
    """The largest share of a template, by IDF, in a span of a file that holds all its key phrases; 0 without one."""
    best = 0.0
    wanted, times = np.unique(template.words, return_counts=True)
    for low, high in candidates(at, word, template.words, idf, rare, slack):
        inside = slice(*np.searchsorted(at, (low - slack, high + len(template.words) + slack)))
        span = np.full(at[inside][-1] - at[inside][0] + 1, -1) if at[inside].size else np.empty(0, np.int64)
        span[at[inside] - at[inside][:1]] = word[inside]
        if all(len(runs(span, key)) for key in template.keys):
            there = np.bincount(word[inside], minlength=len(idf))[wanted]
            best = max(best, float((np.minimum(times, there) * idf[wanted]).sum() / (times * idf[wanted]).sum()))
    return best


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] | None = None,
    templates: list | None = None,
    rare: int = 6,
    slack: int = 8,
    least: float = 0.6,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels array, labels array, score) of every row."""
    scratch = Scratch(docs.sparkSession)
    bound_batches(docs.sparkSession)
    index = Index.of(BASE if base is None else base, TEMPLATES if templates is None else templates)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    told = scratch.keep(_read(rows, index, kind))
    counts = told.where("counts is not null").select(F.posexplode("counts").alias("word", "files")).groupBy("word").agg(F.sum("files").alias("files")).collect()
    files = np.ones(len(index.place) + 1)
    for r in counts:
        files[r.word] += r.files
    idf = 1 + np.log(files[-1] / files[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [], []
            for at, word, known in zip(*(batch.column(c) for c in ("at", "word", "base_labels"))):
                own = {label: 1.0 for label in known.as_py()}
                if at.is_valid:
                    a, w = at.values.to_numpy(), word.values.to_numpy().astype(np.int64)
                    here = np.bincount(w, minlength=len(idf)) > 0
                    for t in index.templates:
                        if here[t.needed].all() and (share := matched(a, w, t, idf, rare, slack)) >= least:
                            own[t.label] = max(share, own.get(t.label, 0.0))
                labels.append(sorted(own))
                scores.append(max(own.values(), default=0.0))
            kept = [batch.column(c) for c in ("id", "n_words", "n_base", "first_word", "last_word", "base_labels")]
            names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=names)

    ddl = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
    found = told.where("counts is null").drop("counts").mapInArrow(run, f"id {kind}, {ddl}")
    return found.withColumnRenamed("id", id_col)
