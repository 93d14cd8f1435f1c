"""License scans through a positional index of rare licence words.

Document frequencies of all licence words are counted over the whole corpus.
Each template enters the index with the highest-IDF words of its mandatory key
phrase, each with its position in the template.  A file looks up those of its
words that the index holds, rarest first; postings of one template are
intersected by relative position (place in the file minus place in the
template), and what is left is verified: the key phrase must stand there word
by word.  As every anchor is a word of the key phrase, no file that holds the
phrase is missed, whatever the frequencies are.

Defined results: null or empty texts have no words and no places; repeated
places count each; ties between equally rare words go to the smaller word, then
the earlier position; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from prismspark.llm.storage import small_batches

#: Words that anchor one template in the index.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    """``key`` is the mandatory phrase; it begins at word ``at`` of ``text``."""

    label: str
    text: str
    key: str
    base: bool = False


# The base phrases and their labels.
BASE_TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)
# Opening words of published licences.
MORE_TEMPLATES = (
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "the mit license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("spdx", "spdx license identifier", "spdx license identifier"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
TEMPLATES = BASE_TEMPLATES + MORE_TEMPLATES

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of 0-9, a-z and non-ASCII, A-Z lower-cased."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def vocabulary(templates: tuple[Template, ...]) -> list[bytes]:
    return sorted({w for t in templates for w in t.text.encode().split()})


def document_frequencies(docs: DataFrame, words: list[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all rows each word stands, and the number of rows."""
    wanted = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                found.update(wanted.intersection(words_of(text)))
        rows = [(w.decode(), c) for w, c in found.items()] + [("", n)]
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in rows], "n": pa.array([c for _, c in rows], pa.int64())})

    total = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").sum("n").collect()  # a row for each licence word
    counts = {r[0].encode(): r[1] for r in total}
    return {w: counts.get(w, 0) for w in words}, counts.get(b"", 0)


def rare_index(templates: tuple[Template, ...], idf: dict[bytes, float]) -> tuple[dict[bytes, list[tuple[int, int]]], list[int]]:
    """word -> postings (template, position in its key phrase) of each
    template's rarest key words; and how many anchors each template has."""
    index: dict[bytes, list[tuple[int, int]]] = {}
    sizes = []
    for t, template in enumerate(templates):
        key = template.key.encode().split()
        best = sorted(range(len(key)), key=lambda j: (-idf[key[j]], key[j], j))[:ANCHORS]
        sizes.append(len(best))
        for j in best:
            index.setdefault(key[j], []).append((t, j))
    return index, sizes


def find(words: list[bytes], index: dict, sizes: list[int], keys: list[list[bytes]], idf: dict[bytes, float]) -> list[tuple[int, int]]:
    """(template, place) of every verified key phrase in ``words``."""
    if index.keys().isdisjoint(words):
        return []
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in index:
            places.setdefault(w, []).append(i)
    held: dict[int, set[int]] = {}
    met: Counter = Counter()
    for w in sorted(places, key=lambda w: (-idf[w], w)):
        for t, j in index[w]:
            starts = {i - j for i in places[w]}
            held[t] = starts if met[t] == 0 else held[t] & starts
            met[t] += 1
    return [(t, s) for t, starts in held.items() if met[t] == sizes[t] for s in starts if s >= 0 and words[s : s + len(keys[t])] == keys[t]]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score) of every row: places of base templates, the labels of all, and the
    IDF-weighted share of the best template that stands around its key."""
    small_batches(docs.sparkSession)
    df, n = document_frequencies(docs, vocabulary(templates))
    idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in df.items()}
    index, sizes = rare_index(templates, idf)
    texts = [t.text.encode().split() for t in templates]
    keys = [t.key.encode().split() for t in templates]
    at = [next(i for i in range(len(x)) if x[i : i + len(k)] == k) for x, k in zip(texts, keys, strict=True)]
    labels, base = [t.label for t in templates], [t.base for t in templates]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def covered(words: list[bytes], t: int, start: int) -> float:
        begin = start - at[t]
        got = sum(idf[w] for j, w in enumerate(texts[t]) if 0 <= begin + j < len(words) and words[begin + j] == w)
        return got / sum(idf[w] for w in texts[t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                found = find(words, index, sizes, keys, idf)
                own = [s for t, s in found if base[t]]
                out.append((
                    doc_id, len(words), len(own), min(own, default=None), max(own, default=None),
                    ",".join(sorted({labels[t] for t, _ in found if base[t]})), ",".join(sorted({labels[t] for t, _ in found})),
                    min(1.0, max((covered(words, t, s) for t, s in found), default=0.0)),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
