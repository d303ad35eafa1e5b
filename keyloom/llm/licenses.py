"""Licence scan by a positional rare-token index.

The templates are lists of words by position. For every template whose mandatory key phrase has all its
words in the file, the phrase's word that is rarest in the corpus is looked up; where the phrase stands word by word,
it votes for the place where the template would begin, as do the template's other words within a few positions of
theirs. The alignment counts if enough of the template's words stand at their places. No template is left out for
another's words.

Cases: null text is the empty text (no words, empty labels, score 0); very long texts are scanned whole, in time
linear in their length; repeated rows each give their row; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrase and label of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of common licences, and the phrase of each that must be there.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "mit-mention": "released under the mit license",
    "apache-mention": "licensed under the apache license version 2 0",
    "gpl-mention": "under the terms of the gnu general public license",
}
KEYS = {
    "mit": "permission is hereby granted free of charge",
    "apache": "licensed under the apache license",
    "gpl": "gnu general public license",
    "bsd": "redistribution and use in source and binary forms",
    "isc": "permission to use copy modify and or distribute this software",
    "mpl": "mozilla public license",
    "unlicense": "free and unencumbered software",
    "mit-mention": "the mit license",
    "apache-mention": "the apache license",
    "gpl-mention": "gnu general public license",
}
#: Positions by which votes may differ, and the least part of a template in place.
SLACK, LEAST = 4, 0.6
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Index:
    """Templates and key phrases as words, and the words' weights."""

    def __init__(self, idf: dict[bytes, float], templates: dict[str, str] = TEMPLATES, keys: dict[str, str] = KEYS):
        self.templates = {n: t.encode().split() for n, t in templates.items()}
        self.keys = {n: k.encode().split() for n, k in keys.items()}
        self.idf = idf
        self.vocabulary = frozenset(w for t in self.templates.values() for w in t)
        self.key_start = {n: next(i for i in range(len(t)) if t[i : i + len(self.keys[n])] == self.keys[n]) for n, t in self.templates.items()}
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def base(self, words: list[bytes], at: dict[bytes, list[int]]) -> tuple[list[int], set[str]]:
        places, labels = [], set()
        for phrase, label in self.phrases:
            k = len(phrase) - 1
            for i in at.get(phrase[-1], ()):
                if i >= k and words[i - k : i + 1] == phrase:
                    places.append(i - k)
                    labels.add(label)
        return places, labels

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Base places and labels, the method's labels, and the best part of a template in place."""
        held = self.vocabulary.intersection(words)
        if len(held) < 2:
            return [], set(), set(), 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in held:
                at[w].append(i)
        places, base = self.base(words, at)
        found, score = set(), 0.0
        for name, template in self.templates.items():
            key = self.keys[name]
            if not held.issuperset(key):
                continue
            rare = max(range(len(key)), key=lambda i: (self.idf.get(key[i], math.inf), -i))
            best, tried = 0, set()
            for i in at[key[rare]]:
                k = i - rare
                if k < 0 or words[k : k + len(key)] != key:
                    continue
                for start in range(k - self.key_start[name] - SLACK, k - self.key_start[name] + SLACK + 1):
                    if start in tried or best == len(template):
                        continue
                    tried.add(start)
                    if not any(words[start + j] == w for j, w in enumerate(template) if 0 <= start + j < len(words)):  # no vote
                        continue
                    best = max(best, sum(w in words[max(start + j - SLACK, 0) : max(start + j + SLACK + 1, 0)] for j, w in enumerate(template)))
            if best / len(template) >= LEAST:
                found.add(name)
                score = max(score, best / len(template))
        return places, base, found, score


def corpus_idf(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency over all documents of the templates' words, a fixed few hundred."""
    vocabulary = frozenset(w for t in templates.values() for w in t.encode().split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words_of(text)))
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each template word
    n = {bytes(r["word"]): r["n"] for r in rows}
    return {w: math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) for w in vocabulary}


ADDED = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]


def scan(df: DataFrame, idf: dict[bytes, float] | None = None) -> DataFrame:
    """df with the scan's columns for each whole `text`."""
    names = [n for n, _ in ADDED]
    rest = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(n, t) for n, t in ADDED)])
    weights = corpus_idf(df) if idf is None else idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(weights)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                places, base, found, score = index.scan(words)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)
