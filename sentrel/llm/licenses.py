"""Operator 11: licence scans with a positional index of rare words.

Templates are notices of public licences, each with key phrases that must stand. The
index maps a template's rarest words, by document frequency over all texts, to their
places in it. Each occurrence of such a word in a file votes for an offset (place in the
file minus place in the template); offsets fall into overlapping bands, so a few
inserted or missing words do no harm. A band with enough different rare words is a
candidate; it is a licence if every key phrase stands there, word for word, at an offset
of the same band. Its score is the weight of the template's words found at offsets of
the band over the weight of all its words.

Base phrases are found wherever their words stand consecutively. A text with one has a
score of at least BASE_SCORE.

Words are runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z; they are
compared as 64-bit hashes. NULL and empty texts have no words, no labels and a score of
0. Texts of any length are scanned whole; rows with equal ids, or none, one by one. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentrel.llm import seq

# Phrases and labels of the base scan.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: (label, words of the notice, key phrases). Notices as their publishers word them.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "in compliance with the license")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1")),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form", "mozilla public license v 2 0")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)
#: Rare words a template is looked up by; of these a band must hold (or all, if fewer).
RARE, NEED = 3, 2
#: Width of a band is twice this many words.
BAND = 8
BASE_SCORE = 0.5

_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.r_[48:58, 97:123, 128:256]] = True
#: More than any place in a template, and than any offset's band is wide.
_ORIGIN = 1 << 20
_TEXT = 1 << 40


Template = tuple[str, str, tuple[str, ...]]


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for _, text, keys in templates for w in " ".join((text, *keys)).split()} | {w for phrase, _ in BASE for w in phrase.split()})


def _hash(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in data])
    return seq.Hasher(seq.BYTE_VALUES[np.frombuffer(b"".join(data), np.uint8)]).ranges(ends - [len(x) for x in data], ends)


class Found:
    """The words of a group of texts: how many each has, and where those of the
    vocabulary stand."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, words: list[str]):
        low = seq.LOWER[buf]
        solid = np.concatenate(([False], _IS_WORD[low], [False]))
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        at = np.searchsorted(starts, offs)
        self.counts = np.diff(at)
        hashes = _hash(words)
        order = np.argsort(hashes)
        mine = seq.Hasher(seq.BYTE_VALUES[low]).ranges(starts, ends)
        i = np.minimum(np.searchsorted(hashes[order], mine), len(words) - 1)
        self.ids = np.where(hashes[order][i] == mine, order[i], -1)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(starts)) - at[:-1][self.text]
        hits = np.flatnonzero(self.ids >= 0)
        hits = hits[np.argsort(self.ids[hits], kind="stable")]
        cuts = np.searchsorted(self.ids[hits], np.arange(len(words) + 1))
        self.by_word = [hits[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def phrase(self, ids: list[int]) -> np.ndarray:
        """Where the words begin to stand consecutively within one text."""
        x = self.by_word[ids[0]]
        x = x[x + len(ids) <= len(self.ids)]
        for i, w in enumerate(ids[1:], 1):
            x = x[self.ids[x + i] == w]
        return x[self.text[x] == self.text[x + len(ids) - 1]]

    def bands(self, x: np.ndarray, place: int) -> np.ndarray:
        """(text, band) of occurrences ``x`` of what stands at ``place`` in a template."""
        k = (self.place[x] - place) // BAND
        base = self.text[x] * _TEXT + k + _ORIGIN
        return np.unique(np.concatenate((base, base + 1)))


def _starts(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def weights(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Of each word of the vocabulary a weight that falls with its document frequency,
    1 at least. One row per word reaches the driver."""
    words = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(len(words), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, buf, offs in seq.batches(b.column(0)):
                f = Found(buf, offs, words)
                n += [len(np.unique(f.text[x])) for x in f.by_word]
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(-1, len(words)), pa.int32()), "n": pa.array([rows, *n.tolist()], pa.int64())})

    got = {r.word: r.n for r in docs.select(F.col(f"`{text_col}`").alias("_t")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = got.get(-1, 0)
    return {w: 1 + int(math.floor(1000 * math.log((rows + 1) / (got.get(i, 0) + 1)) + 0.5)) for i, w in enumerate(words)}


class Index:
    """For each template its rare words with their places, its key phrases, and the
    weights of all its words."""

    def __init__(self, weight: dict[str, int], templates: tuple[Template, ...] = TEMPLATES):
        self.words = vocabulary(templates)
        at = {w: i for i, w in enumerate(self.words)}
        self.base = [([at[w] for w in phrase.split()], label) for phrase, label in BASE]
        self.templates = []
        for label, text, keys in templates:
            t = text.split()
            rare = sorted(set(t), key=lambda w: (-weight[w], w))[:RARE]
            postings = [(at[w], [i for i, x in enumerate(t) if x == w]) for w in rare]
            phrases = [([at[w] for w in k.split()], _starts(t, k.split())) for k in keys]
            self.templates.append((label, postings, phrases, [(at[w], i, weight[w]) for i, w in enumerate(t)]))

    def accepted(self, f: Found) -> Iterator[tuple[str, list, np.ndarray, np.ndarray]]:
        """(label, words of the template, (text, band) pairs in which it stands, the
        share of the template's weight found in each)."""
        for label, postings, phrases, words in self.templates:
            votes = [np.unique(np.concatenate([f.bands(f.by_word[w], i) for i in places])) for w, places in postings]
            bands, n = np.unique(np.concatenate(votes), return_counts=True)
            bands = bands[n >= min(NEED, len(votes))]
            for ids, i in phrases:
                bands = np.intersect1d(bands, f.bands(f.phrase(ids), i)) if len(bands) else bands
            if len(bands):
                found = sum(np.isin(bands, f.bands(f.by_word[w], i)) * weight for w, i, weight in words)
                yield label, words, bands, found / sum(weight for *_, weight in words)

    def places(self, f: Found) -> list[tuple[int, str, int, int, float]]:
        """(text, label, first and last word, share) of each place a notice stands in;
        of bands that overlap the one with the largest share, the first on ties."""
        out = []
        for label, words, bands, share in self.accepted(f):
            run = np.cumsum(np.concatenate(([True], np.diff(bands) > 1)))
            order = np.lexsort((bands, -share, run))
            best = np.sort(order[np.concatenate(([True], np.diff(run[order]) > 0))])
            b, share = bands[best], share[best]
            low, high = np.full(len(b), np.iinfo(np.int64).max), np.full(len(b), -1)
            for w, i, _ in words:
                x = f.by_word[w]
                for key in (f.text[x] * _TEXT + (f.place[x] - i) // BAND + _ORIGIN + k for k in (0, 1)):
                    at = np.minimum(np.searchsorted(b, key), len(b) - 1)
                    hit = b[at] == key
                    np.minimum.at(low, at[hit], f.place[x][hit])
                    np.maximum.at(high, at[hit], f.place[x][hit])
            out += zip((b // _TEXT).tolist(), [label] * len(b), low.tolist(), high.tolist(), np.round(share, 6).tolist())
        return sorted(out)

    def scan(self, f: Found, rows: int) -> dict[str, list]:
        n_base, score = np.zeros(rows, np.int64), np.zeros(rows)
        first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        base: list[set[str]] = [set() for _ in range(rows)]
        more: list[set[str]] = [set() for _ in range(rows)]
        for ids, label in self.base:
            x = f.phrase(ids)
            np.add.at(n_base, f.text[x], 1)
            np.minimum.at(first, f.text[x], f.place[x])
            np.maximum.at(last, f.text[x], f.place[x])
            score[f.text[x]] = BASE_SCORE
            for k in np.unique(f.text[x]).tolist():
                base[k].add(label)
        for label, _, bands, share in self.accepted(f):
            np.maximum.at(score, bands // _TEXT, share)
            for k in np.unique(bands // _TEXT).tolist():
                more[k].add(label)
        none = n_base == 0
        return {
            "n_words": pa.array(f.counts.astype(np.int64)), "n_base": pa.array(n_base), "first_word": pa.array(first, mask=none), "last_word": pa.array(last.astype(np.int64), mask=none),
            "base_labels": pa.array([",".join(sorted(x)) for x in base]), "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(base, more)]), "score": pa.array(np.round(score, 6)),
        }


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per place in which a notice stands: id, label, first_word, last_word
    (words from 0, of those found in the band) and share, what of the notice's weight is found there. ``templates``:
    (label, words, key phrases that are part of the words); they and their index are
    sent to every task, so they are as many as fit there."""
    index = Index(weights(docs, text_col, templates), templates)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, buf, offs in seq.batches(b.column("_text")):
                rows = index.places(Found(buf, offs, index.words))
                ids = b.column("_id").take(pa.array([i + r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)], pa.array([r[4] for r in rows], pa.float64())], ["_id", "label", "first_word", "last_word", "share"])

    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return d.mapInArrow(find, f"_id {d.schema['_id'].dataType.simpleString()}, label string, first_word long, last_word long, share double").withColumnRenamed("_id", id_col)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word, base_labels,
    labels, score (see find_licenses for the places)."""
    index = Index(weights(docs, text_col, templates), templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in seq.batches(b.column("_text")):
                yield pa.RecordBatch.from_pydict({"_id": b.column("_id").slice(i, j - i), **index.scan(Found(buf, offs, index.words), j - i)})

    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    schema = f"_id {d.schema['_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return d.mapInArrow(scan, schema).withColumnRenamed("_id", id_col)


def sql() -> str:
    """The same over the table documents, word by word, for DuckDB."""
    def values(rows) -> str:
        return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) if not isinstance(x, list) else "[" + ", ".join(f"'{w}'" for w in x) + "]" for x in r) + ")" for r in rows)

    t = [(k, label, i, w) for k, (label, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    p = [(k, j, key.split(), _starts(text.split(), key.split())) for k, (_, text, keys) in enumerate(TEMPLATES) for j, key in enumerate(keys)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t(k, label, i, word) AS ({values(t)}), p(k, j, key, i) AS ({values(p)}), b(phrase, label) AS ({values([(x.split(), label) for x, label in BASE])}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS x FROM d),
v AS (SELECT word, 1 + CAST(floor(1000 * ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (count(DISTINCT r) + 1)) + 0.5) AS BIGINT) AS weight FROM (SELECT DISTINCT word FROM t) LEFT JOIN o USING (word) GROUP BY word),
rare AS (SELECT k, word FROM (SELECT DISTINCT k, word, weight FROM t JOIN v USING (word)) QUALIFY row_number() OVER (PARTITION BY k ORDER BY weight DESC, word) <= {RARE}),
votes AS (SELECT DISTINCT r, k, word, i, CAST(floor((x - i) / {BAND}.0) AS BIGINT) + s AS band FROM o JOIN t USING (word), (VALUES (0), (1)) f(s) WHERE r IN (SELECT r FROM o JOIN rare USING (word))),
cand AS (SELECT r, k, band FROM votes JOIN rare USING (k, word) GROUP BY r, k, band HAVING count(DISTINCT word) >= least({NEED}, (SELECT count(*) FROM rare q WHERE q.k = votes.k))),
keys AS (SELECT DISTINCT o.r, p.k, p.j, CAST(floor((o.x - p.i) / {BAND}.0) AS BIGINT) + s AS band FROM p JOIN o ON o.word = p.key[1] JOIN d ON d.r = o.r, (VALUES (0), (1)) f(s) WHERE d.ws[o.x + 1 : o.x + len(p.key)] = p.key),
sure AS (SELECT r, k, band FROM cand JOIN keys USING (r, k, band) GROUP BY r, k, band HAVING count(DISTINCT j) = (SELECT count(*) FROM p q WHERE q.k = cand.k)),
cover AS (SELECT r, k, band, sum(weight)::DOUBLE / (SELECT sum(weight) FROM t JOIN v USING (word) WHERE t.k = c.k) AS score FROM (SELECT DISTINCT r, k, band, i, word FROM sure JOIN votes USING (r, k, band)) c JOIN v USING (word) GROUP BY r, k, band),
more AS (SELECT r, max(score) AS score FROM cover GROUP BY r),
places AS (SELECT o.r, o.x, b.label FROM b JOIN o ON o.word = b.phrase[1] JOIN d ON d.r = o.r WHERE d.ws[o.x + 1 : o.x + len(b.phrase)] = b.phrase),
base AS (SELECT r, count(*) AS n_base, min(x) AS first_word, max(x) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM sure JOIN (SELECT DISTINCT k, label FROM t) USING (k)) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    round(greatest(coalesce(score, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN {BASE_SCORE}::DOUBLE ELSE 0 END), 6) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r) LEFT JOIN labels USING (r)"""
