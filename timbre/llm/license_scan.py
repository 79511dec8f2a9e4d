"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every run of consecutive lines of a file, from one line to its whole text, is a
sparse TF-IDF vector, held against the templates by cosine.  A file whose whole text
matches is a licence file and speaks for its directory; a file without a match of
its own takes the licence of its nearest ancestor directory that has one, by joins on paths.

Inverse document frequencies come from all files, as counts in a fixed number of hashed slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_words, join_groups, materialize, slices, split_words

SLOTS = 1 << 16
THRESHOLD = 0.8

#: Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved."],
}


def standard_templates() -> dict[str, list[str]]:
    """``TEMPLATES`` and the standard full text of each licence in the folder ``licenses``, read on the driver only."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for file in sorted((resources.files(__package__) / "licenses").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            out.setdefault(file.name.removesuffix(".txt"), []).append(file.read_text("utf-8"))
    return out


_MARKS = r"[^\p{L}\p{N}+.\n-]+"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed terms of all texts, text offsets, and line number of each term within its text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _MARKS, " ")
    lines = pc.split_pattern(plain, "\n")
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    at = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    words, offsets = split_words(pc.replace_substring_regex(lines.flatten(), r"[.-]+( |$)", " "))
    counts = np.diff(offsets)
    line = np.repeat(np.arange(len(counts)) - np.repeat(at[:-1], np.diff(at)), counts)
    return hash_words(words), offsets[at], line


def _slot(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(40)).astype(np.int64) % SLOTS


def document_frequencies(files: DataFrame) -> tuple[int, np.ndarray]:
    """Number of files, and in how many of them each slot occurs: bounded by ``SLOTS`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, np.zeros(SLOTS, np.int64)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                terms, offsets, _ = _terms(batch.column("text")[a:b])
                doc = np.repeat(np.arange(b - a), np.diff(offsets))
                held += np.bincount(np.unique(doc * SLOTS + _slot(terms)) % SLOTS, minlength=SLOTS)
                total += b - a
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], total))], names=["slot", "n"])

    rows = files.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df, total = np.zeros(SLOTS), 0
    for s, n in zip(rows["slot"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if s < 0:
            total = n
        else:
            df[s] = n
    return total, df


class _Matcher:
    def __init__(self, total: int, df: np.ndarray, templates: dict[str, list[str]]):
        self.idf = np.log((total + 1) / (df + 1)) + 1
        self.names, self.vectors = [], []
        for name in sorted(templates):
            for text in templates[name]:
                terms, _, _ = _terms(pa.array([text.replace("\n", " ")]))
                uniq, n = np.unique(terms, return_counts=True)
                w = n * self.idf[_slot(uniq)]
                self.names.append(name)
                self.vectors.append((uniq, w / np.linalg.norm(w)))
        self.vocabulary = np.unique(np.concatenate([u for u, _ in self.vectors])) if self.vectors else np.zeros(0, np.uint64)
        self.table = np.zeros((len(self.vocabulary) + 1, len(self.names)))  # last row: terms of no template
        for i, (u, w) in enumerate(self.vectors):
            self.table[np.searchsorted(self.vocabulary, u), i] = w
        self.squares = self.table**2

    def near(self, terms: np.ndarray, doc: np.ndarray, n: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each of ``n`` texts some run of whose lines may reach the threshold, with the templates it may reach.

        No run has a cosine above the norm of that part of the template whose terms the text has at all.
        """
        if not len(terms) or not self.names:
            return
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == terms
        size = len(self.vocabulary)
        pairs = np.unique(doc[known] * size + at[known])
        if not len(pairs):
            return
        owner, first = np.unique(pairs // size, return_index=True)
        covered = np.add.reduceat(self.squares[pairs % size], first)
        able = covered >= threshold**2 - 1e-9
        for i in np.flatnonzero(able.any(1)):
            yield int(owner[i]), np.flatnonzero(able[i])

    def runs(self, terms: np.ndarray, line: np.ndarray, able: np.ndarray, threshold: float) -> tuple[tuple[int, float], tuple[int, float]]:
        """Best template (-1: none) and cosine of the whole text, and of all runs of its consecutive lines, over the templates ``able``.

        Exact: every run is judged that begins with a line of a template's terms and that longer norms do not rule out.
        Once the whole text matches, runs from later lines are not sought: the whole decides.
        Of equal cosines the run that begins first wins, then the first template.
        """
        idf = self.idf[_slot(terms)]
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        at = np.where(self.vocabulary[at] == terms, at, len(self.vocabulary))
        dots = self.table[at][:, able] * idf[:, None]
        starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        ends = np.append(starts[1:], len(terms))
        # occurrence number of each term within the text: a term's k-th occurrence adds (2k - 1) idf^2 to the squared norm
        _, term, count = np.unique(terms, return_inverse=True, return_counts=True)
        order = np.argsort(term, kind="stable")
        nth = np.empty(len(terms), np.int64)
        nth[order] = np.arange(len(terms)) - np.repeat(np.cumsum(count) - count, count)
        before = np.zeros(len(count), np.int64)  # occurrences of each term before the start of the run
        left = dots[::-1].cumsum(0)[::-1]
        sums = np.add.reduceat(dots, starts)
        best, held = (-1, 0.0), 0
        for k, start in enumerate(starts):
            before += np.bincount(term[held:start], minlength=len(count)) if start > held else 0
            held = start
            if k and not sums[k].any():
                continue
            # the norm only grows and what is left of the products bounds every later one: seek on while they allow a match
            stop = k
            dot, norm = np.zeros((0, len(able))), np.zeros(0)
            step = 256
            while stop < len(starts):
                a, upto = starts[stop], int(np.searchsorted(ends, ends[stop] + step, "right"))
                upto = min(max(upto, stop + 1), len(starts))
                b = ends[upto - 1]
                e = ends[stop:upto] - a - 1
                d = dots[a:b].cumsum(0)[e] + (dot[-1] if len(dot) else 0)
                sq = (idf[a:b] ** 2 * (2 * (nth[a:b] - before[term[a:b]]) + 1)).cumsum()[e] + (norm[-1] if len(norm) else 0)
                dot, norm = np.concatenate([dot[-1:], d]), np.concatenate([norm[-1:], sq])
                cos = d / np.sqrt(sq)[:, None]
                top = cos.max(0)
                i = int(np.argmax(top >= top.max() - 1e-12))
                if top[i] >= threshold - 1e-12 and (best[0] < 0 or top[i] > best[1] + 1e-12):
                    best = int(able[i]), float(top[i])
                if k == 0 and upto == len(starts):
                    i = int(np.argmax(cos[-1] >= cos[-1].max() - 1e-12))
                    if cos[-1, i] >= threshold - 1e-12:
                        return (int(able[i]), float(cos[-1, i])), best
                stop, step = upto, 2 * step
                if (left[start] < max(threshold, best[1]) * np.sqrt(sq[-1]) - 1e-9).all() and k:
                    break
        return (-1, 0.0), best


def license_scan(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score, how, from_dir) for each row of ``files(path, text, ...)``.

    ``templates`` holds notices and licence texts by name; None takes ``standard_templates()``.
    ``how``: "file" (the whole text is one of them), "header" (a run of consecutive lines is, wherever it lies), "inherited"
    (from ``from_dir``), or null with no licence.  Of equal cosines the run that begins first wins,
    then the alphabetically first licence; of several licence files in one directory the best match, then
    the smallest path.  A null text matches nothing but inherits; a null path
    neither inherits nor speaks for a directory; repeated rows are judged alike.  Very long
    texts are judged whole; an empty table gives an empty result.
    Columns beside path and text are carried along, unless named like a result column.
    """
    templates = standard_templates() if templates is None else templates
    taken = {"path", "text", "license", "score", "how", "from_dir"}
    rest = [c for c in files.columns if c.lower() not in taken]
    bounded_batches(files.sparkSession)
    total, df = document_frequencies(files)
    matcher = _Matcher(total, df, templates)
    schema_rest = files.select(*(F.col(f"`{c}`") for c in rest)).schema
    names = [*rest, "path", "license", "score", "how"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                n = b - a
                terms, offsets, line = _terms(batch.column("text")[a:b])
                doc = np.repeat(np.arange(n), np.diff(offsets))
                license_, score, how = [None] * n, [None] * n, [None] * n
                for d, able in matcher.near(terms, doc, n, threshold):
                    lo, hi = offsets[d] - offsets[0], offsets[d + 1] - offsets[0]
                    whole, best = matcher.runs(terms[lo:hi], line[lo:hi], able, threshold)
                    k, v, h = (*whole, "file") if whole[0] >= 0 else (*best, "header")
                    if k >= 0:
                        license_[d], score[d], how[d] = matcher.names[k], round(v, 6), h
                part = batch.slice(a, n)
                kept = [part.column(c) for c in [*rest, "path"]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(license_, pa.string()), pa.array(score, pa.float64()), pa.array(how, pa.string())], names=names)

    schema = schema_rest.add("path", "string").add("license", "string").add("score", "double").add("how", "string")
    own = files.select(*(F.col(f"`{c}`") for c in rest), F.col("path").cast("string").alias("path"), F.col("text")).mapInArrow(match, schema)
    # the other columns travel as one, so that no name of theirs meets one of the joins'
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(True)
    own = materialize(own.select(row.alias("row"), "path", "license", "score", "how"))
    own = own.withColumn("dir", F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1))
    speaks = own.where("how = 'file' and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("m")).select(F.col("dir").alias("l_dir"), F.col("m.license").alias("l_license"))
    # nearest ancestors are sought once for each directory, not for each file
    dirs = own.where("license is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.size(parts), F.lit(0), F.lit(-1))).alias("depth"), parts.alias("parts"))
    above = above.select("dir", "depth", F.concat_ws("/", F.slice("parts", 1, F.col("depth"))).alias("l_dir")).distinct()
    nearest = above.join(speaks, "l_dir").groupBy("dir").agg(F.max(F.struct("depth", "l_dir", "l_license")).alias("m")).select(F.col("dir").alias("n_dir"), "m")
    # a directory may hold a third of all files: those that inherit meet their directory's licence by size of the directory
    heirs = own.where("license is null and path is not null")
    sizes = heirs.groupBy("dir").agg(F.count("*").alias("files"))
    found = materialize(sizes.join(nearest, F.col("dir") == F.col("n_dir"), "left").select("dir", "files", "m"))
    out = join_groups(heirs, found, ["dir"], "files").drop("files").unionByName(own.where("license is not null or path is null").withColumn("m", F.lit(None).cast(found.schema["m"].dataType)))
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in rest), "path", F.coalesce("license", F.col("m.l_license")).alias("license"), "score",
        F.when(F.col("how").isNotNull(), F.col("how")).when(F.col("m").isNotNull(), F.lit("inherited")).alias("how"),
        F.col("m.l_dir").alias("from_dir"),
    )
