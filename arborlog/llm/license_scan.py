"""Operator 4: licence scans by the Dice coefficient of word bigrams."""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import plain_words
from .textkit import chunks, code_point_offsets, map_batches, shingle_hashes, text_buffer

#: (licence, notice), common wordings; one licence can have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Bigrams of the notices.  Dice >= t needs sizes of ratio (2 - t) / t at most and t / 2 of both sizes in common."""

    def __init__(self, templates, at_least: float):
        buf, off = text_buffer(pa.array([t for _, t in templates], pa.string()))
        h, _, _, at = plain_words(buf, off)
        self.names = [n for n, _ in templates]
        self.bigrams = [shingle_hashes(h[i:j], 2) for i, j in zip(at[:-1], at[1:])]
        self.counts = [Counter(b.tolist()) for b in self.bigrams]
        self.at_least = at_least
        self.every = np.unique(np.concatenate(self.bigrams))
        self.member = np.zeros((len(self.bigrams), len(self.every) + 1), bool)
        for k, b in enumerate(self.bigrams):
            self.member[k, np.searchsorted(self.every, b)] = True
        self.fewest = min(int(np.ceil(at_least * len(b) / (2 - at_least))) for b in self.bigrams)

    def scan(self, pairs: np.ndarray, hits: np.ndarray) -> dict[str, tuple[float, int, int]]:
        """licence -> (Dice, first word, word after the last) of the best of its notices in one text.

        A notice of m bigrams is compared with the windows of m bigrams (the whole text, where that is
        shorter) that hold enough of its own; a text too short for its size bound is not compared.
        """
        found: list[tuple[float, int, int, str]] = []
        for name, mine, counts, member in zip(self.names, self.bigrams, self.counts, self.member):
            m = min(len(mine), len(pairs))
            if m * (2 - self.at_least) < len(mine) * self.at_least:
                continue
            c = np.concatenate(([0], np.cumsum(member[hits])))
            n = c[m:] - c[:-m]
            for s in np.flatnonzero(2 * n >= self.at_least * (m + len(mine))).tolist():
                value = dice(counts, Counter(pairs[s : s + m].tolist()))
                if value >= self.at_least:
                    found.append((value, s, s + m + 1, name))
        # of spans that overlap, the one that fits best stands, then the longer one, then the first
        starts: list[int] = []
        ends: list[int] = []
        kept: dict[str, tuple[float, int, int]] = {}
        for value, x, y, name in sorted(found, key=lambda i: (-i[0], i[1] - i[2], i[1], i[3])):
            k = bisect.bisect_right(ends, x)
            if k == len(starts) or starts[k] >= y:
                starts.insert(k, x)
                ends.insert(k, y)
                kept.setdefault(name, (value, x, y))
        return kept


def license_scan(docs: DataFrame, templates=TEMPLATES, at_least: float = 0.85) -> DataFrame:
    """(doc_id, license, dice, start, end): the licences whose notice stands in a whole text, with the best span's code points.

    Texts and notices are compared as words of letters and digits without case.  Null and empty texts
    and texts of one word have none; rows that repeat a doc_id come back each; of equal values the
    first span counts; other columns are ignored; an empty table gives no rows.  There is no shuffle.
    """
    known = Templates(templates, at_least)

    def f(batch):
        ids, out = batch.column("doc_id").to_pylist(), []
        for a, _, b, o in chunks(*text_buffer(batch.column("text"))):
            words, starts, ends, at = plain_words(b, o)
            if len(words) < 2:
                continue
            pairs = shingle_hashes(words, 2)
            hits = np.searchsorted(known.every, pairs)
            hits[hits == len(known.every)] = 0
            hits[known.every[hits] != pairs] = len(known.every)
            c = np.concatenate(([0], np.cumsum(hits < len(known.every))))
            last = np.maximum(at[1:] - 1, at[:-1])
            points = None
            for i in np.flatnonzero(c[np.minimum(last, len(c) - 1)] - c[np.minimum(at[:-1], len(c) - 1)] >= known.fewest).tolist():
                lo, hi = int(at[i]), int(last[i])
                points = code_point_offsets(b) if points is None else points
                for name, (value, x, y) in known.scan(pairs[lo:hi], hits[lo:hi]).items():
                    out.append((ids[a + i], name, value, int(points[starts[lo + x]] - points[o[i]]), int(points[ends[lo + y - 1]] - points[o[i]])))
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "license", "dice", "start", "end"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, f, "doc_id long, license string, dice double, start long, end long")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
