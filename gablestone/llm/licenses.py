"""License scans by conditional compression.

Sentences with a word that licences use are joined with their neighbours into candidate
blocks, over the newlines of wrapped text and over blank lines. A block is compressed alone and with each template as a raw zstandard dictionary;
the templates are ranked by how much smaller the block gets. The rank drops none: all whose
words occur in the block often enough, in whatever order, are compared word by word. A
template is confirmed at every place where its words follow each other in order with few
missing or added, and those are reported. Numbers are compared apart, so that one template
serves all versions of a licence and the version is read from the block.

Texts are scanned whole, in place: no shuffle, and a task holds one text at a time.

Defined results: a null or empty text has no blocks, a very long one is scanned whole; a block that no template explains is
counted as a candidate only; of equal reductions the first template by name is tried first;
repeated rows are scanned one by one; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestone.llm.common import bounded_batches, parts, read

#: Words that are missing or added may be so many less than all of a template's words.
FOUND = 0.85
#: Sign of a word that a place has taken, and what passing it costs: more than any template has words.
TAKEN, WALL = -2, 1 << 20

# Wordings of public licences and of the notices that point to them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.',
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "ISC": ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.', "SPDX-License-Identifier: ISC"),
    "LGPL": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.',
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.', "SPDX-License-Identifier: Unlicense"),
}
TRIGGER = re.compile(r"licen[sc]|copyright|permission|warrant|spdx|redistribut|public[\W_]+domain|\bCC[\s-]+BY|free[\W_]+software", re.I)
#: Ends of sentences. A single newline is white space, as licences come in wrapped lines.
END = re.compile(r"[.!?;:](?=\s)|\n[^\S\n]*\n\s*")
WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")

FOUND_TYPE = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("license", T.StringType()),
    T.StructField("reduction", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("added", T.ArrayType(T.StringType())),
])


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def blocks(text: str | None) -> list[tuple[int, int]]:
    """Spans of sentences that use words of licences, with one more on each side, without their outer white space.

    Spans that touch are one: so it goes on over one or two other sentences in between.
    """
    out: list[tuple[int, int]] = []
    if not text or not TRIGGER.search(text):
        return out
    cuts = [0, *(m.end() for m in END.finditer(text)), len(text)]
    # Blank pieces are no sentences.
    spans = [(a + len(t) - len(t.lstrip()), a + len(t.rstrip())) for a, b in pairwise(cuts) if (t := text[a:b]).strip()]
    starts = [a for a, _ in spans]
    last = -1
    for m in TRIGGER.finditer(text):
        first, final = bisect(starts, m.start()) - 1, bisect(starts, m.end() - 1) - 1
        low, high = max(0, first - 1), min(len(spans) - 1, final + 1)
        if out and low <= last + 1:
            out[-1] = (out[-1][0], max(out[-1][1], spans[high][1]))
        else:
            out.append((spans[low][0], spans[high][1]))
        last = max(last, high)
    return out


def bare(ws: list[str]) -> list[str]:
    """The words, with one sign for all numbers."""
    return ["0" if w[0].isdigit() else w for w in ws]


def _next_row(above: np.ndarray, want: int, block: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Fewest missing and added words up to each place of the block, with one more word of a template."""
    row = above + 1
    row[1:] = np.minimum(row[1:], np.where(block == want, above[:-1], row[1:]))
    # A word of the block that is passed over costs one; a taken word can't be passed.
    return np.minimum.accumulate(row - steps) + steps


def _steps(block: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.where(block == TAKEN, WALL, 1))])


def last_row(want: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Fewest missing and added words of the whole template in a span that ends at each place of the block."""
    row, steps = np.zeros(len(block) + 1, np.int64), _steps(block)
    for w in want:
        row = _next_row(row, w, block, steps)
    return row


def alignment(want: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of equal places in a template and in the span that ends with the block and differs least."""
    steps = _steps(block)
    rows = [np.zeros(len(block) + 1, np.int64)]
    for w in want:
        rows.append(_next_row(rows[-1], w, block, steps))
    i, j, pairs = len(want), len(block), []
    while i and j:
        if want[i - 1] == block[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], level: int = 3):
        import zstandard

        self.templates = [(name, t) for name in sorted(templates) for t in templates[name]]
        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.given = []
        for _, t in self.templates:
            d = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False))
        self.words = [words(t) for _, t in self.templates]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in bare(ws)}))}
        self.ids = [np.array([self.vocabulary[w] for w in bare(ws)], np.int64) for ws in self.words]
        self.counts = np.array([np.bincount(t, minlength=len(self.vocabulary)) for t in self.ids])
        self.sizes = np.array([len(t) for t in self.ids])
        self.allowed = np.floor((1 - FOUND) * self.sizes + 1e-9).astype(np.int64)

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """Share of its compressed size that a block loses by each template, largest first."""
        raw = block.lower().encode("utf-8", "replace")
        size = len(self.alone.compress(raw))
        cut = [((size - len(c.compress(raw))) / size, i) for i, c in enumerate(self.given)]
        return sorted(cut, key=lambda x: (-x[0], x[1]))

    def possible(self, block: list[str]) -> list[int]:
        """Templates of which so many words occur in the block, in any order, that they could be confirmed."""
        ids = np.array([self.vocabulary[w] for w in bare(block) if w in self.vocabulary], np.int64)
        shared = np.minimum(self.counts, np.bincount(ids, minlength=len(self.vocabulary))).sum(1)
        return np.flatnonzero((shared >= self.sizes - self.allowed) & (self.sizes > 0)).tolist()

    def places(self, block: list[str], i: int) -> list[tuple[str, list[str], list[str], range]]:
        """Name with the version found, missing and added words, and the span, of all separate places of a template."""
        want, most = self.words[i], int(self.allowed[i])
        reach, out = len(want) + most, []
        words_ = np.array([self.vocabulary.get(w, -1) for w in bare(block)], np.int64)
        ends = last_row(self.ids[i], words_)
        while ends[j := int(ends.argmin())] <= most:
            low = max(0, j - reach)
            pairs = alignment(self.ids[i], words_[low:j])
            hit_a, hit_b = {a for a, _ in pairs}, {low + b for _, b in pairs}
            place = range(min(hit_b), max(hit_b) + 1)
            version = next((block[low + b] for a, b in pairs if want[a][0].isdigit()), "")
            out.append((self.templates[i][0] + (f"-{version}" if version else ""), [w for k, w in enumerate(want) if k not in hit_a], [block[k] for k in place if k not in hit_b], place))
            # No place may reach over a word that is taken: the ends near it are counted anew behind it.
            words_[place.start : place.stop] = TAKEN
            far = min(len(words_), place.stop + reach)
            begin = max(0, place.start - reach)
            ends[place.start + 1 : far + 1] = last_row(self.ids[i], words_[begin:far])[place.start + 1 - begin :]
        return out

    def scan(self, text: str | None) -> list[tuple]:
        """(start, end, licence or None, reduction, missing, added) of every candidate block."""
        out = []
        for a, b in blocks(text):
            block = text[a:b]
            w = words(block)
            ranked = self.ranked(block)
            able = set(self.possible(w))
            confirmed = [(cut, c) for cut, i in ranked if i in able for c in self.places(w, i)]
            taken: list[range] = []
            # Where two wordings claim the same words, the one that differs least has them.
            for cut, (name, missing, added, place) in sorted(confirmed, key=lambda x: (len(x[1][1]) + len(x[1][2]), -len(x[1][3]), x[1][0])):
                k = bisect(taken, place.start, key=lambda t: t.start)
                if (not k or taken[k - 1].stop <= place.start) and (k == len(taken) or taken[k].start >= place.stop):
                    taken.insert(k, place)
                    out.append((a, b, name, round(cut, 4), missing, added))
            if not taken:
                out.append((a, b, None, round(max(0.0, ranked[0][0]), 4) if ranked else 0.0, [], []))
        return out


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    return Scanner(TEMPLATES)


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))
    names = [f.name for f in kind.value_type]
    for texts in parts(batches):
        yield pa.array([[dict(zip(names, x)) for x in default_scanner().scan(t)] for t in texts.to_pylist()], kind)


scan_texts = F.arrow_udf(_scan, T.ArrayType(FOUND_TYPE)).asNondeterministic()


def scan(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """docs with an array of the blocks found in each whole text."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, scan_texts(F.col(text)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licenses", lambda x: x["license"].isNotNull())
    return found.select(
        "doc_id",
        F.size(F.array_distinct(F.transform("licenses", lambda x: x["start"]))).cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["license"])))).alias("licenses"),
        F.size(F.flatten(F.transform(sure, lambda x: F.concat(x["missing"], x["added"])))).cast("long").alias("n_differences"),
    )
