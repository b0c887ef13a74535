"""License notices in documents, found by conditional compression.

1. Words around cues of a notice ("licen", "copyright", ...) form candidate blocks, wherever in a text they are.
2. Around its cues, as far as a template is long, a block is compressed alone and with the template as zstandard raw
   dictionary. A template that the block repeats saves most of its own bytes; templates are ranked by that share.
3. In that order they are confirmed by aligning words, exactly and anywhere in the block: the least number of words of the template
   that are missing plus words put between must be small, and none of them may be one that tells licenses apart ("Lesser", "NonCommercial", the number
   of a version and the like). Of places that overlap the one with fewest differences is confirmed, of equals the longest template's, then the first.
   All confirmed notices are taken out at once and the rest of the block is ranked again, until nothing more is confirmed.

Each document is a row of its own; nothing is shuffled, so neither hot sources nor copies matter. Null or empty
text has no blocks; very long texts are searched whole, in stretches that overlap by more than a template. Repeated rows and null ids are
kept. An empty table gives an empty result. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.batches import map_batches

#: The wording of public license notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "This work is licensed under the CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
_CREATIVE = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
#: Licenses of one wording by their parts and version.
CREATIVE_COMMONS: tuple[tuple[str, str], ...] = tuple(
    (f"CC-{parts}-{version}", text.format(short=f"CC {parts} {version}", long=f"{'-'.join(_CREATIVE[p] for p in parts.split('-'))} {version}", kind=kind))
    for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    for version, kind in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic"))
    for text in ("Licensed under {short}.", "This work is licensed under a Creative Commons {long} {kind} License.", "This work is licensed under a Creative Commons {long} License.", "Creative Commons {long}")
)
MORE: tuple[tuple[str, str], ...] = (
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("BSD-4-Clause", "Released under the BSD 4-Clause License."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
)
#: What an SPDX tag says is named by it.
TAGGED = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-2.0", "ISC", "EPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0")
ALL = TEMPLATES + tuple(x for x in CREATIVE_COMMONS if x not in TEMPLATES) + MORE + tuple((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in (*TAGGED, *dict.fromkeys(name for name, _ in CREATIVE_COMMONS)))
#: Words that tell licenses apart, and words that a number after them is a version's (or a variant's) of.
TELLING = frozenset({"lesser", "affero", "noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd", "only"})
NUMBERED = frozenset({"version", "v", "license", "licenses", "by", "nc", "sa", "nd", "attribution", "noncommercial", "sharealike", "noderivatives", "noderivs", "public", "bsd", "gpl", "lgpl", "agpl", "mpl", "epl", "bsl", "apache", "cc", "cc0", "clause"})
CUES = (b"licen", b"spdx", b"creative commons", b"advertising", b"copyright", b"permission is", b"permission to use", b"redistribut", b"free software", b"unencumbered")
#: How words that hold a cue begin.
CUE_WORDS = ("spdx", "creative", "advertising", "licen", "relicen", "sublicen", "copyright", "permission", "redistribut", "software", "commons", "unencumbered")
#: Differences that a word which tells licenses apart counts as.
FAR = 1_000_000
#: Windows of a block whose compression is remembered.
REMEMBERED = 50_000
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


@dataclass(frozen=True)
class Settings:
    """``least_saved``: share of its own compressed bytes a template must save to be aligned; ``most_different``: differing words, as a share of the template's. Blocks reach as far as a template from a cue."""

    templates: tuple[tuple[str, str], ...] = ALL
    level: int = 16
    least_saved: float = 0.12
    most_different: float = 0.12


def telling(words: list[str]) -> np.ndarray:
    """Which words tell licenses apart: some whatever stands around them, numbers after a word like "version" or after such a number."""
    out = np.zeros(len(words), bool)
    for k, w in enumerate(words):
        out[k] = w in TELLING or w.isdigit() and k > 0 and (words[k - 1] in NUMBERED or out[k - 1] and words[k - 1].isdigit())
    return out


def normal(words: list[str]) -> str:
    return " ".join(words).lower()


class Scanner:
    def __init__(self, s: Settings) -> None:
        self.s = s
        self.words = [_WORD.findall(text.lower()) for _, text in s.templates]
        self.numbers: dict[str, int] = {}
        self.coded = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64) for words in self.words]
        self.sets = [frozenset(words) for words in self.words]
        self.costs = [np.where(telling(words), FAR, 1).astype(np.int64) for words in self.words]
        self.remembered: dict[tuple[int, str], float] = {}
        self.reach = max(map(len, self.words)) + 8
        plain = {"level": s.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(normal(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain) for w in self.words]
        self.own = [len(self.alone.compress(normal(w).encode())) for w in self.words]

    def blocks(self, text: str) -> list[tuple[int, list[str]]]:
        """First word's number and words of each stretch around cues; long stretches are cut with an overlap."""
        data = text.encode("utf-8", "surrogatepass").lower()
        if not any(cue in data for cue in CUES):
            return []
        spans, words = [], []
        for m in _WORD.finditer(text):
            words.append(m[0].lower())
            spans.append(m.start())
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = sorted({bisect.bisect_right(spans, m.start()) - 1 for cue in CUES for m in re.finditer(re.escape(cue.decode()), low)})
        ranges: list[list[int]] = []
        for k in hits:
            a, b = max(0, k - self.reach), min(len(words), k + self.reach + 1)
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        longest = 6 * self.reach
        return [(c, words[c : min(b, c + longest)]) for a, b in ranges for c in range(a, max(a + 1, b - self.reach), longest - self.reach)]

    def saved(self, block: list[str]) -> list[tuple[float, int]]:
        """The templates that save enough around a cue, by the share of their own compressed bytes they save."""
        cues = [i for i, w in enumerate(block) if w.startswith(CUE_WORDS)]
        ranked, there = [], set(block)
        for k, words in enumerate(self.words):
            if len(self.sets[k] - there) > self.s.most_different * len(words):
                continue  # more words are missing than a confirmed notice may lack
            best, done = 0.0, -1
            for i in cues:
                if i > done:
                    a, done = max(0, i - len(words)), i + len(words) // 2
                    best = max(best, self._saving(k, normal(block[a : done + len(words)])))
            if best >= self.s.least_saved:
                ranked.append((best, k))
        return sorted(ranked, key=lambda x: (-x[0], x[1]))

    def _saving(self, k: int, window: str) -> float:
        """What the template as dictionary saves of a window, as a share of its own compressed bytes; repeated windows are compressed once."""
        if (k, window) not in self.remembered:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            data = window.encode("utf-8", "surrogatepass")
            self.remembered[k, window] = (len(self.alone.compress(data)) - len(self.given[k].compress(data))) / self.own[k]
        return self.remembered[k, window]

    def places(self, block: list[str], k: int, most: float) -> list[tuple[int, int, int, int]]:
        """Where template ``k`` stands in the block with at most so many differences: missing words, words put between, and the span, apart from each
        other; of places that overlap the one with fewest differences, then the first.

        ``least[i, j]``: fewest differences between the template's first i words and words that end before the block's j-th; where they begin is free.
        """
        words, own = self.coded[k], np.array([self.numbers.get(w, -1) for w in block], np.int64)
        n, m = len(words), len(own)
        missing_cost, between_cost = self.costs[k], np.where(telling(block), FAR, 1).astype(np.int64)
        step = np.concatenate([[0], np.cumsum(between_cost)])
        least = np.zeros((n + 1, m + 1), np.int64)
        for i in range(n):
            row = least[i] + missing_cost[i]
            np.minimum(row[1:], np.where(own == words[i], least[i, :-1], n * FAR * 2), out=row[1:])
            least[i + 1] = np.minimum.accumulate(row - step) + step  # or words are put between
        ends = np.nonzero(least[n] <= most)[0]
        taken, found = np.zeros(m + 1, bool), []
        for end in ends[np.argsort(least[n, ends], kind="stable")]:
            if taken[end - 1] or not end:
                continue
            i, j, missing = n, int(end), 0
            while i:  # back along the cells it came from
                if j and own[j - 1] == words[i - 1] and least[i, j] == least[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                elif least[i, j] == least[i - 1, j] + missing_cost[i - 1]:
                    i, missing = i - 1, missing + 1
                else:
                    j -= 1
            if not taken[j:end].any() and j < end:
                taken[j:end] = True
                found.append((missing, int(least[n, end]) - missing, j, int(end)))
        return found

    def findings(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of candidate blocks, and the notices confirmed, by place."""
        blocks = self.blocks(text or "")
        found: dict[tuple[int, str], dict] = {}
        over = 0  # where the last notice recorded ends
        for number, (first, block) in enumerate(blocks):
            # Where blocks overlap, a notice belongs to the one in which it begins before the next.
            later = blocks[number + 1][0] if number + 1 < len(blocks) else first + len(block)
            skipped = max(0, over - first)
            block, places = block[skipped:], list(range(first + skipped, first + len(block)))
            while block:
                confirmed = []
                for share, k in self.saved(block):
                    for missing, between, a, b in self.places(block, k, self.s.most_different * len(self.words[k])):
                        confirmed.append((missing + between, -len(self.words[k]), k, a, b, share, missing, between))
                if not confirmed:
                    break
                taken = np.zeros(len(block), bool)
                for _, _, k, a, b, share, missing, between in sorted(confirmed):
                    if not taken[a:b].any():
                        taken[a:b] = True
                        name = self.s.templates[k][0]
                        if places[a] >= later:
                            continue
                        over = max(over, places[b - 1] + 1)
                        found[places[a], name] = {"license": name, "template": k, "word": places[a], "saved": round(share, 6), "missing": missing, "between": between}
                left = np.nonzero(~taken)[0]
                block, places = [block[i] for i in left], [places[i] for i in left]
        return len(blocks), [found[key] for key in sorted(found)]


FINDING = "struct<license:string,template:int,word:long,saved:double,missing:int,between:int>"


def scan(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_blocks, findings`` for each row of ``docs``."""

    def make():
        scanner = Scanner(s)

        def run(batch: pa.RecordBatch) -> dict:
            both = [scanner.findings(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_blocks": [n for n, _ in both], "findings": [f for _, f in both]}

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, f"doc_id long, n_blocks int, findings array<{FINDING}>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that all ``documents`` name."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_blocks", F.size("findings").alias("n_findings"), F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"]))), ",").alias("licenses"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE_SQL: dict[str, str] = {}
