"""License scans: sparse TF-IDF cosine of licence headers and licence files to templates, then inheritance by directory.

Templates are whole licence texts, whole headers and short statements. A file is a licence file if its whole text is close to one,
and has that licence. Else its headers are compared: runs of neighbouring lines that name licensing, as a whole and, where that is
like no template, by paragraph and by line; "all rights reserved" counts only where no other header does. A file without a header of its own takes the licence of the licence file in its nearest ancestor directory, found by
joining the file's ancestors with the directories of licence files.

Weights are 1 + ln(count) times ln((N + 1) / (df + 1)) + 1, with document frequencies over all files for the words of the
templates; any other word weighs as much as a word of no file, so foreign words make a line unlike every template.

Defined cases: null text is empty and has no licence; null paths have no directory and inherit nothing; ties between templates go to
the smaller name, ties between licence files of a directory to the better score, then the smaller id; rows may repeat; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, sub_batches, word_hashes, word_spans

# Names that statements use for a licence.
ALIASES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0", "Apache-2.0"),
    "MIT": ("MIT",),
    "ISC": ("ISC",),
    "BSD-2-Clause": ("BSD 2-Clause", "2-clause BSD", "Simplified BSD"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-clause BSD", "New BSD"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0", "MPL-2.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero 1.0", "CC0-1.0"),
}
STATEMENTS = ("Licensed under the {}.", "Licensed under the {} license.", "Released under the {} License.", "This work is licensed under the {}.", "This file is licensed under the {} license.", "This project is distributed under the terms of the {} license.", "SPDX-License-Identifier: {}")
# Words that tell licences of like wording apart: they weigh BOOST times as much, and a header without a template's telling words is not that template.
TELLING = frozenset("0 1 2 3 4 v2 v3 apache mit isc bsd simplified new gpl gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 lesser library affero mozilla mpl cc cc0 zero by sa nc sharealike noncommercial".split())
BOOST = 3
_GNU = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of version {1} of the GNU {0} License as published by the Free Software Foundation.",
)
_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details."
_COPY = (
    " You should have received a copy of the GNU {0} License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    " You should have received a copy of the GNU {0} License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)


def licence_texts() -> dict[str, str]:
    """Whole texts, by name. AGPL-3.0 is GPL-3.0 with its own name and section 13; of the Creative Commons licences only CC0 has a whole text."""
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")}
    gpl = texts["GPL-3.0"]
    lo, hi = gpl.index("  13. Use with the GNU Affero"), gpl.index("  14. Revised Versions")
    named = re.sub(r"GNU General Public License", "GNU Affero General Public License", gpl[:lo] + _REMOTE + gpl[hi:])
    return texts | {"AGPL-3.0": re.sub(r"GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", named)}


_REMOTE = """  13. Remote Network Interaction; Use with the GNU General Public License.

  Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all
users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive
the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge.

"""


def default_templates() -> list[tuple[str, str, bool]]:
    """(licence, text, whether it must hold the telling words): whole texts, what they grant, whole headers and short statements."""
    whole = sorted(licence_texts().items())
    out = [(k, t, False) for k, t in whole]
    out += [(k, p, False) for k, t in whole if k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") for p in t.split("\n\n") if re.match("Permission|Redistribution", p)]
    out += [(k, s.format(a), True) for k, names in ALIASES.items() for a in names for s in STATEMENTS]
    for k, name, version in (("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"), ("LGPL-2.1", "Lesser General Public", "2.1"), ("LGPL-3.0", "Lesser General Public", "3"), ("AGPL-3.0", "Affero General Public", "3")):
        ends = ["", _NO_WARRANTY, *(_NO_WARRANTY + c for c in _COPY)]
        texts = [(g + e).format(name, version) for g in _GNU for e in ends]
        out += [(k, t, True) for t in texts] + [(k, t.replace("This program", "This library").replace("this program", "this library"), True) for t in texts]
    out += [("Apache-2.0", _APACHE[0], True), ("Apache-2.0", "".join(_APACHE), True)]
    out.append(("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", True))
    out += [("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", True)]
    return [*out, (RESERVED, "All rights reserved.", True)]


RESERVED = "Proprietary"
NAMES_LICENSING = re.compile(r"licen[cs]|rights\s+reserved|permission\s+(?:is|to)|redistribut|warrant|\bliab(?:le|ility)\b|general\s+public|creative\s+commons|\bcc[ -]by|\bcc0", re.I)
GAP, REACH = 5, 12  # lines that name licensing and lie at most so far apart are one header; it may reach so many lines further in its paragraph
TOKEN = re.compile(r"[a-z0-9]+")
# On 94 licence files of this system: texts of the templates reach 0.70 or more, texts like none of them 0.58 at most; versions without a
# template (GPL-1, GFDL-1.2) go to the nearest version.
HEADER_COSINE, FILE_COSINE = 0.65, 0.6

_FOLD = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (97, 123)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi)
_FOLD[65:91] = np.arange(97, 123)


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many files each word of the templates occurs, and how many files there are."""
    raw = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    keys = word_hashes(raw, starts, ends)
    order = np.argsort(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows_seen = np.zeros(len(keys), np.int64), 0
        for b, raw, bounds in sub_batches(batches, "text"):
            raw = _FOLD[raw]
            starts, ends, first = word_spans(raw, bounds)
            h = word_hashes(raw, starts, ends)
            at = np.minimum(np.searchsorted(keys[order], h), len(keys) - 1)
            hit = np.flatnonzero(keys[order][at] == h)
            row = np.searchsorted(first, hit, "right") - 1
            pairs = np.unique(row * len(keys) + order[at[hit]])
            total += np.bincount(pairs % len(keys), minlength=len(keys))
            rows_seen += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary, None]), pa.array([*total.tolist(), rows_seen])], ["word", "df"])

    got = {r["word"]: r["df"] for r in files.select("text").mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    n = got.pop(None, 0)
    return {w: got.get(w, 0) for w in vocabulary}, n


def vector(words: list[str], idf: dict[str, float], unknown: float) -> dict[str, float]:
    v = {w: (1 + log(c)) * idf.get(w, unknown) * (BOOST if w in TELLING else 1) for w, c in Counter(words).items()}
    size = sqrt(sum(x * x for x in v.values()))
    return {w: x / size for w, x in v.items()} if size else {}


class Matcher:
    """Cosines of texts to all templates, through lists of templates by word."""

    def __init__(self, templates: list[tuple[str, list[str], bool]], idf: dict[str, float], unknown: float) -> None:
        self.names = [k for k, _, _ in templates]
        self.header = [h for _, _, h in templates]
        self.needs = [TELLING & set(ws) if h else frozenset() for _, ws, h in templates]
        self.idf, self.unknown, self.by_word = idf, unknown, {}
        for i, (_, ws, _) in enumerate(templates):
            for w, x in vector(ws, idf, unknown).items():
                self.by_word.setdefault(w, []).append((i, x))
        self.seen: dict[str, tuple[str | None, float]] = {}

    def best(self, text: str) -> tuple[str | None, float]:
        """The nearest template's licence; of equal scores the smaller name."""
        if text in self.seen:
            return self.seen[text]
        v = vector(TOKEN.findall(text.lower()), self.idf, self.unknown)
        score = [0.0] * len(self.names)
        for w, x in v.items():
            for i, y in self.by_word.get(w, ()):
                score[i] += x * y
        near = min(((-round(s, 9), self.names[i]) for i, s in enumerate(score) if s > 0 and self.needs[i] <= v.keys()), default=(0.0, None))
        if len(text) < 2000 and len(self.seen) < 20_000:
            self.seen[text] = (near[1], -near[0])
        return near[1], -near[0]

    def header_of(self, text: str, least: float) -> tuple[str | None, float]:
        """The best header. A run of neighbouring lines counts as a whole; where it is like no template, its paragraphs do, then its lines."""
        lines = text.splitlines()
        at = [i for i, line in enumerate(lines) if NAMES_LICENSING.search(line)]
        cuts = [0, *(k for k in range(1, len(at)) if at[k] - at[k - 1] > GAP), len(at)]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            lo, hi = at[a], at[b - 1] + 1
            first, last = lo, hi
            while first > max(lo - REACH, 0) and TOKEN.search(lines[first - 1].lower()):
                first -= 1
            while last < min(hi + REACH, len(lines)) and TOKEN.search(lines[last].lower()):
                last += 1
            part = lines[first:last]
            paragraphs = "\n".join(line if TOKEN.search(line.lower()) else "" for line in part).split("\n\n")
            for step in (["\n".join(part)], ["\n".join(lines[lo:hi]), "\n".join(lines[lo:last]), "\n".join(lines[first:hi]), "\n".join(lines[max(lo - 1, 0) : hi + 1])], paragraphs, [lines[i] for i in at[a:b]]):
                near = [(k == RESERVED, -s, k) for k, s in map(self.best, step) if k and s >= least]
                if near:
                    found.append(min(near))
                    break
        return (min(found)[2], -min(found)[1]) if found else (None, 0.0)


def scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str, bool]] | None = None, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """(id, path, own_license, own_score, is_license_file, license, from_dir), one row for each row of files."""
    rows = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    words = [(k, TOKEN.findall(t.lower()), header) for k, t, header in templates or default_templates()]
    df, n = document_frequencies(rows, sorted({w for _, ws, _ in words for w in ws}))
    idf = {w: log((n + 1) / (c + 1)) + 1 for w, c in df.items()}
    unknown = log(n + 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(words, idf, unknown)
        for b in batches:
            own, score, whole = [], [], []
            for text in b.column(2).to_pylist():
                best, mine, is_file = None, 0.0, False
                if text and NAMES_LICENSING.search(text):
                    best, mine = match.best(text)
                    is_file = best is not None and mine >= file_cosine
                    if not is_file:
                        best, mine = match.header_of(text, header_cosine)
                own.append(best)
                score.append(mine)
                whole.append(is_file)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.bool_())], ["id", "path", "own_license", "own_score", "is_license_file"])

    found = settle(rows.mapInArrow(run, "id long, path string, own_license string, own_score double, is_license_file boolean").withColumn("row", F.monotonically_increasing_id()))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    granted = found.where("is_license_file AND path IS NOT NULL").groupBy(folder.alias("dir")).agg(F.min(F.struct(-F.col("own_score"), "id", "own_license")).alias("best")).select("dir", F.col("best.own_license").alias("granted"))
    # every ancestor directory of a file that has no licence of its own, the root ('') included
    up = found.where("own_license IS NULL AND path IS NOT NULL").select("row", folder.alias("folder")).select("row", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("folder", "/"))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("folder", "/"), 1, k), "/").alias("dir")))).alias("x")).select("row", "x.depth", "x.dir").distinct()
    nearest = up.join(granted, "dir").groupBy("row").agg(F.max(F.struct("depth", "dir", "granted")).alias("near"))
    out = found.join(nearest, "row", "left")
    return out.select("id", "path", "own_license", "own_score", "is_license_file", F.coalesce("own_license", "near.granted").alias("license"), F.col("near.dir").alias("from_dir"))
