"""License scans by conditional compression: how much smaller a block gets when a license text is the dictionary."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Well-known license texts and notices: fixed values.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
    "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
    "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)


def _gpl(kind: str, name: str, version: str, mark: str) -> str:
    return f"This {kind} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{',' if version.startswith('3') else ';'} either version {version} of the License, or (at your option) any later version."


_GPL_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_GPLS = (
    ("GPL-2.0", "program", "General Public License", "2", ";"),
    ("GPL-3.0", "program", "General Public License", "3", ":"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1", ";"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3", ":"),
    ("AGPL-3.0", "program", "Affero General Public License", "3", ":"),
)
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"))
_NAMES = (
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License")),
    ("MIT", ("the MIT License", "the terms of the MIT License")),
    ("ISC", ("the ISC License",)),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the 2-Clause BSD License")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the 3-Clause BSD License")),
    ("MPL-2.0", ("the Mozilla Public License 2.0",)),
    ("Zlib", ("the zlib License",)),
    ("BSL-1.0", ("the Boost Software License, Version 1.0",)),
    *((i, (f"the GNU {n}, version {v}", f"the GNU {n} v{v}", f"the GNU {s} v{v}")) for i, _, n, v, _ in _GPLS for s in [i.split("-")[0]]),
    *((f"CC-{k}-4.0", (f"CC {k} 4.0", f"a Creative Commons {n} 4.0 International License")) for k, n in _CC),
)
TEMPLATES = (
    ("MIT", f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}"),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_WARRANTY),
    ("ISC", f"{_ISC} {_ISC_WARRANTY}"),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD + _BSD_SOURCE + _BSD_BINARY + _BSD_WARRANTY),
    ("BSD-2-Clause", (_BSD + _BSD_SOURCE + _BSD_BINARY).strip()),
    ("BSD-2-Clause", _BSD.strip()),
    ("BSD-3-Clause", _BSD + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", (_BSD + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES).strip()),
    ("BSD-3-Clause", _BSD_NAMES.strip()),
    ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("Apache-2.0", _APACHE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", f"{_BOOST} {_MIT_WARRANTY.replace('NONINFRINGEMENT', 'TITLE AND NON-INFRINGEMENT')}"),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE.partition(". ")[0] + "."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
    *((i, _gpl(*x)) for i, *x in _GPLS),
    *((i, f"{_gpl(kind, name, v, mark)} This {kind} {_GPL_WARRANTY.format(name)}") for i, kind, name, v, mark in _GPLS),
    *((i, frame.format(n)) for i, names in _NAMES for n in names for frame in ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "This work is licensed under {}.")),
    *((i, f"SPDX-License-Identifier: {i}{more}") for i, _ in (*_NAMES, ("CC0-1.0", ()), ("Unlicense", ())) for more in (("", "-only", "-or-later") if "GPL" in i else ("",))),
)
#: Every template holds one of these, perhaps across a line end; a text without any is not looked at further.
ANCHOR = r"licen[sc]e|all\W+rights\W+reserved|all\W+copyright|permission\W+(?:is|to)|redistribution\W+and\W+use|prior\W+written\W+permission|free\W+software|unencumbered|without\W+(?:any\W+)?(?:express|warranty)|under\W+(?:cc\W|a\W+creative\W+commons|the\W+gnu\W)"
#: Least share of a template's words that a window has in order, and most words between them, as a share of it.
LEAST_WORDS, SLACK = 0.9, 0.25
#: Words before a notice, in its sentence, that may deny it.
BEFORE = 4
NEGATIONS = frozenset("not never no neither nor without cannot isn't wasn't aren't weren't can't don't doesn't didn't won't hasn't haven't unless".split())
_ANCHOR = re.compile(ANCHOR, re.IGNORECASE | re.ASCII)  # as the JVM reads it
_WORD = re.compile(r"\w+(?:['.-]\w+)*")
_STOP = re.compile(r"[.!?;:]\s|\n\s*\n")
FOUND = "array<struct<license:string,template:int,reduction:double,missing:int,added:int>>"
_NAMED = frozenset("nc sa nd by-nc by-sa by-nd by-nc-sa lesser affero noncommercial sharealike noderivatives attribution-noncommercial attribution-sharealike attribution-noderivatives".split())


class Scanner:
    """The templates as zstandard raw dictionaries."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        self.words = [[w for w, _, _ in words_of(t)] for _, t in templates]
        self.wanted = [Counter(w) for w in self.words]
        self.anchors = [anchors_of(t, words_of(t)) for _, t in templates]
        frame = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        parameters = zstandard.ZstdCompressionParameters.from_level(19, **frame)
        raw = [zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for w in self.words]
        self.plain = zstandard.ZstdCompressor(compression_params=parameters)
        self.given = [zstandard.ZstdCompressor(dict_data=d, compression_params=parameters) for d in raw]
        self.gain = [max(1, self.saved(k, w)) for k, w in enumerate(self.words)]

    def saved(self, k: int, window: list[str]) -> int:
        """Bytes by which a window's words get smaller with template k as the dictionary."""
        data = " ".join(window).encode()
        return len(self.plain.compress(data)) - len(self.given[k].compress(data))

    def candidates(self, words: list[str], anchors: list[int]) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of the windows in which an anchor of the text stands where the template has one.

        Left out are only windows that lack too many of the template's words to be confirmed.
        """
        held = set(words)
        for k, template in enumerate(self.words):
            n = len(template)
            if sum(w in held for w in template) < LEAST_WORDS * n:
                continue
            slack = int(SLACK * n) + 2
            for at in sorted({a - b for a in anchors for b in self.anchors[k]}):
                lo, hi = max(0, at - slack), max(0, at) + n + slack
                if (self.wanted[k] & Counter(words[lo:hi])).total() >= LEAST_WORDS * n:
                    yield k, lo, min(hi, len(words))

    def scan(self, text: str) -> list[tuple]:
        """(license, template, reduction, missing, added) of the licenses that a text holds, most bytes saved first.

        Windows are ranked by the bytes that the template saves and then confirmed by their exact differences in wording.
        Of two licenses one of whose notices lies within the other's, the one that saves more holds. No saving is asked
        for as such: how well a short notice is compressed hangs on the words around it. `reduction` is a share of what
        the template saves on itself.
        """
        placed = words_of(text)
        words = [w for w, _, _ in placed]
        ranked = sorted(((self.saved(k, words[lo:hi]), k, lo, hi) for k, lo, hi in self.candidates(words, anchors_of(text, placed))), key=lambda x: (-x[0], x[1:]))
        best: dict[str, tuple] = {}
        taken: list[tuple[int, int, str]] = []
        for saved, k, lo, hi in ranked:
            missing, added, first, last = differences(self.words[k], words[lo:hi])
            if not confirmed(self.words[k], missing, added) or denied(text, placed, lo + first):
                continue
            a, b = lo + first, lo + last
            if any(x <= a and b <= y and name != self.names[k] for x, y, name in taken):
                continue
            taken.append((a, b, self.names[k]))
            best.setdefault(self.names[k], (self.names[k], k, saved / self.gain[k], len(missing), len(added)))
        return list(best.values())


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text's words, lower-cased."""
    return [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]


def anchors_of(text: str, placed: list[tuple[str, int, int]]) -> list[int]:
    """Numbers of the words in which an anchor begins."""
    ends = [b for _, _, b in placed]
    return [min(bisect_left(ends, m.start() + 1), len(ends) - 1) for m in _ANCHOR.finditer(text)]


def differences(template: list[str], window: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that the window lacks, words that it has between them, and its first and last word that is the template's."""
    same = [m for m in SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return template, [], 0, -1
    kept = {i for m in same for i in range(m.a, m.a + m.size)}
    inside = {j for m in same for j in range(m.b, m.b + m.size)}
    first, last = min(inside), max(inside)
    return [w for i, w in enumerate(template) if i not in kept], [window[j] for j in range(first, last + 1) if j not in inside], first, last


def confirmed(template: list[str], missing: list[str], added: list[str]) -> bool:
    """Whether differences leave it the same license: few, none between licenses, and no denial among them."""
    n = len(template)
    if len(missing) > (1 - LEAST_WORDS) * n + 1e-9 or len(added) > SLACK * n:
        return False
    numbered = any(re.search(r"\d", w) for w in template)
    telling = [w for w in missing if re.search(r"\d", w)] + [w for w in added if numbered and re.search(r"\d", w)] + [w for w in missing + added if w in _NAMED]
    return not telling and NEGATIONS.isdisjoint(added)


def denied(text: str, placed: list[tuple[str, int, int]], first: int) -> bool:
    """Whether the words just before a notice, in its own sentence, deny it."""
    lo = max(0, first - BEFORE)
    if lo == first:
        return False
    before = _STOP.split(text[placed[lo][1] : placed[first][1]])[-1]
    return not NEGATIONS.isdisjoint(w for w, _, _ in words_of(before))


_scanner: dict[tuple, Scanner] = {}


def scan(df: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """`df` with `licenses`: per license the best template, its size reduction, and words missing and added.

    Whole texts are searched, around every anchor, for templates of any length. Null and empty texts and those without
    an anchor have none, without leaving the JVM; repeated notices count once and repeated rows are treated alike; of
    templates that save as much, the first in order holds; a column named `licenses` is replaced, others pass through;
    an empty table gives an empty result. A text with an anchor takes some 30 times its size in memory.
    """
    if any(not _ANCHOR.search(t) for _, t in templates):
        raise ValueError("a template has no anchor, so its texts would be passed over")
    bounded_batches(df.sparkSession)

    def find(texts: pd.Series) -> pd.Series:
        if templates not in _scanner:
            _scanner[templates] = Scanner(templates)
        names = ("license", "template", "reduction", "missing", "added")
        return pd.Series([[dict(zip(names, x)) for x in _scanner[templates].scan(t)] if t else [] for t in texts], dtype=object)

    # Texts that cannot hold a license reach Python as nulls.
    held = F.when(F.col(text_col).rlike(f"(?i){ANCHOR}"), F.col(text_col))
    kept = [c for c in df.columns if c.lower() != "licenses"]
    return df.select(*kept, F.pandas_udf(find, FOUND)(held).alias("licenses"))
