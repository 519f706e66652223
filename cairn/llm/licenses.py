"""License scan by sentence rules.

Known licence sentences have identifiers. A text is read as a stream of
normalised words (lower case, letters and digits only) with marks where a line or
a sentence begins; wherever one begins, the known sentences with those first
words are compared, whatever line breaks lie inside them. A sentence is known only
whole: it must end where a sentence, a line or the text does ("MIT License plates"
is none). Sentences whose identifier is in ``CLAUSES`` may also end at a comma, a
bracket or a quote. A ``...`` in a known sentence stands for 1 to ``GAP`` words, such
as a holder's name. The longest known sentence at a place wins.

The identifiers found, in the order of the text, are matched against ordered licence
rules: a rule is a sequence of identifiers, longer rules are tried first, equally long
ones in their order in ``RULES``, and what one rule consumed no other takes.
Identifiers that no rule takes, and sentences that speak of a licence but are not
known, count as unknown.

The library of sentences and rules is a parameter; ``SENTENCES`` and ``RULES`` are the
usual one. It is part of the program and travels with it; nothing is shuffled. Null or
empty text: no sentence, category ``none``. Repeated rows give repeated results, null
ids stay null, an empty table gives an empty result, extra columns of any name are
ignored. Texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import batch, binary, only, slices

#: Words that a ``...`` in a known sentence stands for at most.
GAP = 12

_AS_IS = "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_DAMAGES = "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _under(*names: str) -> list[str]:
    """What is said of a work under a licence of these names."""
    lead = ("Released under the", "Released under", "Licensed under the", "Licensed under", "This work is licensed under the", "This work is licensed under", "This project is licensed under the", "This software is licensed under the", "This file is licensed under the", "This code is licensed under the", "Distributed under the", "Distributed under", "Available under the", "Published under the", "Code released under the", "under the terms of the", "License:", "License: the")
    return [f"{x} {n}." for n in names for x in lead]


def _spdx(*ids: str) -> list[str]:
    return [f"SPDX-License-Identifier: {x}" for x in ids]


def _gpl(kind: str, version: str, later: bool) -> list[str]:
    """Notices of the GNU family: "either version N" with a choice of later ones, or "version N" alone."""
    which = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    what = ("This program", "This software", "This library", "This file", "It")
    return [f"{w} is free software{c} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{d} {which}" for w in what for c in (":", ";") for d in (",", ";")][::4] + [f"{w} is free software: you can redistribute it and/or modify it under the terms of version {version} of the GNU {kind} as published by the Free Software Foundation." for w in what if not later]


#: Identifier -> sentences that stand for it.
SENTENCES = {
    "mit-name": ["MIT License", "The MIT License (MIT)", "The MIT License", "MIT Licence"],
    "mit-under": [*_under("MIT License", "MIT licence", "MIT"), *_spdx("MIT"), "MIT licensed."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-grant-free": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "as-is-software": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "no-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-name": ["ISC License", "The ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-under": [*_under("ISC License", "ISC"), *_spdx("ISC")],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", *_spdx("0BSD")],
    "author-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "apache2-name": ["Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "apache2-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache2-copyright-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "apache2-redistribute": ["You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:"],
    "apache2-under": [*_under("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache-2.0 license"), *_spdx("Apache-2.0")],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-limits": ["See the License for the specific language governing permissions and limitations under the License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by ..."],
    "bsd-as-is": [f"THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" {_AS_IS}", f"THIS SOFTWARE IS PROVIDED BY ... \"AS IS\" {_AS_IS}"],
    "bsd-damages": [f"IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS {_DAMAGES}", f"IN NO EVENT SHALL ... {_DAMAGES}"],
    "bsd3-under": [*_under("BSD 3-Clause License", "BSD 3-Clause", "3-Clause BSD License", "New BSD License", "BSD-3-Clause license", "modified BSD license"), *_spdx("BSD-3-Clause")],
    "bsd2-under": [*_under("BSD 2-Clause License", "BSD 2-Clause", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause license"), *_spdx("BSD-2-Clause")],
    "bsd-under": _under("BSD License", "a BSD-style license", "BSD"),
    "gpl3-name": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License, version 3", "GNU General Public License v3.0"],
    "gpl2-name": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU General Public License, version 2", "GNU General Public License v2.0"],
    "lgpl3-name": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-name": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3-name": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gpl-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "gpl3-under": [*_under("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL, version 3", "GNU GPL v3", "GPL-3.0 license", "GPLv3", "GPL v3", "GPL 3.0"), *_spdx("GPL-3.0-only", "GPL-3.0")],
    "gpl2-under": [*_under("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL, version 2", "GNU GPL v2", "GPL-2.0 license", "GPLv2", "GPL v2", "GPL, version 2", "GPL 2.0"), *_spdx("GPL-2.0-only", "GPL-2.0")],
    "gpl3-later": [*_gpl("General Public License", "3", True), *_spdx("GPL-3.0-or-later")],
    "gpl2-later": [*_gpl("General Public License", "2", True), *_spdx("GPL-2.0-or-later")],
    "gpl2-notice": _gpl("General Public License", "2", False),
    "gpl3-notice": _gpl("General Public License", "3", False),
    "lgpl3-later": [*_gpl("Lesser General Public License", "3", True), *_spdx("LGPL-3.0-or-later")],
    "lgpl21-later": [*_gpl("Lesser General Public License", "2.1", True), *_spdx("LGPL-2.1-or-later")],
    "agpl3-later": [*_gpl("Affero General Public License", "3", True), *_spdx("AGPL-3.0-or-later")],
    "gpl-hope": [f"This {w} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE." for w in ("program", "software", "library", "file")],
    "gpl-details": ["See the GNU General Public License for more details."],
    "lgpl-details": ["See the GNU Lesser General Public License for more details."],
    "agpl-details": ["See the GNU Affero General Public License for more details."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "lgpl3-under": [*_under("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0 license"), *_spdx("LGPL-3.0-only", "LGPL-3.0")],
    "lgpl21-under": [*_under("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1 license"), *_spdx("LGPL-2.1-only", "LGPL-2.1")],
    "agpl3-under": [*_under("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0 license"), *_spdx("AGPL-3.0-only", "AGPL-3.0")],
    "mpl2-name": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl2-under": [*_under("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"), *_spdx("MPL-2.0")],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "mpl2-grant": ["Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:"],
    "epl2-under": [*_under("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"), *_spdx("EPL-2.0"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "boost-name": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"],
    "boost-under": [*_under("Boost Software License, Version 1.0"), *_spdx("BSL-1.0")],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-under": [*_under("zlib License", "zlib/libpng license"), *_spdx("Zlib")],
    "cc-by": [*_under("CC BY 4.0", "CC-BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International License"), *_spdx("CC-BY-4.0")],
    "cc-by-sa": [*_under("CC BY-SA 4.0", "CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International License"), *_spdx("CC-BY-SA-4.0")],
    "cc-by-nc": [*_under("CC BY-NC 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International License"), *_spdx("CC-BY-NC-4.0")],
    "cc-by-nd": [*_under("CC BY-ND 4.0", "CC-BY-ND-4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"), *_spdx("CC-BY-ND-4.0")],
    "cc-by-nc-sa": [*_under("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), *_spdx("CC-BY-NC-SA-4.0")],
    "cc0": [*_under("CC0 1.0", "CC0", "CC0 1.0 Universal"), *_spdx("CC0-1.0"), "CC0 1.0 Universal"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", *_under("Unlicense"), *_spdx("Unlicense")],
}

#: Identifiers whose sentence may go on after a comma, a bracket or a quote.
CLAUSES = {n for n in SENTENCES if n.endswith(("-under", "-later", "-notice")) or n.startswith("cc")} | {"apache-comply", "apache-copy", "gpl-received", "mpl2-copy"}

_PERMISSIVE, _COPYLEFT = "permissive", "copyleft"
_MIT, _BSD = ("mit-grant", "mit-notice", "as-is-software", "no-liability"), ("bsd-grant", "bsd-source", "bsd-binary")
_APACHE = ("apache2-under", "apache-comply", "apache-copy", "apache-basis", "apache-limits")
_APACHE_TEXT = ("apache2-name", "apache2-terms", "apache2-copyright-grant", "apache2-redistribute")


def _beginnings(name: str, category: str, seq: tuple[str, ...], least: int) -> list[tuple[str, str, tuple[str, ...]]]:
    """Rules for a sequence and each of its beginnings of ``least`` identifiers or more."""
    return [(name, category, seq[:n]) for n in range(len(seq), least - 1, -1)]


#: (licence, category, identifiers in order); the longest rule that fits at a place wins, ties by this order.
RULES = [
    *_beginnings("MIT", _PERMISSIVE, ("mit-name", *_MIT), 1),
    *_beginnings("MIT", _PERMISSIVE, ("mit-under", *_MIT), 1),
    *_beginnings("MIT", _PERMISSIVE, _MIT, 1),
    *_beginnings("MIT-0", _PERMISSIVE, ("mit-grant-free", "as-is-software", "no-liability"), 1),
    *_beginnings("ISC", _PERMISSIVE, ("isc-name", "isc-grant", "author-as-is"), 1),
    *_beginnings("ISC", _PERMISSIVE, ("isc-grant", "author-as-is"), 1),
    ("ISC", _PERMISSIVE, ("isc-grant", "as-is-software")),
    *_beginnings("0BSD", _PERMISSIVE, ("0bsd-grant", "author-as-is"), 1),
    *_beginnings("BSD-4-Clause", _PERMISSIVE, (*_BSD, "bsd-advertising", "bsd-names", "bsd-as-is", "bsd-damages"), 4),
    *_beginnings("BSD-3-Clause", _PERMISSIVE, (*_BSD, "bsd-names", "bsd-as-is", "bsd-damages"), 4),
    ("BSD-2-Clause", _PERMISSIVE, (*_BSD, "bsd-as-is", "bsd-damages")),
    ("BSD-2-Clause", _PERMISSIVE, (*_BSD, "bsd-as-is")),
    ("BSD-2-Clause", _PERMISSIVE, _BSD),
    *_beginnings("Apache-2.0", _PERMISSIVE, _APACHE_TEXT, 1),
    *_beginnings("Apache-2.0", _PERMISSIVE, ("apache2-name", *_APACHE[1:]), 2),
    *_beginnings("Apache-2.0", _PERMISSIVE, _APACHE, 1),
    *_beginnings("Apache-2.0", _PERMISSIVE, ("apache2-copyright-grant", "apache2-redistribute"), 1),
    *[r for name, v, kind in (("GPL-3.0-or-later", "gpl3-later", "gpl"), ("GPL-2.0-or-later", "gpl2-later", "gpl"), ("GPL-3.0-only", "gpl3-notice", "gpl"), ("GPL-2.0-only", "gpl2-notice", "gpl"), ("LGPL-3.0-or-later", "lgpl3-later", "lgpl"), ("LGPL-2.1-or-later", "lgpl21-later", "lgpl"), ("AGPL-3.0-or-later", "agpl3-later", "agpl")) for r in [*_beginnings(name, _COPYLEFT, (v, "gpl-hope", f"{kind}-details", "gpl-received"), 1)]],
    *_beginnings("GPL-3.0-only", _COPYLEFT, ("gpl3-name", "gpl-verbatim", "gpl3-preamble"), 1),
    *_beginnings("GPL-2.0-only", _COPYLEFT, ("gpl2-name", "gpl-verbatim", "gpl2-preamble"), 1),
    *_beginnings("LGPL-3.0-only", _COPYLEFT, ("lgpl3-name", "gpl-verbatim"), 1),
    *_beginnings("LGPL-2.1-only", _COPYLEFT, ("lgpl21-name", "gpl-verbatim"), 1),
    *_beginnings("AGPL-3.0-only", _COPYLEFT, ("agpl3-name", "gpl-verbatim"), 1),
    ("GPL", _COPYLEFT, ("gpl-hope", "gpl-details")),
    ("GPL", _COPYLEFT, ("gpl-details",)),
    ("GPL", _COPYLEFT, ("gpl-received",)),
    ("LGPL", _COPYLEFT, ("gpl-hope", "lgpl-details")),
    ("LGPL", _COPYLEFT, ("lgpl-details",)),
    ("AGPL", _COPYLEFT, ("gpl-hope", "agpl-details")),
    ("AGPL", _COPYLEFT, ("agpl-details",)),
    ("MPL-2.0", _COPYLEFT, ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", _COPYLEFT, ("mpl2-form",)),
    *_beginnings("MPL-2.0", _COPYLEFT, ("mpl2-name", "mpl2-grant"), 1),
    ("MPL-2.0", _COPYLEFT, ("mpl2-copy",)),
    *_beginnings("BSL-1.0", _PERMISSIVE, ("boost-name", "boost-grant"), 1),
    ("BSL-1.0", _PERMISSIVE, ("boost-grant",)),
    *_beginnings("Zlib", _PERMISSIVE, ("zlib-as-is", "zlib-grant"), 2),
    ("Zlib", _PERMISSIVE, ("zlib-grant",)),
    *[(name, category, (f"{i}-under",)) for i, name, category in (("isc", "ISC", _PERMISSIVE), ("bsd3", "BSD-3-Clause", _PERMISSIVE), ("bsd2", "BSD-2-Clause", _PERMISSIVE), ("bsd", "BSD", _PERMISSIVE), ("boost", "BSL-1.0", _PERMISSIVE), ("zlib", "Zlib", _PERMISSIVE), ("gpl3", "GPL-3.0-only", _COPYLEFT), ("gpl2", "GPL-2.0-only", _COPYLEFT), ("lgpl3", "LGPL-3.0-only", _COPYLEFT), ("lgpl21", "LGPL-2.1-only", _COPYLEFT), ("agpl3", "AGPL-3.0-only", _COPYLEFT), ("mpl2", "MPL-2.0", _COPYLEFT), ("epl2", "EPL-2.0", _COPYLEFT))],
    ("CC-BY-4.0", _PERMISSIVE, ("cc-by",)),
    ("CC-BY-SA-4.0", _COPYLEFT, ("cc-by-sa",)),
    ("CC-BY-ND-4.0", "noderivatives", ("cc-by-nd",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc",)),
    ("CC-BY-NC-SA-4.0", "noncommercial", ("cc-by-nc-sa",)),
    ("CC0-1.0", "public-domain", ("cc0",)),
    ("Unlicense", "public-domain", ("unlicense",)),
]

_WORD = re.compile(r"[a-z0-9]+")
#: A text without any of these words and phrases holds no known sentence and none that speaks of a licence. A phrase is looked for only where its first word is.
_TRIGGERS = (b"license", b"licence", b"permission", b"software", b"redistribut", b"cc0", b"compliance", b"advertising materials")
_PHRASES = [(p.split(b" ")[0], re.compile(p.replace(b" ", b"[^a-z0-9]+"))) for p in (b"copy of the", b"distributed in the hope", b"released under", b"distributed under", b"available under", b"published under", b"under the terms", b"terms and conditions", b"copyright holder", b"each contributor", b"reproduce and distribute", b"in no event")]


def triggers(text: bytes) -> bool:
    low = text.lower()
    return any(w in low for w in _TRIGGERS) or any(w in low and p.search(low) for w, p in _PHRASES)


_SPEAKS = re.compile(r"licensed under|released under the|license identifier|licensed for|under the terms of")
#: A sentence begins at a line's first word, or after one of these and white space; one ends before the same.
_BOUNDARY = re.compile(r"[\n.!?:;]")
_CLAUSE_END = re.compile(r"[\n.!?:;,()\[\]\"'<>|*]")


def normalise(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Library:
    """Sentences by their first two words, and rules by falling length."""

    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules=RULES, clauses: set[str] = CLAUSES):
        self.by_start: dict[tuple[str, ...], list[tuple[list[list[str]], str]]] = defaultdict(list)
        self.ends = {n: _CLAUSE_END if n in clauses else _BOUNDARY for n in sentences}
        for name, forms in sentences.items():
            for f in forms:
                if not triggers(f.encode()):
                    raise ValueError(f"no trigger word in {f!r}")
                parts = [normalise(p) for p in f.split("...")]
                if len(parts) > 1 and not parts[-1]:  # the gap is the end: what follows is free
                    parts.pop()
                self.by_start[tuple(parts[0][:2])].append((parts, name))
        for forms in self.by_start.values():
            forms.sort(key=lambda x: (-sum(map(len, x[0])), x[1]))
        self.rules = sorted(rules, key=lambda r: -len(r[2]))

    @staticmethod
    def _match(words: list[str], i: int, parts: list[list[str]]) -> int:
        """Where the sentence that begins at word ``i`` ends, or -1."""
        if words[i : i + len(parts[0])] != parts[0]:
            return -1
        i += len(parts[0])
        for p in parts[1:]:
            for skip in range(1, GAP + 1):
                if words[i + skip : i + skip + len(p)] == p:
                    i += skip + len(p)
                    break
            else:
                return -1
        return i

    def identifiers(self, text: str) -> tuple[list[str], int]:
        """Known sentences in order of the text, and the number of unknown ones that speak of a licence."""
        low = text.lower()
        spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        found, unknown, upto = [], 0, 0
        starts = [i for i in range(len(words)) if i == 0 or _BOUNDARY.search(low, spans[i - 1][1], spans[i][0])]
        for n, i in enumerate(starts):
            if i < upto:
                continue
            for parts, name in self.by_start.get(tuple(words[i : i + 2]), ()):
                e = self._match(words, i, parts)
                if e > 0 and (e == len(words) or self.ends[name].search(low, spans[e - 1][1], spans[e][0])):
                    found.append(name)
                    upto = e
                    break
            else:
                end = starts[n + 1] if n + 1 < len(starts) else len(words)
                unknown += bool(_SPEAKS.search(" ".join(words[i:end])))
        return found, unknown

    def licences(self, ids: list[str]) -> tuple[list[tuple[str, str]], int]:
        """(licence, category) of the rules that the identifiers match, in order, and how many identifiers none took."""
        out, i, loose = [], 0, 0
        while i < len(ids):
            for name, category, seq in self.rules:
                if tuple(ids[i : i + len(seq)]) == seq:
                    out.append((name, category))
                    i += len(seq)
                    break
            else:
                loose += 1
                i += 1
        return out, loose


_OUT = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_unknown", pa.int64()), ("sentence_ids", pa.string()), ("licenses", pa.string()), ("category", pa.string())])
#: The most restrictive first.
_RANK = ["noncommercial", "noderivatives", "copyleft", "permissive", "public-domain"]


def scan(text: bytes, lib: Library) -> tuple[int, int, str, str, str]:
    if not triggers(text):
        return 0, 0, "", "", "none"
    ids, unknown = lib.identifiers(text.decode("utf-8", "replace"))
    found, loose = lib.licences(ids)
    unknown += loose
    category = min((c for _, c in found), key=_RANK.index, default="unknown" if unknown else "none")
    return len(ids), unknown, ",".join(ids), ",".join(sorted({n for n, _ in found})), category


def _scan(batches):
    lib = Library()
    for rb in batches:
        ids, text = rb.column(0), binary(rb.column(1))
        for a, b in slices(text):
            rows = [scan(t or b"", lib) for t in text.slice(a, b - a).to_pylist()]
            yield batch(_OUT, [ids.slice(a, b - a), *zip(*rows)])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences known, n_unknown, sentence_ids in order, licenses (sorted names), category (the most restrictive of ``_RANK``; unknown; none)."""
    return only(docs, "doc_id", "text").mapInArrow(_scan, "doc_id long, n_sentences long, n_unknown long, sentence_ids string, licenses string, category string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
