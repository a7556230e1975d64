"""Licence scans by canonical digest: texts that differ only in form share a digest, and digests are joined."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching guidelines take as equal.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "organisation": "organization",
    "organisations": "organizations",
    "authorisation": "authorization",
    "authorised": "authorized",
    "favour": "favor",
    "favourable": "favorable",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "sub license": "sublicense",
    "wilful": "willful",
    "whilst": "while",
    "http": "https",
}

#: Texts of short licences and the standard notices of long ones.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.""",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
}

#: A line that only claims copyright, with the break before it. RE2 and Java read it alike.
CLAIM = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*"
#: ASCII punctuation, controls and blanks but line breaks, and typographic quotes, dashes and signs.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’“”–—…•©®™]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Licence tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Whole texts of long licences, a file for each; their names are the licences'.
CATALOGUE = Path(__file__).parent / "catalogue"

_CLAIM = re.compile(CLAIM.encode())
_HINTS = (b"copyright", b"(c)", "©".encode(), b"all rights reserved")
_ASCII_MARKS = bytes(c if c == 10 or 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))
_WIDE_MARKS = [c.encode() for c in "‘’“”–—…•©®™"]
_WORDS = {old.encode(): new.encode() for old, new in SPELLINGS.items() if " " not in old}
_PAIRS = {tuple(old.encode().split()): new.encode() for old, new in SPELLINGS.items() if " " in old}


def canonical_lines(text: str) -> list[list[bytes]]:
    """The canonical words of every line of a whole text.

    Lower-case ASCII, no lines of copyright claims (they become empty), marks as blanks, one spelling
    for each of ``SPELLINGS``; pairs of words are told after single words.
    """
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(h in raw for h in _HINTS):
        raw = _CLAIM.sub(b"\n", raw)
    if not raw.isascii():
        for mark in _WIDE_MARKS:
            raw = raw.replace(mark, b" ")
    lines = [[_WORDS.get(w, w) for w in line.split()] for line in raw.translate(_ASCII_MARKS).split(b"\n")]
    return [_joined(line) for line in lines]


def _joined(words: list[bytes]) -> list[bytes]:
    if not any((a, b) in _PAIRS for a, b in zip(words, words[1:])):
        return words
    out, k = [], 0
    while k < len(words):
        pair = _PAIRS.get(tuple(words[k : k + 2]))
        out += [words[k]] if pair is None else pair.split()
        k += 1 if pair is None else 2
    return out


def digest(words: list[bytes]) -> str | None:
    """SHA-256 of canonical words with single blanks; null where no word is left."""
    return hashlib.sha256(b" ".join(words)).hexdigest() if words else None


def whole_digest(text: str) -> str | None:
    return digest([w for line in canonical_lines(text) for w in line])


def catalogue() -> dict[str, str]:
    """All known texts: the short ones here, and the files of long ones."""
    return LICENSES | {f.stem: f.read_text() for f in sorted(CATALOGUE.glob("*.txt"))}


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``license_id, digest`` of the given texts, or of the catalogue."""
    rows = [(k, whole_digest(v)) for k, v in (catalogue() if texts is None else texts).items()]
    return spark.createDataFrame([r for r in rows if r[1]], "license_id string, digest string")


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line, digest, license_id``: every text, and every line that is a licence by itself.

    Each row of ``docs`` gives a row with line -1, the digest of its whole text, however long, and the
    licence with that digest (null for none). A line of a text, counted from 0 after claim lines are
    emptied, is looked up the same way and gives a row where it is known. ``licenses(license_id,
    digest)`` has one row per digest or more; then the smallest id counts. Null, empty and wordless
    texts have a null digest and match nothing. Repeated rows repeat, an empty table gives no rows,
    and other columns, whatever their names, are ignored.
    """
    known = licenses.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                row, line, digests = [], [], []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    lines = [] if text is None else canonical_lines(text)
                    each = [digest([w for words in lines for w in words]), *map(digest, lines)]
                    kept = [n for n, d in enumerate(each) if d or not n]
                    row += [at] * len(kept)
                    line += [n - 1 for n in kept]
                    digests += [each[n] for n in kept]
                ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(line, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "line", "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    each = rows.mapInArrow(run, f"doc_id {kind}, line long, digest string")
    return each.join(known, "digest", "left").where("line = -1 or license_id is not null").select("doc_id", "line", "digest", "license_id")


def canonical_sql(text: str) -> str:
    """``canonical_lines`` as DuckDB SQL: words have one blank on either side."""
    out = f"translate({text}, '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '{CLAIM}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{MARKS}', ' ', 'g')"
    out = f"' ' || replace(replace({out}, chr(10), ' ' || chr(10) || ' '), ' ', '  ') || ' '"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, '{f' {old} '.replace(' ', '  ')[1:-1]}', '{f' {new} '.replace(' ', '  ')[1:-1]}')"
    return out


def digest_sql(canonical: str) -> str:
    words = f"trim(regexp_replace({canonical}, '[ \\n]+', ' ', 'g'))"
    return f"case when {words} <> '' then sha256({words}) end"


def scan_sql() -> str:
    texts = {k: v.replace("'", "''").replace("\n", "¶") for k, v in catalogue().items()}
    quoted = ", ".join(f"('{k}', replace('{v}', '¶', chr(10)))" for k, v in texts.items())
    return f"""
with known as (
  select digest, min(license_id) as license_id
  from (select license_id, {digest_sql("c")} as digest
        from (select license_id, {canonical_sql("text")} as c from (values {quoted}) v(license_id, text)))
  where digest is not null group by digest),
canonical as (select doc_id, {canonical_sql("text")} as c from documents),
lines as (
  select doc_id, unnest(string_split(c, chr(10))) as c, unnest(range(len(string_split(c, chr(10))))) as line from canonical),
units as (
  select doc_id, -1 as line, {digest_sql("c")} as digest from canonical
  union all select doc_id, line, {digest_sql("c")} from lines)
select doc_id, cast(line as bigint) as line, units.digest, license_id
from units left join known on units.digest = known.digest
where line = -1 or license_id is not null"""
