"""License scans [native]: canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, punctuation and white space, then equivalent spellings are
evened out, so that a spelling of two words is known across a line's end too), digested with SHA-256, and hash-joined as a whole to the digests of known licence texts. Everything is a
built-in column function; the built-in known side is a constant of some dozen digests, so it is broadcast and nothing shuffles.
A caller may add a table of known texts of any size; it is counted before it is broadcast.

Results for odd input: a null text has a null digest and no licence; an empty text (or one of punctuation and copyright
lines only) has the digest of the empty string, which no licence has; repeated rows each get their own result row; an
empty table gives no rows; further columns of the input are ignored. Texts are used whole, however long they are.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import durable, sized_join

#: Texts of short well-known licences (long ones are files of ``TEXTS``, named by licence), and short notices that name one.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]

TEXTS = Path(__file__).parent / "license_texts"

#: Parts of a long text by which it is also known: its terms without the appendix, a Creative Commons licence without the notes around it.
PARTS = [r"(?s)^.*?END OF TERMS AND CONDITIONS", r"(?s)^.*?(?=\nEXHIBIT A -|\nExhibit A - )", r"(?s)\nCreative Commons Attribution[^\n]*4\.0 International Public\s+License\n.*?(?=\n=====)", r"(?s)\nCC0 1\.0 Universal\n.*$"]

#: Addresses of the Free Software Foundation that stand in copies of its licences, where the address is not left out.
ADDRESS = r"51 Franklin (?:Street|St), Fifth Floor, Boston, MA\s+02110-1301,?\s+USA"
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA"]

#: Title lines that may stand above a licence's text; a text counts with its title and without it.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License"]}

#: A line is dropped if, after marks, it begins as a copyright line: the word or sign with a year, name or sign after it.
COPYRIGHT_LINE = r"(?m)^[\t #*/;>-]*(?:portions )?(?:copyright[\t ]+(?:\(c\)|©|[0-9]|by )|copyright:|\(c\)|©|all rights reserved)[^\n]*$"

#: Spellings that count as one, as (parts, pattern, replacement), applied to words parted by single blanks; a pattern's words begin where
#: a word begins, and it has one meaning in Java's and RE2's syntax. Any text that a pattern matches contains one of its parts, which
#: are looked for first: a plain search is far cheaper than a pattern.
SPELLINGS = [
    (["sublicenc", "sub licenc"], r"(^| )sub ?licenc([aeio])", "$1sublicens$2"),
    (["licenc"], r"(^| )licenc([aeio])", "$1licens$2"),
    (["sub licens"], r"(^| )sub licens", "$1sublicens"),
    (["acknowledgement", "judgement"], r"(^| )(acknowledg|judg)ement", "$1$2ment"),
    (["favour", "honour", "colour", "labour", "behaviour"], r"(^| )(fav|hon|col|lab|behavi)our", "$1$2or"),
    (["authoris", "organis", "recognis", "utilis", "initialis", "capitalis", "realis", "specialis"], r"(^| )(author|organ|recogn|util|initial|capital|real|special)is(e|ing|ation)", "$1$2iz$3"),
    (["non infring", "non commercial", "non exclusive", "non transferable"], r"(^| )non (infring|commercial|exclusive|transferable)", "$1non$2"),
    (["copyright owner", "copyright proprietor"], r"(^| )copyright (owner|proprietor)", "$1copyright holder"),
    (["https"], r"(^| )https", "$1http"),
    (["centre", "fibre", "theatre"], r"(^| )(cent|fib|theat)re", "$1$2er"),
    (["catalogue", "analogue", "dialogue"], r"(^| )(catalog|analog|dialog)ue", "$1$2"),
    (["willful"], r"(^| )willful", "$1wilful"),
]


def _has_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named; nested plain expressions would multiply."""
    return F.transform(F.array(value), body)[0]


def canonical(text: Column) -> Column:
    """The form that is digested: lower case, no copyright lines, letters and digits parted by single blanks, one spelling."""

    def respelled(words: Column) -> Column:
        out = words
        for _, pattern, to in SPELLINGS:
            out = F.regexp_replace(out, pattern, to)
        return F.when(_has_any(words, [x for parts, _, _ in SPELLINGS for x in parts]), out).otherwise(words)

    low = _let(F.lower(text), lambda x: F.when(_has_any(x, ["copyright", "(c)", "©", "all rights reserved"]), F.regexp_replace(x, COPYRIGHT_LINE, " ")).otherwise(x))
    return _let(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), respelled)


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(license_digest, license_id): one row for each known text, with each title and without, and for those of ``more``; the smallest id on ties."""
    raw = spark.createDataFrame(_known_rows(), "license_id string, known string")
    if more is not None:
        raw = raw.unionByName(more.select("license_id", F.col("text").alias("known")))
    form = raw.select("license_id", canonical(F.col("known")).alias("form")).filter("form <> '' and license_id is not null")
    return form.groupBy(F.sha2("form", 256).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


@cache
def _long_texts() -> list[tuple[str, str]]:
    """The texts of the files and the parts by which they are known, with each address."""
    out = []
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        forms = [text, *(m[0] for p in PARTS if (m := re.search(p, text)))]
        out += [(file.stem, x) for f in forms for x in dict.fromkeys([f, *(re.sub(ADDRESS, a, f) for a in ADDRESSES)])]
    return out


def _known_rows() -> list[tuple[str, str]]:
    return [(name, f"{title}\n\n{text}" if title else text) for name, text in KNOWN for title in ["", *(TITLES.get(name, []) if len(text) > 200 else [])]] + _long_texts()


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """(id, digest, license_id): ``license_id`` is null unless the whole text is a known one: a built-in one or one of ``known`` (license_id, text)."""
    mine = docs.select(id_col, F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    digests = known_digests(docs.sparkSession, known)
    if known is None:
        found = mine.join(F.broadcast(digests), mine["digest"] == digests["license_digest"], "left")
    else:
        digests = durable(digests)
        found = sized_join(mine, digests, mine["digest"] == digests["license_digest"], "left")
    return found.select(id_col, "digest", "license_id")


def oracle_sql() -> str:
    """The same rows in DuckDB, straight from the definition: every spelling rule over every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"regexp_replace(lower({x}), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
        x = f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for _, pattern, to in SPELLINGS:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
        return f"sha256({x})"

    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in _known_rows())
    return f"""WITH known AS (SELECT {form("known")} AS license_digest, min(license_id) AS license_id FROM (VALUES {rows}) AS t(license_id, known) GROUP BY 1),
mine AS (SELECT doc_id, {form("text")} AS digest FROM documents)
SELECT doc_id, digest, license_id FROM mine LEFT JOIN known ON digest = license_digest"""
