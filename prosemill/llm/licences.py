"""Licence scans by canonical digest lookup.

A text is brought to one form (case, punctuation, white space, copyright lines,
equivalent spellings), and the SHA-256 of that form is joined to the digests of
known licences: entire texts first, and in the same way each line, so that a
one-line notice inside a document is found too.

All of it is DataFrame expressions in one scan of the texts; the table of known
digests has one row a licence text and is broadcast.  Nothing is shuffled: the
lines' digests are looked up in the row.

Defined results: a null, empty or punctuation-only text has the digest of the
empty form and no licence; repeated rows and rows without an id each get a row
of their own; a form that several licences share names the first in order; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings taken as equal, after punctuation has become spaces.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("https", "http"),
)

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted{}\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
    "{}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
    "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
    "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
    "all present and future rights to this software under copyright law.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
    "and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If "
    "you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n"
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
    "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following:\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
    "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works "
    "of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    "generated by a source language processor.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_FURNISHED = "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"

#: Long licences, a file each, read on the driver.
_FILES = tuple((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))

#: Licence id and text: whole licences, then the notices that name one.
KNOWN = (
    *_FILES,
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(_NAMES)),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD.format(_NAMES)),
    ("MIT", "MIT License\n" + _GRANT),
    ("MIT", _GRANT),
    ("MIT-0", _GRANT.replace(_FURNISHED + _NOTICE, "permit persons to whom the Software is furnished to do so.\n")),
    ("MIT-0", "MIT No Attribution\n" + _GRANT.replace(_FURNISHED + _NOTICE, "permit persons to whom the Software is furnished to do so.\n")),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies.")),
    ("0BSD", _ISC.format(".")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("reserved", "All rights reserved."),
)
#: A line that begins with a copyright word or sign and has a year, a second sign or a holder's address.
COPYRIGHT_LINE = (
    r"(?im)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*(?:\b(?:19|20)[0-9][0-9]\b|\(c\)|©|<[^>\n]*>|\[[^\]\n]*\])[^\n]*$"
)
#: Any known form has one of these, as any text of that form has; other lines need no digest.
MARK_WORDS = ("license", "licence", "spdx", "reserved", "permission", "permitted", "warranty", "public domain")
MARKS = "(?i)" + "|".join(MARK_WORDS)


def canonical(text: Column) -> Column:
    """The form in which texts are compared: ASCII words, one space around each."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "")
    form = F.concat(F.lit(" "), F.regexp_replace(F.lower(kept), r"[^a-z0-9]+", " "), F.lit(" "))
    form = F.replace(form, F.lit("  "), F.lit(" "))
    for a, b in EQUIVALENT:
        form = F.replace(form, F.lit(f" {a} "), F.lit(f" {b} "))
    return form


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``digest, licence`` of the known texts, a row a digest."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licences(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] = KNOWN
) -> DataFrame:
    """``doc_id, digest, licence, notices, n_notices`` of every row.

    ``licence``: that of the entire text, or null.  ``notices``: the licences
    that lines name, in order, joined by commas.
    """
    table = known_digests(docs.sparkSession, known)
    named = {r.digest: r.licence for r in table.collect()}  # a row a known text
    pairs = F.create_map(*[F.lit(x) for pair in named.items() for x in pair]) if named else F.create_map().cast("map<string,string>")
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(MARKS))
    found = F.filter(F.transform(lines, lambda x: F.element_at(pairs, digest(x))), lambda x: x.isNotNull())
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    return d.join(F.broadcast(table), "digest", "left").select(
        "doc_id", "digest", "licence", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices")
    )


def scan_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same scan as DuckDB SQL over ``documents``."""

    def form(text: str) -> str:
        kept = f"regexp_replace(coalesce({text}, ''), '{COPYRIGHT_LINE}', '', 'g')"
        out = f"replace(' ' || regexp_replace(lower({kept}), '[^a-z0-9]+', ' ', 'g') || ' ', '  ', ' ')"
        for a, b in EQUIVALENT:
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"sha256({out})"

    rows = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in known)
    return f"""
WITH known AS (SELECT {form("t")} AS digest, min(licence) AS licence FROM (VALUES {rows}) v(licence, t) GROUP BY 1),
numbered AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM numbered),
hits AS (SELECT row, licence, count(*) AS n FROM (SELECT row, {form("line")} AS digest FROM lines) JOIN known USING (digest)
         GROUP BY 1, 2),
found AS (SELECT row, string_agg(licence, ',' ORDER BY licence) AS notices, CAST(sum(n) AS BIGINT) AS n_notices
          FROM hits GROUP BY 1),
whole AS (SELECT doc_id, row, {form("text")} AS digest FROM numbered)
SELECT w.doc_id, w.digest, k.licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN found f ON f.row = w.row
"""
