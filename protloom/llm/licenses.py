"""Licence scans by canonical digests, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# Spellings that licence texts may exchange, each with the one kept.
SPELLINGS = (
    ("licence", "license"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"),
    ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("per cent", "percent"),
    ("programme", "program"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("http ", "https "),
)
# Whole texts and notices of known licences.
_MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _titled(name: str, text: str, *titles: str) -> list[tuple[str, str]]:
    """The text without a title and with each of the usual ones."""
    return [(name, text), *((name, f"{t}\n\n{text}") for t in titles)]


_MIT_BODY, _ISC_BODY = (t.split("\n\n", 1)[1] for t in (_MIT, _ISC))
_BSD2, _BSD3 = f"{_BSD_CONDITIONS}\n\n{_BSD_DISCLAIMER}", f"{_BSD_CONDITIONS}\n\n{_BSD_THIRD}\n\n{_BSD_DISCLAIMER}"
_0BSD_BODY = _ISC_BODY.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
KNOWN = (
    *_titled("MIT", _MIT_BODY, "MIT License", "The MIT License", "The MIT License (MIT)"),
    *_titled("ISC", _ISC_BODY, "ISC License", "The ISC License"),
    *_titled("0BSD", _0BSD_BODY, "BSD Zero Clause License", "Zero-Clause BSD"),
    *_titled("BSD-2-Clause", _BSD2, "BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    *_titled("BSD-3-Clause", _BSD3, "BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    *_titled("Zlib", _ZLIB, "zlib License", "The zlib/libpng License"),
    *_titled("Unlicense", _UNLICENSE, "The Unlicense"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MPL-2.0", _MPL_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    *((f"GPL-{v}", f"This work is licensed under the GNU General Public License, version {v}.") for v in ("2", "3")),
    *((f"CC-{k.replace(' ', '-')}-{v}", f"Licensed under CC {k} {v}.") for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")),
)


#: A copyright line; only \n ends lines, and \b is spelled out, as engines differ on both beyond ASCII.
_OTHER = "[^\\p{L}\\p{N}_\\n]"
COPYRIGHT = f"^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright(?:{_OTHER}[^\\n]*(?:\\(c\\)|©|[0-9]{{4}})|\\(c\\)|©)|copyright by(?:{_OTHER}|$)|\\(c\\)|©|all rights reserved)[^\\n]*$"


def canonical_lines(text: Column) -> Column:
    """The lines of a text, each normalised: copyright lines (with a year, a mark or `by`, so that a sentence's line isn't one) empty, A-Z in lower case, punctuation to single spaces, one spelling."""
    t = ascii_lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, f"(?md){COPYRIGHT}", "")
    t = F.regexp_replace(t, "[^\\p{L}\\p{N}\\n]+", " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.filter(F.transform(F.split(t, "\\n"), lambda x: F.trim(x)), lambda x: x != "")


def texts_in(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of a folder of licence texts, each file one text, named by the file: `more` for known()."""
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"(?i)\.(txt|md)$", "")
    return spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def known(spark: SparkSession, licenses=KNOWN, more: DataFrame | None = None) -> DataFrame:
    """(license, digest) of the canonical forms of known texts, and of those of more(license, text)."""
    table = spark.createDataFrame([(k, v) for k, v in licenses], "license string, text string")
    table = table if more is None else table.unionByName(more.select("license", "text"))
    return table.select("license", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def scan(docs: DataFrame, licenses: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but text, with digest, whole_license, licenses and n_notices.

    digest: of the whole canonical text (null and blank texts: of the empty one). whole_license: the known licence whose
    canonical text is exactly this one. licenses: distinct known licences, sorted, joined by commas, that the whole text
    or one of its lines equals in canonical form; n_notices counts those lines. Nulls in whole_license and licenses where
    nothing matches. Repeated rows stay; an empty table gives an empty result; the four columns replace same-named ones.

    licenses(license, digest) is a list of known texts and is broadcast up to 100,000 rows.
    """
    lookup = F.broadcast(licenses) if licenses.limit(100_001).count() <= 100_000 else licenses
    kept = [c for c in docs.columns if c not in (text, "digest", "whole_license", "licenses", "n_notices")]
    lines = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(c) for c in kept]).alias("__kept"), canonical_lines(F.col(text)).alias("__lines"))
    whole = lambda x: F.struct(F.lit(True).alias("whole"), x.alias("digest"))
    line = lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest"))
    all_of = lines.select("__row", "__kept", digest(F.array_join("__lines", " ")).alias("__digest"), F.transform("__lines", line).alias("__each"))
    long = all_of.select("__row", "__kept", "__digest", F.explode(F.concat(F.array(whole(F.col("__digest"))), F.col("__each"))).alias("e"))
    hits = long.select("__row", "__kept", "__digest", "e.whole", "e.digest").join(lookup, "digest", "left").where("whole or license is not null")
    out = hits.groupBy("__row").agg(F.first("__kept").alias("k"), F.first("__digest").alias("digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.count(F.when(~F.col("whole"), 1)).alias("n_notices"))
    return out.select(*[F.col("k").getField(c).alias(c) for c in kept], "digest", "whole_license", F.when(F.col("licenses") != "", F.col("licenses")).alias("licenses"), "n_notices")


def scan_sql() -> str:
    """scan() of documents with known() texts, in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(c: str) -> str:
        t = f"regexp_replace(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m){COPYRIGHT}', '', 'g')"
        t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        for old, new in SPELLINGS:
            t = f"replace({t}, {quoted(old)}, {quoted(new)})"
        return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN)
    return f"""WITH t(license, text) AS (VALUES {values}),
k AS (SELECT sha256(array_to_string({lines('text')}, ' ')) AS digest, min(license) AS license FROM t GROUP BY 1),
d AS (SELECT row_number() OVER () AS n, doc_id, {lines('text')} AS ls FROM documents),
w AS (SELECT n, doc_id, ls, sha256(array_to_string(ls, ' ')) AS digest FROM d),
e AS (SELECT n, true AS whole, digest FROM w UNION ALL SELECT n, false, sha256(x) FROM (SELECT n, unnest(ls) AS x FROM w)),
h AS (SELECT n, whole, license FROM e JOIN k ON e.digest = k.digest)
SELECT doc_id, digest, max(CASE WHEN whole THEN license END) AS whole_license, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(CASE WHEN NOT whole THEN 1 END) AS n_notices
FROM w LEFT JOIN h ON w.n = h.n GROUP BY w.n, doc_id, digest"""
