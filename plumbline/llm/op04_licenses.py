"""Operator 4, license scans by canonical digest lookup.

A text's canonical form folds A-Z, drops lines that begin with a copyright notice, writes equivalent spellings one way and
turns every run of other ASCII than letters and digits into one space. Its SHA-256 is joined with the digests
of the known licences, made by the same expressions. The catalogue is a fixed list of some kilobytes (or a
given table), so the join may broadcast it once its size is known. Only whole texts match.

Null and empty texts have the digest of nothing and no licence; equal licences in a catalogue give the least
id; repeated rows are looked up each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOTICE = r"(^|\n)[ \t]*(copyright|all rights reserved|\(c\))[^\n]*"
#: Equivalent spellings, as written after folding.
SPELLINGS = [("sub-licen", "sublicen"), ("licence", "license"), ("https:", "http:"), ("favour", "favor"), ("organisation", "organization"), ("per cent", "percent"), ("noninfringement", "non-infringement"), ("&", " and ")]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Known licences: (id, text).
KNOWN = [
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", _ISC),
    ("0BSD", _ZERO),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD_END),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

#: Digests of the canonical forms of longer licence texts, whole: (id, digest).
DIGESTS = [
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Artistic-1.0-Perl", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]


def canonical(text):
    """The canonical form as a column; every copyright notice is dropped with its line."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    notice = t.contains("copyright") | t.contains("all rights reserved") | t.contains("(c)")
    t = F.when(notice, F.regexp_replace(t, _NOTICE, "$1")).otherwise(t)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, license_id (null if none). known: (license_id, text)."""
    spark = docs.sparkSession
    more = spark.createDataFrame(DIGESTS if known is None else [], "license_id string, digest string")
    if known is None:
        known = spark.createDataFrame(KNOWN, "license_id string, text string")
    digests = known.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), canonical(F.col("text")).alias("c")).where("c <> ''").select("license_id", "digest").unionAll(more).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(canonical(F.col(text_col).cast("string")), 256).alias("digest"))
    return own.join(digests, "digest", "left").select("doc_id", "digest", "license_id")


def sql() -> str:
    """The same over DuckDB's views."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def form(c: str) -> str:
        t = f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"
        t = f"regexp_replace({t}, {q(_NOTICE)}, '\\1', 'g')"
        for a, b in SPELLINGS:
            t = f"replace({t}, {q(a)}, {q(b)})"
        return f"trim(regexp_replace({t}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"

    known = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    more = ", ".join(f"({q(i)}, {q(d)})" for i, d in DIGESTS)
    return f"""WITH known AS (SELECT sha256({form("text")}) AS digest, min(license_id) AS license_id FROM (VALUES {known}) AS k(license_id, text) GROUP BY 1 UNION ALL SELECT digest, license_id FROM (VALUES {more}) AS m(license_id, digest))
SELECT doc_id, d.digest, license_id FROM (SELECT doc_id, sha256({form("text")}) AS digest FROM documents) d LEFT JOIN known ON known.digest = d.digest"""
