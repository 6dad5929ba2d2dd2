"""License scan by canonical digest.

A text is put in canonical form (``canonical``), hashed, and hash-joined to
the digests of known licence texts. Canonical form: copyright lines and "all
rights reserved" are left out, letters are lower case, equivalent spellings
are one (licence, colour, "non-commercial", "&", http/https ...), and all
punctuation and white space becomes single spaces. The unit is the entire
text; ``scan`` compares, beside whole documents, each of their lines and
each of their paragraphs (parted by empty lines) in the same way, as licence
notices are mostly one of them.

Everything is built-in column expressions, so Spark runs it inside the JVM
and any SQL engine can repeat it.

Defined cases: a null or empty text, or one that is empty in canonical form,
matches nothing; equal digests of one document are reported once a unit,
with the number of times (``n``); of known licences with equal canonical
texts the first by name counts; repeated rows are reported each; a null
doc_id is kept; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs (pattern, replacement) in the order in which they apply to lower-case text.
RULES = [
    (r"(^|\n)[^\n0-9a-z]*(copyright|\(c\)|©)[^\n]*", "\n"),
    (r"all rights reserved", " "),
    (r"[^0-9a-zà-öø-ÿ]+", " "),
    (r"licence", "license"),
    (r"\blicencing\b|\blicensing\b", "license"),
    (r"\bnon ?commercial\b", "noncommercial"),
    (r"\bsub ?license", "sublicense"),
    (r"\bcc by\b", "creative commons attribution"),
    (r"\bgnu gpl\b|\bgpl\b", "gnu general public license"),
    (r"\b(version|ver|v) (\d)", "v$2"),
    (r"\bhttps?\b", "http"),
    (r"\band or\b", "or"),
    (r"(the|this) software is", "software is"),
]

KNOWN = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """Copyright (C) <year> <holder>
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
}

_BSD = """Copyright (c) <year> <holder>
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT %s AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT %s OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
for _who, _owner in (("HOLDERS", "HOLDER"), ("HOLDERS", "OWNER"), ("OWNER", "OWNER")):
    for _id, _more in (("BSD-2-Clause", ""), ("BSD-3-Clause", _THIRD)):
        for _title in ("", _id.replace("-", " ", 1).replace("-Clause", "-Clause License") + "\n\n"):
            _variant = f"{_id}{'' if (_who, _owner) == ('HOLDERS', 'HOLDER') else f' ({_who}, {_owner})'.lower()}{' with title' if _title else ''}"
            KNOWN[_variant] = _title + _BSD % (_more, _who, _owner)
#: The same texts without their title lines.
for _id in ("MIT", "ISC"):
    KNOWN[f"{_id} without title"] = KNOWN[_id].split("\n", 2)[2]
KNOWN["MIT with The"] = "The " + KNOWN["MIT"]

#: Digests of entire long texts (with their preambles and appendices, as their stewards publish them), whose texts aren't kept here.
DIGESTS = {
    "Apache-2.0": "990ad88230c9492a4c80c5d770bf0c83",
    "Artistic-1.0-Perl": "e85c9362c9991d969aa56fcf2be50262",
    "BSD-3-Clause-UC": "4820d7d6c5a500cd985d9e96274c0c9e",
    "CC0-1.0": "1ddc3c8e63268231d5c52e01cb9d2eed",
    "GFDL-1.2": "fd2ecdb7dcfca52611327d1fef0a6be4",
    "GFDL-1.3": "d710c5a59028ff9cf072f8a98378500f",
    "GPL-1.0": "39d6b18975e8e7d1668a774ba0c00aa6",
    "GPL-2.0": "6ccd9f0ab770f39be8ac5a6a92fc6211",
    "GPL-3.0": "bc78257af652311ebb1b1200f742997d",
    "LGPL-2.0": "205f029c676d399a35da5c5ac13f98ad",
    "LGPL-2.1": "dd908f73199d94d394bac4ea45b3ddb7",
    "LGPL-3.0": "ab3ced68049e8485ae8f2b5882e2b33d",
    "MPL-1.1": "1b025b2a74931b85bf6043176a65ee5c",
    "MPL-2.0": "0ee1e37200604052f748c0073f33ba0f",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return F.trim(reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), RULES, F.lower(text)))


def digest(text: Column) -> Column:
    """MD5 of the canonical form; null if that is empty."""
    c = canonical(text)
    return F.when(c != "", F.md5(c))


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """Rows (license, digest) of known licence texts (default: KNOWN and DIGESTS), one a digest."""
    df = spark.createDataFrame(sorted((texts or KNOWN).items()), "license string, text string")
    df = df.select("license", digest(F.col("text")).alias("digest")).where("digest is not null")
    if not texts:
        df = df.union(spark.createDataFrame(sorted(DIGESTS.items()), "license string, digest string"))
    return df.groupBy("digest").agg(F.min("license").alias("license"))


def whole_digest(text: str) -> str | None:
    """``digest`` of one text by Python's own functions, for tables of known digests."""
    import hashlib
    import re

    c = text.lower()
    for pattern, new in RULES:
        c = re.sub(pattern, new.replace("$2", r"\2"), c)
    c = c.strip(" ")
    return hashlib.md5(c.encode()).hexdigest() if c else None


def anchors(texts: dict[str, str] | None = None) -> list[str]:
    """Strings one of which is in every raw text, in lower case, whose canonical form is that of a known one.

    "license" is written licen... or comes from an abbreviation; else it is the longest word that no rule makes.
    """
    made = set(" ".join(new for _, new in RULES).split()) | {"version"}
    out = set() if texts else {"licen", "gpl"}  # each text of DIGESTS holds one
    for text in (texts or KNOWN).values():
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        own = [w for w in words if w.isalpha() and w.isascii() and len(w) > 4 and w not in made and "licen" not in w]
        kept = [line for line in text.lower().split("\n") if "copyright" not in line and "(c)" not in line]
        own = [w for w in own if any(w in line for line in kept)]
        if any("licen" in line for line in kept) or not own:
            out |= {"licen", "gpl"}
        else:
            out.add(max(own, key=lambda w: (len(w), w)))
    return sorted(out)


def _may(c: Column, found: list[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in found])


def units(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, unit, piece) of whole texts, paragraphs and lines."""
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.col("text").alias("piece")))
    paras = F.transform(F.split("text", r"\n[ \t\r]*\n"), lambda x: F.struct(F.lit("paragraph").alias("unit"), x.alias("piece")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("line").alias("unit"), x.alias("piece")))
    out = docs.select("doc_id", F.inline(F.concat(whole, paras, lines)))
    return out


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """Rows (doc_id, unit, license, digest, n) of every unit whose digest is a known one.

    Only what holds an anchor is put in canonical form; nothing else can match.
    """
    some = anchors(texts)
    licenses = known(docs.sparkSession, texts)
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull() & _may(F.col("text"), some))
    found = units(docs).where(_may(F.col("piece"), some)).select("doc_id", "unit", digest(F.col("piece")).alias("digest"))
    return found.join(licenses, "digest").groupBy("doc_id", "unit", "license", "digest").agg(F.count("*").alias("n"))


def scan_sql(texts: dict[str, str] | None = None) -> str:
    """The same in DuckDB's SQL."""

    def canon(c: str) -> str:
        out = f"lower({c})"
        for pattern, new in RULES:
            out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), new.replace("$2", "\\2"))
        return f"trim({out})"

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((texts or KNOWN).items()))
    more = "" if texts else " UNION ALL VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(DIGESTS.items()))
    return f"""
    WITH known AS (SELECT min(license) AS license, digest FROM (SELECT license, md5({canon("text")}) AS digest FROM (VALUES {rows}) t(license, text){more}) GROUP BY 2),
    units AS (
      SELECT doc_id, 'text' AS unit, text AS piece FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, unit, license, digest, count(*) AS n FROM (SELECT doc_id, unit, {canon("piece")} AS c FROM units) u JOIN known ON md5(c) = digest
    WHERE c <> '' GROUP BY ALL"""
