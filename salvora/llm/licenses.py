"""Licence scans: canonical forms of entire texts and of notice lines, looked up by digest.

A text is brought to a canonical form (case, copyright lines, punctuation, spaces, equivalent spellings) and its SHA-256 is joined to the
digests of known licences, brought to the same form. The known texts are a constant of this module, so their digests are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Equivalent spellings, each with the one that stands for both.
EQUIVALENT = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("sublicence", "sublicense"),
    ("merchantibility", "merchantability"),
)

# Whole licence texts, without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEXTS = (
    ("MIT", _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n" + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("Zlib", _ZLIB),
)

# Digests of the canonical forms of long licence texts as published.
DIGESTS = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

# Notices of one line. Each has the word license, which spares the other lines of a text.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
)

# A line with a word or sign for copyright first and a year, another sign or `by` after it; those that only begin a wrapped line with the word stay. The first is for engines whose $ knows more line ends.
_LINE = r"^[ \t#*/;%!<>-]*(?:(?:copyright|\(c\)|©)[^\n]*(?:19|20)[0-9][0-9][^\n]*|copyright[ \t]*(?:\(c\)|©|by )[^\n]*|©[^\n]*|all rights reserved[ \t\r.*/]*)$"
_COPYRIGHT, _COPYRIGHT_SQL = "(?md)" + _LINE, "(?m)" + _LINE
_HAS_COPYRIGHT = r"copyright|\(c\)|©|all rights"
_MARKS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f“”‘’–—©®«»]+"
_VARIANT = "(^| )(" + "|".join(a for a, _ in EQUIVALENT) + ")( |$)"
_HINT = "(?i)licen[cs]e"


def canonical(text: Column) -> Column:
    """The canonical form: A-Z lower-cased, copyright lines gone, runs of punctuation and space one space, equivalent spellings one."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    bare = F.when(F.regexp_like(low, F.lit(_HAS_COPYRIGHT)), F.regexp_replace(low, _COPYRIGHT, "")).otherwise(low)
    plain = F.trim(F.regexp_replace(bare, _MARKS, " "))
    spelt = plain
    for word, other in EQUIVALENT:
        for _ in range(2):  # neighbours share the space between them
            spelt = F.regexp_replace(spelt, f"(^| ){word}( |$)", f"$1{other}$2")
    return F.when(F.regexp_like(plain, F.lit(_VARIANT)), spelt).otherwise(plain)


def known(spark, texts: tuple = TEXTS, digests: tuple = DIGESTS) -> DataFrame:
    """(license, digest) of the known texts and digests, one row for each digest."""
    frame = spark.createDataFrame(list(texts), "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    given = spark.createDataFrame(list(digests), "license string, digest string")
    return frame.unionByName(given).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: tuple = TEXTS, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, text_digest, license, notices) for every row of docs.

    license: that of the entire text, also wrapped, quoted in comments or spelt otherwise, else null. notices: licences named by lines that are known notices, each once, in
    order; the notices are a constant of some tens, so their lines are looked up where they stand. Null texts count as empty; an empty text has the digest of the empty string and no licence. Repeated rows each give a row; an
    empty table gives none.
    """
    spark = docs.sparkSession
    lines = {}
    pairs = spark.createDataFrame(list(notices), "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    for row in pairs.collect():  # a constant of this module
        lines[row.digest] = row.license
    by_digest = F.create_map(*(F.lit(x) for pair in sorted(lines.items()) for x in pair))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    likely = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(_HINT)))
    found = F.transform(likely, lambda line: F.try_element_at(by_digest, F.sha2(canonical(line), 256)))
    named = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("text_digest"), F.when(F.regexp_like("text", F.lit(_HINT)), named).otherwise(F.array().cast("array<string>")).alias("notices"))
    return rows.join(F.broadcast(known(spark, texts).withColumnRenamed("digest", "text_digest")), "text_digest", "left").select("doc_id", "text_digest", "license", "notices")


def op3_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, license, notices (comma-joined) and their number for all documents."""
    return scan(docs).select("doc_id", "text_digest", "license", F.array_join("notices", ",").alias("notices"), F.size("notices").cast("bigint").alias("n_notices"))


def _sql() -> str:
    def canon(x: str) -> str:
        plain = rf"trim(regexp_replace(regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{_COPYRIGHT_SQL}', '', 'g'), '{_MARKS}', ' ', 'g'))"
        for word, other in EQUIVALENT:
            for _ in range(2):
                plain = rf"regexp_replace({plain}, '(^| ){word}( |$)', '\1{other}\2', 'g')"
        return plain

    values = lambda rows: ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in rows)
    return f"""
WITH k AS (SELECT digest, min(l) AS license FROM (SELECT l, sha256({canon('t')}) AS digest FROM (VALUES {values(TEXTS)}) v(l, t) UNION ALL SELECT * FROM (VALUES {values(DIGESTS)}) w(l, digest)) GROUP BY 1),
n AS (SELECT DISTINCT sha256({canon('t')}) AS digest, l FROM (VALUES {values(NOTICES)}) v(l, t)),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({canon('text')}) AS text_digest FROM documents),
e AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT r, string_agg(DISTINCT l, ',' ORDER BY l) AS notices, CAST(count(DISTINCT l) AS BIGINT) AS n_notices
      FROM (SELECT r, sha256({canon('line')}) AS digest FROM e WHERE regexp_matches(line, '{_HINT}')) x JOIN n USING (digest) GROUP BY r)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM d LEFT JOIN k ON k.digest = d.text_digest LEFT JOIN f USING (r)
"""


OP3_SQL = _sql()
