"""Licence scan by canonical digests.

A text is put into canonical form: ASCII letters in lower case, copyright
lines and ``all rights reserved`` dropped, equivalent spellings made one,
punctuation and white space folded to single spaces. The digest of the whole
document and of each of its lines is joined with the digests of known licence
texts and notices. Only digests take part in the join; the known side is a
parameter, and Spark broadcasts it only where its size allows.

Rows fold per document before the shuffle, so neither a long document nor a
line that stands in a third of all documents gathers anywhere.

Defined results: null and blank texts carry no licence; rows that share an id
are one document whose findings are united; a line that matches several
licences counts for each.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that mean the same, in the order in which they are applied.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("all rights reserved", ""),
    ("https://", "http://"),
    ("&", " and "),
]
COPYRIGHT_LINE = r"\n[ \t]*(?:copyright|\(c\)|©)[^\n]*"
MARKS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"

# Public licence texts and short notices; longer texts and more notices are tables in files, read where the driver plans.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
                "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "ISC": ["SPDX-License-Identifier: ISC"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
}
HERE = Path(__file__).resolve().parent
TEXTS |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((HERE / "licence_texts").glob("*.txt"))}
for _name, _line in (row.split("\t") for row in (HERE / "licence_notices.tsv").read_text(encoding="utf-8").splitlines()[1:]):
    if _line not in NOTICES.setdefault(_name, []):
        NOTICES[_name].append(_line)


def canonical_lines(text: Column) -> Column:
    """The non-empty lines of a text in canonical form."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.concat(F.lit("\n"), text), upper, upper.lower())
    text = F.regexp_replace(text, COPYRIGHT_LINE, "\n")
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.filter(F.transform(F.split(F.regexp_replace(text, MARKS, " "), "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")


def digest(lines: Column) -> Column:
    """The digest of canonical lines as one text."""
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] = TEXTS, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """(license, kind, digest) of licence texts (kind ``text``) and notices (kind ``line``)."""
    rows = [(name, "text", text) for name, text in texts.items()] + [(name, "line", line) for name, lines in notices.items() for line in lines]
    return spark.createDataFrame(rows, "license string, kind string, text string").select("license", "kind", digest(canonical_lines(F.col("text"))).alias("digest")).distinct()


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, ``text_licenses`` (the whole text is one), ``line_licenses`` (both sorted, distinct) and ``n_lines`` (lines that matched)."""
    lines = canonical_lines(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    units = docs.select(F.col(f"`{id_col}`").alias("of"), lines.alias("lines"))
    units = units.select("of", F.explode(F.concat(
        F.array(F.struct(F.lit("text").alias("kind"), digest(F.col("lines")).alias("digest"))),
        F.transform("lines", lambda x: F.struct(F.lit("line").alias("kind"), F.sha2(x, 256).alias("digest"))))).alias("unit")).select("of", "unit.*")
    met = units.join(known, ["kind", "digest"], "left")
    line, text = (F.col("kind") == k for k in ("line", "text"))
    return met.groupBy("of").agg(
        F.array_sort(F.collect_set(F.when(text, F.col("license")))).alias("text_licenses"),
        F.array_sort(F.collect_set(F.when(line, F.col("license")))).alias("line_licenses"),
        F.count(F.when(line, F.col("license"))).alias("n_lines")).withColumnRenamed("of", id_col)
