"""License scan by canonical digests, in DataFrame functions alone.

A text's canonical form is lower case, without copyright lines, with every run of other signs than
letters and digits as one space, and with one of equivalent spellings. Its SHA-256 digest is looked
up among the digests of known licence texts by a hash join: for the whole text, and for each of its
lines, since a notice stands on a line of its own. The known texts are a fixed small table, so its
side of the join is broadcast; nothing else is.

Null texts have a null digest and no licence; empty ones the digest of nothing and no licence; very
long texts are taken whole; rows without an id have no notices; repeated rows each get the licences of
their id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm.license_digests import DIGESTS

# Spellings taken as equal.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "authorised": "authorized",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "judgement": "judgment",
    "licence": "license",
    "licenced": "licensed",
    "organisation": "organization",
    "programme": "program",
    "sublicence": "sublicense",
    "whilst": "while",
}
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
OTHER_SIGNS = r"[^\p{L}\p{N}]+"

# Public licence texts and notices.
_MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", _MIT.removeprefix("MIT License\n\n")),
    ("ISC", _ISC),
    ("ISC", _ISC.removeprefix("ISC License\n\n")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical(text: Column) -> Column:
    """Canonical form of a text."""
    bare = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT_LINE), F.lit(" "))
    words = F.regexp_replace(bare, F.lit(OTHER_SIGNS), F.lit("  "))
    form = F.concat(F.lit(" "), words, F.lit(" "))
    for spelling, usual in EQUIVALENT.items():
        form = F.replace(form, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(F.replace(form, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``(digest, license)``: one row per distinct canonical text of the given licences."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])
    texts = spark.range(1).select(F.inline(rows))
    return texts.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license").alias("license"))


def digest_table(spark: SparkSession, digests=DIGESTS) -> DataFrame:
    """``(digest, license)`` of licences that are known by their digests alone."""
    rows = F.split(F.lit("\n".join(f"{digest} {name}" for name, digest in digests)), "\n")
    row = F.split(F.col("row"), " ")
    return spark.range(1).select(F.explode(rows).alias("row")).select(row[0].alias("digest"), row[1].alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN, digests=DIGESTS) -> DataFrame:
    """``(row_id, digest, license, notices)``: the whole text's licence, and those of its lines, sorted."""
    every = known_digests(docs.sparkSession, known).union(digest_table(docs.sparkSession, digests))
    table = F.broadcast(every.groupBy("digest").agg(F.min("license").alias("license")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
    whole = rows.select("row_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).join(table, "digest", "left")
    lines = rows.select("row_id", F.explode(F.split("body", "\n")).alias("line"))
    found = lines.select("row_id", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(table, "digest")
    notices = found.groupBy("row_id").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    none = F.array().cast("array<string>")
    return whole.join(notices, "row_id", "left").select("row_id", "digest", "license", F.coalesce("notices", none).alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """:func:`canonical` in SQL."""
    form = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    form = f"' ' || regexp_replace({form}, {_quoted(OTHER_SIGNS)}, '  ', 'g') || ' '"
    for spelling, usual in EQUIVALENT.items():
        form = f"replace({form}, ' {spelling} ', ' {usual} ')"
    return f"trim(replace({form}, '  ', ' '))"


def scan_sql(known: Mapping | tuple = KNOWN, digests=DIGESTS) -> str:
    more = ", ".join(f"({_quoted(digest)}, {_quoted(name)})" for name, digest in digests)
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in known)
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256({canonical_sql("t")}) AS digest, license FROM (VALUES {values}) v(license, t) UNION ALL VALUES {more}
  ) GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), notices AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM lines JOIN known ON sha256({canonical_sql("line")}) = digest GROUP BY doc_id
), whole AS (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN notices n ON n.doc_id = w.doc_id
"""
