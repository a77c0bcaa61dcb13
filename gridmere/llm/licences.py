"""
Licence scans: whole texts looked up among the digests of known licences.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent
spellings don't count) and hashed; the digest is joined with those of the known texts. A
document is looked up as a whole and line by line, as notices stand alone on a line.
Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmere.llm.common import texts

#: Spellings that licence texts use for each other, and the one kept.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense",
    "sub licensable": "sublicensable", "favour": "favor", "organisation": "organization",
    "authorised": "authorized", "judgement": "judgment", "fulfil": "fulfill", "modelled": "modeled",
    "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder",
    "https": "http", "acknowledgement": "acknowledgment", "redistributor": "distributor",
}

_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE."
)

#: Licences and notices by their public short names. More come as a table.
KNOWN = [
    ("MIT",
     "MIT License\n\nCopyright (c) <year> <owner>\n\nPermission is hereby granted, free of charge, to any "
     'person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
     "in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software.\n\n" + _DISCLAIMER),
    ("ISC",
     "ISC License\n\nCopyright <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this "
     "software for any purpose with or without fee is hereby granted, provided that the above copyright "
     "notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted.\n\n" + _ISC_END),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

_COPYRIGHT_LINE = "(?im)^[ \\t]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$"
_MARKS = "[^\\p{L}\\p{N}\\n]+"


def canonical(text: Column) -> Column:
    """
    The canonical form, line by line: without copyright lines, lower-cased, every run of marks
    and blanks a single space with one at both ends of a line, and one spelling for
    equivalent words. Lines keep their places, so that parts of a text stay aligned.
    """
    bare = F.lower(F.regexp_replace(text, _COPYRIGHT_LINE, ""))
    spaced = F.regexp_replace(F.regexp_replace(bare, _MARKS, " "), "(?m)^ ?| ?$", " ")
    return reduce(lambda t, s: F.replace(t, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), SPELLINGS.items(), spaced)


def _digest(lines: Column) -> Column:
    """Of a canonical text as one line; null if it has no word."""
    flat = F.trim(F.regexp_replace(lines, "[ \\n]+", " "))
    return F.when(flat != "", F.md5(flat.cast("binary")))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license) of known texts, given as (license, text); of equal texts the first name."""
    if known is None:
        known = spark.createDataFrame(KNOWN, "license string, text string")
    digests = known.select(_digest(canonical(F.col("text"))).alias("digest"), "license")
    return digests.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(
    docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """
    (doc_id, digest, license, notices): the digest of the whole text, the licence that it is,
    and the licences that lines of it are, sorted and each once, as one string (empty: none).

    Null, empty and wordless texts have no digest and match nothing. Rows with the same doc_id and
    text are one; other columns are ignored. The join is on digests of known texts, so a
    line that a third of all documents share finds its licence where the document lies.
    """
    spark = docs.sparkSession
    book = known_digests(spark, known)
    lines = texts(docs, doc_id, text).withColumn("lines", canonical(F.col("text"))).select(
        "doc_id", _digest(F.col("lines")).alias("digest"),
        F.array_distinct(F.split("lines", "\n")).alias("lines"),
    )
    parts = lines.select(
        "doc_id", "digest",
        F.explode(F.concat(
            F.array(F.struct(F.lit(True).alias("whole"), F.col("digest").alias("part"))),
            F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), _digest(x).alias("part"))),
        )).alias("x"),
    ).select("doc_id", "digest", "x.*").where("whole OR part IS NOT NULL")
    found = parts.join(book.withColumnRenamed("digest", "part"), "part", "left").where(
        "whole OR license IS NOT NULL"
    )
    notices = F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license"))))
    return found.groupBy("doc_id", "digest").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_join(notices, " ").alias("notices"),
    )


def oracle_sql() -> str:
    """The same in SQL for DuckDB, over the known texts of this module."""
    def form(column: str) -> str:
        bare = f"lower(regexp_replace({column}, '(?im)^[ \\t]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', '', 'g'))"
        spaced = f"regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        lines = f"list_transform(string_split({spaced}, chr(10)), lambda x: ' ' || trim(x) || ' ')"
        text = f"array_to_string({lines}, chr(10))"
        for a, b in SPELLINGS.items():
            text = f"replace({text}, ' {a} ', ' {b} ')"
        return text

    def digest(column: str) -> str:
        flat = f"trim(regexp_replace({column}, '[ \\n]+', ' ', 'g'))"
        return f"CASE WHEN {flat} <> '' THEN md5({flat}) END"

    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
        WITH known AS (
            SELECT {digest("f")} AS part, min(name) AS found
            FROM (SELECT name, {form("t")} AS f FROM (VALUES {rows}) v(name, t)) GROUP BY 1
        ),
        d AS (SELECT doc_id, {form("coalesce(text, '')")} AS f FROM documents),
        w AS (SELECT doc_id, f, {digest("f")} AS digest FROM d),
        l AS (
            SELECT DISTINCT doc_id, found
            FROM (SELECT doc_id, {digest("x")} AS part
                  FROM (SELECT doc_id, unnest(string_split(f, chr(10))) AS x FROM d))
            JOIN known USING (part)
        )
        SELECT w.doc_id, w.digest, k.found AS license,
               coalesce((SELECT string_agg(found, ' ' ORDER BY found) FROM l WHERE l.doc_id = w.doc_id), '') AS notices
        FROM w LEFT JOIN known k ON k.part = w.digest
    """
