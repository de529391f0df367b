"""Licence scan by canonical digests.

Texts are brought to one form: copyright lines out, everything but letters and digits to one space,
lower case, equivalent spellings to one. The digest of a whole text, and of each of its lines and
paragraphs as a text of its own, is joined to the digests of known licences and notices, a fixed
table: ``NOTICES``, ``HEADERS`` and the whole licences in the folder ``licences``, each with and
without its title, its list numbers and what follows its terms. Paragraphs find wrapped notices;
``n_lines`` counts lines only.

Defined results: null and empty texts carry no licence; a document with several notices lists each
licence once, in order; repeated documents count one by one; no rows give no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and short licence texts in public use, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
]
# Paragraphs that begin files under a licence.
HEADERS = [
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at"),
]
#: A word of every known text; what has none of them is none.
MARK = "(?i)licen[cs]|released|permission|redistribution"
# Spellings that count as the same, after canonical form.
SAME = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("noncommercial", "non commercial"),
        ("organisation", "organization"), ("favour", "favor"), ("ver", "version"), ("v", "version")]
COPYRIGHT = r"(?im)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"
#: Lines that name a year or a holder; a licence's own words may begin a line with "copyright" too.
HOLDER = (r"(?im)^[^a-z0-9\n]*(?:(?:copyright|©)[^\n]*(?:\(c\)|©|\b(?:19|20)\d\d\b|<year>|\[yyyy\])|\(c\)[^\n]*\b(?:19|20)\d\d\b|©"
          r"|copyright by\b|(?-i:Copyright (?!Licen|Holder|Notice|Owner|Law|And|Rights)[A-Z])|all rights reserved\.?[ \t\r]*$)[^\n]*$")
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"


def bodies() -> list[tuple[str, str]]:
    """Whole licences, with and without title, list numbers and what follows the terms."""
    out = []
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        text = path.read_text()
        untitled = re.split(r"\n[ \t]*\n", text, maxsplit=1)[1]
        for t in (text, untitled):
            terms = re.split(r"(?m)^\s*END OF TERMS AND CONDITIONS\s*$", t)[0]
            for end in (t, terms, terms + "\nEND OF TERMS AND CONDITIONS") if terms != t else (t,):
                out.extend((path.stem, x) for x in (end, re.sub(r"(?m)^[0-9]\. ", "", end)))
    return out


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), HOLDER, "")
    out = F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(out, "[^A-Za-z0-9]+", " "))), F.lit(" "))
    for a, b in SAME:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark) -> DataFrame:
    """``license``, ``digest`` of the fixed table."""
    rows = spark.createDataFrame(NOTICES + HEADERS + bodies(), "license string, notice string")
    return rows.select("license", digest(F.col("notice")).alias("digest")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, lines that are a known text, licences in order, and whether the whole text is one."""
    table = F.broadcast(known(docs.sparkSession))  # as many rows as the fixed list
    row = docs.select("doc_id", F.col("text").alias("_t"), F.monotonically_increasing_id().alias("_row"))
    text = F.coalesce("_t", F.lit(""))
    unit = lambda kind: lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit"))
    several = F.filter(F.split(text, PARAGRAPH), lambda u: F.instr(F.trim(u), "\n") > 0)  # one line is a unit already
    units = row.filter(text.rlike(MARK)).select("_row", F.explode(F.concat(
        F.array(unit("whole")(text)), F.transform(F.split(text, "\n"), unit("line")), F.transform(several, unit("paragraph")))).alias("u"))
    units = units.select("_row", "u.*").filter(F.col("unit").rlike(MARK))
    hits = units.select("_row", "kind", digest(F.col("unit")).alias("digest")).join(table, "digest")
    found = hits.groupBy("_row").agg(
        F.sum(F.when(F.col("kind") == "line", 1).otherwise(0)).cast("long").alias("n_lines"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.max(F.col("kind") == "whole").alias("whole_text"))
    out = row.select("doc_id", "_row").join(found, "_row", "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("whole_text", F.lit(False)).alias("whole_text"))


def _sql_canonical(column: str) -> str:
    out = f"regexp_replace({column}, '{COPYRIGHT}', '', 'g')"
    out = f"' ' || lower(trim(regexp_replace({out}, '[^A-Za-z0-9]+', ' ', 'g'))) || ' '"
    for a, b in SAME:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"sha256(trim({out}))"


def oracle() -> str:
    quoted = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in row)) for row in NOTICES)
    return f"""
    WITH known AS (SELECT DISTINCT license, {_sql_canonical('notice')} AS digest FROM (VALUES {quoted}) t(license, notice)),
    rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    units AS (SELECT r, true AS whole, t AS unit FROM rows UNION ALL SELECT r, false, unnest(string_split(t, chr(10))) FROM rows),
    hits AS (SELECT r, whole, license FROM (SELECT r, whole, {_sql_canonical('unit')} AS digest FROM units) JOIN known USING (digest)),
    found AS (SELECT r, count(*) FILTER (NOT whole) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS l, bool_or(whole) AS w
              FROM hits GROUP BY r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(l, '') AS licenses, coalesce(w, false) AS whole_text
    FROM rows LEFT JOIN found USING (r)"""
