"""Licence scans by canonical digest: texts that differ only in case, punctuation, copyright lines or equivalent
spellings have one digest, and digests of whole texts are joined to those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.llm.base import stored

# Spellings that count as one, each a whole word.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "centre": "center", "favour": "favor", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labour": "labor", "modelled": "modeled",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "utilisation": "utilization", "whilst": "while",
    "https": "http",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n\n"
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_PERMIT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted"
)

# Whole licence texts.
LICENCES = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person "
        'obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <holder>\n\n" + _PERMIT + ", provided that the above copyright notice and "
        "this permission notice appear in all copies.\n\n" + _ISC_AS_IS
    ),
    "0BSD": "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n" + _PERMIT + ".\n\n" + _ISC_AS_IS,
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_HEAD + _BSD_AS_IS,
    "BSD-3-Clause": (
        "BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_HEAD + "3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.\n\n" + _BSD_AS_IS
    ),
    "Zlib": (
        "zlib License\n\n(C) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied "
        "warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source "
        "distribution."
    ),
}

# One-line notices that name a licence.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
}

# What follows `copyright` where a licence's own sentence is broken before it, unless a year or a mark comes after.
_GOES_ON = r"(?:notices?|holders?|owners?|laws?|licen[sc]es?|statements?|permission|interest|disclaimer)\b"
_MARK = r"(?:\b[12][0-9]{3}\b|\(c\)|©)"
_PROSE = rf"{_GOES_ON}(?![^\n]*{_MARK})"


def canonical(text: Column) -> Column:
    """Lower case; lines of copyright and of reserved rights gone; words of a-z and 0-9 with one blank between; one
    spelling for equivalent ones. A line that goes on with licence words after `copyright` is one of the licence."""
    lower = F.lower(text)
    kept = F.regexp_replace(
        lower, rf"(?md)^[^a-z0-9\n]*(copyright[ \t]+(?!{_PROSE})(?=[^ \t\r\n])|\(c\)|©|all rights reserved)[^\n]*$", " "
    )
    words = F.trim(F.regexp_replace(kept, r"[^a-z0-9]+", " "))
    one = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(one, w), w)), " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """`known` (licence, text), one row per digest: licence names that share a text are joined by a comma."""
    rows = known.where("text IS NOT NULL").select("licence", digest(F.col("text")).alias("known_digest"))
    return rows.groupBy("known_digest").agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("known_as"))


def texts_of(spark, table: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "licence string, text string")


def scan(
    docs: DataFrame, licences: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, licence, notices.

    digest: of the whole canonical text. licence: the known licence with that
    digest, else null. notices: licences named by lines that are, each as a
    whole, a known notice (a line with the stem "licen"): distinct, sorted,
    comma-joined, empty if none.

    A null text counts as empty, and no licence is empty. Repeated rows and
    null ids are each answered; an empty table gives an empty result. Both
    joins are on a digest against one row per known text; the planner sends the
    known side to every task while it is small. Copies of one text, be they a
    third of the table, then stay where they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), digest(text).alias("digest"),
            F.transform(
                F.filter(F.split(text, "\n"), lambda line: F.lower(line).contains("licen")),
                lambda line: digest(line),
            ).alias("_lines"),
        ),
        "licences",
    )
    known, notes = known_digests(licences), known_digests(notices).withColumnRenamed("known_digest", "_notice")
    found = (
        rows.where(F.size("_lines") > 0).select("_row", F.explode("_lines").alias("_notice"))
        .join(notes, "_notice").groupBy("_row").agg(F.collect_set("known_as").alias("_names"))
    )
    return (
        rows.join(known, F.col("digest") == F.col("known_digest"), "left")
        .join(found, "_row", "left")
        .select(
            "doc_id", "digest", F.col("known_as").alias("licence"),
            F.coalesce(F.array_join(F.sort_array("_names"), ","), F.lit("")).alias("notices"),
        )
    )


def oracle_sql() -> str:
    """The same over `documents`, in the SQL the results are checked with."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # The rule for copyright lines without look-ahead, which its patterns do not have: line by line.
    is_ = lambda pattern: f"regexp_matches(l, {quote(r'^[^a-z0-9]*' + pattern)})"
    dropped = (
        is_(r"(\(c\)|©|all rights reserved)") + " OR " + is_(r"copyright[ \t]+[^ \t\r]") + " AND NOT ("
        + is_(rf"copyright[ \t]+{_GOES_ON}") + " AND NOT " + is_(rf"copyright[ \t]+{_GOES_ON}.*{_MARK}") + ")"
    )
    macro = (
        "list_transform(string_split(trim(regexp_replace(array_to_string(list_filter(string_split(lower(TEXT), chr(10)), "
        f"lambda l: NOT ({dropped})), ' '), "
        "'[^a-z0-9]+', ' ', 'g')), ' '), lambda w: coalesce(map_extract(MAP {"
        + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in SPELLINGS.items())
        + "}, w)[1], w))"
    )
    dig = lambda t: f"sha256(array_to_string({macro.replace('TEXT', t)}, ' '))"
    known = lambda table: (
        "SELECT d, string_agg(DISTINCT licence, ',' ORDER BY licence) AS known_as FROM (SELECT licence, "
        + dig("body") + " AS d FROM (VALUES "
        + ", ".join(f"({quote(n)}, {quote(t)})" for n, t in table.items()) + ") v(licence, body)) GROUP BY d"
    )
    return (
        f"WITH known AS ({known(LICENCES)}), notes AS ({known(NOTICES)}), "
        "rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents), "
        "lines AS (SELECT DISTINCT r, n.known_as FROM (SELECT r, unnest(string_split(body, chr(10))) AS line FROM rows) l "
        f"JOIN notes n ON {dig('l.line')} = n.d WHERE contains(lower(l.line), 'licen')), "
        "named AS (SELECT r, string_agg(known_as, ',' ORDER BY known_as) AS names FROM lines GROUP BY r) "
        f"SELECT doc_id, digest, k.known_as AS licence, coalesce(names, '') AS notices FROM "
        f"(SELECT r, doc_id, {dig('body')} AS digest FROM rows) x "
        "LEFT JOIN known k ON x.digest = k.d LEFT JOIN named USING (r)"
    )
