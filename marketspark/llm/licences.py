"""Licence scans: canonical digests of texts and of their lines and paragraphs, joined to those of known licences.

A text is brought to a canonical form: lower case, a title line and copyright notices left out, signs of
comments, lists and punctuation dropped, white space made single blanks, equivalent spellings made
one. Its SHA-256 is joined by equality to the digests of the known texts, which get the same
treatment. So are the digests of each line and each paragraph (lines without an empty one between
them). A licence of several paragraphs inside another text has another digest and isn't found.

The known texts are a table; those here are a start. Join sides are left to Spark's own checks of
their size.

Edge cases: a null or empty text, and one that is empty in canonical form, matches nothing and has a
null digest; repeated rows are scanned each; known texts of equal form give the smallest of their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import narrow

#: Spellings that count as one, applied to lower-case words in this order.
EQUIVALENT = (
    ("acknowledgment", "acknowledgement"),
    ("analog", "analogue"),
    ("authorization", "authorisation"),
    ("authorized", "authorised"),
    ("center", "centre"),
    ("favor", "favour"),
    ("honor", "honour"),
    ("license", "licence"),
    ("licensed", "licenced"),
    ("noncommercial", "non  commercial"),
    ("organization", "organisation"),
    ("recognize", "recognise"),
    ("sub  licence", "sublicence"),
    ("sublicense", "sublicence"),
    ("per  cent", "percent"),
    ("while", "whilst"),
    ("https", "http"),
)

#: Public texts and notices by their short names.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
}

KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace(
    "\nTHIS SOFTWARE",
    """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
THIS SOFTWARE""",
)
#: Full texts as they are published, by file name.
NAMES = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0"}
for _file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
    KNOWN[NAMES.get(_file.stem, _file.stem)] = _file.read_text(encoding="utf-8")

#: A notice at the beginning of a line, after signs of comments, up to the end of the line or the first
#: words of a licence. Every line has a line break before it and a blank at its end. "(c)" alone may mark
#: a list.
NOTICE_LINE = (
    r"\n[^a-z0-9\n]*(?:(?:copyright(?![ \t]+(?:notice|holder|owner|law|licen))|copr|all rights reserved)[^a-z0-9\n]"
    r"|\(c\)[^a-z0-9\n]*(?:copyright|[0-9]{4})|©)[^\n]*?"
    r"(?=\n|$|permission is hereby|permission to use|redistribution and use|this software is provided"
    r"|licen[sc]ed under|released under|this work is)"
)
#: A line at the beginning that only names a licence.
TITLE = (
    r"^[^a-z0-9]*(?:the )?(?:mit|isc|x11|expat|zlib|0bsd|bsd zero[- ]clause|(?:new |simplified |modified )?bsd(?:[- ][0-9])?(?:[- ]clause)?)"
    r"(?: \"?(?:new|revised|simplified|modified|freebsd)\"?(?: or \"?revised\"?)?)? licen[sc]e(?: \([^)\n]*\))?[^a-z0-9\n]*\n"
)
#: A numbered or lettered list mark at the beginning of a line.
LIST_MARK = r"\n[ \t]*(?:[0-9]{1,2}|[a-z])[.)][ \t]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; words stand two blanks apart."""
    plain = F.replace(F.replace(F.lower(text), F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit(" \n"))
    plain = F.concat(F.lit("\n"), plain, F.lit(" "))
    plain = F.regexp_replace(F.regexp_replace(plain, NOTICE_LINE, "\n"), TITLE, "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, NOTICE_LINE, "\n"), LIST_MARK, "\n")
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for spelling, common in EQUIVALENT:
        plain = F.replace(plain, F.lit(f" {spelling} "), F.lit(f" {common} "))
    return F.trim(plain)


def canonical_lines(text: Column) -> Column:
    """The canonical form of a text whose lines are kept."""
    plain = F.replace(F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    plain = F.concat(F.lit("\n"), F.replace(plain, F.lit("\n"), F.lit(" \n")), F.lit(" "))
    plain = F.regexp_replace(F.regexp_replace(plain, NOTICE_LINE, "\n"), LIST_MARK, "\n")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", "  ")
    plain = F.concat(F.lit(" "), F.replace(plain, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for spelling, common in EQUIVALENT:
        plain = F.replace(plain, F.lit(f" {spelling} "), F.lit(f" {common} "))
    return F.regexp_replace(plain, " *\n *", "\n")


def parts(plain: Column) -> Column:
    """The canonical lines and paragraphs of a text, from `canonical_lines`, each once; with empty ones.

    Read from a column, which is made once; an expression would be worked out for lines and paragraphs again.
    """
    across = [(a, b) for a, b in EQUIVALENT if "  " in a]

    def whole(paragraph: Column) -> Column:
        one = F.concat(F.lit(" "), F.replace(paragraph, F.lit("\n"), F.lit("  ")), F.lit(" "))
        for spelling, common in across:
            one = F.replace(one, F.lit(f" {spelling} "), F.lit(f" {common} "))
        return F.trim(one)

    lines = F.transform(F.split(plain, "\n"), lambda line: F.trim(line))
    return F.array_distinct(F.concat(lines, F.transform(F.split(plain, "\n\n+"), whole)))


def sha(form: Column) -> Column:
    """SHA-256 of a canonical form; null if it is empty."""
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if nothing is left of the text."""
    return sha(canonical(text))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN.items()], "licence string, text string")


def find_licences(
    df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, digest, licence, inside.

    `licence` is that of the whole text, or else the smallest name of those `inside`: the known licences
    that are a line or a paragraph of the text, sorted. Null and empty if there is none.
    """
    names = known.select(digest(known["text"]).alias("part"), "licence").where("part is not null")
    names = names.groupBy("part").agg(F.min("licence").alias("licence"))
    forms = narrow(df, id_col, text_col).select(
        "doc_id",
        canonical(F.col("text")).alias("form"),
        canonical_lines(F.col("text")).alias("plain"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = forms.select(
        "doc_id",
        sha(F.col("form")).alias("digest"),
        F.transform(F.filter(parts(F.col("plain")), lambda p: p != ""), sha).alias("parts"),
        "row",
    )
    found = rows.select("row", "doc_id", "digest", F.explode_outer(F.array_union("parts", F.array("digest"))).alias("part"))
    found = found.join(names, "part", "left").groupBy("row", "doc_id", "digest").agg(
        F.min(F.when(F.col("part") == F.col("digest"), F.col("licence"))).alias("whole"),
        F.array_sort(F.collect_set("licence")).alias("inside"),
    )
    return found.select("doc_id", "digest", F.coalesce("whole", F.get("inside", F.lit(0))).alias("licence"), "inside")
