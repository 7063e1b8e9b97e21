"""License scans by canonical digests.

A text is normalised (case, equivalent spellings, versions and lead-ins, copyright lines, punctuation, white space) and its digest is joined to
the digests of known licences, normalised alike. A document is a licence if its entire text is one; lines of other
documents that are a known notice are reported as well, without a shuffle of texts.

NULL texts and texts that normalise to nothing match nothing. Of known licences with one digest the least name counts.
Repeated rows repeat; doc_id is not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import license_table

MAX_KNOWN = 10_000  # licences, so that their digests may go to every task

# Public licence texts and the notices that stand for them; license_table has the others.
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "GPL-3.0 notice": "Licensed under the GNU General Public License v3.0.",
    "CC-BY-4.0 notice": "Licensed under a Creative Commons Attribution 4.0 International License.",
}

# Equivalent spellings, after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("favour", "favor"),
    ("organisation", "organization"), ("per cent", "percent"), ("whilst", "while"), ("http://", "https://"),
)
# Lines that say whose the copyright is; a wrapped line of a licence's own text may begin with the word as well.
COPYRIGHT = (
    r"(?m)^[\s#*/;-]*(?:copyright\b(?![\s\"'”.,-]*(?:holders?|notices?|and|laws?|line|owners?|ownership|disclaimers?|permissions?|on|interests?|treaty|"
    r"licen[sc]es?|also|if|are|is|in|to|or|of|statement|doctrines|patent|like|those|the (?:software|program|library))\b)|"
    r"\(c\)\s*(?:copyright|[\d<\[])|©)[^\n]*$|^[\s#*/;-]*all rights reserved\W*$"
)
# Equivalent wordings of a normalised text: whose name may not be used, "version 3" = "v3.0" = "3", and what leads in a notice.
WORDINGS = (
    (r"neither the names? of (?:\S+ ){1,12}?nor the names of", "neither the name of the holder nor the names of"),
    (r"\bv(?:ersion|er)? ?(\d+)\b", "$1"),
    (r"\b(\d+) 0\b", "$1"),
    (r"^(?:(?:except where otherwise noted |unless otherwise stated )?(?:this|the|all) (?:\S+ ){1,4}?(?:is|are) )?"
     r"(?:(?:licensed|released|distributed|published|provided|available|made available|shared) under |subject to (?=(?:the )?terms ))"
     r"(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?", "licensed under "),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, letters and digits only, single spaces, one wording."""
    out = F.lower(text)
    out = F.regexp_replace(out, COPYRIGHT, "")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for other, one in WORDINGS:
        out = F.regexp_replace(out, other, one)
    return out


def digest(text: Column) -> Column:
    """NULL for texts that normalise to nothing."""
    body = canonical(text)
    return F.when(body != "", F.sha2(body, 256))


def known_licenses(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license, digest), one row per digest."""
    listed = license_table.texts(KNOWN) + license_table.notices() if known is None else list(known.items())
    rows = spark.createDataFrame(listed, "license string, text string")
    rows = rows.select("license", digest(F.col("text")).alias("digest")).where("digest is not null")
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id with `license` of the entire text, NULL for others, and n_notice_lines: lines that are a known notice.

    The join is on the digest of the entire text; the known digests are few and checked to be."""
    n = known.count()
    if n > MAX_KNOWN:
        raise ValueError(f"{n} licences; {MAX_KNOWN} may go to every task")
    digests = [r["digest"] for r in known.select("digest").collect()]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: digest(line).isin(digests)) if digests else F.array()
    rows = docs.select("doc_id", digest(body).alias("digest"), F.size(lines).cast("long").alias("n_notice_lines"))
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "license", "n_notice_lines")
