"""Licence scans: whole texts in a canonical form are looked up among the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import table

MAX_KNOWN = 100_000  # digests of so many known texts (about 100 bytes each) are sent to every executor; more are joined

# Texts of known short licences and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
KNOWN = {
    "MIT": [MIT, f"MIT License\n\nCopyright (c) <year> <holders>\n\n{MIT}", f"The MIT License (MIT)\n\n{MIT}", "Released under the MIT License."],
    "ISC": [ISC, f"ISC License\n\n{ISC}"],
    "0BSD": [ZERO_BSD, f"BSD Zero Clause License\n\n{ZERO_BSD}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}

# Spellings that count as equal (left becomes right).
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "sub license": "sublicense",
    "sub licence": "sublicense",
}
# SHA-256 of the canonical form of whole published licence texts, in the spellings above; a second digest is that of the
# text up to its "END OF TERMS AND CONDITIONS". A text alone doesn't tell "only" from "or later"; BSD-3-Clause is the wording that names the University.
DIGESTS = {
    "Apache-2.0": [
        "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
    ],
    "Artistic-1.0-Perl": [
        "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    ],
    "BSD-3-Clause": [
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2-only": [
        "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    ],
    "GFDL-1.3-only": [
        "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    ],
    "GPL-1.0-only": [
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    ],
    "GPL-2.0-only": [
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    ],
    "GPL-3.0-only": [
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    ],
    "LGPL-2.0-only": [
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    ],
    "LGPL-2.1-only": [
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    ],
    "LGPL-3.0-only": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    ],
    "MPL-2.0": [
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ],
}
COPYRIGHT_LINE = r"(?im)^[\s*#/;-]*(?:copyright\s*(?:\(c\)|©|<|\[|\d{4}|the authors?\b|by\b)|\(c\)\s*(?:copyright\b|<|\[|\d{4})|©|all rights reserved)[^\n]*$"
ANY_SPELLING = r"\b(?:" + "|".join(SPELLINGS) + r")\b"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, single spaces, one spelling (null: empty), whatever the length.

    A copyright line begins with the word or sign and a year, a placeholder or its holder; a clause "(c) You must ..." is none.
    """
    c = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), COPYRIGHT_LINE, "")
    c = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    spelt = c
    for old, new in SPELLINGS.items():
        spelt = F.regexp_replace(spelt, rf"\b{old}\b", new)
    return F.when(c.rlike(ANY_SPELLING), spelt).otherwise(c)


def scan(docs: DataFrame, known: dict[str, list[str]] | DataFrame, digests: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, licence_id) for every row of docs; licence_id is null if the whole text is none.

    known: texts by licence, or a DataFrame (licence_id, text); digests: canonical digests of further texts by licence. Of licences with one canonical text the smallest id
    is given; texts without a letter or digit match nothing, in docs (null ones too) as in known. Repeated rows
    get equal rows. No rows: no rows. Further columns of docs are ignored.
    """
    more = [(k, d) for k, ds in (digests or {}).items() for d in ds]
    if isinstance(known, dict):
        rows = [(k, t) for k, texts in known.items() for t in texts]
        known = docs.sparkSession.createDataFrame(rows, "licence_id string, text string")
        small = len(rows) + len(more) <= MAX_KNOWN
    else:
        small = known.limit(MAX_KNOWN + 1).count() + len(more) <= MAX_KNOWN
    found = known.select("licence_id", canonical(F.col("text")).alias("c")).filter("c <> ''").select("licence_id", F.sha2(F.col("c").cast("binary"), 256).alias("canonical_sha256"))
    found = found.union(docs.sparkSession.createDataFrame(more, "licence_id string, canonical_sha256 string"))
    found = found.groupBy("canonical_sha256").agg(F.min("licence_id").alias("licence_id"))
    own = docs.select("doc_id", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("canonical_sha256"))
    return own.join(F.broadcast(found) if small else found, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), KNOWN, DIGESTS)


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(t: str) -> str:
        c = f"trim(regexp_replace(lower(regexp_replace(coalesce({t}, ''), {quoted(COPYRIGHT_LINE)}, '', 'g')), '[^\\pL\\pN]+', ' ', 'g'))"
        for old, new in SPELLINGS.items():
            c = f"regexp_replace({c}, '\\b{old}\\b', '{new}', 'g')"
        return c

    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, texts in KNOWN.items() for t in texts)
    digests = ", ".join(f"({quoted(k)}, {quoted(d)})" for k, ds in DIGESTS.items() for d in ds)
    return f"""
WITH found AS (SELECT id, sha256({canon("t")}) AS canonical_sha256 FROM (VALUES {values}) v(id, t) UNION ALL SELECT * FROM (VALUES {digests}) w(id, canonical_sha256)),
known AS (SELECT canonical_sha256, min(id) AS licence_id FROM found GROUP BY 1),
own AS (SELECT doc_id, sha256({canon("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, licence_id FROM own LEFT JOIN known USING (canonical_sha256)
"""


ORACLE = _oracle()
