"""Licence scans by canonical digest: texts that say the same licence hash alike.

A text is normalised in case, white space, punctuation, copyright lines and equivalent spellings, and the
digest of what remains is looked up among the digests of known licences with a hash join. Whole texts are
looked up, and so is each line, for notices that stand in other text.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import licence_texts
from barloom.llm.common import LOWER, UPPER, ascii_lower, require

# Spellings that licences use for one another.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
    ("while", "whilst"),
    ("v", "version"),
    ("and or", "or"),
]

# Known notices and short licences.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
]
# The short licences are usual without their title and with others; full texts and headers join them.
_SHORT = [
    (name, titles, text.removeprefix(f"{name} License "))
    for name, titles in (("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"]), ("ISC", ["ISC License", "The ISC License"]))
    for own, text in KNOWN
    if own == name and text.startswith(f"{name} License ")
]
KNOWN += [row for row in licence_texts.rows(_SHORT + licence_texts.TEXTS) if row not in KNOWN]

COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*$"
#: Only a line feed ends a line.
UNIX_LINES = "(?d)"
NO_WORD = r"[^a-z0-9]+"


def canonical(text: Column) -> Column:
    """The words of the text as licences are compared: lower case, without copyright lines and
    punctuation, in one spelling, separated by single spaces."""
    lines = F.regexp_replace(ascii_lower(F.translate(text, "\r", "\n")), UNIX_LINES + COPYRIGHT_LINE, "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, NO_WORD, " ")), F.lit(" "))
    # Neighbouring occurrences share a space, so each spelling is replaced with its spaces doubled.
    doubled = F.replace(words, F.lit(" "), F.lit("  "))
    spelled = reduce(
        lambda value, pair: F.replace(value, F.lit(f" {pair[0].replace(' ', '  ')} "), F.lit(f" {pair[1].replace(' ', '  ')} ")),
        SPELLINGS, doubled,
    )
    return F.trim(F.regexp_replace(spelled, " +", " "))


def digested(df: DataFrame, text: Column) -> DataFrame:
    """Add ``digest``, that of the canonical text; null if nothing remains.

    The words are a column of their own on the way, so that they are made once.
    """
    words = df.withColumn("_words", canonical(text))
    return words.withColumn("digest", F.when(F.col("_words") != "", F.sha2("_words", 256))).drop("_words")


def known_digests(known: DataFrame) -> DataFrame:
    """``digest`` and ``licence`` of known texts (``licence``, ``text``); of several licences with one
    digest, the first by name."""
    return (
        digested(known.select("licence", "text"), F.col("text"))
        .filter("digest is not null and licence is not null")
        .groupBy("digest")
        .agg(F.min("licence").alias("licence"))
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``licence`` and ``notices`` for every row of ``docs``.

    ``digest`` is that of the whole text, ``licence`` the known licence with that digest, and ``notices``
    the names, sorted and comma-joined, of the known licences that a line of the text states by itself.
    Null texts and texts without letters and digits have no digest, no licence and no notices (an empty
    string). Repeated rows stay. The known digests are joined by hash; the matches of a row are put
    together before anything moves.
    """
    require(docs, ["doc_id", "text"])
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r", "\n")
    line = F.transform(F.split(text, "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), text.alias("text")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    pieces = rows.select("_row", "doc_id", F.explode(F.concat(whole, line)).alias("piece"))
    hashed = digested(pieces, F.col("piece.text")).select("_row", "doc_id", "piece.whole", "digest")
    found = hashed.join(known_digests(known), "digest", "left")
    notices = F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence"))))
    return (
        found.groupBy("_row", "doc_id")
        .agg(
            F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
            F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
            F.array_join(notices, ",").alias("notices"),
        )
        .drop("_row")
    )


def canonical_sql(text: str) -> str:
    """The same normal form in SQL."""
    lines = f"regexp_replace(translate(translate({text}, chr(13), chr(10)), '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
    words = f"replace(' ' || trim(regexp_replace({lines}, '{NO_WORD}', ' ', 'g')) || ' ', ' ', '  ')"
    for old, new in SPELLINGS:
        words = f"replace({words}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({words}, ' +', ' ', 'g'))"
