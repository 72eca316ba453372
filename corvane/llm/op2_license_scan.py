"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram hash of every text is joined to the places of that hash in license
templates. A hit votes for a diagonal: its place in the text less its place in the template. Votes
are counted by text, template and diagonal. Of a notice's diagonals those with LEAST votes count;
neighbouring ones (shifted by up to SHIFT words put in or left out, at most GAP words apart)
merge, and merged spans are verified by the share of the template's k-grams that they hold.

The base phrases are templates of their own, with k = PHRASE_K: a place of a phrase of n words is a
diagonal with all its votes. Notices, whole ones and their opening sentences, have k = NOTICE_K, so
that ordinary word pairs hit nothing; they add labels where a merged span holds `threshold` of one.

Texts are split into words once: what comes of that, a row a text and one a hit, is a kept table.
Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text lower-cased in A-Z. Null or empty text, or
without hits: counts 0, null places, empty labels, score 0. Null doc_id: a row like any other.
Repeated rows: one result each. Templates are a fixed list, so their broadcast is bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import keep

GAP, SHIFT, LEAST, THRESHOLD = 12, 8, 3, 0.7
PHRASE_K, NOTICE_K = 2, 4

# Base phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Words of common notices, and of their opening sentences, with the labels that they give.
NOTICES = [
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib-notice", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("boost-notice", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-notice", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]

#: name, text, label, base, k of each template
TEMPLATES = [(f"phrase {text}", text, label, True, PHRASE_K) for text, label in PHRASES.items()] + [(f"notice {k} {label}", text, label, False, NOTICE_K) for k, (label, text) in enumerate(NOTICES)]
#: Votes are bits: so many 64-bit numbers hold those of the longest template.
MASKS = -(-max(len(text.split()) - k + 1 for _, text, _, _, k in TEMPLATES) // 64)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _SEPARATORS), "")


def _neighbours(values: Column, step: int) -> Column:
    """The hash of each value with the one step places on, in order."""
    n = F.size(values) - step
    return F.when(n > 0, F.zip_with(F.slice(values, 1, n), F.slice(values, 1 + step, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def grams(words: Column) -> tuple[Column, Column]:
    """The hashes of every 2-gram, and of every 4-gram by its two 2-grams."""
    pairs = _neighbours(words, 1)
    return pairs, _neighbours(pairs, 2)


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, n_grams, h, at: a row for each k-gram of each template."""
    table = spark.sql("VALUES " + ", ".join(f"('{name}', '{text}', '{label}', {base}, {k})" for name, text, label, base, k in TEMPLATES)).toDF("template", "text", "label", "base", "k")
    pairs, fours = grams(words(F.col("text")))
    of = table.withColumn("grams", F.when(F.col("k") == PHRASE_K, pairs).otherwise(fours)).withColumn("n_grams", F.size("grams"))
    return of.select("template", "label", "base", "n_grams", F.posexplode("grams").alias("at", "h"))


_VOTES = [f"votes{k}" for k in range(MASKS)]


def _count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(c) for c in columns))


def diagonals(hits: DataFrame) -> DataFrame:
    """Votes of each diagonal: bits hold which of the template's k-grams voted, once each, so any
    number of partial counts adds up to the same."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)
    votes = [F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / 64) == k, bit)), F.lit(0).cast("long")).alias(c) for k, c in enumerate(_VOTES)]
    return hits.groupBy("r1", "r2", "template", "label", "base", "n_grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(*votes, F.min("place").alias("first"), F.max("place").alias("last"))


def verified(voted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(r1, r2, label, base, first, share) of base phrases and merged notice spans. A phrase's
    diagonal with all its votes stays alone; both kinds go through one window."""
    key = ["r1", "r2", "template", "label", "base", "n_grams"]
    along = Window.partitionBy("r1", "r2", "template").orderBy("first", "last", "diagonal")
    far = F.col("base") | (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > SHIFT) | (F.col("first") - F.lag("last").over(along) > GAP)
    pieces = voted.where(_count(_VOTES) >= F.when(F.col("base"), F.col("n_grams")).otherwise(F.least(F.lit(LEAST), "n_grams")))
    parts = pieces.withColumn("part", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(along))
    merged = parts.groupBy(*key, "part").agg(*(F.bit_or(c).alias(c) for c in _VOTES), F.min("first").alias("first"))
    return merged.select("r1", "r2", "label", "base", "first", (_count(_VOTES) / F.col("n_grams")).alias("share")).where(F.col("share") >= threshold)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    # rows are told apart by id and text, so that repeated rows agree and a null id is no special case
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.hash("text", "doc_id").alias("r2"), words(F.col("text")).alias("words"))
    pairs, fours = grams(F.col("words"))
    # a place without hashes before all others stands for the text itself
    places = F.concat(F.array(F.array(F.lit(None).cast("long"))), F.zip_with(pairs, fours, lambda a, b: F.array(a, b)))
    rolled = keyed.select("doc_id", "r1", "r2", F.size("words").cast("long").alias("n_words"), F.posexplode(places).alias("at_place", "hashes"))
    rolled = rolled.select("doc_id", "r1", "r2", "n_words", (F.col("at_place") - 1).alias("place"), F.explode("hashes").alias("h"))
    seen = rolled.join(F.broadcast(templates(docs.sparkSession)), "h", "left").where("place < 0 or template is not null")
    seen = keep(seen.drop("h"), "licenses")
    counted, hits = seen.where("place < 0").select("doc_id", "r1", "r2", "n_words"), seen.where("place >= 0")
    of_base = lambda c: F.when(F.col("base"), c)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = verified(diagonals(hits), threshold).groupBy("r1", "r2").agg(
        F.count(of_base(F.lit(1))).alias("n_base"),
        F.min(of_base(F.col("first"))).cast("long").alias("first_word"),
        F.max(of_base(F.col("first"))).cast("long").alias("last_word"),
        joined(of_base(F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    filled = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    out = counted.join(found, ["r1", "r2"], "left").na.fill(filled)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _values() -> str:
    return ", ".join(f"('{name}', '{text}', '{label}', {base}, {k})" for name, text, label, base, k in TEMPLATES)


ORACLE_SQL = rf"""
WITH t AS (SELECT *, string_split(text, ' ') AS w FROM (VALUES {_values()}) v(template, text, label, base, k)),
tp AS (SELECT template, label, base, k, len(w) - k + 1 AS n_grams, unnest(range(1, len(w) - k + 2)) AS i, w FROM t),
tpl AS (SELECT template, label, base, k, n_grams, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS gram FROM tp),
docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (VALUES ({PHRASE_K}), ({NOTICE_K})) v(k)),
rolled AS (SELECT doc_id, k, i - 1 AS place, array_to_string(w[i:i + k - 1], ' ') AS gram FROM places),
diag AS (
  SELECT doc_id, template, label, base, n_grams, place - pos AS diagonal, count(DISTINCT pos) AS votes, list(DISTINCT pos) AS seen, min(place) AS first, max(place) AS last
  FROM rolled JOIN tpl USING (k, gram) GROUP BY ALL),
pieces AS (
  SELECT *, coalesce(abs(diagonal - lag(diagonal) OVER w) > {SHIFT} OR first - lag(last) OVER w > {GAP}, true) AS far
  FROM diag WHERE NOT base AND votes >= least({LEAST}, n_grams)
  WINDOW w AS (PARTITION BY doc_id, template ORDER BY first, last, diagonal)),
parts AS (SELECT *, sum(far::INT) OVER (PARTITION BY doc_id, template ORDER BY first, last, diagonal) AS part FROM pieces),
notices AS (
  SELECT doc_id, label, base, min(first) AS first, len(list_distinct(flatten(list(seen)))) / n_grams AS share
  FROM parts GROUP BY doc_id, template, label, base, n_grams, part),
found AS (
  SELECT doc_id, label, base, diagonal AS first, 1.0 AS share FROM diag WHERE base AND votes = n_grams
  UNION ALL SELECT * FROM notices WHERE share >= {THRESHOLD}),
by_doc AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN by_doc USING (doc_id)
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
