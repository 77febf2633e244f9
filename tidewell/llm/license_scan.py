"""License scans by diagonal voting, in DataFrame operations alone.

Texts and templates become lower-cased words. Every run of K words of a text is hashed and joined to the places of the
same run in the templates; a match votes for the diagonal (place in the text less place in the template). Votes are
summed by diagonal; diagonals next to each other, as a changed word or two in the middle of a notice makes them, are
merged; and a merged span is kept if enough of the template's words lie under its matches and the span isn't much
longer than what is matched. A kept span gives the template's label and, as score, the matched share of the template.

Beside this, phrases that name a license are found exactly, and their labels always stay.

Defined results: a null or empty text has no words, no labels and score 0. Rows are handled one by one: votes go by
doc_id and a hash of the text, so that rows share them only if both are equal, and null doc_ids with different texts
don't. An empty table gives no rows. Other columns aren't read. An empty template set finds phrases only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NON_WORD_CLASS, UPPER

#: Words of a run.
K = 4
#: Diagonals at most this far apart are one span.
NEAR = 3
#: Share of the template's words, and of the span's words, that must be matched.
COVER, DENSE = 0.6, 0.6
#: Template words up to which the template side is broadcast; a larger set is joined by shuffling.
BROADCAST_WORDS = 1_000_000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Customary notices, and paragraphs of the public license texts, with their labels. Each paragraph is a
# template, so that any of them is found without the others.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def word_array(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NON_WORD_CLASS + "+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def grams(words: Column, k: int) -> Column:
    """Hash of each run of k words, by place."""
    runs = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(runs, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))


def _places(words: Column, phrase: str, label: str) -> Column:
    p = phrase.split(" ")
    starts = F.slice(words, 1, F.greatest(F.size(words) - (len(p) - 1), F.lit(0)))
    at = F.transform(F.filter(F.transform(starts, lambda w, i: F.struct(i.alias("at"), (w == p[0]).alias("hit"))), lambda x: x["hit"]), lambda x: x["at"])
    rest = lambda i: F.array(*[F.get(words, i + j) for j in range(1, len(p))]) == F.array(*map(F.lit, p[1:]))
    at = F.filter(at, rest) if len(p) > 1 else at
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """Array of (place, label) of every phrase."""
    return F.concat(*[_places(words, phrase, label) for phrase, label in phrases.items()])


def template_rows(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, body string")
    rows = rows.withColumn("w", word_array(F.col("body")))
    return rows.select("template", "label", F.size("w").alias("size"), F.posexplode(grams(F.col("w"), k)).alias("place", "gram"))


def diagonals(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans: doc_id, tag (hash of the text), template, label, first and last word, cover. docs: doc_id, tag, text."""
    spark = docs.sparkSession
    sides = template_rows(spark, templates, k)
    if sum(len(t.split()) for _, t in templates) <= BROADCAST_WORDS:
        sides = F.broadcast(sides)
    texts = docs.select("doc_id", "tag", word_array(F.col("text")).alias("w"))
    seen = texts.select("doc_id", "tag", F.posexplode(grams(F.col("w"), k)).alias("at", "gram")).join(sides, "gram")
    votes = seen.groupBy("doc_id", "tag", "template", "label", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.collect_set("place")).alias("place"))
    across = Window.partitionBy("doc_id", "tag", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(across) > NEAR).cast("int"), F.lit(1))
    spans = votes.withColumn("new", new).withColumn("span", F.sum("new").over(across))
    spans = spans.groupBy("doc_id", "tag", "template", "label", "size", "span").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_list("place"))).alias("place"))
    under = lambda places: F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (k - 1))))))
    spans = spans.select("doc_id", "tag", "template", "label", F.array_min("at").alias("first"), (F.array_max("at") + (k - 1)).alias("last"), (under(F.col("place")) / F.col("size")).alias("cover"), under(F.col("at")).alias("matched"))
    return spans.where((F.col("cover") >= COVER) & (F.col("matched") >= DENSE * (F.col("last") - F.col("first") + 1)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    w = own.select("doc_id", "tag", word_array(F.col("text")).alias("w"), F.lower("text").contains("license").alias("named"))
    places = F.when(F.col("named"), phrase_places(F.col("w"), PHRASES)).otherwise(F.array().cast("array<struct<at:long,label:string>>"))
    base = w.select("doc_id", "tag", F.size("w").cast("long").alias("n_words"), places.alias("found"))
    best = diagonals(own, templates).groupBy(F.col("doc_id").alias("voted_id"), F.col("tag").alias("voted_tag")).agg(F.array_sort(F.collect_set("label")).alias("voted"), F.max("cover").alias("cover"))
    both = base.join(best, F.col("doc_id").eqNullSafe(F.col("voted_id")) & (F.col("tag") == F.col("voted_tag")), "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["label"])))
    all_labels = F.array_sort(F.array_union(base_labels, F.coalesce("voted", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_base"),
        F.array_min(F.transform("found", lambda x: x["at"])).alias("first_word"), F.array_max(F.transform("found", lambda x: x["at"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents"))
