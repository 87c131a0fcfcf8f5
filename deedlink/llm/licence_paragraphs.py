"""Licence families of paragraphs by sparse logistic regression over word n-grams, with DataFrame operations only.

The model is trained on windows of known notices (one class for each family) and on all different lines of the corpus that
don't resemble a notice (class ``unknown``), those with the same n-grams of the notices as one row with their number. n-grams of the
notices that are not rare in these lines are left out.
A text is cut into paragraphs at blank lines, and every line into words. A line is judged if it has one of the gates, the runs of two or
three words with a weight. A notice may be wrapped: lines with a gate are judged alone, and the stretch from the first to the last of them
in a paragraph is judged as a whole.
A prediction counts if its probability passes a threshold calibrated on rows that the training has not seen, and if
the stretch resembles a notice of the family.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deedlink.llm.common import smallest, stage  # noqa: F401

UNKNOWN = "unknown"
#: Notices by family, as they are commonly written.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license, see the LICENSE file",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the Apache License on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal public domain dedication.", "Released under CC0 1.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
#: Sentences that speak of licences and belong to no family.
OTHERS = [
    "All rights reserved. See the license agreement for details.",
    "Licensed under the terms of the agreement between the parties.",
    "The license fee is due within thirty days.",
    "A driving license is required for this position.",
    "This software is licensed, not sold.",
    "No license is granted by this document.",
    "Released under a commercial license, contact the author for terms.",
]
#: Part of the class unknown's weight that ``OTHERS`` have together, however many lines the corpus has.
OTHERS_SHARE = 0.002
#: Words of a training window, and the most words of a gram.
WINDOWS = (4, 6, 9, 14)
GRAM = 3
#: Share of calibration rows of the class unknown that must stay unknown, and the least threshold.
UNKNOWN_KEPT = 0.995
LEAST_PROBABILITY = 0.3
#: Share of a notice's grams, or of the paragraph's, that confirms a prediction.
CONFIRMED = 0.6
#: Share of the corpus's lines that may have a gram of the vocabulary, and likeness from which a line does not count as unknown.
RARE = 0.001
RESEMBLES = 0.4
#: ``[^a-z0-9.+]`` by its ranges alone, which Java tells apart many times faster than ranges mixed with single characters.
_BETWEEN = r"[\x00-*,-\-/:-`{-\x{10ffff}]"
_LICENCE_WORDS = "(?i)licen[cs]e|copyright|spdx|redistribut"


class LicenceModel(NamedTuple):
    """``weights``: (gram, class, weight) that are not nought; ``gates``: grams of which a line has one to be judged."""

    classes: list[str]
    intercepts: list[float]
    weights: list[tuple[str, str, float]]
    gates: list[str]
    threshold: float


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits, ``.`` and ``+``, without full stops at the end."""
    plain = F.regexp_replace(F.lower(text), rf"{_BETWEEN}+|\.+(?![a-z0-9])", " ")
    return F.filter(F.split(F.trim(plain), " +"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct runs of one to ``GRAM`` words."""
    return F.array_distinct(_runs(words, (1, GRAM)))


def _runs(words: Column, sizes: tuple[int, int]) -> Column:
    """Runs of ``sizes`` words, with repetitions."""

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, n)))

    return F.concat(*(words if n == 1 else of(n) for n in range(sizes[0], sizes[1] + 1)))


def _table(spark: SparkSession, rows: list[dict], kinds: str) -> DataFrame:
    """A small table from fixed rows."""
    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{kinds}>>'))", args={"rows": json.dumps(rows)})


def _notices(spark: SparkSession) -> DataFrame:
    rows = [{"family": f, "number": k, "notice": t} for f, own in NOTICES.items() for k, t in enumerate(own)]
    return _table(spark, rows, "family:string,number:int,notice:string").withColumn("words", words_of(F.col("notice")))


def _windows(rows: DataFrame) -> DataFrame:
    """family, source and words of the whole of each text and of its windows."""
    rows = rows.withColumn("source", F.xxhash64("words"))
    whole = rows.select("family", "source", "words")
    for n in WINDOWS:
        starts = F.when(F.size("words") > n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        cut = rows.select("family", "source", F.explode(starts).alias("at"), "words")
        whole = whole.union(cut.select("family", "source", F.slice("words", F.col("at"), n)))
    return whole


def _lines_of(documents: DataFrame) -> DataFrame:
    """words of the lines that may train the class unknown: long enough and without a word that tells of licences."""
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where((F.length("line") > 20) & ~F.col("line").rlike(_LICENCE_WORDS)).select(words_of(F.col("line")).alias("words"))


def _hits(marked: Column, own: list[str]) -> Column:
    """The grams of ``own`` in words, given with null in place of each word that ``own`` has not; no other gram is built."""

    def run(n: int) -> Column:
        more = lambda i: [x for k in range(1, n) for x in (F.lit(" "), F.get(marked, i + k))]
        return F.transform(marked, lambda w, i: F.when(w.isNotNull(), F.concat(w, *more(i))))

    runs = [F.filter(run(n), lambda g: g.isin(own)) for n in range(2, GRAM + 1)]
    return F.array_distinct(F.concat(F.filter(marked, lambda w: w.isNotNull()), *runs))


def _unknown_lines(documents: DataFrame, notices: DataFrame, own: list[str]) -> DataFrame:
    """source, n_grams (with repetitions) and hits (the grams of ``own``) of all lines that differ in words and don't resemble a notice."""
    single = [g for g in own if " " not in g]
    n_grams = reduce(lambda total, n: total + F.greatest(F.size("words") - n, F.lit(0)), range(GRAM), F.lit(0))
    marked = F.transform("words", lambda w: F.when(w.isin(single), w))
    lines = _lines_of(documents).select(F.xxhash64("words").alias("source"), n_grams.alias("n_grams"), marked.alias("marked"))
    hits = lines.select("source", "n_grams", _hits(F.col("marked"), own).alias("hits"))
    known = F.broadcast(notices.select(grams_of(F.col("words")).alias("notice_grams")))
    enough = RESEMBLES * F.least(F.size("notice_grams"), F.col("n_grams"))
    # what a line shares with all notices bounds what it shares with one, and is cheap to tell
    alike = (F.col("n_grams") > 0) & (F.size("hits") >= enough) & (F.size(F.array_intersect("hits", "notice_grams")) >= enough)
    lines = hits.groupBy("source").agg(F.first("n_grams").alias("n_grams"), F.first("hits").alias("hits"))
    return stage(lines.join(known, alike, "left_anti"), "licence-lines")


def fit(documents: DataFrame) -> LicenceModel:
    """A model from the notices and all lines of ``documents``; it also works without any."""
    spark = documents.sparkSession
    notices = _notices(spark)
    others = _table(spark, [{"notice": t} for t in OTHERS], "notice:string").select(F.lit(UNKNOWN).alias("family"), words_of(F.col("notice")).alias("words"))
    own = sorted(r[0] for r in notices.select(F.explode(grams_of(F.col("words"))).alias("gram")).distinct().collect())
    plain = _unknown_lines(documents, notices, own)
    met = {r[0]: r[1] for r in plain.select(F.explode("hits").alias("gram")).groupBy("gram").count().collect()}
    different = plain.count()
    most = RARE * different
    vocabulary = [g for g in own if met.get(g, 0) <= most]

    rows = _windows(notices.select("family", "words")).union(_windows(others)).withColumn("grams", grams_of(F.col("words")))
    # a window without a feature says nothing about a family
    speaks = F.size(F.array_intersect("grams", F.from_json(F.lit(json.dumps(vocabulary)), "array<string>"))) > 0
    rows = rows.where((F.col("family") == UNKNOWN) | speaks)
    classes = [UNKNOWN, *NOTICES]
    number = F.element_at(F.from_json(F.lit(json.dumps({c: k for k, c in enumerate(classes)})), "map<string,double>"), F.col("family"))
    rows = rows.select("family", "source", "grams", number.alias("label"), F.pmod(F.xxhash64("words", "family"), F.lit(5)).alias("part"), F.lit(1).cast("long").alias("n"))
    # lines with the same features are one row with their number, so all lines are trained on
    lines = plain.select(F.array_sort(F.filter("hits", lambda g: g.isin(vocabulary))).alias("grams"), F.pmod(F.xxhash64("source"), F.lit(5)).alias("part"))
    lines = lines.withColumn("part", F.least("part", F.lit(1))).groupBy("grams", "part").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.select(F.lit(UNKNOWN).alias("family"), F.lit(None).cast("long").alias("source"), "grams", F.lit(0.0).alias("label"), "part", "n")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    rows = stage(vectors.transform(rows.union(lines)).select("family", "source", "label", "part", "n", "features"), "licence-training")
    # every class weighs the same, however many rows it has, and so does every notice of a class and every line of the corpus
    seen = rows.where(f"part <> 0 or family <> '{UNKNOWN}'")
    told, corpus = seen.where("source is not null"), seen.where("source is null")
    count = corpus.agg(F.sum("n")).head()[0] or 0
    share = F.when((F.col("label") == 0) & F.lit(count > 0), OTHERS_SHARE).otherwise(1.0)
    notices_of = told.groupBy("label").agg(F.count_distinct("source").alias("sources"))
    weight = (1000 / (F.count(F.lit(1)) * F.first("sources"))).alias("weight")
    weighed = told.join(told.join(notices_of, "label").groupBy("label", "source").agg(weight), ["label", "source"])
    weighed = weighed.select("label", "features", (F.col("weight") * share).alias("weight"))
    weighed = weighed.union(corpus.select("label", "features", F.col("n") * F.lit(1000 * (1 - OTHERS_SHARE) / max(1, count))))
    model = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=3e-4, elasticNetParam=0.2, maxIter=80, standardization=False
    ).fit(weighed)
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = [(g, c, float(matrix[k, v])) for k, c in enumerate(classes) for v, g in enumerate(vocabulary) if abs(matrix[k, v]) > 1e-6]
    gates = sorted({g for g, _, _ in weights if " " in g})
    made = LicenceModel(classes, [float(x) for x in intercepts], weights, gates, LEAST_PROBABILITY)
    seen = model.transform(rows.where(f"part = 0 and family = '{UNKNOWN}'"))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(classes) - 1))
    least = seen.select(best.alias("best"), "n").groupBy("best").agg(F.sum("n").alias("n")).agg(F.percentile("best", F.lit(UNKNOWN_KEPT), F.col("n"))).first()[0]
    return made._replace(threshold=max(LEAST_PROBABILITY, least or 0.0))


def classify(paragraphs: DataFrame, model: LicenceModel) -> DataFrame:
    """key, family, probability, likeness, confirmed of the paragraphs (key, words) that have a feature.

    family is ``unknown`` if no family's probability reaches the threshold. likeness: the greatest share of a notice's grams that the
    paragraph has, or of the paragraph's grams that the notice has.
    """
    spark = paragraphs.sparkSession
    table = F.broadcast(_table(spark, [{"gram": g, "class": c, "weight": w} for g, c, w in model.weights], "gram:string,class:string,weight:double"))
    grams = paragraphs.select("key", grams_of(F.col("words")).alias("grams"))
    hits = grams.select("key", F.explode("grams").alias("gram")).join(table, "gram")
    sums = hits.groupBy("key").agg(*(F.sum(F.when(F.col("class") == c, F.col("weight")).otherwise(0.0)).alias(f"s{k}") for k, c in enumerate(model.classes)))
    logits = F.array(*(F.col(f"s{k}") + F.lit(b) for k, b in enumerate(model.intercepts)))
    odds = F.transform("logits", lambda z: F.exp(z - F.array_max("logits")))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    scored = sums.select("key", logits.alias("logits")).withColumn("odds", odds).withColumn("p", F.slice(F.transform("odds", lambda x: x / total), 2, len(model.classes) - 1))
    families = F.from_json(F.lit(json.dumps(model.classes[1:])), "array<string>")
    best = F.array_max("p")
    predicted = scored.select(
        "key", best.alias("probability"),
        F.when(best >= model.threshold, F.get(families, F.array_position("p", best).cast("int") - 1)).otherwise(UNKNOWN).alias("family"),
    )
    notices = F.broadcast(_notices(spark).select("family", grams_of(F.col("words")).alias("notice_grams")))
    shared = F.size(F.array_intersect("grams", "notice_grams"))
    likeness = shared / F.least(F.size("notice_grams"), F.size("grams"))
    met = predicted.where(F.col("family") != UNKNOWN).join(grams, "key").join(notices, "family").groupBy("key").agg(F.max(likeness).alias("likeness"))
    out = predicted.join(met, "key", "left").withColumn("likeness", F.coalesce("likeness", F.lit(0.0)))
    return out.select("key", "family", "probability", "likeness", (F.col("likeness") >= CONFIRMED).alias("confirmed"))


def _gated(gates: list[str]) -> Callable[[Column], Column]:
    """Whether words hold one of ``gates``."""
    # a gate that holds a shorter one need not be looked for
    least = [g for g in gates if not any(h != g and f" {h} " in f" {g} " for h in gates)]
    single = sorted({w for g in least for w in g.split(" ")})

    def of(words: Column) -> Column:
        # no run is built but of words that a gate has
        def has(marked: Column) -> Column:
            def at(w: Column, i: Column) -> Column:
                runs = []
                for n in range(2, GRAM + 1):
                    own = [g for g in least if g.count(" ") == n - 1]
                    more = [x for k in range(1, n) for x in (F.lit(" "), F.get(marked, i + k))]
                    runs += [F.concat(w, *more).isin(own)] if own else []
                return F.when(w.isNotNull(), F.coalesce(*(F.when(r, True) for r in runs), F.lit(False))).otherwise(False)

            return F.array_contains(F.transform(marked, at), True)

        return F.get(F.transform(F.array(F.transform(words, lambda w: F.when(w.isin(single), w))), has), F.lit(0))

    return of


def stretches(text: Column, model: LicenceModel) -> Column:
    """What is judged of a text: an array of paragraph, line, words.

    Lines with a gate, numbered from 1 in their paragraph, and as line 0 the stretch from the first to the last of
    several such lines of a paragraph. Every line is cut into words.
    """
    gated = _gated(model.gates)

    def entry(paragraph: Column, line: Column, words: Column) -> Column:
        return F.struct(paragraph.alias("paragraph"), line.cast("int").alias("line"), words.alias("words"))

    def of_paragraph(text: Column, number: Column) -> Column:
        cut = F.transform(F.split(text, "\n"), lambda x, i: entry(number, i + 1, words_of(x)))
        spoken = F.filter(cut, lambda x: gated(x["words"]))

        def with_whole(lines: Column) -> Column:
            first, last = F.get(lines, F.lit(0))["line"], F.get(lines, F.size(lines) - 1)["line"]
            whole = words_of(F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), " "))
            return F.when(F.size(lines) > 1, F.concat(F.array(entry(number, F.lit(0), whole)), lines)).otherwise(lines)

        # the lines are found once and used several times
        return F.get(F.transform(F.array(spoken), with_whole), F.lit(0))

    paragraphs = F.transform(F.split(text, r"\n[\x20\t\x0B\f\r]*\n"), lambda x, i: F.struct(i.alias("number"), x.alias("text")))
    return F.flatten(F.transform(paragraphs, lambda p: of_paragraph(p["text"], p["number"])))


def licences(documents: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): the licence families of its paragraphs.

    families: those of confirmed lines and stretches of lines, sorted, joined by commas. n_paragraphs: lines with a non-space
    character; n_confirmed; n_unconfirmed: predicted, but unlike the family's notices; n_unknown: with a gate, but of no
    family. A stretch of lines is counted only where it is confirmed and none of its lines is. probability: the greatest of
    what is confirmed, else null. Null texts count as empty; null ids and repeated rows stay.
    """
    model = model or fit(documents)
    text = F.coalesce("text", F.lit(""))
    spoken = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")).cast("long")
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), spoken.alias("n_paragraphs"), stretches(text, model).alias("stretches"))
    rows = stage(rows, "licence-paragraphs")
    judged = rows.select("row", F.inline("stretches"))
    judged = classify(judged.select(F.struct("row", "paragraph", "line").alias("key"), "words"), model)
    judged = judged.select("key.*", "family", "probability", "confirmed", (F.col("family") != UNKNOWN).alias("known"))
    of_lines = F.coalesce(F.max(F.when(F.col("line") > 0, F.col("confirmed"))), F.lit(False))
    whole = F.coalesce(F.max(F.when(F.col("line") == 0, F.col("confirmed"))), F.lit(False))
    single = lambda c: F.sum(F.when(F.col("line") > 0, c.cast("long")).otherwise(0))
    by_paragraph = judged.groupBy("row", "paragraph").agg(
        F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("families"),
        (single(F.col("confirmed")) + (whole & ~of_lines).cast("long")).alias("n_confirmed"),
        single(F.col("known") & ~F.col("confirmed")).alias("n_unconfirmed"), single(~F.col("known")).alias("n_unknown"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    )
    counts = ("n_confirmed", "n_unconfirmed", "n_unknown")
    by_row = by_paragraph.groupBy("row").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"),
        *(F.sum(c).alias(c) for c in counts), F.max("probability").alias("probability"),
    )
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "row", "n_paragraphs").join(by_row, "row", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("families", F.lit("")).alias("families"), *(F.coalesce(c, none).alias(c) for c in counts), "probability",
    )
