"""Licence notices found by a trained classifier of paragraphs and confirmed by templates.

Features of a paragraph are its runs of one to three words that occur in a licence template.  A
multinomial logistic regression tells the families and the class of unknown paragraphs.  It is trained on variants of the templates, with words left
out and put between words of the corpus, and on at most ``BACKGROUND`` paragraphs of the corpus that
share few runs with any template.  A temperature, fitted on variants and paragraphs that were not
trained on, calibrates its probabilities.

A paragraph is a stretch of consecutive lines with words, comment marks left out, so a notice may be
wrapped in any way.  Places in it that hold enough of the runs of three words of a template are
candidates if they have the words by which the template names its family (``NAMES``) and no negation
that the template has not; of those that overlap, the one that holds most of its template stands.
The words of the place are scored, and it is a notice if the classifier names the family of the
template.  The unknown class is trained on templates without their names and with negations too.

Only paragraphs with a word of a set that every confirmed place has a word of are looked at further;
the set follows from the templates alone.  No statistic of the corpus decides what is looked at: the
sample serves the fit only.  All steps are DataFrame operations and JVM models.

Defined results: NULL and empty texts have no paragraphs; places without a confirmed family above
the threshold give no row; the same notice twice gives two rows, also in one paragraph.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmine.llm.common import bound, settle

BACKGROUND = 3_000
COPIES = 40
THRESHOLD = 0.5
CONFIRMED = 0.5
UNKNOWN = "unknown"
# What is between paragraphs, lines of marks alone among it, and words that mark a
# comment; all other marks are no words.
BLANK = "\\n(?:[^\\p{L}0-9\\n]*\\n)+"
COMMENT_WORD = "(?im)^[ \\t]*(?:dnl|@?rem|c)(?=[ \\t])"
# Words that are in most texts; which they are decides about speed alone.
PLAIN = set("a an and any are as at be by for from in is it may not of on or see that the this to under "
            "use with without you even more work 0 2 3 4".split())

# Usual notices of licence families.
TEMPLATES = {
    "Apache-2.0": [
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "MIT": [
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
        "This project is licensed under the MIT License",
    ],
    "GPL-3.0": [
        "SPDX-License-Identifier: GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details",
    ],
    "LGPL": [
        "SPDX-License-Identifier: LGPL-3.0",
        "under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation",
    ],
    "CC-BY-NC": [
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License",
    ],
    "CC-BY": [
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "BSD": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
    ],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
}


# Stretches of words by which a notice names its family.  A place must hold those that
# its template has.
NAMES = {
    "Apache-2.0": ["apache", "version 2 0", "apache 2 0"],
    "MIT": ["mit"],
    "GPL-3.0": ["gnu general", "version 3", "gpl 3 0"],
    "LGPL": ["lesser general", "lgpl"],
    "CC-BY-NC": ["by nc 4", "attribution noncommercial 4"],
    "CC-BY": ["by 4 0", "attribution 4 0"],
    "BSD": ["bsd"],
    "MPL-2.0": ["mozilla", "v 2 0", "mpl 2 0"],
}
# Words that turn a notice into its contrary, and how far before it they do.
NEGATIONS = ["not", "never", "neither", "nor", "cannot", "isn", "wasn", "aren"]
BEFORE = 3


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}0-9]+"), lambda w: w != "")


def runs(words: Column, n: int) -> Column:
    """Distinct runs of ``n`` words."""
    return bound(words, lambda given: F.array_distinct(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(given)), lambda i: i + n <= F.size(given)),
        lambda i: F.array_join(F.slice(given, i + 1, n), " "),
    )))


def _features(words: Column) -> Column:
    return bound(words, lambda given: F.concat(runs(given, 1), runs(given, 2), runs(given, 3)))


def template_table(spark: SparkSession) -> DataFrame:
    """``template, family, words, names, grams``: grams are runs of three words, names the words
    that name the family."""
    rows = [
        (i, family, text, sorted({w for n in _template_names(family, text) for w in n.split(" ")}))
        for i, (family, text) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)
    ]
    table = spark.createDataFrame(
        rows, "template int, family string, text string, names array<string>")
    return table.select(
        "template", "family", words_of(F.col("text")).alias("words"), "names"
    ).withColumn("grams", runs(F.col("words"), 3))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.posexplode(F.split(text_col, BLANK)).alias("paragraph", "block")
    )


def _block_words(block: Column) -> Column:
    return words_of(F.regexp_replace(block, COMMENT_WORD, ""))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, paragraph, words`` of each stretch of lines of a text that have words."""
    blocks = _blocks(docs, id_col, text_col)
    return blocks.select("id", "paragraph", _block_words(F.col("block")).alias("words")).where(
        F.size("words") > 0
    )


def _some(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents that a hash decides on, about four times ``BACKGROUND`` of them."""
    share = int(min(1.0, 4 * BACKGROUND / max(1, docs.count())) * 1_000_000) + 1
    return docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)) < share)


@dataclass
class Classifier:
    """``temperature`` divides logits."""

    vectorizer: CountVectorizerModel
    model: LogisticRegressionModel
    classes: list[str]
    temperature: float


def _variants(templates: DataFrame, background: DataFrame) -> DataFrame:
    """``label, words, part``: templates with words left out, between words of the corpus.

    The words that name the family stay; the same without them, or with a negation before, is of the
    unknown class.
    """
    around = background.select(
        F.pmod(F.xxhash64("words"), F.lit(64)).alias("cell"), F.slice("words", 1, 30).alias("near")
    ).groupBy("cell").agg(F.min("near").alias("near"))
    nameless = F.filter("words", lambda w: ~F.array_contains("names", w))
    denied = F.concat(F.slice("words", 1, 1), F.array(F.lit("not")), F.expr("slice(words, 2, 999)"))
    given = templates.select("family", "words", "names").union(
        templates.where(F.size("names") > 0).select(F.lit(UNKNOWN), nameless, "names")
    ).union(templates.where(F.size("names") > 0).select(F.lit(UNKNOWN), denied, "names"))
    copies = given.select(
        "family", "words", "names", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")
    ).withColumn("cell", F.pmod(F.xxhash64("words", "copy"), F.lit(64)))
    left_out = F.filter("words", lambda w, i: F.array_contains("names", w) | w.isin("not") | (F.pmod(
        F.xxhash64(w, i, F.col("copy")), F.lit(100)) >= F.when(F.col("copy") % 4 == 0, 0).otherwise(12)))
    near = F.coalesce("near", F.array().cast("array<string>"))
    cut = (F.pmod(F.xxhash64("copy", "cell"), F.lit(15)) + 1).cast("int")
    joined = copies.join(around, "cell", "left").withColumn("cut", cut).withColumn(
        "near", F.when(F.col("copy") % 3 == 0, F.array().cast("array<string>")).otherwise(near)
    )
    return joined.select(
        F.col("family").alias("class"),
        F.concat(F.expr("slice(near, 1, cut)"), left_out, F.expr("slice(near, cut + 1, 30)"))
        .alias("words"),
        (F.col("copy") % 5).alias("part"),
    )


def train(spark: SparkSession, parts: DataFrame) -> Classifier:
    """Fits a classifier.  ``parts`` are paragraphs as of `paragraphs`."""
    templates = template_table(spark)
    sample = settle(
        parts.select("words").orderBy(F.xxhash64("id", "paragraph"), "id", "paragraph")
        .limit(BACKGROUND),
        "licence-background",
    )
    grams = sorted({r[0] for r in templates.select(F.explode("grams")).collect()})
    known = F.array(*map(F.lit, grams))
    other = sample.where(F.size(F.array_intersect(runs(F.col("words"), 3), known)) < 2)
    features = sorted(
        r[0] for r in templates.select(F.explode(_features(F.col("words"))).alias("f")).distinct()
        .collect()
    )
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    rows = _variants(templates, other).union(
        other.select(F.lit(UNKNOWN), "words", F.pmod(F.xxhash64("words"), F.lit(5)))
    )
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("class")) - 1
    vectorizer = CountVectorizerModel.from_vocabulary(features, "features", "vector").setBinary(True)
    ready = settle(
        rows.select(label.cast("double").alias("label"), _features(F.col("words")).alias("features"),
                    "part"),
        "licence-training",
    )
    vectors = vectorizer.transform(ready)
    fitted = LogisticRegression(
        featuresCol="vector", regParam=0.001, elasticNetParam=0.5, maxIter=30, family="multinomial",
    ).fit(vectors.where("part <> 0"))
    temperature = _temperature(fitted, vectors.where("part = 0"))
    return Classifier(vectorizer, fitted, classes, temperature)


def _softmax(raw: Column, temperature: float) -> Column:
    powers = bound(raw, lambda given: F.transform(
        given, lambda x: F.exp((x - F.array_max(given)) / temperature)))
    return bound(powers, lambda given: F.transform(
        given, lambda p: p / F.aggregate(given, F.lit(0.0), lambda a, b: a + b)))


def _temperature(model: LogisticRegressionModel, held: DataFrame) -> float:
    """The temperature of the least loss on rows that were not trained on, of a few steps."""
    raw = model.transform(held).select("label", vector_to_array("rawPrediction").alias("raw"))
    steps = [2.0 ** (i / 2) for i in range(-4, 7)]
    losses = raw.select(*[
        F.avg(-F.log(F.greatest(F.element_at(
            _softmax(F.col("raw"), t), (F.col("label") + 1).cast("int")), F.lit(1e-12))))
        .alias(f"t{i}") for i, t in enumerate(steps)
    ]).first()
    found = [(loss, t) for loss, t in zip(losses, steps, strict=True) if loss is not None
             and not math.isnan(loss)]
    return min(found)[1] if found else 1.0


def _needed_words(templates: list[list[str]], confirmed: float) -> list[str]:
    """Words such that runs of a template without any of them are not enough to confirm it.

    Of each template, words of the most of its runs left, rare ones of the language if they do.
    """
    needed: set[str] = set()
    for grams in templates:
        left = [g for g in grams if needed.isdisjoint(g.split(" "))]
        while left and len(left) >= confirmed * len(grams):
            words = sorted({w for g in left for w in g.split(" ")})
            word = min(words, key=lambda w: (w in PLAIN, -sum(w in g.split(" ") for g in left), w))
            needed.add(word)
            left = [g for g in left if word not in g.split(" ")]
    return sorted(needed)


def _meant_in(words: Column, family: str, text: str) -> Callable[[Column], Column]:
    """Whether a place of a template holds the names that the template has, and no more negations,
    in it or right before, than the template."""
    names = _template_names(family, text)
    allowed = sum(w in NEGATIONS for w in _template_words(text))

    def is_meant(place: Column) -> Column:
        first = F.greatest(place["first"] - BEFORE, F.lit(0))
        around = F.slice(words, first + 1, place["last"] + 3 - first)
        own = F.slice(words, place["first"] + 1, place["last"] - place["first"] + 3)
        held = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        meant = F.size(F.filter(around, lambda w: w.isin(NEGATIONS))) <= allowed
        for name in names:
            meant = meant & held.contains(f" {name} ")
        return meant

    return is_meant


def _places(hits: Column, template: int, family: str, grams: list[str], confirmed: float) -> Column:
    """Where a text holds at least the share ``confirmed`` of the runs of a template.

    ``hits``: ``at, gram`` in the order of the text.  Runs are gathered until one comes again or is
    far from the one before.  Gathered runs that are enough are a place; of others, the earlier of
    two equal ones goes.
    """
    far = 2 * (len(grams) + 2)
    hit = "struct<at:int,gram:string>"
    place = "struct<first:int,last:int,share:double,n:int,template:int,family:string>"

    def enough(runs_: Column) -> Column:
        return F.size(runs_) >= F.lit(confirmed * len(grams))

    def as_place(gathered: Column) -> Column:
        last = F.element_at(gathered, -1)["at"]
        close = F.filter(gathered, lambda g: last - g["at"] < far)
        return bound(F.when(enough(close), close).otherwise(gathered), lambda g: F.struct(
            F.element_at(g, 1)["at"].alias("first"), F.element_at(g, -1)["at"].alias("last"),
            (F.size(g) / len(grams)).alias("share"), F.size(g).alias("n"),
            F.lit(template).alias("template"), F.lit(family).alias("family"),
        ).cast(place))

    def with_last(state: Column) -> Column:
        return F.when(enough(state["open"]), F.concat(
            state["done"], F.array(as_place(state["open"])))).otherwise(state["done"])

    def step(state: Column, h: Column) -> Column:
        opened = state["open"]
        ends = enough(opened) & (
            F.exists(opened, lambda g: g["gram"] == h["gram"])
            | (h["at"] - F.element_at(opened, -1)["at"] >= far)
        )
        return F.struct(
            F.when(ends, with_last(state)).otherwise(state["done"]).alias("done"),
            F.when(ends, F.array(h)).otherwise(
                F.concat(F.filter(opened, lambda g: g["gram"] != h["gram"]), F.array(h))
            ).alias("open"),
        )

    own = F.filter(hits, lambda h: h["gram"].isin(grams))
    start = F.struct(F.array().cast(f"array<{place}>").alias("done"),
                     F.array().cast(f"array<{hit}>").alias("open"))
    return F.when(enough(F.array_distinct(F.transform(own, lambda h: h["gram"]))),
                  F.aggregate(own, start, step, with_last)).otherwise(
        F.array().cast(f"array<{place}>"))


def _best_places(places: Column) -> Column:
    """Of places that overlap, the one of the largest share, then of most runs."""
    ranked = F.array_sort(places, lambda a, b: F.when(a["share"] != b["share"], F.when(
        a["share"] > b["share"], -1).otherwise(1)).when(a["n"] != b["n"], b["n"] - a["n"])
        .when(a["first"] != b["first"], a["first"] - b["first"])
        .otherwise(a["template"] - b["template"]))
    # A run is of three words, so it overlaps those that start at its next two.
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, p: F.when(
        F.exists(kept, lambda k: (k["first"] <= p["last"] + 2) & (p["first"] <= k["last"] + 2)), kept
    ).otherwise(F.concat(kept, F.array(p))))


def licence_notices(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    confirmed: float = CONFIRMED,
    classifier: Classifier | None = None,
) -> DataFrame:
    """Id, ``paragraph, family, probability, similarity`` of each licence notice.

    ``paragraph`` is the number of its paragraph in the text; ``similarity`` is the share of the
    best template's runs of three words that its place holds.
    """
    spark = docs.sparkSession
    fitted = classifier or train(spark, paragraphs(_some(docs, id_col, text_col), id_col, text_col))
    texts = [(family, text) for family, ts in TEMPLATES.items() for text in ts]
    templates = [(i, family, _template_grams(text)) for i, (family, text) in enumerate(texts)]
    needed = F.array(*map(F.lit, _needed_words([t[2] for t in templates], confirmed)))
    known = sorted({g for _, _, grams in templates for g in grams})
    # Written, so that neither words nor places nor scores are computed again for each of their uses.
    hopeful = settle(
        _blocks(docs, id_col, text_col)
        .where(F.arrays_overlap(_block_words(F.col("block")), needed))
        .select("id", "paragraph", _block_words(F.col("block")).alias("words")),
        "hopeful-paragraphs",
    )
    every = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: i + 3 <= F.size("words")),
        lambda i: F.struct(i.alias("at"), F.concat_ws(
            " ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("gram")),
    )
    hits = settle(
        hopeful.withColumn("hits", F.filter(every, lambda h: h["gram"].isin(known)))
        .where(F.size("hits") > 0),
        "template-runs",
    )
    found = settle(
        hits.withColumn("places", F.concat(*[
            F.filter(_places(F.col("hits"), *template, confirmed), _meant_in(F.col("words"), *own))
            for template, own in zip(templates, texts, strict=True)
        ])).where(F.size("places") > 0).drop("hits"),
        "template-places",
    )
    places = settle(
        found.withColumn("place", F.explode(_best_places(F.col("places")))).select(
            "id", "paragraph", "place",
            F.expr("slice(words, place.first + 1, place.last - place.first + 3)").alias("words")),
        "notice-places",
    )
    vectors = fitted.vectorizer.transform(
        places.withColumn("features", _features(F.col("words")))
    )
    scored = settle(
        fitted.model.transform(vectors).select(
            "id", "paragraph", "place", vector_to_array("rawPrediction").alias("raw")),
        "scored-places",
    )
    chance = settle(
        scored.select("id", "paragraph", "place",
                      _softmax(F.col("raw"), fitted.temperature).alias("chance")),
        "place-chances",
    )
    best = chance.withColumn(
        "probability", F.array_max("chance")
    ).withColumn("family", F.element_at(
        F.array(*map(F.lit, fitted.classes)),
        F.array_position("chance", F.col("probability")).cast("int"),
    )).where((F.col("family") == F.col("place.family")) & (F.col("probability") >= threshold))
    return best.select(
        F.col("id").alias(id_col), "paragraph", "family", "probability",
        F.col("place.share").alias("similarity"),
    )


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _template_names(family: str, text: str) -> list[str]:
    """The names of the family that a template has."""
    held = f" {' '.join(_template_words(text))} "
    return [name for name in NAMES[family] if f" {name} " in held]


def _template_grams(text: str) -> list[str]:
    words = _template_words(text)
    return list(dict.fromkeys(" ".join(words[i : i + 3]) for i in range(max(0, len(words) - 2))))
