"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

Features are word pairs and triples of licence statements; every other pair or
triple has weight zero, so a paragraph is scored where it is read, from the few of its n-grams that
have a weight. A multinomial logistic regression is fitted on variants of the statements and a
paragraphs of all of the corpus's own texts. It decides which families a paragraph
may be of: those whose odds against no licence reach a threshold, calibrated on
paragraphs of both kinds that it hasn't seen. A statement of such a family then has to be
found in the paragraph to a sufficient part; where that holds for none of them, the paragraph is "unknown".
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.common import cut, let, uniform

#: Short statements by licence family.
STATEMENTS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "This project is distributed under the Apache 2.0 license."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This software is available under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL, version 2 or later.", "Distributed under the GNU Lesser General Public License."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Distributed under the BSD license."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution ShareAlike License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Public-domain": ["This work is in the public domain.", "Released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "All-rights-reserved": ["All rights reserved.", "Copyright, all rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
NONE, UNKNOWN = "none", "unknown"
#: Share of a statement's n-grams that confirms it.
CONFIRM = 0.6
#: Share of the calibration paragraphs that may be taken for a licence.
FALSE_RATE = 0.001
#: Share of unseen statements that the threshold may miss to keep to FALSE_RATE.
MISSED_RATE = 0.05
#: A second family is told from this part of the likeliest one's probability on.
LEAST_RATIO = 0.001
#: Words too common to tell a licence by.
COMMON = frozenset("a all and any are as at be been by can for from has in is it may no not of or that the this to under use with without you".split())
#: What stands between words, read once and not given back.
GAP = "[^a-z0-9]++"
#: Lines from one window of joined lines to the next; a window has twice as many, so that each run of STEP + 1 lines is in one.
STEP = 8


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _grams(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)})


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\n")


def grams(paragraph: Column) -> Column:
    """Distinct word pairs and triples of a paragraph."""
    words = F.filter(F.split(F.lower(paragraph), r"[^a-z0-9]+"), lambda w: w != "")

    def joined(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
        triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        none = F.array().cast("array<string>")
        return F.when(F.size(w) < 2, none).when(F.size(w) < 3, pairs).otherwise(F.array_distinct(F.concat(pairs, triples)))

    return let(words, joined)


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small constant table."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _statements(found: Column) -> Column:
    """share, family, matched of each statement: the part of its n-grams that ``found`` holds.

    The statements are one literal, so plans stay small however many there are.
    """
    rows = [{"family": family, "grams": _grams(_words(text))} for family, texts in STATEMENTS.items() for text in texts]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,grams:array<string>>>")

    known = F.from_json(F.lit(json.dumps(sorted({g for row in rows for g in row["grams"]}))), "array<string>")

    def option(own: Column, hits: Column) -> Column:
        matched = F.array_intersect(own["grams"], hits)
        return let(matched, lambda m: F.struct((F.size(m) / F.size(own["grams"])).alias("share"), own["family"].alias("family"), m.alias("matched")))

    # Most paragraphs hold none of the n-grams, or few.
    return let(F.array_intersect(found, known), lambda hits: F.transform(table, lambda own: option(own, hits)))


def _containment(found: Column) -> Column:
    """share, family, matched of the statement that ``found`` holds to the largest part."""
    return F.array_max(_statements(found))


def _confirmed(found: Column, families: Column | None = None) -> Column:
    """share, family of each family (of ``families``, if given) of which ``found`` holds a statement to CONFIRM at least.

    A statement counts not if all that is found of it is found of one of another family with more of it.
    """

    def explained(x: Column, every: Column) -> Column:
        return F.exists(every, lambda y: (y["family"] != x["family"]) & (F.size(y["matched"]) > F.size(x["matched"])) & (F.size(F.array_except(x["matched"], y["matched"])) == 0))

    def best(left: Column) -> Column:
        def of(family: Column) -> Column:
            return F.array_max(F.filter(left, lambda x: x["family"] == family))

        each = F.transform(F.array(*map(F.lit, STATEMENTS)), of)
        return F.transform(F.array_compact(each), lambda x: F.struct(x["share"].alias("share"), x["family"].alias("family")))

    near = F.filter(_statements(found), lambda x: (x["share"] >= CONFIRM) & (F.lit(True) if families is None else F.array_contains(families, x["family"])))
    return let(let(near, lambda every: F.filter(every, lambda x: ~explained(x, every))), best)


def _marks() -> list[str]:
    """Words of which each text has one in which a statement is found to CONFIRM: of each statement, words in over 1 - CONFIRM of its n-grams."""
    marks: list[str] = []
    for own in (_grams(_words(text)) for texts in STATEMENTS.values() for text in texts):
        left = [set(g.split()) for g in own]
        least = len(own) - (1 - CONFIRM) * len(own) - 1e-9
        while len(left) >= least:
            counts = Counter(w for g in left for w in g)
            word = max(counts, key=lambda w: (w in marks, w not in COMMON, len(w) > 4, counts[w], w))
            left = [g for g in left if word not in g]
            if word not in marks:
                marks.append(word)
    return marks


def _may_hold(text: Column) -> Column:
    """Whether a word of ``_marks`` is in the text: false only where no statement can be confirmed."""
    return F.exists(F.split(F.lower(text), GAP), lambda w: w.isin(_marks()))


def _following(grams_: list[str]) -> Column:
    """A map from what stands before the last word of each of ``grams_`` to a map from that word to the whole."""
    ways: dict[str, dict[str, str]] = {}
    for gram in grams_:
        before, _, last = gram.rpartition(" ")
        ways.setdefault(before, {})[last] = gram
    return F.from_json(F.lit(json.dumps(ways)), "map<string,map<string,string>>")


def known(paragraph: Column, vocabulary: list[str]) -> Column:
    """Distinct word pairs and triples of a paragraph that are in ``vocabulary``, which holds the pairs of its triples.

    They are looked up word by word, so no other pair or triple is formed.
    """
    pairs, triples = ([g for g in vocabulary if g.count(" ") == n] for n in (1, 2))
    firsts, seconds = (sorted({g.split()[k] for g in pairs}) for k in (0, 1))

    def found(words: Column) -> Column:
        def begun(w: Column, i: Column) -> Column:
            after = F.get(words, i + 1)
            pair = F.element_at(F.element_at(_following(pairs), w), after)
            # A map is searched key by key, so only words of pairs are looked up.
            return F.when(w.isin(firsts) & after.isin(seconds), F.struct(pair.alias("gram"), (i + 2).alias("next")))

        def both(met: Column) -> Column:
            more = F.transform(met, lambda x: F.element_at(F.element_at(_following(triples), x["gram"]), F.get(words, x["next"])))
            return F.array_distinct(F.concat(F.transform(met, lambda x: x["gram"]), F.array_compact(more)))

        return let(F.filter(F.transform(words, begun), lambda x: x["gram"].isNotNull()), both)

    return F.coalesce(let(F.split(F.lower(paragraph), GAP), found), F.array().cast("array<string>"))


def train(texts: DataFrame) -> tuple[list[str], list[str], list[list[float]], list[float], float]:
    """Classes, vocabulary, weights by class, intercepts and the calibrated threshold of P(licence).

    All different texts count, each once, whatever ids they have.
    """
    spark = texts.sparkSession
    classes = [NONE, *STATEMENTS]
    positives, unseen = [], []
    for label, statements in enumerate(STATEMENTS.values(), 1):
        for words in map(_words, statements):
            cuts = [words[:i] + words[i + 1 :] for i in range(len(words))] if len(words) < 12 else []
            positives += [{"label": label, "grams": _grams(w)} for w in [words, words, *cuts[::2], words[: max(3, 2 * len(words) // 3)], words[len(words) // 3 :]]]
            # Not trained on: other words left out, and other words around.
            unseen += [{"grams": _grams(w)} for w in [*cuts[1::2], ["note", *words, "see", "below"]]]
    vocabulary = sorted({g for row in positives for g in row["grams"]})
    held = uniform(F.col("text"), F.lit(29)) < 0.25
    # Of each text once, not of each of its paragraphs.
    whole = texts.where(F.col("text").isNotNull()).select("text", F.sha2("text", 256).alias("t"), held.alias("held"))
    each = whole.select("t", "held", F.explode(F.array_distinct(paragraphs(F.col("text")))).alias("p"))
    # Two words make a pair.
    each = each.where(F.lower("p").rlike(f"[a-z0-9]{GAP}[a-z0-9]")).select("t", "held", F.array_sort(known(F.col("p"), vocabulary)).alias("grams"))
    # Equal texts count once: what they hold is divided by their number, so no text is shuffled.
    each = each.groupBy("t", "held", "grams").agg(F.count("*").alias("n")).join(whole.groupBy("t").agg(F.count("*").alias("copies")), "t")
    plain = each.select("held", "grams", F.expr("n div copies").alias("n"))
    # Paragraphs of the same n-grams are one example of their number; most have none.
    plain = cut(plain.groupBy("held", "grams").agg(F.sum("n").cast("double").alias("weight")).where(_containment(F.col("grams"))["share"] < CONFIRM / 2), "paragraphs")
    n_seen, n_held = (x or 0.0 for x in plain.agg(F.sum(F.when(~F.col("held"), F.col("weight"))), F.sum(F.when(F.col("held"), F.col("weight")))).first())
    examples = plain.where("not held").select(F.lit(0.0).alias("label"), "grams", "weight")
    own = _table(spark, positives, "label:double,grams:array<string>").withColumn("weight", F.lit(max(1.0, n_seen / len(positives))))
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    vectorizer.setBinary(True)
    rows = vectorizer.transform(examples.unionByName(own)).select("label", "features", "weight").coalesce(8)
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, weightCol="weight").fit(rows)
    weights, intercepts = fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()

    def odds(df: DataFrame) -> DataFrame:
        return df.where(F.size("grams") > 0).withColumn("odds", judge(F.col("grams"), vocabulary, weights, intercepts)["odds"])

    false = odds(plain.where("held"))
    n_scored = false.agg(F.sum("weight")).first()[0] or 0.0
    # The paragraphs with no known n-gram aren't scored; they rank below all others.
    share = 1 - min(1.0, FALSE_RATE * max(n_held, 1.0) / max(n_scored, 1.0))
    high = false.agg(F.percentile("odds", share, F.col("weight").cast("bigint"))).first()[0]
    least = odds(_table(spark, unseen, "grams:array<string>").withColumn("grams", F.filter("grams", lambda g: g.isin(vocabulary)))).agg(F.percentile("odds", MISSED_RATE)).first()[0]
    return classes, vocabulary, weights, intercepts, float(min(max(0.5, high or 0.5), max(0.5, least)))


def judge(found: Column, vocabulary: list[str], weights: list[list[float]], intercepts: list[float]) -> Column:
    """p_licence, odds_each (a family's share of what it and no licence have), odds (the largest) and best (class index) of an array of n-grams of ``vocabulary``."""
    table = F.from_json(F.lit(json.dumps({g: [round(own[i], 8) for own in weights] for i, g in enumerate(vocabulary)})), "map<string,array<double>>")
    start = F.from_json(F.lit(json.dumps(intercepts)), "array<double>")
    logits = F.aggregate(found, start, lambda z, g: F.zip_with(z, F.element_at(table, g), lambda a, b: a + b))

    def shares(z: Column) -> Column:
        none, top, families = F.get(z, F.lit(0)), F.array_max(z), F.slice(z, 2, len(intercepts) - 1)
        total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        # A family far less likely than the best one isn't told, whatever its odds.
        each = F.transform(families, lambda x: F.when(F.exp(x - top) >= LEAST_RATIO, 1 / (1 + F.exp(none - x))).otherwise(0.0))
        best = F.array_position(families, F.array_max(families)).cast("int")
        return F.struct((1 - F.exp(none - top) / total).alias("p_licence"), each.alias("odds_each"), F.array_max(each).alias("odds"), best.alias("best"))

    return let(logits, shares)


def _likely(texts: DataFrame, model: tuple) -> DataFrame:
    """Rows of (doc_id, paragraph, p, ...) that the classifier takes for a licence, with p_licence, predicted (the likeliest), families and grams."""
    classes, vocabulary, weights, intercepts, threshold = model
    hits = let(known(F.col("p"), vocabulary), lambda h: F.when(F.size(h) > 0, judge(h, vocabulary, weights, intercepts)))
    # Exploding keeps the judgement from being taken again for every column read from it.
    met = texts.withColumn("j", F.explode(F.filter(F.array(hits), lambda j: j["odds"] >= threshold)))
    names = F.array(*[F.lit(c) for c in classes])
    told = F.filter(F.transform(F.col("j.odds_each"), lambda o, i: F.when(o >= threshold, F.get(names, i + 1))), lambda c: c.isNotNull())
    return met.select(*texts.columns, F.col("j.p_licence").alias("p_licence"), F.get(names, F.col("j.best")).alias("predicted"), told.alias("families"), grams(F.col("p")).alias("grams"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph taken for a licence and family: doc_id, paragraph, family, predicted, probability, confirmed_share, n_chars.

    Paragraphs are lines, numbered from 0, and windows of 2 * STEP lines from every STEP-th on, numbered by their first
    line. A line has a row for each family that the classifier gives it and of which a statement is found to CONFIRM
    at least, or one of family "unknown". A window has rows only for families that are so found in it, but in none of its lines and not in
    what it shares with the window before. Null and empty texts have no licence. An empty table gives an
    empty result; rows that repeat an id and a text give each row once; other columns aren't read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(texts)
    lines = _likely(texts.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "p")), model)
    none = F.transform(F.array(_containment(F.col("grams"))), lambda x: F.struct(x["share"].alias("share"), F.lit(UNKNOWN).alias("family")))
    lines = lines.withColumn("found", let(_confirmed(F.col("grams"), F.col("families")), lambda c: F.when(F.size(c) > 0, c).otherwise(none)))

    split = texts.select("doc_id", paragraphs(F.col("text")).alias("lines")).where((F.size("lines") > 1) & _may_hold(F.col("text")))
    starts = F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(STEP)))
    windows = split.select("doc_id", "lines", starts.alias("paragraph")).where((F.col("paragraph") == 0) | (F.col("paragraph") + STEP < F.size("lines")))
    windows = windows.select("doc_id", "paragraph", F.slice("lines", F.col("paragraph") + 1, F.lit(2 * STEP)).alias("lines")).withColumn("p", F.array_join("lines", "\n"))
    windows = windows.where(_may_hold(F.col("p")))
    windows = _likely(windows, model)
    shared = F.when(F.col("paragraph") > 0, F.array_join(F.slice("lines", 1, STEP), "\n"))
    parts = F.array_compact(F.array_append(F.col("lines"), shared))
    told = F.flatten(F.transform(parts, lambda x: F.transform(_confirmed(grams(x)), lambda f: f["family"])))
    windows = windows.withColumn("found", _confirmed(F.col("grams"), F.col("families"))).where(F.size("found") > 0).withColumn("told", told)
    windows = windows.withColumn("found", F.filter("found", lambda f: ~F.array_contains("told", f["family"])))

    cols = ["doc_id", "paragraph", "p", "p_licence", "predicted", "found"]
    met = lines.select(cols).unionByName(windows.select(cols)).withColumn("f", F.explode("found"))
    return met.select(
        "doc_id", "paragraph", F.col("f.family").alias("family"), "predicted",
        F.round("p_licence", 6).alias("probability"), F.round("f.share", 6).alias("confirmed_share"), F.char_length("p").cast("bigint").alias("n_chars"),
    )
