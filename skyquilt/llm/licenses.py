"""Licence scan: a trained paragraph classifier with an unknown class and template comparison.

Paragraphs are lines. Features are word bigrams that occur in the licence templates below (their number is
fixed by the templates). A multinomial logistic regression is fitted over the licence families, "unknown"
(licence-like text of no family) and "none" on windows of the templates and, for "none", on PROSE and about NEGATIVES
different lines of the input that name no licence and share less than NEAR of any template's bigrams (those with the
lowest hashes, by their share of the hash range). Its threshold is calibrated on windows held out of the fit.
A prediction is confirmed by comparison with the family's templates: CONTAINED of a template's bigrams stand in
the paragraph, or of the paragraph's bigrams in a template. A family that is predicted but too unsure or
unconfirmed becomes "unknown", if the line names a licence or half of CONTAINED is reached, however unsure it is.

Every line of every document is scored: its bigrams meet the broadcast vocabulary, and only those found in it
go on. A line without any has no evidence and is "none".

Defined results: null and empty texts have no licence; one-word lines have no bigram; equal rows have equal
results, as a line counts once however often its row is repeated; ties of classes go to the first of CLASSES; an
empty table gives an empty result. Names of the input cannot clash, as only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, cut, doc_key, table

NEGATIVES = 2000
WINDOWS = (6, 9, 14)
HELD_OUT = 5
CONTAINED = 0.6
PRECISION = 0.99
#: A line with this part of a template's bigrams, or NEAR_GRAMS of one that are this part of its own, is no example of "none".
NEAR = 0.3
NEAR_GRAMS = 4
NAMED = r"licen[cs]|copyright|rights reserved|public domain"
# Notices as the licences word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public_domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    ("unknown", "Use of this material is subject to the license agreement."),
    ("unknown", "See the LICENSE file for license terms."),
    ("unknown", "Licensed under the terms of the accompanying license."),
    ("unknown", "Released under a license of its own."),
)
#: Examples of "none" that are there whatever the input is, so that every class can be fitted.
PROSE = ("It rained all night and the river rose.", "She put the letters back and closed the drawer.", "Prices went up again in the spring.")
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
CLASSES = (*FAMILIES, "none")


def bigrams(line: Column) -> Column:
    """Distinct hashes of neighbouring words; a word is a run of ASCII letters and digits."""
    words = F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))))[0]
    return F.array_distinct(F.coalesce(pairs, F.array().cast("array<bigint>")))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, f, t) for i, (f, t) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, family string, line string")


def vocabulary(spark: SparkSession) -> DataFrame:
    """gram, its index from 0, and the templates that hold it."""
    held = templates(spark).select("template", F.explode(bigrams(F.col("line"))).alias("gram")).groupBy("gram").agg(F.sort_array(F.collect_set("template")).alias("templates"))
    sorted_grams = held.agg(F.sort_array(F.collect_list("gram")).alias("all"))
    index = sorted_grams.select(F.posexplode("all").alias("feature", "gram"))
    return held.join(F.broadcast(index), "gram")


def near_template(line: Column, held: list[list[int]]) -> Column:
    """Whether a line has NEAR of the bigrams of a template, or is made of them by that part. held: bigrams by template."""
    array = lambda grams: F.array(*[F.lit(g) for g in grams])
    every = array(sorted({g for grams in held for g in grams}))

    def judged(both: Column) -> Column:
        def one(grams: list[int]) -> Column:
            t = F.size(F.array_intersect(both["common"], array(grams)))
            return (t >= NEAR * len(grams)) | (t >= NEAR_GRAMS) & (t >= NEAR * both["n"])

        return F.when(F.size(both["common"]) > 0, F.greatest(*[one(grams) for grams in held if grams])).otherwise(F.lit(False))

    return bind(bind(bigrams(line), lambda g: F.struct(F.array_intersect(g, every).alias("common"), F.size(g).alias("n"))), judged)


def examples(lines: DataFrame) -> DataFrame:
    """Labelled (family, line): templates, their windows, and lines that name no licence."""
    known = templates(lines.sparkSession)
    parts = F.split("line", " ")
    windows = [known.select("family", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - w + 1)), lambda i: F.concat_ws(" ", F.slice(parts, i, w)))).alias("line")) for w in WINDOWS]
    positive = known.select("family", "line")
    for w in windows:
        positive = positive.unionByName(w)
    plain = lines.select("line", F.xxhash64("line").alias("h")).filter((F.length("line") > 0) & ~F.lower("line").rlike(NAMED))
    held = [r.grams for r in known.orderBy("template").select(bigrams(F.col("line")).alias("grams")).collect()]  # as many as the templates have
    far = ~near_template(F.col("line"), held)
    different = plain.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, NEGATIVES / max(1, different))
    low = F.shiftrightunsigned("h", 1) <= F.lit(min(2**63 - 1, int(share * 2**62) * 2))
    negative = plain.filter(low).filter(far).select(F.lit("none").alias("family"), "line").distinct()
    negative = negative.unionByName(lines.sparkSession.createDataFrame([("none", t) for t in PROSE], "family string, line string"))
    return positive.distinct().unionByName(negative)


def classifier(lines: DataFrame) -> tuple[DataFrame, list[float], float]:
    """(feature weights by gram, intercepts by class, threshold), fitted on ``examples``."""
    spark = lines.sparkSession
    words = cut(vocabulary(spark))
    ordered = [r.gram for r in words.orderBy("feature").collect()]  # as many as the templates have
    size = len(ordered)
    present = F.transform(F.array(*[F.lit(g) for g in ordered]), lambda g: F.array_contains("grams", g).cast("double"))
    dense = examples(lines).withColumn("grams", bigrams(F.col("line"))).withColumn("x", array_to_vector(present))
    label = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("family")) - 1
    data = cut(dense.select("line", "family", "x", label.cast("double").alias("label")).repartition(4, "line"))
    held = (F.pmod(F.xxhash64("line"), F.lit(HELD_OUT)) == 0) & ~F.col("line").isin([t for _, t in TEMPLATES])
    fit = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=40, regParam=0.002, elasticNetParam=0.0)
    trial = fit.fit(data.filter(~held))
    tried = trial.transform(data.filter(held)).select((F.col("prediction") == F.col("label")).alias("right"), F.array_max(vector_to_array("probability")).alias("p")).filter("prediction <> %d" % (len(CLASSES) - 1))
    steps = [0.3 + 0.05 * i for i in range(14)]
    rates = tried.agg(*[F.avg(F.when(F.col("p") >= s, F.col("right").cast("double"))) for s in steps]).first()
    threshold = next((s for s, r in zip(steps, rates) if r is None or r >= PRECISION), steps[-1])
    model = fit.fit(data)
    matrix = model.coefficientMatrix.toArray()
    weights = spark.createDataFrame([(i, [float(v) for v in matrix[:, i]]) for i in range(size)], "feature int, weights array<double>")
    return words.join(F.broadcast(weights), "feature"), [float(v) for v in model.interceptVector], threshold


def _lines(documents: DataFrame) -> DataFrame:
    keyed = documents.select(doc_key(), F.coalesce("text", F.lit("")).alias("text"))
    return keyed.select("__doc", F.xxhash64("text").alias("__hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """(__doc, __hash, at, family, p): every line with licence evidence and its class, "none" left out."""
    lines = _lines(documents)
    words, intercepts, threshold = classifier(lines)
    sizes = [r.n for r in templates(lines.sparkSession).select(F.size(bigrams(F.col("line"))).alias("n"), "template").orderBy("template").collect()]
    grams = lines.withColumn("grams", bigrams(F.col("line"))).select("__doc", "__hash", "at", F.size("grams").alias("n"), F.lower("line").rlike(NAMED).alias("named"), F.explode("grams").alias("gram"))
    once = grams.join(F.broadcast(words.select("gram")), "gram").dropDuplicates(["__doc", "__hash", "at", "gram"])
    hits = once.join(F.broadcast(words), "gram")
    by_line = hits.groupBy("__doc", "__hash", "at", "n", "named").agg(
        *[F.sum(F.get("weights", F.lit(k))).alias(f"w{k}") for k in range(len(CLASSES))], *[F.count_if(F.array_contains("templates", F.lit(t))).alias(f"t{t}") for t in range(len(TEMPLATES))]
    )
    logits = F.array(*[F.col(f"w{k}") + intercepts[k] for k in range(len(CLASSES))])
    shared = [F.greatest(F.col(f"t{t}") / max(1, sizes[t]), F.col(f"t{t}") / F.col("n")) for t in range(len(TEMPLATES))]
    likest = [F.greatest(F.lit(0.0), *[shared[t] for t, (f, _) in enumerate(TEMPLATES) if f == family]) for family in FAMILIES]
    scored = by_line.select("__doc", "__hash", "at", "named", logits.alias("z"), F.array(*likest, F.lit(0.0)).alias("likest"))
    top = scored.withColumn("m", F.array_max("z")).withColumn("k", (F.array_position("z", F.col("m")) - 1).cast("int"))
    p = 1 / F.aggregate("z", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("m")))
    names = F.array(*[F.lit(c) for c in CLASSES])
    named = top.withColumn("p", p).withColumn("c", F.get(names, F.col("k"))).filter("c <> 'none'")
    sure = (F.col("p") >= threshold) & (F.get("likest", F.col("k")) >= CONTAINED)
    doubt = F.col("c").eqNullSafe("unknown") | ~sure
    # What names no licence and is not half like any template is prose that shares a few words with one.
    out = named.withColumn("family", F.when(doubt, F.lit("unknown")).otherwise(F.col("c")))
    return out.filter((F.col("family") != "unknown") | F.col("named") | (F.array_max("likest") >= CONTAINED / 2)).select("__doc", "__hash", "at", "family", "p")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, families (sorted, comma-joined, without "unknown"), n_licence and n_unknown lines of every document."""
    found = paragraphs(documents).groupBy("__doc", "__hash").agg(
        F.array_join(F.array_remove(F.sort_array(F.collect_set("family")), "unknown"), ",").alias("families"), F.count_if(F.col("family") != "unknown").alias("n_licence"), F.count_if(F.col("family") == "unknown").alias("n_unknown")
    )
    keyed = documents.select("doc_id", doc_key(), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"))
    joined = keyed.join(found, ["__doc", "__hash"], "left")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"))


def query(spark, sf_dir):
    """op9: licence families in the whole of documents."""
    return scan(table(spark, sf_dir, "documents"))
