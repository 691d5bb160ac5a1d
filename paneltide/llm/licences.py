"""Licence scan: a trained paragraph classifier, calibrated, with template comparison.

Paragraphs (lines) are described by the word pairs that stand in them, of those that the training texts hold. A sparse
multinomial logistic regression (elastic net) learns the families from whole licence texts (licence_texts/), by
paragraph and by wrapped line, and from notices made of NOTICES and NAMES; the unknown class from sentences that name
no licence and from lines of the corpus, at most SAMPLE_LINES of at most SAMPLE_TEXTS documents, chosen by hash. A
quarter of the rows is kept apart; the temperature is fitted on it, so probabilities are calibrated, and a paragraph
whose best family stays below LEAST_PROBABILITY is unknown. A prediction is confirmed if one of the family's templates
(the paragraphs and notices learned from) and the paragraph hold enough of the pairs of the shorter of the two.

Only DataFrame functions on the documents. Pairs are hashes of two words; they meet the weights, whose table is bounded
by the training texts, in a broadcast join, so that only paragraphs with template pairs are ever shuffled, by document
and paragraph: hot sources, copies and common words meet in no key. A line costs time in proportion to its length.

Null and empty texts have no paragraphs. Rows that repeat both id and text give each finding once. A null id is an
id of its own. Families of equal probability: the first in the order of FAMILIES. Templates of equal share: the last by
name. Other columns of docs play no part.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table

#: The files of licence_texts that teach a family.
TEXTS: dict[str, list[str]] = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL": ["GPL-2", "GPL-3"],
    "LGPL": ["LGPL-2.1", "LGPL-3"],
    "BSD": ["BSD"],
    "MPL-2.0": ["MPL-2.0"],
    "ISC": ["ISC"],
    "CC0": ["CC0-1.0"],
    "Artistic": ["Artistic"],
}
#: Names by which a notice refers to a family.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT/X11 License", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2 or later", "GNU GPL", "GPLv3", "GPL-2.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3"],
    "BSD": ["BSD License", "3-Clause BSD License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC"],
    "CC-BY": ["Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY", "CC-BY-3.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA", "CC-BY-SA-3.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC", "CC-BY-NC-3.0"],
    "CC0": ["CC0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "Artistic": ["Artistic License", "Artistic License 2.0", "Perl Artistic License"],
}
#: How notices refer to a name.
NOTICES = [
    "{}",
    "License: {}",
    "SPDX-License-Identifier: {}",
    "This software is distributed under the {}.",
    "The code is available under the terms of the {}.",
    "It may be used and shared under the {}",
    "You can redistribute it and/or modify it under the {} as published",
    "See the {} for more details.",
    "This project uses the {}.",
    "The documentation is covered by the {}.",
    "Files in this folder are licensed under the {} unless stated otherwise.",
    "Published under {}.",
    "Licensed under {}; see the file that comes with it.",
    "made available by its authors under the {}",
    "subject to the terms and conditions of the {}",
]
PROPRIETARY = [
    *[before + "ll rights reserved" + after for before in ("Copyright by the publisher; a", "(c) The company. A", "The contents remain the property of the company and a", "2019 The press, a", "Text and pictures by the author. A", "Translation, a") for after in (".", " worldwide.", " by it.", ", including the right of reproduction in whole or in part.", "; no licence is granted.")],
    "All rights are reserved by the author.",
    "No part of this publication may be reproduced or transmitted without the prior written permission of the publisher.",
    "This document is confidential and proprietary and may not be disclosed to third parties.",
    "Unauthorised copying of this file, via any medium, is strictly prohibited.",
    "Proprietary and confidential. Not for distribution.",
]
FAMILIES = [*NAMES, "proprietary"]
UNKNOWN = "unknown"
#: Sentences that sound like a licence and name none.
NEUTRAL = [
    "See the license for details.",
    "The license of this work is not known.",
    "Please read the terms of use before you copy this text.",
    "This is the version of the work that was published under another name.",
    "You may use this file as you like.",
    "The public has a right to the software of the general library.",
    "He lost his driving license in version one of the story.",
    "Her work was distributed by the school and licensed by the city.",
    "The general told the public that the software was available.",
    "An artistic performance under the terms of the common contract.",
    "Students at MIT wrote this code as part of the project.",
    "The Apache helicopter landed under the bridge.",
    "A creative person can share this work with others.",
    "Version 2.0 of the document is available on request.",
    "The rights of the reserve are all described in the annex.",
    "It was released under the name of another author.",
    "Copies of the book are sold under the counter.",
    "The library is free and open to the public.",
    "Terms and conditions apply to this offer.",
    "This software is distributed on three disks.",
    "The documentation is covered by dust.",
    "No part of this story is true.",
    "Files in this folder are sorted by date.",
    "License: none",
]
SAMPLE_TEXTS, SAMPLE_LINES = 400, 4000
#: Pairs of the training texts that can have a weight.
VOCABULARY = 4000
LEAST_PROBABILITY = 0.6
#: Share of the pairs of the shorter of template and paragraph that a confirmed paragraph holds.
CONFIRMED = 0.6
REGULARISATION, ELASTIC = 1e-4, 0.3
#: Words of a wrapped line of a licence text.
WRAP = 11
#: Starts and ends a paragraph, so that its first and last word stand in a pair.
EDGE = "^"


def tokens(paragraph: Column) -> Column:
    """The words of a paragraph between two edges: runs of letters, digits and dots, in lower case."""
    w = F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"), F.lit(0))
    return F.concat(F.array(F.lit(EDGE)), w, F.array(F.lit(EDGE)))


def each_pair(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each pair of neighbouring words: the kept columns, first and second; an empty paragraph has its edges."""
    sides = rows.select(*keep, let(tokens(F.col(text)), lambda w: F.struct(F.slice(w, F.lit(1), F.size(w) - 1).alias("first"), F.slice(w, F.lit(2), F.size(w) - 1).alias("second"))).alias("w"))
    return sides.select(*keep, F.inline(F.arrays_zip("w.first", "w.second"))).toDF(*keep, "first", "second")


def _pair_lists(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """rows with their distinct pairs as strings, by a number of their own."""
    return rows.withColumn("pairs", let(tokens(F.col(text)), lambda w: F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, w[i + 1]))))).select(*keep, "pairs")


def templates() -> list[tuple[str, str, str]]:
    """(family, name, text) of what is learned from: paragraphs of whole licence texts, and notices."""
    folder = Path(__file__).parent / "licence_texts"
    out = []
    for family, files in TEXTS.items():
        for name in files:
            paragraphs = [" ".join(p.split()) for p in (folder / f"{name}.txt").read_text().split("\n\n")]
            out += [(family, f"{name}:{i}", p) for i, p in enumerate(p for p in paragraphs if len(p.split()) > 3)]
    for family, names in NAMES.items():
        out += [(family, f"{family}:{n}:{i}", notice.format(name)) for n, name in enumerate(names) for i, notice in enumerate(NOTICES)]
    return out + [("proprietary", f"proprietary:{i}", t) for i, t in enumerate(PROPRIETARY)]


def training_rows() -> list[tuple[str, str]]:
    """(family, text): the templates, their wrapped lines, and the unknown class's sentences, whole and among other words."""
    out = []
    for family, _, text in templates():
        w = text.split()
        out.append((family, text))
        if len(w) > WRAP:
            out += [(family, " ".join(w[i : i + WRAP])) for i in range(0, len(w), WRAP) if len(w) - i >= WRAP // 2]
        else:
            out.append((family, f"Lorem {text} Ipsum dolor."))
    for text in NEUTRAL:
        out += [(UNKNOWN, text), (UNKNOWN, f"Lorem {text} Ipsum dolor."), (UNKNOWN, " ".join(text.split()[1:])), (UNKNOWN, " ".join(text.split()[:-1]))]
    return out


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The weights: a row for each pair that has one, by its hash and words, and in all rows the intercepts and the temperature."""
    spark = docs.sparkSession
    classes = [UNKNOWN, *FAMILIES]
    rows = [(float(classes.index(c)), t, i % 4 == 3) for i, (c, t) in enumerate(training_rows())]
    written = _pair_lists(spark.createDataFrame(rows, "label double, t string, apart boolean"), "t", "label", "apart")
    # Lines of the corpus that hold such words could be what is looked for; the others teach the unknown class.
    chosen = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(id_column)).alias("k"), F.col(id_column).alias("id"), F.col(text).alias("body")).orderBy("k", "id", F.xxhash64("body")).limit(SAMPLE_TEXTS)
    lines = chosen.select(F.explode(F.split("body", "\n")).alias("t")).where(~F.lower("t").rlike("licen|rights reserved|copyright|permission"))
    some = lines.distinct().orderBy(F.xxhash64("t"), "t").limit(SAMPLE_LINES)
    foreign = _pair_lists(some.select(F.lit(0.0).alias("label"), "t", (F.pmod(F.xxhash64("t", F.lit(1)), F.lit(4)) == 0).alias("apart")), "t", "label", "apart")
    sample = cut(written.unionByName(foreign).withColumn("n", F.monotonically_increasing_id()))
    sizes = {r["label"]: r["n"] for r in sample.where("NOT apart").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The pairs that the largest shares of a family's rows hold.
    shares = sample.where("label > 0 AND NOT apart").select("label", F.explode("pairs").alias("pair")).groupBy("pair", "label").agg(F.count(F.lit(1)).alias("n"))
    size_of = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, n)])
    vocabulary = sorted(r[0] for r in shares.groupBy("pair").agg(F.max(F.col("n") / size_of[F.col("label")]).alias("share")).orderBy(F.desc("share"), "pair").limit(VOCABULARY).collect())
    # Rare families count more, by how much rarer they are, damped.
    weigh = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, (max(sizes.values()) / n) ** 0.75)])
    # A few thousand rows at most: one task goes over them in each step of the fit.
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "pairs", "features").transform(sample.where("NOT apart").coalesce(1)).select("label", "features", weigh[F.col("label")].alias("weight"))
    model = LogisticRegression(family="multinomial", regParam=REGULARISATION, elasticNetParam=ELASTIC, maxIter=50, standardization=False, weightCol="weight").fit(vectors)
    matrix, intercepts = model.coefficientMatrix.toArray(), [float(x) for x in model.interceptVector]
    weights = [(*p.split(" "), [float(x) for x in matrix[:, k]]) for k, p in enumerate(vocabulary) if matrix[:, k].any()]
    learned = spark.createDataFrame(weights, "first string, second string, weights array<double>").withColumn("pair", F.xxhash64("first", "second"))
    kept_out = cut(sample.where("apart").select("n", "label", F.explode("pairs").alias("pair")).withColumn("pair", F.xxhash64(F.split("pair", " ")[0], F.split("pair", " ")[1])))
    logits = [F.col(f"l{k}") for k in range(len(intercepts))]
    scored = cut(_sums(kept_out, learned, intercepts, ["n", "label"]).withColumn("own", F.array(*logits)[F.col("label").cast("int")]))
    tried = scored.withColumn("t", F.explode(F.array(*[F.lit(2 ** (k / 4)) for k in range(-12, 9)])))
    loss = tried.groupBy("t").agg(F.avg(F.log(sum(F.exp((x - F.col("own")) / F.col("t")) for x in logits))).alias("loss"))
    best = loss.orderBy("loss", "t").first()
    temperature = best["t"] if best is not None else 1.0
    return learned.withColumn("intercepts", F.array(*[F.lit(x) for x in intercepts])).withColumn("temperature", F.lit(temperature))


def _sums(pairs: DataFrame, weights: DataFrame, intercepts: list[float], keys: list[str]) -> DataFrame:
    """keys and the logits l0, l1, ... of each group of keys. pairs: keys and pair. The weights are bounded by the training texts."""
    n = len(intercepts)
    known = weights.select("pair", *[F.col("weights")[k].alias(f"w{k}") for k in range(n)])
    # Each pair counts once; the groups stay where they are for the sums.
    once = pairs.join(F.broadcast(known.select("pair")), "pair", "left_semi").groupBy(*keys).agg(F.collect_set("pair").alias("pairs"))
    found = once.select(*keys, F.explode("pairs").alias("pair")).join(F.broadcast(known), "pair")
    return found.groupBy(*keys).agg(*[(F.sum(f"w{k}") + intercepts[k]).alias(f"l{k}") for k in range(n)])


def predict(pairs: DataFrame, weights: DataFrame, keys: list[str], least: float = LEAST_PROBABILITY) -> DataFrame:
    """keys, family and probability of the groups of keys in which a family is found."""
    first = weights.select("intercepts", "temperature").first()
    if first is None:
        return pairs.where("false").select(*keys, F.lit("").alias("family"), F.lit(0.0).alias("probability"))
    of = [F.col(f"l{k + 1}") for k in range(len(FAMILIES))]
    # Most paragraphs are sooner of no family than of any; chances are taken of the others only.
    able = _sums(pairs, weights, list(first["intercepts"]), keys).withColumn("best", F.greatest(*of)).where("best > l0")
    probability = 1 / sum(F.exp((x - F.col("best")) / first["temperature"]) for x in [F.col("l0"), *of])
    family = F.coalesce(*[F.when(x == F.col("best"), F.lit(c)) for c, x in zip(FAMILIES, of, strict=True)])
    return able.select(*keys, family.alias("family"), probability.alias("probability")).where(F.col("probability") >= least)


def _inner(pairs: DataFrame) -> DataFrame:
    """Pairs without the edges: a template may stand within a paragraph, and a paragraph within a template."""
    return pairs.where((F.col("first") != EDGE) & (F.col("second") != EDGE))


def scan(docs: DataFrame, weights: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = LEAST_PROBABILITY) -> DataFrame:
    """Id, paragraph number, family, probability, the most similar template of the family, the share of pairs, confirmed."""
    spark = docs.sparkSession
    keys = ["id", "text_hash", "paragraph"]
    lines = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "t"))
    hashed = each_pair(lines, "t", *keys).select(*keys, F.xxhash64("first", "second").alias("pair"))
    found = cut(predict(hashed, weights, keys, least))
    # Only the texts that a family was found in are read a second time; findings of a text are one row there.
    of = found.groupBy("id", "text_hash").agg(F.collect_list(F.struct("paragraph", "family", "probability")).alias("found"))
    own = docs.select(F.col(id_column).alias("__id"), F.xxhash64(F.col(text)).alias("__hash"), F.col(text).alias("__text"))
    texts = own.join(of, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("text_hash"))).select("id", "text_hash", F.split("__text", "\n").alias("lines"), "found").dropDuplicates(["id", "text_hash"])
    again = texts.select("id", "text_hash", F.explode(F.transform("found", lambda x: F.struct(x.alias("x"), F.col("lines")[x["paragraph"]].alias("t")))).alias("y")).select("id", "text_hash", "y.x.*", "y.t")
    held = _inner(each_pair(again, "t", *keys, "family", "probability")).select(*keys, "family", "probability", F.xxhash64("first", "second").alias("pair")).distinct()
    known = _inner(each_pair(spark.createDataFrame(templates(), "family string, template string, t string"), "t", "family", "template")).select("family", "template", F.xxhash64("first", "second").alias("pair")).distinct()
    sized = cut(known.join(known.groupBy("template").agg(F.count(F.lit(1)).alias("of")), "template"))
    size = held.groupBy(*keys, "family", "probability").agg(F.count(F.lit(1)).alias("size"))
    shared = held.join(F.broadcast(sized), ["family", "pair"]).groupBy(*keys, "template", "of").agg(F.count(F.lit(1)).alias("shared"))
    null_safe = [size[k].eqNullSafe(shared[k]) for k in keys]
    joined = size.join(shared, null_safe[0] & null_safe[1] & null_safe[2], "left").select(*[size[k] for k in keys], "family", "probability", "template", (F.col("shared") / F.least("of", "size")).alias("share"))
    top = joined.groupBy(*keys, "family", "probability").agg(F.max(F.when(F.col("share").isNotNull(), F.struct("share", "template"))).alias("m"))
    share = F.coalesce("m.share", F.lit(0.0))
    return top.select(F.col("id").alias(id_column), F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", F.col("m.template").alias("template"), share.alias("share"), (share >= CONFIRMED).alias("confirmed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the paragraphs of all documents in which a licence family is found."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, cut(train(docs)))
