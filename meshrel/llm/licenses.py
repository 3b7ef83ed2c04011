"""Licence scan: a sparse n-gram logistic regression over paragraphs, confirmed by templates; built-in functions only."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import joined_back, settle, table

#: The paragraphs of the notices of each family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License v3",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "reserved": ["All rights reserved", "Copyright holder. All rights reserved"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
#: Words that no feature may consist of alone.
STOP = "a all along an and any anyone are as at author be but by can code commercial conditions copies copy details details either extent file files following for form forms free from general hands held hope if in included including international is it its language law list may means met more name names no not of on one or other our out part permitted person persons possible provided public purpose received related required rights see sell shall should so source specific subject such terms than that the their this to under use used useful v version was with without work you your written binary prior products charge hereby".split()
#: Sentences that are no notices, for the unknown class.
OTHERS = [
    "The driver showed a valid licence to the officer and went on", "She has a license to teach in two states", "The right to vote was reserved for the few",
    "The general public was not permitted to enter", "They released the new version of the software on Monday", "We use the source and the binary forms of the number",
    "All of the work was done under the old terms", "The apache rode over the hill", "He was free to copy the file", "The foundation published a study on common attribution errors",
    "The conditions are met if the sum is positive", "Rights and duties of the citizens", "A table was reserved for four", "Creative people share common traits",
    "The court granted permission to appeal without a fee", "The warranty covers all parts for two years", "The software is distributed to schools", "A merger agreement was published in the journal",
    "He gave notice and left the company", "Copies of the letter were sold at auction", "The product comes with documentation in three languages", "The author has waived the fee for this talk",
]
UNKNOWN = "unknown"
LEAST_PROBABILITY = 0.6
LEAST_TEMPLATE = 0.6
#: A unit is one line, or so many neighbouring ones.
SPANS = (1, 2, 4, 8)
#: At most so many lines of the corpus fit the unknown class.
NEGATIVES = 2_000
_SPLIT = r"[^a-z0-9.]+"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(_SPLIT, text.lower())) if w]


def features_of(words: list[str]) -> set[str]:
    return {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in STOP or b not in STOP}


def template_share(words, family: str) -> float:
    """The largest part of a template's different words that ``words`` hold."""
    return max(len(own & set(words)) / len(own) for own in (set(words_of(t)) for t in TEMPLATES[family]))


def sample_lines(docs: DataFrame, most: int = NEGATIVES) -> list[str]:
    """The middle lines of the ``most`` texts at most that come first by a hash; at most 300 characters of each."""
    text = F.col("text").cast("string")
    rows = docs.where(F.length(text) > 0).select(F.xxhash64(F.lit(5), text).alias("h"), F.split(text, "\n").alias("lines"))
    rows = rows.select("h", F.substring(F.element_at("lines", (F.size("lines") / 2 + 1).cast("int")), 1, 300).alias("line"))
    return [r["line"] for r in rows.orderBy("h").limit(most).collect()]


def fit(lines: list[str] | None = None, seed: int = 1, copies: int = 24, rounds: int = 160, ridge: float = 1e-3, least_weight: float = 0.05) -> dict:
    """A multinomial logistic regression of the families against the unknown class.

    A family's rows are noisy copies of its paragraphs: parts of at least 0.6 of them, with words lost and words of
    other sentences at either end. The unknown class has ``OTHERS``, sentences put together of their words, and the
    ``lines`` of the corpus that share less than 0.4 of any template. The vocabulary is that of the templates but
    for words that occur in over 1 in 200 of the lines. Weights under ``least_weight`` become zero. A temperature,
    chosen by the likelihood of held-out rows, calibrates the probabilities, that of the unknown class among them.
    ``held_out`` has the share of held-out rows that get their class.
    """
    rng = random.Random(seed)
    classes = [*TEMPLATES, UNKNOWN]
    split = [words_of(x) for x in lines or []]
    split = [w for w in split if w and all(template_share(w, f) < 0.4 for f in TEMPLATES)]
    seen: dict[str, int] = {}
    for w in split:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    common = {x for x, n in seen.items() if n * 200 > len(split)}
    filler = [w for s in OTHERS for w in words_of(s)] + [w for s in split[:200] for w in s[:10]]
    rows: list[tuple[set[str], int]] = []
    for y, name in enumerate(classes[:-1]):
        for template in TEMPLATES[name]:
            whole = words_of(template)
            for _ in range(copies):
                n = rng.randint(-(-len(whole) * 6 // 10), len(whole))
                at = rng.randint(0, len(whole) - n)
                words = [w for w in whole[at : at + n] if rng.random() > 0.06]
                extra = [rng.choice(filler) for _ in range(rng.choice([0, 0, 3, 8, 20]))]
                rows.append((features_of(words + extra if rng.random() < 0.5 else extra + words), y))
    other = [words_of(s) for s in OTHERS] * 8 + [[rng.choice(filler) for _ in range(rng.randint(1, 20))] for _ in range(400)] + split
    rows += [(features_of(w), len(classes) - 1) for w in other]
    rng.shuffle(rows)
    names = sorted({f for t in TEMPLATES.values() for s in t for f in features_of(words_of(s)) if not any(w in common for w in f.split())})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (found, _) in enumerate(rows):
        x[i, [at[f] for f in found if f in at]] = 1
    y = np.array([r[1] for r in rows])
    held = np.arange(len(rows)) % 4 == 3
    target = np.eye(len(classes), dtype=np.float32)[y]
    weight, bias = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)

    def share(logits):
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    fitted, wanted = x[~held], target[~held]
    for _ in range(rounds):
        gap = share(fitted @ weight + bias) - wanted
        weight -= 4.0 * (fitted.T @ gap / len(fitted) + ridge * weight)
        bias -= 1.0 * gap.mean(axis=0)
    weight[np.abs(weight) < least_weight] = 0
    logits = (x[held] @ weight + bias).astype(np.float64)
    heat = min(np.linspace(0.25, 4, 40), key=lambda t: -np.log(share(logits / t)[np.arange(len(logits)), y[held]] + 1e-12).mean())
    used = np.flatnonzero(np.abs(weight).sum(axis=1))
    right = float((logits.argmax(axis=1) == y[held]).mean())
    return {"classes": classes, "features": [names[i] for i in used], "weight": (weight[used] / heat).astype(np.float64), "bias": (bias / heat).astype(np.float64), "held_out": right}


def telling_words(model: dict) -> list[str]:
    """Words without which no unit has a feature that speaks for a family against the unknown class."""
    gain = (model["weight"][:, :-1] - model["weight"][:, -1:]).max(axis=1)
    return sorted({w for f, g in zip(model["features"], gain) if g > 0 for w in f.split() if w not in STOP})


def notices(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The licence notices of each text: (k1, k2, family, first_line, last_line, probability, template_share).

    (k1, k2) is a digest of doc_id and text, which ``row_keys`` gives; equal rows have equal notices, once. The units
    that are judged are lines and 2, 4 and 8 neighbouring lines, so that a notice wrapped over lines is judged as one
    paragraph. A unit whose first line has no telling word has nothing that speaks for a family and is not built; this
    loses nothing, as the unit without that line is judged. A prediction counts if it is no unknown, reaches the
    least probability, and the unit holds the least part of the words of a template of its family. Of the units that begin in
    a line the one with the largest part counts, then the likelier, then the shorter; of equal ones the first family.
    Units of a family that overlap are one notice.

    Null and empty texts have no notices; very long texts are judged whole. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    model = model or fit(sample_lines(docs))
    classes = model["classes"]
    pattern = r"(?i)(?<![a-z0-9.])\.*(?:" + "|".join(map(re.escape, telling_words(model))) + r")\.*(?![a-z0-9.])"
    rows = docs.select(*row_keys(docs), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(pattern)).select("k1", "k2", F.split("text", "\n").alias("all"))
    units = F.transform("all", lambda line, i: F.when(line.rlike(pattern), F.struct(i.alias("first_line"), F.slice(F.col("all"), i + 1, max(SPANS)).alias("lines"))))
    begun = rows.select("k1", "k2", F.explode(F.filter(units, lambda u: u.isNotNull())).alias("u")).select("k1", "k2", "u.first_line", "u.lines")
    sizes = F.array_distinct(F.array(*[F.least(F.size("lines"), F.lit(n)) for n in SPANS]))
    sized = begun.select("k1", "k2", "first_line", F.explode(sizes).alias("n_lines"), "lines")
    joined = F.array_join(F.slice("lines", 1, F.col("n_lines")), " ")
    words = F.filter(F.transform(F.split(F.lower(joined), _SPLIT), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")
    units = settle(sized.select("k1", "k2", "first_line", "n_lines", words.alias("words")).distinct())
    pairs = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.col("words")[i + 1]))
    # Equal units are judged once.
    kinds = units.groupBy("words").agg(F.count("*").alias("n"))
    grams = kinds.select("words", "n", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    weights = spark.createDataFrame([(f, *map(float, w)) for f, w in zip(model["features"], model["weight"])], ", ".join(["gram string", *[f"w{i} double" for i in range(len(classes))]]))
    sums = grams.join(F.broadcast(weights), "gram").groupBy("words", "n").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(classes))])
    logits = F.array(*[F.col(f"w{i}") + float(b) for i, b in enumerate(model["bias"])])
    judged = sums.select("words", "n", logits.alias("logits")).withColumn("top", F.array_max("logits"))
    total = F.aggregate("logits", F.lit(0.0), lambda a, b: a + F.exp(b - F.col("top")))
    best = F.array_position("logits", F.col("top")).cast("int")
    judged = judged.withColumn("family", F.element_at(F.array(*map(F.lit, classes)), best)).withColumn("probability", F.round(1 / total, 6))
    judged = judged.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))
    shares = [F.when(F.col("family") == name, F.size(F.array_intersect("words", F.array(*map(F.lit, own)))) / len(own)) for name, texts in TEMPLATES.items() for own in (sorted(set(words_of(t))) for t in texts)]
    judged = judged.withColumn("template_share", F.round(F.greatest(*shares), 6)).where(F.col("template_share") >= LEAST_TEMPLATE).select("words", "n", "family", "probability", "template_share")
    hits = joined_back(units, settle(judged), ["words"], ["k1", "first_line"]).groupBy("k1", "k2", "first_line").agg(F.max(F.struct("template_share", "probability", (-F.col("n_lines")).alias("shorter"), "family")).alias("b"))
    hits = hits.select("k1", "k2", "first_line", (F.col("first_line") - F.col("b.shorter") - 1).alias("last_line"), "b.family", "b.probability", "b.template_share")
    own = W.partitionBy("k1", "k2", "family").orderBy("first_line", "last_line")
    before = F.max("last_line").over(own.rowsBetween(W.unboundedPreceding, -1))
    merged = hits.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("first_line")).cast("int")).withColumn("notice", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    return merged.groupBy("k1", "k2", "family", "notice").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.max("probability").alias("probability"), F.max("template_share").alias("template_share")).drop("notice")


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The ``notices`` of each row: (doc_id, family, first_line, last_line, probability, template_share).

    Rows without doc_id come out without one; of repeated rows each has its notices.
    """
    found = settle(notices(docs, model))
    return docs.select("doc_id", *row_keys(docs)).join(found, ["k1", "k2"]).drop("k1", "k2")


def row_keys(docs: DataFrame) -> list:
    """k1 and k2: a digest of 128 bits of doc_id and text, nulls included."""
    parts = [docs["doc_id"].cast("string"), docs["text"].cast("string"), docs["doc_id"].isNull(), docs["text"].isNull()]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its families in order, its notices, and its best probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = notices(docs).groupBy("k1", "k2").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"), F.count("*").alias("n_notices"), F.max("probability").alias("probability"))
    joined = docs.select("doc_id", *row_keys(docs)).join(settle(found), ["k1", "k2"], "left")
    return joined.select("doc_id", F.coalesce("licences", F.lit(UNKNOWN)).alias("licences"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"), "probability")


QUERIES = {"op2_license_scan": op2_license_scan}
