"""Operator 8, license scans [native]: a trained paragraph classifier whose finds a template comparison confirms.

The model (sparse word 1- and 2-gram multinomial logistic regression with a class ``unknown``) is fitted on the driver
from the notices below and seeded variations of them. The main path, which reads the documents, is DataFrame functions
only: paragraphs with a cue word are told apart once per distinct text, however often it is copied. A paragraph without
any cue word is no notice here, by definition.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Notices by licence family, in whole paragraphs; short forms in four languages.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Lizenziert unter der Apache Lizenz, Version 2.0.",
        "Sous licence Apache, version 2.0.",
        "Licenciado bajo la licencia Apache, versi\u00f3n 2.0.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Ver\u00f6ffentlicht unter der MIT Lizenz.",
        "Publi\u00e9 sous licence MIT.",
        "Publicado bajo la licencia MIT.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2.", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL.", "SPDX-License-Identifier: EUPL-1.2"],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Lizenziert unter CC BY 4.0.", "Sous licence CC BY 4.0.", "Bajo licencia CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Lizenziert unter CC BY-SA 4.0.", "Sous licence CC BY-SA 4.0.", "Bajo licencia CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Lizenziert unter CC BY-NC 4.0.", "Sous licence CC BY-NC 4.0.", "Bajo licencia CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).", "Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Alle Rechte vorbehalten.", "Tous droits r\u00e9serv\u00e9s.", "Todos los derechos reservados."],
}
#: Paragraphs with cue words that are no licence notice.
OTHERS = ["A driving licence is required to rent a car.", "The pub lost its licence last year.", "She asked for permission to leave early.", "The warranty covers parts and labour for two years.", "He was licensed as a physician in the state.", "Copyright law differs between countries.", "The fishing license costs ten euros and can be bought at the lake.", "Software licenses are often hard to read.", "The city granted permission for the new bridge.", "Without warning the public domain of the king was divided.", "This version of the work was free for the public under the terms of the contract."]
#: a notice names itself: what has none of these words is no paragraph of this scan
CUE = r"(?i)licen[cs]|lizen[zs]|copyright|permission|warrant|redistribut|public domain|spdx|rights reserved|rechte vorbehalten|droits r|derechos reservados"
CUE_WRAPPED = CUE.replace(" ", "[^A-Za-z0-9]+")  # also where a line ends within a cue
UNKNOWN = "unknown"
WORDS = 96  # of a window of lines: a quarter more than the longest notice has
VARIANTS, EPOCHS, RATE, L1 = 24, 120, 2.0, 2e-4
SURE, CONFIRMED = 0.5, 0.6  # least calibrated probability of a family; least share of a notice's 2-grams

_WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def grams(text: str) -> set[str]:
    w = re.findall(_WORD, text.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


@dataclass
class Model:
    classes: list[str]
    weight: dict[str, list[float]]
    bias: list[float]
    temperature: float


def fit(seed: int = 11) -> Model:
    """Notices with words dropped, cut and framed by other words, against shuffled words, fragments and OTHERS."""
    rng = random.Random(seed)
    filler = "the of and in project file see for details our team here code work text page under about with website".split()
    rows: list[tuple[str, str]] = []
    for family, notices in NOTICES.items():
        for notice in notices:
            words = notice.split()
            rows.append((notice, family))
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.08] or words
                rows.append((" ".join(rng.choices(filler, k=rng.randint(0, 6)) + kept + rng.choices(filler, k=rng.randint(0, 6))), family))
                mixed = rng.sample(words, len(words))
                rows.append((" ".join(mixed[: rng.randint(1, min(4, len(mixed)))] + rng.choices(filler, k=6)), UNKNOWN))
    for text in OTHERS:
        rows += [(text, UNKNOWN), *((" ".join(rng.sample(text.split(), len(text.split()))), UNKNOWN) for _ in range(VARIANTS))]
    rng.shuffle(rows)
    classes = [*NOTICES, UNKNOWN]
    vocabulary = sorted({g for text, _ in rows for g in grams(text)})
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, (text, _) in enumerate(rows):
        found = grams(text)
        x[i, [at[g] for g in found]] = 1 / max(1, len(found)) ** 0.5
    y = np.array([classes.index(c) for _, c in rows])
    apart = np.arange(len(y)) % 5 == 0
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    gw = np.full_like(w, 1e-6)
    for _ in range(EPOCHS):
        z = x[~apart] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), y[~apart]] -= 1
        g = x[~apart].T @ p / len(p)
        gw += g**2
        rate = RATE / 4 / np.sqrt(gw)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        b -= RATE * p.mean(0)
    z = x[apart] @ w + b

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y[apart]]).mean())

    temperature = min((float(t) for t in np.geomspace(0.2, 10, 80)), key=loss)
    used = np.flatnonzero(np.abs(w).max(1) > 1e-6)
    return Model(classes, {vocabulary[i]: [float(v) for v in w[i]] for i in used}, [float(v) for v in b], temperature)


def _grams(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def classified(paragraphs: DataFrame, model: Model) -> DataFrame:
    """(key, family, probability, likeness) of distinct paragraphs (key, paragraph).

    Features join the model's weights and the notices' 2-grams, tables of fixed size. A family that isn't probable
    enough, or none of whose notices has enough of its 2-grams in the paragraph, is ``unknown``.
    """
    spark, classes = paragraphs.sparkSession, model.classes
    weights = F.broadcast(spark.createDataFrame(list(model.weight.items()), "gram string, w array<double>"))
    templates = [(family, f"{family}#{i}", g, len(pairs)) for family, notices in NOTICES.items() for i, n in enumerate(notices) for pairs in [[g for g in grams(n) if " " in g] or sorted(grams(n))] for g in pairs]
    notices = F.broadcast(spark.createDataFrame(templates, "family string, notice string, gram string, n int"))
    features = paragraphs.select("key", _grams(F.col("paragraph")).alias("g")).select("key", F.size("g").alias("size"), F.explode_outer("g").alias("gram"))
    scale = F.sqrt(F.greatest(F.first("size"), F.lit(1)))
    sums = features.join(weights, "gram", "left").groupBy("key").agg(*[((F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) / scale + model.bias[i]) / model.temperature).alias(f"z{i}") for i in range(len(classes))])
    best = F.greatest(*[F.struct(F.col(f"z{i}").alias("z"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    total = sum((F.exp(F.col(f"z{i}") - best["z"]) for i in range(1, len(classes))), F.exp(F.col("z0") - best["z"]))
    guess = sums.select("key", best["c"].alias("guess"), (1 / total).alias("probability"))
    alike = features.join(notices, "gram").groupBy("key", "family", "notice").agg((F.count("*") / F.first("n")).alias("s")).groupBy("key", "family").agg(F.max("s").alias("likeness"))
    joined = guess.join(alike.withColumnRenamed("family", "guess"), ["key", "guess"], "left")
    sure = (F.col("probability") >= SURE) & (F.coalesce("likeness", F.lit(0.0)) >= CONFIRMED)
    return joined.select("key", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", F.coalesce("likeness", F.lit(0.0)).alias("likeness"))


SPANS = "array<struct<i:int,j:int,p:string>>"


def _windows(text: str) -> str:
    """SQL of the (first line, last line, text) of lines with a cue and of windows of two and more lines with one. A
    window ends before a blank line and with the line that brings it to WORDS words, so it has WORDS lines at most; of
    longer lines at its ends it has the nearest WORDS words."""
    cut = f"transform(split({text}, '\\n'), (p, i) -> named_struct('i', i, 'p', p, 'w', CASE WHEN p RLIKE '[A-Za-z0-9]' THEN size(split(trim(p), '[ \\t]+')) ELSE 0 END))"
    head = f"CASE WHEN l.w > {WORDS} THEN array_join(slice(split(trim(l.p), '[ \\t]+'), 1, {WORDS}), ' ') ELSE l.p END"
    tail = f"CASE WHEN l.w > {WORDS} THEN array_join(slice(split(trim(l.p), '[ \\t]+'), -{WORDS}, {WORDS}), ' ') ELSE l.p END"
    cue, wrapped = f"RLIKE r'{CUE}'", f"RLIKE r'{CUE_WRAPPED}'"
    none = f"CAST(array() AS {SPANS})"
    # n counts the words after the first line, which may be long
    step = f"(a, l) -> CASE WHEN a.over OR l.w = 0 THEN named_struct('over', true, 'n', a.n, 'p', a.p, 'out', a.out) ELSE named_struct('over', a.n + l.w >= {WORDS}, 'n', a.n + l.w, 'p', concat(a.p, ' ', {head}), 'out', concat(a.out, array(named_struct('i', i, 'j', l.i, 'p', concat(a.p, ' ', {head}))))) END"
    from_line = f"CASE WHEN l.w = 0 THEN {none} ELSE aggregate(slice(c, i + 2, {WORDS}), named_struct('over', false, 'n', least(l.w, {WORDS // 4}), 'p', {tail}, 'out', {none}), {step}, a -> filter(a.out, x -> x.p {wrapped})) END"
    single = f"CASE WHEN l.p {cue} THEN array(named_struct('i', i, 'j', i, 'p', l.p)) ELSE {none} END"
    return f"element_at(transform(array({cut}), c -> flatten(transform(c, (l, i) -> concat({single}, {from_line})))), 1)"


def _notices(spans: str) -> str:
    """SQL of the sorted (first line, family) of the notices and unknown lines among classified spans (i, j, family, s)."""
    within = "x.i >= m.i AND x.j <= m.j AND (x.i > m.i OR x.j < m.j)"
    better = f"filter({spans}, m -> m.family <> '{UNKNOWN}' AND (m.i = m.j OR NOT exists({spans}, x -> {within} AND x.family = m.family AND x.s >= m.s)))"
    around = "x.i <= m.i AND x.j >= m.j AND (x.i < m.i OR x.j > m.j)"
    own = f"transform(array({better}), k -> filter(k, m -> NOT exists(k, x -> {around} AND x.family <> m.family AND x.s > m.s)))[0]"
    firsts = "filter(k, m -> NOT exists(k, x -> x.family = m.family AND ((x.i < m.i AND x.j >= m.i) OR (x.i = m.i AND x.j > m.j))))"
    others = f"filter({spans}, m -> m.i = m.j AND m.family = '{UNKNOWN}' AND NOT exists(k, x -> x.i <= m.i AND x.j >= m.i))"
    return f"array_sort(transform(transform(array({own}), k -> concat({firsts}, {others}))[0], m -> named_struct('i', m.i, 'family', m.family)))"


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, n_licenses, families (sorted, distinct), n_unknown, places.

    Paragraphs are lines, and windows of lines up to a blank one (without letters and digits), so that wrapped notices
    are seen whole. A window counts if it is more like a notice than any part of it; what overlaps in one family is one
    notice, and lines with a cue that a notice covers aren't ``unknown``. ``places`` is line:family, comma-joined in
    order, by a notice's first line, ``unknown`` lines with a cue included. Null and empty texts have none; rows that
    repeat id and text have the same; other columns are not read. Rows without a cue word, nearly all, are not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("__t")).select("doc_id", F.when(F.col("__t").rlike(CUE_WRAPPED), F.expr(_windows("__t"))).otherwise(F.expr(f"CAST(array() AS {SPANS})")).alias("lines"))
    rows = common.stored(rows, "lines")
    found = rows.where(F.size("lines") > 0).withColumn("row", F.sha2(F.to_json(F.struct("lines")), 256))
    cues = found.select("row", "lines").distinct().select("row", F.explode("lines").alias("l")).select("row", "l.i", "l.j", F.sha2("l.p", 256).alias("key"), F.col("l.p").alias("paragraph"))
    cues = common.stored(cues, "cues")
    of = classified(cues.groupBy("key").agg(F.first("paragraph").alias("paragraph")), model)
    done = cues.select("row", "i", "j", "key").join(of, "key").groupBy("row").agg(F.collect_list(F.struct("i", "j", "family", F.col("likeness").alias("s"))).alias("all"))
    done = common.stored(done.select("row", F.expr(_notices("all")).alias("f")), "families")
    none = F.expr("CAST(array() AS array<struct<i:int,family:string>>)")
    out = found.select("doc_id", "row").join(done, "row").select("doc_id", "f").unionByName(rows.where(F.size("lines") == 0).select("doc_id", none.alias("f")))
    known = F.filter("f", lambda s: s.family != UNKNOWN)
    return out.select("doc_id", F.size(known).cast("long").alias("n_licenses"), F.array_sort(F.array_distinct(F.transform(known, lambda s: s.family))).alias("families"), (F.size("f") - F.size(known)).cast("long").alias("n_unknown"), F.array_join(F.transform("f", lambda s: F.concat_ws(":", s.i, s.family)), ",").alias("places"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.documents(spark, sf_dir), fit())
