"""License scans by a trained paragraph classifier (operator 10)."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import kind
from .common import map_rows, read

# Characteristic sentences of public licences, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise.",
        "Distributed under the MIT License; see the LICENSE file for details.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "You may not use this file except in compliance with the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "This project is released under the Apache 2.0 license.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "Released under the GPL version 2 or later.",
        "Licensed under GPLv3.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Released under the LGPL version 2.1 or later.",
        "See the GNU Lesser General Public License for more details.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software under the terms of the GNU Affero General Public License.",
        "Licensed under AGPLv3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 2-Clause License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly credited.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Available under a Creative Commons Attribution-NonCommercial-ShareAlike license.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "Reserved": ("All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved."),
}
# Public short identifiers and usual names of the families, for tags and one-line declarations.
NAMES = {
    "MIT": ("MIT", "MIT-0", "X11"), "Apache": ("Apache-2.0", "Apache 2.0", "Apache License 2.0", "ASL 2.0"), "GPL": ("GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0", "GNU GPL"),
    "LGPL": ("LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-2.1", "GNU LGPL"), "AGPL": ("AGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0", "GNU AGPL"), "BSD": ("BSD-3-Clause", "BSD-2-Clause", "BSD"),
    "CC-BY": ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-3.0"), "CC-BY-NC": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"), "MPL": ("MPL-2.0", "Mozilla Public License 2.0"), "Unlicense": ("Unlicense", "CC0-1.0", "CC0"), "ISC": ("ISC",),
}
# Forms of a declaration, and of talk about one that grants nothing.
DECLARES = ("SPDX-License-Identifier: {0}", "License: {0}", "Code is {0} licensed.", "Distributed under the {0} license.", "Licensed under {0}.", "Released under the {0} license.", "This software is available under the {0} license.")
REPORTS = (
    "We compared code licensed under the {0} license with ours.", "Never write that your work is licensed under the {0} license unless you mean it.", "It is not licensed under the {0} license.",
    "They asked whether the project was released under the {0} license.", "He would rather not have it distributed under the {0} license.", "If it were licensed under {0}, we could use it.",
    "Many projects are licensed under {0} instead of another license.", "The difference between {0} and other licenses is explained here.", "Do not claim that this is released under the {0} license.",
)
#: Words that turn a sentence about a licence into talk, where its template doesn't have them itself.
CUES = frozenset("not never unless whether compare compared comparing comparison difference claim claims instead rather versus asked if were misunderstand explained explains discuss discussed many".split())
UNKNOWN = "unknown"
# Sentences about licences and software that grant nothing.
TALK = (
    "He lost the license of his driver.", "She renewed her driver's license in March.", "The licensing committee will meet again next week.",
    "The restaurant was denied a liquor license by the city council.", "Copyright law differs from country to country.", "A license is a contract between two parties.",
    "The judge ruled that the copyright had expired.", "They discussed which license to choose for the new project.", "The public domain is shrinking, the author argues.",
    "We compared the MIT and the Apache license in this article.", "Many people misunderstand the GNU General Public License.", "The warranty covers parts and labour for two years.",
    "All rights and duties of the tenants are listed below.", "The foundation publishes free software and pays its authors.", "You may use the kitchen until ten.",
    "A copy of the report was sent to the board.", "The source code of the program was lost in the fire.", "Permission to enter the building is granted at the door.",
    "The software is provided by the school.", "Redistribution of wealth was the topic of the debate.", "The conditions of the contract are not met.",
    "This file is too large to be opened.", "This program was shown on television last night.", "The library is free for everyone in town.",
    "Its creative commons room hosts painters and musicians.", "The attribution of the painting is disputed.", "The general public was not admitted.",
    "You should have received a letter along with this parcel.", "The version of the story that he tells is wrong.", "Rights reserved for members are explained on page two.",
    "Der Führerschein wurde ihm im März entzogen.", "Die Lizenz des Händlers ist abgelaufen.", "Das Urheberrecht schützt Werke der Literatur.",
    "Le permis de conduire est obligatoire.", "La licence de pêche coûte vingt euros.", "Le droit d'auteur protège les œuvres.",
    "La licencia de conducir caduca cada diez años.", "El derecho de autor protege las obras.", "The license plate of the car was stolen.", "",
)
#: Labelled sample: documents drawn by the hash of their id, sentences of theirs taken as unknown, variants of each template sentence, features.
UNKNOWN_DOCS, UNKNOWN_ROWS, VARIANTS, FEATURES = 1000, 3000, 24, 20_000
#: Share of held-out unknown sentences that the threshold lets through, and of a template's word pairs that confirm.
FALSE_RATE, CONFIRM = 0.002, 0.6
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Corpus sentences with these are not taken as examples of unknown.
_HINTS = "(?i)licen|copyright|warrant|rights reserved|public domain|creative commons|spdx"


def words(text: str) -> list[str]:
    """Lower-case words; both spellings of license are one."""
    return [w.replace("licenc", "licens") if "licenc" in w else w for w in _WORD.findall(text.lower())]


def templates() -> dict[str, list[list[str]]]:
    """Words of each family's sentences, tags and declarations."""
    short = {f: [d.format(n) for n in names for d in DECLARES] for f, names in NAMES.items()}
    return {f: [words(x) for x in (*sentences, *short.get(f, ()))] for f, sentences in TEMPLATES.items()}


def grams(tokens: list[str]) -> list[str]:
    """Distinct word n-grams of one to three words."""
    return list({" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)})


def training_rows(prose: list[list[str]], seed: int = 7) -> list[tuple[str, list[str]]]:
    """(family, words) of the templates by a fixed generator: whole, with words left out, joined in twos, and inside ordinary words."""
    rng, rows = np.random.default_rng(seed), []
    around = [w for w in prose if len(w) >= 4] or [[]]
    for family, tokens in templates().items():
        n_long = len(TEMPLATES[family])
        for k, own in enumerate(tokens):
            rows.append((family, own))
            for turn in range(VARIANTS if k < n_long else 4):
                more = tokens[rng.integers(len(tokens))] if turn % 4 == 1 else []
                kept = [t for t in own + more if rng.random() > 0.1] or own
                if turn % 4 >= 2:
                    ahead, behind = (around[rng.integers(len(around))] for _ in range(2))
                    kept = ahead[: rng.integers(6)] + kept + behind[: rng.integers(6)]
                rows.append((family, kept))
    rows += [(UNKNOWN, words(r.format(n))) for names in NAMES.values() for n in names for r in REPORTS]
    return rows


class Model:
    """Sparse weights of the classifier, its temperature and threshold, and the templates' word pairs."""

    def __init__(self, families: list[str], weights: dict[str, np.ndarray], bias: np.ndarray) -> None:
        self.families, self.weights, self.bias = families, weights, bias
        self.unknown = families.index(UNKNOWN)
        self.temperature, self.least = 1.0, 0.5
        self.pairs = {f: [(set(zip(t, t[1:], strict=False)), set(t)) for t in own] for f, own in templates().items()}
        # By n-gram length, and for each gram the most that it can do for any family against unknown.
        self.by_size: list[dict[tuple[str, ...], str]] = [{}, {}, {}]
        for gram in weights:
            parts = tuple(gram.split(" "))
            self.by_size[len(parts) - 1][parts if len(parts) > 1 else gram] = gram
        self.most = {g: max(0.0, float(np.delete(w - w[self.unknown], self.unknown).max())) for g, w in weights.items()}
        self.most_bias = float(np.delete(bias - bias[self.unknown], self.unknown).max())

    def found(self, tokens: list[str]) -> list[str]:
        """Weighted n-grams of a sentence, each once."""
        one, two, three = self.by_size
        out = list(one.keys() & set(tokens))
        if two:
            out += [two[p] for p in two.keys() & set(zip(tokens, tokens[1:], strict=False))]
        if three:
            out += [three[p] for p in three.keys() & set(zip(tokens, tokens[1:], tokens[2:], strict=False))]
        return out

    def logits(self, found: list[str]) -> np.ndarray:
        return self.bias + np.sum([self.weights[g] for g in found], axis=0) if found else self.bias

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        return _softmax(self.logits(self.found(tokens)) / self.temperature)

    def classify(self, tokens: list[str]) -> tuple[str, float]:
        """Family and probability; unknown under the threshold or when no template of the family agrees.

        The probabilities are not worked out where the weights' bound shows every family under the threshold.
        """
        found = self.found(tokens)
        bound = (self.most_bias + sum(map(self.most.__getitem__, found))) / self.temperature
        if bound < math.log(self.least / (1 - self.least)):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < self.least or not self.confirmed(family, tokens):
            return UNKNOWN, float(p[best])
        return family, float(p[best])

    def confirmed(self, family: str, tokens: list[str]) -> bool:
        """Whether a template of the family has most of its word pairs here, and nothing beside it says that this is only talk."""
        own, cues = set(zip(tokens, tokens[1:], strict=False)), CUES.intersection(tokens)
        return any(s and len(own & s) >= CONFIRM * len(s) and not cues - known for s, known in self.pairs[family])

    def to_json(self) -> str:
        kept = {g: w.tolist() for g, w in self.weights.items()}
        return json.dumps({"families": self.families, "bias": self.bias.tolist(), "weights": kept, "temperature": self.temperature, "least": self.least})

    @staticmethod
    def from_json(text: str) -> Model:
        held = json.loads(text)
        model = Model(held["families"], {g: np.array(w) for g, w in held["weights"].items()}, np.array(held["bias"]))
        model.temperature, model.least = held["temperature"], held["least"]
        return model

    def calibrate(self, held: list[tuple[str, list[str]]]) -> None:
        """Temperature of least log loss on held-out rows; the threshold that all but ``FALSE_RATE`` of their unknown ones stay under."""
        logits = np.array([self.logits(self.found(t)) for _, t in held])
        own = np.array([self.families.index(f) for f, _ in held])

        def loss(temperature: float) -> float:
            return -float(np.mean([math.log(max(_softmax(z)[k], 1e-12)) for z, k in zip(logits / temperature, own, strict=True)]))

        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        false = sorted(float(np.delete(_softmax(z), self.unknown).max()) for z in logits[own == self.unknown] / self.temperature)
        self.least = max(0.3, min(0.9, false[int((1 - FALSE_RATE) * (len(false) - 1))])) if false else 0.5


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(frame: DataFrame, id_col: str, text_col: str) -> Model:
    """Fit on template variants, sentences about licences and at most ``UNKNOWN_ROWS`` corpus sentences without licence words.

    The corpus sentences come from ``UNKNOWN_DOCS`` rows of least id hash, so neither their place nor
    their number in the table matters.  Every fifth row is held out for calibration.
    """
    spark = frame.sparkSession
    ids = frame.select(F.col(id_col).alias("__of")).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64("__of"), "__of").limit(UNKNOWN_DOCS)
    drawn = frame.join(F.broadcast(ids), F.col(id_col) == F.col("__of"), "left_semi")  # at most UNKNOWN_DOCS ids
    lines = (
        drawn.select(F.explode(F.split(F.col(text_col), r"\n|(?<=[.!?])\s")).alias("line"))
        .filter(F.length("line").between(20, 2000) & ~F.col("line").rlike(_HINTS))
        .orderBy(F.xxhash64("line"), "line")
        .limit(UNKNOWN_ROWS)
        .collect()
    )
    prose = [words(r["line"]) for r in lines]
    rows = training_rows(prose) + [(UNKNOWN, t) for t in prose] + [(UNKNOWN, words(t)) for t in TALK for _ in range(4)]
    fit, held = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    data = spark.createDataFrame([(f, grams(t)) for f, t in fit], "family string, grams array<string>").coalesce(2).cache()
    counted = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, minDF=2, binary=True)
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc")
    regression = LogisticRegression(
        family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60, featuresCol="features", labelCol="label"
    )
    fitted = Pipeline(stages=[index, counted, regression]).fit(data)
    data.unpersist()
    families, vocabulary = fitted.stages[0].labels, fitted.stages[1].vocabulary
    matrix, bias = fitted.stages[2].coefficientMatrix.toArray(), fitted.stages[2].interceptVector.toArray()
    model = Model(list(families), {g: matrix[:, k] for k, g in enumerate(vocabulary) if matrix[:, k].any()}, bias)
    model.calibrate(held)
    return model


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Keep a model as one text row, for scans of other tables or later runs."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def load(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path, wholetext=True).first()[0])


def scan(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Licence families of each text with the sentences that show them.

    The classifier judges every sentence of every line, so a licence line inside running text is found,
    and every sentence that is wrapped over lines of one paragraph (lines without a blank one between).
    ``families`` lists distinct families in order of appearance, ``spans``
    the sentences (start and end in code points, family, probability).  The model, whose size does
    not grow with the corpus, goes to every task; all texts are read whole.  Null and empty
    texts have no licences; repeated rows come out alike; an empty table gives no rows.
    """
    model = model or train(frame, id_col, text_col)

    def make():
        @lru_cache(maxsize=20_000)
        def verdict(sentence: str) -> tuple[str, float]:
            return model.classify(words(sentence))

        def row(ident, text):
            spans = []
            for start, end, sentence in sentences_of(text or ""):
                family, p = verdict(sentence)
                if family != UNKNOWN:
                    spans.append({"start": start, "end": end, "family": family, "probability": round(p, 4)})
            alone = len(spans)
            for start, end, sentence in wrapped(text or ""):
                family, p = verdict(sentence)
                if family != UNKNOWN and not any(x["family"] == family and x["start"] < end and start < x["end"] for x in spans[:alone]):
                    spans.append({"start": start, "end": end, "family": family, "probability": round(p, 4)})
            if len(spans) > alone:
                spans.sort(key=lambda x: (x["start"], x["end"]))
            return ident, list(dict.fromkeys(s["family"] for s in spans)), len(spans), spans

        return row

    ddl = (
        f"{id_col} {kind(frame, id_col)}, families array<string>, n_paragraphs long,"
        " spans array<struct<start:long,end:long,family:string,probability:double>>"
    )
    return map_rows(frame, [id_col, text_col], ddl, make)


_STOP = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý])")


def sentences_of(text: str):
    """(start, end, text) of the sentences of each line."""
    at = 0
    for line in text.split("\n"):
        start = 0
        for stop in _STOP.finditer(line):
            yield at + start, at + stop.start(), line[start : stop.start()]
            start = stop.end()
        if start < len(line):
            yield at + start, at + len(line), line[start:]
        at += len(line) + 1


#: Lines in a row; anchored at a line's start and without stepping back, so every character is read once.
_PARAGRAPH = re.compile(r"^(?![^\S\n]*+$)[^\n]++(?:\n(?![^\S\n]*+\n)[^\n]++)+", re.M)


def wrapped(text: str):
    """(start, end, text) of the sentences that run over line ends within a paragraph."""
    for paragraph in _PARAGRAPH.finditer(text):
        whole, at, start = paragraph[0], paragraph.start(), 0
        for stop in (*_STOP.finditer(whole), None):
            end = stop.start() if stop else len(whole)
            if whole.find("\n", start, end) >= 0:
                yield at + start, at + end, whole[start:end]
            start = stop.end() if stop else end


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
