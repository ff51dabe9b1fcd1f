"""Licence scans: a trained paragraph classifier, confirmed against templates.

A sparse logistic regression over word one- to three-grams tells licence families from
each other and from prose.  It is trained on the driver from the templates below, varied,
and from a bounded sample of the corpus as prose; its confidence is calibrated on wording
it was not trained on.  A paragraph that is licence-like but of no family with enough
confidence is ``unknown``; a predicted family is confirmed where the paragraph holds most
shingles of one of its templates.

Paragraphs end at blank lines, or where a line ends with a sentence; other line breaks
only wrap.  All texts are scored by DataFrame operations: paragraphs are met with the
model's grams, a broadcast table of bounded size, and their scores summed before any
shuffle.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, table
from .decontamination import word_array

# Names of common licences, by family.
NAMES = {
    "agpl": ["gnu affero general public license", "affero general public license version 3", "gnu agpl", "agpl"],
    "apache": ["apache license", "apache license version 2 0", "apache software license", "apache 2 0"],
    "bsd": ["bsd license", "bsd 3 clause license", "2 clause bsd license", "new bsd license", "modified bsd license"],
    "cc0": ["cc0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0 license"],
    "cc-by": ["cc by 4 0", "cc by 3 0", "creative commons attribution license", "creative commons attribution 4 0 international license"],
    "cc-by-nc": ["cc by nc 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "creative commons attribution noncommercial license",
                 "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["cc by sa 4 0", "cc by sa 3 0", "creative commons attribution sharealike license",
                 "creative commons attribution sharealike 4 0 international license"],
    "gpl": ["gnu general public license", "gnu general public license version 3", "gnu gpl", "gpl", "gpl v2", "gplv3"],
    "isc": ["isc license", "isc software license"],
    "lgpl": ["gnu lesser general public license", "lesser general public license version 2 1", "gnu lgpl", "lgpl",
             "gnu library general public license"],
    "mit": ["mit license", "mit x11 license", "mit expat license", "mit style license"],
    "mpl": ["mozilla public license", "mozilla public license v 2 0", "mozilla public license version 2 0", "mpl 2 0", "mpl"],
    "unlicense": ["unlicense", "unlicense license"],
}
# Sentences of common licence notices, by family.
NOTICES = {
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "apache": [
        "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses",
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    ],
    "cc0": [
        "dedicated to the public domain under cc0 1 0 universal",
        "to the extent possible under law the author has waived all copyright and related rights to this work",
    ],
    "cc-by": ["you are free to share and adapt the material under creative commons attribution as long as you give appropriate credit"],
    "cc-by-nc": ["you may share and adapt the material for noncommercial purposes only under creative commons attribution noncommercial"],
    "cc-by-sa": ["text is available under the creative commons attribution sharealike license additional terms may apply"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license if a copy of the mpl was not distributed with this file you can obtain one"],
    "proprietary": [
        "copyright all rights reserved no part of this publication may be reproduced without prior written permission",
        "no part of this document may be reproduced or transmitted in any form without the prior written permission of the publisher",
        "this software is proprietary and confidential unauthorized copying of this file is strictly prohibited",
        "proprietary and confidential all rights reserved",
        "all rights reserved",
        "copyright all rights reserved",
        "all rights reserved worldwide",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software in the public domain",
    ],
}
# Names of licences outside the families, which must come out as unknown.
OTHERS = [
    "eclipse public license version 1 0", "zlib license", "boost software license version 1 0", "open font license version 1 1",
    "artistic license version 2 0", "academic free license", "custom license see the license file",
    "common development and distribution license", "european union public license", "microsoft public license",
    "postgresql license", "python software foundation license", "php license", "openssl license", "license of the author",
]
# Statements that name a licence.
FORMS = [
    "licensed under {}", "licensed under the {}", "released under the {}", "released under {}", "available under the {}",
    "distributed under the terms of the {}", "this work is licensed under a {}", "this work is licensed under the {}",
    "this software is provided under the {}", "spdx license identifier {}", "subject to the terms of the {}",
    "the code is covered by the {}", "see the {} for details", "{}",
]
# Prose that shares words with licences.
CONFUSERS = [
    "he lost his driving license on the way to the station",
    "the apache helicopter flew over the valley",
    "she studied physics at mit before moving abroad",
    "the public was free to use the work of the museum",
    "general conditions in the region are hard without rain",
    "the version of the story that is told here",
    "a copy of the letter was sent to the author",
    "the software was slow and the files were lost",
    "the license plate of the car was provided by a person",
    "the warranty of the washing machine ends in may",
    "permission was granted to enter the source of the river",
    "the commons voted on the attribution of the painting",
]
# Words that carry no sense of a licence by themselves.
STOP = frozenset(
    "a above all along an and any are as at be by can except for from has have here him his how if in into is it its law "
    "long may met most must new no not of on one only or shall should under without "
    "other part person see she that the their this to v was we were which will with work you your 0 1 2 3 4 way".split()
)

NONE, UNKNOWN = "none", "unknown"
FAMILIES = sorted({*NAMES, *NOTICES})
#: What confirms a family: its names and notices.
TEMPLATES = [(f, t) for f in FAMILIES for t in (*NAMES.get(f, ()), *NOTICES.get(f, ()))]
#: Stands for the end of a document among its grams; no word holds this character.
LAST = "\x01"
#: Documented bounds of the sample of prose: its paragraphs, and the words taken of each.
PROSE, PROSE_WORDS = 2_000, 300
#: Where paragraphs end: blank lines, and line breaks after the end of a sentence.
BREAKS = r"\r?\n(?:[ \t]*\r?\n)+|(?<=[.!?][\"')\]]{0,2}[ \t]{0,2})\r?\n"
#: Parts that templates are dealt into for calibration; at most one in so many may be wrong.
FOLDS, WRONG = 4, 50
#: Word shingles of the template comparison, and the share of them that must be found.
SHINGLE, HELD = 3, 0.8


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def template_shingles(text: str) -> set[str]:
    words = text.split()
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))}


@dataclass
class Model:
    """``weights[gram]`` has a value for each of ``classes``; so has ``bias``."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    anchors: list[str]
    confidence: float
    temperature: float

    def __post_init__(self):
        # Paragraphs without a gram of the model are not scored at all.
        if self.bias[-1] < max(self.bias):
            raise ValueError("a paragraph without any gram must be prose")

    def logits(self, words: list[str]) -> np.ndarray:
        z = np.array(self.bias)
        for g in grams(words):
            if g in self.weights:
                z = z + self.weights[g]
        return z / self.temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Example:
    grams: set[str]
    label: int
    fold: int


def _fit(data: list[Example], use: np.ndarray, n: int, epochs: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Grams, weights and biases of a softmax regression over ``n`` classes, by Adam."""
    seen = Counter(g for e, u in zip(data, use, strict=True) if u for g in e.grams)
    names = sorted(g for g, k in seen.items() if k >= 5)
    index = {g: i for i, g in enumerate(names)}
    taken = [e for e, u in zip(data, use, strict=True) if u]
    row = np.array([r for r, e in enumerate(taken) for g in sorted(e.grams) if g in index], dtype=np.int64)
    col = np.array([index[g] for e in taken for g in sorted(e.grams) if g in index], dtype=np.int64)
    want = np.eye(n)[[e.label for e in taken]]
    by_col = np.argsort(col, kind="stable")
    heads, rows = np.searchsorted(col[by_col], np.arange(len(names))), row[by_col]
    w, b = np.zeros((len(names), n)), np.zeros(n)
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    starts, filled = np.unique(row, return_index=True)[1], np.unique(row)
    for step in range(1, epochs + 1):
        z = np.tile(b, (len(taken), 1))
        if len(filled):
            z[filled] += np.add.reduceat(w[col], starts, axis=0)
        g = (_softmax(z) - want) / len(taken)
        gw = np.add.reduceat(g[rows], heads, axis=0) if len(names) else w
        for k, (p, d) in enumerate(((w, gw + 1e-5 * w), (b, g.sum(axis=0)))):
            m[2 * k] = 0.9 * m[2 * k] + 0.1 * d
            m[2 * k + 1] = 0.999 * m[2 * k + 1] + 0.001 * d * d
            p -= 0.1 * (m[2 * k] / (1 - 0.9**step)) / (np.sqrt(m[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return names, w, b


def examples(prose: list[list[str]], copies: int, seed: int) -> tuple[list[Example], list[str], list[str]]:
    """Training examples, the classes and the anchors.

    Each notice is varied ``copies`` times, and all its copies go to one fold.  Each name
    is stated in every form, and the forms take turns with the folds; prose is dealt out.
    """
    draw = random.Random(seed)
    anchors = sorted({w for t in (*(t for _, t in TEMPLATES), *OTHERS, *FORMS) for w in t.split()} - STOP - {"{}"})
    known = set(anchors)
    # Licence paragraphs of the corpus itself are no examples of prose.
    marked = {"license", "licensed", "copyright", "licence", "spdx"}
    prose = [p for p in prose if p and not (marked & set(p))]
    filler = sorted({w for p in prose for w in p if w not in known}) or ["lorem", "ipsum", "dolor"]
    classes = [*FAMILIES, UNKNOWN, NONE]
    data: list[Example] = []

    def add(words: list[str], label: int, fold: int) -> None:
        data.append(Example({g for g in grams(words) if known & set(g.split())}, label, fold % FOLDS))

    def varied(text: str) -> list[str]:
        words = text.split()
        kept = [w for w in words if w in known or draw.random() > 0.08]
        around = [draw.choice(filler) for _ in range(draw.choice([0, 0, 0, 2, 6]))]
        cut = draw.randint(0, len(around))
        return [*around[:cut], *kept, *around[cut:]]

    for i, c in enumerate(classes):
        for k, name in enumerate(OTHERS if c == UNKNOWN else NAMES.get(c, ())):
            for j, form in enumerate(FORMS):
                for _ in range(2):
                    add(varied(form.format(name)), i, k + j)
        for k, text in enumerate(CONFUSERS if c == NONE else NOTICES.get(c, ())):
            for _ in range(copies):
                add(varied(text), i, k)
    for k, p in enumerate(prose):
        add(p, len(classes) - 1, k)
    return data, classes, anchors


def held_out_logits(data: list[Example], n: int, epochs: int) -> np.ndarray:
    """For each example, the logits of a model that was trained without its fold."""
    out = np.zeros((len(data), n))
    fold = np.array([e.fold for e in data])
    for k in range(FOLDS):
        names, w, b = _fit(data, fold != k, n, epochs)
        index = {g: i for i, g in enumerate(names)}
        for r in np.flatnonzero(fold == k):
            out[r] = b + sum((w[index[g]] for g in sorted(data[r].grams) if g in index), np.zeros(n))
    return out


def train(prose: list[list[str]], copies: int = 16, epochs: int = 120, seed: int = 5) -> Model:
    """Fit on varied templates against ``prose``, paragraphs as lists of words.

    Licences outside the families are a class of their own, ``unknown``.  Confidence is
    calibrated on templates that a model has not seen: a temperature by the least loss,
    and the least confidence at which at most one in ``WRONG`` predicted families is wrong.
    """
    data, classes, anchors = examples(prose, copies, seed)
    y, n = np.array([e.label for e in data]), len(classes)
    z = held_out_logits(data, n, epochs)
    losses = {}
    for t in (0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0):
        losses[t] = -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = min(losses, key=losses.get)
    confidence = least_confidence(_softmax(z / temperature), y)
    names, w, b = _fit(data, np.ones(len(data), dtype=bool), n, epochs)
    return Model(
        classes,
        {g: [float(x) for x in w[i]] for i, g in enumerate(names)},
        [float(x) for x in b],
        anchors,
        confidence,
        temperature,
    )


def least_confidence(probs: np.ndarray, y: np.ndarray) -> float:
    """The least confidence from which predicted families are right but for one in ``WRONG``."""
    top, guess = probs.max(axis=1), probs.argmax(axis=1)
    family = guess < probs.shape[1] - 2
    for c in np.unique(np.round(top[family], 3)):
        sure = family & (top >= c)
        if c >= 0.5 and (guess[sure] != y[sure]).sum() * WRONG <= sure.sum():
            return float(c)
    return 0.99


def _paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        F.filter(F.split(body(text_col), BREAKS), lambda x: x.rlike(r"\S")).alias("paragraphs"),
    )


def prose_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PROSE) -> list[list[str]]:
    """The first ``PROSE_WORDS`` words of one paragraph each of the ``most`` documents with the least hash of their id.

    Where an id is repeated, the least of its rows' paragraphs counts.  No documents, or
    none with an id, give no sample.
    """
    hashed = F.xxhash64("of", F.lit(3))
    some = docs.select(F.col(id_col).alias("of")).where("of is not null").distinct().orderBy(hashed, "of").limit(most)
    first = (
        docs.select(F.col(id_col).alias("id"), F.split(body(text_col), BREAKS).alias("p"))
        .join(F.broadcast(some), F.col("id") == F.col("of"))
        .select("id", F.expr("get(p, cast(pmod(xxhash64(id), size(p)) as int))").alias("p"))
        .select("id", F.slice(word_array(F.coalesce("p", F.lit(""))), 1, PROSE_WORDS).alias("w"))
        .groupBy("id")
        .agg(F.min("w").alias("w"))
        .orderBy("id")
        .collect()
    )
    return [list(r["w"]) for r in first]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, n_licence, n_unknown, families, confirmed`` of every row.

    Paragraphs end at ``BREAKS`` and are not blank.  ``n_licence`` counts those of a family,
    ``n_unknown`` those of other licences; ``families`` and ``confirmed`` are sorted and
    comma-joined.  Where classes tie, the first by name is taken, and prose before all.  A
    null or empty text has no paragraphs; a very long one is scanned whole, paragraph by
    paragraph; repeated rows each give a row; a null id is a value like any other; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [f"w{i}" for i in range(len(model.classes))]
    shingles = [template_shingles(t) for _, t in TEMPLATES]
    # Found shingles are counted for each template in bits of a few sums, wide enough for all.
    tally_bits = max(map(len, shingles)).bit_length()
    per_sum = 63 // tally_bits
    tallies = [f"c{i}" for i in range(-(-len(shingles) // per_sum))]
    # Bounded: grams of the training set and of the templates only.
    rows = {g: [*ws, *[0] * len(tallies)] for g, ws in model.weights.items()}
    for t, found in enumerate(shingles):
        for g in found:
            row = rows.setdefault(g, [*[0.0] * len(names), *[0] * len(tallies)])
            row[len(names) + t // per_sum] += 1 << (tally_bits * (t % per_sum))
    rows[LAST] = [*[0.0] * len(names), *[0] * len(tallies)]
    vocabulary = spark.createDataFrame(
        [(g, *vs) for g, vs in rows.items()],
        ", ".join(["gram string", *(f"{n} double" for n in names), *(f"{c} bigint" for c in tallies)]),
    )
    anchors = F.array(*[F.lit(a) for a in model.anchors])
    whole = _paragraphs(docs, id_col, text_col).withColumn("n", F.size("paragraphs"))
    # The row at the end takes the paragraph count along for documents without a licence.
    lines = whole.select(
        "rid", "doc_id", "n",
        F.posexplode_outer(F.concat("paragraphs", F.array(F.lit("")))).alias("at", "line"),
    ).withColumn("w", word_array(F.col("line")))
    # Every gram of the model holds an anchor, so a paragraph without one is prose.
    kept = lines.where((F.col("at") == F.col("n")) | F.arrays_overlap("w", anchors))
    pairs = "zip_with(w, slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> if(b is null, null, concat(a, ' ', b)))"
    grammed = kept.withColumn("w2", F.expr(pairs)).withColumn(
        "w3",
        F.expr("zip_with(w2, slice(w, 3, greatest(size(w) - 2, 0)), (a, b) -> if(b is null, null, concat(a, ' ', b)))"),
    )
    last = F.col("at") == F.col("n")
    # A paragraph that shares no gram with the table drops out here: it is prose too.
    scored = (
        grammed.select(
            "rid", "doc_id", "n", "at",
            F.explode_outer(
                F.when(last, F.array(F.lit(LAST))).otherwise(F.array_distinct(F.concat("w", "w2", "w3")))
            ).alias("gram"),
        )
        .join(F.broadcast(vocabulary), "gram")
        .groupBy("rid", "doc_id", "n", "at")
        .agg(
            *[(F.sum(c) + F.lit(model.bias[i])).alias(c) for i, c in enumerate(names)],
            *[F.sum(c).alias(c) for c in tallies],
        )
    )
    exps = [F.exp((F.col(c) - F.greatest(*names)) / model.temperature) for c in names]
    label = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position(F.array(*names), F.greatest(*names)).cast("int"))
    judged = scored.select(
        "rid", "doc_id", "n", "at", *tallies,
        label.alias("label"),
        (F.lit(1.0) / sum(exps[1:], exps[0])).alias("confidence"),
        # How far licences as a whole are ahead of prose.
        (F.greatest(*names[:-1]) > F.col(names[-1])).alias("licence"),
    ).withColumn(
        "label",
        F.when((F.col("at") == F.col("n")) | ~F.col("licence"), F.lit(NONE))
        .when((F.col("label") == UNKNOWN) | (F.col("confidence") < model.confidence), F.lit(UNKNOWN))
        .otherwise(F.col("label")),
    )
    held = F.lit(False)
    for t, (family, _) in enumerate(TEMPLATES):
        count = F.expr(f"shiftright(c{t // per_sum}, {tally_bits * (t % per_sum)}) & {(1 << tally_bits) - 1}")
        held = held | ((F.col("label") == family) & (count >= HELD * len(shingles[t])))
    told = judged.select(
        "rid", "doc_id", "n", "label", held.alias("held")
    )
    family = ~F.col("label").isin(NONE, UNKNOWN)
    return (
        told.groupBy("rid", "doc_id")
        .agg(
            F.max("n").cast("bigint").alias("n_paragraphs"),
            F.count(F.when(family, 1)).alias("n_licence"),
            F.count(F.when(F.col("label") == UNKNOWN, 1)).alias("n_unknown"),
            F.concat_ws(",", F.array_sort(F.collect_set(F.when(family, F.col("label"))))).alias("families"),
            F.concat_ws(",", F.array_sort(F.collect_set(F.when(family & F.col("held"), F.col("label"))))).alias("confirmed"),
        )
        .drop("rid")
    )


def op1_licences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(prose_sample(docs)))
