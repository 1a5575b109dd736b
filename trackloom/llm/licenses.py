"""Licence scans: a trained paragraph classifier. Scoring uses DataFrame functions only.

A paragraph is what blank lines part; line ends inside it count as spaces. It is looked at in overlapping runs of words
of two sizes, so that a short notice in a long paragraph and a notice wrapped over lines are both seen whole. A run is
classified by multinomial logistic regression over the one- to three-word n-grams it contains; n-grams are those of the
training notices, so the weight table has a fixed size. One class is "unknown"; probabilities are calibrated by a
temperature fitted on notices whose templates were left out of training. A prediction counts if its probability reaches
a threshold and the run holds enough of the words of one of the family's templates.

Texts and runs are passed over unread only if they hold none of the `telling` words: of each template so many words
that a run without them can't hold enough of it to be confirmed.

Training runs on the driver in numpy, on the templates below with words dropped and others put around them, and on
texts that are no notices. It does not depend on the corpus.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored, table, words

#: Short notices of each licence family, and paragraphs of the public licence texts and headers.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3", "gnu agpl v3 license", "spdx license identifier agpl 3 0 or later",
        "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "apache": [
        "licensed under the apache license version 2 0", "spdx license identifier apache 2 0", "this project uses the apache 2 0 license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "bsd": [
        "released under the bsd license", "licensed under the 3 clause bsd license", "spdx license identifier bsd 3 clause", "distributed under the simplified bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "bsl": ["distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0", "licensed under the boost software license"],
    "cc-by": ["licensed under cc by 4 0", "licensed under the creative commons attribution 4 0 international license", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under the creative commons attribution noncommercial 4 0 international license", "this work is licensed under a creative commons attribution noncommercial 4 0 license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under the creative commons attribution sharealike 4 0 international license", "text is available under the creative commons attribution sharealike license"],
    "cc0": ["released under cc0 1 0 universal public domain dedication", "licensed under cc0", "cc0 1 0 universal", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "epl": [
        "licensed under the eclipse public license version 2 0", "spdx license identifier epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3", "this program is free software licensed under the gnu gpl version 2 or later", "spdx license identifier gpl 3 0 or later",
        "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "isc": ["released under the isc license", "licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2 1", "gnu lgpl v3 license", "spdx license identifier lgpl 2 1 or later",
        "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "mit": [
        "released under the mit license", "licensed under the mit license", "spdx license identifier mit", "distributed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at mozilla org",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx license identifier unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
    ],
    "zlib": [
        "released under the zlib license", "spdx license identifier zlib", "licensed under the zlib license",
        "in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ],
}

#: Texts with words of notices that are no notices of a family.
NO_NOTICE = [
    "all rights reserved copyright by the author", "a driving license is required", "the license agreement was signed in march", "permission to enter was refused",
    "released under pressure from the public", "the general public was not licensed to enter version 2", "copyright notice", "he lost his fishing licence last year",
    "the university mit is in boston", "this license is proprietary and confidential", "public domain songs are free", "creative people share their common work", "version 3 0 of the program",
    "see the file license for details", "the software is provided as is without warranty of any kind", "you should have received a copy of the letter along with this parcel",
    "for the purpose of this agreement the software means the program", "in no event will the bank be liable for loss of profit", "subject to the terms of the contract of sale",
    "an eclipse of the sun is public this year", "the apache helicopter landed on the base", "mozilla published version 2 of the browser", "she received a boost from the new software",
]

#: Words that any English text holds; they tell nothing, and stand around notices in training.
COMMON = "the of and to a is in for or by any with this that you be not as it on at are was he she his her from all can will one have has had but if an no they we".split()

#: Words of templates that much other text holds too.
PLAIN = "above agreed basis forms held into its kind library list made met must shall subject use along anyone arising at authors available binary clause code conditions copies copy damages derived documentation either event file files following form free from general holder included international law may mit name names notice obtain or person portions program project public purpose received required rights should source terms text under universal unless use used uses version will without work writing".split()

#: Sizes of the runs of words that are looked at, and how far each is moved on.
RUNS = ((16, 8), (48, 24))

UNKNOWN = "unknown"
THRESHOLD, CONFIRM, SEED = 0.5, 0.8, 42
_word = re.compile(WORD)
_blank = r"\n[ \t\r]*\n"


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def telling(confirm: float = CONFIRM) -> list[str]:
    """Words of which any run that holds a share `confirm` of a template's words holds one at least: as many words of
    each template as can be missing, and one more; words of many templates first, common, plain and short ones last."""
    forms = [set(t.split()) for ts in TEMPLATES.values() for t in ts]
    uses = {w: sum(w in f for f in forms) for f in forms for w in f}
    out: set[str] = set()
    for f in forms:
        missing = len(f) - math.ceil(confirm * len(f) - 1e-9)
        out |= set(sorted(f, key=lambda w: (w in COMMON, len(w) < 2, w in PLAIN, -uses[w], w))[: missing + 1])
    return sorted(out)


def samples(rng, each: int = 16) -> tuple[list[set[str]], np.ndarray, np.ndarray]:
    """n-gram sets, class numbers, and the number of the template or text that each was made from (-1: of several)."""
    found, label, origin = [], [], []
    filler = [*COMMON, *(f"filler{i}" for i in range(40))]
    around = lambda: list(rng.choice(filler, rng.integers(0, 16)))

    def add(tokens, k, source):
        found.append(grams([*around(), *tokens, *around()]))
        label.append(k)
        origin.append(source)

    families = sorted(TEMPLATES)
    made = [(t.split(), k) for k, f in enumerate(families) for t in TEMPLATES[f]] + [(t.split(), len(families)) for t in NO_NOTICE]
    for source, (tokens, k) in enumerate(made):
        for _ in range(each):
            add([w for w in tokens if rng.random() > 0.08] or tokens, k, source)
    every = [w for t, _ in made for w in t]
    for _ in range(each * 20):
        # Words of notices in no order are no notice.
        add(list(rng.choice(every, rng.integers(1, 9))), len(families), -1)
    return found, np.array(label), np.array(origin)


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the regression, by gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        p = _softmax(x @ w + b) - y
        vw = 0.9 * vw - 0.5 * (x.T @ p / len(p) + 1e-4 * w)
        vb = 0.9 * vb - 0.5 * p.mean(0)
        w, b = w + vw, b + vb
    return w, b


@lru_cache(maxsize=1)
def model() -> tuple[list[str], list[str], np.ndarray, np.ndarray, dict]:
    """(classes, n-grams, weights with a row per n-gram, biases, both divided by the fitted temperature; and how the
    folds of unseen templates were told: family -> (right, of all))."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    classes = [*sorted(TEMPLATES), UNKNOWN]
    texts = [t.split() for ts in TEMPLATES.values() for t in ts] + [t.split() for t in NO_NOTICE]
    vocab = sorted(set().union(*map(grams, texts)))
    at = {g: i for i, g in enumerate(vocab)}
    found, label, origin = samples(rng)
    x = np.zeros((len(found), len(vocab)), np.float32)
    for i, f in enumerate(found):
        x[i, [at[g] for g in f if g in at]] = 1
    y = np.eye(len(classes), dtype=np.float32)[label]
    logit = np.zeros_like(y)
    for fold in range(3):
        held = origin % 3 == fold
        w, b = fitted(x[~held], y[~held])
        logit[held] = x[held] @ w + b
    loss = lambda t: -np.log(_softmax(logit / t)[np.arange(len(logit)), label] + 1e-12).mean()
    heat = min(np.geomspace(0.3, 5, 60), key=loss)
    told = logit.argmax(1)
    unseen = {c: (int((told[(label == k) & (origin >= 0)] == k).sum()), int(((label == k) & (origin >= 0)).sum())) for k, c in enumerate(classes)}
    w, b = fitted(x, y)
    return classes, vocab, (w / heat).astype(float), (b / heat).astype(float), unseen


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def word_runs(w: Column, size: int, step: int) -> Column:
    """(start, run) of overlapping runs of `size` words; one shorter run where there are not more words."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step).cast("int")))
    return F.transform(starts, lambda k: F.struct((k * step).alias("start"), F.slice(w, k * step + 1, size).alias("run")))


def scan(docs: DataFrame, threshold: float = THRESHOLD, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, family (of the surest confirmed notice, null if none), families (all of them, sorted,
    joined by commas; empty if none), n_notices (confirmed runs of one family that overlap are one), confidence (null
    if none).

    Null and empty texts have no notice; long texts are read whole. Repeated rows give repeated rows, an empty table
    none. Equal probabilities go to the family that comes first. Other columns are not looked at.
    """
    spark = docs.sparkSession
    classes, vocab, weights, bias, _ = model()
    names = [f"w{k}" for k in range(len(classes))]
    table_rows = [(g, *map(float, w)) for g, w in zip(vocab, weights, strict=True)]
    weight_table = spark.createDataFrame(table_rows, "gram string, " + ", ".join(f"{n} double" for n in names))
    gate = telling(confirm)

    text = F.coalesce(F.col(text_col), F.lit(""))
    pattern = f"(?i)(?<![a-z0-9])({'|'.join(gate)})(?![a-z0-9])"
    parts = F.when(text.rlike(pattern), F.filter(F.split(text, _blank), lambda p: p.rlike(pattern))).otherwise(F.array().cast("array<string>"))
    opened = stored(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), parts.alias("parts")), "licence-parts")

    paragraphs = opened.select("row", F.posexplode("parts").alias("part", "p")).select("row", "part", words(F.col("p")).alias("w")).where(F.size("w") > 0)
    runs = None
    for size, step in RUNS:
        own = paragraphs.select("row", "part", F.explode(word_runs(F.col("w"), size, step)).alias("r")).select("row", "part", "r.start", F.lit(size).alias("size"), F.col("r.run").alias("w"))
        runs = own if runs is None else runs.unionByName(own)
    runs = runs.where(F.arrays_overlap("w", F.array(*map(F.lit, gate))))
    at = ["row", "part", "start", "size"]

    def joined(n: int):
        listed = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, listed).otherwise(F.array().cast("array<string>"))

    every = F.concat(F.col("w"), joined(2), joined(3))
    found = runs.select(*at, F.explode(F.array_distinct(every)).alias("gram"))
    # The weight table has a row for each n-gram of the templates above: a fixed few thousand.
    sums = found.join(F.broadcast(weight_table), "gram").groupBy(*at).agg(*[F.sum(n).alias(n) for n in names])
    logits = F.array(*[F.col(n) + F.lit(float(b)) for n, b in zip(names, bias, strict=True)])
    scored = sums.select(*at, logits.alias("z")).withColumn("most", F.array_max("z"))
    mass = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", F.col("most")).cast("int"))
    scored = scored.select(*at, best.alias("family"), (1.0 / mass).alias("confidence")).where((F.col("family") != UNKNOWN) & (F.col("confidence") >= threshold))

    forms = spark.createDataFrame([(f, sorted(set(t.split()))) for f in sorted(TEMPLATES) for t in TEMPLATES[f]], "family string, form array<string>")
    held = F.size(F.array_intersect("w", "form")) / F.size("form")
    confirmed = scored.join(runs, at).join(F.broadcast(forms), "family").where(held >= confirm).groupBy(*at, "family").agg(
        F.max("confidence").alias("confidence"), (F.col("start") + F.max(F.size("w"))).alias("end")
    )
    own = Window.partitionBy("row", "family").orderBy("part", "start", "size")
    reach = F.max(F.struct("part", "end")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = reach.isNull() | (reach["part"] < F.col("part")) | (reach["end"] <= F.col("start"))
    marked = confirmed.withColumn("new", apart.cast("long"))
    surest = F.max_by("family", F.struct("confidence", (-F.col("part")).alias("early"), (-F.col("start")).alias("first"), (-F.col("size")).alias("small")))
    answers = marked.groupBy("row").agg(
        surest.alias("family"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.sum("new").alias("n_notices"), F.max("confidence").alias("confidence")
    )
    return opened.select("doc_id", "row").join(answers, "row", "left").select(
        "doc_id", "family", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), "confidence"
    )


def scan_text(text: str | None, threshold: float = THRESHOLD, confirm: float = CONFIRM) -> list[tuple[str, float, int, int, int]]:
    """The same rule for one text in plain Python, as a check, and without passing anything over: (family, probability,
    paragraph, start, end) of its confirmed runs."""
    classes, vocab, weights, bias, _ = model()
    at = {g: i for i, g in enumerate(vocab)}
    out = []
    for part, paragraph in enumerate(re.split(_blank, text or "")):
        tokens = _word.findall("".join(c.lower() if c.isascii() else c for c in paragraph))
        for size, step in RUNS:
            for start in range(0, max(1, len(tokens) - size + step), step):
                run = tokens[start : start + size]
                rows = [at[g] for g in grams(run) if g in at]
                if not rows:
                    continue
                p = _softmax((weights[rows].sum(0) + bias)[None])[0]
                k = int(p.argmax())
                forms = [set(t.split()) for t in TEMPLATES.get(classes[k], [])]
                if classes[k] != UNKNOWN and p[k] >= threshold and any(len(f & set(run)) / len(f) >= confirm for f in forms):
                    out.append((classes[k], float(p[k]), part, start, start + len(run)))
    return out


def op9_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
