"""Licence scan: a trained paragraph classifier over sparse word n-grams, in DataFrame functions only.

A multinomial logistic regression over word 1- and 2-grams is trained on licence statements in four languages (frames in which
names of licences stand, and texts of the licences themselves) and on prose that grants nothing: the same frames with other words,
and sentences with words that licences have too. Every paragraph that holds an n-gram which speaks for a family is scored; without
one, no family reaches ``LIKELY``. A row is given for each paragraph in which one does.

The class ``unknown`` is calibrated out of fold: the statements are dealt to folds, each with all its variants, and scored by a model
that has not seen them; a family is predicted only above the least probability at which at most ``UNKNOWN_RATE`` of the unknown prose
would pass. A prediction is confirmed when the paragraph holds at least ``CONFIRM`` of the 2-grams of one of the family's statements.

A paragraph is a line; a line that doesn't end a sentence goes on in the next if that begins with a small letter.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, documents, written

UNKNOWN_RATE, CONFIRM, FOLDS = 0.02, 0.6, 3
#: N-grams whose weights are all smaller, either way, are left out of the model: common words speak for nothing.
LEAST_WEIGHT = 0.4
#: A paragraph gets a row if a family is so likely or more.
LIKELY = 0.05
#: A line end inside a paragraph.
WRAP = r"(?<![.!?:;\n])\n(?=[a-z(])"
#: Names of the licences of each family; texts of theirs that name none.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT licence", "MIT-Lizenz", "licencia MIT", "MIT"],
    "isc": ["ISC License", "ISC licence", "ISC-Lizenz", "licencia ISC", "ISC"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL", "LGPL", "GPLv3", "GPLv2 or later", "GPL-3.0-or-later", "GPL-2.0", "GNU Lesser General Public License", "LGPL-2.1", "GNU Affero General Public License", "AGPLv3", "licence publique générale GNU"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-style license", "BSD-Lizenz"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "eupl": ["European Union Public Licence", "EUPL", "EUPL-1.2", "EUPL v1.2", "Open-Source-Lizenz für die Europäische Union"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Namensnennung 4.0", "Creative Commons Reconocimiento 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0", "Creative Commons Paternité - Partage à l'identique"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 3.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivatives License", "Creative Commons Namensnennung - Nicht kommerziell"],
    "public-domain": ["CC0 1.0", "CC0", "CC0-1.0", "CC0 1.0 Universal public domain dedication", "Unlicense"],
    "proprietary": [],
}
TEXTS = {
    "apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "isc": ["Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU General Public License along with this program."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org."],
    "public-domain": [
        "This work has been released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This is free and unencumbered software released into the public domain.",
        "The author has dedicated the work to the public domain.", "Dieses Werk ist gemeinfrei.", "Dieses Bild wurde vom Urheber in die Gemeinfreiheit entlassen.", "Cette œuvre appartient au domaine public.", "Esta obra ha sido liberada al dominio público.", "Placed in the public domain by its author."],
    "proprietary": [
        "All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the copyright holder.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.",
        "Reproduction interdite sans autorisation écrite.", "Nachdruck nur mit schriftlicher Genehmigung des Verlags.", "Prohibida la reproducción total o parcial sin permiso escrito.", "This software is proprietary and confidential.", "Unauthorized copying of this file is strictly prohibited."],
}
#: Frames in which a name may stand, in four languages.
FRAMES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under the terms of the {}.", "Distributed under the {}.", "Available under {}.", "Available under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Text is available under the {}.",
    "This project is released under the {}.", "Published under {}.", "SPDX-License-Identifier: {}", "License: {}", "You may use it under the terms of the {}.", "Code in this folder is covered by the {}.", "The data are provided under the {}.",
    "Lizenziert unter der {}.", "Freigegeben unter der {}.", "Unter der {} veröffentlicht.", "Veröffentlicht unter {}.", "Dieses Werk steht unter der {}.", "Es gelten die Bedingungen der {}.", "Verfügbar unter {}.", "Lizenz: {}",
    "Sous licence {}.", "Publié sous la {}.", "Distribué selon les termes de la {}.", "Ce document est mis à disposition sous {}.", "Licence : {}",
    "Publicado bajo la {}.", "Licenciado bajo {}.", "Distribuido bajo los términos de la {}.", "Esta obra está disponible bajo {}.", "Licencia: {}",
]
#: What else stands in such frames, and prose that grants nothing, with words that licences have too.
OTHERS = [
    "supervision of the director", "name of his brother", "new management", "old bridge", "same conditions as last year", "rules of the game", "number 2.0", "general agreement", "public eye", "European Union", "Aufsicht der Leitung", "alten Brücke", "neuen Nummer", "Bedingungen des Vertrags", "öffentlichen Hand",
    "direction du maire", "pluie", "responsabilité générale", "dirección del alcalde", "lluvia", "responsabilidad pública",
]
PROSE = [
    "He lost his driving licence after the accident and had to walk to work.", "The council granted a licence to sell food at the market on Sundays.", "You need the permission of your parents to go on the trip.", "The warrant for the arrest was signed by a judge on Monday.",
    "The repair is free because the warranty of the machine has two years left.", "A fishing license costs ten dollars and is valid for a year.", "Poets have some license with grammar, and readers forgive them.", "The court ruled on a question of copyright between two publishers.",
    "The state plans to redistribute income by means of a new tax.", "She asked permission to leave early because she was ill.", "The pilot renewed her license and flew home the same day.", "Our licence plates were stolen from the car in the night.", "Copyright law differs from country to country, and so do its terms.",
    "They were given permission to dig on the hill near the old mill.", "The shop has a license for spirits but not for music.", "The results warrant a closer look at the method of the study.", "Many old songs are in the public domain, but their recordings are not.", "The doctor had no license to practise medicine in this state.",
    "The software license fee rose by ten percent last year.", "Redistribution of seats before the election was disputed.", "Without a warrant the police may not enter the house.", "The license office opens at nine and closes at four.", "All rights are earned, said the old man, and none of them are free.", "The permission slip must be signed by a teacher.",
    "The Apache helicopter landed near the village at noon.", "Researchers at MIT published a study of the sea.", "The gnu is a large antelope of the plains.", "Mozilla makes a browser that many people use.", "Creative people often work in common rooms.", "He was released under the new law and went home by train.", "The general public may visit the museum on Sundays.",
    "A copy of the letter was sent to the author of the book.", "The file was distributed with the first version of the program.", "Members of the European Union met in public.", "Version 2.0 of the program is faster than 1.0.", "Use of the source is free of charge for any person.", "The forms are subject to the approval of the board.", "The conditions of the contract are met by both.",
    "Er fährt mit dem Bus zur Arbeit und kommt mit dem Zug zurück.", "Sie kommt mit ihrer Schwester und mit den Kindern.", "Die Lizenz für den Ausschank wurde der Wirtin entzogen.", "Das Werk steht unter der Leitung eines neuen Direktors.", "Alle Rechte und Pflichten der Mieter stehen im Vertrag.", "Die Bedingungen der Arbeit haben sich verbessert.", "Unter der Brücke wohnt ein Mann mit Hund.",
    "Der Film wurde im Mai veröffentlicht und mit Lob bedacht.", "Eine Kopie des Schreibens liegt mit den Akten vor.", "Der Trainer verlor seine Lizenz und das Vertrauen der Spieler.", "Il a obtenu sa licence de droit à Paris.", "La licence du joueur a été suspendue pour un an.", "Sous la pluie, les termes de la lettre étaient illisibles.", "Tous les droits de douane ont été augmentés.",
    "Le domaine est ouvert au public le dimanche.", "Le document a été publié par le maire.", "Ses œuvres sont exposées sous verre.", "Perdió su licencia de conducir en mayo.", "La licencia de obras fue negada por el alcalde.", "El libro fue publicado bajo otro nombre.", "Los derechos del niño son de todos.", "El dominio del balón fue total y el público aplaudió.", "Según los términos de la carta, no hay permiso.",
]
#: Common words of German, one of which is also the name of a licence, in sentences by rule.
PROSE += [f"{s} mit {o}." for s in ("Er fährt", "Sie kommt auf der Straße", "Das Haus", "Ein Mann und die Frau", "Der Rat sprach", "Wir gehen in die Stadt", "Der Mann, der", "Eine Stadt, in der", "Wer bleibt, der", "Die Straße, die", "Sie lebt unter") for o in ("dem Bus", "der Zeit", "den Kindern", "einem Hund", "Geld", "zwei Türen und einer Bank", "ihr", "großer Freude")]
PROSE += [f"{s} ist {o}." for s in ("Das Tier", "Der Anfang", "Die Stadt", "In der Nacht", "Es", "Was für die einen gut") for o in ("alt", "neu und groß", "die Regel", "das Problem der Leute", "in der Nähe")]
PROSE += [f"{s} {o}." for s in ("The Apache people", "Some students of MIT", "The general public", "Many creative people", "Members of the Union", "By law all authors") for o in ("lived in the plains", "met on Monday", "may ask for a copy of the file", "are free to go", "have no rights in this case")]
CLASSES = ["unknown", *NAMES]


def templates() -> dict[str, list[str]]:
    """The statements of each family: its names in every frame, and its texts."""
    return {family: [frame.format(name) for name in names for frame in FRAMES] + TEXTS.get(family, []) for family, names in NAMES.items()}


def statements() -> list[tuple[int, int, str]]:
    """Training rows ``fold, label, text``: all frames filled; the families' texts and the prose whole, without their last or first words,
    and inside other words. A frame is in one fold with all that stands in it, and so is a text with its variants."""
    rows = []
    framed = [(0, other) for other in OTHERS] + [(label, name) for label, names in enumerate(NAMES.values(), 1) for name in names]
    for k, frame in enumerate(FRAMES):
        for label, name in framed:
            rows.append((k % FOLDS, label, frame.format(name)))
    texts = [(0, t) for t in PROSE] + [(label, t) for label, family in enumerate(NAMES, 1) for t in TEXTS.get(family, [])]
    for k, (label, text) in enumerate(texts):
        w = text.split()
        forms = {text, " ".join(w[: max(3, len(w) - 2)]), " ".join(w[-max(3, len(w) - 1) :]), f"Note that {text} See the file for more."}
        rows += [(k % FOLDS, label, form) for form in sorted(forms)]
    return rows


def words_of(text: Column) -> Column:
    """A word is letters, digits, dots and pluses, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}0-9.+]+|\.(?=\s|$)"), lambda w: w != "")


def grams(text: Column) -> Column:
    """Distinct word 1- and 2-grams."""
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))
    return F.transform(F.array(words_of(text)), lambda w: F.array_union(w, pairs(w)))[0]


def pairs(text: Column) -> Column:
    return F.filter(grams(text), lambda g: F.contains(g, F.lit(" ")))


#: Of the process: the statements and the learner are the same in every session.
_fitted: list[tuple] = []


def fitted(spark: SparkSession) -> tuple[list[tuple[str, list[float]]], list[float], float]:
    """What ``_fit`` gives, once a process."""
    if not _fitted:
        _fitted.append(_fit(spark))
    return _fitted[0]


def _fit(spark: SparkSession) -> tuple[list[tuple[str, list[float]]], list[float], float]:
    """Weights of each n-gram for each class, the intercepts, and the calibrated least probability."""
    rows = spark.createDataFrame(statements(), "fold int, label int, text string").coalesce(1).withColumn("grams", grams(F.col("text")))
    vocabulary = [r[0] for r in rows.select(F.explode("grams").alias("g")).distinct().orderBy("g").collect()]
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    learner = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=40)
    # A few thousand rows, the statements in this file.
    rows = counted.transform(rows).select("fold", "label", "features").cache()
    wrong = []
    for fold in range(FOLDS):
        trial = learner.fit(rows.where(f"fold <> {fold}")).transform(rows.where(f"fold = {fold} and label = 0"))
        wrong += [max(r["probability"][1:]) for r in trial.select("probability").collect()]
    wrong.sort()
    least = max(0.5, wrong[int((1 - UNKNOWN_RATE) * len(wrong))])
    model = learner.fit(rows)
    rows.unpersist()
    weights = model.coefficientMatrix.toArray()
    return [(g, weights[:, i].tolist()) for i, g in enumerate(vocabulary) if abs(weights[:, i]).max() >= LEAST_WEIGHT], model.interceptVector.tolist(), least


def telling(weights: list[tuple[str, list[float]]]) -> list[str]:
    """Words one of which every paragraph holds that has an n-gram which speaks for a family: of a pair the longer word."""
    speak = [g for g, w in weights if max(w[1:]) > w[0]]
    return sorted({max(g.split(), key=len) for g in speak})


@written
def scan(docs: DataFrame) -> DataFrame:
    """A row for each paragraph of ``docs(doc_id, text)`` that is of a licence family with a probability of ``LIKELY`` or more.

    Columns ``doc_id, paragraph`` (from 0), ``family`` ('unknown' or a key of NAMES), ``probability`` (of that family), ``overlap``
    (greatest share of one of its statements' 2-grams that the paragraph holds), ``confirmed``. ``unknown``: the likeliest family
    is under the calibrated probability, or may be another licence. Null and empty texts have no rows; a null doc_id stays null;
    repeated rows each have theirs; no rows give none. A paragraph of any length is one row until its n-grams are looked up.
    """
    spark = docs.sparkSession
    weights, intercepts, least = fitted(spark)
    k = len(CLASSES)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lines = texts.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", WRAP, " "), "\n")).alias("paragraph", "line"))
    lines = lines.where(F.arrays_overlap(words_of(F.col("line")), F.array(*map(F.lit, telling(weights)))))
    known = F.array_intersect(grams(F.col("line")), F.array(*[F.lit(g) for g, _ in weights]))
    lines = lines.withColumn("grams", known).where(F.size("grams") > 0)
    # Written once, so that the rows keep their ids.
    lines = cut(lines.withColumn("row", F.monotonically_increasing_id()), "paragraphs")
    # Both tables come from the statements in this file, so their size is bounded.
    table = F.broadcast(spark.createDataFrame(weights, "gram string, w array<double>"))
    hits = lines.select("row", "doc_id", "paragraph", F.explode("grams").alias("gram"))
    sums = [F.sum(F.get("w", F.lit(c))) + intercepts[c] for c in range(k)]
    scored = hits.join(table, "gram").groupBy("row", "doc_id", "paragraph").agg(F.array(*sums).alias("z"))
    top = F.array_max("z")
    scored = scored.withColumn("p", F.transform("z", lambda z: F.exp(z - top))).withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, y: a + y)))
    best = F.array_max(F.slice("p", 2, k - 1))
    scored = cut(scored.select("row", "doc_id", "paragraph", best.alias("best"), F.array_position(F.slice("p", 2, k - 1), best).cast("int").alias("class"), F.get("p", F.lit(0)).alias("p0")).where(F.col("best") >= LIKELY), "scored")
    shapes = [(c, j, p) for c, texts in enumerate(templates().values(), 1) for j, p in enumerate(texts)]
    shapes = spark.createDataFrame(shapes, "class int, template int, text string").select("class", "template", F.explode(pairs(F.col("text"))).alias("gram"))
    shapes = shapes.withColumn("n", F.count("*").over(W.partitionBy("class", "template")))
    asked = lines.select("row", "line").join(scored.select("row", "class"), "row").select("row", "class", F.explode(pairs(F.col("line"))).alias("gram"))
    held = asked.join(F.broadcast(shapes), ["class", "gram"]).groupBy("row", "template").agg((F.count("*") / F.first("n")).alias("share"))
    held = held.groupBy("row").agg(F.max("share").alias("share"))
    joined = scored.join(held, "row", "left")
    known = F.col("best") >= least
    family = F.when(known, F.element_at(F.array(*map(F.lit, CLASSES)), F.col("class") + 1)).otherwise("unknown")
    overlap = F.when(known, F.coalesce("share", F.lit(0.0))).otherwise(0.0)
    return joined.select("doc_id", "paragraph", family.alias("family"), F.when(known, F.col("best")).otherwise(F.col("p0")).alias("probability"), overlap.alias("overlap"), (overlap >= CONFIRM).alias("confirmed"))


def op2_license_scans(spark, sf_dir):
    return scan(documents(spark, sf_dir))
