"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fathomlake.llm import decontamination, jaccard, licences, packing, quality, sharding, substrings, suffix, tokens, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, rep long, row long, slot int"


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("aeiournstlk") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(rng, 120)
    long = prose(rng, 9000)
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, "one two three"), (8, "One two  three"),
        (9, prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60)), (10, prose(rng, 50) + " " + passage + " tail " + prose(rng, 40)),
        (11, long), (12, "for " * 900), (13, "naïve Σας ΣΑΣ <|endoftext|> ça va\r\n" * 40), (14, passage[:420]), (None, base), (2, base), (15, "x" * 399), (16, "x" * 400), (17, "x" * 401),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i == 1 else "en", "s", len(t or ""), "l", 0, 0, 0) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def grams(text):
    w = [x.decode() for x in (text or "").lower().encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, none, texts):
    one = {i: grams(t) for i, t in texts if i is not None}
    links = {i: {j for j in one if j != i and one[i] and one[j] and 5 * len(one[i] & one[j]) >= 4 * len(one[i] | one[j])} for i in one}
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert set(got) == set(one)
    for i in one:
        assert got[i].n_links == len(links[i]), i
        reach = {i}
        while more := {k for j in reach for k in links[j]} - reach:
            reach |= more
        assert got[i].class_id == min(reach), i
    assert jaccard.near_duplicates(none).count() == 0


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(1)
    base = prose(rng, 200).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: grams(t) for i, t in rows}
    want = {i: sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets}
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_packing(docs, none, texts):
    rows = packing.pack_documents(docs).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= sum(r.length for r in rows) / 2048 + 2
    assert packing.pack_documents(none).count() == 0


def test_ids_are_the_librarys():
    mine, t = packing._Ids(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counter, w = tokens.Counter(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    alphabet = " \n\t\r\x1c\x85  ab'sé1,.$ßΣİ中\U0001f600"
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    cases += [f"ab{chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x20000, 7) if not 0xD800 <= c < 0xE000] + ["<|endoftext|>a <|startoftext|>", "ꟋꟜ"]
    for s in cases:
        assert mine.text(s) == np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)
        assert counter.count([s])[0] == len(w.encode(s, add_special_tokens=False).ids), repr(s)


def test_token_counts(docs, none, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in texts)
    assert Counter(map(tuple, tokens.count_tokens(docs, path).collect())) == want
    assert tokens.count_tokens(none, path).count() == 0


def test_sharding(spark, docs, none, texts):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 20)).otherwise(F.repeat(F.col("id").cast("string"), 10)).alias("text"))
    rows = sharding.shard_by_bytes(many, 10, rows_a_task=100).collect()
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 10
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(none).count() == 0


def test_repeated_bytes(docs, none, texts):
    starts = Counter(d[p : p + 400] for _, t in texts for d in [(t or "").encode()] for p in range(len(d) - 399))
    want = Counter()
    for i, t in texts:
        d = (t or "").encode()
        keep = bytearray(b"\1" * len(d))
        for p in range(len(d) - 399):
            if starts[d[p : p + 400]] > 1:
                keep[p : p + 400] = bytes(400)
        runs = sum(not k and (j == 0 or bool(keep[j - 1])) for j, k in enumerate(keep))
        rest = bytes(x for x, k in zip(d, keep, strict=True) if k)
        want[i, len(d), len(d) - len(rest), runs, hashlib.sha256(rest).hexdigest()] += 1
    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, suffix.remove_repeats(docs, fields).select("doc.doc_id", *fields).collect())) == want
    assert suffix.remove_repeats(none, fields).count() == 0


def test_decontamination(spark, docs, none, texts):
    words = texts[10][1].split()
    items = [(1, " ".join(words[100:130])), (2, " ".join([*words[300:320], "x", *words[321:330]])), (3, "never " * 3), (4, None), (5, "one two three four"), (6, " ".join(words[8000:8400])), (6, " ".join(words[8000:8400]))]
    got = Counter(map(tuple, decontamination.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()))
    want = Counter()
    five = lambda t: {g for g in grams(t) if len(g) == 5}
    for i, t in texts:
        for k, x in items:
            q = five(x)
            if q and 5 * (m := len(q & five(t))) >= 4 * len(q):
                want[i, k, len(q), m, m / len(q)] += 1
    assert got == want and want
    assert decontamination.contained_items(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def base_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams3 = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams3[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_counts(spark, docs, none, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in texts] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.apply_rules(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((i, *base_counts(t)) for i, t in texts)
    assert all(r.kept != r.base_failed for r in rows)  # too few labels for any cutoff
    assert quality.apply_rules(none, labels).count() == 0


def test_cutoffs_bound_false_rejections(spark):
    n = 4000
    good = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(False).alias("base_failed"), *[F.when(F.col("id") % 200 == 0, F.lit(0.25)).otherwise(0.01).alias(r) for r in quality.GRID])
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = quality.cutoffs(good, labels).first()
    from math import exp, lgamma, log

    pmf = lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(quality.ALPHA) + (n - j) * log(1 - quality.ALPHA))
    level = quality.DELTA / len(quality.GRID)
    assert sum(pmf(j) for j in range(21)) <= level  # 20 of 4000 pass at 1 %
    assert got.max_symbol_rate == 0.02
    p = spark.createDataFrame([(n, 20), (n, 35), (300, 0)], "n long, k long").select(quality.tail("n", "k", quality.ALPHA)).collect()
    for (x,), (m, k) in zip(p, [(n, 20), (n, 35), (300, 0)], strict=True):
        exact = sum(exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * log(quality.ALPHA) + (m - j) * log(1 - quality.ALPHA)) for j in range(k + 1))
        assert abs(x - exact) < 1e-9


def test_repeated_units(docs, none, texts):
    rows = {(r.doc_id, r.n_chars): r for r in substrings.remove_repeated_units(docs).collect()}
    assert len(rows) == len({(i, len(t or "")) for i, t in texts})
    assert rows[1, len(texts[0][1])].n_removed == 0 and rows[2, len(texts[0][1])].kept == ""
    assert rows[None, len(texts[0][1])].n_removed == 0
    for r in rows.values():
        text = next(t for i, t in texts if i == r.doc_id and len(t or "") == r.n_chars) or ""
        for a, b in (map(int, s.split("-")) for s in r.spans.split(",") if s):
            text = text[:a] + "\0" * (b - a) + text[b:]
        assert text.replace("\0", "") == r.kept
    assert substrings.remove_repeated_units(none).count() == 0


def test_licences(spark, docs, none):
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "The house by the river was sold on Friday to an old judge."), (3, None), (4, ""), (4, "All rights reserved."), (None, "Licensed under the Apache License, Version 2.0.")]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1): ("mit", True), (4, 0): ("proprietary", True), (None, 0): ("apache", True)}
    assert licences.scan(none).count() == 0


#: Written apart from the statements that the model is trained on.
LICENCES = [
    ("Available under the EUPL-1.2", "eupl"), ("Freigegeben unter der MIT Lizenz", "mit"), ("Distributed under the GPLv3", "gpl"), ("Unter der GNU General Public License veröffentlicht", "gpl"), ("Released under the terms of the ISC license", "isc"),
    ("Diese Software darf unter den Bedingungen der Apache License 2.0 genutzt werden.", "apache"), ("Ce logiciel est distribué sous licence MIT.", "mit"), ("Este software se distribuye bajo licencia GPLv3.", "gpl"), ("Inhalte stehen unter CC BY-SA 4.0, sofern nicht anders angegeben.", "cc-by-sa"),
    ("Except where otherwise noted, content on this site is licensed under CC BY 4.0", "cc-by"), ("Photo by J. Doe, CC BY-NC 2.0", "cc-by-nc"), ("CC0 1.0", "public-domain"), ("© 2019 Acme Corp. All rights reserved.", "proprietary"), ("Alle Rechte vorbehalten", "proprietary"), ("Tous droits réservés, 2021", "proprietary"),
    ("This file is part of Foo and is licensed under the BSD 2-clause license", "bsd"), ("Mozilla Public License v2.0 applies to this module", "mpl"), ("The authors place this code in the public domain", "public-domain"), ("El contenido está bajo licencia Creative Commons Reconocimiento 4.0", "cc-by"), ("Lizenziert gemäß Apache-2.0", "apache"),
    ("This library is free software; you can redistribute it under the terms of the LGPL", "gpl"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
]
NO_LICENCES = [
    "He came with the bus, mit dem Rad", "The apache tribe lived in the plains", "I got my licence by post", "Die Lizenz des Piloten lief ab", "Sous la table, le chat dort", "La licencia del bar fue renovada", "the general public likes the mit in the sun", "Version 2.0 released",
    "public domain of ideas is what we discussed in class", "Er geht mit seiner Frau und mit Hund", "Under the bridge by the sea", "All rights and duties", "They released the prisoners under the terms of the peace", "creative and common", "by by by", "in der und mit zu er für", "Attribution of the painting is uncertain",
]


def test_licences_in_statements_that_were_not_trained_on(spark):
    rows = [(k, t) for k, (t, _) in enumerate(LICENCES)] + [(100 + k, t) for k, t in enumerate(NO_LICENCES)]
    got = {r.doc_id: r.family for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("family <> 'unknown'").collect()}
    assert sum(got.get(k) == family for k, (_, family) in enumerate(LICENCES)) >= 19
    assert sum(100 + k in got for k in range(len(NO_LICENCES))) <= 2


def test_toxicity(spark, none):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiournstlk") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    bad = ["vexword", "grimble", "snarlpot", "mudbrick"]
    rows = [(i, prose(rng, 80, words) + (" " + rng.choice(bad) + " x " + rng.choice(bad) if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (-1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    for i, _, x in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    wrong = sum(got[i].predicted != x for i, _, x in rows if got[i].held_out)
    assert wrong <= 5
    assert got[None].predicted == 0 and 0 <= got[-1].score <= 1
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_pipeline_stages(spark):
    from fathomlake.llm.common import cut, documents

    docs = documents(spark, SF)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, cut(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
        if name == "ngram_jaccard":
            sets = {r.doc_id: grams(r.text) for r in before.collect()}
            left = {r.doc_id for r in kept.collect()}
            for i in sets.keys() - left:
                assert sets[i], i
        if name == "decontamination":
            items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {r.doc_id for r in before.collect() if not any(5 * len(q & grams(r.text)) >= 4 * len(q) for q in items if q)}
            assert {r.doc_id for r in kept.collect()} == want
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_cuts_passages_of_51_words(spark):
    rng = random.Random(11)
    passage = prose(rng, 51)
    assert 200 <= len(passage) < 400
    rows = [(1, prose(rng, 90) + " " + passage + " " + prose(rng, 90)), (2, prose(rng, 70) + "\n" + passage + "\n" + prose(rng, 70)), (3, prose(rng, 200))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_bytes(spark, docs, SF).collect()}
    assert passage not in left[1] and passage not in left[2] and left[3] == rows[2][1]


def test_pipeline_keeps_one_row_of_each_group(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(9, a), (3, a), (3, b), (3, a), (None, a), (None, c), (None, c), (7, d), (7, d), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect())
    assert left == Counter([(3, a), (3, b), (None, c), (7, d), (8, None), (8, "")])


def test_repeated_lines_of_any_length(spark):
    long = "the old harbour has seven quiet piers."
    rows = [(1, f"menu\nOne. Two. Three.\n{long} Fine day.\nonly here\n"), (2, f"Menu \nnew. Two. words\none. two.  three.\nThen {long}\n"), (3, f"menu\nBefore. {long} Fine day.\n\nrare {long} ok"), (4, f"{long} Fine day.\nmenu")]
    got = {r.doc_id: r.kept for r in substrings.remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"new. Two. words\nThen {long}\n", 3: f"Before. {long} Fine day.\n\nrare {long} ok", 4: ""}


def test_toxic_terms_come_from_all_labels(spark):
    n = 30_000
    used = spark.range(n).select(F.col("id").alias("doc_id")).where(~toxicity.held_out(F.col("doc_id")))
    rare = {r.doc_id for r in used.orderBy(F.xxhash64("doc_id").desc()).limit(8).collect()}  # the last by hash
    rows = [(i, f"some plain words number{i % 7} " + ("rareword" if i in rare else "vexword" if i % 8 == 0 else "fine"), int(i % 8 == 0 or i in rare)) for i in range(n)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    assert [scorer.weights[i] > 0 for i in scorer.find("rareword")] == [True]
