"""Models, bounds and pipeline stages against independent computations; null, empty, repeated and clashing input."""

import random
import re
from collections import Counter
from math import comb, exp

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from fathomlake.llm import common, decontamination, licences, quality, sharding, substrings, suffix, toxicity

from .test_corpus_operators import SF, base_counts, grams, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


# ---- what the operators share ---------------------------------------------------------------------------------------


def test_components_read_each_link_once(spark, monkeypatch):
    """A dense group, a path in mixed order, loops, nulls and small groups: smallest vertices, by links that get fewer with each round."""
    rng = random.Random(3)
    path = [*range(1000, 1100)]
    rng.shuffle(path)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(900)] + list(zip(path, path[1:], strict=False)) + [(i, i + 1) for i in range(2000, 2100)] + [(-5, 5000), (7000, 7000), (None, 1), (2, None)]
    top = {v: v for p in pairs if None not in p and p[0] != p[1] for v in p}
    find = lambda v: v if top[v] == v else find(top[v])
    for a, b in pairs:
        if a in top and b in top:
            low, high = sorted((find(a), find(b)))
            top[high] = low
    sizes, plain = [], common.cut

    def counted(df, label):
        out = plain(df, label)
        sizes.extend([out.count()] if label == "edges" else [])
        return out

    monkeypatch.setattr(common, "cut", counted)
    with common.scratch(spark):
        got = {r.v: r.label for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got == {v: find(v) for v in top}
    rounds = sizes[: sizes.index(0) + 1]
    assert 2 <= len(rounds) <= 6 and all(b <= a / 2 for a, b in zip(rounds, rounds[1:], strict=False))


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://head:7077", "applicationId": "app"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    assert common.one_machine("local[8]") and common.one_machine("local") and not common.one_machine("local-cluster[3,2,1024]")


def test_operators_leave_their_result_and_nothing_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    common.release(spark)
    rows = spark.conf.get(common.BATCH_ROWS)
    out = suffix.remove_repeats(table(spark, [(1, "x" * 500), (2, "x" * 500)]), ["n_removed"])
    assert [r.n_removed for r in out.collect()] == [500, 500]
    assert len(list(tmp_path.glob("*-*"))) == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("fathomlake_")]
    assert spark.conf.get(common.BATCH_ROWS) == rows
    common.release(spark)
    assert not list(tmp_path.glob("*-*"))


def test_bucketed_tables_lie_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/here")
    with common.scratch(spark):
        held = common.bucketed(table(spark, [(1, "a"), (2, "b")]), "doc_id")
        assert held.count() == 2 and all(f.startswith(f"file://{tmp_path}/here/") for f in held.inputFiles())
    assert not list((tmp_path / "here").glob("*")) and not [t for t in spark.catalog.listTables() if t.name.startswith("fathomlake_")]


def test_results_of_two_stages_are_read_side_by_side(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [(1, text), (2, text), (3, "other words")])
    one = corpus_pipeline.one_of_each_group(spark, docs, SF)
    two = corpus_pipeline.drop_repeated_bytes(spark, docs.where("doc_id > 1"), SF)
    three = corpus_pipeline.one_of_each_group(spark, docs.where("doc_id > 2"), SF)
    assert (one.count(), two.count(), three.count(), one.count()) == (2, 2, 1, 2)
    common.release(spark)


# ---- models and bounds ----------------------------------------------------------------------------------------------


def test_quality_verdict_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        text = prose(rng, 60, [f"word{k}" for k in range(500)])
        if i % 10 == 0:
            text = text.replace(" ", " *** ", rng.choice((12, 20, 50)))
        elif i % 250 == 1:
            text = text.replace(" ", " !!! ", 20)
        rows.append((i, text, "en" if i % 3 else "de"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {i for i, _, _ in rows if i % 10}
    labels = spark.createDataFrame([(i, int(i in good)) for i, _, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.apply_rules(docs, labels).collect()}

    signal = {i: {r: got[i][r] for r in quality.GRID} for i in got}
    for i, text, _ in rows:
        n = len(text.split())
        assert signal[i]["symbol_rate"] == sum(c in quality.SYMBOLS for c in text) / n and signal[i]["bang_rate"] == text.count("!") / n
    for lang in ("en", "de"):
        held = [i for i, _, x in rows if x == lang and i in good and not got[i].base_failed]
        cut, last = dict.fromkeys(quality.GRID, float("inf")), None
        for rule, value in quality.STEPS:
            tried = {**cut, rule: value}
            k = sum(any(signal[i][r] > c for r, c in tried.items()) for i in held)
            if sum(comb(len(held), j) * quality.ALPHA**j * (1 - quality.ALPHA) ** (len(held) - j) for j in range(k + 1)) > quality.DELTA / 2:
                break
            cut = last = tried
        assert last is not None or lang == "de"
        for i, text, x in rows:
            if x == lang:
                assert got[i].kept == (not base_counts(text)[5] and not any(signal[i][r] > c for r, c in cut.items())), i


def test_label_model_is_em(spark):
    rng = np.random.default_rng(3)
    n, v = 4000, toxicity.VOTERS
    truth = rng.random(n) < 0.12
    on = np.r_[np.full(v - 1, 0.55), 0.03]
    off = np.r_[np.full(v - 1, 0.02), 0.9]
    vote = rng.random((n, v)) < np.where(truth[:, None], on, off)
    patterns, inverse, counts = np.unique(vote @ (1 << np.arange(v)), return_inverse=True, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float))
    q = model.posterior(patterns)[inverse]
    assert ((q >= 0.5) == truth).mean() > 0.99 and abs(model.prior - truth.mean()) < 0.02
    assert np.abs(model.rate[1] - vote[truth].mean(axis=0)).max() < 0.1

    # The same by loops over documents, where voters are not correlated: weights stay near 1.
    prior, rate, weight = 0.1, [[0.02] * (v - 1) + [0.9], [0.5] * (v - 1) + [0.05]], [1.0] * v
    some = vote[:300]
    small = toxicity.LabelModel(*(lambda u: (u[0], u[1].astype(float)))(np.unique(some @ (1 << np.arange(v)), return_counts=True)), rounds=2)
    for _ in range(2):
        post = []
        for row in some:
            z = np.log(prior / (1 - prior)) + sum(w * (np.log(b if x else 1 - b) - np.log(a if x else 1 - a)) for x, a, b, w in zip(row, *rate, weight, strict=True))
            post.append(1 / (1 + exp(-z)))
        post = np.array(post)
        prior = post.mean()
        rate = [[(p @ some[:, j] / 300 + 1e-4) / (p.sum() / 300 + 2e-4) for j in range(v)] for p in (1 - post, post)]
        rest = some - (np.array(rate[0]) + post[:, None] * (np.array(rate[1]) - np.array(rate[0])))
        cov = rest.T @ rest / 300 + 1e-9 * np.eye(v)
        weight = list(1 / np.maximum(1, np.abs(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))).sum(axis=0)))
    assert abs(small.prior - prior) < 1e-6 and np.abs(small.rate - np.array(rate)).max() < 1e-6 and np.abs(small.weight - weight).max() < 1e-6


def test_toxicity_on_awkward_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiournstlk") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    rows = [(i, prose(rng, 40, words) + (" vexword grimble" if i % 6 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in [*rows, *rows[:3], (None, "vexword grimble " * 30_000), (7000, None), (7001, " \n")]], "doc_id long, text string, found string, pattern string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 6 == 0), "x") for i, _ in rows] + [(None, 1, "x"), (1, None, "x"), (0, 1, "x")], "doc_id long, toxic int, text string")
    scorer = toxicity.train(docs, labels)
    got = toxicity.score(docs, scorer).collect()
    assert len(got) == 606 and all(r.predicted == (r.doc_id is None or (r.doc_id < 600 and r.doc_id % 6 == 0)) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert toxicity.keep_clean(docs, scorer).columns == docs.columns


def test_licence_scores_by_hand(spark):
    weights, intercepts, least = licences.fitted(spark)
    by, tell = dict(weights), set(licences.telling(weights))
    assert exp(max(intercepts[1:]) - intercepts[0]) < licences.LIKELY  # without a telling n-gram nothing is a licence
    texts = [x for _, _, x in licences.statements()][::25] + ["Some words, then: licensed under\nthe MIT License, as is.", "plain words", "", None, "all rights reserved. " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "p", 1.0) for i, t in rows], "doc_id long, text string, paragraph string, row double")
    want = Counter()
    for i, text in rows:
        for k, line in enumerate(re.sub(licences.WRAP, " ", text or "").split("\n")):
            w = [x for x in regex.split(r"[^\p{L}0-9.+]+|\.(?=\s|$)", line.lower()) if x]
            z = np.array(intercepts, float)
            for g in {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}:
                z += np.array(by.get(g, [0.0] * len(z)))
            p = np.exp(z - z.max())
            p /= p.sum()
            if p[1:].max() < licences.LIKELY:
                continue
            assert tell & set(w)
            known = p[1:].max() >= least
            want[i, k, licences.CLASSES[1 + int(p[1:].argmax())] if known else "unknown", round(float(p[1:].max() if known else p[0]), 6)] += 1
    got = Counter((r.doc_id, r.paragraph, r.family, round(r.probability, 6)) for r in licences.scan(docs).collect())
    assert got == want and sum(want.values()) > 20


# ---- operators on awkward rows --------------------------------------------------------------------------------------


def test_paragraphs_by_brute_force(spark):
    rng = random.Random(9)
    word = ["".join(rng.choice("aeiournstlk") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    shared = ". ".join(prose(rng, 9, word) for _ in range(6)) + "."
    line = prose(rng, 8, word) + "."
    rows = [(1, f"{prose(rng, 30, word)}. {shared} {prose(rng, 20, word)}."), (2, f"{line}\n{prose(rng, 40, word)}.\n{shared}"), (3, f"{prose(rng, 9, word)}\n{line}\nOh. {shared} No. {shared}"), (3, "x"), (4, None), (5, ""), (None, shared), (6, shared * 2000)]
    docs = spark.createDataFrame([(i, t, "g", 1) for i, t in rows], "doc_id long, text string, gone string, place int")
    form = lambda u: " ".join(u.split()).lower()
    lines = {k: [re.findall(r"[^.!?\n]+[.!?]*\n*|[.!?]+\n*|\n+", line) for line in re.findall(r"[^\n]*\n+|[^\n]+", t or "")] for k, (_, t) in enumerate(rows)}
    first: dict[str, tuple] = {}
    places = []
    for k, (i, _) in enumerate(rows):
        p = 0
        for line in lines[k]:
            for at, u in [(2 * p + 1, "".join(line)), *((2 * q, u) for q, u in enumerate(line, p) if len(line) > 1 and len(u.split()) >= substrings.LEAST)]:
                if i is not None and u.strip():
                    places.append((form(u), (i, k, at)))
                    first[form(u)] = min(first.get(form(u), (i, k, at)), (i, k, at))
            p += len(line)
    gone = {at for f, at in places if first[f] != at}
    for k, (i, text) in enumerate(rows):
        units = [(u, 2 * p + 1) for p, line in zip(np.cumsum([0, *map(len, lines[k])]).tolist(), lines[k], strict=False) for u in line]
        whole = [(i, k, line) in gone for _, line in units]
        long = [len(u.split()) >= substrings.LEAST for u, _ in units]
        marked = [whole[p] or (long[p] and (i, k, 2 * p) in gone) for p in range(len(units))]
        at = [p for p, x in enumerate(long) if x]
        for p, x in enumerate(long):
            if not x and not whole[p]:
                low, high = [q for q in at if q < p], [q for q in at if q > p]
                marked[p] = bool(low and high and marked[low[-1]] and marked[high[0]])
        kept, run = "", []
        for p, (u, _) in enumerate([*units, ("", 0)]):
            if p < len(units) and marked[p]:
                run.append(p)
                continue
            if sum(len(units[q][0].split()) for q in run) < substrings.PARAGRAPH:
                kept += "".join(units[q][0] for q in run if not whole[q])
            kept, run = kept + u, []
        got = [r.kept for r in substrings.remove_repeated_units(docs).where(F.col("doc_id").eqNullSafe(i) & (F.col("n_chars") == len(text or ""))).collect()]
        assert got == [kept], k


def test_items_of_every_size_partition_are_found(spark):
    """Items of 1 to 2,000 shingles, 0.8 to all of each in a long document and less in another; and documents just large enough."""
    rng = random.Random(6)
    words = [f"q{k}" for k in range(5000)]
    items, rows, want = [], [], set()
    for i, n in enumerate([1, 2, 3, 5, 8, 15, 16, 31, 40, 63, 64, 100, 127, 128, 300, 512, 1000, 2000]):
        w = [rng.choice(words) for _ in range(n + 4)]
        items.append((i, " ".join(w)))
        some = -(-4 * n // 5)
        part = " ".join(w[: some + 4])  # just enough shingles, and nothing else in the document
        rows += [(100 * i, part), (100 * i + 1, f"{prose(rng, 300, words)} {part} {prose(rng, 2500, words)}"), (100 * i + 2, f"{prose(rng, 50, words)} {' '.join(w)}")]
        want |= {(100 * i + k, i) for k in range(3)}
        if n > 4:
            rows.append((100 * i + 3, f"{prose(rng, 900, words)} {' '.join(w[: some + 3])}"))
    got = decontamination.contained_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    for n in (1, 5, 64, 1000):
        assert decontamination.least_shingles(n.bit_length() - 1) <= -(-4 * n // 5)


def test_passage_words_by_brute_force(spark):
    rng = random.Random(21)
    words = [f"v{k}" for k in range(400)]
    shared = prose(rng, 55, words)
    rows = [(i, f"{prose(rng, rng.randrange(5, 90), words)} {shared if i % 3 == 0 else ''} {prose(rng, 20, words)}") for i in range(12)] + [(20, shared), (21, None), (22, f"{shared} {shared}"), (23, shared.rsplit(" ", 5)[0])]
    n = suffix.PASSAGE
    seen = Counter()
    split = {i: (t or "").split() for i, t in rows}
    for w in split.values():
        seen.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    want = {i: len({k + j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(n)}) for i, w in split.items()}
    got = {r.doc.doc_id: r.n_passage_words for r in suffix.remove_repeats(table(spark, rows), ["n_passage_words"]).collect()}
    assert got == want and want[20] == 55 and want[23] == 0


def test_words_as_symbols_by_brute_force(spark):
    rng = random.Random(8)
    word = ["".join(rng.choice("aeiournstlk") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    passage = prose(rng, 51, word)
    rows = [(1, prose(rng, 90, word) + "\n" + passage.replace(" ", "\t ", 5) + " " + prose(rng, 30, word)), (2, f"{passage} {prose(rng, 10, word)}"), (3, passage.rsplit(" ", 1)[0]), (4, None), (5, "for " * 400), (None, "naïve Σας " * 60), (2, "for  " * 60 + "\n")]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, rid int, starts string")
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[p : p + 51]) for w in words for p in range(len(w) - 50))
    want = Counter()
    for (i, t), w in zip(rows, words, strict=True):
        hit = {q for p in range(len(w) - 50) if seen[tuple(w[p : p + 51])] > 1 for q in range(p, p + 51)}
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        text, runs = (t or "").encode(), sorted(q for q in hit if q - 1 not in hit)
        for p in reversed(runs):
            end = p
            while end + 1 in hit:
                end += 1
            text = text[: at[p][0]] + text[at[end][1] :]
        want[i, len(runs), text.decode()] += 1
    got = suffix.remove_repeats(docs, ["n_spans", "kept", "n_passage_words"], 51, suffix.WORDS).select("doc.doc_id", "n_spans", "kept").collect()
    assert Counter(map(tuple, got)) == want


def test_shards_are_written_whole(spark, tmp_path):
    docs = table(spark, [(i % 90, f"text {i % 50} " * (i % 7)) for i in range(200)] + [(None, None)])
    sharding.write_shards(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    sizes = [r.b for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 0.2 * sum(sizes) / 5
    assert all(len(list(p.glob("part-*"))) == 1 for p in (tmp_path / "out").glob("shard=*"))


def test_clashing_names_in_decontamination(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item, "a", 1), (1, item, "a", 1), (2, "other words here and there", "b", 2), (3, None, "c", 3), (None, f"x {item} y", "d", 4)], "doc_id long, text string, gone_text string, th long")
    items = spark.createDataFrame([(7, item, "z"), (8, None, "z"), (9, "", "z")], "item_id long, text string, item string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontamination.contained_items(docs, items).collect()) == [(0, 7), (1, 7), (1, 7)]
    left = decontamination.keep_uncontaminated(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3}
    assert decontamination.contained_items(docs, items.limit(0)).count() == 0


# ---- the pipeline ---------------------------------------------------------------------------------------------------


def test_each_stage_by_brute_force(spark):
    docs = common.documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)

    clean = common.cut(stages["toxicity"](spark, docs, SF), "clean")
    scorer = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    by_text = {r.doc_id: 1 / (1 + exp(-(scorer.bias + sum(scorer.weights[i] for i in {scorer.find.index[t] for w in set(re.findall(r"\w+", r.text.lower())) for t in toxicity.terms_of(w) if t in scorer.find.index})))) for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in by_text.items() if p < 0.5}

    rows = clean.collect()
    sets = {r.doc_id: grams(r.text) for r in rows}
    leader = {}
    for i in sorted(sets):
        if i not in leader:
            leader[i], todo = i, [i]
            while todo:
                a = todo.pop()
                for b in sets:
                    if b not in leader and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        leader[b] = i
                        todo.append(b)
    single = common.cut(stages["ngram_jaccard"](spark, clean, SF), "single")
    assert {r.doc_id for r in single.collect()} == set(leader.values())

    rows = single.collect()
    words = {r.doc_id: r.text.encode().split() for r in rows}
    seen = Counter(tuple(w[p : p + 51]) for w in words.values() for p in range(len(w) - 50))
    left = common.cut(stages["suffix_array_dedup"](spark, single, SF), "left")
    for r in left.collect():
        w = words[r.doc_id]
        hit = {q for p in range(len(w) - 50) if seen[tuple(w[p : p + 51])] > 1 for q in range(p, p + 51)}
        assert r.text.encode().split() == [x for q, x in enumerate(w) if q not in hit] and r.n_chars == len(r.text)

    pieces = stages["best_fit_packing"](spark, left, SF).collect()
    from .test_corpus_operators import Tokenizer, public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert total == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in left.collect()}
    assert max(Counter({s: sum(p.length for p in pieces if p.sequence_id == s) for s in {p.sequence_id for p in pieces}}).values()) <= 2048


def test_stages_on_awkward_rows(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    extra = "_fathomlake_row string, cut_bytes int, row_id int, gone_text string, kept string"
    rows = [(1, f"{prose(rng, 40)} {passage}"), (1, f"{passage} {prose(rng, 40)}"), (None, None), (None, prose(rng, 30)), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, 2, "g", "k") for i, t in rows], COLUMNS + ", " + extra.removeprefix("_fathomlake_row string, "))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() == 6
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
