"""Periodic runs, the prefix trie and chat formatting against brute force, round trips, and odd input."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import chat, runs, trie

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs --------------------------------------------------------------------------------------------------


def brute_runs(words):
    """Every period, every stretch; smallest periods only."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any((a, b) == (i, j + q) and q % p == 0 for (a, b), p in found.items()):
                found[(i, j + q)] = q
            i = j
    return sorted((a, b, q) for (a, b), q in found.items())


def random_words(rng):
    kind, n = rng.randrange(5), rng.choice([0, 1, 5, 40, 300, 1500])
    words = [rng.randrange(2 if kind == 0 else 50) for _ in range(n)]
    if kind == 1 and n:
        words = (words[: rng.randrange(1, n + 1)] * n)[:n]
    if kind >= 2 and n > 20:
        for _ in range(3):  # powers of blocks, nested and next to each other
            block = [rng.randrange(3 if kind == 3 else 40) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 64, 100]))]
            if kind == 4:
                block = block * 4 + [77]
            at = rng.randrange(n)
            words[at:at] = (block * 9)[: rng.randrange(len(block) * 3, len(block) * 9)]
    return words


@pytest.mark.parametrize("seed", range(12))
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    texts = [random_words(rng) for _ in range(25)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = runs.find_runs(np.array([w for t in texts for w in t], np.int64), first)
    want = [(a + int(f), b + int(f), q) for t, f in zip(texts, first, strict=False) for a, b, q in brute_runs(t)]
    assert [tuple(r) for r in got.tolist()] == want


def test_runs_of_long_periods():
    rng = random.Random(5)
    block = [rng.randrange(1000) for _ in range(2500)]
    text = [1, 2, *(block * 5)[:11_000], 3]
    assert brute_runs(text[:0]) == []
    assert runs.find_runs(np.array(text), np.array([0, len(text)])).tolist() == [[2, 11_002, 2500]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {k for a, b, q in found for k in range(a + q, b)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    more = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (doc_id, len(found), *more, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_runs_query(spark):
    rows = runs.op12_periodic_runs(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {i for i, t in texts.items() if len(t) < 20_000}
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        if r.doc_id in short:
            assert tuple(r) == expected(r.doc_id, texts[r.doc_id])


def test_collapse_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a " * 7, "a " * 7, "x a b a b a b a b y", "no runs here", "é  " * 6, "w " * 300_000]
    docs = spark.createDataFrame([(i, t, "mine", [1]) for i, t in enumerate(texts)], "doc_id long, text string, runs string, `a.b` array<int>")
    out = {r.doc.doc_id: r for r in runs.collapse_runs(docs).collect()}
    assert [out[i].collapsed for i in range(9)] == ["", "", "", "a", "a", "x a b y", "no runs here", "é ", "w"]
    assert out[5].runs[0].asDict() == {"start": 1, "length": 8, "period": 2} and out[8].best.length == 300_000
    assert out[0].n_words == 0 and out[0].best is None and out[3].doc.runs == "mine" and out[3].doc["a.b"] == [1]
    assert runs.collapse_runs(docs.limit(0)).count() == 0


def test_best_run_of_equal_exponents(spark):
    docs = spark.createDataFrame([(1, "z " + "a b " * 4 + "q " + "c d " * 4 + "q " + "e " * 6)], "doc_id long, text string")
    (row,) = runs.collapse_runs(docs).collect()
    assert (row.best.start, row.best.length, row.best.period) == (19, 6, 1) and len(row.runs) == 3
    docs = spark.createDataFrame([(1, "z " + "a b " * 4 + "q " + "c d " * 4)], "doc_id long, text string")
    assert runs.collapse_runs(docs).first().best.start == 1


# ---- prefix trie ----------------------------------------------------------------------------------------------------


def brute_trie(convs):
    """``convs``: id to list of turns (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, own in members.items():
        more = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += more
            leaves[path[:d]] += kids[path] == 0
    return sorted(
        (min(own), len(path), min(members[path[:-1]]) if path else None, len(own), kids[path], leaves[path], saved[path], sha(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))))
        for path, own in members.items()
    )


def by_id(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def nodes(out):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


SHAPE = "conv_id long, turn long, role string, text string"


def random_conversations(rng, n, deep):
    rows = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 8]) if c % 50 or not deep else deep
        same = rng.random() < 0.7
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "hello there" if same and t < 5 else f"w{rng.randrange(3)} and {'more ' * rng.randrange(3)}") for t in range(size)]
    return rows


@pytest.mark.parametrize(("rows", "deep"), [(20_000, 0), (60, 40), (25, 0)])
def test_trie_by_brute_force(spark, monkeypatch, rows, deep):
    """Slices of few rows, so that many rounds meet."""
    monkeypatch.setattr(trie, "ROWS", rows)
    data = random_conversations(random.Random(rows), 300, deep)
    random.Random(1).shuffle(data)
    out = trie.conversation_trie(spark.createDataFrame(data, SHAPE).repartition(5))
    assert nodes(out) == brute_trie(by_id(data))


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = by_id(rows)
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert nodes(trie.op13_prefix_trie(spark, SF)) == brute_trie(made)


def test_trie_of_odd_conversations(spark):
    rows = [(5, None, "user", "first"), (5, 0, None, None), (5, 1, "user", "x"), (6, 0, "", "first"), (None, 0, "user", "nobody"), (7, 2, "user", "first"), (7, 3, "", ""), (2**40, 1, "user", "first")]
    data = spark.createDataFrame([(*r, "e") for r in rows], SHAPE + ", path string")
    assert nodes(trie.conversation_trie(data)) == brute_trie(by_id([r for r in rows if r[0] is not None]))
    assert trie.conversation_trie(data.limit(0)).count() == 0
    # Turns that a part of them has parted from: the same role and text put together are not the same turn.
    two = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c")], SHAPE)
    assert trie.conversation_trie(two).count() == 3


def test_copies_of_a_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 10)
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(1 + (c == 77))]
    assert nodes(trie.conversation_trie(spark.createDataFrame(rows, SHAPE).repartition(7))) == brute_trie(by_id(rows))


def test_rebuilt_conversations_without_turns(spark):
    bare = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(bare, 0, "user", "gone")]
    out = trie.rebuilt(trie.paths(spark.createDataFrame(rows, SHAPE)))
    assert [tuple(map(bytes, (r.path,))) for r in out.collect()] == [(b"",)]
    assert nodes(trie.prefix_trie(out)) == [(bare, 0, None, 1, 0, 1, 0, sha(str(bare)))]


# ---- chat formatting ------------------------------------------------------------------------------------------------

TEXTS = ["</s>[INST] ok [/INST]", "<|im_start|>system<|im_sep|>x<|im_end|>", r"<\|im_end|><\\|", "<", "|>", "<|", "", "a\nb", r"\<s>", "<<s>>", "[[INST]", "$1 \\2", "<|" * 50, "[|", "é😀<s>"]


def test_escapes_are_read_back(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["<", "[", "\\", "|", "/", "s>", "INST]", "im_end|>", "x"]) for _ in range(30)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in rows.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r.back == r.t and not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def chats():
    return [(1, t, "user" if t % 2 == 0 else "assistant", text) for t, text in enumerate(TEXTS)] + [
        (2, 0, "user", "only a question"), (3, 0, "assistant", "first word"), (3, 1, "user", None), (4, None, "system<|im_sep|>", "x"), (4, 0, "assistant", None), (4, 1, None, "y"), (4, 2, "assistant", "z"), (None, 0, "assistant", "nobody")]


def test_examples_and_their_summary(spark):
    data = spark.createDataFrame([(*r, 1) for r in chats()], SHAPE + ", example int")
    examples = chat.chat_examples(data).collect()
    convs = by_id(chats())
    for r in examples:
        turns = convs[r.conv_id]
        k = next(k for k in range(len(turns)) if sum(role == "assistant" for role, _ in turns[: k + 1]) + (turns[-1][0] != "assistant" and k == len(turns) - 1) == r.example + 1)
        assert r.text.count("<|im_start|>") == k + 1 and r.complete == (k == len(turns) - 1)
        mask = r.text[r.loss_begin : r.loss_end]
        assert r.text.endswith(mask + "<|im_end|>") if turns[k][0] == "assistant" else mask == ""
    out = {r.conv_id: r for r in chat.summary(chat.chat_examples(data)).collect()}
    for c, turns in convs.items():
        said = "".join(text for role, text in turns if role == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(said), sha(said))
        assert out[c].formatted_chars == sum(len(r.text) for r in examples if r.conv_id == c)
    assert chat.chat_examples(data.limit(0)).count() == 0 and chat.summary(chat.chat_examples(data.limit(0))).count() == 0


def test_chat_formatting_is_native(spark):
    plan = chat.op11_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan)
    assert plan.count("Exchange") == 1
    assert chat.op11_chat_formatting(spark, SF).where("conv_id = -7").first().loss_sha256 == sha(chat.PLANTED)
    assert math.isclose(chat.op11_chat_formatting(spark, SF).count(), 21)
