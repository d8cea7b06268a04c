"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In each step every sequence finds its
pair of lowest rank, and all sequences merge theirs at once; what survives when no pair has a rank is the count.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

#: Letters whose lower case the library knows (Unicode 16) and this Python does not.
NEW_LOWER = (("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))
_memo: dict[str, "Counter"] = {}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Counter:
    """Counts tokens as the tokenizer file says: its pattern, its merges, its word end and its special tokens."""

    def __init__(self, path: str, most: int = 250_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.most, self.counts = most, {}
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]))
        self.split = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.wide = len(vocab) + len(spec["added_tokens"])
        pairs = np.array([vocab[a] * self.wide + vocab[b] for a, b in model["merges"]], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)

    def merge(self, pieces: list[str]) -> np.ndarray:
        """Symbols left of each piece; no piece is empty."""
        data = [p.encode() for p in pieces]
        size = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[raw]
        symbols[np.cumsum(size) - 1] = self.last[raw[np.cumsum(size) - 1]]
        owner = np.repeat(np.arange(len(size)), size)
        counts = size.copy()
        none = len(self.ranks)
        while len(symbols) > 1:
            key = symbols[:-1] * self.wide + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), none - 1)
            rank = np.where((self.pairs[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            lowest = np.full(len(counts), none)
            np.minimum.at(lowest, owner[:-1], rank)
            hit = (rank < none) & (rank == lowest[owner[:-1]])
            if not hit.any():
                break
            # Of equal symbols in a row only every second pair can merge, counted from the run's first.
            where = np.flatnonzero(hit)
            first = np.concatenate(([True], np.diff(where) > 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.merged[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
            left = np.bincount(owner, minlength=len(counts))
            active = lowest < none
            counts[active] = left[active]
            # Sequences in which nothing merged are finished and leave the arrays.
            symbols, owner = symbols[active[owner]], owner[active[owner]]
        return counts

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special tokens the text holds."""
        parts = self.special.split(text)
        out: list[str] = []
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            # One character at a time: the library gives a final sigma no form of its own.
            part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
            for upper, lower in NEW_LOWER:
                part = part.replace(upper, lower)
            out += self.split.findall(part)
        return out, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        if len(self.counts) > self.most:
            self.counts.clear()
        new = list({p for ps, _ in split for p in ps if p not in self.counts})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.counts.update(zip(part, self.merge(part).tolist(), strict=True))
        get = self.counts.__getitem__
        return [sum(map(get, ps)) + special for ps, special in split]


@written
def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each whole text; a null text is empty, a null doc_id stays null."""

    def run(batches):
        counter = _memo[tokenizer] if tokenizer in _memo else _memo.setdefault(tokenizer, Counter(tokenizer))
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                n = np.array(counter.count([t or "" for t in part.column(1).to_pylist()]), np.int64)
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
