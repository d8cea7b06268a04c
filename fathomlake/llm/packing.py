"""Best-fit packing of tokenised documents into sequences of a fixed length: hierarchical residual packing.

Every partition packs its own pieces best-fit, the longest first, and emits the bins that are nearly full. The others go
on as items of one size to a round with a quarter of the partitions, until one is left or a round no longer merges
enough. A round's partitions hold at most ``most`` items each, so no task ever takes in an unbounded set.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, drop, partitions, written
from .tokens import byte_chars

CAPACITY = 2048
#: The tokenizer file's special token, which it also finds inside texts.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_wide = re.compile(r"\s (?:\s|\Z)").search
_memo: dict[str, "_Ids"] = {}


class _Ids(dict):
    """Little-endian 32-bit ids of a word with the space before it.

    The tokenizer file's pattern takes a character and a space after it into one pre-token only in a run of white space, so
    a text without a space between two others is encoded word by word, each word once. The file's vocabulary and merges are run by the
    faster of the two byte-level BPE libraries; tests hold its ids against the file's own.
    """

    def __init__(self, path: str):
        super().__init__()
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items() if t != SPECIAL}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = array("I", [SPECIAL_ID]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        self[word] = ids = array("I", self.encode(word)).tobytes()
        return ids

    def text(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.special.join(self.text(x) for x in text.split(SPECIAL))
        if _wide(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + w] for w in rest])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and an id 0, cut at ``capacity`` if longer.

    A null text is empty and gives the id 0 alone; a null doc_id stays null; repeated rows are documents of their own.
    Of a longer document the first piece takes what does not divide.
    """

    def run(batches):
        ids = _memo[tokenizer] if tokenizer in _memo else _memo.setdefault(tokenizer, _Ids(tokenizer))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.text(text.as_py() or "") + b"\0\0\0\0"
                n, begin, k = len(data) // 4, 0, 0
                size = n % capacity or min(n, capacity)
                while begin < n:
                    for column, x in zip(out, (doc, k, begin, size, zlib.crc32(data[4 * begin : 4 * (begin + size)])), strict=True):
                        column.append(x)
                    begin, k, size = begin + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indexes) by best fit, the largest item first. The open bins are kept by what is left in them."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


_BINS = "fill int, full boolean, members array<long>, lengths array<int>"


def _round(items: DataFrame, capacity: int, enough: int, most: int) -> DataFrame:
    """Bins of each partition's items; the members of the items in a bin follow each other."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def packed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        fill = table["fill"].to_numpy()
        members, lengths = table["members"].combine_chunks(), table["lengths"].combine_chunks()
        bins = best_fit(fill, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64)
        ends = np.cumsum([len(b) for b in bins])
        got, sizes = members.take(pa.array(order)), lengths.take(pa.array(order))
        per_item = np.diff(got.offsets.to_numpy())
        at = np.concatenate(([0], np.cumsum(per_item)))[np.concatenate(([0], ends))].astype(np.int32)
        filled = np.add.reduceat(fill[order], np.concatenate(([0], ends[:-1])))
        flat = lambda x: x.flatten()
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(filled >= enough), pa.ListArray.from_arrays(pa.array(at), flat(got)), pa.ListArray.from_arrays(pa.array(at), flat(sizes))], ["fill", "full", "members", "lengths"])

    return items.select("fill", "members", "lengths").mapInArrow(run, _BINS)


def pack(items: DataFrame, capacity: int = CAPACITY, enough: float = 0.98, fan_in: int = 4, most: int = 200_000, least_gain: float = 0.005) -> DataFrame:
    """Pack rows with a unique ``pid`` and a ``length`` up to ``capacity``: ``pid, sequence_id, offset``.

    ``enough``: bins this full are emitted; ``fan_in``: partitions that meet in the next round; ``most``: items that a
    task holds at once. No rows give no rows. Rounds end when one partition has seen all underfull bins, or when a round
    took in less than ``least_gain`` of them, whatever their number.
    """
    spark = items.sparkSession
    n = partitions(spark)
    start = items.select(F.col("length").cast("int").alias("fill"), F.array("pid").alias("members"), F.array(F.col("length").cast("int")).alias("lengths"))
    bins = cut(_round(start.repartition(n), capacity, int(enough * capacity), most), "bins")
    done = [bins.where("full")]
    rest = bins.where("not full")
    left = rest.count()
    while n > 1 and left:
        n = max(-(-n // fan_in), -(-left // most))
        bins = cut(_round(rest.repartition(n), capacity, int(enough * capacity), most), "bins")
        done.append(bins.where("full"))
        rest = bins.where("not full")
        before, left = left, rest.count()
        if n > 1 and bins.count() > (1 - least_gain) * before:
            break
    for x in done:
        rest = rest.unionByName(x)
    at = F.transform(F.sequence(F.lit(0), F.size("members") - 1), lambda i: F.struct(F.element_at("members", i + 1).alias("pid"), F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("long"), lambda a, x: a + x).alias("offset")))
    return rest.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode(at).alias("x")).select("x.pid", "sequence_id", "x.offset")


@written
def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack ``docs(doc_id, text)``: a row per piece with its sequence and the place in it.

    Other columns of ``docs`` are not read. The pieces are written once; only their numbers and lengths go through the
    rounds.
    """
    made = pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity)
    made = cut(made.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return made.join(pack(made, capacity), "pid").drop("pid")


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
