"""Exact substring deduplication by distributed prefix doubling.

A symbol (a byte, or a word) goes if a string of ``length`` symbols that covers it also starts elsewhere. Prefix doubling
gives every position the rank of its first h symbols and, from the ranks at a position and h symbols on, that of its first
2h, until the rank is unique or h is past the threshold. A position whose shorter string is unique can be dropped at once,
and most are, so the positions are screened first by strings that every string at them contains:

1. Each start belongs to one anchor, the place of the least hash of a few symbols in the window of 0.7 ``length`` places that
   begins at the start; it depends on the symbols alone. All strings of one anchor share 0.3 ``length`` symbols after it. An
   anchor whose shared symbols are unique is dropped with all its starts.
2. An anchor whose starts' strings all lie in a stretch that occurs again is settled: all its starts repeat. The starts
   of the others, a few to a cell, share nearly ``length`` symbols: a cell whose shared symbols are unique is dropped, and
   one whose whole stretch occurs again is settled. Of settled equals one goes on, as what the others may repeat.
3. Only cells where a repeat begins or ends are left. Their positions are ranked by their first quarter of ``length``, and
   pairs of ranks are sorted and reranked at offsets of one and two quarters.

All keys are counted with partial sums and joined back; nothing gathers a group. An anchor whose key a task meets twice is
known to repeat and joins nothing, so a frequent key does not meet in one task. Strings are compared by 128 bits of hash from
step 2 on. The documents are exchanged once, into a table bucketed by row, which the later steps read in place.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bucketed, cut, documents, drop, written

LENGTH = 400
#: Passages of over 50 words.
PASSAGE = 51
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_table: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Unit:
    """What a text is a string of: bytes, or words as they stand between white space."""

    words: bool
    gram: int
    cell: int

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit value for each symbol of all texts, and where each text begins."""
        if self.words:
            w = S.words(texts, fold=False)
            return w.hash, w.first
        data, at = S.utf8(texts)
        return S._BYTE[data], at


BYTES, WORDS = Unit(False, 16, 16), Unit(True, 2, 4)


def _power(n: int, base: int) -> np.ndarray:
    held = _table.get(base)
    if held is None or len(held) < n:
        held = _table[base] = S.powers(max(n, 1 << 16), np.uint64(base))
    return held


class Prefix:
    """Hashes of any stretch of some symbols, from sums over their prefixes."""

    def __init__(self, values: np.ndarray, which: int):
        n, base = len(values), _BASES[which]
        self.back = _power(n + 1, pow(base, -1, 1 << 64))
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(n + 1, base)[:n], out=self.sum[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values[a:b]. The power of its place is divided out, so that equal stretches give equal hashes."""
        return S.mix((self.sum[b] - self.sum[a]) * self.back[a])

    def every(self, n: int) -> np.ndarray:
        """Of all stretches of ``n`` symbols."""
        h = self.sum[n:] - self.sum[:-n]
        h *= self.back[: len(h)]
        return S.mix(h)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the least of h[i:i + w], the last of equals."""
    n = len(h) - w + 1
    # The order of the hashes with later places first among equals, as one comparable number.
    best = h & ~np.uint64(0xFFFFFFFF)
    best |= np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(h), -1, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < w:
        best = np.minimum(best[:n], best[w - span : w - span + n])
    return (np.uint64(0xFFFFFFFF) - (best[:n] & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _window(length: int) -> int:
    return length * 7 // 10


def _twice(*keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs more than once in these arrays."""
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _anchors(length: int, unit: Unit):
    """Arrow function: rows (rid, text) to (rid, at, near, far, key, sure): an anchor, the span of its starts, its screen,
    and whether the screen is met again in the same slice of texts."""

    def run(batches):
        for batch in batches:
            for part in S.slices(batch, "text", 1_000_000):
                values, at = unit.symbols(part.column("text"))
                out = [np.zeros(0, np.int64)] * 5
                if len(values) >= length:
                    p = Prefix(values, 0)
                    place = _least(p.every(unit.gram), _window(length))
                    size = np.diff(at)
                    starts = np.flatnonzero(np.arange(length, length + len(place)) <= np.repeat(at[1:], size)[: len(place)])
                    if len(starts):
                        place, row = place[starts], np.repeat(np.arange(len(size)), size)[starts]
                        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
                        low, high = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
                        a, r = place[new], row[new]
                        out = [r, a - at[r], a - high, a - low, p.of(a, a + length - _window(length) + 1).view(np.int64)]
                rid = part.column("rid").take(pa.array(out[0]))
                columns = [pa.array(x.astype(t)) for x, t in zip(out[1:], ("i4", "i4", "i4", "i8"), strict=True)]
                yield pa.RecordBatch.from_arrays([rid, *columns, pa.array(_twice(out[4]))], ["rid", "at", "near", "far", "key", "sure"])

    return run


def _spans(part: pa.RecordBatch, at: np.ndarray, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The spans of all rows of ``part``: the row of each and its fields; the places in the first field count from the
    first text's begin."""
    spans = part.column("spans")
    row = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
    flat = spans.flatten()
    out = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(fields)]
    out[0] = out[0] + at[row]
    return row, out


def _whole(length: int, unit: Unit):
    """Rows (rid, text, spans of anchors) to the same anchors with 128 bits of all that their starts' strings cover."""

    def run(batches):
        for batch in batches:
            for part in S.slices(batch, "text", 1_000_000):
                values, at = unit.symbols(part.column("text"))
                row, (a, near, far, key) = _spans(part, at, 4)
                keys = [Prefix(values, k).of(a - far, a - near + length).view(np.int64) for k in (0, 1)]
                columns = [pa.array(x.astype("i4")) for x in (a - at[row], near, far)]
                yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(row)), *columns, pa.array(key), *map(pa.array, keys), pa.array(_twice(*keys))], ["rid", "at", "near", "far", "key", "w1", "w2", "sure"])

    return run


def _cells(length: int, unit: Unit):
    """Rows (rid, text, spans of anchors) to cells of starts with the keys of what they share and of all they cover."""
    n = unit.cell

    def run(batches):
        for batch in batches:
            for part in S.slices(batch, "text", 1_000_000):
                values, at = unit.symbols(part.column("text"))
                row, (a, near, far) = _spans(part, at, 3)
                first, last = near // n, far // n
                times = last - first + 1
                anchor = np.repeat(np.arange(len(a)), times)
                cell = first[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(times) - times, times)
                row, a, near, far = row[anchor], a[anchor], near[anchor], far[anchor]
                low, high = a - np.minimum(far, cell * n + n - 1), a - np.maximum(near, cell * n)
                p, q = Prefix(values, 0), Prefix(values, 1)
                core = (a - cell * n, a - cell * n - n + 1 + length)
                keys = [x.of(*span).view(np.int64) for span in (core, (low, high + length)) for x in (p, q)]
                places = [pa.array((x - at[row]).astype("i4")) for x in (low, high)]
                yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(row)), *places, *map(pa.array, keys), pa.array(_twice(*keys[2:]))], ["rid", "low", "high", "c1", "c2", "w1", "w2", "sure"])

    return run


def _positions(length: int, step: int, unit: Unit):
    """Rows (rid, text, open cells) to positions with the rank of their first ``step`` symbols, for the starts and all that
    their doubling will look at; ``goal``: a start."""

    def run(batches):
        for batch in batches:
            for part in S.slices(batch, "text", 1_000_000):
                values, at = unit.symbols(part.column("text"))
                row, (low, high) = _spans(part, at, 2)
                size = high + at[row] - low + 1
                goal = np.unique(np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                pos = np.unique(np.concatenate([goal + k for k in (0, step, length - 2 * step, length - step)]))
                own = np.searchsorted(at, pos, "right") - 1
                keys = [pa.array(Prefix(values, k).of(pos, pos + step).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(own)), pa.array((pos - at[own]).astype("i4")), pa.array(np.isin(pos, goal, assume_unique=True)), *keys], ["rid", "pos", "goal", "r1", "r2"])

    return run


def rerank(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``pid, rid, pos, goal, rank`` of the positions whose sort key ``by`` is not unique; the new rank of a position is the
    smallest ``pid`` of its equals. Spark sorts and counts the keys with partial sums, so a frequent one is no group."""
    equal = pairs.groupBy(*by).agg(F.min("pid").alias("head"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(equal.hint("shuffle_hash"), by).select("pid", "rid", "pos", "goal", F.col("head").alias("rank"))


def doubled(ranks: DataFrame, step: int, length: int) -> DataFrame:
    """Starts ``rid, pos`` whose ``length`` symbols occur again, from ranks by ``step`` symbols. The last two halves overlap
    if ``length`` is no multiple."""
    first, ranks = ranks, cut(rerank(ranks, ["r1", "r2"]), "ranks")
    drop(first)
    while step < length:
        offset = min(step, length - step)
        on = ranks.select("rid", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("next"))
        before, ranks = ranks, cut(rerank(ranks.join(on, ["rid", "pos"]), ["rank", "next"]), "ranks")
        drop(before)
        step += offset
    return ranks.where("goal").select("rid", "pos")


def repeated_starts(held: DataFrame, length: int = LENGTH, unit: Unit = BYTES) -> DataFrame:
    """``rid, low, high``: runs of starts (both ends included) in ``held(rid, text)`` whose ``length`` symbols start elsewhere too."""
    anchors = cut(held.mapInArrow(_anchors(length, unit), "rid long, at int, near int, far int, key long, sure boolean"), "anchors")
    again = anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = anchors.where("not sure").join(again.hint("shuffle_hash"), "key")
    kept = _by_row(anchors.where("sure").select("rid", "at", "near", "far", "key").unionByName(met.select("rid", "at", "near", "far", "key")), "at", "near", "far", "key")
    whole = held.join(kept, "rid").select("rid", "text", "spans").mapInArrow(_whole(length, unit), "rid long, at int, near int, far int, key long, w1 long, w2 long, sure boolean")
    whole = _settled(cut(whole, "anchors"))
    drop(anchors)
    cells = held.join(_by_row(_partners(whole, ["key"]), "at", "near", "far"), "rid").select("rid", "text", "spans")
    cells = cut(cells.mapInArrow(_cells(length, unit), "rid long, low int, high int, c1 long, c2 long, w1 long, w2 long, sure boolean"), "cells")
    cores = cells.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
    live = _settled(cut(cells.join(cores.hint("shuffle_hash"), ["c1", "c2"]), "live"))
    drop(cells)
    step = -(-length // 4)
    ranks = held.join(_by_row(_partners(live, ["c1", "c2"]), "low", "high"), "rid").select("rid", "text", "spans")
    ranks = ranks.mapInArrow(_positions(length, step, unit), "rid long, pos int, goal boolean, r1 long, r2 long")
    starts = doubled(cut(ranks.withColumn("pid", F.monotonically_increasing_id()), "positions"), step, length)
    single = starts.select("rid", F.col("pos").alias("low"), F.col("pos").alias("high"))
    runs = whole.where("settled").select("rid", (F.col("at") - F.col("far")).alias("low"), (F.col("at") - F.col("near")).alias("high"))
    return runs.unionByName(live.where("settled").select("rid", "low", "high")).unionByName(single)


def _by_row(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("spans"))


def _settled(rows: DataFrame) -> DataFrame:
    """``rows`` and ``settled``: whether all that their starts cover (w1, w2) occurs again, so that every start repeats."""
    again = rows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2", F.lit(True).alias("settled"))
    met = rows.where("not sure").join(again.hint("shuffle_hash"), ["w1", "w2"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    out = cut(rows.where("sure").withColumn("settled", F.lit(True)).unionByName(met).drop("sure"), "settled")
    drop(rows)
    return out


def _partners(rows: DataFrame, shared: list[str]) -> DataFrame:
    """The rows that aren't settled, and of the settled ones that share a key with them one of each kind: what they may
    repeat."""
    open_ = rows.where("not settled").drop("settled")
    # All firsts are of one row.
    kinds = rows.where("settled").groupBy("w1", "w2").agg(*[F.first(c).alias(c) for c in open_.columns if c not in ("w1", "w2")])
    return open_.unionByName(kinds.join(open_.select(*shared).distinct().hint("shuffle_hash"), shared, "left_semi").select(open_.columns))


def _runs(starts, length: int) -> list[list[int]]:
    """Maximal runs of symbols (begin, end) that the ``length`` symbols at some starts cover."""
    runs: list[list[int]] = []
    if starts.is_valid:
        low, high = (starts.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for a, b in sorted(zip(low.tolist(), (high + length).tolist(), strict=True)):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
    return runs


def _in_bytes(texts: pa.Array, every: list[list[list[int]]]) -> None:
    """Turn runs of words into runs of bytes."""
    some = [i for i, runs in enumerate(every) if runs]
    row = 0
    for part in S.slices(pa.RecordBatch.from_arrays([texts.take(pa.array(some, pa.int64()))], ["text"]), "text"):
        w = S.words(part.column("text"), fold=False)
        _, at = S.utf8(part.column("text"))
        for k in range(part.num_rows):
            i, first = some[row + k], w.first[k]
            every[i] = [[int(w.start[first + a] - at[k]), int(w.end[first + b - 1] - at[k])] for a, b in every[i]]
        row += part.num_rows


def _removal(length: int, unit: Unit, fields: list[str]):
    """Rows (rid, text, starts, passages) to the removed runs of bytes, their number, and what is left."""

    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            out: dict[str, list] = {f: [] for f in _KINDS}
            every = [_runs(x, length) for x in batch.column("starts")]
            if unit.words:
                _in_bytes(batch.column("text"), every)
            for i, runs in enumerate(every):
                data = text[i].as_py()
                ends = [0, *(x for r in runs for x in r), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if runs else data
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest() if "kept_sha256" in fields else None)
                out["spans"].append([{"begin": a, "end": b} for a, b in runs])
                out["kept"].append(rest.decode("utf-8", "ignore") if "kept" in fields else None)
                out["n_passage_words"].append(sum(b - a for a, b in _runs(batch.column("passages")[i], PASSAGE)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(out[f], _KINDS[f][1]) for f in fields)], ["doc", *fields])

    return run


_RUN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_KINDS = {
    "n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "kept_sha256": ("string", pa.string()),
    "spans": ("array<struct<begin:long,end:long>>", _RUN), "kept": ("string", pa.string()), "n_passage_words": ("long", pa.int64()),
}


def _collected(held: DataFrame, length: int, unit: Unit, name: str) -> DataFrame:
    starts = repeated_starts(held.select("rid", "text"), length, unit)
    return cut(starts.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias(name)), name)


@written
def remove_repeats(docs: DataFrame, fields: list[str], length: int = LENGTH, unit: Unit = BYTES) -> DataFrame:
    """``doc`` (all columns of a row of ``docs``, but its text) and ``fields`` of what removal leaves of its ``text``.

    ``fields``: any of n_bytes, n_removed, n_spans (maximal runs), kept_sha256, spans (the runs, in bytes), kept (the
    text; a character cut in two goes), and n_passage_words: words in strings of PASSAGE words that start elsewhere too,
    which is told and not removed. A null text is empty; texts shorter than ``length`` stay whole; rows that repeat are
    texts of their own, so each removes the other; no rows give none. ``unit`` WORDS: strings of words are compared as they
    are written, whatever white space parts them, and the white space around a removed run stays. ``length``: 12 or more.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(others.alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = bucketed(rows.withColumn("rid", F.monotonically_increasing_id()), "rid")
    every = held.join(_collected(held, length, unit, "starts"), "rid", "left")
    if "n_passage_words" in fields:
        every = every.join(_collected(held, PASSAGE, WORDS, "passages"), "rid", "left")
    else:
        every = every.withColumn("passages", F.lit(None).cast("array<struct<low:int,high:int>>"))
    shape = rows.select("doc").schema
    for f in fields:
        shape = shape.add(f, _KINDS[f][0])
    return every.select("doc", "text", "starts", "passages").mapInArrow(_removal(length, unit, fields), shape)


def op5_suffix_array_dedup(spark, sf_dir):
    """Removal by strings of 400 bytes, and how many words of each document stand in passages of over 50 words that repeat: those
    are often under 400 bytes, so removal leaves them."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
    return remove_repeats(docs, fields).select("doc.doc_id", *fields)
