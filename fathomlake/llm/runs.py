"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q that is ``TIMES`` periods long or more and that no neighbouring word prolongs.

Places are chosen at dyadic scales t: those in whose window of t + 1 places the least hash of t words is at either end. The choice
depends on the 2 t words from the place on alone, so a run of period q (t <= q < 2 t) has a chosen place, and again one with the
same 2 t words exactly q words later: two neighbours among the chosen places with equal words propose their distance as a
period, and the stretch is prolonged both ways as far as the words allow. No chosen place need lie in a region of a period of
t / 4 or less; such regions are the runs that smaller scales have found, and their places are barred. Periods below ``SMALL`` are
found by comparing each word with that q places on.

Why none is missed: the first 3 t - 1 words of such a run have no period of t / 4 or less (the run would have a smaller period),
so one of their windows of t words is not barred, and the place of the least hash among the first 2 t windows, or the place t
before it, is chosen and lies among the run's first t. From there a context of 2 t words and its copy q places on lie inside the run, since that is 4 q
long or more, and no equal context lies between, because the q rotations of a primitive word differ.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shingles as S
from .common import documents, written
from .suffix import Prefix

#: A run has so many periods and so many words at least.
TIMES, LEAST = 4, 6
#: Periods below this are compared directly.
SMALL = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _small(x: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (begin, end, period) of small periods; ``end``: where the text of each word ends."""
    found = []
    for q in range(1, min(SMALL, len(x))):
        begin, stop = _stretches((x[q:] == x[:-q]) & (np.arange(q, len(x)) < end[:-q]))
        long = stop - begin + q >= max(LEAST, TIMES * q)
        for a, b in zip(begin[long].tolist(), (stop[long] + q).tolist(), strict=True):
            if not any(np.array_equal(x[a : b - d], x[a + d : b]) for d in range(1, q) if q % d == 0):
                found.append((a, b, q))
    return found


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of h[i:i + w] for each i."""
    n, span = len(h) - w + 1, 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[w - span : w - span + n])


def _chosen(p: Prefix, t: int, barred: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The synchronising set of scale ``t``: places whose 2 t words lie inside their text."""
    h = p.every(t) >> np.uint64(1)
    h[barred[: len(h)]] = _NONE
    least = _least(h, t + 1)
    n = len(least)
    ends = (h[:n] == least) | (h[t : t + n] == least)
    return np.flatnonzero(ends & (least != _NONE) & (np.arange(2 * t, n + 2 * t) <= end[:n]))


def _proposed(p: Prefix, t: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen places whose context comes next at a distance from t to 2 t - 1, and that distance."""
    context = p.of(places, places + 2 * t)
    order = np.lexsort((places, context))
    a, b = order[:-1], order[1:]
    gap = places[b] - places[a]
    good = (context[a] == context[b]) & (gap >= t) & (gap < 2 * t)
    return places[a[good]], gap[good]


def _reach(p: Prefix, s: np.ndarray, d: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
    """How many words from ``s`` on (sign 1) or before it (-1) equal those ``d`` places on, ``most`` at most."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        n = (low + high + 1) // 2
        a, b = (s, s + n) if sign > 0 else (s - n, s)
        same = p.of(a, b) == p.of(a + d, b + d)
        low, high = np.where(same, n, low), np.where(same, high, n - 1)
    return low


def _exact(x: np.ndarray, s: int, d: int, begin: int, end: int) -> tuple[int, int]:
    """The stretch around ``s`` whose words ``d`` apart are equal, by the words themselves."""
    differ = np.flatnonzero(x[begin : end - d] != x[begin + d : end]) + begin
    k = int(np.searchsorted(differ, s))
    return (int(differ[k - 1]) + 1 if k else begin), (int(differ[k]) if k < len(differ) else end - d) + d


def _prolonged(x: np.ndarray, p: Prefix, s: np.ndarray, d: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs that the proposals lead to; hashes find their ends, and the words confirm them."""
    a = s - _reach(p, s, d, s - begin[s], -1)
    b = s + d + _reach(p, s, d, end[s] - s - d, 1)
    _, once = np.unique(np.stack((a, b, d)), axis=1, return_index=True)
    found = set()
    for i in once.tolist():
        low, high, q = int(a[i]), int(b[i]), int(d[i])
        first, last = int(begin[s[i]]), int(end[s[i]])
        ends = (low == first or x[low - 1] != x[low - 1 + q]) and (high == last or x[high] != x[high - q])
        if not ends or not np.array_equal(x[low : high - q], x[low + q : high]):
            low, high = _exact(x, int(s[i]), q, first, last)
        if high - low >= max(LEAST, TIMES * q):
            found.add((low, high, q))
    return sorted(found)


def find_runs(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (begin, end, period) of all runs in texts of the symbols ``x``; text i is ``x[first[i]:first[i + 1]]``. By begin and
    period."""
    size = np.diff(first)
    found = _small(x, np.repeat(first[1:], size))
    t = SMALL
    while len(size) and TIMES * t <= size.max():
        own = np.flatnonzero(size >= TIMES * t)
        inside = np.repeat(size >= TIMES * t, size)
        y, head = x[inside], np.concatenate(([0], np.cumsum(size[own])))
        shift = np.repeat(first[own] - head[:-1], size[own])
        begin, end = np.repeat(head[:-1], size[own]), np.repeat(head[1:], size[own])
        barred = np.zeros(len(y) + 1, np.int64)
        if found:
            a, b, q = np.array(found).T
            periodic = (TIMES * q <= t) & (b - a >= t) & inside[a]
            back = np.cumsum(inside) - 1
            np.add.at(barred, back[a[periodic]], 1)
            np.add.at(barred, back[b[periodic] - 1] + 2 - t, -1)
        p = Prefix(S.mix(y.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 0)
        s, d = _proposed(p, t, _chosen(p, t, np.cumsum(barred[:-1]) > 0, end))
        if len(s):
            found += [(a + int(shift[a]), b + int(shift[a]), q) for a, b, q in _prolonged(y, p, s, d, begin, end)]
        t *= 2
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SPARK_RUN = "struct<start:long,length:long,period:long>"


def _best(runs: list[dict]) -> dict | None:
    return min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)


def _batches(batches):
    """Rows (doc, text) to the runs of each text, the best of them, and what collapsing leaves."""
    for batch in batches:
        for part in S.slices(batch, "text", 1_000_000):
            words = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(w) for w in words])))
            flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
            found = find_runs(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), first)
            cut = np.searchsorted(found[:, 0], first)
            runs, best, left = [], [], []
            for i, ws in enumerate(words):
                mine = [{"start": a - int(first[i]), "length": b - a, "period": q} for a, b, q in found[cut[i] : cut[i + 1]].tolist()]
                if mine:
                    keep = np.ones(len(ws), bool)
                    for r in mine:
                        keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                    ws = [ws[k] for k in np.flatnonzero(keep)]
                runs.append(mine)
                best.append(_best(mine))
                left.append(b" ".join(ws).decode())
            columns = [part.column("doc"), pa.array(np.diff(first)), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "runs", "best", "collapsed"])


def _collapsed(docs: DataFrame) -> DataFrame:
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(others.alias("doc"), F.col("text").cast("string").alias("text"))
    found = StructType.fromDDL(f"n_words long, runs array<{_SPARK_RUN}>, best {_SPARK_RUN}, collapsed string")
    return rows.mapInArrow(_batches, StructType([rows.schema["doc"], *found]))


@written
def collapse_runs(docs: DataFrame) -> DataFrame:
    """``doc`` (the columns of a row of ``docs``, but its text), ``n_words``, ``runs``, ``best`` and ``collapsed`` of its text.

    Words stand between ASCII white space and are compared as they are written. ``runs``: start (word number from 0), length and
    period of every run, by start and period. ``best``: the run of the greatest length/period, of equals the first, then that of
    the smaller period; null without a run. ``collapsed``: the words that no run holds after its first period, one space between.
    A null or empty text has no words and an empty ``collapsed``; no rows give none, rows that repeat are judged alike and stay.
    A text is one row and is searched whole in one task, with memory of about 100 bytes a word; nothing is exchanged.
    """
    return _collapsed(docs)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def planted(doc_id: Column, text: Column) -> Column:
    """The texts of one document in ten with a period: word i from a on becomes word a + (i - a) % p of the original."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        place = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))
        source = lambda s, i: F.when(i < s["a"], i.cast("long")).otherwise(s["a"] + (i - s["a"]) % s["p"])
        return let(place, lambda s: F.array_join(F.transform(w, lambda x, i: F.get(w, source(s, i).cast("int"))), " "))

    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(""))).otherwise(text)


@written
def _digests(docs: DataFrame) -> DataFrame:
    out = _collapsed(docs)
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return out.select("doc.doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _digests(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
