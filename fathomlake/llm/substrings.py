"""Repeated lines and paragraphs: unit hashing.

Units are whole lines, of any number of words, and the sentences of ``least`` words or more of lines that have several. They are
normalised (lower case, single spaces) and their 128-bit digests grouped over all documents. Of equal units the occurrence of the
smallest (doc_id, place) stays. Every other line goes, and with its lines a repeated paragraph. Repeated passages also lie inside
other lines, where no line end tells where they begin and end: there, sentences in a row that all stood earlier go if they make a
paragraph of ``paragraph`` words or more. A shorter sentence counts with its neighbours, as repeated if the nearest longer ones on both
sides are; a repeated sentence inside a line that is new stays, as it does not make a text a copy.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, written

LEAST, PARAGRAPH = 6, 20
#: A sentence; it never reaches over the end of its line.
UNIT = r"[^.!?\n]+[.!?]*\n*|[.!?]+\n*|\n+"
_unit = regex.compile(UNIT)


def _md5(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).lower().encode(), usedforsecurity=False).digest()


def _sentences(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Begin and end of each sentence, and the places of those that begin a line."""
    spans, heads = [], []
    for m in _unit.finditer(text):
        if not spans or text[m.start() - 1] == "\n":
            heads.append(len(spans))
        spans.append(m.span())
    return spans, heads


def _digests(least: int):
    """The place of a sentence is twice its number; that of a line twice the number of its first sentence, and one."""

    def run(batches):
        for batch in batches:
            rid, place, digest = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                spans, heads = _sentences(text)
                for first, end in pairwise([*heads, len(spans)]):
                    words = [text[a:b].split() for a, b in spans[first:end]]
                    units = [(2 * first + 1, [w for ws in words for w in ws])]
                    if end - first > 1:
                        units += [(2 * k, w) for k, w in enumerate(words, first) if len(w) >= least]
                    for at, w in units:
                        if w:
                            rid.append(i)
                            place.append(at)
                            digest.append(_md5(w))
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = pa.array(rid, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(place, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "th", "place", "d1", "d2"])

    return run


def _between(long: np.ndarray, out: np.ndarray) -> None:
    """Shorter units go if the nearest longer ones on both sides go."""
    at = np.flatnonzero(long)
    for i in np.flatnonzero(~long):
        k = np.searchsorted(at, i)
        out[i] = 0 < k < len(at) and out[at[k - 1]] and out[at[k]]


def _paragraphs(words: np.ndarray, out: np.ndarray, paragraph: int) -> None:
    """Of runs of units that go those with fewer words stay."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype("i1")))
    total = np.concatenate(([0], np.cumsum(words)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if total[b] - total[a] < paragraph:
            out[a:b] = False


def _removed(words: np.ndarray, heads: list[int], gone: list[int], least: int, paragraph: int) -> np.ndarray:
    """Which sentences go, from the places that do."""
    at = np.array(gone)
    lines = np.repeat(np.isin(heads, at[at % 2 == 1] // 2), np.diff([*heads, len(words)]))
    marked = lines.copy()
    marked[at[at % 2 == 0] // 2] = True
    _between(words >= least, marked)
    marked |= lines
    _paragraphs(words, marked, paragraph)
    return lines | marked


def _kept(least: int, paragraph: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text = text or ""
                spans, heads = _sentences(text)
                out = np.zeros(len(spans), bool)
                if gone:
                    out = _removed(np.array([len(text[a:b].split()) for a, b in spans]), heads, gone, least, paragraph)
                removed = [spans[i] for i in np.flatnonzero(out)]
                kept = "".join(text[a:b] for (a, b), x in zip(spans, out, strict=True) if not x)
                rows.append((len(text), len(spans), len(removed), sum(b - a for a, b in removed), ",".join(f"{a}-{b}" for a, b in removed), kept, hashlib.md5(kept.encode(), usedforsecurity=False).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["n_chars", "n_units", "n_removed", "removed_chars", "spans", "kept", "kept_md5"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", *names])

    return run


@written
def remove_repeated_units(docs: DataFrame, least: int = LEAST, paragraph: int = PARAGRAPH) -> DataFrame:
    """``doc_id, n_chars, n_units, n_removed, removed_chars, spans, kept, kept_md5`` for each row of ``docs(doc_id, text)``.

    ``n_units``: sentences; ``spans``: those removed, ``begin-end`` in characters of the original text, joined by commas; ``kept``:
    the text left. A null text is empty; a null doc_id has no rank, so its row stays whole and counts for no other; rows that
    repeat doc_id and text are one document. No rows give none; other columns aren't read. A text is read whole in one task; the
    digests of its units are grouped with partial minima, so a line that all documents hold is a row a task.
    """
    held = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = held.where("doc_id is not null").mapInArrow(_digests(least), "doc_id long, th long, place int, d1 long, d2 long")
    found = cut(found, "units")
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    gone = found.join(first, ["d1", "d2"]).where(F.struct("doc_id", "th", "place") != F.col("first"))
    gone = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    every = held.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "gone")
    return every.mapInArrow(_kept(least, paragraph), "doc_id long, n_chars long, n_units long, n_removed long, removed_chars long, spans string, kept string, kept_md5 string")


def op9_substring_dedup(spark, sf_dir):
    return remove_repeated_units(documents(spark, sf_dir)).drop("kept")


_FORM = r"lower(trim(regexp_replace({0}, '[ \t\r\n\v\f]+', ' ', 'g'), ' '))"
_WORDS = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END"

ORACLE = {
    "op9_substring_dedup": rf"""
WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS us FROM documents),
u AS (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS place FROM a),
n AS (SELECT *, {_FORM.format("unit")} AS form, coalesce(sum(CASE WHEN suffix(unit, chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
      sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place) - length(unit) AS begin FROM u),
w AS (SELECT *, {_WORDS.format("form")} AS words FROM n),
l AS (SELECT doc_id, line, min(place) AS head, count(*) AS size, {_FORM.format("string_agg(unit, '' ORDER BY place)")} AS form FROM w GROUP BY doc_id, line),
e AS (SELECT doc_id, 2 * head + 1 AS spot, form FROM l WHERE form <> ''
      UNION ALL SELECT doc_id, 2 * place, w.form FROM w JOIN l USING (doc_id, line) WHERE size > 1 AND words >= {LEAST}),
d AS (SELECT doc_id, spot, row_number() OVER (PARTITION BY form ORDER BY doc_id, spot) > 1 AS dup FROM e),
r AS (SELECT w.*, coalesce(x.dup, false) AS whole, CASE WHEN words >= {LEAST} THEN coalesce(x.dup, false) OR coalesce(y.dup, false) END AS dup
      FROM w JOIN l USING (doc_id, line) LEFT JOIN d x ON x.doc_id = w.doc_id AND x.spot = 2 * head + 1 LEFT JOIN d y ON y.doc_id = w.doc_id AND y.spot = 2 * place),
m AS (SELECT *, CASE WHEN words >= {LEAST} THEN dup ELSE whole OR
      coalesce(last_value(dup IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
      AND coalesce(first_value(dup IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false)
      END AS marked FROM r),
q AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, marked ORDER BY place) AS run FROM m),
g AS (SELECT *, whole OR marked AND sum(words) OVER (PARTITION BY doc_id, marked, run) >= {PARAGRAPH} AS gone FROM q)
SELECT d.doc_id, length(coalesce(d.text, '')) AS n_chars, count(g.place) AS n_units,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       CAST(coalesce(sum(length(unit)) FILTER (WHERE gone), 0) AS BIGINT) AS removed_chars,
       coalesce(string_agg(CAST(begin AS BIGINT) || '-' || CAST(begin + length(unit) AS BIGINT), ',' ORDER BY place) FILTER (WHERE gone), '') AS spans,
       md5(coalesce(string_agg(unit, '' ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.text""",
}
