"""Near-duplicate join: word n-gram Jaccard similarity by MinHash banding, verified on full n-gram sets.

1. Every text gets 100 MinHashes over its five-word shingles, in 20 bands of 5 rows: a pair of similarity 0.8 shares a
   band with probability 1 - (1 - 0.8^5)^20 = 0.9996, one of 0.5 with 0.47 (``bands_for`` chooses them for a recall).
2. Texts of equal words form one class; only its smallest doc_id goes on.
3. Band hashes are shuffled and counted; each class in a shared bucket is linked to the bucket's smallest, never to all.
   The components of these links are the candidate groups.
4. Inside a group all pairs are verified on full shingle sets as products of 0/1 matrices. Groups of more than a block
   are split, and pairs of blocks are tasks of their own, so no group is gathered in one task and no pairs become rows:
   a block task gives each class its number of links and one link that keeps it connected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import connected_components, cut, documents, partitions, written

SIMILARITY = (4, 5)
BLOCK = 256
BLOCK_WORDS = 400_000


def bands_for(similarity: float, recall: float, rows: int = 5) -> int:
    """Bands of ``rows`` MinHashes that find a pair of ``similarity`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, th, c1, c2, n_words, band``: text hash, class key (128 bits over the words in order), band hashes."""
    rng = np.random.default_rng(7)
    flips = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    odd = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    bases = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

    def run(batches):
        for batch in batches:
            for part in S.slices(batch, "text"):
                w = S.words(part.column("text"))
                h, owner, _ = S.shingles(w)
                n, count = part.num_rows, w.count
                place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
                keys = []
                for base in bases:
                    value = np.concatenate((w.hash * S.powers(int(count.max(initial=0)), base)[place], [np.uint64(0)]))
                    keys.append(S.mix(np.where(count > 0, np.add.reduceat(value, w.first[:-1]), np.uint64(0)) if n else value[:0]).view(np.int64))
                have = np.flatnonzero(np.bincount(owner, minlength=n))
                band = np.zeros((len(have), bands), np.uint64)
                head = np.searchsorted(owner, have)
                if len(have):
                    for k in range(bands * rows):
                        low = np.minimum.reduceat((h ^ flips[k]) * odd[k], head)
                        band[:, k // rows] = S.mix(band[:, k // rows] + low)
                ends = np.zeros(n + 1, np.int32)
                ends[1:] = np.cumsum(np.isin(np.arange(n), have)) * bands
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(keys[0]), pa.array(keys[1]), pa.array(count), out], ["doc_id", "th", "c1", "c2", "n_words", "band"])

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    return named.mapInArrow(run, "doc_id long, th long, c1 long, c2 long, n_words long, band array<long>")


def _matches(owner: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
    """Sizes of all pairwise intersections of ``m`` sets given as (owner, element); sizes of the sets on the diagonal."""
    pairs = np.unique(np.stack((h, owner.astype(np.uint64))), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
    value, own = pairs[0], pairs[1].astype(np.int64)
    size = np.bincount(own, minlength=m)
    new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1 if len(col) else np.zeros(0, bool)
    keep = shared[col] if len(col) else new
    own, col = own[keep], (np.cumsum(shared) - 1)[col[keep]] if len(col) else col
    total = np.zeros((m, m), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        here = (col >= low) & (col < low + 4096)
        x = np.zeros((m, 4096), np.float32)
        x[own[here], col[here] - low] = 1
        total += x @ x.T
    np.fill_diagonal(total, size)
    return total


def _verify(batches):
    """Batches sorted by (grp, lo, hi): for each such task, the links between its blocks."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        ids = np.stack([held[c].to_numpy() for c in ("grp", "lo", "hi")])
        last = np.flatnonzero((ids != ids[:, -1:]).any(axis=0))
        done = int(last[-1]) + 1 if len(last) else 0
        if done:
            yield from _verified(held.slice(0, done))
            held = held.slice(done)
    if held is not None and held.num_rows:
        yield from _verified(held)


def _verified(table: pa.Table):
    num, den = SIMILARITY
    ids = np.stack([table[c].to_numpy() for c in ("grp", "lo", "hi", "rep")])
    new = np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)))
    table, ids = table.filter(pa.array(new)), ids[:3, new]
    edge = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0), [True])))
    rep, weight, block = (table[c].to_numpy() for c in ("rep", "weight", "block"))
    text = table["text"].combine_chunks()
    out: list[list[np.ndarray]] = [[], [], []]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        h, owner, _ = S.shingles(S.words(text.slice(a, b - a)))
        both = _matches(owner, h, b - a)
        size = np.diag(both).copy()
        linked = den * both >= num * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        lo, hi = ids[1, a], ids[2, a]
        if lo != hi:
            linked &= block[a:b, None] != block[None, a:b]
        linked &= (size > 0)[:, None]
        label = np.arange(b - a)
        while True:
            low = np.minimum(label, np.where(linked, label[None, :], b - a).min(axis=1, initial=b - a))
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        some = np.flatnonzero(linked.any(axis=1))
        out[0].append(rep[a:b][some])
        out[1].append(rep[a:b][label[some]])
        out[2].append((linked @ weight[a:b])[some])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["rep", "near", "links"])


@written
def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY[0] / SIMILARITY[1], recall: float = 0.9995, rows: int = 5) -> DataFrame:
    """``doc_id, copy_of, class_id, n_links`` for each distinct doc_id of ``docs(doc_id, text)``.

    ``copy_of``: smallest doc_id of equal words in equal order (case and white space aside); ``class_id``: smallest
    doc_id that a chain of links leads to; ``n_links``: how many other documents have a Jaccard similarity of 0.8 or
    more of shingle sets, copies included. A null or empty text, or one without words, has no links and is its own
    class. Rows without doc_id are left out; of rows that repeat a doc_id the smallest text hash stands for it.
    """
    spark = docs.sparkSession
    bands = bands_for(similarity, recall, rows)
    every = signatures(docs, bands, rows)
    one = F.min(F.struct("th", "c1", "c2", "n_words", "band")).alias("x")
    sig = cut(every.groupBy("doc_id").agg(one).select("doc_id", "x.*"), "signatures")
    worded = sig.where("n_words > 0")
    classes = cut(worded.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "th", "n_words", "band")).alias("x"), F.count("*").alias("weight")).select("c1", "c2", F.col("x.doc_id").alias("rep"), "x.th", "x.n_words", "x.band", "weight"), "classes")
    keyed = classes.select("rep", F.posexplode("band").alias("b", "key"))
    buckets = keyed.groupBy("b", "key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").select("b", "key", "low")
    groups = connected_components(keyed.join(buckets, ["b", "key"]).where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    members = cut(groups.select(F.col("v").alias("rep"), F.col("label").alias("grp")).join(classes.select("rep", "th", "n_words", "weight"), "rep"), "members")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n_words") / F.lit(BLOCK_WORDS))).cast("int").alias("blocks"))
    placed = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # doc_id and the hash of its text name the row to fetch; rows that repeat both are dropped in the task.
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    # The plan is the same at every size: texts go where their groups are, and no side is sent to all tasks.
    texts = placed.hint("merge").join(texts, ["rep", "th"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = texts.select("grp", "rep", "weight", "block", "text", other).select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "weight", "block", "text")
    tasks = tasks.repartition(partitions(spark), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "rep")
    links = cut(tasks.mapInArrow(_verify, "rep long, near long, links long"), "links")
    final = connected_components(links.select(F.col("rep").alias("a"), F.col("near").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    found = classes.select("c1", "c2", "rep", "weight").join(counts, "rep", "left").join(final.select(F.col("v").alias("rep"), "label"), "rep", "left")
    own = sig.join(found, ["c1", "c2"], "left").where("n_words > 0").select("doc_id", F.col("rep").alias("copy_of"), F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    alone = sig.where("n_words = 0").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return own.unionByName(alone)


def op1_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: All pairs of shingle sets that share a shingle, and the components of their links.
ORACLE = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
cls AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS weight, ws FROM w WHERE len(ws) > 0 GROUP BY ws),
sh AS MATERIALIZED (SELECT DISTINCT rep, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS s FROM cls),
n AS MATERIALIZED (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
hit AS (SELECT a.rep AS a, b.rep AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.rep < b.rep GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM hit JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS v, rep AS u FROM cls UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.u = e.a),
label AS (SELECT v, min(u) AS label FROM reach GROUP BY v),
cnt AS (SELECT e.a AS rep, sum(c.weight) AS links FROM both_ways e JOIN cls c ON c.rep = e.b GROUP BY e.a)
SELECT doc_id, coalesce(c.rep, doc_id) AS copy_of, coalesce(l.label, doc_id) AS class_id,
       CAST(coalesce(k.links, 0) + coalesce(c.weight - 1, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN cls c ON w.ws = c.ws LEFT JOIN label l ON l.v = c.rep LEFT JOIN cnt k ON k.rep = c.rep""",
}
