"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so plain MinHash similarity between them is near 0 and containment is what
counts. Items are partitioned by the size of their shingle set, in powers of two. An item's sketch is its ``k`` smallest
shingle hashes, where ``k`` belongs to its partition and the hits asked for follow from it, so that an item of which 0.8 is
contained is missed with a probability of 1e-4 at most. Each partition is a search of its own, and a document takes part in those
whose items are small enough for it: with fewer than 0.8 of the least number of shingles of a partition it can contain none of
its items.

1. The sketches are a table of hashes by partition. Sieves of a fixed size, bits of those hashes, one for each partition (32 at most),
   go to the tasks, whatever the number of items.
2. Documents are read once: the shingle hashes that pass the sieve of a partition that the document takes part in are joined with
   its sketches by hash, and hits counted for each text and item. Texts are named by their hash, so copies are one.
3. The texts with enough hits are read again and joined with their items, and each pair is verified on the words themselves.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import cut, documents, drop, small, written

THRESHOLD = (4, 5)
MISS = 1e-4
#: Hashes in the sketches of the partitions of fewer than 64 shingles, and of the others.
SHORT_SKETCH, LONG_SKETCH = 16, 32
#: Bits of a partition's sieve (1 MB), and of one of its chunks.
SIEVE, CHUNK = 23, 15


def sketch_rule(n: int) -> tuple[int, int]:
    """Sketch size and least hits for an item of ``n`` shingles: by its size partition."""
    partition = n.bit_length() - 1
    k = min(n, SHORT_SKETCH if partition < 6 else LONG_SKETCH)
    p = THRESHOLD[0] / THRESHOLD[1]
    need, tail = 0, 0.0
    while need < k and (tail := tail + comb(k, need) * p**need * (1 - p) ** (k - need)) <= MISS:
        need += 1
    return k, max(1, need)


def _grams(text: str) -> set[tuple[bytes, ...]]:
    w = text.lower().encode().split()
    return {tuple(w[i : i + S.N]) for i in range(len(w) - S.N + 1)}


def _sketched(batches):
    """Rows (item, text) to (item, partition, need, keys)."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not (n := len(_grams(text))):
                continue
            h = np.unique(S.shingles(S.words(pa.array([text])))[0])
            k, need = sketch_rule(n)
            for column, x in zip(out, (item, n.bit_length() - 1, need, h[:k].view(np.int64)), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["item", "partition", "need", "keys"])


def _bits(table: pa.Table) -> pa.Table:
    """The cells of one chunk of a sieve as bits."""
    bits = np.zeros(1 << CHUNK, bool)
    bits[table["cell"].to_numpy() & (1 << CHUNK) - 1] = True
    return pa.table({"partition": table["partition"].slice(0, 1), "chunk": table["chunk"].slice(0, 1), "bits": [np.packbits(bits).tobytes()]})


def _sieves(keys: DataFrame) -> dict[int, np.ndarray]:
    """Bits of the hashes ``key`` of each partition that has some: at most 32 times 1 MB come to the driver, whatever their number."""
    cell = F.shiftrightunsigned("key", 64 - SIEVE).cast("int")
    cells = keys.select("partition", cell.alias("cell")).distinct().withColumn("chunk", F.shiftright("cell", CHUNK))
    out: dict[int, np.ndarray] = {}
    for partition, chunk, bits in cells.groupBy("partition", "chunk").applyInArrow(_bits, "partition int, chunk int, bits binary").collect():
        sieve = out.setdefault(partition, np.zeros((1 << SIEVE - CHUNK, 1 << CHUNK - 3), np.uint8))
        sieve[chunk] = np.frombuffer(bits, np.uint8)
    return {p: sieve.ravel() for p, sieve in out.items()}


def least_shingles(partition: int) -> int:
    """Shingles that a document has if it contains enough of an item of the partition."""
    return -(-(THRESHOLD[0] << partition) // THRESHOLD[1])


def _probe(sieves):
    """Rows (th, text) to the distinct shingle hashes (th, partition, key) that pass the sieves of the document's partitions."""

    def run(batches):
        bits = sieves.value
        for batch in batches:
            for part in S.slices(batch, "text"):
                h, doc, _ = S.shingles(S.words(part.column("text")))
                # Repeats included, so no less than the distinct ones.
                size = np.bincount(doc, minlength=part.num_rows)[doc]
                cell = (h >> np.uint64(64 - SIEVE)).astype(np.int64)
                place, bit = cell >> 3, np.uint8(1) << (7 - (cell & 7)).astype(np.uint8)
                for p, sieve in bits.items():
                    some = np.flatnonzero((sieve[place] & bit).astype(bool) & (size >= least_shingles(p)))
                    if len(some):
                        pairs = np.unique(np.stack((doc[some].astype(np.uint64), h[some])), axis=1)
                        yield pa.RecordBatch.from_arrays([part.column("th").take(pa.array(pairs[0].astype(np.int64))), pa.array(np.full(len(pairs[0]), p, np.int32)), pa.array(pairs[1].view(np.int64))], ["th", "partition", "key"])

    return run


def _verified(batches):
    """Rows (th, doc_id, text, item_id, item_text) to those of which enough is contained; rows of one text come together."""
    last: tuple[str | None, set] = (None, set())
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text, item, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item_text")), strict=True):
            if text != last[0]:
                last = (text, _grams(text))
            grams = _grams(wanted)
            shared = len(grams & last[1])
            if THRESHOLD[1] * shared >= THRESHOLD[0] * len(grams):
                for column, x in zip(out, (doc, item, len(grams), shared, shared / len(grams)), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])


_OUT = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


@written
def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and test item of which 0.8 or more of the five-word shingles are in the document.

    ``docs(doc_id, text)``, ``items(item_id, text)``; columns ``doc_id, item_id, n_item_shingles, n_shared,
    containment``. Null and empty texts, and items or documents under five words, match nothing; a null id stays null;
    repeated documents each have their rows, repeated items too. Other columns aren't read. No rows on either side give none.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    wanted = cut(items.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).withColumn("item", F.monotonically_increasing_id()), "items")
    sketches = wanted.select("item", "text").mapInArrow(_sketched, "item long, partition int, need int, keys array<long>")
    sketches = cut(sketches.select("item", "partition", "need", F.explode("keys").alias("key")), "sketches")
    sieves = docs.sparkSession.sparkContext.broadcast(_sieves(sketches))
    hits = texts.select("th", "text").mapInArrow(_probe(sieves), "th long, partition int, key long").distinct()
    found = hits.join(sketches, ["partition", "key"]).groupBy("th", "item").agg(F.count("*").alias("hits"), F.max("need").alias("need")).where("hits >= need")
    found = cut(found.select("th", "item"), "candidates")
    drop(sketches)
    again = texts.join(small(found.select("th").distinct()), "th", "left_semi")
    pairs = found.join(wanted.select("item", "item_id", F.col("text").alias("item_text")), "item")
    full = again.join(pairs, "th").select("th", "doc_id", "text", "item_id", "item_text")
    return full.sortWithinPartitions("th").mapInArrow(_verified, _OUT)


def op6_benchmark_decontamination(spark, sf_dir):
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_GRAMS = "unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])"

ORACLE = {
    "op6_benchmark_decontamination": f"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
ig AS (SELECT DISTINCT item_id, {_GRAMS} AS g FROM i),
k AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dg AS (SELECT DISTINCT doc_id, {_GRAMS} AS g FROM d),
m AS (SELECT doc_id, item_id, count(*) AS m FROM dg JOIN ig USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, m AS n_shared, m / n AS containment FROM m JOIN k USING (item_id)
WHERE 5 * m >= 4 * n""",
}


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that contain no item; rows without doc_id are judged by their text as well."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    gone = small(contained_items(keyed, items).select(F.col("doc_id").alias("gone_text")).distinct())
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["gone_text"], "left_anti")
