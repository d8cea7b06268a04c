"""Shards of near-equal bytes by histogram sort.

The order is by a 64-bit hash of the text and then by doc_id, so equal texts are neighbours and stay together unless
a splitter must fall among them. Splitters are found by counting exact bytes below probes: first below evenly spaced
keys, then below more of them inside each interval that holds a splitter, until each is within the tolerance. Only then
are rows exchanged, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, documents, scratch, written

SHARDS = 40
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Bits of a key column that a round leaves out: 4096 probes in an interval, at most.
SHIFTS = (52, 40, 28, 16, 4, 0)


def splitters(keys: DataFrame, n: int, tolerance: float = 0.002) -> list[tuple[int, int]]:
    """``n - 1`` ascending keys that part ``keys(h, d, size)``, in the order of ``(h, d)``, into runs of near-equal bytes.

    A splitter is the lowest key of the run above it and lies within ``tolerance`` of a mean run of its goal, or at the
    nearest row. Each round brings at most 4096 sums to the driver for each splitter still sought, whatever the input.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    goals = {j: total * j / n for j in range(1, n)}
    found: dict[int, tuple[int, int]] = {}
    sought: dict[tuple, tuple[int, list[int]]] = {(): (0, list(goals))}  # interval: bytes below it, splitters in it
    for column in "hd":
        for k, shift in enumerate(SHIFTS):
            if not sought:
                break
            cell = lambda i: F.shiftright(column, SHIFTS[i])  # noqa: B023, E731
            rows = keys
            if column == "h" and k:
                rows = rows.where(cell(k - 1).isin([p[0] for p in sought]))
            elif column == "d":
                tests = [(F.col("h") == p[0]) & ((cell(k - 1) == p[1]) if k else F.lit(True)) for p in sought]
                rows = rows.where(_any(tests))
            by = [F.col("h")] if column == "d" else []
            cells: dict[tuple, list[tuple[int, int]]] = {}
            for *h, c, size in rows.groupBy(*by, cell(k).alias("cell")).agg(F.sum("size")).collect():
                parent = (*h, c >> (SHIFTS[k - 1] - shift)) if k else tuple(h)
                cells.setdefault(parent, []).append((c, size))
            inner: dict[tuple, tuple[int, list[int]]] = {}
            for parent, (below, wanted) in sought.items():
                held = sorted(cells.get(parent, []))
                edges = [below]
                for _, size in held:
                    edges.append(edges[-1] + size)
                for j in wanted:
                    near = min(range(len(edges)), key=lambda i: abs(edges[i] - goals[j]))  # noqa: B023
                    last = column == "d" and shift == 0
                    if not held or last or abs(edges[near] - goals[j]) <= tolerance * total / n:
                        edge = (held[near][0] if near < len(held) else held[-1][0] + 1) << shift if held else HIGH
                        found[j] = (parent[0], edge) if column == "d" else (edge, LOW)
                        if edge > HIGH:
                            found[j] = (HIGH, HIGH)
                    else:
                        i = max(i for i in range(len(held)) if edges[i] <= goals[j])
                        child = (parent[0] if column == "d" else held[i][0], held[i][0]) if column == "d" else (held[i][0],)
                        inner.setdefault(child, (edges[i], []))[1].append(j)
            sought = inner
    return [found[j] for j in range(1, n)]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def run_of(cuts: list[tuple[int, int]], low: int = 0) -> Column:
    """The number of the run that a row's ``(h, d)`` lies in: a binary search over the splitters, as nested conditions."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    h, d = cuts[mid]
    below = (F.col("h") < h) | ((F.col("h") == h) & (F.col("d") < d))
    return F.when(below, run_of(cuts[:mid], low)).otherwise(run_of(cuts[mid + 1 :], low + mid + 1))


@written
def shard_by_bytes(docs: DataFrame, n: int = SHARDS, tolerance: float = 0.002, rows_a_task: int = 2_000_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs(doc_id, text)``.

    ``size`` is the text's UTF-8 bytes and 16 (a null text has none); a null doc_id sorts first and stays null; repeated
    rows each have a slot. No rows give no rows. A shard of more than ``rows_a_task`` rows is sorted in several runs, at
    most 25, whose slots go on from one another.
    """
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    keys = cut(keys.withColumn("d", F.coalesce("doc_id", F.lit(LOW))), "keys")
    runs = min(25, max(1, -(-keys.count() // (n * rows_a_task))))
    placed = keys.withColumn("run", run_of(splitters(keys, n * runs, tolerance)))
    first: dict[int, int] = {}
    counts = dict(placed.groupBy("run").count().collect())
    for r in range(n * runs):
        first[r] = 0 if r % runs == 0 else first[r - 1] + counts.get(r - 1, 0)
    starts = F.element_at(F.array(*[F.lit(first[r]).cast("long") for r in range(n * runs)]), F.col("run") + 1)
    place = F.row_number().over(W.partitionBy("run").orderBy("h", "d"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("run") / runs).cast("int").alias("shard"), (starts + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n: int = SHARDS) -> None:
    """Write the rows of ``docs`` as ``n`` folders ``shard=i`` of near-equal bytes, each in key order."""
    with scratch(docs.sparkSession):
        _write(docs, path, n)


def _write(docs: DataFrame, path: str, n: int) -> None:
    held = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"))
    keys = cut(held.select("h", "d", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size")), "keys")
    held = held.withColumn("shard", run_of(splitters(keys, n)))
    # By the number itself, so that each task has one shard.
    held.repartitionById(n, "shard").sortWithinPartitions("shard", "h", "d").drop("h", "d").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir):
    return shard_by_bytes(documents(spark, sf_dir))
