"""The prefix trie of conversations by truncation peeling.

A conversation is a path, the digests of its turns one after another, so its prefixes are those of its path. Equal paths are
counted first. Paths are then sorted across the cluster, and each slice of the sorted paths is peeled by itself: from its greatest
depth down, the conversations that end at a depth are merged with the nodes that survive from below, a node that is whole is
emitted, its last turn is stripped, and what has become equal is merged again with its sums. Only prefixes of a slice's first or
last path can go on in another slice. They stay open, and their sums are sorted and peeled again together with those of the other
slices, until one slice is left. So a turn that a third of all conversations begin with is spread over many slices, and
what is left after a round is a few rows for each slice. Prefixes are told apart by 128-bit digests of their turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, partitions, small, written

#: Bytes of a turn in a path: 16 of its digest, 8 with the number of its words.
TURN = 24
#: Ids that are listed in one row at most, and rows (and bytes) of a slice.
BLOCK, ROWS, BYTES = 4096, 20_000, 16_000_000
_OPEN = "path binary, n long, low long, kids long, leaves long, saved long, ends string"
_NODE = "depth int, parent_low long, parent_id binary, id binary"
_FIELDS = ["path", "n", "low", "kids", "leaves", "saved", "ends", "depth", "parent_low", "parent_id", "id"]
_SUMS = ("n", "kids", "leaves", "saved")
_KIND = pa.schema([("path", pa.binary()), *((c, pa.int64()) for c in ("n", "low", "kids", "leaves", "saved")), ("ends", pa.string()), ("depth", pa.int32()), ("parent_low", pa.int64()), ("parent_id", pa.binary()), ("id", pa.binary())])


def paths(rows: DataFrame) -> DataFrame:
    """``conv_id, path`` of each conversation of ``rows(conv_id, turn, role, text)``; rows without ``conv_id`` are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    code = F.concat(F.md5(F.concat(F.md5(role), text)), F.lpad(F.hex(words), 16, "0")).alias("code")
    coded = rows.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), code)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "code")))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda t: t["code"]), ""))
    return coded.groupBy("conv_id").agg(joined.alias("path"))


def turns(path: Column, begin, end=None) -> Column:
    """The turns of a path from ``begin`` up to ``end``, or to its end."""
    n = F.length(path) if end is None else (end - begin) * TURN
    return F.substr(path, begin * TURN + 1, n)


def _shared(turn: np.ndarray, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """How many leading turns each path shares with the one before it."""
    out = np.minimum(depth, np.concatenate(([0], depth[:-1])))
    row = np.flatnonzero(out)
    if len(row):
        n = out[row]
        head = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(head, n)
        differ = (turn[np.repeat(at[row], n) + k] != turn[np.repeat(at[row - 1], n) + k]).any(axis=1)
        out[row] = np.minimum.reduceat(np.where(differ, k, np.repeat(n, n)), head)
    return out


def peel(rows: list[tuple], whole: bool, named: bool) -> pa.RecordBatch:
    """The nodes of a slice of sorted ``rows`` (path, n, low, kids, leaves, saved, ends), and the open ones with their paths.

    ``whole``: there are no other slices. ``named``: closed nodes get an id by which children elsewhere find them.
    """
    given = [r[0] for r in rows]
    depth = np.fromiter(map(len, given), np.int64, len(given)) // TURN
    at = np.cumsum(depth) - depth
    turn = np.frombuffer(b"".join(given), ">u8").reshape(-1, TURN // 8)
    shared = _shared(turn, at, depth)
    # What each path shares with the first and with the last one.
    first = np.minimum.accumulate(np.concatenate((depth[:1], shared[1:])))
    last = np.minimum.accumulate(np.concatenate((depth[-1:], shared[:0:-1])))[::-1]
    edge = np.full(len(rows), -1) if whole else np.maximum(first, last)
    own = {c: np.array([r[k] for r in rows], np.int64) for k, c in enumerate(("n", "low", "kids", "leaves", "saved"), 1)}
    own |= {"head": np.arange(len(rows)), "ends": np.array([i if r[6] is not None else -1 for i, r in enumerate(rows)])}
    below = {c: v[:0] for c, v in own.items()}
    order = np.argsort(-depth, kind="stable")
    begins = np.searchsorted(-depth[order], -np.arange(-1, depth.max() + 1))  # of the rows of depth -1, 0, 1, ...
    out: list[pa.RecordBatch] = []
    waiting: dict | None = None

    def texts(rows_: np.ndarray) -> pa.Array:
        return pa.array([rows[i][6] if i >= 0 else None for i in rows_.tolist()], pa.string())

    def prefix(row: int, d: int) -> bytes:
        return given[row][: d * TURN]

    def emit(size: int, columns: dict[str, pa.Array]) -> None:
        out.append(pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _KIND], schema=_KIND))

    def emit_waiting(low: np.ndarray, ids: list) -> None:
        """The nodes one level deeper, whose parents are now known: their least member, or an id where they are open."""
        if waiting is not None:
            known = pa.array(low, mask=np.array([x is not None for x in ids], bool))
            emit(len(low), waiting | {"parent_low": known, "parent_id": pa.array(ids, pa.binary())})

    for d in range(int(depth.max()), -1, -1):
        ended = order[begins[d + 1] : begins[d]]
        if not len(ended) and not len(below["head"]):
            continue
        now = {c: np.concatenate((below[c], own[c][ended])) for c in own}
        sort = np.argsort(now["head"], kind="stable")
        now = {c: v[sort] for c, v in now.items()}
        new = shared[now["head"]] < d
        new[0] = True
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        node = {c: np.add.reduceat(now[c], begin) for c in _SUMS} | {"low": np.minimum.reduceat(now["low"], begin), "head": now["head"][begin], "ends": np.maximum.reduceat(now["ends"], begin)}
        is_open = edge[node["head"]] >= d
        if waiting is not None:
            parent = group[np.argsort(sort)[: len(below["head"])]]
            names = {g: hashlib.md5(prefix(int(node["head"][g]), d)).digest() for g in np.flatnonzero(is_open).tolist()}
            emit_waiting(node["low"][parent], [names.get(g) for g in parent.tolist()])
            waiting = None
        going = {c: v[is_open] for c, v in node.items()}
        if len(going["head"]):
            open_ = {"path": pa.array([prefix(i, d) for i in going["head"].tolist()], pa.binary()), "ends": texts(going["ends"])}
            emit(len(going["head"]), open_ | {c: pa.array(going[c]) for c in (*_SUMS, "low")})
        done = {c: v[~is_open] for c, v in node.items()}
        words = turn[at[done["head"]] + d - 1, 2].astype(np.int64) if d else np.zeros(len(done["head"]), np.int64)
        leaves, saved = np.where(done["kids"] > 0, done["leaves"], 1), done["saved"] + (done["n"] - 1) * words
        below = done | {"kids": np.ones_like(leaves), "leaves": leaves, "saved": saved, "ends": np.full(len(leaves), -1)}
        if len(leaves):
            ids = [hashlib.md5(prefix(i, d)).digest() if named else None for i in done["head"].tolist()]
            columns = {c: pa.array(v) for c, v in (("n", done["n"]), ("low", done["low"]), ("kids", done["kids"]), ("leaves", leaves), ("saved", saved))}
            waiting = columns | {"depth": pa.array(np.full(len(leaves), d), pa.int32()), "ends": texts(done["ends"]), "id": pa.array(ids, pa.binary())}
    if waiting is not None:
        emit(len(below["head"]), waiting)
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def _slices(rows):
    """Runs of rows of a bounded size."""
    held, size = [], 0
    for r in rows:
        if held and (len(held) >= ROWS or size >= BYTES):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r[0])
    if held:
        yield held


def _counted(batches):
    """Sorted blocks (path, ids, n, low) to one row a path: the ids of a path are digested as they come, block after block."""
    path = None
    for batch in batches:
        for p, ids, n, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p == path:
                total, least = total + n, min(least, low)
                digest.update(b"," + ids.encode())
            else:
                if path is not None:
                    yield path, total, least, 0, 0, 0, digest.hexdigest()
                path, total, least, digest = p, n, low, hashlib.sha256(ids.encode())
    if path is not None:
        yield path, total, least, 0, 0, 0, digest.hexdigest()


def _first_round(batches):
    for rows in _slices(_counted(batches)):
        yield peel(rows, False, False)


def _next_round(whole: bool):
    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for part in [list(rows)] if whole else _slices(rows):
            if part:
                yield peel(part, whole, True)

    return run


@written
def prefix_trie(of: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``of(conv_id, path)``; each ``conv_id`` once.

    ``conv_id``: the smallest member, whose first ``depth`` turns are the node; ``parent_conv_id``: that of the parent, null at the
    root; ``n_convs``: members; ``n_children``; ``n_leaves``: childless nodes of the subtree, itself included; ``saved_tokens``:
    over the subtree, the words of a node's last turn for each member but one; ``ends_sha256``: of the ids of the members that
    end here, ascending, with commas between. A conversation without turns ends at the root; without conversations there is no
    root. A node that many conversations end at has their ids as blocks of up to ``BLOCK``, which one task digests in order.
    A path is one value of 24 bytes a turn, and an open prefix of a slice's edge is a row of the next round.
    """
    spark = of.sparkSession
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = of.groupBy("path", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids"))
    blocks = cut(blocks.select("path", "block", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("low")), "blocks")
    ordered = blocks.repartitionByRange(partitions(spark), "path").sortWithinPartitions("path", "block").select("path", "ids", "n", "low")
    rounds = [cut(ordered.mapInArrow(_first_round, f"{_OPEN}, {_NODE}"), "peeled")]
    drop(blocks)
    before, over = None, False
    while not over:
        left = rounds[-1].where("path is not null").select(_FIELDS[:7])
        count = left.count()
        over = count <= ROWS or before is not None and count > before // 2  # few, or all on the edges of slices
        ordered = left.repartitionByRange(1 if over else -(-count // ROWS), "path").sortWithinPartitions("path")
        before = count
        rounds.append(cut(ordered.mapInArrow(_next_round(over), f"{_OPEN}, {_NODE}"), "peeled"))
    closed = [r.where("path is null") for r in rounds]
    nodes, later = closed[0], closed[1]
    for r in closed[1:]:
        nodes = nodes.unionByName(r)
    for r in closed[2:]:
        later = later.unionByName(r)
    parents = small(later.select(F.col("id").alias("parent_id"), F.col("low").alias("open_low")))
    parent = F.coalesce("parent_low", "open_low").alias("parent_conv_id")
    ends = F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.join(parents, "parent_id", "left").select(
        F.col("low").alias("conv_id"), "depth", parent, F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends)


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of ``rows(conv_id, turn, role, text)``.

    Turns are ordered by ``turn``, those without one first, equal ones by role and digest; rows that repeat are turns of their own;
    a null role or text is empty; rows without ``conv_id`` are left out; other columns are not looked at.
    """
    return prefix_trie(paths(rows))


def rebuilt(of: DataFrame) -> DataFrame:
    """Conversations that begin like another: the first h turns of c - c % 20, then what c has after its own first h, where h is
    crc32(c) % 4. A conversation that isn't there gives nothing."""
    base = of.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(20)))
    heads = base.where("conv_id = base").select("base", turns(F.col("path"), F.lit(0), F.lit(3)).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).cast("int")
    begins = F.coalesce(turns(F.col("head"), F.lit(0), h), F.lit(b""))
    return base.join(heads, "base", "left").select("conv_id", F.concat(begins, turns(F.col("path"), h)).alias("path"))


def op13_prefix_trie(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return prefix_trie(rebuilt(paths(rows)))


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""
ORACLE = {
    "op13_prefix_trie": f"""WITH convs AS (
            SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        sized AS (SELECT *, CAST(conv_id AS VARCHAR) AS id FROM convs),
        hashed AS (SELECT *, CAST({_CRC.format("id")} % 4 AS BIGINT) AS h FROM sized),
        made AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
            FROM hashed c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
        parts AS (SELECT conv_id, len(turns) AS size, d AS depth, turns[1:d] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM made)),
        nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256,
            CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
            FROM parts GROUP BY depth, path),
        kids AS (SELECT p.depth, p.path, count(*) AS n FROM nodes c JOIN nodes p ON c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path GROUP BY p.depth, p.path),
        counted AS (SELECT v.*, coalesce(k.n, 0) AS kids FROM nodes v LEFT JOIN kids k ON k.depth = v.depth AND k.path = v.path),
        under AS (SELECT *, unnest(range(depth + 1)) AS up FROM counted),
        sums AS (SELECT up AS depth, path[1:up] AS path, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM under GROUP BY up, path[1:up])
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, s.leaves AS n_leaves,
            CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM counted v JOIN sums s ON s.depth = v.depth AND s.path = v.path
        LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]"""
}
