"""Prefix trie of conversations by vertical bitmaps.

A shard is a range of conversation ids and a band of places. Its index holds, for each
(place, turn), the bitset of its conversations; from a node's bitset, intersection with
the postings of the next place gives the children, depth first, with their member
counts and the conversations that end there. Shards are as large as ``ROWS`` rows, so
neither a first turn that many conversations share nor one endless conversation is one
task's work: the former lies in many ranges, the latter in many bands. Nodes of the
shards that are the same path are then summed.

A turn is known by an md5 of role and text, a path by its depth and the exclusive or of
two 64-bit hashes of (place, turn) over its turns; so paths are summed up in any order.

Sums over a subtree need no walk: a node's members are known by their rows. Each node
belongs to its smallest member; a conversation owns the end of its own path, from some
depth on. So a row of conversation c adds, to its node, the code points from this turn
to the first turn whose node c owns: those are c's turns that others have already paid.

Defined cases: null role or text is empty, rows without a conv_id go, turns without a
number come first, turns of one number are ordered by hash, equal rows are turns of
their own, other columns don't matter, an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

#: Rows of a shard, at which it is closed at the next conversation.
ROWS = 20_000
#: Places of a band: the most turns that a shard has of one conversation.
BAND = 64


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), t1 and t2 (the turn's hash) and chars of each turn.

    Places are counted in blocks of turn numbers, to which the rows of the blocks before are added.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("m"), F.length(text).cast("long").alias("chars"), F.shiftright("turn", 8).alias("block")
    )
    before = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(W.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "m"))
    out = rows.withColumn("place", place).join(counts, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return saved(out.select("conv_id", (F.col("place") + F.col("first")).alias("place"), _half(F.col("m"), 1).alias("t1"), _half(F.col("m"), 17).alias("t2"), "chars"))


def spliced(turns: DataFrame, source: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from two: the first ``heads`` turns of conversation ``source``, then their own after so many.

    Both are expressions of conv_id, ``heads`` at most ``most``. Returns the turns, as of
    ``numbered``, and all conv_ids, since a rebuilt conversation may have no turn.
    """
    own = numbered(turns)
    wanted = own.select("conv_id").distinct().select("conv_id", source.alias("source"), heads.cast("int").alias("h"))
    turn = F.struct("place", "t1", "t2", "chars")
    first = own.where(F.col("place") <= most).groupBy(F.col("conv_id").alias("source")).agg(F.sort_array(F.collect_list(turn)).alias("first"))
    first = wanted.select("source").distinct().join(first, "source")
    plan = saved(wanted.join(first, "source", "left").select("conv_id", "h", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(first.schema["first"].dataType)).alias("head")))
    taken = plan.select("conv_id", F.inline("head"))
    rest = own.join(plan.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where(F.col("place") > F.col("h"))
    return taken.unionByName(rest.select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "t1", "t2", "chars")), plan.select("conv_id")


def _paths(rows: DataFrame) -> DataFrame:
    """Adds to each turn its path's key (k1, k2), its parent's (p1, p2), the code points up to it (sum) and whether it is the last."""
    g = {"g1": F.xxhash64("place", "t1", "t2"), "g2": F.xxhash64("t2", "place", "t1", F.lit(1))}
    rows = rows.withColumns(g | {"band": F.floor((F.col("place") - 1) / BAND)})
    in_band = W.partitionBy("conv_id", "band").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    bands = rows.groupBy(F.col("conv_id").alias("c"), F.col("band").alias("b")).agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"), F.sum("chars").alias("x"), F.max("place").alias("end"))
    bands = bands.select(
        "c", "b", *(F.coalesce(f(n).over(before), F.lit(0)).alias(n) for n, f in (("x1", F.bit_xor), ("x2", F.bit_xor), ("x", F.sum))), F.max("end").over(W.partitionBy("c")).alias("length")
    )
    rows = rows.withColumns({"k1": F.bit_xor("g1").over(in_band), "k2": F.bit_xor("g2").over(in_band), "sum": F.sum("chars").over(in_band)})
    out = rows.join(bands, (F.col("conv_id") == F.col("c")) & (F.col("band") == F.col("b")))
    key = {k: F.col(k).bitwiseXOR(F.col(x)) for k, x in (("k1", "x1"), ("k2", "x2"))}
    parent = {p: key[k].bitwiseXOR(F.col(g)) for p, k, g in (("p1", "k1", "g1"), ("p2", "k2", "g2"))}
    return saved(out.select("conv_id", "band", "place", "t1", "t2", *(c.alias(n) for n, c in (key | parent).items()), "chars", (F.col("sum") + F.col("x")).alias("sum"), (F.col("place") == F.col("length")).alias("last")))


#: What a shard says of a node; ``ends`` are the decimal ids of the conversations that end there.
PART = "k1 long, k2 long, p1 long, p2 long, depth long, chars long, sum long, conv_id long, n long, ends string"
_PART = pa.schema([(n, pa.string() if n == "ends" else pa.int64()) for n in "k1 k2 p1 p2 depth chars sum conv_id n ends".split()])


def _shard(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The nodes of one shard: rows ordered by (conv_id, place), all of one band."""
    conv, start = np.unique(cols["conv_id"], return_index=True)
    stop = np.append(start[1:], len(cols["conv_id"]))
    first = cols["place"][start]
    names = conv.tolist()
    # The turn of each row as a small number, and for each (place, turn) its bitset of conversations.
    turn = np.unique(np.rec.fromarrays([cols["place"], cols["t1"], cols["t2"]]), return_inverse=True)[1].ravel().tolist()
    postings: dict[int, int] = {}
    alive: dict[int, int] = {}
    ending: dict[int, int] = {}
    last, place = cols["last"], cols["place"].tolist()
    for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        bit = 1 << i
        for r in range(a, b):
            postings[turn[r]] = postings.get(turn[r], 0) | bit
            alive[place[r]] = alive.get(place[r], 0) | bit
        if last[b - 1]:
            ending[place[b - 1]] = ending.get(place[b - 1], 0) | bit
    rows, counts, ends = [], [], []
    # Conversations enter a band below different nodes: those that came by one path are one root here.
    roots: dict[tuple[int, int], int] = {}
    for i, key in enumerate(zip(cols["p1"][start].tolist(), cols["p2"][start].tolist(), strict=True)):
        roots[key] = roots.get(key, 0) | 1 << i
    band = int(first.min())
    stack = [(bits, band) for bits in roots.values()]
    while stack:
        bits, at = stack.pop()
        rest = bits & alive.get(at, 0)
        while rest:
            i = (rest & -rest).bit_length() - 1
            r = start[i] + at - first[i]
            child = bits & postings[turn[r]]
            rest &= ~child
            if child & (child - 1):
                done = child & ending.get(at, 0)
                ids = []
                while done:
                    low = done & -done
                    ids.append(str(names[low.bit_length() - 1]))
                    done ^= low
                rows.append(r)
                counts.append(child.bit_count())
                ends.append(",".join(ids) if ids else None)
                stack.append((child, at + 1))
            else:  # a conversation that is alone stays so
                tail = range(r, stop[i])
                rows.extend(tail)
                counts.extend([1] * len(tail))
                ends.extend([None] * (len(tail) - 1) + [str(names[i]) if last[stop[i] - 1] else None])
    take = np.array(rows, dtype=np.int64)
    values = [cols[c][take] for c in ("k1", "k2", "p1", "p2", "place", "chars", "sum", "conv_id")]
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in values), pa.array(counts, pa.int64()), pa.array(ends, pa.string())], schema=_PART)


_NUMBERS = ("conv_id", "band", "place", "t1", "t2", "k1", "k2", "p1", "p2", "chars", "sum", "last")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts rows ordered by (band, conv_id, place) into shards."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _NUMBERS}
        held = {c: np.concatenate([held[c], new[c]]) for c in _NUMBERS} if held else new
        while len(held["band"]):
            edge = np.flatnonzero((held["conv_id"][1:] != held["conv_id"][:-1]) | (held["band"][1:] != held["band"][:-1])) + 1
            other = np.flatnonzero(held["band"] != held["band"][0])
            size = other[0] if len(other) else None
            full = edge[edge >= ROWS]
            cut = min(x for x in (size, full[0] if len(full) else None, len(held["band"]) + 1) if x is not None)
            if cut > len(held["band"]):
                break
            yield _shard({c: v[:cut] for c, v in held.items()})
            held = {c: v[cut:] for c, v in held.items()}
    if held and len(held["band"]):
        yield _shard(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends, whose parts come in order; what is held is one hash, however many ends there are."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    key, sha = None, None
    for batch in batches:
        out = []
        for *node, ends in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "depth", "ends")), strict=True):
            if node == key:
                sha.update(b"," + ends.encode())
                continue
            if key:
                out.append((*key, sha.hexdigest()))
            key, sha = node, hashlib.sha256(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], [], []), schema, strict=True)], schema=schema)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, sha.hexdigest()), schema, strict=True)], schema=schema)


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the conversations in ``convs``, whose turns are ``rows`` (as of ``numbered``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, as the query's contract has them.
    """
    spark = rows.sparkSession
    paths = _paths(rows)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = paths.repartitionByRange(tasks, "band", "conv_id").sortWithinPartitions("band", "conv_id", "place")
    parts = saved(dealt.mapInArrow(_shards, PART))
    key = ["k1", "k2", "depth"]
    same = [F.first(c).alias(c) for c in ("p1", "p2", "chars", "sum")]
    nodes = parts.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), *same)
    ended = parts.where("ends is not null").select(*key, "conv_id", "ends")
    ended = ended.unionByName(convs.join(paths.select("conv_id").distinct(), "conv_id", "left_anti").select(*(F.lit(0).cast("long").alias(k) for k in key), "conv_id", F.col("conv_id").cast("string").alias("ends")))
    digests = ended.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(_digests, "k1 long, k2 long, depth long, ends_sha256 string")

    total = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in (*key, "p1", "p2", "chars", "sum")]
    nodes = nodes.select(*key, "p1", "p2", "chars", "sum", "conv_id", "n_convs").unionByName(total.select(*zero, "conv_id", "n_convs"))
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, key, "left").na.fill(0, ["n_children"]))

    # What a conversation owns: the nodes of its path from some depth on, and so at most one leaf.
    owned = nodes.where("depth > 0").groupBy("conv_id").agg(F.min(F.struct("depth", (F.col("sum") - F.col("chars")).alias("paid"))).alias("o"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    length = paths.groupBy("conv_id").agg(F.max("sum").alias("all"))
    info = length.join(owned, "conv_id", "left").select("conv_id", F.col("o.depth").alias("from"), F.coalesce("o.paid", "all").alias("paid"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    mine = paths.select("conv_id", "k1", "k2", F.col("place").alias("depth"), (F.col("sum") - F.col("chars")).alias("before")).join(info, "conv_id")
    shared = F.when(F.col("from").isNull() | (F.col("depth") < F.col("from")), F.col("paid") - F.col("before")).otherwise(F.lit(0))
    below = mine.groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(shared).alias("saved_tokens"))
    top = nodes.agg(
        F.sum(F.when((F.col("n_children") == 0), 1).otherwise(0)).alias("n_leaves"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.count("*").alias("n")
    ).where("n > 0").select(*(F.lit(0).cast("long").alias(k) for k in key), "n_leaves", "saved_tokens")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # The root's children are the most of any node's; the root is one row, so they need no shuffle for it.
    root = F.broadcast(nodes.where("depth = 0").select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")))
    at = lambda d: nodes.where(d)
    placed = at("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(at("depth = 1").join(root, "depth", "left")).unionByName(at("depth > 1").join(parents, ["p1", "p2", "depth"], "left"))
    out = placed.join(below.unionByName(top), key, "left").join(digests, key, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    )

