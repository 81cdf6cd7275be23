"""Sharding by sampled splitters.

Rows are ordered by the hash of their text, so equal texts stand together. A
sample drawn with a chance in proportion to a row's size gives the quantile
boundaries of many fine ranges. The ranges' true sizes are counted. In a range that is
over its share each large group of equal texts becomes a piece of its own, and what is
left is subdivided by the hash of the text, so equal texts stay together. Only a group
that doesn't fit into a shard's share is subdivided itself, by the hash of the key.
The pieces, a bounded number, are dealt to the shards, largest first, each to the
least filled shard, which makes the shards' bytes near equal.

All this is planned on a table of hash, key and size, so the texts are read twice: for
that table and for the result. A piece is numbered in parts of a size that suits one
task, dealt by hash, so neither a piece nor a shard stands in one task. The parts' counts
give each its first slot.

Rows that agree in text and key can't be told apart by hash. If a group of such rows is
over its share, the rows are written to the shared folder with a number for each first,
and dealt by that number: read again, a row keeps its number, so a task that is run
again deals alike.

Only sums for each piece reach the driver: at most ``3 * ranges`` rows, whatever the
input's size, and of the large groups at most ``2 * ranges / PART``.

Defined cases: a null text has zero bytes and stands before all texts; repeated rows
and rows without key get slots of their own and are spread like others; an empty table
gives an empty table. Other columns pass through; those named like an output are
replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, saved

#: Bytes added to each row's text.
ROW_BYTES = 8
#: Fine ranges for each shard, and sampled rows for each range.
RANGES, SAMPLES = 48, 12
#: Shares (each 1 / ranges of all) beyond which a range is looked into, and those of a large group and of each part.
OVERFULL, PART = 8, 4
#: Bytes and rows wanted in a part of a piece, which one task numbers.
TASK_BYTES, TASK_ROWS = 128 << 20, 1_000_000


def split_points(keys: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of ``h`` in a size-weighted sample of about ranges * SAMPLES rows.

    A row is drawn if a hash of its own, as a fraction, is below its size over the
    step; a hash and not a random number, so that a task that is run again draws alike.
    """
    step = max(1.0, total / (ranges * SAMPLES))
    draw = F.pmod(F.xxhash64("h", "key", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    sample = keys.where(draw < F.col("size") / step).select("h", F.greatest(F.col("size"), F.lit(step)).alias("w"))
    drawn = sorted((r["h"], r["w"]) for r in sample.groupBy("h").agg(F.sum("w").alias("w")).collect())
    share, filled, points = sum(w for _, w in drawn) / ranges, 0.0, []
    for h, w in drawn:
        filled += w
        if filled >= share * (len(points) + 1) and len(points) < ranges - 1:
            points.append(h)
            filled = max(filled, share * len(points))
    return sorted(set(points))


def range_of(h: Column, points: list[int]) -> Column:
    """How many points are below ``h``: a binary search in a literal array."""
    if not points:
        return F.lit(0)
    steps = [1 << k for k in range(len(points).bit_length() - 1, -1, -1)]
    table = F.array(*map(F.lit, points))
    search = lambda p: F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda lo, s: F.when(F.coalesce(F.get(p, lo + s - 1) < h, F.lit(False)), lo + s).otherwise(lo),
    )
    return F.element_at(F.transform(F.array(table), search), 1)


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """``df`` with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    outs = ("size", "shard", "slot")
    ranges = ranges or shards * RANGES
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in outs or c in (key, text)])
    names = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outs]
    h, size, number, piece, part, shard, first = (fresh(df, x) for x in ("h", "size", "number", "piece", "part", "shard", "first"))
    bytes_ = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + ROW_BYTES
    null_first = F.when(F.col(f"`{text}`").isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64(F.col(f"`{text}`")))
    df = df.withColumns({h: null_first, size: bytes_, number: F.lit(0).cast("long")})
    keys = saved(df.select(F.col(h).alias("h"), F.col(f"`{key}`").cast("string").alias("key"), F.col(size).alias("size")))
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    points = split_points(keys, total, ranges)
    share = lambda rows, size: max(size / max(1, total), rows / max(1, n)) * ranges
    sums = (F.count("*").alias("n"), F.sum("size").alias("size"))
    found = {r["r"]: [r["n"], r["size"]] for r in keys.groupBy(range_of(F.col("h"), points).alias("r")).agg(*sums).collect()}
    over = [r for r, x in found.items() if share(*x) > OVERFULL]
    within, base = F.lit(0).cast("long"), max(1, -(-total // (ranges * TASK_BYTES)), -(-n // (ranges * TASK_ROWS)))
    many, text_key = F.lit(base), F.col(f"`{key}`").cast("string")
    if over:
        most = PART / ranges
        large = keys.where(range_of(F.col("h"), points).isin(over)).groupBy("h", range_of(F.col("h"), points).alias("r")).agg(*sums)
        large = sorted(large.where((F.col("size") > most * total) | (F.col("n") > most * n)).collect(), key=lambda r: r["h"])
        code, cuts, parted = {}, {}, {}
        for i, g in enumerate(large):
            found[g["r"]] = [found[g["r"]][0] - g["n"], found[g["r"]][1] - g["size"]]
            code[g["h"]] = (i + 1) << 16
            cuts[g["h"]] = 1 + int(share(g["n"], g["size"]) / PART) if g["size"] * shards > total else 1
            parted[g["h"]] = max(base, -(-g["size"] // (cuts[g["h"]] * TASK_BYTES)), -(-g["n"] // (cuts[g["h"]] * TASK_ROWS)))
        rest = {r: 1 + int(share(*found[r]) / PART) for r in over if share(*found[r]) > OVERFULL}
        alike = keys.where(F.col("h").isin(list(code))).groupBy("h", "key").agg(*sums).where((F.col("n") > 1) & ((F.col("size") > most * total) | (F.col("n") > most * n)))
        if code and not alike.isEmpty():
            df = saved(df.withColumn(number, F.monotonically_increasing_id()))
        told = lambda d, of: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))[of].cast("long") if d else F.lit(None).cast("long")
        own = told(code, F.col(h)) + F.pmod(F.xxhash64(text_key, number, F.lit("piece")), told(cuts, F.col(h)))
        left = F.pmod(F.xxhash64(h, F.lit("piece")), told(rest, range_of(F.col(h), points)))
        among = range_of(F.col(h), points).isin(over)
        within = F.when(among, F.coalesce(own, left, F.lit(0).cast("long"))).otherwise(within)
        many = F.when(among, F.coalesce(told(parted, F.col(h)), F.lit(base))).otherwise(many)
    df = df.withColumn(piece, range_of(F.col(h), points) * F.lit(1 << 32) + within)
    df = df.withColumn(part, F.pmod(F.xxhash64(h, text_key, number, F.lit("part")), many))
    counts = df.groupBy(piece, part).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    heap, dealt = [(0, k) for k in range(shards)], {}
    for p in sorted(counts.groupBy(piece).agg(F.sum("size").alias("s")).collect(), key=lambda r: (-r["s"], r[piece])):
        filled, k = heapq.heappop(heap)
        dealt[p[piece]] = k
        heapq.heappush(heap, (filled + p["s"], k))
    if not dealt:
        return df.select(*names, F.col(size).alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    plan = df.sparkSession.sql("select inline(array(" + ", ".join(f"struct({p}L as {piece}, {k} as {shard})" for p, k in dealt.items()) + "))")
    before = W.partitionBy(shard).orderBy(piece, part).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(plan), piece).select(piece, part, shard, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    order = W.partitionBy(piece, part).orderBy(h, F.col(f"`{key}`").cast("string"), number)
    ranked = df.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(starts, [piece, part])
    return ranked.select(*names, F.col(size).alias("size"), F.col(shard).alias("shard"), (F.col("slot") + F.col(first)).alias("slot"))


def write(assigned: DataFrame, path: str) -> None:
    """Writes each shard as a folder of its own."""
    assigned.repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)
