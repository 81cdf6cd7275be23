"""Phrase collocations by SON partitioning.

The corpus falls into ``SHARDS`` shards: every so-manieth split of the input. Each shard
is mined completely at the support divided by the number of shards, rounded up. A phrase
that misses that in every shard has at most shards * (ceil(support / shards) - 1)
occurrences, which is less than the support whatever the shards' sizes are; so the union
of the shards' phrases holds every phrase sought, and their exact counts over all shards
follow. Support is a number of occurrences, not a share, so shards must be fewer than
it: a shard is no task, but is mined by as many tasks as Spark deals its phrases to.

Mining goes by levels: words, then pairs of frequent words, then threes of two frequent
pairs. What a level found goes to the next as a bit map of hashes, 32 MB however many
phrases there are: a clear bit proves a phrase rare, and a set one proves nothing, so
all that passes is counted, in the end by its text. Tasks mine slices of documents in
numpy. A mined phrase is a hash: 32 bits in one of many buckets, packed with its count
into one row for each task and bucket; phrases that share a hash only pass more easily.

Defined cases: null text is empty, null lang is ``und``, equal rows count each, other
columns don't matter, an empty table has no phrases. Scores are exact for
counts up to 3 * 10^15.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

SHARDS = 3
#: Bits of the map of frequent phrases.
BITS = 1 << 28
#: Bytes of text that are mined together, and phrases that a task gathers before it sums them up.
SLICE, GATHERED = 4 << 20, 4_000_000
#: The language of documents without one.
UNKNOWN = "und"

#: Bytes that end a piece. Upper-case letters are gone by then, so ``A`` can mark an end.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"A" * len(_ENDS) + b" ")
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Slice:
    """Words of some texts of one language: ``ids`` into ``words``, -1 where a piece ends, and each word's hash."""

    def __init__(self, lang: str, texts: list[bytes]):
        tokens = b"\n".join(texts).translate(_TABLE).replace(b"A", b" A ").split()
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        self.lang, self.words = lang, coded.dictionary.to_pylist()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = self.words.index(b"A") if b"A" in self.words else -1
        self.ids = np.where(ids == end, -1, ids)
        seed = xxhash.xxh32_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def starts(self, n: int, known: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of ``n`` words begin whose parts may all be frequent, and the phrases' hashes."""
        at, h = np.flatnonzero(self.ids >= 0), None
        for k in range(1, n + 1):
            if k > 1:
                # A phrase's parts are those that begin here and one word later.
                there = np.zeros(len(self.ids) + 1, bool)
                there[at] = True
                at = at[there[at + 1]]
            h = self.hash(at, k)
            if k < n:
                at = at[known(k, h)]
        return at, h

    def hash(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = _mixed(h + self.hashes[self.ids[at + k]] * _K[k])
        return h


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= SLICE:
                yield Slice(lang, held.pop(lang))
                del size[lang]
        for lang, texts in held.items():
            yield Slice(lang, texts)


class Frequent:
    """Bit maps of the frequent phrases of each length, as broadcast; ``buckets`` is how many hashes are dealt to."""

    def __init__(self, buckets: int, maps: list):
        self.buckets, self.maps = buckets, maps

    def deal(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 32 bits of each hash."""
        return (h >> np.uint64(32)) % np.uint64(self.buckets), h & np.uint64(0xFFFFFFFF)

    def __call__(self, n: int, h: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.maps[n - 1].value, np.uint8)
        bit = _bit(*self.deal(h))
        return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _bit(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    return ((low ^ (bucket * np.uint64(0x9E3779B1))) % np.uint64(BITS)).astype(np.int64)


def _bit_map(spark: SparkSession, bits: DataFrame):
    """A broadcast bit map of column ``bit``: BITS / 8 bytes at most go through the driver, whatever comes in."""
    rows = bits.select(F.shiftright("bit", 15).alias("row"), (F.col("bit") % 32768).alias("at")).repartition("row").groupBy("row").agg(F.bitmap_construct_agg("at").alias("map"))
    out = bytearray(BITS // 8)
    for r in rows.collect():
        out[r["row"] * 4096 : (r["row"] + 1) * 4096] = r["map"]
    return spark.sparkContext.broadcast(bytes(out))


MINED = "bucket int, shard int, low binary, n binary"


def _mine(n: int, known: Frequent, enough: int) -> Callable:
    """The phrases of ``n`` words in a part of a shard; a count of ``enough`` stands for any higher one."""
    schema = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("low", pa.binary()), ("n", pa.binary())])

    def summed(held: list[np.ndarray], shard: int) -> pa.RecordBatch:
        bucket, low = known.deal(np.concatenate(held))
        key, count = np.unique(bucket << np.uint64(32) | low, return_counts=True)
        count = np.minimum(count, enough).astype(np.uint32)
        bucket, first = np.unique(key >> np.uint64(32), return_index=True)
        low, cuts = key.astype(np.uint32), [*first.tolist(), len(key)]
        packed = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x in (low, count)]
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), shard, np.int32)), *(pa.array(x, pa.binary()) for x in packed)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() % SHARDS, [], 0
        for s in _slices(batches):
            held.append(s.starts(n, known)[1])
            size += len(held[-1])
            if size >= GATHERED:
                yield summed(held, shard)
                held, size = [], 0
        if size:
            yield summed(held, shard)

    return run


def _found(enough: int) -> Callable:
    """The bits of the hashes that are frequent in some shard; rows come bucket by bucket."""

    def bits(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(low, np.uint32).astype(np.uint64) | np.uint64(shard << 32) for shard, low, _ in rows])
        count = np.concatenate([np.frombuffer(n, np.uint32) for *_, n in rows])
        key, at = np.unique(key, return_inverse=True)
        often = key[np.bincount(at.ravel(), count) >= enough] & np.uint64(0xFFFFFFFF)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(np.uint64(bucket), often)))], names=["bit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and held:
                    yield bits(bucket, held)
                    held = []
                bucket = b
                held.append(tuple(row))
        if held:
            yield bits(bucket, held)

    return run


#: Rows of counted phrases that a task gathers before it sums them up.
COUNTED = 1_000_000
_COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])


def _count(longest: int, known: Frequent) -> Callable:
    """The phrases of 2 words and more that may be frequent, by their text, with their counts in a part; ``longest`` 1: all words."""

    def phrases(s: Slice, k: int) -> tuple[list[bytes], np.ndarray]:
        at, h = s.starts(k, known)
        at = at[known(k, h)]
        # Equal phrases get equal numbers: that of the words before, made small again, times the words, plus the next word's.
        part = s.ids[at]
        for j in range(1, k):
            first = np.unique(part, return_inverse=True)[1] if j > 1 else part
            part = first * len(s.words) + s.ids[at + j]
        _, i, count = np.unique(part, return_index=True, return_counts=True)
        words = [[s.words[w] for w in s.ids[at[i] + j].tolist()] for j in range(k)]
        return list(map(b" ".join, zip(*words, strict=True))), count

    def summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        out = pa.concat_tables(held).group_by(["lang", "size", "phrase"]).aggregate([("n", "sum")]).select(["lang", "size", "phrase", "n_sum"])
        yield from out.rename_columns(_COUNTS.names).cast(_COUNTS).combine_chunks().to_batches(max_chunksize=200_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for s in _slices(batches):
            for k in range(2, longest + 1) if longest > 1 else (1,):
                if k == 1:
                    count = np.bincount(s.ids[s.ids >= 0], minlength=len(s.words))
                    found, count = [w for w, c in zip(s.words, count.tolist(), strict=True) if c], count[count > 0]
                else:
                    found, count = phrases(s, k)
                columns = [pa.array([s.lang] * len(found), pa.string()), pa.array(np.full(len(found), k, np.int32)), pa.array(found, pa.binary()), pa.array(count.astype(np.int64))]
                held.append(pa.table(columns, schema=_COUNTS))
                size += len(found)
            if size >= COUNTED:
                yield from summed(held)
                held, size = [], 0
        if size:
            yield from summed(held)

    return run


def counts(docs: DataFrame, support: int = 10, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """lang, size, phrase and f of every phrase of up to ``longest`` words with at least ``support`` occurrences, and each lang's words (n)."""
    assert 1 <= longest <= len(_K), "phrases have one to three words"
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = "lang string, size int, phrase binary, n long"
    local = -(-support // SHARDS)
    every = lambda df: df.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = saved(every(texts.mapInArrow(_count(1, Frequent(buckets, [])), rows)))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= support)
    known = Frequent(buckets, [_bit_map(spark, frequent.mapInArrow(_word_bits(buckets), "bit long"))])
    for k in range(2, longest + 1):
        mined = texts.mapInArrow(_mine(k, known, local), MINED).repartition("bucket").sortWithinPartitions("bucket")
        known = Frequent(buckets, [*known.maps, _bit_map(spark, mined.mapInArrow(_found(local), "bit long"))])
    phrases = every(texts.mapInArrow(_count(longest, known), rows)).where(F.col("f") >= support) if longest > 1 else frequent.where("false")
    return saved(frequent.unionByName(phrases)), total


def _word_bits(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            h = np.fromiter((_word_hash(lang, w) for lang, w in zip(langs, words, strict=True)), np.uint64, len(words))
            h = _mixed(np.full(len(h), 1, np.uint64) + h * _K[0])
            yield pa.RecordBatch.from_arrays([pa.array(_bit(*Frequent(buckets, []).deal(h)))], names=["bit"])

    return run


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def score(a: Column, left: Column, right: Column, scale: int = 1_000_000) -> Column:
    """floor(scale * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, support: int = 10, best: int | None = 2000, covered: float = 0.5) -> DataFrame:
    """Each lang's phrases of two and three words, by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    A phrase inside a longer one that has at least ``covered`` (a share in hundredths) of
    its occurrences goes. ``best`` is how many of a lang are returned, None for all.
    """
    found, total = counts(docs, support)
    words = found.where("size = 1").select("lang", F.col("phrase").alias("w"), F.col("f").alias("fw"))
    pairs, threes = found.where("size = 2"), found.where("size = 3")
    text = F.col("phrase").cast("string")
    at = lambda c, i: F.split(c, " ")[i]
    part = lambda *i: F.concat_ws(" ", *(at(text, k) for k in i)).cast("binary")

    def with_part(df: DataFrame, of: Column, parts: DataFrame, name: str) -> DataFrame:
        renamed = parts.select(F.col("lang").alias("_l"), F.col(parts.columns[1]).alias("_p"), F.col(parts.columns[2]).alias(name))
        return df.withColumn("_of", of).join(renamed, (F.col("lang") == F.col("_l")) & (F.col("_of") == F.col("_p"))).drop("_l", "_p", "_of")

    two = pairs.select("lang", F.col("phrase").alias("p"), F.col("f").alias("fp"))
    of_two = with_part(with_part(pairs, part(0), words, "l"), part(1), words, "r").select("lang", "phrase", F.col("f").alias("a"), "l", "r")
    of_three = with_part(with_part(with_part(with_part(threes, part(0), words, "l1"), part(1, 2), two, "r1"), part(0, 1), two, "l2"), part(2), words, "r2")
    of_three = saved(of_three.withColumns({"s1": score(F.col("f"), F.col("l1"), F.col("r1")), "s2": score(F.col("f"), F.col("l2"), F.col("r2"))}))
    later = F.col("s2") < F.col("s1")
    longer = of_three.select("lang", "phrase", F.col("f").alias("a"), F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"))
    within = of_three.select("lang", "f", F.explode(F.array(part(0, 1), part(1, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = of_two.join(within, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < round(100 * covered) * F.col("a"))).drop("longest")
    out = kept.unionByName(longer).withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))).withColumn("phrase", text)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = out.withColumn("rank", rank)
    if best is not None:
        out = out.where(F.col("rank") <= best)
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
