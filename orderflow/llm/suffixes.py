"""Removal of repeated passages by merged Burrows-Wheeler transforms.

Every byte that a string of ``length`` bytes covers which also starts earlier goes.

1. Which strings can repeat at all is told by a filter that loses none: of all pieces of
   ``GRAM`` bytes of a string its anchor is the one of least hash, so equal strings have
   equal anchors, and an anchor that is picked at one place of the corpus only lies in no
   repeated string. Counts of anchors become a bit map of 32 MB, however many there are; a
   set bit proves nothing and only costs work.
2. Runs of strings with one anchor, with the bytes they cover, are dealt out by anchor. In a
   bucket, shards of ``SHARD`` bytes get their suffix order and transform: for each suffix
   the ``STEP`` bytes before it, in the order of suffixes. The shards are then merged by
   refining their interleave: going through it, the next suffix of each shard in turn
   gives the symbol before it, and dealing the entries out by symbol, in order, gives
   the interleave by STEP bytes more. No suffix is compared with another. Where symbol or
   block of neighbours differ, their common prefix ends: after length / STEP rounds the
   blocks left are the repeated intervals.
3. Of each block the first occurrence stays; the others, and with them whole runs that are
   equal to an earlier run, are covered. Only the first ones, as ranges of starts, go
   back to the documents.

An anchor with runs of more than ``CROWD`` bytes is dealt out further by the runs' bytes; the
first occurrences of its parts then meet as whole strings, dealt out by the string.

Earlier means smaller doc_id, then less hash of the text where one doc_id has several texts,
then earlier start. Defined cases: null text is empty, a null doc_id comes after all
others, rows equal in doc_id and text are one document and get the same result, texts
shorter than ``length`` keep everything, other columns are kept, an empty table gives
none, long texts are read in pieces of ``PIECE`` bytes that overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, fresh, saved

LENGTH = 100
#: Bytes of an anchor, and of a symbol of the transforms: an even number that divides the length.
GRAM, STEP = 32, 10
#: Bits of the map of anchors.
BITS = 1 << 28
#: Bytes of text that are hashed at once; strings of a run.
PIECE, RUN = 1 << 19, 4096
#: Bytes of a shard, of a bucket's merge (one anchor's runs stay together), and of an anchor's runs that may be merged at once.
SHARD, BUCKET, CROWD = 1 << 15, 1 << 18, 2 << 20

_RANDOM = np.random.RandomState(7).randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K
    return x ^ (x >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place; 0 is kept for none."""
    h, k = _RANDOM[data], 1
    while k < GRAM:
        step = min(k, GRAM - k)
        h = h[:-step] * _K + h[step:] if step == k else _mixed(h[:-step] * _K + h[step:])
        h ^= h >> np.uint64(31)
        k += step
    return _mixed(h) | np.uint64(1)


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``width`` values in a row."""
    k = 1
    while k < width:
        step = min(k, width - k)
        values = best(values[:-step], values[step:])
        k += step
    return values


class Piece:
    """Some texts, or a part of one, behind each other; ``anchor`` holds each string's, 0 where no string of one text starts."""

    def __init__(self, data: bytes, starts: list[int], length: int):
        self.data, self.length = data, length
        raw = np.frombuffer(data, np.uint8)
        self.starts = np.array(starts, np.int64)
        if len(raw) < length:
            self.anchor = np.zeros(0, np.uint64)
            return
        self.grams = _grams(raw)
        self.anchor = _slide(self.grams, length - GRAM + 1, np.minimum)
        # A string that begins in the last bytes of a text would run into the next.
        for stop in [*starts[1:], len(data)]:
            self.anchor[max(stop - length + 1, 0) : stop] = 0

    def picked(self) -> np.ndarray:
        """Hashes of all places that are some string's anchor."""
        if not len(self.anchor):
            return self.anchor
        pad = np.zeros(self.length - GRAM, np.uint64)
        most = _slide(np.concatenate([pad, self.anchor, pad]), self.length - GRAM + 1, np.maximum)
        return self.grams[most == self.grams]

    def runs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the runs of strings with one anchor that the bit map ``known`` has."""
        a = self.anchor
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.empty(len(a), bool)
        new[0], new[1:] = True, a[1:] != a[:-1]
        new[self.starts[self.starts < len(a)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        h = a[first]
        bit = (h % np.uint64(BITS)).astype(np.int64)
        may = (h != 0) & ((known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)
        first, last = first[may], last[may]
        if len(first) and (last - first).max() >= RUN:
            cut = [(x, min(x + RUN - 1, b)) for a, b in zip(first.tolist(), last.tolist(), strict=True) for x in range(a, b + 1, RUN)]
            first, last = np.array(cut, np.int64).T
        return first, last


def _pieces(texts: list[bytes | None], length: int) -> Iterator[tuple[Piece, list[int], int]]:
    """Pieces with the row numbers of their texts, and where the first begins in its own text."""
    data, starts, rows, size = [], [], [], 0
    for i, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        if len(text) > PIECE:
            for at in range(0, len(text) - length + 1, PIECE):
                yield Piece(text[at : at + PIECE + length - 1], [0], length), [i], at
            continue
        data.append(text)
        starts.append(size)
        rows.append(i)
        size += len(text)
        if size > PIECE:
            yield Piece(b"".join(data), starts, length), rows, 0
            data, starts, rows, size = [], [], [], 0
    if data:
        yield Piece(b"".join(data), starts, length), rows, 0


def _pick(length: int) -> Callable:
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [piece.picked() for piece, _, _ in _pieces(batch.column(0).to_pylist(), length)]
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=schema)

    return run


RUNS = "h long, none boolean, id long, th long, start long, bytes binary"
_RUNS = pa.schema([("h", pa.int64()), ("none", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


def _cut(known, length: int) -> Callable:
    """The runs of each document; equal ones of a batch once, at their first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            none, ids, th = (batch.column(i).to_pylist() for i in range(3))
            found: dict[bytes, tuple] = {}
            for piece, rows, at in _pieces(batch.column(3).to_pylist(), length):
                first, last = piece.runs(bits)
                text = np.searchsorted(piece.starts, first, side="right") - 1
                start = first - piece.starts[text] + at
                h = piece.anchor[first].view(np.int64)
                for a, b, t, s, anchor in zip(first.tolist(), (last + length).tolist(), text.tolist(), start.tolist(), h.tolist(), strict=True):
                    key = piece.data[a:b]
                    place = (none[rows[t]], ids[rows[t]], th[rows[t]], s)
                    old = found.get(key)
                    if old is None or place < old[1]:
                        found[key] = anchor, place
            if found:
                place = zip(*(v[1] for v in found.values()), strict=True)
                columns = [[v[0] for v in found.values()], *place, list(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUNS, strict=True)], schema=_RUNS)

    return run


def _stable(numbers: np.ndarray) -> np.ndarray:
    """The order of small numbers, equal ones as they stand: numpy deals 16 bits out in passes over the bytes."""
    low = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable")
    if not len(numbers) or numbers.max() < 1 << 16:
        return low
    return low[np.argsort((numbers >> 16).astype(np.uint16)[low], kind="stable")]


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """The rank of each row of some columns of small numbers, the last being the least important; equal rows share one."""
    order = _stable(columns[-1])
    for c in columns[-2::-1]:
        order = order[_stable(c[order])]
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


class Transforms:
    """Shards of some strings, each with its suffixes in the order of their first ``length`` bytes.

    Each string is followed by STEP zero bytes: the suffixes without bytes, which stand
    first in their shard.
    """

    def __init__(self, strings: list[bytes], length: int):
        self.length = length
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + STEP
        begins = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        raw = np.frombuffer((b"\0" * STEP).join([*strings, bytes(STEP)]), np.uint8)
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        self.offset = (np.arange(total) - begins[self.string]).astype(np.int32)
        self.left = (sizes - STEP).astype(np.int32)[self.string] - self.offset
        # The symbol that begins at each place, as a small number; 0 where a string has ended.
        pairs = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        self.symbol = _dense([pairs[k : k + total] for k in range(0, STEP, 2)]) + 1
        self.symbol[self.left <= 0] = 0
        # Shards are whole strings.
        cuts = [*begins[np.flatnonzero(np.diff(begins // SHARD, prepend=-1))].tolist(), total]
        self.order = np.concatenate([a + self._suffixes(slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)])
        self.shard = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))

    def _suffixes(self, part: slice) -> np.ndarray:
        """Places of a shard in the order of their suffixes, by doubling of what is compared."""
        rank, left, known = _dense([self.symbol[part]]), self.left[part], STEP
        while known < self.length:
            step = min(known, self.length - known)
            ahead = np.zeros_like(rank)
            ahead[:-step] = rank[step:]
            ahead[left <= step] = 0  # what lies beyond a string's own end is no part of its suffix
            rank = _dense([rank, ahead])
            known += step
        return _stable(rank)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all strings of ``length`` bytes in the merged order, and for each the number of its block: equal strings share one.

        Round r refines the suffixes that begin STEP * r bytes before such a string's end.
        """
        offset, left = self.offset[self.order], self.left[self.order]

        def suffixes(r: int) -> np.ndarray:
            """Entries, shard by shard in the shard's own order."""
            return np.flatnonzero((offset >= self.length - STEP * r) & (left >= STEP * r))

        at = suffixes(0)
        # At first the interleave knows of each entry only its shard, and all are one block.
        interleave, block = self.shard[at], np.zeros(len(at), np.int32)
        for r in range(1, self.length // STEP + 1):
            # Each shard's entries come in its own order: its transform, the symbol before each, is read from front to back.
            read = np.empty(len(interleave), np.int32)
            read[_stable(interleave)] = self.symbol[self.order[at] - STEP]
            dealt = _stable(read)
            read, block, interleave = read[dealt], block[dealt], interleave[dealt]
            new = np.zeros(len(read), bool)
            new[1:] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
            block = np.cumsum(new, dtype=np.int32)
            at = suffixes(r)
        places = np.empty(len(interleave), np.int64)
        places[_stable(interleave)] = self.order[at]
        return places, block


def first_starts(strings: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First occurrences of the strings of ``length`` bytes in some strings: the number of the one it is in, and the offset there.

    The occurrence of least ``place`` + offset is the first; no two have the same.
    """
    t = Transforms(strings, length)
    places, block = t.merged()
    at = place[t.string[places]] + t.offset[places]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    least = np.minimum.reduceat(at, starts) if len(at) else at
    kept = np.sort(places[at == least[block]])
    return t.string[kept], t.offset[kept]


KEPT = "none boolean, id long, th long, start long, stop long, h long, bytes binary"
_KEPT = pa.schema([("none", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("h", pa.int64()), ("bytes", pa.binary())])


def _merge(length: int) -> Callable:
    """First occurrences in each anchor's runs, as ranges of starts; of crowded anchors one by one with their bytes."""

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        strings = [r[6] for r in rows]
        # Runs in the order of their texts and starts; runs of one text may overlap, so an occurrence is ranked by text and start.
        order = sorted(range(len(rows)), key=lambda i: rows[i][2:6])
        place = np.empty(len(rows), np.int64)
        base, last = -1, None
        for i in order:
            if rows[i][2:5] != last:
                last, base = rows[i][2:5], base + 1
            place[i] = (base << 32) + rows[i][5]
        t, offset = first_starts(strings, place, length)
        out: list[tuple] = []
        edge = np.flatnonzero((t[1:] != t[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(t)], strict=True):
            if a == b:
                continue
            _, crowded, none, id_, th, start, data = rows[t[a]]
            lo, hi = int(offset[a]), int(offset[b - 1])
            if crowded:
                out += [(none, id_, th, start + o, start + o, rows[t[a]][0], data[o : o + length]) for o in range(lo, hi + 1)]
            else:
                out.append((none, id_, th, start + lo, start + hi, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _KEPT, strict=True)], schema=_KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "crowded", "none", "id", "th", "start", "bytes")), strict=True):
                if r[0] != key and size >= BUCKET:
                    yield merged(rows)
                    rows, size = [], 0
                if rows and r[0] == key and r[6] == rows[-1][6]:
                    continue  # the same run again, later
                key = r[0]
                rows.append(r)
                size += len(r[6])
        if rows:
            yield merged(rows)

    return run


def _bit_map(spark: SparkSession, hashes: DataFrame):
    """A broadcast bit map of column ``h``: BITS / 8 bytes at most go through the driver, whatever comes in."""
    bit = F.pmod("h", F.lit(BITS))
    rows = hashes.select(F.shiftright(bit, 15).alias("row"), (bit % 32768).alias("at")).repartition("row").groupBy("row").agg(F.bitmap_construct_agg("at").alias("map"))
    out = bytearray(BITS // 8)
    for r in rows.collect():
        out[r["row"] * 4096 : (r["row"] + 1) * 4096] = r["map"]
    return spark.sparkContext.broadcast(bytes(out))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _remove(known, length: int, text: str, ranges: str) -> Callable:
    """Adds the covered spans of each document, and what is left of it; ``ranges`` are starts of strings that stay."""

    def spans(piece: Piece, rows: list[int], at: int, bits: np.ndarray, stay: list, found: dict[int, list]) -> None:
        first, last = piece.runs(bits)
        edge = np.zeros(len(piece.anchor) + 1, np.int32)
        edge[first] += 1
        np.subtract.at(edge, last + 1, 1)
        goes = np.cumsum(edge[:-1]) > 0
        for row, start in zip(rows, piece.starts.tolist(), strict=True):
            for r in stay[row] or ():
                goes[max(r["start"] - at, 0) + start : max(r["stop"] + 1 - at, 0) + start] = False
        turn = np.flatnonzero(np.diff(np.concatenate([[False], goes, [False]])))
        text = np.searchsorted(piece.starts, turn[::2], side="right") - 1
        for t, a, b in zip(text.tolist(), turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            shift = at - int(piece.starts[t])
            a, b, own = a + shift, b - 1 + length + shift, found.setdefault(rows[t], [])
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], b)
            else:
                own.append((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text)).cast(pa.binary()).to_pylist()
            stay = batch.column(names.index(ranges)).to_pylist()
            found: dict[int, list] = {}
            for piece, rows, at in _pieces(texts, length):
                spans(piece, rows, at, bits, stay, found)
            left = []
            for i, t in enumerate(texts):
                if i not in found:
                    left.append(t or b"")
                    continue
                cuts = [0, *(x for s in found[i] for x in s), len(t)]
                left.append(b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            listed = [[{"start": a, "stop": b} for a, b in found.get(i, ())] for i in range(len(texts))]
            columns = [batch.column(n) for n in names if n != ranges]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, SPANS), pa.array(left, pa.binary())], names=[*(n for n in names if n != ranges), "spans", "left"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``spans``, the (start, stop) of its maximal covered runs of bytes, and ``left``, the bytes that stay."""
    if length % STEP or length < 2 * GRAM:
        raise ValueError(f"the length must be a multiple of {STEP} and at least {2 * GRAM}")
    spark = docs.sparkSession
    key = {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)).cast("long"), "th": F.xxhash64("text")}
    text = F.col("text").cast("binary")
    picked = docs.select(text.alias("text")).mapInArrow(_pick(length), "h long, n long")
    picked = saved(picked.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    known = _bit_map(spark, picked)
    runs = docs.select(*(c.alias(n) for n, c in key.items()), text.alias("text")).mapInArrow(_cut(known, length), RUNS)
    # Between two picks of an anchor lie less than two lengths, so this is no less than the bytes of its runs.
    parts = F.ceil(F.col("n") * (2 * length) / CROWD)
    crowds = few(picked.where(parts > 1).select("h", parts.alias("parts")))
    dealt = runs.join(crowds, "h", "left").select(
        F.when(F.col("parts").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.pmod(F.xxhash64("bytes"), F.coalesce("parts", F.lit(1))))).alias("key"),
        F.col("parts").isNotNull().alias("crowded"), "none", "id", "th", "start", "bytes",
    )
    place = ("none", "id", "th", "start")
    kept = saved(dealt.repartition("key").sortWithinPartitions("key", "bytes", *place).mapInArrow(_merge(length), KEPT))
    alone = kept.where("bytes is not null").groupBy("bytes").agg(F.min(F.struct(*place)).alias("first")).select(*(F.col(f"first.{c}").alias(c) for c in place), F.col("first.start").alias("stop"))
    ranges = kept.where("bytes is null").select(*place, "stop").unionByName(alone)
    held = fresh(docs, "ranges")
    names = {n: fresh(docs, n) for n in key}
    ranges = ranges.groupBy(*(F.col(n).alias(names[n]) for n in key)).agg(F.collect_list(F.struct("start", "stop")).alias(held))
    joined = docs.withColumns({names[n]: c for n, c in key.items()}).join(ranges, list(names.values()), "left").drop(*names.values())
    clash = {c: fresh(docs, c) for c in docs.columns if c.lower() in ("spans", "left")}
    fields = ", ".join(f"`{clash.get(f.name, f.name)}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.withColumnsRenamed(clash).mapInArrow(_remove(known, length, "text", held), f"{fields}, spans array<struct<start: long, stop: long>>, left binary")
