"""Packing documents into sequences by cutting-stock column generation.

A document longer than a sequence gives full pieces and a rest; a rest gives a block,
a multiple of ``BLOCK_TOKENS``, and a tail. The histogram of the pieces (one class for
each length, so of bounded size) is a cutting-stock problem: a linear program over patterns, solved by column generation, whose new
columns an unbounded knapsack prices by dynamic programming. The solution is
rounded down; what is left, a bounded number of pieces, is packed by best fit. A task
numbers its pieces of each length as it cuts them; the counts by task, summed over the
tasks before, make that a rank among all pieces of the length. The rank says which copy
of which pattern, and so which sequence and offset, a piece gets. Since classes
are exact lengths, every place in a pattern is filled exactly. No group is larger than
what one task has cut, whatever the share of a length or of a repeated key.

Defined cases: a null text counts as empty and has only the closing id; repeated
rows are pieces of their own; an empty table gives an empty table. Only the key and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from .common import saved

LENGTH, END_ID, BLOCK_TOKENS = 1024, 0, 256
#: The linear program stops at this share above its lower bound, or after so many columns; either only leaves more padding.
GAP, COLUMNS = 0.002, 1200
_encoders: dict[tuple[str, str | None], Callable[[str], np.ndarray]] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Token bytes and special tokens of a tokenizer file whose ids are the order of its merges, else None."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, cut = d["model"], d.get("pre_tokenizer") or {}
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if model.get("type") != "BPE" or not level or d.get("normalizer") or model.get("dropout"):
        return None
    special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in d.get("added_tokens", [])):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    letters = byte_letters()
    return {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}, special


def encoder(path: str, pattern: str | None) -> Callable[[str], np.ndarray]:
    """Text to the ids that the tokenizer file gives it, read once in each worker.

    With ``pattern``, the file's own way to cut text, the merges run in tiktoken, which
    needs half the time; the ids are the same. What its pattern engine refuses, white
    space of millions of characters, and files of another kind go through tokenizers.
    """
    if (path, pattern) in _encoders:
        return _encoders[path, pattern]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    by_tokenizers = lambda s: np.array(slow.encode_batch_fast([s], add_special_tokens=False)[0].ids, dtype=np.uint32)
    found, encode = ranks_of(path) if pattern else None, by_tokenizers
    if found:
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=found[0], special_tokens=found[1])

        def encode(s: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(s, allowed_special="all")
            except ValueError:
                return by_tokenizers(s)

    _encoders[path, pattern] = encode
    return encode


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids."""
    at = n - n % length
    out = [(k, length) for k in range(0, at, length)]
    block = (n - at) // BLOCK_TOKENS * BLOCK_TOKENS
    if block:
        out.append((at, block))
    if n - at - block:
        out.append((at + block, n - at - block))
    return out


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False, pattern: str | None = None) -> DataFrame:
    """One row for each document: key, doc_tokens (with the closing id), its task and its pieces.

    A piece has start, length, ids_crc32, its number among the task's pieces of its
    length and, if asked for, ids.
    """
    kinds = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("number", pa.int64()), *[("ids", pa.binary())] * with_ids]
    piece = T.StructType([T.StructField(n, T.BinaryType() if n == "ids" else T.LongType(), False) for n, _ in kinds])
    keys = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([keys.schema["key"], T.StructField("doc_tokens", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("pieces", T.ArrayType(piece, False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = encoder(path, pattern), END_ID.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (length + 1)
        for b in batches:
            sizes, rows, ends = [], [], [0]
            for t in b.column(1).to_pylist():
                ids = encode(t or "").astype("<u4").tobytes() + end
                for start, n in cuts(len(ids) // 4, length):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((start, n, zlib.crc32(part), seen[n], *[part] * with_ids))
                    seen[n] += 1
                sizes.append(len(ids) // 4), ends.append(len(rows))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            inner = pa.StructArray.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], fields=[pa.field(n, k, False) for n, k in kinds])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array([task] * len(sizes), pa.int32()), lists], names=schema.names)

    return keys.mapInArrow(run, schema)


def best_pattern(prices: np.ndarray, length: int) -> tuple[float, list[int]]:
    """The most valuable multiset of lengths that fits; prices[i] is the value of length i + 1."""
    value, choice = np.zeros(length + 1), np.zeros(length + 1, dtype=np.int64)
    for c in range(1, length + 1):
        got = value[c - 1 :: -1][: len(prices)] + prices[:c]
        k = int(got.argmax())
        if got[k] > value[c - 1] + 1e-12:
            value[c], choice[c] = got[k], k + 1
        else:
            value[c] = value[c - 1]
    c, items = length, []
    while c > 0:
        if choice[c]:
            items.append(int(choice[c]))
            c -= int(choice[c])
        else:
            c -= 1
    return float(value[length]), items


def cutting_stock(demand: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """Patterns (lists of lengths that fit in a sequence) and how often each is used; every demand is met exactly.

    demand[i] counts the pieces of length i + 1. The simplex method runs on the
    lengths that occur, from patterns of one length each.
    """
    lengths = np.flatnonzero(demand) + 1
    m = len(lengths)
    if not m:
        return []
    index = {int(x): i for i, x in enumerate(lengths)}
    need = demand[lengths - 1].astype(float)
    basis = [[int(x)] * (length // int(x)) for x in lengths]
    counts = np.array([len(b) for b in basis], dtype=float)
    inverse, used = np.diag(1 / counts), need / counts
    for _ in range(COLUMNS):
        duals = inverse.sum(0)
        prices = np.zeros(length)
        prices[lengths - 1] = np.maximum(duals, 0)
        value, items = best_pattern(prices, length)
        # Farley's bound: the optimum is at least the present cost over the best value.
        if value <= 1 + GAP:
            break
        column = np.zeros(m)
        for x in items:
            column[index[x]] += 1
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, used / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step, row = ratio[out], inverse[out] / direction[out]
        used = np.maximum(used - step * direction, 0)
        used[out], basis[out] = step, items
        inverse -= np.outer(direction, row)
        inverse[out] = row
    left, plan = demand.astype(np.int64).copy(), []
    for items, x in sorted(zip(basis, used, strict=True), key=lambda p: -p[1]):
        each = np.bincount(items, minlength=length + 1)[1:]
        on = each > 0
        times = min(int(x + 1e-6), int((left[on] // each[on]).min()))
        if times > 0:
            plan.append((sorted(items, reverse=True), times))
            left -= times * each
    return plan + best_fit(left, length)


def best_fit(left: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """Largest first, each sequence filled with the largest pieces that still fit; equal sequences are made at once."""
    left, plan = left.copy(), []
    while left.any():
        room, items = length, []
        spare = left.copy()
        while room > 0 and len(fits := np.flatnonzero(spare[:room])):
            x = int(fits[-1]) + 1
            k = min(int(spare[x - 1]), room // x)
            items += [x] * k
            spare[x - 1] -= k
            room -= k * x
        each = left - spare
        on = each > 0
        times = int((left[on] // each[on]).min())
        plan.append((items, times))
        left -= times * each
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: upper rank, first rank, first sequence, offset in it and pieces a sequence, for each place in a pattern."""
    found: dict[int, list] = {}
    first, ranks = 0, {}
    for items, times in plan:
        at = 0
        for x in items:
            r = ranks.get(x, 0)
            found.setdefault(x, []).append((r + times, r, first, at))
            ranks[x] = r + times
            at += x
        first += times
    return {x: tuple(np.array(v, dtype=np.int64).T) for x, v in found.items()}


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False, pattern: str | None = None) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    docs = saved(pieces(df, path, key, text, length, with_ids, pattern))
    parts = docs.select("key", "doc_tokens", "task", F.explode("pieces").alias("p")).select("key", "doc_tokens", "task", "p.*")
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    demand = np.zeros(length, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        demand[r["length"] - 1] = r["n"]
    where = places(cutting_stock(demand, length))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    given = ["start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    rank = parts.join(first, ["length", "task"]).select("key", *given, (F.col("number") + F.col("first")).alias("rank"))
    schema = T.StructType([T.StructField(key, docs.schema["key"].dataType), *(rank.schema[n] for n in given), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, ranks = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, b.num_columns - 1))
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for x in np.unique(size):
                i = np.flatnonzero(size == x)
                upper, low, seq, at = where[int(x)]
                p = np.searchsorted(upper, ranks[i], side="right")
                sequence[i], offset[i] = seq[p] + ranks[i] - low[p], at[p]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return rank.mapInArrow(run, schema)
