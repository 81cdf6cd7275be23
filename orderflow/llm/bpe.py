"""Byte-level BPE with numpy matrices: encoding and decoding of whole texts.

Every match of the pattern is encoded on its own. A match that is a token is that
token. The others are put into padded matrices by length; in each round every row
merges its leftmost pair of least rank, found in a hashed table of pairs, and the
matrix closes the gap. Rows without a pair leave. A match longer than the widest padded
matrix is a row of its own width; there a round merges the places of the least pair from
the left up to the first whose new token makes a pair of a still lower rank, which is the
same merges in the same order in far fewer rounds.

Defined cases: null and empty texts have no ids; null ids decode to no bytes; an
empty table gives an empty table; repeated rows are encoded alike. Other columns
pass through; those named like an output are replaced.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .segments import SegmentCache

NONE = np.int32(2**31 - 1)
#: Widths of the padded matrices, in bytes.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256)
#: Cells of one matrix.
CELLS = 2_000_000
#: Characters that are encoded at once.
BLOCK = 2_000_000


class PairTable:
    """Open-addressing hash table from a pair of ids to the merged id, looked up by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = rest[self.keys[slots[rest]] == -1]
            at, first = np.unique(slots[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], merged[free[first]]
            rest = np.setdiff1d(rest, free[first], assume_unique=True)
            slots[rest] = (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids (= ranks); NONE where a pair doesn't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys).ravel() & (self.keys[slot] != -1).ravel() & (left >= 0).ravel() & (right >= 0).ravel())
        flat, k, at = out.ravel(), keys.ravel(), slot.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == k[open_]
            flat[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return flat.reshape(out.shape)


class Vocabulary:
    """Ranks read from a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.matches = regex.compile(pattern).findall
        self.bytes_ = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get = self.ranks.get
        pairs = [(a, b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        left, right, merged = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.cache = SegmentCache(self.text, np.array([len(t) for t in self.tokens]))

    def text(self, text: str) -> np.ndarray:
        """The ids of one text."""
        cut = self.matches(text)
        ids = self.encode(set(cut))
        return np.frombuffer(b"".join(map(ids.__getitem__, cut)), dtype="<i4")

    def encode(self, matches: set[str]) -> dict[str, bytes]:
        out, by_width = {}, {w: [] for w in WIDTHS}
        for text in matches:
            m = text.encode()
            if (i := self.ranks.get(m)) is not None:
                out[text] = i.to_bytes(4, "little")
            elif len(m) > WIDTHS[-1]:
                out[text] = self.long(m)
            else:
                by_width[WIDTHS[bisect_left(WIDTHS, len(m))]].append((text, m))
        for width, rows in by_width.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                out.update(zip([t for t, _ in part], self.matrix([m for _, m in part], width), strict=True))
        return out

    def matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(-1, width)
        sizes = np.array([len(r) for r in rows])
        ids = np.where(np.arange(width) < sizes[:, None], self.bytes_[raw], np.int32(-1)).astype(np.int32)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        place, out = np.arange(len(rows)), [b""] * len(rows)
        while len(place):
            n, w = ids.shape
            at = ranks.argmin(1) if w > 1 else np.zeros(n, dtype=np.int64)
            best = ranks[np.arange(n), at] if w > 1 else np.full(n, NONE)
            if (done := best == NONE).any():
                ended = ids[done]
                flat, stop = ended[ended >= 0].astype("<i4").tobytes(), (np.cumsum((ended >= 0).sum(1)) * 4).tolist()
                for p, a, b in zip(place[done].tolist(), [0, *stop[:-1]], stop, strict=True):
                    out[p] = flat[a:b]
                ids, ranks, place, at, best = ids[~done], ranks[~done], place[~done], at[~done], best[~done]
                n = len(place)
                if not n:
                    break
            each = np.arange(n)
            ids[each, at] = best
            keep = np.ones((n, w), dtype=bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), dtype=bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(n, w - 2)
            if w > 2:
                rows_ = np.flatnonzero(at > 0)
                ranks[rows_, at[rows_] - 1] = self.pairs.find(ids[rows_, at[rows_] - 1], ids[rows_, at[rows_]])
                rows_ = np.flatnonzero(at < w - 2)
                ranks[rows_, at[rows_]] = self.pairs.find(ids[rows_, at[rows_]], ids[rows_, at[rows_] + 1])
        return out

    def long(self, match: bytes) -> bytes:
        """A row of one long match."""
        ids = self.bytes_[np.frombuffer(match, dtype=np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # Of places in a row, as in a run of one letter, every second one from the left.
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            around = np.concatenate([[-1], ids, [-1, -1]]).astype(np.int32)
            token = np.full(len(at), least, dtype=np.int32)
            before = np.where(np.diff(at, prepend=-3) == 2, least, around[at])
            lower = (self.pairs.find(before, token) < least) | (self.pairs.find(token, around[at + 3]) < least)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids[at] = least
            ids, now = ids[keep], at - np.arange(len(at))
            keep = np.ones(len(ranks), dtype=bool)
            keep[at] = False
            ranks = ranks[keep]
            touched = np.unique(np.concatenate([now - 1, now]))
            touched = touched[(touched >= 0) & (touched < len(ranks))]
            ranks[touched] = self.pairs.find(ids[touched], ids[touched + 1])
        return ids.astype("<i4").tobytes()


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once in each worker."""
    if (key := (path, pattern)) not in _loaded:
        _loaded[key] = Vocabulary(path, pattern)
    return _loaded[key]


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts (null: empty) in runs of about BLOCK characters."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(t or "")
        if size >= BLOCK:
            yield run
            run, size = [], 0
    if run:
        yield run


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def _with(df: DataFrame, names: dict[str, T.DataType], keep_out: set[str] = frozenset()) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns named like ``names``, and the schema with them."""
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in names or c in keep_out])
    rest = [f for f in df.schema.fields if f.name not in keep_out]
    return df, T.StructType([*rest, *(T.StructField(n, t) for n, t in names.items())])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its text and with ``ids`` (array<int>)."""
    df, schema = _with(df, {"ids": T.ArrayType(T.IntegerType(), False)}, {text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = vocabulary(path, pattern).cache
        for b in batches:
            at = 0
            for texts in blocks(b.column(b.schema.get_field_index(text)).to_pylist()):
                part = b.slice(at, len(texts))
                at += len(texts)
                rest = [n for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in rest), id_lists(cache.texts(texts))], names=[*rest, "ids"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of the tokens."""
    df, schema = _with(df, {"decoded": T.BinaryType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path, pattern).tokens.__getitem__
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            decoded = [b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, schema)
