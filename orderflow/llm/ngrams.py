"""Katz backoff language model, learned from a corpus and evaluated on all of it.

Tokens are the words of a text and one end token; the first word's context is a start
mark. P(w | v) is the Good-Turing discounted share of the pair's training count in its
context's, or, for pairs without training count, the context's backoff weight times
P(w). P(w) is the discounted unigram share; unknown words share the mass that
discounting frees. The weights make every distribution sum to one exactly.

Texts are cut into chunks of about ``CHUNK`` tokens, and each chunk sums its own words
and pairs before anything is shuffled. What a chunk needs to know goes to buckets by
word, later by context, as arrays; a bucket adds up all chunks' counts, keeps its part
of the model's tables and answers each chunk in the same order. The number of buckets
grows with the bytes of text, so a bucket's size does not. A context with more than its
share of all tokens is spread over ``SPREAD`` buckets by the second word, and its sums,
a few thousand at most, are put together afterwards. Every table between two exchanges
is written to the shared folder.

Defined cases: null texts are empty and have the end token only; without training rows
all tokens are unknown and have probability one; repeated rows count as often as they
occur; an empty table gives an empty table. Only the key and text columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: Tokens of a chunk, text bytes for each bucket, buckets of a frequent context, and the least share that makes one.
CHUNK, BUCKET_BYTES, SPREAD, LEAST_SHARE = 2_000_000, 12_000_000, 64, 1 / 20_000
#: Good-Turing discounts counts up to this.
K = 5
END, START = 0, 1  # a chunk's own numbers of the two marks; words follow
ROW = "kind string, chunk long, bucket int, data binary"
STATE, WORDS, SIZES, KNOWN, PAIRS, HOT = "state", "words", "sizes", "known", "pairs", "hot"


def small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def dump(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps([small(a) if isinstance(a, np.ndarray) else a for a in arrays], protocol=5), 1)


def load(data: bytes) -> list:
    return pickle.loads(zstandard.decompress(data))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "chunk", "bucket", "data"])


def mix(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


def word_bucket(words: list[bytes], buckets: int) -> np.ndarray:
    from zlib import crc32

    return np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words)) % np.uint64(buckets)


class Chunk:
    """Documents of one chunk as they are read."""

    def __init__(self):
        self.number = {b"": END}
        self.keys, self.train, self.ids, self.tokens = [], [], [], 0

    def add(self, key, text: str | None, train: bool) -> None:
        words = (text or "").encode().lower().split()
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number) + 1
        self.keys.append(key), self.train.append(train)
        self.ids.append(np.array([*map(number.__getitem__, words), END], dtype=np.int32))
        self.tokens += len(words) + 1

    def rows(self, chunk: int, buckets: int) -> Iterator[tuple]:
        ids, sizes = np.concatenate(self.ids), np.array([len(x) for x in self.ids])
        train = np.array(self.train)
        counts = np.bincount(ids[np.repeat(train, sizes)], minlength=len(self.number) + 1)
        yield STATE, chunk, -1, dump(self.keys, sizes, train.astype(np.uint8), ids, len(self.number) + 1)
        words, places = list(self.number), np.array(list(self.number.values()))
        of = word_bucket(words, buckets)
        for b in range(buckets):
            at = np.flatnonzero(of == b)
            if len(at):
                yield WORDS, chunk, b, dump(b" ".join([words[i] for i in at]), places[at], counts[places[at]])


def chunks(df: DataFrame, buckets: int) -> DataFrame:
    """One state row for each chunk, and its words for each bucket; ``df`` has key, text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, c = TaskContext.get().partitionId() << 32, 0, Chunk()
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                c.add(*row)
                if c.tokens >= CHUNK:
                    for r in c.rows(first + n, buckets):
                        yield batch([r])
                    n, c = n + 1, Chunk()
        if c.keys:
            for r in c.rows(first + n, buckets):
                yield batch([r])

    return df.mapInArrow(run, ROW)


def counted(buckets: int):
    """Adds up the words of one bucket: the answer to each chunk (places, ids, counts) and the counts of counts.

    Ids are unique over all buckets and small for frequent words; 0 is the start mark.
    """

    def run(t: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        asked = []
        for chunk, data in zip(t["chunk"].to_pylist(), t["data"], strict=True):
            words, places, counts = load(data.as_py())
            for w in (words := words.split(b" ")):
                if w not in number:
                    number[w] = len(number)
            asked.append((chunk, places, np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)), counts))
        total = np.zeros(len(number), dtype=np.int64)
        for _, _, at, counts in asked:
            total[at] += counts.astype(np.int64)
        rank = np.empty(len(number), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(number))
        bucket = t["bucket"][0].as_py()
        rows = [(KNOWN, c, bucket, dump(places, 1 + rank[at] * buckets + bucket, total[at])) for c, places, at, _ in asked]
        each, times = np.unique(total, return_counts=True)
        low = [int(times[each == r].sum()) for r in range(1, K + 2)]
        end = int(total[number[b""]]) if b"" in number else 0
        rows.append((SIZES, -1, bucket, pickle.dumps((int(total.sum()), int((total > 0).sum()), low, end))))
        return pa.Table.from_batches([batch(rows)])

    return run


class Local:
    """A chunk with the numbers that the word buckets know."""

    def __init__(self, t: pa.Table):
        kinds, data = t["kind"].to_pylist(), t["data"]
        self.keys, self.sizes, train, self.ids, n = load(data[kinds.index(STATE)].as_py())
        self.sizes, self.train, self.ids = self.sizes.astype(np.int64), train.astype(bool), self.ids.astype(np.int64)
        self.gid, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i in (i for i, k in enumerate(kinds) if k == KNOWN):
            places, gid, count = load(data[i].as_py())
            self.gid[places], self.count[places] = gid, count
        self.count[START], self.n = self.count[END], n

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as context * n + word, the pair of each token, and the pairs' training counts."""
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = START
        pairs, of = np.unique(before * self.n + self.ids, return_inverse=True)
        counts = np.bincount(of[np.repeat(self.train, self.sizes)], minlength=len(pairs))
        return pairs, of, counts

    def dealt(self, pairs: np.ndarray, buckets: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the pairs by bucket, context and word, and each one's bucket in that order."""
        v, w = np.divmod(pairs, self.n)
        gv, gw = self.gid[v], self.gid[w]
        spread = np.where(self.count[v] > hot, mix(gw) % np.uint64(SPREAD), np.uint64(0))
        bucket = mix(gv * SPREAD + spread.astype(np.int64)) % np.uint64(buckets)
        order = np.lexsort((gw, gv, bucket))
        return order, bucket[order].astype(np.int64)


def runs(x: np.ndarray) -> np.ndarray:
    """First places of equal runs."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.array([], dtype=np.int64)


def asked_pairs(buckets: int, hot: int):
    def run(t: pa.Table) -> pa.Table:
        c = Local(t)
        pairs, _, counts = c.pairs()
        order, bucket = c.dealt(pairs, buckets, hot)
        v, w = np.divmod(pairs[order], c.n)
        cuts, rows = [*runs(bucket).tolist(), len(order)], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            first = runs(v[a:b])
            data = dump(c.gid[v[a:b][first]], np.diff([*first, b - a]), c.count[v[a:b][first]], c.gid[w[a:b]], c.count[w[a:b]], counts[order[a:b]])
            rows.append((PAIRS, t["chunk"][0].as_py(), int(bucket[a]), data))
        return pa.Table.from_batches([batch(rows)])

    return run


#: Sums for each context: followers with pair count 1 to K, pair counts over K, followers with word count 1 to K, word counts over K.
SUMS = 2 * K + 2


def summed_pairs(hot: int):
    """Adds up the pairs of one bucket: the answer to each chunk, sums of contexts, counts of counts."""

    def run(t: pa.Table) -> pa.Table:
        asked = [(c, load(d.as_py())) for c, d in zip(t["chunk"].to_pylist(), t["data"], strict=True)]
        gv = np.concatenate([np.repeat(a[0].astype(np.int64), a[1]) for _, a in asked])
        gw, cw, n = (np.concatenate([a[i].astype(np.int64) for _, a in asked]) for i in (3, 4, 5))
        order = np.lexsort((gw, gv))
        v, w = gv[order], gw[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=n[order]).astype(np.int64)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = total[group]
        v, cw = v[new], cw[order][new]
        first = runs(v)
        context = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
        seen = total > 0
        sums = np.zeros((len(first), SUMS), dtype=np.int64)
        low, rare = seen & (total <= K), seen & (cw <= K)
        np.add.at(sums, (context[low], total[low] - 1), 1)
        np.add.at(sums, (context[rare], K + cw[rare]), 1)
        sums[:, K] = np.bincount(context[seen & ~low], weights=total[seen & ~low], minlength=len(first))
        sums[:, 2 * K + 1] = np.bincount(context[seen & ~rare], weights=cw[seen & ~rare], minlength=len(first))
        own, bucket, at, rows, often = v[first], t["bucket"][0].as_py(), 0, [], {}
        for c, a in asked:
            size = len(a[3])
            of = np.searchsorted(own, a[0].astype(np.int64))
            rows.append((PAIRS, c, bucket, dump(back[at : at + size], *sums[of].T)))
            for i in np.flatnonzero(a[2] > hot):
                often[int(a[0][i])] = sums[of[i]].tolist()
            at += size
        rows.append((HOT, -1, bucket, pickle.dumps(often)))
        rows.append((SIZES, -1, bucket, pickle.dumps([int((total == r).sum()) for r in range(1, K + 2)])))
        return pa.Table.from_batches([batch(rows)])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 to K from the numbers of items that occur 1 to K + 1 times.

    Where those numbers give a factor outside (0, 1), as in small corpora, all factors
    come from one absolute discount.
    """
    out = np.ones(K + 1)
    if n[0] and all(n[:K]):
        a = (K + 1) * n[K] / n[0]
        d = np.array([((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if a != 1 else 0 for r in range(1, K + 1)])
        if ((d > 0) & (d <= 1)).all():
            out[1:] = d
            return out
    if n[0]:
        each = n[0] / (n[0] + 2 * n[1])
        out[1:] = [(r - min(each, 0.9)) / r for r in range(1, K + 1)]
    return out


class Model:
    """The global numbers: tokens, types, discounts and the sums of frequent contexts."""

    def __init__(self, tokens: int, types: int, words: list[int], pairs: list[int], often: dict[int, list[int]], hot: int):
        self.tokens, self.types, self.hot = tokens, types, hot
        self.d1, self.d2 = discounts(words), discounts(pairs)
        freed = sum((1 - self.d1[r]) * r * words[r - 1] for r in range(1, K + 1)) / max(1, tokens)
        #: Where discounting frees nothing, one token more is thought of, which is unknown.
        self.scale = 1.0 if freed > 1e-12 else tokens / (tokens + 1)
        self.unknown = freed if freed > 1e-12 else 1 / (tokens + 1)
        keys = sorted(often)
        self.often, self.sums = np.array(keys, dtype=np.int64), np.array([often[k] for k in keys], dtype=np.int64).reshape(-1, SUMS)

    def words(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with these training counts."""
        share = self.scale * np.where(c <= K, self.d1[np.minimum(c, K)], 1.0) * c / max(1, self.tokens)
        return np.where(c > 0, share, self.unknown)

    def pairs(self, c: np.ndarray, context: np.ndarray, sums: np.ndarray, of: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(w | v): pair counts, the contexts' counts and sums, each pair's context, and P(w).

        A context whose discounts free nothing gives its backoff one count of its own.
        """
        r = np.arange(1, K + 1)
        total = np.maximum(context, 1)
        taken = (sums[:, :K] @ (self.d2[1:] * r) + sums[:, K]) / total
        lower = sums[:, K + 1 : 2 * K + 1] @ self.words(r) + self.scale * sums[:, 2 * K + 1] / max(1, self.tokens)
        none = 1 - taken < 1e-12
        scale = np.where(none, total / (total + 1), 1.0)
        weight = np.where(none, 1 / (total + 1), 1 - taken) / np.maximum(1 - lower, 1e-300)
        weight = np.where(context > 0, weight, 1.0)
        seen = scale[of] * np.where(c <= K, self.d2[np.minimum(c, K)], 1.0) * c / total[of]
        return np.where(c > 0, seen, weight[of] * word)


def scored(model: Model, buckets: int, key: pa.DataType):
    def run(t: pa.Table) -> pa.Table:
        c = Local(t)
        pairs, of, _ = c.pairs()
        order, bucket = c.dealt(pairs, buckets, model.hot)
        v, w = np.divmod(pairs[order], c.n)
        kinds, of_bucket = t["kind"].to_pylist(), t["bucket"].to_pylist()
        answers = {b: i for i, (k, b) in enumerate(zip(kinds, of_bucket, strict=True)) if k == PAIRS}
        p = np.empty(len(pairs))
        cuts = [*runs(bucket).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            count, *sums = load(t["data"][answers[int(bucket[a])]].as_py())
            sums = np.array(sums, dtype=np.int64).T.reshape(-1, SUMS)
            first = runs(v[a:b])
            contexts = v[a:b][first]
            often = c.count[contexts] > model.hot
            if often.any():
                sums[often] = model.sums[np.searchsorted(model.often, c.gid[contexts[often]])]
            which = np.repeat(np.arange(len(first)), np.diff([*first, b - a]))
            p[order[a:b]] = model.pairs(count.astype(np.int64), c.count[contexts], sums, which, model.words(c.count[w[a:b]]))
        starts = np.cumsum(c.sizes) - c.sizes
        log = lambda x: np.log10(np.minimum(x, 1.0))
        score = np.add.reduceat(log(p)[of], starts)
        base = np.log10((c.count + 1) / (model.tokens + model.types + 1))
        return pa.table({
            "key": pa.array(c.keys, key), "n_tokens": pa.array(c.sizes), "n_known": pa.array(np.add.reduceat((c.count[c.ids] > 0).astype(np.int64), starts)),
            "base_score": pa.array(np.add.reduceat(base[c.ids], starts)), "score": pa.array(score),
        })

    return run


def score(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; ``train`` says which rows to learn from."""
    kind = df.schema[key].dataType
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-size // BUCKET_BYTES))
    read = saved(chunks(docs, buckets))
    known = saved(read.where(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(counted(buckets), ROW))
    sizes = [pickle.loads(r["data"]) for r in known.where(F.col("kind") == SIZES).collect()]
    tokens, types = sum(s[0] for s in sizes), sum(s[1] for s in sizes)
    words = [sum(s[2][r] for s in sizes) for r in range(K + 1)]
    hot = int(max(tokens / (4 * buckets), tokens * LEAST_SHARE))
    local = read.where(F.col("kind") == STATE).unionByName(known.where(F.col("kind") == KNOWN))
    asked = local.groupBy("chunk").applyInArrow(asked_pairs(buckets, hot), ROW)
    answered = saved(asked.groupBy("bucket").applyInArrow(summed_pairs(hot), ROW))
    pairs, often = [0] * (K + 1), {}
    for r in answered.where(F.col("kind").isin(SIZES, HOT)).select("kind", "data").collect():
        got = pickle.loads(r["data"])
        if r["kind"] == SIZES:
            pairs = [a + b for a, b in zip(pairs, got, strict=True)]
        else:
            for v, sums in got.items():
                often[v] = [a + b for a, b in zip(often.get(v, [0] * SUMS), sums, strict=True)]
    model = Model(tokens, types, words, pairs, often, hot)
    schema = T.StructType([T.StructField("key", kind), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])
    every = local.unionByName(answered.where(F.col("kind") == PAIRS))
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    out = every.groupBy("chunk").applyInArrow(scored(model, buckets, arrow), schema)
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
