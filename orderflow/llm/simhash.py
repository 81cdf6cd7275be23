"""Near copies by SimHash and vantage-point trees.

A fingerprint has 64 bits from the hashes of all word shingles. Two fingerprints
link if they differ in at most ``radius`` bits; then of ``blocks`` blocks of bits one
differs in at most ``radius // blocks``. So there is a vantage-point tree for each
block. A tree's inner nodes hold a vantage point and a radius; they come from a
bounded sample of fingerprints, and every fingerprint descends to the leaf of its
own, its shard. By the triangle inequality a linked pair that a node separates lies
within the block's radius of the node's boundary: fingerprints there also visit the
other side. Leaves compare their own fingerprints with all that are in them, exactly
over all 64 bits.

Exact copies share a fingerprint and are compared once. A leaf with many
fingerprints is dealt in blocks of its own rows times chunks of all its rows, so a
task holds at most HOME + MEMBERS of them whatever the leaf's size. Where a task finds
more links than it has fingerprints, it returns a spanning forest of them, which has the
same components, so a dense group gives no more links than it has members.

``similar_copies`` links texts whose five-word shingle sets have a Jaccard of ``SIMILAR``
or more. At that similarity 64 bits are too few: they differ in some ten bits, and trees
of so wide a radius prune nothing. A shingle set therefore has a longer fingerprint, cut
into blocks with a tree each, and a pair that agrees in a block meets in a leaf of its
tree. At Jaccard j it differs in a bit with a chance of p = acos(2j / (1 + j)) / pi, and
so agrees in a block of b bits with (1 - p)^b; ``layout`` takes as many bits as keep a
leaf small, which grow with the logarithm of the rows, and as many blocks as find
``RECALL`` of the pairs at the least similarity, and more of all above it, at every size.
In a leaf all pairs are compared: candidates differ in at most ``WITHIN`` of 256 bits,
which one pair in 10,000 at the least similarity exceeds, and their sizes must allow that
Jaccard. A forest of the candidates tells only the clusters. In each cluster whole
shingle sets are compared, in blocks of bounded size, so no pair hangs on a link that is
rejected: all pairs in a cluster of one block; in a larger one all sets with one block,
and then all pairs but those within the largest component found so far and those too
different in size. What is left out can't change a component.

Defined cases: a null or empty text has fingerprint zero and links like any other (an
empty shingle set only equals itself); repeated rows belong to the same component; a null
key never names a component unless it has no other; an empty table gives an empty table.
Only the key and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, may_be_in, saved

SHINGLE, RADIUS, BLOCKS, SEED = 3, 3, 2, 42
#: Similar copies share SIMILAR (as a fraction) of their sets of shingles of SET_SHINGLE words.
SIMILAR, SET_SHINGLE = (4, 5), 5
#: Share of the pairs of that similarity that are to agree in a block, bits of a block at least, and rows wanted for each of its values at most.
RECALL, SET_BITS, SET_LEAF = 0.975, 12, 512
#: Words of a fingerprint that are compared, bits in which candidates may differ in them, and in half of them.
WORDS, WITHIN, HALF = 4, 60, 40
#: Sets and hashes wanted in a block of a cluster; a task compares two blocks.
SETS, HASHES = 512, 1 << 20
#: Sizes of one band: a bit more than a link may differ by, so that rounding can't part linked sets by two bands.
BAND = 1.01 * SIMILAR[1] / SIMILAR[0]
#: Fingerprints sampled to place the trees' nodes: SAMPLE at least, one in SAMPLE_SHARE, MOST at most.
SAMPLE, SAMPLE_SHARE, MOST = 1 << 14, 1000, 1 << 20
#: Fingerprints wanted in a leaf, and of a task's own and in all.
LEAF, HOME, MEMBERS = 1500, 4096, 1 << 15
#: Pairs that a task holds before it reduces them to a spanning forest.
PAIRS = 100_000


def hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words; of all words if there are fewer."""
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64, count=len(words) - shingle + 1)


def shingles(text: str | None) -> np.ndarray:
    """The set of the text's five-word shingles, as sorted hashes."""
    return np.unique(hashes((text or "").encode().lower().split(), SET_SHINGLE))


def named(found: np.ndarray) -> int:
    """The node of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def ones(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set, from counts of their bytes."""
    seen = np.zeros(8 * 256, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        by_byte = h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8) + _COLUMN
        seen += np.bincount(by_byte.ravel(), minlength=8 * 256)
    return (seen.reshape(8, 256) @ _BITS).ravel()


#: First count of each byte, and the bits of each byte value.
_COLUMN = (np.arange(8) * 256).astype(np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values; no words: 0."""
    h = hashes((text or "").encode().lower().split(), shingle)
    n = len(h)
    if n < 2:
        return int(h[0]) if n else 0
    return int(np.packbits(2 * ones(h) > n, bitorder="little").view(np.uint64)[0])


def layout(n: int) -> tuple[int, int]:
    """Blocks and bits of each in the fingerprints of ``n`` shingle sets."""
    j = SIMILAR[0] / SIMILAR[1]
    p = math.acos(2 * j / (1 + j)) / math.pi
    bits = max(SET_BITS, math.ceil(math.log2(max(1, n) / (4 * SET_LEAF))))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - p) ** bits)), bits


def set_print(found: np.ndarray, words: int) -> bytes:
    """SimHash of a shingle set over ``words`` 64-bit words mixed from each hash."""
    bits = []
    for word in range(words):
        x = found + np.uint64((0x9E3779B97F4A7C15 * (word + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits.append(2 * ones(x ^ (x >> np.uint64(31))) > len(found))
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key and ``fp`` (the fingerprint as a signed long)."""
    given = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([given.schema["key"], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=schema.names)

    return given.mapInArrow(run, schema)


def shingle_sets(df: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``node``, ``size`` and ``print`` of the text's shingle set."""
    given = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([given.schema["key"], T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("print", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(named(x), len(x), set_print(x, words)) for x in map(shingles, b.column(1).to_pylist())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return given.mapInArrow(run, schema)


def block(fps: np.ndarray, tree: int, blocks: int) -> np.ndarray:
    """The bits of a fingerprint that a tree looks at."""
    low, high = 64 * tree // blocks, 64 * (tree + 1) // blocks
    return ((fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.uint64)


def set_words(prints: list[bytes], words: int) -> np.ndarray:
    """A row for each fingerprint of a shingle set, a column for each word."""
    return np.frombuffer(b"".join(prints), dtype="<u8").reshape(-1, words) if prints else np.zeros((0, words), dtype=np.uint64)


def set_blocks(x: np.ndarray, blocks: int, bits: int) -> list[np.ndarray]:
    """The values of each block of the fingerprints ``x``, rows of words."""
    out, mask = [], np.uint64((1 << bits) - 1)
    for low in range(0, blocks * bits, bits):
        i, at = divmod(low, 64)
        value = x[:, i] >> np.uint64(at)
        if at + bits > 64:
            value = value | (x[:, i + 1] << np.uint64(64 - at))
        out.append(value & mask)
    return out


def grow(samples: list[np.ndarray], leaves: int, radius: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A tree for each block's sample: vantage point, boundary and first child of each node (0: a leaf)."""
    trees, rng = [], np.random.default_rng(0)
    for sample in samples:
        point, bound, child = [0], [0], [0]
        queue = [(0, np.unique(sample), leaves)]
        while queue:
            node, x, want = queue.pop()
            if want < 2 or len(x) < 8:
                continue
            best = None
            for v in rng.choice(x, min(6, len(x)), replace=False):
                d = np.bitwise_count(x ^ v)
                mu = int(np.median(d))
                inside = float((d <= mu).mean())
                cost = max(inside, 1 - inside) + float((np.abs(d - mu - 0.5) < radius).mean())
                if 0 < inside < 1 and (best is None or cost < best[0]):
                    best = (cost, v, mu, d <= mu)
            if best is None:
                continue
            point[node], bound[node], child[node] = best[1], best[2], len(point)
            for k, part in enumerate((x[best[3]], x[~best[3]])):
                point.append(0), bound.append(0), child.append(0)
                queue.append((child[node] + k, part, max(1, round(want * len(part) / len(x)))))
        trees.append((np.array(point, dtype=np.uint64), np.array(bound, dtype=np.int16), np.array(child, dtype=np.int32)))
    return trees


def descend(x: np.ndarray, tree: tuple, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, leaf and whether it is the row's own leaf, for every leaf a fingerprint stands in.

    At a node an own row goes to its side; if it is outside and within ``radius`` of
    the boundary it visits the inside, too, where its partners are their own rows. A
    visitor goes to both sides if either may hold a partner.
    """
    point, bound, child = tree
    row, node, own = np.arange(len(x)), np.zeros(len(x), dtype=np.int32), np.ones(len(x), dtype=bool)
    done = []
    while len(row):
        at_leaf = child[node] == 0
        done.append((row[at_leaf], node[at_leaf], own[at_leaf]))
        row, node, own = row[~at_leaf], node[~at_leaf], own[~at_leaf]
        d = np.bitwise_count(x[row] ^ point[node]).astype(np.int16)
        mu, first = bound[node], child[node]
        outside = d > mu
        visit_in = outside & (d - mu <= radius)
        visit_out = ~outside & ~own & (mu - d < radius)
        row = np.concatenate([row, row[visit_in], row[visit_out]])
        node = np.concatenate([first + outside, first[visit_in], first[visit_out] + 1])
        own = np.concatenate([own, np.zeros(int(visit_in.sum() + visit_out.sum()), dtype=bool)])
    return tuple(np.concatenate(p) for p in zip(*done, strict=True))


def near(own: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of different fingerprints; if there are more than fingerprints, a least spanning forest of them.

    Every pair returned is a link. The forest takes the links of fewest bits first.
    """
    every = np.unique(np.concatenate([own, others]))
    step = max(1, (1 << 21) // max(1, len(others)))
    a, b, most = own[:0], own[:0], max(PAIRS, 4 * len(every))
    for k in range(0, len(own), step):
        part = own[k : k + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ others[None, :]) <= radius)
        x, y = part[i], others[j]
        other = x != y
        a, b = np.concatenate([a, x[other]]), np.concatenate([b, y[other]])
        if len(a) > most:
            a, b = spanning(every, a, b)
    return spanning(every, a, b) if len(a) >= len(every) else (a, b)


def candidates(own: tuple, others: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that differ in at most WITHIN bits and whose sizes allow a link, or a spanning forest of them.

    ``own`` and ``others`` hold the fingerprints' first words, the node and the size of each row.
    """
    (x, node, size), (o_x, o_node, o_size) = own, others
    every = np.unique(np.concatenate([node, o_node]))
    at, o_at, label = np.searchsorted(every, node), np.searchsorted(every, o_node), np.arange(len(every))
    step = max(1, (1 << 20) // max(1, len(o_x)))
    a, b, most = node[:0], node[:0], max(PAIRS, 4 * len(every))
    for k in range(0, len(x), step):
        apart = np.bitwise_count(x[k : k + step, None, 0] ^ o_x[None, :, 0]) + np.bitwise_count(x[k : k + step, None, 1] ^ o_x[None, :, 1])
        i, j = np.nonzero(apart <= HALF)
        i += k
        for m in range(0, len(i), 1 << 16):
            p, q = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
            likely = (label[at[p]] != label[o_at[q]]) & (SIMILAR[1] * np.minimum(size[p], o_size[q]) >= SIMILAR[0] * np.maximum(size[p], o_size[q]))
            p, q = p[likely], q[likely]
            found = np.bitwise_count(x[p] ^ o_x[q]).sum(1) <= WITHIN
            a, b = np.concatenate([a, node[p[found]]]), np.concatenate([b, o_node[q[found]]])
            if len(a) > most:
                a, b = spanning(every, a, b)
                label = merged(label, np.searchsorted(every, a), np.searchsorted(every, b))
    return spanning(every, a, b) if len(a) >= len(every) else (a, b)


def spanning(every: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boruvka's forest: in each round every component takes its link of fewest bits to another one."""
    order = np.argsort(np.bitwise_count(a ^ b), kind="stable")
    a, b = a[order], b[order]
    i, j = np.searchsorted(every, a), np.searchsorted(every, b)
    label, kept = np.arange(len(every)), np.zeros(len(a), dtype=bool)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = label[i[open_]], label[j[open_]]
        cross = x != y
        open_, x, y = open_[cross], x[cross], y[cross]
        if not len(open_):
            break
        _, first = np.unique(np.concatenate([x, y]), return_index=True)
        taken = open_[np.unique(first % len(open_))]
        kept[taken] = True
        label = merged(label, i[taken], j[taken])
    return a[kept], b[kept]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component, with links a - b added to the components that ``label`` tells."""
    while True:
        low = np.minimum(label[a], label[b])
        root = np.arange(len(label))
        np.minimum.at(root, label[a], low)
        np.minimum.at(root, label[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        new = root[label]
        if np.array_equal(new, label):
            return label
        label = new


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``radius`` whose components are those of all such pairs.

    ``distinct`` has one row for each fingerprint, in ``fp``.
    """
    reach = radius // blocks

    def compare(t: pa.Table) -> pa.Table:
        fps, own = t["fp"].to_numpy().view(np.uint64), t["own"].to_numpy()
        a, b = near(fps[own > 0], fps[own != 1], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    prints = lambda column: column.to_numpy(zero_copy_only=False).view(np.uint64)
    split = lambda column: [block(prints(column), t, blocks) for t in range(blocks)]
    rows = dealt(distinct.select(F.col("fp").alias("print"), "fp"), ["fp"], "fp", split, reach, LEAF)
    return rows.groupBy("leaf", "i", "j").applyInArrow(compare, "a long, b long")


def candidate_links(distinct: DataFrame, blocks: int, bits: int, words: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes, or a spanning forest of those of a dense task; ``distinct`` is of ``shingle_sets``."""
    kept = [f"w{k}" for k in range(WORDS)]

    def compare(t: pa.Table) -> pa.Table:
        own, x = t["own"].to_numpy(), np.column_stack([t[w].to_numpy() for w in kept]).view(np.uint64)
        columns = x, t["node"].to_numpy().view(np.uint64), t["size"].to_numpy()
        a, b = candidates(tuple(c[own > 0] for c in columns), tuple(c[own != 1] for c in columns))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = set_words(b.column(0).to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[:, k]) for k in range(WORDS))], names=["print", "node", "size", *kept])

    split = lambda column: set_blocks(set_words(column.to_pylist(), words), blocks, bits)
    wide = distinct.select("print", "node", "size").mapInArrow(first, f"print binary, node long, size long, {', '.join(f'{w} long' for w in kept)}")
    rows = dealt(saved(wide), [*kept, "node", "size"], "node", split, 0, SET_LEAF)
    return rows.groupBy("leaf", "i", "j").applyInArrow(compare, "a long, b long")


def dealt(distinct: DataFrame, kept: list[str], name: str, split: Callable, reach: int, wanted: int) -> DataFrame:
    """The rows of every task: the columns ``kept``, leaf, i, j and own (1: own, 0: other, 2: both).

    ``split`` gives each tree's bits of a column of fingerprints, ``print``; ``name`` is
    what tells rows apart, ``reach`` how far over a boundary a row visits, ``wanted``
    the rows of a leaf.
    """
    n = distinct.count()
    size = min(MOST, max(SAMPLE, n // SAMPLE_SHARE))
    sample = distinct.select("print").orderBy(F.xxhash64("print"), "print").limit(size).toArrow()["print"].combine_chunks()
    trees = grow(split(sample), max(1, n // wanted), reach)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = b.select(kept).columns
            for t, bits in enumerate(split(b.column(0))):
                row, leaf, own = descend(bits, trees[t], reach)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in rest), pa.array(leaf.astype(np.int32) * len(trees) + t), pa.array(own)], names=[*kept, "leaf", "home"])

    # Placing a row is cheap, so it is done again rather than written: once for the leaves' sizes, once for the tasks.
    kinds = "".join(f"{c} {distinct.schema[c].dataType.simpleString()}, " for c in kept)
    placed = distinct.select("print", *kept).mapInArrow(place, f"{kinds}leaf int, home boolean")
    # As many rows as the trees have leaves. They are broadcast only if they are few.
    sizes = placed.groupBy("leaf").agg(F.sum(F.col("home").cast("int")).alias("home"), F.count("*").alias("members"))
    sizes = few(sizes.select("leaf", F.ceil(F.col("home") / HOME).cast("int").alias("b"), F.ceil(F.col("members") / MEMBERS).cast("int").alias("c")).where("b > 0"))
    rows = placed.join(sizes, "leaf").withColumn("h", F.xxhash64(name))
    every_own, every_other = F.sequence(F.lit(0), F.col("b") - 1), F.sequence(F.lit(0), F.col("c") - 1)
    mine, chunk = F.pmod("h", F.col("b")).cast("int"), F.pmod(F.shiftright("h", 20), F.col("c")).cast("int")
    as_own = F.transform(every_other, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.when(j == chunk, 2).otherwise(1).alias("own")))
    as_other = F.transform(every_own, lambda i: F.struct(i.alias("i"), chunk.alias("j"), F.lit(0).alias("own")))
    at_home = F.concat(as_own, F.filter(as_other, lambda p: p["i"] != mine))
    return rows.select(*kept, "leaf", F.explode(F.when(F.col("home"), at_home).otherwise(as_other)).alias("p")).select(*kept, "leaf", "p.*")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``edges`` (a, b).

    Large-star and small-star steps over Spark joins, each written to the shared
    folder, until the edges are stars. The least neighbours are written, too: with no
    aggregate between the shuffle and the join, the edges of a hub can be split.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = saved(large)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def similar(t: pa.Table) -> pa.Table:
    """Linked pairs between block i and block j of a cluster; if there are more than sets, a spanning forest of them."""
    node, mine, sets = t["node"].to_numpy().view(np.uint64), t["mine"].to_numpy(), [shingles(x) for x in t["text"].to_pylist()]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    full = np.flatnonzero(size)
    node, mine, size = node[full], mine[full], size[full]
    a, b, every = [node[:0]], [node[:0]], np.unique(node)
    if len(node) > 1:
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts, inside = np.cumsum(size) - size, np.zeros(ids.max() + 1, dtype=bool)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        for x in np.flatnonzero(mine == i):
            mark = ids[starts[x] : starts[x] + size[x]]
            inside[mark] = True
            shared = np.add.reduceat(inside[ids], starts, dtype=np.int64)
            inside[mark] = False
            linked = (sum(SIMILAR) * shared >= SIMILAR[0] * (size[x] + size)) & (mine == j)
            if i == j:
                linked[: x + 1] = False
            a.append(np.full(int(linked.sum()), node[x])), b.append(node[linked])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a) >= len(every):
        a, b = spanning(every, a, b)
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def confirmed(clusters: DataFrame, nodes: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) of nodes of a cluster with a Jaccard of SIMILAR or more, whose components are those of all such pairs.

    ``clusters`` has component for each node but the least of it, ``nodes`` has node,
    size and the least key. The texts are read again for nodes in clusters only.
    """
    least = clusters.select(F.col("component").alias("node"), "component").distinct()
    wanted = saved(clusters.unionByName(least).join(nodes, "node"))
    large = wanted.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum("size") / HASHES)).cast("int").alias("b")).where("b > 1")
    given = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    keys = saved(wanted.select(F.col("least").alias("least_key")).distinct())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes_ = [named(shingles(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), b.column(0)], names=["node", "text"])

    # Rows of one key may have different texts: only the wanted nodes stay, once. Texts are shuffled and not sets, which are larger.
    likely = may_be_in(given, F.col("key"), keys, F.col("least_key"), "likely").where("likely")
    texts = likely.join(keys, F.col("key").eqNullSafe(F.col("least_key")), "left_semi").select("text")
    texts = texts.mapInArrow(read, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))
    large = saved(large)
    placed = wanted.join(few(large), "component", "left").withColumn("b", F.coalesce("b", F.lit(1)))
    placed = placed.select("component", "node", "size", "b", F.pmod(F.xxhash64("node"), F.col("b")).cast("long").alias("mine"))
    rows = texts.join(placed, "node")
    if large.isEmpty():
        return compared(rows, F.col("mine"))
    rows = saved(rows)
    small, big = rows.where("b = 1"), rows.where("b > 1")
    # Every set of a large cluster meets those of its first block.
    meets = big.withColumn("k", F.explode(F.when(F.col("mine") == 0, F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    first = saved(compared(meets, F.col("k")))
    return compared(small, F.col("mine")).unionByName(first).unionByName(compared(*others(big.where("mine > 0"), components(first))))


def compared(rows: DataFrame, other: Column) -> DataFrame:
    """The linked pairs (a, b) of the blocks ``mine`` and ``other`` of each component."""
    pairs = rows.select("component", F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), "mine", "node", "text")
    return pairs.groupBy("component", "i", "j").applyInArrow(similar, "a long, b long")


def others(big: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """The rows of large clusters for the pairs that are still open, and the block each is to meet.

    ``found`` has the components so far. Sets of a cluster's largest component needn't meet
    one another, nor do sets whose sizes alone rule a link out: sizes come in bands
    so wide that a link never skips one. So a cluster that is one component costs no more
    than its rows, one with few others their number times its rows.
    """
    found = found.select("node", F.col("component").alias("part"))
    big = saved(big.join(found, "node", "left").select("component", "node", "size", "text", F.coalesce("part", "node").alias("part")))
    parts = big.groupBy("component", "part").agg(F.count("*").alias("n"))
    main = few(parts.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("main")))
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(BAND))
    # A cell is a band of the largest component (odd) or of all others (even).
    celled = big.join(main, "component").withColumn("cell", 2 * band + (F.col("part") == F.col("main")).cast("long"))
    blocks = F.ceil(F.greatest(F.count("*") / SETS, F.sum("size") / HASHES))
    cells = few(celled.groupBy("component", "cell").agg(blocks.alias("c")))
    number = lambda cell, block: F.shiftleft(cell, 32) + block
    mine = celled.join(cells, ["component", "cell"]).withColumn("mine", number(F.col("cell"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("c")))).drop("c")
    odd = F.col("cell") % 2
    evens = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.col("cell") - odd + 2 * d)
    to = F.when(odd == 1, evens).otherwise(F.concat(evens, F.transform(evens, lambda c: c + 1)))
    met = mine.withColumn("to", F.explode(to)).join(cells.withColumnRenamed("cell", "to"), ["component", "to"])
    return met.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))), number(F.col("to"), F.col("k"))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """key, ``fp`` and ``component_id`` (the least key reachable over links) of each row."""
    prints = saved(fingerprints(df, key, text, shingle))
    nodes = saved(prints.groupBy("fp").agg(F.min("key").alias("least")))
    of = classes(nodes, "fp", components(links(nodes, radius, blocks)))
    return prints.join(of, "fp").select(F.col("key").alias(key), "fp", "component_id")


def similar_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``component_id`` (the least key reachable over texts of a Jaccard of SIMILAR or more) and ``alone`` (no other row is in the component) of each row."""
    blocks, bits = layout(df.count())
    words = max(WORDS, -(-blocks * bits // 64))
    found = saved(shingle_sets(df, words, key, text))
    nodes = saved(found.groupBy("node").agg(F.min("key").alias("least"), F.first("size").alias("size"), F.first("print").alias("print")))
    clusters = components(candidate_links(nodes, blocks, bits, words))
    edges = confirmed(clusters, nodes.select("node", "least", "size"), df, key, text)
    of = classes(nodes.select("node", "least"), "node", components(edges))
    rows = found.groupBy("node").agg(F.count("*").alias("rows"))
    of = of.join(rows, "node")
    alone = of.groupBy("component").agg((F.sum("rows") == 1).alias("alone"))
    of = of.join(alone, "component").select("node", "component_id", "alone")
    return saved(found.select("key", "node").join(of, "node").select(F.col("key").alias(key), "component_id", "alone"))


def classes(nodes: DataFrame, node: str, found: DataFrame) -> DataFrame:
    """``node`` and the least key of its component; ``nodes`` has node and least, ``found`` is of ``components``.

    Both sides are written: with no aggregate between the shuffle and the join, a class
    with many nodes can be split.
    """
    found = found.withColumnRenamed("node", "of")
    classed = saved(nodes.join(found, nodes[node] == found["of"], "left").select(node, "least", F.coalesce("component", node).alias("class")))
    named_ = saved(classed.groupBy("class").agg(F.min("least").alias("component_id")))
    return saved(classed.join(named_, "class").select(node, F.col("class").alias("component"), "component_id"))
