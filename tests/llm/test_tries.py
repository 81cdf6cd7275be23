"""The conversation trie against one built conversation by conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderflow.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, k1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[x] for x in below), saved, sha))
    return sorted(map(str, out))


def grouped(rows):
    convs = defaultdict(list)
    for c, _, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            convs[c].append((role or "", text or ""))
    return convs


def got(spark, rows, splice=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if splice:
        made = tries.spliced(df, F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, 5)
    else:
        own = tries.numbered(df)
        made = own, own.select("conv_id").distinct()
    return sorted(str(tuple(r)) for r in tries.trie(*made).select(*COLUMNS).collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    monkeypatch.setattr(tries, "BAND", 3)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 60):
        rows += [(c, t, rng.choice(["a", "b", None]), rng.choice(["x", "yy", None, ""]), "clash") for t in range(rng.choice([1, 2, 3, 9]))]
    rows += [(100, 50 + t, "a", "x", None) for t in range(40)]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(grouped(rows))
    convs = grouped(rows)
    rebuilt = {c: convs.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + turns[h:] for c, turns in convs.items()}
    assert got(spark, rows, True) == plain(rebuilt)


def test_edges(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "a", "x", None)]) == []
    # Without a source all turns of a short conversation may go; it still is a member of the root and ends there.
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert got(spark, [(c, 1, "a", "x", None), (c, 2, "a", "y", None)], True) == plain({c: []})
    # Unnumbered turns come first; equal rows are turns of their own; an accent is one code point.
    rows = [(1, None, "a", "é", None), (1, 1, None, None, None), (1, 1, None, None, None), (2, 0, "a", "é", None), (3, 5, "a", "é" * 5000, None)]
    assert got(spark, rows) == plain(grouped(rows))


def test_role_and_text_are_not_joined(spark):
    rows = [(1, 1, "ab", "c", None), (2, 1, "a", "bc", None)]
    assert got(spark, rows) == plain(grouped(rows))
