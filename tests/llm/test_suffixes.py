"""Removal of repeated strings against a dictionary of all of them."""

import random

import numpy as np
import pytest
import xxhash

from orderflow.llm import suffixes
from orderflow.llm.suffixes import Transforms, first_starts, without_repeats

SCHEMA = "doc_id long, text string, spans string, h long, id int"


def plain(rows, length=100):
    """What is left and the spans of each (doc_id, text), in any order of equal rows."""
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t, 42)).astype(np.int64)) if t is not None else 42
    order = sorted({(r[0] is None, r[0] or 0, signed(None if r[1] is None else r[1].encode()), r[0], r[1]) for r in rows}, key=lambda r: r[:3])
    seen, out = set(), {}
    for *_, doc, text in order:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
        out[doc, text] = bytes(np.frombuffer(b, np.uint8)[~gone]), list(zip(edge[::2], edge[1::2], strict=True))
    return out


def got(spark, rows, length=100, splits=5):
    df = without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(splits), length)
    return [((r["doc_id"], r["text"]), (bytes(r["left"]), [tuple(s) for s in r[-2]]), r["h"]) for r in df.collect()]


def check(spark, rows, length=100, splits=5):
    found = got(spark, rows, length, splits)
    want = plain(rows, length)
    assert len(found) == len(rows) and all(want[k] == v for k, v, _ in found)
    assert sorted(str(r[3]) for r in rows) == sorted(str(h) for *_, h in found)


def made(rng, n):
    passages = ["".join(rng.choice("abcé \0") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 150))), rng.choice("xy") * rng.randint(1, 260)]) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice(["".join(parts), "".join(parts), None, ""]) if i % 9 == 0 else "".join(parts), "clash", i, 1))
    return rows + rows[:3]


@pytest.mark.parametrize(("seed", "length", "splits"), [(0, 100, 5), (1, 100, 1), (2, 70, 8)])
def test_random_passages(spark, seed, length, splits):
    check(spark, made(random.Random(seed), 120), length, splits)


def test_edges(spark):
    assert got(spark, []) == []
    check(spark, [(1, None, "", 1, 1), (2, "", "", 2, 1), (3, "short", "", 3, 1), (3, "short", "", 3, 1), (None, "q" * 99, "", 4, 1)])
    rng = random.Random(3)
    s = "".join(rng.choice("abcdefgh") for _ in range(100))
    # Exactly the length, at the ends of texts, one byte too short, within one text, and behind a null doc_id.
    check(spark, [(None, s, "", 0, 1), (5, "x" + s, "", 1, 1), (6, s + "y", "", 2, 1), (7, s[:99], "", 3, 1), (8, s + s, "", 4, 1)])


def test_long_texts_are_read_in_pieces(spark):
    rng = random.Random(4)
    noise = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    check(spark, [(2, noise, "", 1, 1), (1, noise[524_200:524_500], "", 2, 1), (3, "z" * 600_000, "", 3, 1), (4, noise[1:], "", 4, 1)])


def test_a_crowded_anchor_is_dealt_out(spark):
    """A passage in many texts, each with other neighbours: its runs at the edges are as many as the texts."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i, f"{rng.random():.17f}" * 5 + passage + f"{rng.random():.17f}" * 5, "", i, 1) for i in range(suffixes.CROWD // 150)]
    found = got(spark, rows[:16_000])
    want = plain(rows[:16_000])
    assert all(want[k] == v for k, v, _ in found)


@pytest.mark.parametrize("seed", range(4))
def test_merged_transforms_are_sorted(seed, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 300)
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(20, 180))) for _ in range(40)] + [b"a" * 150] * 2
    t = Transforms(strings, 100)
    assert t.shard.max() > 5
    places, block = t.merged()
    assert sorted(places.tolist()) == np.flatnonzero(t.left >= 100).tolist()
    whole = [(b, strings[t.string[p]][t.offset[p] : t.offset[p] + 100]) for b, p in zip(block.tolist(), places, strict=True)]
    assert len({b for b, _ in whole}) == len({s for _, s in whole}) == len(set(whole))
    assert [b for b, _ in whole] == sorted(b for b, _ in whole)
    place = np.arange(len(strings)) << 32
    first = {}
    for i, s in enumerate(strings):
        for o in range(len(s) - 99):
            first.setdefault(s[o : o + 100], (i, o))
    assert list(zip(*(x.tolist() for x in first_starts(strings, place, 100)), strict=True)) == sorted(first.values())
