"""Collocations against counting all phrases in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orderflow.llm import phrases

SCHEMA = "doc_id long, text string, lang string, h long, shard int, n string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support, best, covered=50):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        many = {p: v for p, v in c.items() if len(p) > 1 and v >= support}
        for p, a in many.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= covered * a for q, b in many.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def made(rng, docs):
    words = ["The", "of", "é", "wörd", "x1", "Ab", "q", "zz", "Émile"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(docs)]
    return [(i, rng.choice([t, t, t, None, "new york city " * 3]), rng.choice(["en", "fr", None, "und"]), i, i, "clash") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "support", "best", "splits"), [(0, 10, 2000, 5), (1, 10, 7, 1), (2, 1, 2000, 4), (3, 4, 40, 9)])
def test_random_texts(spark, seed, support, best, splits):
    rows = made(random.Random(seed), 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(splits)
    got = [tuple(r) for r in phrases.collocations(df, support, best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == plain(rows, support, best) and got


def test_a_phrase_that_just_reaches_the_support(spark):
    """Ten occurrences, dealt over the splits in any way, are found; nine are not."""
    rows = [(i, "just so", "en", 0, 0, "") for i in range(10)] + [(i, "not so", "en", 0, 0, "") for i in range(9)]
    for splits in (2, 3, 8, 19):
        got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(splits)).collect()
        assert [(r["phrase"], r["a"], r["l"], r["r"], r["n"]) for r in got] == [("just so", 10, 10, 19, 38)]


def test_edges(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, 0, 0, ""), (2, "", "en", 0, 0, ""), (3, " \t.,!", "en", 0, 0, ""), (3, "a b " * 200_000, "fr", 0, 0, "")]
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == plain(rows, 10, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(3 * 10**15, 3 * 10**15, 3 * 10**15), (123_456_789_012, 987_654_321_987, 123_456_789_013), (10, 3_000_000_000, 4_000_000_000), (7, 7, 49)]
    got = [r[0] for r in spark.createDataFrame(cases, "a long, l long, r long").select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in cases]
