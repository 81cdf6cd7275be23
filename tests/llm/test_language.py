"""Language identification against the same rules in plain Python: dictionaries, pieces, levels and ties."""

import random
from collections import defaultdict

import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from orderflow.llm import language, simhash

DIR = "/root/testdata/sf0.001"
LETTER, NOISE = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def words(text):
    return NOISE.sub(" ", text.lower())


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def learned(rows):
    """For each label, the first thousand characters of its row of least hash in each of 48 buckets."""
    by = defaultdict(dict)
    count = defaultdict(int)
    for key, text, lang in rows:
        if text is None or lang is None or not LETTER.search(text):
            continue
        h = signed(str(key))
        count[lang] += 1
        bucket = by[lang].setdefault(h % 48, [h, text])
        if h < bucket[0]:
            by[lang][h % 48] = [h, text]
        elif h == bucket[0]:
            bucket[1] = min(bucket[1][:1000], text[:1000])
    kept = sorted(by, key=lambda x: (-count[x], x))[:256]
    return {x: " ".join(words(t[:1000]) for _, t in sorted(by[x].values())).encode() for x in sorted(kept)}


def told(text, dictionaries):
    if not text or not dictionaries or not LETTER.search(text):
        return "und", 0.0
    p, sizes = words(text), []
    pieces = [p[i : i + 2000].encode() for i in range(0, len(p), 2000)]
    for lang, data in dictionaries.items():
        total = 0
        for piece in pieces:
            levels = (9, 3, 12) if len(piece) < 200 else (9,)
            lengths = []
            for level in levels:
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                lengths.append(len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False).compress(piece)))
            total += min(lengths)
        sizes.append((total, lang))
    best = sorted(sizes, key=lambda x: x[0])  # of equals the first label in order stands
    return (best[0][1], 1.0) if len(best) == 1 else (best[0][1], (best[1][0] - best[0][0]) / best[1][0])


@pytest.fixture(scope="module")
def rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang").collect()]
    return [*rows, (9001, None, "en"), (9002, "12 34 !?", "en"), (9003, "some words here", None), (9004, "ein kurzer Satz über nichts", "nds"), (9004, "ein anderer Satz", "nds")]


def test_dictionaries_and_predictions(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.fit(df)
    want = learned(rows)
    assert found == want and list(found) == sorted(found)
    rng = random.Random(0)
    texts = [t for _, t, _ in rows[:25]] + [" ".join(rng.sample((t or "x").split(" "), k=min(len((t or "x").split(" ")), 1 + i % 9))) for i, (_, t, _) in enumerate(rows[:40])]
    texts += [None, "", "7 7", "é", "zz " * 3000, "the " * 500 + "der " * 500]
    out = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), found).orderBy("doc_id").collect()
    for text, r in zip(texts, out, strict=True):
        lang, score = told(text, want)
        assert (r["lang_pred"], r["score"]) == (lang, score), text
        assert r["lang_rejected"] == (lang == "und" or score < language.MARGIN)


def test_ties_and_one_label(spark):
    """Labels with one and the same text compress alike: the first stands, with no margin, and is rejected."""
    same = [(1, "aba cada bra", "b"), (1, "aba cada bra", "a")]
    found = language.fit(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "bra cada aba")], "doc_id long, text string")
    assert [(r["lang_pred"], r["score"], r["lang_rejected"]) for r in language.predict(df, found).collect()] == [("a", 0.0, True)]
    assert told("bra cada aba", learned(same)) == ("a", 0.0)
    one = language.fit(spark.createDataFrame(same[:1], "doc_id long, text string, lang string"))
    assert [(r["lang_pred"], r["score"]) for r in language.predict(df, one).collect()] == [("b", 1.0)]


def test_a_hub_can_be_split(spark, monkeypatch):
    """In the star steps both sides of each join are read from tables: no aggregate stands between shuffle and join."""
    plans = []
    before = simhash.saved

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return before(df)

    monkeypatch.setattr(simhash, "saved", seen)
    edges = spark.range(1, 400).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(500, 501), (501, 502)], "a long, b long"))
    out = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert out == {**{i: 0 for i in range(1, 400)}, 501: 500, 502: 500}
    joins = [p for p in plans if "Join" in p]
    assert joins
    for p in joins:
        below = p[p.index("Join") :]
        assert "HashAggregate" not in below
