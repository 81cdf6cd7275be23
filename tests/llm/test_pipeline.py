"""The pipeline's stages, each against SQL or plain Python on its own input, and on repeated and null rows."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from orderflow.llm import language, queries
from tests.llm.test_language import learned, told

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of each stage."""
    base = tmp_path_factory.mktemp("stages")
    before, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, DIR).write.parquet(f"file://{base}/{name}")
        after = spark.read.parquet(f"file://{base}/{name}")
        out[name] = before, after
        before = after
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_quality_rules_keep_what_sql_keeps(stages):
    before, after = stages["quality_rules"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({queries.quality_sql()}) where failed_rules = ''").fetchall()}
    assert rows(after) == [r for r in rows(before) if r[0] in kept] and 0 < len(kept) < before.count()


def test_languages_are_told_as_in_plain_python(stages):
    before, after = stages["language_id"]
    dictionaries = learned([(r["doc_id"], r["text"], r["lang"]) for r in before.collect()])
    kept = []
    for r in rows(before):
        lang, score = told(r[1], dictionaries)
        if lang != "und" and score >= language.MARGIN:
            kept.append(r)
    assert rows(after) == kept


def test_packing_holds_every_id_once(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in before.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in after.collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for doc, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[doc])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_repeated_and_null_rows(spark, stages):
    """Rows that the rules reject go, repeated ones each; of near copies one row stays; packing takes every row."""
    good = [r for r in rows(stages["language_id"][1])][:3]
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "short", "en", "s", 5)]
    df = spark.createDataFrame([*good, *good, *odd, *odd], DOCS)
    functions = dict(corpus_pipeline.STAGES)
    kept = functions["quality_rules"](spark, df, DIR)
    assert rows(kept) == sorted([*good, *good])
    told_ = functions["language_id"](spark, df, DIR)
    assert set(rows(told_)) <= {*good, odd[2]} and all(rows(told_).count(r) == 2 for r in set(rows(told_)))
    alone = functions["simhash_near_dedup"](spark, df.where("doc_id is not null"), DIR)
    assert len(alone.collect()) == len({r[0] for r in alone.collect()}) and {g[0] for g in good} >= {r[0] for r in alone.collect()} - {900, 901, 902}
    packed = functions["packing"](spark, df, DIR).groupBy("doc_id").sum("length").collect()
    single = {r["doc_id"]: r["doc_tokens"] for r in functions["packing"](spark, spark.createDataFrame([*good, *odd], DOCS), DIR).collect()}
    assert {r["doc_id"]: r["sum(length)"] for r in packed} == {k: 2 * v for k, v in single.items()} and single[900] == single[901] == 1


def test_stages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).collect() == []
