"""Language identification by compression.

For each language a raw-content zstandard dictionary is built from sample texts.
A text is cut into pieces, each piece is compressed with each dictionary, and the
language with the fewest bytes over all pieces wins. Pieces keep the dictionary's
effect alike in short and long texts; every piece of the text counts. A short piece
gives few bytes and so a coarse measure: it is compressed at ``SHORT_LEVELS``, too,
and the fewest bytes count.

The dictionaries come from a bounded sample of labelled rows: for each of the
``MAX_LANGUAGES`` labels with most rows one document for each of ``SAMPLE_DOCS`` hash
buckets, ``SAMPLE_CHARS`` characters of each. So what is sent to the tasks stays under
MAX_LANGUAGES * SAMPLE_DOCS * SAMPLE_CHARS characters, however many labels there are;
labels beyond them, noise as a rule, are not learned.

Defined cases: null texts and texts without a letter (numerals are none) get ``und``,
score 0 and are rejected; without any labelled row every text does. Rows with null
language are not learned from. Ties go to the language first in order. Repeated rows
are judged alike. Other columns pass through; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 48, 1000, 256
#: Characters of a piece, compression level, and the least share of bytes by which the best must beat the second.
PIECE, LEVEL, MARGIN = 2000, 9, 0.005
#: Bytes below which a piece is short, and the levels at which such pieces are compressed as well.
SHORT, SHORT_LEVELS = 200, (3, 12)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NOISE = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> str:
    """Lower-cased words of letters."""
    return _NOISE.sub(" ", text.lower())


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary's bytes for each language; ``labelled`` holds the rows to learn from."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    hashed = rows.select("lang", F.xxhash64(F.col("key").cast("string")).alias("h"), F.rlike("text", F.lit(r"\p{L}")).alias("ok")).where("ok")
    buckets = hashed.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("bucket")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    most = buckets.groupBy("lang").agg(F.sum("n").alias("n"), F.collect_list("h").alias("h")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    picked = most.select("lang", F.explode("h").alias("h"))
    first = rows.withColumn("h", F.xxhash64(F.col("key").cast("string"))).join(F.broadcast(picked), ["lang", "h"])
    texts = first.groupBy("lang", "h").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).orderBy("lang", "h").collect()
    return {x: " ".join(plain(r["text"]) for r in texts if r["lang"] == x).encode() for x in sorted({r["lang"] for r in texts})}


_compressors: dict = {}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, list[zstandard.ZstdCompressor]]]:
    """For each language a compressor of each level, that of LEVEL first."""
    key = hash(tuple(dictionaries.items()))
    if key not in _compressors:
        _compressors.clear()
        made = []
        for lang, data in dictionaries.items():
            each = []
            for level in (LEVEL, *SHORT_LEVELS):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                each.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False))
            made.append((lang, each))
        _compressors[key] = made
    return _compressors[key]


def identify(text: str | None, made: list) -> tuple[str, float]:
    """The best language and its margin over the second, as a share of the second's bytes."""
    if not text or not made or not _LETTER.search(text):
        return UNKNOWN, 0.0
    p = plain(text)
    pieces = [p[i : i + PIECE].encode() for i in range(0, len(p), PIECE)]
    size = lambda x, each: min(len(c.compress(x)) for c in (each if len(x) < SHORT else each[:1]))
    sizes = sorted((sum(size(x, each) for x in pieces), k) for k, (_, each) in enumerate(made))
    if len(sizes) == 1:
        return made[0][0], 1.0
    return made[sizes[0][1]][0], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``lang_rejected``."""
    outs = ("lang_pred", "score", "lang_rejected")
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in outs or c == text])
    t = fresh(df, "text")
    given = df.withColumn(t, F.col(f"`{text}`"))
    rest = [f for f in df.schema.fields if f.name.lower() not in outs]
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors(dictionaries)
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            found = [identify(x, made) for x in b.column(at[t]).to_pylist()]
            langs, scores = [x for x, _ in found], [s for _, s in found]
            no = [x == UNKNOWN or s < margin for x, s in found]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(at[f.name]) for f in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(no, pa.bool_())], names=schema.names
            )

    return given.mapInArrow(run, schema)
