"""One query for each operator, over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, neighbours, ngrams, packing, phrases, quality, sharding, simhash, suffixes, transcripts, tries, urls
from .common import table


def remainder(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.assign(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


URL_RULES = [
    urls.UrlRule("org", "/", "allow"),
    urls.UrlRule("example.org", "/es/", "block"),
    urls.UrlRule("example.org", "/en/1", "block"),
    urls.UrlRule("com", "/fr/", "allow"),
    urls.UrlRule("com", "/de/", "block"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdicts are the labels from which the templates of other pages are judged."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.fit(docs.where(F.coalesce(remainder(4), F.lit(-1)) != 2))
    judged = language.predict(docs.select("doc_id", "text"), learned)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.col("lang_rejected").alias("rejected"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    scored = ngrams.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from conversations whose crc32(conv_id as text) mod 5 is not 2; predicts the roles of all from their texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fold = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5
    held_out = F.coalesce(fold == 2, F.lit(False))
    model = transcripts.fit(turns.where(~held_out))
    parsed = transcripts.parse(turns, model).withColumnsRenamed({"key": "conv_id", "part": "turn"})
    return parsed.select("conv_id", "turn", held_out.alias("held_out"), "role_pred", "turn_text", F.size("turns").cast("long").alias("n_turns"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("key") % 20 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("measures")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *(m[c].alias(c) for c in base),
        failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    decoded = bpe.decode(encoded, path, pattern)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return tries.trie(*tries.spliced(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 100, heads, 5))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("left")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("left", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_url_filters": op2_url_filters,
    "op3_language_id": op3_language_id,
    "op4_language_model": op4_language_model,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_neighbours": op6_neighbours,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repeats": op13_repeats,
}


def quality_sql() -> str:
    """The quality rules in SQL, from the same table of thresholds."""
    ratios = {
        "mean_word_length": ("word_chars", "n_words"),
        "symbol_ratio": ("n_symbols", "word_chars"),
        "repeat_word_ratio": ("n_repeat_words", "n_words"),
        "stop_word_ratio": ("stops", "n_words"),
        "number_word_ratio": ("numbers", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ("bullets", "n_lines"),
        "ellipsis_line_ratio": ("ellipses", "n_lines"),
    }
    tests = []
    for r in quality.RULES:
        a, b = ratios.get(r.measure, (r.measure, None))
        value = f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END)" if b else a
        bad = " OR ".join([f"{value} < {r.low}"] * (r.low is not None) + [f"{value} > {r.high}"] * (r.high is not None))
        tests.append(f"CASE WHEN {bad} THEN '{r.measure}' END")
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ 	-
]+') AS l FROM d)),
g AS (SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
wc AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (WHERE word IN ({stops})) AS stops,
  count(*) FILTER (WHERE word >= '0' AND word < ':') AS numbers FROM w GROUP BY 1),
x AS (SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]')),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE regexp_matches(line, '^ *[*•-]')) AS bullets,
  count(*) FILTER (WHERE regexp_matches(line, '([.][.][.]|…) *$')) AS ellipses FROM x GROUP BY 1),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stops, 0) AS stops, coalesce(numbers, 0) AS numbers,
  coalesce(n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses
  FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN lc USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(tests)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f"""


PHRASE_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
f AS (SELECT * FROM g WHERE f >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT a.lang, a.k, a.phrase, a.f AS a, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a.f * a.f // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, cut
  FROM (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1) a
  JOIN g l ON l.lang = a.lang AND l.phrase = array_to_string(a.ws[1:cut], ' ') JOIN g r ON r.lang = a.lang AND r.phrase = array_to_string(a.ws[cut + 1:], ' ')),
s AS (SELECT lang, phrase, a, l, r, score, k FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM c) WHERE o = 1),
x AS (SELECT lang, phrase, max(f) AS longest FROM (SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k = 3)) GROUP BY 1, 2),
d AS (SELECT s.* FROM s LEFT JOIN x ON s.k = 2 AND x.lang = s.lang AND x.phrase = s.phrase WHERE longest IS NULL OR 100 * longest < 50 * a),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d JOIN n USING (lang))
SELECT * FROM o WHERE rank <= 2000"""

#: Bytes as two hexadecimal digits each, since SQL cuts text by characters.
REPEAT_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(CAST(length(x) // 2 - 99 AS BIGINT))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
e AS (SELECT doc_id, i, CASE WHEN i <= max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e) GROUP BY doc_id, g),
h AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM g GROUP BY 1),
k AS (SELECT d.doc_id, x, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, list_concat([0], coalesce(stops, [])) AS froms, list_concat(coalesce(starts, []), [length(x) // 2]) AS tos FROM d LEFT JOIN h USING (doc_id))
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda j: substr(x, CAST(2 * froms[j] + 1 AS BIGINT), CAST(2 * (tos[j] - froms[j]) AS BIGINT))), ''))) AS kept_sha256 FROM k"""

#: CRC-32 of a decimal number, byte by byte from the table that its polynomial gives.
CRC_SQL = """tab AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i))"""
TRIE_SQL = f"""WITH {CRC_SQL},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS source, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: ascii(d))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), tab),
m AS (SELECT c.*, (SELECT count(*) FROM o WHERE o.conv_id = c.source AND o.place <= c.h) AS m FROM c),
r AS (SELECT m.conv_id, o.place, turn, chars FROM m JOIN o ON o.conv_id = m.source AND o.place <= m.h
  UNION ALL SELECT m.conv_id, o.place - m.h + m.m, turn, chars FROM m JOIN o ON o.conv_id = m.conv_id AND o.place > m.h),
p AS (SELECT conv_id, place, chars, list(turn) OVER (PARTITION BY conv_id ORDER BY place) AS path, place = count(*) OVER (PARTITION BY conv_id) AS ended FROM r
  UNION ALL SELECT conv_id, 0, 0, [], NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = m.conv_id) FROM m),
n AS (SELECT path, place AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:i] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS i FROM u) GROUP BY 1)
SELECT u.conv_id, u.depth, q.conv_id AS parent_conv_id, u.n_convs, u.n_children, n_leaves, saved_tokens, u.ends_sha256 FROM u JOIN s ON u.path = s.path LEFT JOIN n q ON u.depth > 0 AND q.path = u.path[1:u.depth - 1]"""

ORACLE_SQL: dict[str, str] = {"op9_quality_rules": quality_sql(), "op11_collocations": PHRASE_SQL, "op12_prefix_trie": TRIE_SQL, "op13_repeats": REPEAT_SQL}
