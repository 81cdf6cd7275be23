"""The corpus operators on small rows: brute force, round trips and the defined edge cases."""

import bisect
import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orderflow.llm import bpe, common, language, neighbours, ngrams, packing, quality, queries, sharding, simhash, transcripts, urls

DIR = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ODD = [None, "", " \n\t ", "one", "ÀB c\x0bD\x1ce  f", "a b c a b c a b c " * 30, "x" * 5000, "the same line\n" * 9, "日本語 テキスト 😀 " * 7, "# $ % & | < > *" * 9, "word " * 3000]


# Sharding


def test_shards_are_near_equal_and_slots_gapless(spark):
    out = queries.op1_sharding(spark, "/root/testdata/sf0.01").toPandas()
    sums = out.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"), different=("slot", "nunique"))
    assert len(sums) == 24 and (sums.top + 1 == sums.n).all() and (sums.different == sums.n).all()
    assert sums.b.max() - sums.b.min() < 0.01 * sums.b.mean() and len(out) == 1000


def test_a_group_of_copies_with_a_third_of_all_rows_is_subdivided(spark):
    df = docs(spark, ["copy of one text"] * 400 + [f"text {i}" for i in range(800)] + [None] * 3)
    out = sharding.assign(df.withColumns({"shard": F.lit("x"), "slot": F.lit(1)}), 6).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 1203 and sizes.max() < 1.1 * sizes.mean()
    assert out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert out[out.text.isna()]["size"].eq(8).all()


def test_small_groups_stay_together(spark):
    df = docs(spark, [f"text {i % 300}" for i in range(900)])
    assert (sharding.assign(df, 4).toPandas().groupby("text").shard.nunique() == 1).all()


def test_sharding_of_nothing_and_repeated_rows(spark):
    empty = docs(spark, ["a"]).where("false")
    assert sharding.assign(empty, 3).collect() == []
    twice = docs(spark, ["a"] * 5).withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted(r["slot"] for r in sharding.assign(twice, 1).collect()) == [0, 1, 2, 3, 4]


def spark_hash(*values):
    """Spark's xxhash64, by the library: each value's hash is the seed of the next."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - 2**64 if h >= 2**63 else h


def brute_shards(rows, shards, ranges):
    """shard and slot of each key, from the same rules in plain Python."""
    items = [(str(k), -(2**63) if t is None else spark_hash(t), len((t or "").encode()) + 8) for k, t in rows]
    total, n = sum(s for *_, s in items), len(items)
    step = max(1.0, total / (ranges * sharding.SAMPLES))
    drawn = defaultdict(float)
    for k, h, s in items:
        if spark_hash(h, k, "draw") % 2**30 / 2**30 < s / step:
            drawn[h] += max(s, step)
    share, filled, points = sum(drawn.values()) / ranges, 0.0, []
    for h, w in sorted(drawn.items()):
        filled += w
        if filled >= share * (len(points) + 1) and len(points) < ranges - 1:
            points.append(h)
            filled = max(filled, share * len(points))
    points = sorted(set(points))
    of_range = defaultdict(list)
    for k, h, s in items:
        of_range[bisect.bisect_left(points, h)].append((h, k, s))
    pieces, large = defaultdict(list), {}
    for r, held in of_range.items():
        share = lambda held: max(sum(s for *_, s in held) / total, len(held) / n) * ranges
        if share(held) > sharding.OVERFULL:
            groups = defaultdict(list)
            for x in held:
                groups[x[0]].append(x)
            for h, group in groups.items():
                if share(group) > sharding.PART:
                    large[h] = (r, group)
            held = [x for x in held if x[0] not in large]
            if share(held) > sharding.OVERFULL:
                cut = 1 + int(share(held) / sharding.PART)
                for h, k, s in held:
                    pieces[r << 32 | spark_hash(h, "piece") % cut].append((h, k, s))
                continue
        pieces[r << 32] += held
    for i, (_, (r, group)) in enumerate(sorted(large.items())):
        size = sum(s for *_, s in group)
        cut = 1 + int(max(size / total, len(group) / n) * ranges / sharding.PART) if size * shards > total else 1
        for h, k, s in group:
            pieces[(r << 32) + ((i + 1) << 16) + spark_hash(k, 0, "piece") % cut].append((h, k, s))
    pieces = {p: held for p, held in pieces.items() if held}
    sums, out, slots = [0] * shards, {}, defaultdict(list)
    for p, held in sorted(pieces.items(), key=lambda x: (-sum(s for *_, s in x[1]), x[0])):
        k = min(range(shards), key=lambda i: (sums[i], i))
        sums[k] += sum(s for *_, s in held)
        slots[k].append((p, held))
    for k, dealt in slots.items():
        out.update((key, (k, i)) for i, (_, key, _) in enumerate(x for _, held in sorted(dealt) for x in sorted(held)))
    return out


@pytest.mark.parametrize("copies", [5, 10, 40])
def test_equal_texts_that_fit_a_shard_stay_in_one(spark, copies):
    """Groups of a few hundredths of all rows or bytes, in few rows, fit; so do groups of many short texts."""
    rows = [*((i, f"text {i}") for i in range(1000)), *((2000 + i, "one text") for i in range(copies)), *((3000 + i, "long " * 10) for i in range(copies // 5))]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 24).toPandas()
    assert (out.groupby("text").shard.nunique() == 1).all()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() < 1.05 * sizes.mean()


def test_equal_texts_of_the_given_table_stay_in_one(spark):
    out = queries.op1_sharding(spark, "/root/testdata/sf0.01").select("doc_id", "shard", "text_crc32", "size").toPandas()
    share = out["size"].sum() / 24
    groups = out.groupby(["text_crc32", "size"]).agg(shards=("shard", "nunique"), n=("doc_id", "count"))
    whole = groups.reset_index()
    assert (whole[whole["size"] * whole["n"] <= share].shards == 1).all() and (whole.n > 1).any()


def test_shards_against_brute_force(spark, given):
    rows = [*enumerate(given.values()), *((1000 + i, "copy of one text " * 9) for i in range(150)), (2000, None), (2001, ""), (2002, "é" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_shards(rows, 5, 40)
    assert {str(r["doc_id"]): (r["shard"], r["slot"]) for r in sharding.assign(df, 5, ranges=40).collect()} == want


@pytest.mark.parametrize("key", [7, None])
def test_repeated_and_null_keys_are_spread(spark, key):
    """A third of all rows agree in text and key; a hash can't part them."""
    df = spark.range(600).selectExpr(f"cast({'null' if key is None else key} as long) as doc_id", "'one and the same text' as text")
    df = df.unionByName(spark.range(1200).selectExpr("id as doc_id", "concat('another text ', id) as text"))
    df = df.withColumns({c: F.lit("clash") for c in ("slot0", "n", "s", "piece", "part", "h", "first", "number")})
    out = sharding.assign(df, 24)
    rows = out.toPandas()
    assert len(rows) == 1800 and out.columns[:2] == ["doc_id", "text"] and (rows.slot0 == "clash").all()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() < 1.1 * sizes.mean()
    assert rows.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_parts_number_a_piece_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 2)
    df = docs(spark, [f"text {i % 50}" for i in range(900)])
    rows = sharding.assign(df, 4, ranges=16).toPandas()
    assert rows.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all() and (rows.groupby("text").shard.nunique() == 1).all()


# URL filters


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"), "https://example.org": ("example.org", "", None, None), "http://x.org/es/": ("x.org", "/es/", "org/", "allow"),
        "http://example.org/es/q#t": ("example.org", "/es/q", "example.org/es/", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "no scheme": ("", "", None, None), "http://c.com?/de/": ("c.com", "", None, None), "": ("", "", None, None), "http://ÄB.com/de/x": ("Äb.com", "/de/x", "com/de/", "block"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(99, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = {r["url"]: r for r in urls.judge(df, queries.URL_RULES).collect()}
    assert len(out) == len(rows)
    for u, (host, path, rule, verdict) in cases.items():
        assert (out[u]["host"], out[u]["path"], out[u]["rule"]) == (host, path, rule), u
        assert out[u]["verdict"] == verdict if verdict else out[u]["verdict"] in ("allow", "block")
    assert (out[None]["host"], out[None]["path"]) == ("", "")


def test_templates_generalise_and_reject(spark):
    rows = [(f"http://h.net/spam/{i}", 1) for i in range(40)] + [(f"http://h.net/good{i}/{i}", 0) for i in range(40)] + [("http://h.net/spam/new", None), ("http://h.net/other/1", None)]
    df = spark.createDataFrame(rows, "url string, bad int")
    out = {r["url"]: r for r in urls.judge(df, [], F.col("bad")).collect()}
    assert out["http://h.net/spam/new"]["verdict"] == "block" and out["http://h.net/spam/new"]["template"].startswith("/spam/")
    assert out["http://h.net/other/1"]["verdict"] == "allow" and out["http://h.net/good3/3"]["verdict"] == "allow"
    assert urls.judge(df.where("false"), [], F.col("bad")).collect() == []


def brute_urls(rows):
    """template, verdict and purity of each url without rules; rows are (host, segments, label)."""
    nodes = defaultdict(lambda: defaultdict(list))
    for host, path, label in rows:
        for i, seg in enumerate(path):
            below = path[i + 1] if i + 1 < len(path) else ""
            for parent in (("host", host, path[:i]), ("at", host, i), ("all", path[:i])):
                nodes[parent][seg].append((label, below == "", "{n}" in below))
    own = set()

    def differs(mine, every):
        (x, a), (all_x, all_a) = mine, every
        a, b = a + 2, all_a - a + 2
        p, q = (x + 1) / a, (all_x - x + 1) / b
        return abs(p - q) / math.sqrt(p * (1 - p) / (a + 1) + q * (1 - q) / (b + 1)) >= urls.CRITICAL

    for parent, kids in nodes.items():
        shares = lambda rs: ((sum(r[0] or 0 for r in rs), sum(r[0] is not None for r in rs)), (sum(r[1] for r in rs), len(rs)), (sum(r[2] for r in rs), len(rs)))
        every = shares([r for rs in kids.values() for r in rs])
        own |= {(parent, seg) for seg, rs in kids.items() if len(rs) >= urls.SUPPORT and any(map(differs, shares(rs), every))}
    found, sums, table = {}, defaultdict(lambda: [0, 0]), [0, 0]
    for host, path, label in rows:
        named = [s if any((p, s) in own for p in (("host", host, path[:i]), ("at", host, i), ("all", path[:i]))) else "*" for i, s in enumerate(path)]
        t = found[host, path] = "".join(f"/{s}" for s in named)
        for x in (sums[host, t], sums["host", host, 0], sums["template", t, 0], table):
            x[0] += label or 0
            x[1] += label is not None
    share = (table[0] + 1) / (table[1] + 2)
    smooth = lambda bad, n, prior: (bad + urls.WEIGHT * prior) / (n + urls.WEIGHT)
    odds = lambda p: math.log(p / (1 - p))
    purity = {}
    for (h, path), t in found.items():
        (bad, n), (all_bad, all_n) = sums[h, t], sums["template", t, 0]
        prior = 1 / (1 + math.exp(odds(share) - odds(smooth(*sums["host", h, 0], share)) - odds(smooth(all_bad - bad, all_n - n, share))))
        purity[h, path] = smooth(bad, n, prior)
    return {k: (t, "block" if purity[k] >= urls.REJECT else "allow", purity[k]) for k, t in found.items()}


def test_templates_against_a_plain_tree(spark):
    rng, rows = random.Random(4), []
    for _ in range(1500):
        host, depth = rng.choice(["a.net", "a.net", "b.net", "c.net"]), rng.randrange(0, 9)
        path = tuple(rng.choice(["x", "y", "spam", f"v{rng.randrange(400)}"]) for _ in range(depth))
        rows.append((host, path, rng.choice([None, float("spam" in path[4:])])))
    rows += [("d.net", ("p",) * 30, None)] * 3 + [("e.net", (), 1.0)] * 9
    df = spark.createDataFrame([(f"http://{h}/{'/'.join(p)}", x) for h, p, x in rows], "url string, bad double")
    df = df.withColumns({c: F.lit("clash") for c in ("shape", "of_rule", "blocked", "row", "label", "n", "seg")})
    digits = lambda p: tuple(re.sub("[0-9]+", "{n}", s) for s in p)
    want = brute_urls([(h, digits(p), x) for h, p, x in rows])
    out = urls.judge(df, [], F.col("bad")).collect()
    assert len(out) == len(rows) and all(r["shape"] == "clash" for r in out)
    for r in out:
        template, verdict, purity = want[r["host"], digits(tuple(s for s in r["path"].split("/") if s))]
        assert (r["template"], r["verdict"]) == (template, verdict) and math.isclose(r["purity"], purity), r["url"]
    assert len({v for _, v, _ in want.values()}) == 2


def test_deep_paths_are_told_apart_and_long_urls_pass(spark):
    rows = [(f"http://h.net/a/b/c/d/e/{k}/{i}", b) for i in range(60) for k, b in (("spam", 1), ("good", 0))]
    rows += [("http://h.net/" + "q/" * 20_000, None), ("http://h.net/a/b/c/d/e/spam/new", None), ("http://h.net/a/b/c/d/e/spam/new", None)]
    df = spark.createDataFrame(rows, "url string, bad int")
    out = urls.judge(df, [], F.col("bad")).collect()
    assert len(out) == len(rows) and all((r["verdict"] == "block") == ("/spam/" in r["url"]) for r in out if r["bad"] is not None or "new" in r["url"])


def test_hosts_without_labels_learn_from_the_same_template_elsewhere(spark):
    out = queries.op2_url_filters(spark, "/root/testdata/sf0.1").toPandas()
    free = out[out.rule.isna()]
    assert len(out) == 2500 and set(free.verdict) == {"allow", "block"}
    # Every /es/ page with a rule is blocked, every /fr/ page with a rule of its own allowed.
    assert (free[free.path.str.startswith("/es/")].verdict == "block").all() and (free[free.path.str.startswith("/fr/")].verdict == "allow").all()


def test_held_out_rule_verdicts_beat_the_share_of_the_host(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = urls.parts(F.col("url"))
    _, verdict = urls.rule_of(host, path, queries.URL_RULES)
    pages = pages.withColumn("bad", (verdict == "block").cast("int")).withColumn("held", F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0)
    out = urls.judge(pages, [], F.when(~F.col("held"), F.col("bad"))).toPandas().dropna(subset=["bad"])
    shares = out[~out.held].groupby("host").bad.mean()
    held = out[out.held]
    by_host = ((held.host.map(shares).fillna(0) >= urls.REJECT) == (held.bad == 1)).mean()
    by_tree = ((held.verdict == "block") == (held.bad == 1)).mean()
    assert by_tree > by_host + 0.1 and by_tree > 0.85


def test_branches_differ_by_what_is_below_them(spark):
    rows = [(f"http://h.net/news/{i}/story", None) for i in range(30)] + [(f"http://h.net/tags/w{'x' * i}", None) for i in range(30)]
    out = urls.judge(spark.createDataFrame(rows, "url string, bad int"), [], F.col("bad")).toPandas()
    assert set(out.template.str.split("/").str[1]) == {"news", "tags"} and set(out.verdict) == {"allow"}


def test_hashes_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(urls, "BLOCK", 3)
    for n in (0, 1, 2, 3, 4, 6, 7, 20):
        path = [f"s{i % 4}" for i in range(n)]
        got = spark.createDataFrame([(path, path[:-1])], "p array<string>, q array<string>").select(urls.prefixes(F.col("p")), urls.prefixes(F.col("q"))).first()
        assert len(got[0]) == n + 1 == len(set(got[0])) and got[0][: len(got[1])] == got[1]


def test_a_crawler_trap_takes_no_round_for_each_level(spark):
    rows = [("http://t.net/" + "q/" * n, None) for n in (996, 997, 998, 999, 1000)] + [("http://u.net/" + "q/" * 100_000, 1)] * 5
    began = time.time()
    out = urls.judge(spark.createDataFrame(rows, "url string, bad int"), [], F.col("bad")).collect()
    assert len(out) == 10 and {r["template"].count("/") for r in out} == {996, 997, 998, 999, 1000, 100_000}
    assert time.time() - began < 60


# Language


def test_languages_of_held_out_documents(spark):
    out = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    right = out.where("lang = lang_pred").count() / out.count()
    assert right > 0.93
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    learned = language.fit(spark.read.parquet(f"{DIR}/documents.parquet"))
    out = language.predict(docs(spark, [None, "", "123 !?", "the and of to the and of to"]).withColumn("score", F.lit("x")), learned).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == ["und", "und", "und", "en"] and [r["score"] for r in out[:3]] == [0, 0, 0] and all(r["lang_rejected"] for r in out[:3])
    none = language.fit(docs(spark, ["a"]).where("false"))
    assert none == {} and language.predict(docs(spark, ["abc"]), none).first()["lang_pred"] == "und"


def test_numerals_are_no_letters_and_labels_may_be_many(spark):
    learned = language.fit(spark.read.parquet(f"{DIR}/documents.parquet"))
    out = language.predict(docs(spark, ["½", "²³ Ⅷ ①", "_ 5 --", "ª", "ж" * 3, "long text " * 50_000, "long text " * 50_000]), learned).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in out] == [True, True, True, False, False, False, False] and out[5]["score"] == out[6]["score"]
    noisy = docs(spark, [f"text {i % 400}" for i in range(800)]).withColumn("lang", F.concat(F.lit("l"), F.least(F.col("doc_id") % 400, F.lit(299))))
    learned = language.fit(noisy)
    assert len(learned) == language.MAX_LANGUAGES and "l299" in learned
    assert language.predict(docs(spark, ["text 299"]), learned).first()["lang_pred"] in learned


# Language model


def brute_model(rows):
    """Scores by plain dictionaries, and a check that the distributions sum to one."""
    tokens = {i: [*re.findall(SPACE, lower(t)), ""] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for i in train for w in tokens[i])
    two = Counter(p for i in train for p in zip([None, *tokens[i][:-1]], tokens[i], strict=True))
    n, k = sum(one.values()), ngrams.K
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, k + 2)]
    d1, d2 = ngrams.discounts(of(one)), ngrams.discounts(of(two))
    d = lambda table, c: table[c] if c <= k else 1.0
    unknown = 1 - sum(d(d1, c) * c for c in one.values()) / n
    word = lambda w: d(d1, one[w]) * one[w] / n if w in one else unknown
    total, follow, back = Counter(), defaultdict(list), {}
    for (v, w), c in two.items():
        total[v] += c
        follow[v].append((w, c))
    for v, f in follow.items():
        left, low = 1 - sum(d(d2, c) * c for _, c in f) / total[v], 1 - sum(word(w) for w, _ in f)
        back[v] = (left / low, 1.0) if left > 1e-12 else (1 / (total[v] + 1) / low, total[v] / (total[v] + 1))

    def p(v, w):
        if c := two.get((v, w), 0):
            return back[v][1] * d(d2, c) * c / total[v]
        return back[v][0] * word(w) if v in back else word(w)

    for v in (None, tokens[train[0]][0]):
        assert abs(sum(p(v, w) for w in one) + p(v, "\0") - 1) < 1e-9
    return {
        i: (len(t), sum(w in one for w in t), n, sum(math.log10((one[w] + 1) / (n + len(one) + 1)) for w in t), sum(math.log10(p(v, w)) for v, w in zip([None, *t[:-1]], t, strict=True)))
        for i, t in tokens.items()
    }


@pytest.mark.parametrize("chunk,bucket", [(2_000_000, 24_000_000), (3000, 40_000)])
def test_language_model_against_brute_force(spark, given, monkeypatch, chunk, bucket):
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    monkeypatch.setattr(ngrams, "BUCKET_BYTES", bucket)
    want = brute_model(given.items())
    out = queries.op4_language_model(spark, DIR).collect()
    assert len(out) == len(want)
    for r in out:
        assert tuple(r)[2:] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_language_model_edges(spark):
    df = docs(spark, [None, "", "a b", "a b"])
    out = ngrams.score(df, F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in out] == [(1, 0, 0, 0), (1, 0, 0, 0), (3, 0, 0, 0), (3, 0, 0, 0)]
    assert ngrams.score(df.where("false"), F.lit(True)).collect() == []
    assert all(math.isfinite(r["score"]) for r in ngrams.score(df, F.lit(True)).collect())


# Chat


def test_roles_of_held_out_conversations(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    out = queries.op5_chat_formatting(spark, d).collect()
    roles = {(r["conv_id"], r["turn"]): r["role"] for r in spark.read.parquet(f"{d}/conversations.parquet").collect()}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(roles) and sum(r["role_pred"] == roles[r["conv_id"], r["turn"]] for r in held) > 0.9 * len(held)
    monkeypatch.setattr(transcripts, "BLOCK", 2)  # blocks give the same path
    monkeypatch.setattr(transcripts, "LINES", 3)
    assert sorted(map(tuple, queries.op5_chat_formatting(spark, d).collect())) == sorted(map(tuple, out))


def chats(spark):
    """Held-in model of the conversations, and the turns of the others."""
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns = defaultdict(list)
    for r in rows.where("conv_id % 4 = 1").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    return transcripts.fit(rows.where("conv_id % 4 <> 1")), turns


def test_one_text_with_markers_comes_apart_into_its_turns(spark):
    model, turns = chats(spark)
    for marker in ("{}: ", "[{}] - "):
        df = spark.createDataFrame([(c, 0, "\n".join(marker.format(r.capitalize()) + t for r, t in ts)) for c, ts in turns.items()], "conv_id long, turn int, text string")
        right = total = 0
        for r in transcripts.parse(df, model).collect():
            want = turns[r["conv_id"] if "conv_id" in r else r["key"]]
            got = [(t["role"], t["text"]) for t in r["turns"]]
            total += len(want)
            right += sum(w in got for w in want) if len(got) == len(want) else len(set(want) & set(got))
        assert right > 0.95 * total, marker


def test_markers_help_and_unseen_values_favour_no_role(spark):
    model, _ = chats(spark)
    texts = {1: "hi there|hello", 2: "User: hi there|Assistant: hello", 3: "x" * 5000 + "|" + "y" * 9000}
    df = spark.createDataFrame([(c, k, t) for c, ts in texts.items() for k, t in enumerate(ts.split("|"))], "conv_id int, turn int, text string")
    got = defaultdict(dict)
    for r in transcripts.parse(df, model).collect():
        got[r["key"]][r["part"]] = (r["role_pred"], r["turn_text"])
    assert {c: [got[c][k][0] for k in (0, 1)] for c in texts} == dict.fromkeys(texts, ["user", "assistant"])
    assert got[2][1][1] == "<|assistant|>\nhello"
    for table, other in model.emit.values():
        assert len(set(other.tolist())) == 1
    one = spark.createDataFrame([(1, 0, "User: a?\nAssistant: b.\nmore of b\nUser: c?\nAssistant: d.")], "conv_id int, turn int, text string")
    r = transcripts.parse(one, model).first()
    assert [tuple(t) for t in r["turns"]] == [("user", "a?"), ("assistant", "b.\nmore of b"), ("user", "c?"), ("assistant", "d.")]
    assert r["turn_text"] == "<|user|>\na?\n<|assistant|>\nb.\nmore of b\n<|user|>\nc?\n<|assistant|>\nd."


def brute_viterbi(model, features):
    """The best states, by plain loops over all moves; ties go to the state first in order."""
    n, score, back = len(model.roles) * 2, None, []
    for k, row in enumerate(features):
        e = [sum(model.emit[f][0].get(v, model.emit[f][1])[s] for f, v in zip(transcripts.FEATURES, row, strict=True)) for s in range(n)]
        if k == 0:
            score = [model.first[s] + e[s] for s in range(n)]
            continue
        came = [max(range(n), key=lambda a: (score[a] + model.move[a, s], -a)) for s in range(n)]
        score, back = [score[a] + model.move[a, s] + e[s] for s, a in enumerate(came)], [*back, came]
    path = [max(range(n), key=lambda s: (score[s], -s))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("lines", [1 << 14, 2])
def test_paths_against_a_plain_viterbi(spark, monkeypatch, lines):
    model, turns = chats(spark)
    monkeypatch.setattr(transcripts, "LINES", lines)
    monkeypatch.setattr(transcripts, "BLOCK", 2)
    rng, rows = random.Random(7), []
    for c, ts in list(turns.items())[:12]:
        rows += [(c, k, rng.choice(["", "", f"{r}: "]) + t) for k, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    described = transcripts.lines(df, "conv_id", "turn", "text")
    got, features = defaultdict(list), defaultdict(list)
    for r in described.orderBy("key", "part", "line").collect():
        features[r["key"]].append(tuple(r[f] for f in transcripts.FEATURES))
    for r in transcripts.decode(described, model).orderBy("key", "part", "line").collect():
        got[r["key"]].append(2 * model.roles.index(r["role_pred"]) + (not r["begins"]))
    assert got == {c: brute_viterbi(model, f) for c, f in features.items()}


def test_markers_and_chat_edges(spark, monkeypatch):
    rows = [(c, t, r, x) for c in range(20) for t, r, x in ((0, "user", "User: what is it?"), (1, "assistant", "Assistant: this.\nAnd that."), (2, "user", "Human: why?"))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    model = transcripts.fit(df)
    new = spark.createDataFrame([(1, 0, "Assistant: hello\nmore"), (1, 1, "Q: really?"), (2, 0, None), (2, 0, None), (None, None, "x")], "conv_id int, turn int, text string")
    out = sorted(transcripts.parse(new, model).collect(), key=str)
    assert len(out) == 5
    first = next(r for r in out if r["key"] == 1 and r["part"] == 0)
    assert first["role_pred"] == "assistant" and first["turn_text"] == "<|assistant|>\nhello\nmore"
    assert transcripts.parse(new.where("false"), model).collect() == []
    assert {r["role_pred"] for r in transcripts.parse(new, transcripts.fit(df.where("false"))).collect()} == {"unknown"}
    monkeypatch.setattr(transcripts, "LINES", 1000)
    clash = {c: F.lit("clash") for c in ("key", "part", "block", "line", "copy", "n", "state", "span", "turns")}
    odd = [(3, 5, "a\n" * 5000), *((4, 1, f"text {i}\nmore") for i in range(900)), *((None, None, f"text {i}") for i in range(1200)), *((5, 2, "same"),) * 50]
    found = transcripts.parse(spark.createDataFrame(odd, "conv_id int, turn int, text string").withColumns(clash), model).collect()
    assert Counter((r["key"], r["part"]) for r in found) == Counter((c, t) for c, t, _ in odd)
    assert next(r for r in found if r["key"] == 3)["turn_text"].count("a") >= 5000
    repeated = spark.createDataFrame([(1, k, r, f"{r} text") for _ in range(3000) for k, r in enumerate(("user", "assistant"))], "conv_id int, turn int, role string, text string")
    assert transcripts.fit(repeated).roles == ["assistant", "user"]


# Neighbours


def brute_nearest(rows, k=20):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float((v * w).sum()), j) for j, w in ok if j != i))[:k]
    return out


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, found = brute_nearest(rows), defaultdict(dict)
    for r in queries.op6_neighbours(spark, d).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert found.keys() == want.keys()
    hits = sum(len({j for _, j in w} & {j for j, _ in found[q].values()}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, of in found.items():
        assert [x[1] for _, x in sorted(of.items())] == sorted((x[1] for x in of.values()), reverse=True) and sorted(of) == list(range(1, len(of) + 1))
        assert all(s == pytest.approx(float(np.dot(np.float64(exact[q]), np.float64(exact[j]))), abs=1e-12) for j, s in of.values())


def test_equal_vectors_and_unusable_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(200 + i, rng.normal(size=2).tolist()) for i in range(50)] + [(300, None), (320, [0.0, 0.0]), (340, [float("nan"), 1.0]), (360, [None, 1.0]), (380, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("key") % 20 == 0).collect()
    want = brute_nearest(rows)
    of = {q: [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] for q in want}
    assert {r["query_id"] for r in found} == set(want) and of[0] == [j for _, j in want[0]]
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), F.col("key") % 20 == 0).collect()
    assert [r["vec_id"] for r in few] == [1, 2]
    assert neighbours.search(df.where("false"), F.col("key") % 20 == 0).collect() == []


def clustered(n, size=16, clusters=10, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return centres[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, size))


def test_clustered_vectors_need_few_cells_and_bounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 100)
    x = clustered(4000)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = neighbours.Cells(x, 40, 16)
    of, far = cells.place(x)
    cells.radius[:] = [far[of == c].max(initial=-np.inf) for c in range(len(cells.radius))]
    scores = x[:200] @ x.T
    home = cells.home(x[:200])
    least = np.array([np.sort(scores[i][of == home[i]])[-20:][0] for i in range(200)])
    row, cell = cells.others(x[:200], least)
    assert len(row) < 0.35 * 200 * len(cells.radius)
    seen = {*zip(row.tolist(), cell.tolist()), *enumerate(home.tolist())}
    assert all((i, of[j]) in seen for i in range(200) for j in np.argsort(-scores[i])[:20])
    rows = [(i, v.tolist()) for i, v in enumerate(x[:1500])]
    want, found = brute_nearest(rows), defaultdict(set)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("key") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert sum(len({j for _, j in w} & found[q]) for q, w in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_every_dimension_is_searched_and_other_columns_do_not_clash(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200 + i, rng.normal(size=9).tolist()) for i in range(3)] + [(500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("key", "v", "size", "query", "shard", "block", "longest")})
    found = neighbours.search(df, F.col("key") % 20 == 0).collect()
    of = Counter(r["query_id"] for r in found)
    assert of == {**{i: 20 for i in range(0, 200, 20)}, 200: 2}
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 200) == [201, 202]


def test_repeated_ids_of_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("key") == 0).orderBy("rank").collect()
    # Each vector of id 0 has its own ranks: 5, 1, 1 and 1, 1, 0.
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 1.0), (1, 2, 5.0), (2, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (3, 2, 0.0)]


@pytest.mark.parametrize(("same", "others"), [(25, 9), (60, 30), (3, 0)])
def test_more_copies_of_the_query_than_places(spark, same, others):
    """Copies of the query's own row, and of others' rows, take no place from other ids with the same vector."""
    rows = [(0, [1.0, 0.0])] * same + [(i, [1.0, 0.0]) for i in range(1, others + 1)] + [(1, [1.0, 0.0])] * 40 * bool(others) + [(100 + i, [0.5, 0.1 * i]) for i in range(10)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("key") == 0).orderBy("rank").collect()
    want = sorted((-(v[0]), i) for i, v in rows if i != 0)[:20]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found] == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


# Near copies


def brute_print(text):
    words = re.findall(SPACE, lower(text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=3):
    of = dict(zip(ids, ids, strict=True))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(ids[i]), find(ids[j])
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark, given):
    texts = [*given.values(), *ODD, given[0], lower(given[1]) + " tail"]
    out = {r["doc_id"]: r for r in simhash.near_copies(docs(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [out[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == prints
    want = brute_components(list(range(len(texts))), prints)
    assert {i: out[i]["component_id"] for i in out} == want


@pytest.mark.parametrize("leaf,home,members,pairs", [(1500, 4096, 1 << 15, 100_000), (20, 16, 64, 10)])
def test_trees_find_every_link(spark, monkeypatch, leaf, home, members, pairs):
    for name, x in (("LEAF", leaf), ("HOME", home), ("MEMBERS", members), ("PAIRS", pairs)):
        monkeypatch.setattr(simhash, name, x)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(150)]
    prints = {0, *centres}
    for c in centres[:60]:
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                c ^= 1 << b
            prints.add(c)
    dense = rng.getrandbits(64)
    prints |= {dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(df).collect()
    assert all(((e["a"] ^ e["b"]) & (2**64 - 1)).bit_count() <= 3 for e in edges)
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(signed, [p & (2**64 - 1) for p in signed])
    groups = defaultdict(set)
    for p, w in want.items():
        groups[w].add(found.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def shingle_sets(texts):
    out = []
    for t in texts:
        words = re.findall(SPACE, lower(t))
        runs = [" ".join(words[k : k + 5]) for k in range(len(words) - 4)] or ([" ".join(words)] if words else [])
        out.append(frozenset(xxhash.xxh64_intdigest(r.encode(), 42) for r in runs))
    return out


def print_of(found, words):
    """A set's fingerprint by plain loops over its bits."""
    bits, mask = [0] * (64 * words), 2**64 - 1
    for h in found:
        for word in range(words):
            x = (h + 0x9E3779B97F4A7C15 * (word + 1)) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            x ^= x >> 31
            for b in range(64):
                bits[64 * word + b] += x >> b & 1
    return sum((2 * c > len(found)) << b for b, c in enumerate(bits))


def brute_similar(texts):
    """Components of all pairs that share 0.8 of their five-word shingle sets, and those pairs."""
    sets = shingle_sets(texts)
    of, pairs = list(range(len(texts))), []

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or x and y and 5 * len(x & y) >= 4 * len(x | y):
                pairs.append((a, b))
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}, pairs


def edited(rng, text, share):
    """``text`` with a share of its words changed."""
    words = text.split()
    for k in rng.sample(range(len(words)), round(len(words) * share)):
        words[k] = f"changed{rng.random()}"
    return " ".join(words)


def test_links_have_the_exact_similarity(spark, given):
    rng = random.Random(6)
    texts = [t for t in given.values() if len(t.split()) > 100][:12]
    texts += [edited(rng, t, share) for t in texts for share in (0.01, 0.03, 0.05)]
    texts += ["x y z " * 40, "x y z " * 41, None, "", " \n", "short text", "short  text", "short texts"]
    texts += ["p q r " * 60 + " ".join(f"{c}{k}" for k in range(20)) for c in "uv"]
    out = simhash.similar_copies(docs(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_similar(texts)[0]


@pytest.mark.parametrize("small", [False, True])
def test_dense_groups_lose_no_link(spark, monkeypatch, small):
    """Chains, dense groups and near misses, with tasks so small that forests and blocks are used, against all pairs."""
    if small:
        for name, x in (("SET_LEAF", 64), ("HOME", 16), ("MEMBERS", 64), ("PAIRS", 10), ("SETS", 8), ("HASHES", 2000)):
            monkeypatch.setattr(simhash, name, x)
    rng, texts = random.Random(8), []
    for _ in range(6):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
        texts += [text, *(edited(rng, text, rng.choice((0.01, 0.02, 0.04, 0.08))) for _ in range(25))]
        for _ in range(10):  # a chain: each is near the one before
            texts.append(edited(rng, texts[-1], 0.02))
    out = simhash.similar_copies(docs(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_similar(texts)[0]


def one_cluster(spark, texts):
    """``texts`` as the arguments of ``confirmed``, all in one cluster; their nodes."""
    sets = [simhash.shingles(t) for t in texts]
    nodes = [simhash.named(x) for x in sets]
    df = docs(spark, texts)
    rows = [(i, n, len(x)) for i, (n, x) in enumerate(zip(nodes, sets))]
    known = spark.createDataFrame(rows, "least long, node long, size long").groupBy("node").agg(F.min("least").alias("least"), F.first("size").alias("size"))
    least = min(nodes)
    clusters = known.select("node", F.lit(least).alias("component")).where(F.col("node") != least)
    return (clusters, known, df, "doc_id", "text"), nodes


def test_large_clusters_keep_every_component(spark, monkeypatch):
    """One cluster of dense groups, of chains, of lone texts and of sizes far apart, in blocks of a few sets, against all pairs."""
    monkeypatch.setattr(simhash, "SETS", 6)
    monkeypatch.setattr(simhash, "HASHES", 2000)
    rng, texts = random.Random(9), []
    for length in (15, 60, 120, 121, 300):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(length))
        texts += [text, *(edited(rng, text, rng.choice((0.01, 0.02, 0.04, 0.08))) for _ in range(12))]
        words = text.split()
        texts += [" ".join(words[: length - k]) for k in range(0, length // 2, 9)]  # a chain of ever shorter texts
    texts += texts[:5] + ["x y z", "u v w x y z"]
    args, nodes = one_cluster(spark, texts)
    out = {r["node"]: r["component"] for r in simhash.components(simhash.confirmed(*args)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for i, c in brute_similar(texts)[0].items():
        got[out.get(nodes[i], nodes[i])].add(i)
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_large_cluster_that_is_one_component_costs_its_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 10)
    rng, met, compared = random.Random(10), [], simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda rows, other: met.append(rows.count()) or compared(rows, other))
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    texts = [edited(rng, text, 0.01) for _ in range(400)]
    lone = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200))]
    simhash.confirmed(*one_cluster(spark, texts + lone)[0]).collect()
    assert sum(met) < 4 * len(texts)  # all pairs of blocks: 40 times


def test_fingerprints_of_sets_by_plain_loops():
    rng, blocks, bits = random.Random(3), *simhash.layout(10**6)
    sets = [sorted(rng.getrandbits(64) for _ in range(n)) for n in (1, 2, 7, 300)]
    words = simhash.set_words([simhash.set_print(np.array(x, dtype=np.uint64), 5) for x in sets], 5)
    for row, x in enumerate(sets):
        whole = print_of(x, 5)
        assert sum(int(w) << 64 * k for k, w in enumerate(words[row])) == whole
        assert [int(v[row]) for v in simhash.set_blocks(words, blocks, bits)] == [whole >> k * bits & (1 << bits) - 1 for k in range(blocks)]
    assert blocks * bits <= 320 and simhash.layout(10**10)[1] > bits


def test_pairs_at_the_least_similarity_are_candidates():
    """The share of pairs with a Jaccard just over 0.8 that agree in a block and are near enough, against RECALL."""
    rng, met, near_, n = random.Random(9), 0, 0, 0
    blocks, bits = simhash.layout(10**6)
    while n < 600:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 300))]
        x, y = shingle_sets([" ".join(words), edited(rng, " ".join(words), 0.022)])
        if 0.8 <= len(x & y) / len(x | y) < 0.82:
            pair = simhash.set_words([simhash.set_print(np.array(sorted(s), dtype=np.uint64), 5) for s in (x, y)], 5)
            met += any(v[0] == v[1] for v in simhash.set_blocks(pair, blocks, bits))
            near_ += int(np.bitwise_count(pair[0, :4] ^ pair[1, :4]).sum()) <= simhash.WITHIN and int(np.bitwise_count(pair[0, :2] ^ pair[1, :2]).sum()) <= simhash.HALF
            n += 1
    assert met >= 0.96 * n and near_ >= 0.995 * n


def test_similar_texts_of_many_bits_are_found(spark):
    rng, texts = random.Random(9), []
    while len(texts) < 20:
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(180))
        pair = [text, edited(rng, text, 0.02)]
        if 10 <= (brute_print(pair[0]) ^ brute_print(pair[1])).bit_count() <= 13 and brute_similar(pair)[1]:
            texts += pair
    out = corpus_pipeline.simhash_near_dedup(spark, docs(spark, texts), DIR).collect()
    assert {r["doc_id"] for r in out} == set(range(0, 20, 2))


def test_null_keys_and_clashing_columns_of_near_copies(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s"), (9, None)], "doc_id long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("key", "fp", "node", "component_id", "class", "least", "own", "leaf", "print", "size")})
    for found in (simhash.near_copies(df), simhash.similar_copies(df)):
        rows = sorted((str(r["doc_id"]), str(r["component_id"])) for r in found.collect())
        assert rows == [("3", "3"), ("9", "9"), ("None", "3"), ("None", "3"), ("None", "None")]
    assert simhash.similar_copies(df.where("false")).collect() == []


def test_near_copies_of_nothing(spark):
    assert simhash.near_copies(docs(spark, ["a"]).where("false")).collect() == []


def test_the_filter_of_keys_passes_all_of_them(spark, monkeypatch):
    df = spark.range(5000).selectExpr("if(id % 7 = 0, null, id) as k", "'x' as map", "'y' as row")
    keys = spark.range(0, 3000, 3).selectExpr("id as q").unionByName(spark.sql("select cast(null as long) as q"))
    for bits in (1 << 24, 1 << 15):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        out = common.may_be_in(df, F.col("k"), keys, F.col("q"), "likely").collect()
        inside = {i for i in range(0, 3000, 3)} | {None}
        assert len(out) == 5000 and all(r["likely"] for r in out if r["k"] in inside)
        assert sum(r["likely"] for r in out if r["k"] not in inside) < (10 if bits > 1 << 15 else 500)


# Packing


def test_pieces_and_sequences(spark, given):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {**given, **{10_000 + i: x for i, x in enumerate(ODD)}}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    out = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    for d, part in out.sort_values(["doc_id", "start"]).groupby("doc_id"):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert part.length.sum() == len(ids) and (part.doc_tokens == len(ids)).all() and (part.start == part.length.cumsum() - part.length).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    assert set(out.doc_id) == set(texts)
    for _, s in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    assert out.length.sum() > 0.97 * 1024 * out.sequence_id.nunique()
    assert packing.pack(df.where("false"), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_packing_of_repeated_rows_null_keys_and_clashing_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(7, "one and the same text")] * 40 + [(None, "no key")] * 40 + [(None, None), (8, "word " * 4000)], "doc_id long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("key", "task", "number", "rank", "first", "pieces", "start", "n")})
    out = packing.pack(df, path, pattern=public_tokenizers.PATTERN, with_ids=True).toPandas()
    assert len(out[out.doc_id == 7]) == 40 and out.doc_id.isna().sum() == 41
    for _, s in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(out.ids, out.ids_crc32, out.length, strict=True))


def test_both_ways_to_encode_agree(given):
    """The merges in tiktoken against the tokenizers library, on odd texts, special tokens and every code point."""
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    fast, slow = packing.encoder(path, public_tokenizers.PATTERN), packing.encoder(path, None)
    parts = [*" \n\t ab'sé漢1\x1c😀-.　the\r\x0b\x85\u2028", "<|endoftext|>", "<|endoftext", "'re", "  ", "don't"]
    texts = [*given.values(), *ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(3000))]
    texts += ["".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} " for c in range(k, min(k + 997, 0x110000)) if not 0xD800 <= c <= 0xDFFF) for k in range(0, 0x110000, 997)]
    texts += [" " * 3_000_000 + "x"]  # more white space than the faster engine takes
    assert packing.ranks_of(path) is not None
    for t in texts:
        assert fast(t or "").tolist() == slow(t or "").tolist()


def test_cutting_stock_meets_every_demand():
    rng = np.random.default_rng(0)
    for n in (1, 7, 5000):
        demand = np.bincount(rng.integers(0, 64, n), minlength=64)
        plan = packing.cutting_stock(demand, 64)
        got = sum(np.bincount(items, minlength=65)[1:] * times for items, times in plan)
        assert (got == demand).all() and all(sum(items) <= 64 for items, _ in plan)
    used = sum(times for _, times in plan)
    assert (demand * np.arange(1, 65)).sum() > 0.98 * 64 * used


# Quality


def brute_measures(text):
    text = text or ""
    words = re.findall(SPACE, text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if times[r] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark, given):
    texts = [*given.values(), *ODD]
    df = docs(spark, texts).withColumn("kept", F.lit("clash"))
    for r in quality.judge(df).collect():
        m = r["measures"]
        got = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        assert got == brute_measures(texts[r["doc_id"]]), r["doc_id"]
        assert not r["kept"] or got[0] >= 50
    plan = quality.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# Byte-level BPE


def test_bpe_against_the_library_and_back(spark, given):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    v = bpe.vocabulary(path, pattern)
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = " \n\t ab'sé漢1\x1c😀-.　 the "
    texts = [*given.values(), *ODD, "a" * 20_000, "ab" * 900 + "c", " " * 400 + "x", "\n\n a", " a", "  a", "it's we'll '' 's", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400))]
    encoded = bpe.encode(docs(spark, texts).select("doc_id", "text", F.lit(1).alias("ids")), path, pattern)
    for r in bpe.decode(encoded, path, pattern).collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == e.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    assert bpe.encode(docs(spark, ["a"]).where("false"), path, pattern).collect() == []
    got = {r["doc_id"]: r for r in queries.op10_byte_bpe(spark, DIR).collect()}
    for i, t in given.items():
        ids = e.encode_ordinary(t)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_long_matches_against_the_library():
    import tiktoken

    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(5)
    words = ["a" * n for n in range(257, 300)] + ["the" * 200, "x" * 100_000, "".join(rng.choice("etaoinshr") for _ in range(50_000))]
    words += ["".join(rng.choice(("ab", "aa", "the", "ing", "z")) for _ in range(rng.randrange(200, 900))) for _ in range(100)]
    for w in words:
        want = e.encode_ordinary(w)
        assert np.frombuffer(v.long(w.encode()), dtype="<i4").tolist() == want
    for t in rng.sample(v.tokens, 3000):
        w = (t * 40).decode(errors="ignore").strip()
        if len(v.matches(w)) == 1:
            assert np.frombuffer(v.long(w.encode()), dtype="<i4").tolist() == e.encode_ordinary(w)


# Pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet")
    before = rows
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, d).write.parquet(f"file://{tmp_path}/{name}")
        after = spark.read.parquet(f"file://{tmp_path}/{name}")
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        kept = {r["doc_id"] for r in after.collect()}
        if name == "simhash_near_dedup":
            ids = sorted(texts)
            of, _ = brute_similar([texts[i] for i in ids])
            assert kept == {ids[k] for k in of.values()}
        if name == "packing":
            assert kept == set(texts)
        else:
            assert after.columns == rows.columns and kept <= set(texts)
        before = after
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = {r["doc_id"] for r in spark.read.parquet(f"file://{tmp_path}/quality_rules").collect()}
    assert not [i for i in judged if labels.get(i) == 0][3:]


def test_pipeline_edges(spark):
    df = docs(spark, [None, "", "short"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), DIR).collect() == []
        stage(spark, df.unionByName(df), DIR).collect()


def test_documents_without_id_are_kept_once_for_each_group(spark, given):
    texts = [t for t in given.values() if len(t.split()) > 50][:4]
    df = spark.createDataFrame([(None, texts[0], "en", "s", 1), (None, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1), (None, texts[2], "en", "s", 1), (7, texts[2], "en", "s", 1), (7, texts[2], "en", "s", 1), (8, texts[3], "en", "s", 1)], DOCS)
    out = corpus_pipeline.simhash_near_dedup(spark, df, DIR).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("8", texts[3])])
