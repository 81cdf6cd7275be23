"""URL filters from a tree of path templates.

A url is cut into host and path. Explicit rules come first; the longest that fits
decides. All other urls are judged by the template of their path in a tree of their
host: digits in a segment become a wildcard, and a segment is kept as a branch of its
own only if it is frequent and differs from its siblings by a two-proportion test, in
its labels or in what is below it (paths that end there, numbers that follow). All
others, variable or statistically similar, share the wildcard branch. Siblings are told
apart by the host's prefixes, by the host's positions (segments below variable ones)
and by the prefixes of all hosts (hosts with few labels). A template is blocked if its
labelled purity reaches ``REJECT``. It is smoothed towards a prior in which the odds of
its host and of the same template on other hosts are joined, both smoothed towards the
whole table's share.

Everything is DataFrame operations on counts for each (host, shape), so a host with
most of the pages is summed before any shuffle. All levels are grown at once: each
segment is one row for each of the three trees, known by hashes of 64 bits, and the
work grows with the segments of the distinct shapes, however deep paths are.

Defined cases: null urls and urls without ``://`` have empty host and path and no
rule; null labels are unknown; without labels nothing is blocked but by rules; repeated
rows are judged alike; an empty table gives an empty table. Other columns pass through;
those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, let, saved

#: Pages a branch needs, the test's critical value (5 % over its nine tests), weight of the prior and purity at which a template is blocked.
SUPPORT, CRITICAL, WEIGHT, REJECT = 5, 2.77, 4.0, 0.8
ANY, END, NUMBER = "*", "", "{n}"
#: Segments of a path that are hashed together.
BLOCK = 256


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """A path without empty segments, with digits as a wildcard."""
    return F.btrim(F.regexp_replace(F.regexp_replace(path, "[0-9]+", "{n}"), "/+", "/"), F.lit("/"))


def segments(shape: Column) -> Column:
    return F.filter(F.split(shape, "/"), lambda s: s != "")


def prefixes(segs: Column) -> Column:
    """Hashes of all prefixes of a list, that of the empty one first.

    Lists grow in blocks, so a path of very many segments isn't copied for each of them.
    """
    last = lambda xs: F.element_at(xs, -1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(segs) / BLOCK).cast("int")), lambda i: F.slice(segs, i * BLOCK + 1, BLOCK))
    grown = lambda start, block: F.aggregate(
        block, F.array(start), lambda xs, s: F.concat(xs, F.array(F.xxhash64(last(xs), s))), lambda xs: F.slice(xs, 2, BLOCK)
    )
    # An empty block, which comes last if at all, has nothing to go on from.
    filled = F.filter(blocks, lambda b: F.size(b) > 0)
    root = F.array(F.array(F.lit(0).cast("long")))
    return F.flatten(F.aggregate(filled, root, lambda done, b: F.concat(done, F.array(grown(last(last(done)), b)))))


def places(host: Column, segs: Column) -> Column:
    """For each segment of a path its branch in three trees: pos, seg, parent, branch, leaf, numbered.

    The trees are those of the host's prefixes, of the host's positions whatever stands
    before, and of the prefixes on all hosts.
    """
    next_ = F.concat(F.slice(segs, 2, F.greatest(F.size(segs), F.lit(1))), F.array(F.lit(END)))
    each = let(prefixes(segs), lambda c: F.arrays_zip(c.alias("before"), F.slice(c, 2, F.greatest(F.size(c), F.lit(1))).alias("upto"), segs.alias("seg"), next_.alias("next")))

    def of(z: Column, i: Column) -> Column:
        seg, below = z["seg"], z["next"]
        keys = (
            (F.xxhash64(F.lit("host"), host, z["before"]), F.xxhash64(F.lit("host"), host, z["upto"])),
            (F.xxhash64(F.lit("at"), host, i), F.xxhash64(F.lit("at"), host, i, seg)),
            (F.xxhash64(F.lit("all"), z["before"]), F.xxhash64(F.lit("all"), z["upto"])),
        )
        more = (i.alias("pos"), (below == END).alias("leaf"), F.contains(below, F.lit(NUMBER)).alias("numbered"))
        return F.array(*(F.struct(p.alias("parent"), b.alias("branch"), *more) for p, b in keys))

    # The list of prefixes is one longer than that of segments.
    return F.flatten(F.transform(F.filter(each, lambda z: z["seg"].isNotNull()), of))


def differs(some: str, of: str) -> Column:
    """Whether a branch's share of ``some`` in ``of`` differs from that of its siblings, by the spreads of both shares, wide where few are known."""
    a, b = F.col(of) + 2, F.col(f"all_{of}") - F.col(of) + 2
    p, q = (F.col(some) + 1) / a, (F.col(f"all_{some}") - F.col(some) + 1) / b
    return F.abs(p - q) / F.sqrt(p * (1 - p) / (a + 1) + q * (1 - q) / (b + 1)) >= CRITICAL


def branches(each: DataFrame) -> DataFrame:
    """The branches that stand for themselves; all others are the wildcard of their parent."""
    sums = ("n", "labelled", "bad", "leaf", "numbered")
    at = lambda c: F.when(F.col(f"at.{c}"), F.col("n")).otherwise(F.lit(0))
    rows = each.select("n", "labelled", "bad", F.col("at.parent"), F.col("at.branch"), at("leaf").alias("leaf"), at("numbered").alias("numbered"))
    nodes = saved(rows.groupBy("parent", "branch").agg(*(F.sum(c).alias(c) for c in sums)))
    parents = saved(nodes.groupBy("parent").agg(*(F.sum(c).alias(f"all_{c}") for c in sums)))
    own = differs("bad", "labelled") | differs("leaf", "n") | differs("numbered", "n")
    return nodes.where(F.col("n") >= SUPPORT).join(parents, "parent").where(own).select("branch")


def templates(counts: DataFrame) -> DataFrame:
    """host, shape, template, purity and blocked.

    ``counts`` has one row for each host and shape: n, labelled and bad.
    """
    counts = saved(counts.withColumn("id", F.md5(F.concat("host", F.lit("/"), "shape"))))
    # Explode repeats all other columns for each segment, so the shape itself stays behind.
    each = counts.select("id", "n", "labelled", "bad", F.explode(places(F.col("host"), segments(F.col("shape")))).alias("at"))
    kept = few(branches(each))
    own = each.select("id", F.col("at.branch"), F.col("at.pos")).join(kept, "branch", "left_semi").groupBy("id").agg(F.collect_set("pos").alias("own"))
    named = F.transform(segments(F.col("shape")), lambda s, i: F.when(F.array_contains("own", i), s).otherwise(F.lit(ANY)))
    template = F.when(F.col("shape") == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(named, "/")))
    level = counts.join(own, "id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    level = saved(level.select("host", "shape", template.alias("template"), "labelled", "bad"))
    sums = lambda stem="": (F.sum("labelled").alias(f"{stem}labelled"), F.sum("bad").alias(f"{stem}bad"))
    every = level.agg(*sums()).first()
    share = ((every["bad"] or 0) + 1) / ((every["labelled"] or 0) + 2)
    smooth = lambda bad, labelled, prior: (bad + WEIGHT * prior) / (labelled + WEIGHT)
    odds = lambda p: F.ln(p / (1 - p))
    judged = saved(level.groupBy("host", "template").agg(*sums()))
    hosts, others = few(judged.groupBy("host").agg(*sums("host_"))), few(judged.groupBy("template").agg(*sums("all_")))
    of_host = smooth(F.col("host_bad"), F.col("host_labelled"), F.lit(share))
    elsewhere = smooth(F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled"), F.lit(share))
    prior = 1 / (1 + F.exp(odds(F.lit(share)) - odds(of_host) - odds(elsewhere)))
    judged = judged.join(hosts, "host").join(others, "template").select("host", "template", smooth(F.col("bad"), F.col("labelled"), prior).alias("purity"))
    return level.select("host", "shape", "template").join(judged, ["host", "template"]).withColumn("blocked", F.col("purity") >= REJECT)


def judge(df: DataFrame, rules: list[UrlRule], label: Column | None = None, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict, template and the template's purity.

    ``label`` (1 bad, 0 good, null unknown) is a column of ``df``; without it the
    verdicts of the rules are the labels.
    """
    outs = ("host", "path", "rule", "verdict", "template", "purity")
    kept = [c for c in df.columns if c.lower() not in outs]
    host, path = parts(F.col(f"`{url}`"))
    # The table's own columns stand in one struct, so none of them can clash with a helper.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row") if kept else F.lit(None).alias("row"), host.alias("host"), path.alias("path"), (F.lit(None) if label is None else label).cast("double").alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("of_rule"), shape(F.col("path")).alias("shape"))
    known = F.col("label") if label is not None else F.when(F.col("of_rule") == "block", 1.0).when(F.col("of_rule") == "allow", 0.0)
    counts = rows.select("host", "shape", known.alias("known")).groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("known").alias("labelled"), F.coalesce(F.sum("known"), F.lit(0.0)).alias("bad")
    )
    found = templates(counts)
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    out = rows.join(found, ["host", "shape"])
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "host", "path", "rule", F.coalesce("of_rule", method).alias("verdict"), "template", "purity")
