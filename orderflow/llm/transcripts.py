"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript comes in ordered parts (messages, paragraphs, or one text with all turns);
each part is cut into lines, and each line is described by a few categorical features: a
speaker marker at its start ("User:", "Assistant -"), whether it is its part's first, its
length, its last character, bullets and code. The hidden states are (role, begins or
continues). Emissions and moves are smoothed counts over labelled parts, tables of a
size that features x states bound. Markers and places are known and not learned: a share
``MARKED`` of turns is taken to begin with a marker of its role, whether labelled parts
have markers or not, and turns begin with a part or inside one, as in one text of many
turns. A value never seen tells no state from another.
Viterbi gives the best states of each transcript; runs of one role become turns, which
are rendered in one canonical form.

A transcript is decoded in blocks of consecutive lines: each block gives a max-plus
matrix over its first and last states, the matrices of a transcript are combined, and
each block is then traced between its known ends. So no task holds a whole long
transcript, and the result is exactly Viterbi's. Blocks are ranges of parts; where such a
range has too many lines, as with one very long text or many parts under one number, they
are ranges of the parts' hashes and of lines.

Defined cases: null parts are empty and have one empty line; ties go to the state first
in order; rows with null key form one transcript; parts under the same number, or none,
follow one another by the hash of their text, equal ones are decoded once; without
labelled rows every role is ``unknown``; an empty table gives an empty table. Only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, saved

#: Parts in a block, and lines beyond which its parts are blocks of their own, cut after so many lines.
BLOCK, LINES = 1024, 1 << 14
#: Share of turns that begin with a marker of their role, of these with another role's, and of other lines with any.
MARKED, WRONG, STRAY = 0.3, 0.01, 0.005
#: Share of continuing lines that stand first in a part.
LATE = 0.0005
#: Words that name a speaker at the start of a line.
SPEAKERS = {"user": "user human customer question q you", "assistant": "assistant bot ai model answer a agent", "system": "system instruction instructions prompt context"}
MARKER = r"^\s*[\[<(*#]*\s*([A-Za-z]+)\s*[\]>)*]*\s*[:>|-]\s*"
#: Lines that the shares of all lines weigh as in each state's counts.
PRIOR = 10
FEATURES = ("marker", "place", "length", "end", "kind")
FIRST, INNER = "first", "inner"


def speaker(line: Column) -> Column:
    """The role that a line's marker names, else an empty string."""
    word = F.lower(F.regexp_extract(line, MARKER, 1))
    out = F.lit("")
    for role, words in SPEAKERS.items():
        out = F.when(word.isin(words.split()), F.lit(role)).otherwise(out)
    return out


def lines(df: DataFrame, key: str, part: str, text: str, role: str | None = None, carried: str | None = None) -> DataFrame:
    """key, part, copy, line, text, of (lines of the part), role, n (``carried``, else 1) and one column for each feature."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{part}`").alias("part"), (F.col(f"`{role}`") if role else F.lit(None).cast("string")).alias("role"),
        (F.col(f"`{carried}`") if carried else F.lit(1)).alias("n"), F.posexplode(F.split(body, "\n")).alias("line", "text"), F.xxhash64(body).alias("copy"), F.size(F.split(body, "\n")).alias("of"),
    )
    t = F.col("text")
    bare = F.rtrim(t)
    return given.select(
        "key", "part", "copy", "role", "n", "line", "text", "of",
        speaker(t).alias("marker"),
        F.when(F.col("line") == 0, F.lit(FIRST)).otherwise(F.lit(INNER)).alias("place"),
        F.concat(F.lit("l"), F.floor(F.log2(F.length(t) + 1)).cast("string")).alias("length"),
        F.when(bare.endswith("?"), F.lit("?")).when(bare.endswith(":"), F.lit(":")).otherwise(F.lit("")).alias("end"),
        F.when(t.rlike(r"^\s*([-*•]|\d+[.)])\s"), F.lit("bullet")).when(t.rlike(r"^(\s{4}|```|.*[{};]\s*$)"), F.lit("code")).otherwise(F.lit("prose")).alias("kind"),
    )


class Model:
    """Log probabilities; states are role * 2 + (0: begins, 1: continues)."""

    def __init__(self, roles: list[str], first: np.ndarray, move: np.ndarray, emit: dict):
        self.roles, self.first, self.move, self.emit = roles, first, move, emit

    def emissions(self, rows: list[tuple]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.roles) * 2))
        for f in range(len(FEATURES)):
            table, other = self.emit[FEATURES[f]]
            out += np.array([table.get(r[f], other) for r in rows]).reshape(len(rows), -1)
        return out


def fit(labelled: DataFrame, key: str = "conv_id", part: str = "turn", text: str = "text", role: str = "role") -> Model:
    """Learns from rows with a role; counts are summed by Spark, and only the tables of counts reach the driver."""
    labelled = labelled.where(F.col(f"`{role}`").isNotNull())
    rows = lines(labelled, key, part, text, role)
    state = F.concat("role", F.when(F.col("line") == 0, F.lit("\x1fB")).otherwise(F.lit("\x1fI")))
    described = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES)))
    counts = rows.select(state.alias("state"), described.alias("x")).groupBy("state", "x.f", "x.v").agg(F.count("*").alias("n")).collect()
    roles = sorted({r["state"].split("\x1f")[0] for r in counts})
    index = {f"{r}\x1f{s}": 2 * k + i for k, r in enumerate(roles) for i, s in enumerate("BI")}
    n = len(index)
    emit = {}
    for f in FEATURES:
        mine = [r for r in counts if r["f"] == f]
        table, total = {}, np.zeros(n)
        for r in mine:
            total[index[r["state"]]] += r["n"]
            table.setdefault(r["v"], np.zeros(n))[index[r["state"]]] += r["n"]
        rest = total.sum() + len(table) + 1
        # Smoothed towards the value's share in all lines, so that a role of few lines gets no more of a rare value than others.
        emit[f] = ({v: np.log((c + PRIOR * (c.sum() + 1) / rest) / (total + PRIOR)) for v, c in table.items()}, np.full(n, -math.log(rest)))
    emit["marker"], emit["place"] = marked(roles), placed(roles)
    parts = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{part}`").alias("part"), F.col(f"`{role}`").alias("role"), F.size(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("lines"))
    # Summed before they meet, so parts repeated under one number don't multiply.
    turns = parts.groupBy("key", "part", "role").agg(F.count("*").alias("n"))
    after = turns.select("key", (F.col("part") - 1).alias("part"), F.col("role").alias("next"), F.col("n").alias("m"))
    pairs = turns.join(after, ["key", "part"]).groupBy("role", "next").agg(F.sum(F.least("n", "m")).alias("n")).collect()
    starts = parts.where("part = 0").groupBy("role").agg(F.count("*").alias("n")).collect()
    length = {r["role"]: r["m"] for r in parts.groupBy("role").agg(F.avg("lines").alias("m")).collect()}
    move, first = np.full((n, n), -math.inf), np.full(n, -math.inf)
    seen = np.ones((len(roles), len(roles)))
    for r in pairs:
        seen[roles.index(r["role"]), roles.index(r["next"])] += r["n"]
    begun = np.ones(len(roles))
    for r in starts:
        begun[roles.index(r["role"])] += r["n"]
    for i, r in enumerate(roles):
        first[2 * i] = math.log(begun[i] / begun.sum())
        stay = max(0.01, min(0.99, 1 - 1 / max(1.0, length.get(r, 1.0))))
        for s in (2 * i, 2 * i + 1):
            move[s, 2 * i + 1] = math.log(stay)
            for j in range(len(roles)):
                move[s, 2 * j] = math.log((1 - stay) * seen[i, j] / seen[i].sum())
    return Model(roles, first, move, emit)


def marked(roles: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Emissions of markers by MARKED, WRONG and STRAY; a role without words of its own has no marker."""
    known = [r for r in roles if r in SPEAKERS]
    table = {}
    for marker in ("", *SPEAKERS):
        p = []
        for r in roles:
            own = MARKED if r in known else 0.0
            begins = 1 - own if marker == "" else own * (1 - WRONG) if marker == r else max(own, MARKED) * WRONG / len(SPEAKERS)
            p += [begins, 1 - STRAY if marker == "" else STRAY / len(SPEAKERS)]
        table[marker] = np.log(np.array(p))
    return table, np.zeros(2 * len(roles))


def placed(roles: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Emissions of places: what begins stands first in its part or inside, what continues hardly ever first."""
    table = {FIRST: np.log([0.5, LATE] * len(roles)), INNER: np.log([0.5, 1 - LATE] * len(roles))}
    return table, np.zeros(2 * len(roles))


def through(model: Model, emitted: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best scores (rows: where it came from) of each last state, and for each line the best state before.

    ``start`` holds the scores of the states of the first line, one row for each way in.
    """
    score, back = start + emitted[0], []
    for e in emitted[1:]:
        ways = score[:, :, None] + model.move[None]
        back.append(ways.argmax(1))
        score = ways.max(1) + e
    return score, back


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Consecutive rows that agree in their first ``width`` columns; a run may span batches."""
    key, held = None, []
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns, strict=True):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``, a string in the order of part, copy and line, for a bounded number of lines."""
    span = F.coalesce(F.floor(F.col("part") / BLOCK).cast("long"), F.lit(-(1 << 53)))
    rows = rows.withColumn("span", span)
    many = rows.groupBy("key", "span").agg(F.count("*").alias("all")).where(F.col("all") > LINES)
    many = few(many.select(F.col("key").alias("k"), F.col("span").alias("s")))
    rows = rows.join(many, F.col("key").eqNullSafe(F.col("k")) & (F.col("span") == F.col("s")), "left")
    # Of parts under one number the hash's first bits tell blocks apart; a text of very many lines is cut by lines, after the others of those bits.
    at, bits = F.coalesce(F.pmod("part", F.lit(BLOCK)), F.lit(0)), F.shiftright("copy", 52) + 2048
    of_lines = F.when(F.col("of") > LINES, F.format_string("-%016x-%012d", F.col("copy"), F.floor(F.col("line") / LINES))).otherwise(F.lit(""))
    more = F.when(F.col("s").isNotNull(), F.concat(F.format_string("-%04d-%04d", at, bits), of_lines)).otherwise(F.lit(""))
    return rows.select("key", F.concat(F.format_string("%020d", F.col("span") + (1 << 54)), more).alias("block"), "part", "copy", "line", *FEATURES, "n", "text")


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """key, part, copy, line, text n and the line's role_pred and begins, from ``lines``."""
    state = len(model.roles) * 2
    order = ["key", "block", "part", "copy", "line"]
    dealt = saved(blocked(rows).repartition("key", "block").sortWithinPartitions(*order))
    key_type = rows.schema["key"].dataType.simpleString()
    arrow_type = pa.string() if key_type == "string" else pa.int64()
    out = pa.schema([("key", arrow_type), ("block", pa.string()), ("m", pa.list_(pa.float64()))])

    def matrices(batches):
        for (key, blk), held in runs(batches, 2):
            e = model.emissions([h[3:] for h in held])
            score, _ = through(model, e, np.vstack([model.first, model.move]))
            yield pa.RecordBatch.from_pydict({"key": [key], "block": [blk], "m": [score.ravel().tolist()]}, schema=out)

    def ends(t: pa.Table) -> pa.Table:
        """The last state of each block of one transcript."""
        t = t.sort_by("block")
        ms = np.array(t["m"].to_pylist()).reshape(len(t), state + 1, state)
        score, back = ms[0][0], []
        for m in ms[1:]:
            ways = score[:, None] + m[1:]
            back.append(ways.argmax(0))
            score = ways.max(0)
        last = [int(score.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        return pa.table({"key": t["key"], "block": t["block"], "before": pa.array([-1, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    # Only transcripts of more than one block are combined; the others are traced from their start to their best end.
    spans = dealt.groupBy("key").agg(F.min("block").alias("a"), F.max("block").alias("z")).where("a < z").select(F.col("key").alias("k"))
    long = dealt.join(spans, F.col("key").eqNullSafe(F.col("k")), "left_semi")
    sums = long.select("key", "block", "part", "copy", "line", *FEATURES).repartition("key", "block").sortWithinPartitions(*order).mapInArrow(matrices, f"key {key_type}, block string, m array<double>")
    known = sums.groupBy("key").applyInArrow(ends, f"key {key_type}, block string, before int, last int")
    known = known.withColumnsRenamed({"key": "k", "block": "b"})
    ready = dealt.join(known, F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b")), "left")
    ready = ready.select("key", "block", "part", "copy", "line", *FEATURES, "before", "last", "n", "text").repartition("key", "block").sortWithinPartitions(*order)
    schema = pa.schema([("key", arrow_type), ("part", pa.int64()), ("copy", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("text", pa.string()), ("role_pred", pa.string()), ("begins", pa.bool_())])

    def trace(batches):
        out, size = [], 0
        for (key, _), held in runs(batches, 2):
            before, last = held[0][-4], held[0][-3]
            start = model.first if before is None or before < 0 else model.move[before]
            score, back = through(model, model.emissions([h[3:] for h in held]), start[None])
            s = int(score[0].argmax()) if last is None else last
            states = [s]
            for b in reversed(back):
                states.append(int(b[0][states[-1]]))
            states.reverse()
            out += [(key, h[0], h[1], h[2], h[-2], h[-1], model.roles[s // 2], s % 2 == 0) for h, s in zip(held, states, strict=True)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return ready.mapInArrow(trace, f"key {key_type}, part long, copy long, line int, n int, text string, role_pred string, begins boolean")


def shown(decoded: DataFrame) -> DataFrame:
    """``decoded`` with each line's text without the marker that begins its turn."""
    bare = F.when(F.col("begins") & (speaker(F.col("text")) == F.col("role_pred")), F.regexp_replace("text", MARKER, "")).otherwise(F.col("text"))
    return decoded.withColumn("bare", bare)


def render(decoded: DataFrame) -> DataFrame:
    """key, part, copy, role_pred, n, ``turn_text`` and ``turns`` of each part.

    ``turns`` has role and text of each run of lines between beginnings, ``turn_text`` the
    same in the form ``<|role|>`` line end text. A part whose first line continues the
    role before it gets no header there; ``role_pred`` is its first line's role.
    """
    rows = F.struct("line", "role_pred", "begins", "bare")
    parts = shown(decoded).groupBy("key", "part", "copy").agg(F.sort_array(F.collect_list(rows)).alias("all"), F.first("n").alias("n"))
    line = lambda x: F.concat(F.when(x["begins"], F.concat(F.lit("<|"), x["role_pred"], F.lit("|>\n"))).otherwise(F.lit("")), x["bare"])
    starts = F.filter(F.transform("all", lambda x, i: F.when(x["begins"] | (i == 0), i)), lambda i: i.isNotNull())
    until = lambda i, at: F.coalesce(F.get("starts", at + 1), F.size("all")) - i
    turn = lambda i, at: F.struct(
        F.get("all", i)["role_pred"].alias("role"), F.array_join(F.transform(F.slice("all", i + 1, until(i, at)), lambda x: x["bare"]), "\n").alias("text")
    )
    parts = parts.withColumn("starts", starts)
    return parts.select(
        "key", "part", "copy", F.get("all", F.lit(0))["role_pred"].alias("role_pred"), F.array_join(F.transform("all", line), "\n").alias("turn_text"), F.transform("starts", turn).alias("turns"), "n",
    )


def parse(df: DataFrame, model: Model, key: str = "conv_id", part: str = "turn", text: str = "text") -> DataFrame:
    """key, part, role_pred, turn_text and turns for each row of ``df``; equal rows are decoded once and returned as often as they occur."""
    kind = df.schema[key].dataType
    as_type = "long" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string"
    rows = df.select(F.col(f"`{key}`").cast(as_type).alias("key"), F.col(f"`{part}`").cast("long").alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if not model.roles:
        turn = F.array(F.struct(F.lit("unknown").alias("role"), F.col("text").alias("text")))
        return rows.select(F.col("key").cast(kind), "part", F.lit("unknown").alias("role_pred"), F.col("text").alias("turn_text"), turn.alias("turns"))
    once = rows.groupBy("key", "part", "text").agg(F.count("*").cast("int").alias("n"))
    decoded = render(decode(lines(once, "key", "part", "text", carried="n"), model))
    return decoded.select(F.col("key").cast(kind), "part", "role_pred", "turn_text", "turns", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("z")).drop("z")
