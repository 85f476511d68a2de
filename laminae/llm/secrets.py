r"""Secrets in texts, in DataFrame operations alone.

Three fixed patterns give base spans. Beside them, long tokens are scored by two character Markov
models, of random strings and of ordinary identifiers, trained from labelled samples: where the
log-likelihood ratio of the characters speaks for a random string, the token is a further span. The
ratio that it takes is calibrated on samples that the models have not seen. Base spans stay as they
are; the models say of each whether its value looks random.

Offsets are code points, ends exclusive. A null or empty text has no spans. Texts of any length are
scanned whole, in time that grows with their length and not with the square of their matches. Spans
of equal start: in the order of the kinds. Rows that repeat are rows of their own; an empty table
gives an empty result. Only doc_id and text are read; further columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the base kinds match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

KINDS = ("assign", "access", "hex", "markov")
#: Characters of the models and of the tokens they judge.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
#: A token is a span when the ratio is at least so much in all (nats), and more a character than that of so many of the unseen ordinary samples.
LEAST_RATIO, ORDINARY = 12.0, 0.999
#: Every so-many-th sample calibrates and does not teach.
UNSEEN = 4
#: Matches that one step of a scan appends to a list; a list of lists holds the steps.
AT_ONCE = 128

# Words of which ordinary identifiers are put together.
WORDS = (
    "get set user name max min retry count page index value item list map key data file path read write open close start stop init config option "
    "default handler request response client server connection session cache buffer stream parse format string number array object create update "
    "delete insert select table column row field type class method function module package import export test check error warning message event "
    "listener callback timeout interval thread process queue stack node tree graph edge vertex color width height size length offset limit total "
    "average first last next previous current parent child root leaf source target input output result status state mode flag"
).split()


def labelled_samples(spark: SparkSession, n: int = 12000) -> DataFrame:
    """``text, label``, the same each time: ``n`` random strings (1: hexadecimal, base 64 and its URL form, letters and digits, capitals and
    digits) and ``n`` ordinary ones (0: identifiers and paths of words, numbers, times, rulers)."""
    i = F.col("id")
    raw = F.concat(F.sha2(i.cast("string"), 256), F.sha2(F.concat(i.cast("string"), F.lit("+")), 256))
    dense = F.translate(F.base64(F.unhex(raw)), "=\r\n", "")
    length = F.pmod(F.xxhash64(i, F.lit(-1)), F.lit(29)).cast("int") + 20
    drawn = (
        F.when(i % 6 == 0, raw)
        .when(i % 6 == 1, dense)
        .when(i % 6 == 2, F.translate(dense, "+/", "-_"))
        .when(i % 6 == 3, F.translate(dense, "+/", ""))
        .when(i % 6 == 4, F.lower(F.translate(dense, "+/", "")))
        .otherwise(F.upper(F.translate(dense, "+/", "")))
    )
    word = lambda j: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(i, F.lit(j)), F.lit(len(WORDS))) + 1).cast("int"))
    parts = [word(j) for j in range(5)]
    digits = F.translate(raw, "abcdef", "012345")
    joined = (
        F.when(i % 9 == 0, F.concat_ws("_", *parts))
        .when(i % 9 == 1, F.concat_ws("-", *parts))
        .when(i % 9 == 2, F.concat(parts[0], *(F.initcap(p) for p in parts[1:])))
        .when(i % 9 == 3, F.upper(F.concat_ws("_", *parts)))
        .when(i % 9 == 4, F.concat(F.concat_ws("/", *parts), F.lit("/"), (i % 1000).cast("string")))
        .when(i % 9 == 5, F.concat(*parts))
        .when(i % 9 == 6, F.substring(digits, 1, 40))
        .when(i % 9 == 7, F.concat_ws("-", F.lit("20") + (i % 100), *(F.substring(digits, 3 * j + 1, 2) for j in range(6))))
        .otherwise(F.repeat(F.element_at(F.split(F.lit("- = _ / + 0 x * # ="), " "), (i % 10 + 1).cast("int")), 40))
    )
    ids = spark.range(n)
    random = ids.select(F.substring(drawn, F.lit(1), length).alias("text"), F.lit(1).alias("label"), "id")
    return random.unionByName(ids.select(joined.alias("text"), F.lit(0).alias("label"), "id")).select("text", "label", (i % UNSEEN == 0).alias("unseen"))


@dataclass(frozen=True)
class Models:
    """The log-ratio of each step between two characters, row by row of ``ALPHABET``, and the ratio a character from which a token is random."""

    steps: list[float]
    least: float


def train(samples: DataFrame) -> Models:
    """Count the steps of the seen samples, then calibrate on the unseen ones; at most two counts a step reach the driver."""
    chars = F.filter(F.split("text", ""), lambda c: (F.length(c) == 1) & F.lit(ALPHABET).contains(c))
    pairs = lambda c: F.arrays_zip(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))).alias("a"), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))).alias("b"))
    steps = samples.filter("not unseen").select("label", chars.alias("c")).select("label", F.explode(pairs(F.col("c"))).alias("s"))
    counts: dict = {0: {}, 1: {}}
    for label, a, b, n in steps.groupBy("label", "s.a", "s.b").count().collect():
        counts[label][a, b] = n
    size = len(ALPHABET)
    totals = {k: {a: sum(counts[k].get((a, b), 0) for b in ALPHABET) for a in ALPHABET} for k in (0, 1)}
    chance = lambda k, a, b: math.log((counts[k].get((a, b), 0) + 0.5) / (totals[k][a] + 0.5 * size))
    table = [chance(1, a, b) - chance(0, a, b) for a in ALPHABET for b in ALPHABET]
    ordinary = samples.filter("unseen and label = 0").filter(F.col("text").rlike(f"^{TOKEN}$"))
    least = ordinary.agg(F.percentile_approx(log_ratio(F.col("text"), table) / F.length("text"), F.lit(ORDINARY), F.lit(10_000))).first()[0]
    return Models(table, max(0.0, least or 0.0))


def log_ratio(token: Column, table: list[float]) -> Column:
    """Sum of the table over a token's steps. Characters are numbered once, so long tokens stay linear."""
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def total(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.get(F.lit(table), a * len(ALPHABET) + b))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

    return let(F.filter(at, lambda n: n >= 0), total)


def looks_random(token: Column, models: Models) -> Column:
    """Whether the ratio of a token is high enough, in all and a character."""
    enough = lambda r: (r >= LEAST_RATIO) & (r > F.lit(models.least) * F.length(token))
    return let(log_ratio(token, models.steps), enough)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The results (of type ``kind``) of ``step(state, item) -> state, result`` for each item in order.

    A list is copied for each append, so results are gathered in lists of ``AT_ONCE`` and these in a list.
    """

    def block(items: Column, state: Column) -> Column:
        def one(s: Column, item: Column) -> Column:
            state, result = step(s["state"], item)
            return F.struct(state.alias("state"), F.concat(s["out"], F.array(result)).alias("out"))

        return F.aggregate(items, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)

    def all_blocks(items: Column) -> Column:
        def next_block(s: Column, i: Column) -> Column:
            join = lambda b: F.struct(b["state"].alias("state"), F.concat(s["out"], F.array(b["out"])).alias("out"))
            return let(block(F.slice(items, i * AT_ONCE + 1, F.lit(AT_ONCE)), s["state"]), join)

        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        last = F.floor((F.size(items) - 1) / AT_ONCE).cast("int")
        return F.aggregate(F.sequence(F.lit(0), last), start, next_block, lambda s: F.flatten(s["out"]))

    return let(items, lambda v: F.when(F.size(v) > 0, all_blocks(v)).otherwise(F.array().cast(f"array<{kind}>")))


_SPAN = "struct<start: int, rank: int, end: int, text: string, value: string>"
_NO_SPANS = f"array<{_SPAN}>"


def _span(start: Column, rank: Column, end: Column, text: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), text.alias("text"), value.alias("value"))


def _spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """Spans of the matches whose ``group`` has ``least`` characters, from the lengths of what lies between and within them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.transform(F.split(text, pattern), F.length)
    rows = F.arrays_zip(whole.alias("m"), judged.alias("g"), F.slice(between, 1, F.size(whole)).alias("gap"))

    def step(at: Column, r: Column) -> tuple[Column, Column]:
        end = at + r["gap"] + F.length(r["m"])
        return end, _span(at + r["gap"], F.lit(KINDS.index(kind)), end, r["m"], r["g"])

    found = scan(rows, F.lit(0), step, _SPAN)
    found = F.filter(found, lambda s: F.length(s["value"]) >= least) if least else found
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(_NO_SPANS))


def _clear(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no base span: in order, none that started before is still open, and none starts before a token ends."""
    base_rank = len(KINDS) - 1
    kept = f"struct<span: {_SPAN}, clear: boolean>"
    ordered = F.array_sort(F.concat(base, tokens))

    def forth(open_until: Column, s: Column) -> tuple[Column, Column]:
        clear = (s["rank"] == base_rank) & (s["start"] >= open_until)
        return F.when(s["rank"] == base_rank, open_until).otherwise(F.greatest(open_until, s["end"])), F.struct(s.alias("span"), clear.alias("clear"))

    def back(next_start: Column, x: Column) -> tuple[Column, Column]:
        s = x["span"]
        clear = x["clear"] & (s["end"] <= next_start)
        return F.when(s["rank"] == base_rank, next_start).otherwise(s["start"]), F.struct(s.alias("span"), clear.alias("clear"))

    marked = scan(F.reverse(scan(ordered, F.lit(0), forth, kept)), F.lit(2**31 - 1), back, kept)
    clear = F.transform(F.filter(marked, lambda x: x["clear"]), lambda x: x["span"])
    return F.when(F.size(tokens) == 0, F.array().cast(_NO_SPANS)).when(F.size(base) == 0, tokens).otherwise(clear)


def secret_spans(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, base, markov, spans``: arrays of ``start, rank (of KINDS), end, text, value``, by start and rank.

    ``base`` has ``random`` too: whether the models take its value for a random string. A Markov span
    never overlaps a base span. Everything happens within a row: no shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        _spans(text, ASSIGN, "assign", LEAST_VALUE, 2).alias("a"),
        _spans(text, ACCESS, "access").alias("k"),
        _spans(text, HEX, "hex").alias("h"),
        _spans(text, TOKEN, "markov").alias("t"),
    ).select("doc_id", F.array_sort(F.concat("a", "k", "h")).alias("plain"), "t")
    clear = let(F.struct(F.col("plain").alias("base"), F.col("t").alias("tokens")), lambda v: _clear(v["base"], v["tokens"]))
    rows = rows.withColumn("markov", F.array_sort(F.filter(clear, lambda t: looks_random(t["value"], models))))
    judged = F.transform("plain", lambda s: s.withField("random", looks_random(s["value"], models)))
    return rows.select("doc_id", judged.alias("base"), "markov", F.array_sort(F.concat("plain", "markov")).alias("spans"))


def listed(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
