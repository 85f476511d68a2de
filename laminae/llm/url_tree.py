r"""URL filters: host and path rules, and a path-template tree for what no rule decides.

The longest rule that fits decides a URL. URLs decided so are the labelled sample of the tree. Level
by level, under each node of a host, path segments are generalised: runs of digits become their
first digit and ``#`` (a variable segment); segments too rare to be a branch become ``*``; branches
whose share of blocked URLs does not differ significantly from that of their siblings are merged
into ``*``, and so are variable ones of which no label tells. A leaf is a template of its host. The
same tree over all hosts together gives a shared template. A template's purity is its share of
blocked URLs among the labelled, smoothed towards that of the shared template, and that one's
towards the share among all labels; templates of high purity are rejected, all others allowed.

A null URL, or one without ``://``, has an empty host and path. Paths are judged whole, however long
or deep. An empty table gives an empty result. Rows that repeat count as often as they occur. Only
page_id and url are read; further columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import compact, durable
from .lookup import lookup

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A branch has so many URLs at least.
LEAST_URLS = 5
#: Standard errors from which a branch's share of blocked URLs differs from its siblings'.
DIFFERENT = 1.96
#: Weight of the shared template's purity in a template's (and of all labels' in that), and the purity from which a template is rejected.
SMOOTHING, REJECTED = 4.0, 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """A struct ``verdict, rule`` of the longest rule that fits, or null."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(rule_name(r))):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.struct(F.lit(rule[0]).alias("verdict"), F.lit(rule_name(rule)).alias("rule"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Path segments, runs of digits made their first digit and ``#``."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "([0-9])[0-9]*", "$1#"), "/")


def templates(rows: DataFrame, root: str = "host", name: str = "template") -> DataFrame:
    """Add the column ``name`` to rows ``host, segments, bad`` (1, 0 or null, by label); the trees' roots are the values of ``root``.

    A level is two aggregations with sums in each task first, so a host with a third of all URLs
    costs no more than another, and a lookup of the branches that stay. Rows whose path has ended are
    done; when no branch has ``LEAST_URLS`` rows any more, all that is left is ``*``.
    """
    columns, done = rows.columns, []
    rows = durable(rows.withColumn(name, F.col(root)).withColumn("__left", F.col("segments")))
    while True:
        rows = rows.withColumn("__seg", F.get("__left", F.lit(0)))
        branches = rows.groupBy(name, "__seg").agg(F.count("*").alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("hit"))
        parents = branches.groupBy(F.col(name).alias("__of")).agg(*(F.sum(c).alias(f"all_{c}") for c in ("seen", "hit")))
        branches = branches.filter(F.col("n") >= LEAST_URLS).join(parents, F.col(name).eqNullSafe(F.col("__of")))
        others, other_hit = F.col("all_seen") - F.col("seen"), F.col("all_hit") - F.col("hit")
        pooled = F.try_divide(F.col("all_hit"), F.col("all_seen"))
        gap = F.try_divide(F.col("hit"), F.col("seen")) - F.try_divide(other_hit, others)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("seen")) + F.try_divide(F.lit(1.0), others)))
        # Without labels on both sides nothing says that a branch is like its siblings: it stays, unless it is variable.
        unknown = (F.col("seen") == 0) | (others == 0)
        stays = F.when(unknown, ~F.col("__seg").contains("#")).otherwise(F.abs(gap) > DIFFERENT * error)
        branches, n_branches = compact(branches.select(name, "__seg", stays.alias("__kept")))
        if n_branches:
            rows = lookup(rows, branches.filter("__kept"), [name, "__seg"], "page_id", rows=n_branches)
            token = F.when(F.col("__kept"), F.col("__seg")).otherwise("*")
            rows = rows.withColumn(name, F.concat_ws("/", name, token)).withColumn("__left", F.slice("__left", 2, F.greatest(F.size("__left") - 1, F.lit(0))))
            rows = durable(rows.drop("__seg", "__kept"))
        tail = F.concat(F.col(name), F.array_join(F.transform("__left", lambda _: F.lit("/*")), ""))
        ended = rows.filter(F.size("__left") == 0) if n_branches else rows
        done.append(ended.select(*columns, tail.alias(name)))
        if not n_branches:
            return reduce(lambda a, b: a.unionByName(b), done)
        rows = rows.filter(F.size("__left") > 0)


def purities(rows: DataFrame) -> DataFrame:
    """Add ``template``, ``shared`` (the template over all hosts) and ``purity`` to rows ``page_id, host, segments, bad``."""
    rows = templates(rows)
    rows = templates(rows.withColumn("__all", F.lit("")), "__all", "shared").drop("__all")
    seen, hit = rows.agg(F.count("bad"), F.sum("bad")).first()
    prior = (hit or 0) / seen if seen else 0.0
    shared = rows.groupBy("shared").agg(((F.sum(F.coalesce("bad", F.lit(0))) + SMOOTHING * prior) / (F.count("bad") + SMOOTHING)).alias("__over"))
    own = rows.groupBy("template").agg(F.sum(F.coalesce("bad", F.lit(0))).alias("__hit"), F.count("bad").alias("__seen"))
    rows = lookup(lookup(rows, shared, ["shared"], "page_id"), own, ["template"], "page_id")
    return rows.withColumn("purity", (F.col("__hit") + SMOOTHING * F.col("__over")) / (F.col("__seen") + SMOOTHING)).drop("__hit", "__seen", "__over")


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, shared, purity`` of every row of ``pages``."""
    rows = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    bad = F.when(F.col("found").isNotNull(), (F.col("found.verdict") == "block").cast("int"))
    rows = purities(rows.withColumns({"segments": segments(F.col("path")), "bad": bad}))
    method = F.when(F.col("purity") >= REJECTED, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "template", "shared", "purity"
    )
