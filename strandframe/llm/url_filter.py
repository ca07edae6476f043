"""Urls judged by rules for hosts and paths, and hosts that no rule fits by what links say of them.

Trust begins at hosts with pages that a rule allows and follows links; distrust begins at hosts with pages that a rule
blocks and follows links backwards, to hosts that link to such ones. Both are personalised PageRank, summed as a series: what
a host passes on is KEEP percent of its mass, in equal parts to its links, in each of ROUNDS rounds. Masses are whole numbers,
so reruns and other engines agree on every digit. A host of which distrust is the larger share is blocked.

Everything is built-in DataFrame functions. Rounds move one row a host; each is stored, so no plan grows with them. A host
with many links has them spread over salts, as many as its links ask for, and mass goes to each salt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expose, lookup_join, lower_ascii, stored

#: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ROUNDS, KEEP, UNIT = 20, 85, 1 << 20
#: Links of a host that one salt has.
LINKS = 10_000
#: Longer names are no host names; they have no parent.
NAME = 253
#: What follows href= up to the host: a scheme or none, and two slashes.
HREF = r"""[hH][rR][eE][fF]=["']?(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#"'<> ]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first :// and the next / ? # in lower case (A-Z only), and what follows up to ? or #; empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as its text, and its verdict; null where none fits. Of equally long ones the longer host, then block."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    none = F.lit(None).cast("string")
    first = lambda value: F.coalesce(*(F.when(_fits(host, path, r), F.lit(value(r))) for r in ordered), none)
    return first(lambda r: r[0] + r[1]), first(lambda r: r[2])


def links(pages: DataFrame) -> DataFrame:
    """src, dst: each two different hosts of which a page of the first has a link to the second. pages: host, html."""
    hosts = F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lower_ascii)
    found = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(hosts)).alias("dst"))
    return found.where("src != dst").distinct()


def parents(hosts: DataFrame) -> DataFrame:
    """src, dst: each host with the nearest domain above it that is a host as well, in both directions. hosts: host, each once."""
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    named = hosts.where((F.char_length("host") <= NAME) & (F.instr("host", ".") > 0))
    up = named.select(F.col("host").alias("low"), F.posexplode(above).alias("steps", "up"))
    known = lookup_join(up, hosts.select(F.col("host").alias("up")), "up", "inner")
    near = known.groupBy("low").agg(F.min_by("up", "steps").alias("up"))
    return near.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("low").alias("dst")))).alias("x")).select("x.*")


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, keep: int = KEEP) -> DataFrame:
    """kind, host, mass: seeds (the same columns, each host once a kind) and all that they pass on along edges (kind, src, dst, each once)."""
    degrees = edges.groupBy("kind", F.col("src").alias("host")).agg(F.count(F.lit(1)).alias("degree"))
    degrees = stored(degrees.withColumn("salts", F.ceil(F.col("degree") / LINKS).cast("int")))
    salted = edges.join(degrees.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", "src", "dst", F.pmod(F.xxhash64("dst"), "salts").cast("int").alias("salt"))
    salted = stored(salted)
    state = stored(seeds)
    all_rounds = [state]
    for _ in range(rounds):
        part = F.expr(f"mass * {keep} div (100 * degree)")
        out = state.join(degrees, ["kind", "host"]).select("kind", F.col("host").alias("src"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        moved = out.where("part > 0").join(salted, ["kind", "src", "salt"])
        state = stored(moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum("part").alias("mass")))
        if state.isEmpty():
            break
        all_rounds.append(state)
    total = all_rounds[0]
    for s in all_rounds[1:]:
        total = total.unionByName(s)
    return total.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def distrusted(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust, blocked for each host that mass reaches. judged: host, by_rule, n (pages); edges: src, dst, each once.

    The masses are compared as shares of what each kind began with.
    """
    seeds = stored(judged.where("host != '' and by_rule is not null").select(F.col("by_rule").alias("kind"), "host", (F.col("n") * UNIT).alias("mass")))
    began = {r.kind: float(r.mass) for r in seeds.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    both = F.array(F.struct(F.lit("allow").alias("kind"), "src", "dst"), F.struct(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    mass = propagated(seeds, edges.select(F.explode(both).alias("x")).select("x.*"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0))
    out = mass.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    against = lambda name, other: F.col(name).cast("double") * F.lit(began.get(other, 1.0))
    return out.withColumn("blocked", against("distrust", "allow") > against("trust", "block"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    A url that is null or has no :// has an empty host and path. Pages without a host take no part in the graph; those and
    pages of hosts that neither trust nor distrust reaches are allowed where no rule says otherwise. A tie is no distrust.
    Null pages have no links; a page counts once a row, links of a page and pages of a host count once an edge. An empty table
    gives no rows. rules are few: they become one expression.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    text, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", text.alias("rule"), verdict.alias("by_rule"))
    linked = stored(links(pages.select(host.alias("host"), F.col(html_col).alias("html"))))
    judged = stored(rows.groupBy("host", "by_rule").agg(F.count(F.lit(1)).alias("n")))
    names = judged.select("host").union(linked.select("src")).union(linked.select("dst"))
    hosts = stored(names.where("host != ''").distinct())
    edges = stored(linked.unionByName(parents(hosts)).distinct())
    blocked = stored(distrusted(judged, edges).select("host", "blocked"))
    found = lookup_join(rows, blocked, "host")
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"))


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_HREF = HREF.replace("'", "''")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {_RULES}) AS r(rh, rp, rv)),
p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
hp AS (SELECT DISTINCT host, path FROM h),
best AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS by_rule
  FROM hp JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
j AS (SELECT h.*, rule, by_rule FROM h LEFT JOIN best USING (host, path)),
linked AS (SELECT DISTINCT host AS src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS dst FROM h WHERE host <> '')),
hosts AS (SELECT host FROM h WHERE host <> '' UNION SELECT src FROM linked UNION SELECT dst FROM linked),
up AS (SELECT a.host AS low, arg_max(b.host, length(b.host)) AS up FROM hosts a JOIN hosts b ON ends_with(a.host, '.' || b.host) WHERE length(a.host) <= {NAME} GROUP BY a.host),
e AS (SELECT src, dst FROM linked WHERE src <> dst UNION SELECT low, up FROM up UNION SELECT up, low FROM up),
both_ AS (SELECT 'allow' AS kind, src, dst FROM e UNION ALL SELECT 'block', dst, src FROM e),
edges AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM both_),
seeds AS (SELECT by_rule AS kind, host, (count(*) * {UNIT})::BIGINT AS mass FROM j WHERE host <> '' AND by_rule IS NOT NULL GROUP BY ALL),
w AS (SELECT 0 AS k, kind, host, mass FROM seeds
  UNION ALL SELECT w.k + 1, w.kind, e.dst, sum(w.mass * {KEEP} // (100 * e.degree))::BIGINT FROM w JOIN edges e ON e.kind = w.kind AND e.src = w.host WHERE w.k < {ROUNDS} AND w.mass * {KEEP} // (100 * e.degree) > 0 GROUP BY ALL),
began AS (SELECT coalesce(sum(mass) FILTER (kind = 'allow'), 1)::DOUBLE AS a, coalesce(sum(mass) FILTER (kind = 'block'), 1)::DOUBLE AS b FROM seeds),
per AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'allow'), 0)::DOUBLE AS t, coalesce(sum(mass) FILTER (kind = 'block'), 0)::DOUBLE AS d FROM w GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN d * a > t * b THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN per ON per.host = j.host CROSS JOIN began
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(expose(spark).read.parquet(f"{sf_dir}/pages.parquet"))
