"""URL filter: path rules first, then exact membership in a list of hosts by a cascade of Bloom filters.

Level 1 of the cascade holds the listed keys of the corpus; level 2 the keys of the corpus that are not listed but pass
level 1; level 3 the listed ones that pass level 2; and so on until no key is wrong. The key universe is complete (every
host of the corpus and each of its parent domains), so the first level that a key fails tells exactly whether it is
listed, with no join of urls against the list. Building takes DataFrame aggregates of bits over the distinct keys; what
reaches the driver, and every task as a literal, is the bits. The universe is cut by hash into cascades of max_filter_bits at
most, of which each key has one; all of them together are checked against MOST_BITS, and a larger list is an error.

Contract: one row per input row. A null url, or one without "://", has an empty host and path: no rule fits, no key is
listed, the verdict is allow. Repeated rows repeat; extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, materialize, table

#: Fixed values: (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The production list, as registrable domains; a listed domain holds for its subdomains too.
LISTED = [f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]
WORD = 64
#: Bits of all cascades together: 64 MB of literals. About a hundred million listed hosts fit.
MOST_BITS = 1 << 29


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased."""
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c, b.c, c."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        let(F.split(host, "[.]"), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    )


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)).cast("long") for i in range(hashes)]


def _build(keys: DataFrame, n: int, level: int, rate: float) -> Level:
    hashes = max(1, min(24, round(-math.log2(rate))))
    bits = max(WORD, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / WORD) * WORD)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    words = at.groupBy((F.col("p") / WORD).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(WORD)).cast("int"))).alias("b"))
    filled = [0] * (bits // WORD)
    for r in words.toLocalIterator():  # at most bits / 64 rows, whatever the number of keys
        filled[r.w] = r.b
    return Level(bits, hashes, filled)


def _passes(key: Column, level: Level, number: int) -> Column:
    words = F.array(*[F.lit(w).cast("long") for w in level.words]) if len(level.words) <= 64 else F.lit(level.words).cast("array<long>")
    tests = [F.getbit(F.element_at(words, (p / WORD).cast("int") + 1), F.pmod(p, F.lit(WORD)).cast("int")) == 1 for p in _positions(key, number, level.bits, level.hashes)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def build_cascade(universe: DataFrame, max_filter_bits: int = 1 << 27, most_bits: int = MOST_BITS) -> list[list[Level]]:
    """universe: distinct (key, listed). One cascade for each part of the universe by hash; a part is a list of levels."""
    total = universe.agg(F.count("*").alias("n"), F.count_if("listed").alias("r")).first()
    # Level 1 takes about log2(n / r) / ln 2 bits a listed key, those after it two bits a key together.
    need = total.r * (math.log2(max(2, total.n / max(1, total.r))) / math.log(2) + 4)
    if need > most_bits:
        raise ValueError(f"the list needs about {need:.0f} bits of filters, more than {most_bits}")
    parts = max(1, math.ceil(need / max_filter_bits))
    cascades = []
    for part in range(parts):
        own = universe.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)) == part) if parts > 1 else universe
        ins, outs = own.where("listed").select("key"), own.where("not listed").select("key")
        n_in, n_out = ins.count(), outs.count()
        levels: list[Level] = []
        while n_in:
            rate = min(0.5, max(1e-7, n_in / (math.sqrt(2) * max(1, n_out)))) if not levels else 0.5
            levels.append(_build(ins, n_in, len(levels), rate))
            number = len(levels) - 1
            ins, outs = outs.where(_passes(F.col("key"), levels[-1], number)), ins
            n_in, n_out = ins.count(), n_in
        cascades.append(levels)
    return cascades


def is_listed(key: Column, cascades: list[list[Level]]) -> Column:
    """Exact for keys of the universe: the level that a key fails first is one of the other side."""

    def one(levels: list[Level]) -> Column:
        out = F.lit(len(levels) % 2 == 1)
        for number in reversed(range(len(levels))):
            out = F.when(_passes(key, levels[number], number), out).otherwise(F.lit(number % 2 == 1))
        return out

    if len(cascades) == 1:
        return one(cascades[0])
    part = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(cascades)))
    out = F.lit(False)
    for k, levels in enumerate(cascades):
        out = F.when(part == k, one(levels)).otherwise(out)
    return out


def key_universe(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (key, listed) of all hosts and their parent domains. hosts: column host; listed: column key."""
    keys = hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).groupBy("key").agg(F.lit(False).alias("listed"))
    return keys.unionByName(listed.select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.bool_or("listed").alias("listed"), F.count_if(~F.col("listed")).alias("seen")).where("seen > 0").drop("seen")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", key: str = "page_id", max_filter_bits: int = 1 << 27) -> DataFrame:
    """key, host, path, rule, verdict. listed: a column key of host names; a name holds for its subdomains."""
    parsed = pages.select(pages[key].alias(key), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    universe = materialize(key_universe(parsed.select("host").groupBy("host").agg(F.lit(1)).select("host"), listed), "url-keys")
    cascades = build_cascade(universe, max_filter_bits)
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    blocked = F.exists(suffixes(F.col("host")), lambda k: is_listed(k, cascades))
    return parsed.select(key, "host", "path", rule.alias("rule"), F.coalesce(action, F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    return filter_urls(table(spark, sf_dir, "pages"), listed)


_NAMES = "|".join(sorted({d.split(".")[0] for d in LISTED}))
ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN regexp_matches(host, '(^|[.])({_NAMES})[.]example[.](com|net|org)$') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": ORACLE}
