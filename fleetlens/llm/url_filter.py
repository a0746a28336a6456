"""URL filters by a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, sent, written

#: A cascade's filters travel inside the plan; keys whose filters would take more bits are dealt to shards by hash, each with a cascade and a pass of its own.
MAX_BITS = 1 << 18
#: Of the keys that aren't a level's own, the share that a level after the first takes for its own: the least bits in all.
MISTAKEN = 0.5


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number in the cascade, its numbers of bits and of hashes, and the bits in longs."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def may_hold(self, key: Column) -> Column:
        words = F.lit(list(self.words))
        out = F.lit(True)
        for p in positions(key, self.number, self.bits, self.hashes):
            out = out & (_bit(words, p) == 1)
        return out


def _bit(words: Column, p: Column) -> Column:
    return F.call_function("getbit", F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int"))


def positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing: h1 + i * h2 for i below hashes."""
    h = F.xxhash64(F.lit(number), key)
    one, two = F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 29), F.lit(bits - 1)) + 1
    return [F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(hashes)]


def mistaken(number: int, own: int, others: int) -> float:
    """The share of other keys that a level may take for its own: of the first level so many as the list has keys, over the root of 2; of others MISTAKEN."""
    return MISTAKEN if number else min(MISTAKEN, own / (math.sqrt(2) * max(1, others)))


def shape(n: int, share: float) -> tuple[int, int]:
    """Bits and hashes of a filter of n keys that takes about that share of other keys for its own."""
    return max(8, math.ceil(n * math.log2(1 / share) / math.log(2))), max(1, round(math.log2(1 / share)))


def build_level(keys: DataFrame, key: str, number: int, n: int, others: int) -> Level:
    """Sets the bits of all n keys: distinct positions are gathered in longs by a grouped bit_or, bounded by the filter's size."""
    bits, hashes = shape(n, mistaken(number, n, others))
    p = F.explode(F.array(*positions(F.col(key), number, bits, hashes))).alias("p")
    packed = keys.select(p).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("x"))
    words = [0] * math.ceil(bits / 64)
    for r in packed.collect():  # bits / 64 rows at most
        words[r.w] = r.x
    return Level(number, bits, hashes, tuple(words))


def build_cascade(listed: DataFrame, universe: DataFrame, key: str) -> list[Level]:
    """Levels 0, 2, ... hold listed keys, levels 1, 3, ... the keys of the universe that the level before takes for listed.

    The rows of a level are those of the level two before that the level between them takes by mistake, so the last
    level has no mistakes over the universe and membership there is exact. Each level has hashes of its own and holds
    about half of the keys of the one two before, so the cascade ends. An empty list is an empty cascade."""
    named = written(listed.select(key).where(F.col(key).isNotNull()).distinct(), "url-listed")
    n = named.count()
    if not n:
        release(named)
        return []
    levels = [build_level(named, key, 0, n, universe.count())]
    taken = universe.select(key).where(F.col(key).isNotNull() & levels[0].may_hold(F.col(key)))
    wrong = written(taken.distinct().join(sent(named), key, "left_anti"), "url-mistaken")
    pool = [named, wrong]
    while n := pool[len(levels) % 2].count():
        number = len(levels)
        levels.append(build_level(pool[number % 2], key, number, n, 0))
        pool[(number + 1) % 2] = pool[(number + 1) % 2].where(levels[-1].may_hold(F.col(key)))
    release(named, wrong)
    return levels


def shards(n_listed: int, n_universe: int) -> int:
    """Cascades that a list needs so that no filter of theirs is above MAX_BITS: the first holds the list, the second what that takes by mistake, which is less."""
    others = max(1, n_universe - n_listed)
    return max(1, math.ceil(shape(n_listed, mistaken(0, n_listed, others))[0] / MAX_BITS)) if n_listed else 1


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n)) if n > 1 else F.lit(0)


def member(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe that the cascade was built over: the parity of the first level that lacks the key."""
    out = F.lit(len(levels) % 2 == 1)  # of no level: nothing is listed
    for level in reversed(levels):
        out = F.when(level.may_hold(key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def candidate_keys(host: Column, path: Column, depth: int, names: int) -> Column:
    """Every key that a rule for this URL could have: each suffix of the host at a dot, with each prefix of the path that ends in a slash. depth and names are the slashes and labels of the rule that has most of them."""
    labels = F.split(host, r"\.", -1)
    labels = F.slice(labels, F.greatest(F.size(labels) - names + 1, F.lit(1)), names)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/", -1)
    ends = F.greatest(F.size(parts) - 1, F.lit(0))
    prefixes = F.when(ends > 0, F.transform(F.sequence(F.lit(1), F.least(ends, F.lit(depth))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def keys_of(spark: SparkSession, keys: Iterable[str] | DataFrame) -> DataFrame:
    """A list of keys as a table `key`; a table is taken as it is, so that a long list needs no driver."""
    if isinstance(keys, DataFrame):
        return keys.select(keys[keys.columns[0]].alias("key"))
    return spark.range(1).select(F.explode(F.lit(sorted(keys)).cast("array<string>")).alias("key"))


def url_filter(pages: DataFrame, rules: dict[str, str], blocked_hosts: list[str] | DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    rules maps keys like `example.net/en/` (a host and a path prefix ending in a slash) to allow or block. A rule fits
    its host and the hosts below it if the path starts with the rule's; the longest wins. A URL that no rule fits is
    blocked if its host, or one above it, is in blocked_hosts, else allowed; those may be a table of one column. All lists are held in one cascade each over the complete universe of keys of
    the table, so a lookup needs no join and errs on no key of the table. A list too long for one cascade is dealt to
    shards of the keys' hash, and the rows are passed over once for each.

    Defined results: a null URL, or one without ://, has empty host and path, no rule and the verdict allow; repeated
    rows are judged each; very long URLs are judged whole, by keys of as many labels and slashes as any rule or listed host has;
    other columns are ignored; an empty table gives no rows; null hosts in the list are left out."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    depth = max((k.count("/") for k in rules), default=1)
    blocked = keys_of(spark, blocked_hosts)
    most = blocked.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 1
    names = max([most, *(1 + k.split("/")[0].count(".") for k in rules)])
    own = candidate_keys(F.col("host"), F.col("path"), depth, names)
    above = F.transform(candidate_keys(F.col("host"), F.lit("/"), 1, names), lambda k: F.concat(F.lit("host:"), k))
    universe = written(parts.select(F.explode(F.concat(own, above)).alias("key")).distinct(), "url-keys")
    listed = [keys_of(spark, [k for k, v in rules.items() if v == "block"]), keys_of(spark, [k for k, v in rules.items() if v == "allow"]), blocked.select(F.concat(F.lit("host:"), "key", F.lit("/")).alias("key"))]
    n = shards(max(x.count() for x in listed), universe.count())
    rows = parts.select("*", F.lit(None).cast("struct<n:int,key:string,verdict:string>").alias("best"), F.lit(False).alias("listed"))
    for shard in range(n):
        mine = lambda k: shard_of(k, n) == shard  # noqa: B023, E731  used in this round only
        block, allow, hosts = (build_cascade(x.where(mine(F.col("key"))), universe.where(mine(F.col("key"))), "key") for x in listed)
        hit = F.transform(F.filter(own, mine) if n > 1 else own, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.when(member(block, k), F.lit("block")).when(member(allow, k), F.lit("allow")).alias("verdict")))  # noqa: B023
        best = F.array_max(F.filter(F.array_append(hit, F.col("best")), lambda s: s["verdict"].isNotNull()))
        held = F.col("listed") | F.exists(F.filter(above, mine) if n > 1 else above, lambda h: member(hosts, h))  # noqa: B023
        rows = rows.withColumns({"best": best, "listed": held})
        rows = written(rows, "url-shard") if shard < n - 1 else rows
    return rows.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
