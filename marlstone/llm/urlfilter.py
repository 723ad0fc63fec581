"""URL filters: a sort-merge range join of urls with nested rules.

A rule names a host and a path. It fits its host, every subdomain of it, and urls whose path
starts with its path. Hosts are compared by their canonical key, the labels in reverse, each
followed by a dot (``www.example.net`` is ``net.example.www.``). A url asks at each host that
encloses its own and has rules, with its path; there the rules that fit are those whose path is a
prefix, and a prefix is an interval of paths in byte order. The intervals of any two rules of a host
are nested or apart. A sweep over urls and interval bounds in order of host key and path therefore
needs a stack: a bound replaces the stack of active rules, and a url takes the innermost rule of the
last bound before it. No url is tried against a rule, however many rules a host has.

The sweep runs in groups of one host each. A host's urls are dealt to so many groups that each has
``GROUP`` of them, or ten for each rule of the host if that is more; the host's rules are copied to
each. So one host with a third of all urls is spread out, and copies of rules are at most a tenth of
the urls, and the rules themselves. Nothing is broadcast by force, and nothing collected but the
number of labels of the deepest rule.

Defined results: a null url, or one without ``://``, has an empty host and path; a path that is
empty starts with no rule's ``/``; two rules that fit count by their length in characters (host
and path), then by the longer host, then block before allow, then by their text; repeated rows
are judged one by one; an empty table of rules leaves every url to the default; rules without a
host (null) are ignored, and a null path is the empty path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Scheme end, then the host, then the path.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


#: Urls of a group of the sweep, about.
GROUP = 100_000


def _ranked(rules: DataFrame) -> DataFrame:
    """``at, path, best``: the rules by host key; of several on one host and path the one that counts."""
    known = rules.where(F.col("host").isNotNull()).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    best = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").cast("int").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict")
    return known.groupBy(_key(_labels(F.col("host"))).alias("at"), "path").agg(F.max(best).alias("best"))


def _bounds(ranked: DataFrame) -> DataFrame:
    """``at, place, kind, stack``: start (1) and end (0) of each rule's interval of paths, with the
    rules, outermost first, that are active from there on."""
    # a rule can only lie within those of its host with a shorter path, of a length that some rule has
    sizes = ranked.groupBy("at").agg(F.collect_set(F.length("path")).alias("sizes"))
    above = ranked.join(sizes, "at").select("at", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    above = above.select("at", "path", F.expr("substring(path, 1, n)").alias("outer"))
    stacks = above.join(ranked.withColumnRenamed("path", "outer"), ["at", "outer"]).groupBy("at", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("outer"), "best"))), lambda x: x["best"]).alias("stack"))
    place = F.col("path").cast("binary")
    starts = stacks.select("at", place.alias("place"), F.lit(1).alias("kind"), "stack")
    # 0xFF is no byte of any path, so this lies behind all paths with the rule's in front
    ends = stacks.select("at", F.concat(place, F.lit(bytearray(b"\xff"))).alias("place"), F.lit(0).alias("kind"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"))
    return starts.unionByName(ends)


def judge_urls(
    urls: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", group: int = GROUP
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row of ``urls``.

    rules: columns host, path and verdict (block or allow). default: the verdict where no rule
    fits. group: urls of a group of the sweep.
    """
    ranked = _ranked(rules)
    depth = ranked.agg(F.max(F.size(F.split("at", r"\.", -1)) - 1)).first()[0] or 0
    # written once, so that row numbers hold
    rows = stored(urls.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row")))
    labels = F.slice(_labels(F.col("host")), 1, max(1, depth))
    around = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: _key(F.slice("labels", F.lit(1), k)))
    asked = rows.select("row", "path", labels.alias("labels")).select("row", "path", F.explode(around).alias("at"))
    hosts = ranked.groupBy("at").agg(F.count(F.lit(1)).alias("n_rules"))
    asked = asked.join(hosts, "at")
    room = F.greatest(F.lit(group), 10 * F.col("n_rules"))
    salts = asked.groupBy("at", "n_rules").agg(F.ceil(F.count(F.lit(1)) / room).alias("salts")).select("at", "salts")
    left = asked.join(salts, "at").select("at", F.pmod(F.xxhash64("row"), "salts").alias("salt"), F.col("path").cast("binary").alias("place"), F.lit(2).alias("kind"), "row")
    right = _bounds(ranked).join(salts, "at").select("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "place", "kind", "stack")
    sweep = Window.partitionBy("at", "salt").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = left.unionByName(right, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("kind") == 2)
    found = swept.select("row", F.try_element_at("active", F.lit(-1)).alias("best")).groupBy("row").agg(F.max("best").alias("best"))
    return rows.join(found, "row", "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
