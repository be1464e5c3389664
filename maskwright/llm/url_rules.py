"""URL filters by hashed expressions.

Each URL is expanded into host suffixes and path prefixes; the hash of each
pair meets the rules by equality on its first eight hex digits, the whole
digest confirms, and of the rules that fit the one with the longest host and
path decides. All of it is DataFrame expressions.

Only suffixes of as many labels, and prefixes of as many characters, as some
rule has are made, so a URL of any length has few. Equal hosts and paths are
judged once. Rules are a table of any size and are joined, not embedded.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lowered;
path: from there up to "?", "#" or the end. A null URL, or one without "://",
has neither and fits no rule. Of rules of equal length the longer host wins;
of one rule with two verdicts block wins. Rules with null are left out, and
without rules every URL gets the default. Repeated pages stay. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import ascii_lower, quoted

ALLOW, BLOCK = "allow", "block"
SHORT = 8


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, url: str = "url", id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict; rules are (host, path, verdict)."""
    known = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna()
    rule = F.concat("rule_host", "rule_path")
    known = known.select("rule_host", rule.alias("rule"), "verdict", F.sha2(rule, 256).alias("digest"), F.length("rule_path").alias("chars"), _labels(F.col("rule_host")).alias("labels"))
    # Two short lists, however many rules: hosts have at most 127 labels, and paths few lengths.
    shape = known.agg(F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()
    link = F.col(quoted(url)).cast("string")
    read = pages.select(F.col(quoted(id)).alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"))
    if not shape["labels"]:
        return read.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = read.select("host", "path").where("host <> ''").distinct()
    numbers = lambda xs: F.array(*[F.lit(int(x)) for x in sorted(xs)])
    suffixes = places.select("host", "path", F.explode(F.filter(numbers(shape["labels"]), lambda k: k <= _labels(F.col("host")))).alias("k"))
    suffixes = suffixes.select("host", "path", F.expr("substring_index(host, '.', -k)").alias("suffix"))
    prefixes = suffixes.select("host", "path", "suffix", F.explode(F.filter(numbers(shape["chars"]), lambda n: n <= F.length("path"))).alias("n"))
    tried = prefixes.select("host", "path", F.sha2(F.concat("suffix", F.expr("substring(path, 1, n)")), 256).alias("tried"))
    tried = tried.withColumn("short", F.substring("tried", 1, SHORT))
    fits = tried.join(known.withColumn("short", F.substring("digest", 1, SHORT)), "short").where("tried = digest")
    order = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == BLOCK).alias("blocks"), "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    joined = read.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
