"""What several operators share: texts, held tables, running sums of hot keys, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from maskwright.session import hold

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word is a run of anything but the ASCII white space. bytes.split() of Python cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else. lower() does that to an ASCII text, and is far quicker than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))


def as_doc(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of an operator's own column can clash with one of them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("doc")


def held(df: DataFrame, purpose: str) -> tuple[DataFrame, int, int]:
    """``hold``, with the number of rows and the sum of their hashes: both are observed while the table is written."""
    seen = Observation()
    found = hold(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(quoted(c)) for c in df.columns]).cast("decimal(38,0)")).alias("sign")), purpose)
    got = seen.get
    return found, got["n"], int(got["sign"] or 0)


def remembered(key, make):
    """make(), once in a Python worker: functions travel by value and would start anew in each task."""
    import sys
    import types

    kept = sys.modules.setdefault("_maskwright_worker", types.ModuleType("_maskwright_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def running_sum(df: DataFrame, by: str, order: list[str], value: Column, name: str, bucket_rows: int = 4096) -> DataFrame:
    """Adds the sum of value over the rows of the same ``by`` that come before, in an order shuffled by ``order``.

    ``by`` must not be null; df is read three times, so hold it first. No task
    holds a key: rows are dealt to buckets of about ``bucket_rows`` by the
    hash of ``order``, sums of buckets are added up, and a window runs within
    a bucket only. The order is that of (bucket, order), the same in every run.
    """
    buckets = max(1, -(-df.count() // bucket_rows))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(buckets)).cast("long")).withColumn("_value", value)
    sums = dealt.groupBy(by, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_inner", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return inner.join(starts, [by, "_bucket"]).withColumn(name, F.col("_start") + F.col("_inner")).drop("_bucket", "_value", "_start", "_inner")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b); root is the smallest node that can be reached.

    Large and small stars in turn: each round is two joins with the minima of
    the neighbourhoods, which are partial aggregates, so a hub costs no task
    more than its share (a skewed join is split). Rounds grow with the
    logarithm of the longest chain. Each round is held, not chained.
    """
    edges, n, sign = held(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while n and sign != last:
        last = sign
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, n, sign = held(small.union(low).distinct(), "links")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(members.select("root", "root").distinct())


class Recent:
    """Values of keys, worked out many at a time by ``make(keys)`` and remembered.

    Two generations of at most about ``room`` bytes each (and one batch over):
    when the young one is full it becomes the old one, and a key that is met
    again moves back. So what recurs stays, whatever came first.
    """

    # What a key and its value cost besides their own length.
    EACH = 200

    def __init__(self, make, room: int = 96 << 20):
        self.make, self.room = make, room
        self.young, self.old, self.held = {}, {}, 0

    def of(self, keys: set) -> dict:
        """A mapping that has all of the keys."""
        if self.held > self.room:
            self.young, self.old, self.held = {}, self.young, 0
        missing = keys.difference(self.young)
        again = {k: self.old[k] for k in missing if k in self.old}
        new = list(missing.difference(again))
        for found in (again, dict(zip(new, self.make(new)))):
            self.young.update(found)
            self.held += sum(map(len, found)) + sum(map(len, found.values())) + self.EACH * len(found)
        return self.young
