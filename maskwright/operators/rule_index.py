"""Rules as a table: names and patterns meet rules by equality of hashed affixes.

A segment of a pattern is a name in full, a start (``x*``), an end (``*x``), a
part (``*x*``) or anything (``*``). A rule is found by one of its segments, the
one whose key the fewest names have: the name itself, its first or last
characters, or a gram of its part. A name has a key for each length that rules
use, so an inventory meets rules in one equality join, however many there are
of both; the whole pattern is tested on what meets.

Two patterns can name one thing if no segment keeps them apart. They meet by
the first segment in which both say something about the same end of a name (or
one is given in full); if there is none, nothing keeps them apart.

The keys of names are many times the names, which Spark's estimate of their
size does not tell: no plan may broadcast them by it. Rules are counted. Few
are sent to the names, which then need no shuffle; many meet them by one.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = ("db", "table", "column")
# Characters of a gram of a part; a shorter part is its own gram.
GRAM = 3
FULL, START, END, PART, ANY = "f", "s", "e", "c", "a"
# Up to so many rules are sent to every task.
FEW = 10_000


def _sent(rules: DataFrame):
    """How tables made of these rules are joined, some rows per rule: sent to the names, or met by a shuffle."""
    few = rules.limit(FEW + 1).count() <= FEW
    return F.broadcast if few else lambda df: df.hint("merge")


def how(seg: Column) -> Column:
    """What a segment struct (lit, pre, suf) says of a name."""
    return (
        F.when(seg["lit"] == "", ANY).when(seg["pre"] & seg["suf"], PART).when(seg["pre"], END).when(seg["suf"], START).otherwise(FULL)
    )


def _key(at: int, kind: Column | str, text: Column) -> Column:
    return F.xxhash64(F.lit(at), F.lit(kind) if isinstance(kind, str) else kind, text)


def _own_text(seg: Column) -> Column:
    """What the segment itself is found by."""
    return F.when(how(seg) == PART, F.substr(seg["lit"], F.lit(1), F.lit(GRAM))).otherwise(seg["lit"])


def _sizes(segs: list[tuple[int, DataFrame]]) -> dict[tuple[int, str], list[int]]:
    """Lengths in use by position and kind: as many as names have characters, at most."""
    out = {}
    for at, frame in segs:
        for r in frame.select(how(F.col("seg")).alias("how"), F.char_length(_own_text(F.col("seg"))).alias("n")).distinct().collect():
            out.setdefault((at, r["how"]), []).append(r["n"])
    return {k: sorted(v) for k, v in out.items()}


def _affixes(at: int, text: Column, sizes: dict, kinds: str, longest: Column) -> Column:
    """Keys of the starts, ends and grams of text at the lengths in use, none longer than ``longest``."""
    keys = []
    for n in sizes.get((at, START), []) if START in kinds else []:
        keys.append(F.when(longest >= n, _key(at, START, F.left(text, F.lit(n)))))
    for n in sizes.get((at, END), []) if END in kinds else []:
        keys.append(F.when(longest >= n, _key(at, END, F.right(text, F.lit(n)))))
    out = F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<bigint>")
    for n in sizes.get((at, PART), []) if PART in kinds else []:
        starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        out = F.array_union(out, F.transform(starts, lambda i: _key(at, PART, F.substr(text, i, F.lit(n)))))
    return F.array_distinct(out)


def name_keys(names: dict[int, Column], sizes: dict) -> Column:
    """All keys by which rules may find something with these folded names (by position)."""
    parts = [F.array(_key(-1, ANY, F.lit("")))] if any(kind == ANY for _, kind in sizes) else []
    for at, name in names.items():
        text = F.coalesce(name, F.lit(""))
        if (at, FULL) in sizes:
            parts.append(F.array(_key(at, FULL, text)))
        parts.append(_affixes(at, text, sizes, START + END + PART, F.char_length(text)))
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


def find_rules(names: DataFrame, folded: dict[int, Column], rules: DataFrame, matches: Column) -> DataFrame:
    """names joined with the rules (segments as structs ``s0``, ``s1``, ``s2``) that ``matches`` holds for.

    ``folded`` says by which positions rules are found, and gives the names there.
    """
    sizes = _sizes([(at, rules.select(F.col(f"s{at}").alias("seg")).distinct()) for at in folded])
    sent = _sent(rules)
    segs = {at: F.col(f"s{at}") for at in folded}
    own = F.array(*[F.when(how(s) != ANY, _key(at, how(s), _own_text(s))) for at, s in segs.items()])
    some = F.filter(own, lambda k: k.isNotNull())
    keyed = rules.withColumn("_keys", F.when(F.size(some) > 0, some).otherwise(F.array(_key(-1, ANY, F.lit("")))))
    offered = names.withColumn("_key", F.explode(name_keys(folded, sizes)))
    wanted = keyed.select(F.explode("_keys").alias("_key")).distinct()
    # How many names have a key decides by which one a rule is found.
    common = offered.select("_key").join(sent(wanted), "_key").groupBy("_key").agg(F.count("*").alias("_n"))
    ids = [c for c in rules.columns]
    best = keyed.select(*ids, F.explode("_keys").alias("_key")).join(sent(common), "_key").groupBy(*ids).agg(F.min(F.struct("_n", "_key"))["_key"].alias("_key"))
    return offered.join(sent(best), "_key").where(matches).drop("_key")


def _apart(x: str, y: str) -> bool:
    """Whether segments of these kinds say something about the same end, or one is in full and the other says anything."""
    if ANY in (x, y):
        return False
    return FULL in (x, y) or (x == y and x != PART)


def _meets(at: int, both: list[DataFrame], sent) -> DataFrame:
    """Both sides' columns, of patterns whose segments at a position may fit, of kinds that can keep them apart."""
    names = ("a", "b")
    sides = {n: df.withColumn("seg", F.col(f"{n}{at}")) for n, df in zip(names, both)}
    columns = {n: df.columns for n, df in zip(names, both)}
    sizes = {name: _sizes([(at, df.select("seg").distinct())]) for name, df in sides.items()}

    def own(name, kinds):
        df = sides[name].where(how(F.col("seg")).isin(*kinds))
        return df.select(*columns[name], _key(at, how(F.col("seg")), _own_text(F.col("seg"))).alias("key"))

    def offered(name, other):
        seg, lit = F.col("seg"), F.col("seg.lit")
        inner = F.char_length(lit) - 1
        none = F.array().cast("array<bigint>")
        keys = (
            F.when(how(seg) == FULL, _affixes(at, lit, sizes[other], START + END + PART, F.char_length(lit)))
            .when(how(seg) == START, _affixes(at, lit, sizes[other], START, inner))
            .when(how(seg) == END, _affixes(at, lit, sizes[other], END, inner))
            .otherwise(none)
        )
        return sides[name].select(*columns[name], F.explode(keys).alias("key"))

    same = own("a", FULL + START + END).join(sent(own("b", FULL + START + END)), "key")
    shorter = own("a", START + END + PART).join(sent(offered("b", "a")), "key")
    longer = offered("a", "b").join(sent(own("b", START + END + PART)), "key")
    return same.union(shorter).union(longer).drop("key")


def overlapping(left: DataFrame, right: DataFrame, overlap) -> DataFrame:
    """(a, b): pairs of patterns that could name one column; both tables have pattern, s0, s1, s2, one row per pattern."""
    sides = [df.select(F.col("pattern").alias(n), *[F.col(f"s{i}").alias(f"{n}{i}") for i in range(3)]) for n, df in (("a", left), ("b", right))]
    kinds = FULL + START + END + PART + ANY
    sent = _sent(right)

    def decides(i):
        x, y = how(F.col(f"a{i}")), how(F.col(f"b{i}"))
        return F.concat(x, y).isin(*[p + q for p, q in product(kinds, kinds) if _apart(p, q)])

    out, order = None, (2, 1, 0)
    for n, at in enumerate(order):
        met = _meets(at, sides, sent)
        for before in order[:n]:
            met = met.where(~decides(before))
        met = met.where(overlap(F.col("a2"), F.col("b2")) & overlap(F.col("a1"), F.col("b1")) & overlap(F.col("a0"), F.col("b0"))).select("a", "b")
        out = met if out is None else out.union(met)
    # Where no segment can keep two patterns apart, their kinds alone decide.
    free = {x: [y for y in kinds if not _apart(x, y)] for x in kinds}
    fits = {"".join(k): ["".join(o) for o in product(*[free[x] for x in k])] for k in product(kinds, repeat=3)}
    table = F.create_map(*[x for k, v in fits.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    shape = F.concat(*[how(F.col(f"s{i}")) for i in range(3)])
    loose = left.select(F.col("pattern").alias("a"), F.explode(F.element_at(table, shape)).alias("shape"))
    loose = loose.join(sent(right.select(F.col("pattern").alias("b"), shape.alias("shape"))), "shape")
    return out.union(loose.select("a", "b"))
