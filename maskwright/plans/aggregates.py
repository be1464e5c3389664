"""Aggregates of governed frames: what to compute and what it reveals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.plans.refusals import Refused

# Aggregate names by what their result reveals.
COUNTS = ("count",)
PICKS = ("min", "max", "any_value")
NUMERIC = {
    "sum": "sum",
    "avg": "avg",
    "stddev": "stddev",
    "std": "std",
    "stddev_samp": "stddev_samp",
    "stddev_pop": "stddev_pop",
    "variance": "variance",
    "var_samp": "var_samp",
    "var_pop": "var_pop",
    "bit_and": "bit_and",
    "bit_or": "bit_or",
    "bit_xor": "bit_xor",
    "bool_and": "bool_and",
    "bool_or": "bool_or",
    "every": "every",
}
TEXTS = ("group_concat", "string_agg")
LISTS = ("array_agg",)
JSON_LISTS = ("json_agg", "jsonb_agg", "json_arrayagg", "json_group_array")
JSON_OBJECTS = ("json_object_agg", "jsonb_object_agg", "json_objectagg", "json_group_object")


def bare(key: str) -> str:
    """An ordering key without its direction."""
    return re.sub(r"(?i)(\s+(asc|desc))?(\s+nulls\s+(first|last))?\s*$", "", key)


def direction(key: str) -> tuple[bool, bool]:
    """Whether an ordering key descends, and whether its nulls come first (as Spark has it where the key says nothing)."""
    tail = key[len(bare(key)) :].lower()
    down = "desc" in tail
    return down, "first" in tail or ("last" not in tail and not down)


def _json(c: Column) -> Column:
    """A value as JSON text."""
    one = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substr(one, F.lit(2), F.char_length(one) - 2)


def _compared(x: Column, y: Column, ways: list[tuple[bool, bool]]) -> Column:
    """-1, 0 or 1: two structs by o0, o1, ..., each in its direction, and by their value where these are equal."""
    out = F.lit(0)
    for name, (down, nulls_first) in reversed([*((f"o{i}", w) for i, w in enumerate(ways)), ("v", (False, True))]):
        p, q = x[name], y[name]
        out = (
            F.when(p.eqNullSafe(q), out)
            .when(p.isNull(), -1 if nulls_first else 1)
            .when(q.isNull(), 1 if nulls_first else -1)
            .when(p < q, 1 if down else -1)
            .otherwise(-1 if down else 1)
        )
    return out


@dataclass(frozen=True)
class Agg:
    """One aggregate: name, argument expressions, alias and modifiers."""

    fn: str
    args: tuple[str, ...]
    alias: str
    distinct: bool = False
    where: str | None = None
    order_by: tuple[str, ...] = ()
    descending: bool = False
    separator: str = ","

    def column(self) -> Column:
        fn = self.fn
        args = [F.expr(a) for a in self.args]
        keep = F.expr(self.where) if self.where else None
        guard = (lambda c: F.when(keep, c)) if keep is not None else (lambda c: c)
        if fn == "count":
            if not args:
                return F.count(guard(F.lit(1)))
            return F.count_distinct(guard(args[0])) if self.distinct else F.count(guard(args[0]))
        if fn == "total":
            value = guard(args[0].cast("double"))
            return F.coalesce(F.sum_distinct(value) if self.distinct else F.sum(value), F.lit(0.0))
        if fn in PICKS:
            return F.call_function(fn, guard(args[0]))
        if fn in NUMERIC:
            if not self.distinct:
                return F.call_function(NUMERIC[fn], guard(args[0]))
            if fn == "sum":
                return F.sum_distinct(guard(args[0]))
            if fn == "avg":
                value = guard(args[0])
                return F.sum_distinct(value) / F.count_distinct(value)
            kept = f"CASE WHEN {self.where} THEN {self.args[0]} END" if self.where else self.args[0]
            return F.expr(f"{NUMERIC[fn]}(DISTINCT {kept})")
        if fn in TEXTS:
            return self._joined(args[0], keep)
        if fn in LISTS:
            return self._list(args[0], keep)
        if fn in JSON_LISTS:
            return F.to_json(self._list(args[0], keep), {"ignoreNullFields": "false"})
        if fn in JSON_OBJECTS:
            pair = F.struct(args[0].cast("string").alias("key"), _json(args[1]).alias("value"))
            kept = F.collect_list(pair if keep is None else F.when(keep, pair))
            # Pairs, not a map: a key may come up more than once.
            pairs = F.transform(F.array_sort(kept), lambda x: F.concat(_json(x["key"]), F.lit(":"), x["value"]))
            return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        raise Refused("E_FUNCTION", f"{fn} is not an aggregate")

    def _ordered(self, value: Column, keep: Column | None) -> Column:
        """The group's values as structs, nulls included, in the order asked for."""
        parts = [F.expr(bare(o)).alias(f"o{i}") for i, o in enumerate(self.order_by)]
        item = F.struct(*parts, value.alias("v"))
        item = item if keep is None else F.when(keep, item)
        items = F.collect_set(item) if self.distinct else F.collect_list(item)
        if not self.order_by and not self.distinct:
            return items
        ways = [direction(o if o != bare(o) or not self.descending else f"{o} desc") for o in self.order_by]
        if all(way == (self.descending, not self.descending) for way in ways):
            return F.sort_array(items, not self.descending)
        return F.array_sort(items, lambda x, y: _compared(x, y, ways))

    def _list(self, value: Column, keep: Column | None) -> Column:
        return F.transform(self._ordered(value, keep), lambda x: x["v"])

    def _joined(self, value: Column, keep: Column | None) -> Column:
        texts = F.filter(self._list(value.cast("string"), keep), lambda x: x.isNotNull())
        return F.when(F.size(texts) > 0, F.array_join(texts, self.separator))


def agg(fn: str, *args: str, alias: str, **options) -> Agg:
    """``agg("sum", "amount", alias="total")``; options: distinct, where, order_by (each key with its own
    direction: ``("a desc", "b")``; ``descending`` turns those that name none), separator."""
    if isinstance(options.get("order_by"), str):
        options["order_by"] = (options["order_by"],)
    return Agg(fn.lower(), tuple(args), alias, **options)
