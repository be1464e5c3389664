"""Relational queries over protected tables.

A ``Governed`` frame runs on clear values in Spark and keeps the provenance
of every column beside it. Its methods refuse uses that would reveal a
masked value, note what the k-anonymity counts must check, and ``result``
puts the masks on top. There is no parser: an expression is checked by
letting Spark resolve it against the columns it may read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import detectors as det
from maskwright.operators.disclosure import k_report, k_subjects
from maskwright.operators.hot_windows import RANKS, RUNNING, hot_windows
from maskwright.operators.masking import protect_column
from maskwright.operators.output import Limits
from maskwright.operators.rules import RuleSet, fold
from maskwright.plans.aggregates import COUNTS, PICKS, Agg
from maskwright.plans.aggregates import bare as _bare
from maskwright.plans.aggregates import direction as _direction
from maskwright.plans.provenance import Kind, Prov, mixed, same_column
from maskwright.plans.refusals import Refused
from maskwright.session import cut_lineage, hold
from maskwright.sources.sinks import store_batch

MAX_PASSES = 8

# Window functions that are not aggregates, and the frames offered.
RANKING = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
ANALYTIC = ("lag", "lead", "first_value", "last_value", "nth_value")
WINDOW_AGGREGATES = (
    "count sum avg min max stddev std stddev_pop stddev_samp variance var_pop var_samp "
    "bit_and bit_or bit_xor bool_and bool_or every any_value"
).split()
_BOUND = r"(?:UNBOUNDED (?:PRECEDING|FOLLOWING)|CURRENT ROW|\d+ (?:PRECEDING|FOLLOWING))"
_UP_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW".split()
_FRAME = re.compile(rf"(?:ROWS|RANGE) (?:BETWEEN {_BOUND} AND {_BOUND}|{_BOUND})")


def _held_whole(t: T.DataType) -> bool:
    """Whether a table can hold a column of this type, or rows of this schema."""
    if isinstance(t, T.StructType):
        return bool(t.fields) and all(_held_whole(f.dataType) for f in t.fields)
    if isinstance(t, T.MapType):
        return _held_whole(t.keyType) and _held_whole(t.valueType)
    if isinstance(t, T.ArrayType):
        return _held_whole(t.elementType)
    return not isinstance(t, (T.NullType, T.CalendarIntervalType))


@dataclass(frozen=True)
class Trail:
    """What a query touched, gathered along its frames."""

    uses: frozenset[tuple[str, str]] = frozenset()
    steering: frozenset[str] = frozenset()
    pii_joins: frozenset[str] = frozenset()
    pii_filter: bool = False
    relations: frozenset[str] = frozenset()
    # Base tables by source: the subjects of a filter are counted there.
    bases: tuple[tuple[str, DataFrame], ...] = ()
    masked: frozenset[str] = frozenset()
    views: frozenset[str] = frozenset()
    checks: tuple[tuple[str, DataFrame, bool], ...] = ()

    def merge(self, o: Trail) -> Trail:
        known = {s for s, _ in self.bases}
        frames = {id(f) for _, f, _ in self.checks}
        return Trail(
            self.uses | o.uses,
            self.steering | o.steering,
            self.pii_joins | o.pii_joins,
            self.pii_filter or o.pii_filter,
            self.relations | o.relations,
            self.bases + tuple(b for b in o.bases if b[0] not in known),
            self.masked | o.masked,
            self.views | o.views,
            self.checks + tuple(c for c in o.checks if id(c[1]) not in frames),
        )


def governed(
    df: DataFrame, db: str, table: str, rules: RuleSet, view: bool = False, masking: bool = True
) -> Governed:
    """A scan: every column is itself, sensitive when a rule masks it."""
    provs, masked = {}, set()
    for c in df.columns:
        source = f"{db}.{table}.{c}"
        mode = rules.mode(db, table, c) if masking else None
        if mode:
            masked.add(source)
        provs[c] = Prov(frozenset({source}), Kind.IDENTITY, bool(mode), frozenset({mode} if mode else ()))
    trail = Trail(
        relations=frozenset({f"{db}.{table}"}),
        bases=tuple((s, df) for s in masked),
        masked=frozenset(masked),
        views=frozenset(masked if view else ()),
    )
    return Governed(df, provs, trail)


@dataclass(frozen=True)
class Governed:
    _df: DataFrame
    _prov: dict[str, Prov]
    _trail: Trail = field(default_factory=Trail)
    # A k-anonymity check is due on the rows of this frame, or on its groups.
    _due: bool = False
    _groups: DataFrame | None = None
    _limit: int | None = None

    # ---- what an expression reads ----

    @property
    def columns(self) -> list[str]:
        return list(self._prov)

    def provenance(self, name: str) -> Prov:
        return self._prov[self._name(name)]

    def _name(self, name: str) -> str:
        found = [c for c in self._prov if c == name] or [c for c in self._prov if fold(c) == fold(name)]
        if len(found) != 1:
            raise Refused("E_UNKNOWN_NAME", f"unknown or ambiguous column {name[:64].lower()}")
        return found[0]

    def _is_column(self, text) -> bool:
        return isinstance(text, str) and any(fold(c) == fold(text.strip("`")) for c in self._prov)

    def _reads(self, expr: str | Column) -> list[str]:
        """The columns an expression reads, as Spark's analysis of it over an empty frame refers to them.

        The plan is judged, not the text: one row source (the empty frame), no
        subquery, no function whose body is not known.
        """
        try:
            plan = _empty(self._df).select(F.expr(expr) if isinstance(expr, str) else expr)._jdf.queryExecution().analyzed()
        except AnalysisException as problem:
            condition = problem.getCondition() or ""
            if condition.startswith("UNRESOLVED_COLUMN"):
                named = problem.getMessageParameters()["objectName"]
                raise Refused("E_UNKNOWN_NAME", f"unknown or ambiguous column {named[:64].lower()}") from None
            if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
                raise Refused("E_UNSUPPORTED_SYNTAX", "an expression reads the columns of its own frame, no table") from None
            raise Refused("E_INVALID_SQL", f"Spark cannot resolve the expression ({condition})") from None
        if not plan.subqueriesAll().isEmpty() or plan.collectLeaves().size() != 1 or plan.output().size() != 1:
            raise Refused("E_UNSUPPORTED_SYNTAX", "a subquery is written as a governed frame: semi_join, anti_join or with_scalar")
        if any(_unknown(e) for node in _nodes(plan) for e in _scala(node.expressions())):
            raise Refused("E_UNSUPPORTED_SYNTAX", "an expression holds a function that is not built in, or that calls out")
        names = _sources(plan)
        return [c for c in self._prov if c in names]

    def _value(self, expr: str | Column) -> Prov:
        if self._is_column(expr):
            return self._prov[self._name(expr.strip("`"))]
        return mixed(self._prov[c] for c in self._reads(expr))

    def _with(self, df: DataFrame, provs: dict[str, Prov], trail: Trail | None = None, **changes) -> Governed:
        return replace(self, _df=df, _prov=provs, _trail=trail or self._trail, **changes)

    def _touch(self, clause: str, *provs: Prov, steer: bool = True) -> Trail:
        t = self._trail
        uses = {(s, clause) for p in provs if p.sensitive for s in p.sources if s in t.masked}
        steering = {s for p in provs for s in p.sources} if steer else set()
        return replace(t, uses=t.uses | uses, steering=t.steering | steering)

    def _all_pii(self, p: Prov) -> bool:
        return (
            p.sensitive
            and not p.lit
            and p.kind == Kind.IDENTITY
            and bool(p.sources)
            and p.sources <= self._trail.masked
        )

    def _settle(self) -> Governed:
        """Note the check that is due before the rows change shape."""
        t = self._trail
        if self._groups is not None:
            check = ("a group", self._groups.agg(F.min("_k").alias("n")), True)
            return replace(self, _trail=replace(t, checks=t.checks + (check,)), _groups=None, _due=False)
        if self._due:
            check = ("the PII filter", self._df.agg(F.count(F.lit(1)).alias("n")), False)
            return replace(self, _trail=replace(t, checks=t.checks + (check,)), _due=False)
        return self

    # ---- projection ----

    def select(self, *items: str | tuple[str, str]) -> Governed:
        """Columns, (column, alias) pairs, or "*"."""
        pairs: list[tuple[str, str]] = []
        for it in items:
            if it == "*":
                pairs += [(c, c) for c in self._prov]
            else:
                src, label = (it, it) if isinstance(it, str) else it
                pairs.append((self._name(src), self._name(src) if isinstance(it, str) else label))
        if len({fold(a) for _, a in pairs}) != len(pairs):
            raise Refused("E_INVALID_SQL", "two output columns have one name")
        df = self._df.select(*[F.col(f"`{c}`").alias(a) for c, a in pairs])
        me = self._settle()
        trail = me._touch("select", *[me._prov[c] for c, _ in pairs], steer=False)
        return me._with(df, {a: me._prov[c] for c, a in pairs}, trail)

    def rename(self, **labels: str) -> Governed:
        """``rename(new=old)``: the other columns keep their names and places."""
        back = {self._name(old): new for new, old in labels.items()}
        return self.select(*[(c, back.get(c, c)) for c in self._prov])

    def prefix(self, text: str) -> Governed:
        """Every column under a prefix, as a table alias would."""
        return self.select(*[(c, text + c) for c in self._prov])

    def with_column(self, name: str, expr: str | Column) -> Governed:
        """A computed column over columns that are not masked."""
        if self._groups is not None:
            return self._settle().with_column(name, expr)
        reads = self._reads(expr)
        p = self._value(expr) if self._is_column(expr) else mixed(self._prov[c] for c in reads)
        if p.sensitive and not self._is_column(expr):
            raise Refused("E_MASKED_EXPRESSION", f"a PII column ({p.names()}) is used inside an expression")
        if p.kind == Kind.CONST:
            p = replace(p, lit=True)
        column = F.expr(expr) if isinstance(expr, str) else expr
        trail = self._touch("select", p, steer=not self._is_column(expr))
        return self._with(self._df.withColumn(name, column), {**self._prov, name: p}, trail)

    def with_columns(self, exprs: dict[str, str | Column]) -> Governed:
        """Several computed columns over the columns there are now."""
        me = self._settle() if self._groups is not None else self
        provs, trail = dict(me._prov), me._trail
        for name, expr in exprs.items():
            one = replace(me, _trail=trail).with_column(name, expr)
            provs[name], trail = one._prov[name], one._trail
        columns = {n: F.expr(e) if isinstance(e, str) else e for n, e in exprs.items()}
        return me._with(me._df.withColumns(columns), provs, trail)

    # ---- filters ----

    def filter(self, expr: str | Column) -> Governed:
        """Any condition over columns that are not masked."""
        p = mixed(self._prov[c] for c in self._reads(expr))
        if p.sensitive:
            raise Refused(
                "E_MASKED_FILTER",
                f"{p.names()} is masked: a condition on it is an equality, through filter_pii or a join",
            )
        groups = self._groups.where(expr) if self._groups is not None else None
        return self._with(self._df.where(expr), self._prov, self._touch("where", p), _groups=groups)

    def filter_pii(self, column: str, values, op: str | None = None) -> Governed:
        """``= literal``, ``<=> literal``, ``IN (literals)`` or ``IS NULL`` (values None) on a masked column."""
        name = self._name(column)
        p = self._prov[name]
        if not p.sensitive:
            raise Refused("E_INVALID_SQL", f"{name} is not masked: use filter")
        if p.kind != Kind.IDENTITY:
            raise Refused("E_MASKED_FILTER", f"an aggregate or expression of a PII column ({p.names()}) cannot be compared")
        op = (op or ("is null" if values is None else "in" if isinstance(values, (list, tuple, set)) else "=")).lower()
        if op not in ("=", "<=>", "is not distinct from", "in", "is null"):
            raise Refused("E_MASKED_FILTER", f"a PII column ({p.names()}) may only be filtered by positive equality")
        listed = None if op == "is null" else list(dict.fromkeys(values)) if op == "in" else [values]
        if listed is not None and (not listed or any(isinstance(v, Column) for v in listed)):
            raise Refused("E_MASKED_FILTER", f"a PII column ({p.names()}) may only be compared with literals")
        if p.sources & self._trail.views:
            raise Refused("E_MASKED_FILTER", f"a PII column ({p.names()}) of a view cannot be compared: filter on the base table")
        if op in ("<=>", "is not distinct from") and values is None:
            listed = None
        masked = sorted(p.sources & self._trail.masked)
        if not masked:
            raise Refused("E_MASKED_FILTER", f"a PII column ({p.names()}) has no base column to count")
        bases = dict(self._trail.bases)
        # The subjects are counted in the column's own table: a join cannot inflate them.
        checks = tuple(("the PII filter", k_subjects(bases[s], s.split(".", 2)[2], listed), False) for s in masked)
        c = F.col(f"`{name}`")
        if listed is None:
            test = c.isNull()
        elif op in ("<=>", "is not distinct from"):
            test = c.eqNullSafe(F.lit(values))
        else:
            test = c.isin(listed)
        kept = self._df.where(test)
        trail = self._touch("where", p)
        trail = replace(trail, pii_filter=True, checks=trail.checks + checks)
        return self._with(kept, self._prov, trail, _due=True)

    # ---- joins ----

    def _equality(self, l: Prov, r: Prov, trail: Trail) -> Trail:
        """PII joins only PII; the equality of two PII columns is noted."""
        if not l.sensitive and not r.sensitive:
            return trail
        if l.kind != Kind.IDENTITY or r.kind != Kind.IDENTITY:
            raise Refused("E_MASKED_FILTER", f"PII columns ({l.names()}, {r.names()}) may only be joined as plain columns")
        if not (l.sensitive and r.sensitive):
            pii, other = (l, r) if l.sensitive else (r, l)
            raise Refused(
                "E_MASKED_FILTER",
                f"{pii.names()} is masked and {other.names()} is not: the join would tell values apart",
            )
        if l.lit or r.lit:
            raise Refused("E_MASKED_FILTER", f"a PII column ({l.names()}) is compared with values that may be literals")
        if same_column(l, r):
            raise Refused("E_MASKED_FILTER", "a PII column is compared with itself")
        sides = sorted([", ".join(sorted(l.sources)), ", ".join(sorted(r.sources))])
        return replace(trail, pii_joins=trail.pii_joins | {" = ".join(sides)})

    def _pairs(self, other: Governed, on) -> list[tuple[str, str]]:
        pairs = [(c, c) if isinstance(c, str) else c for c in ([on] if isinstance(on, (str, tuple)) else on)]
        return [(self._name(a), other._name(b)) for a, b in pairs]

    def _joinable(self, other: Governed, pairs, clause: str = "join") -> tuple[Governed, Governed, Trail]:
        a, b = self._settle(), other._settle()
        provs = [p for l, r in pairs for p in (a._prov[l], b._prov[r])]
        trail = a._trail.merge(b._trail)
        both = Governed(a._df, a._prov, trail)
        trail = both._touch(clause, *provs)
        for l, r in pairs:
            trail = self._equality(a._prov[l], b._prov[r], trail)
        return a, b, trail

    def join(
        self, other: Governed, on: Sequence | None = None, how: str = "inner", using: Sequence[str] | None = None, where: str | None = None
    ) -> Governed:
        """ON equalities (names or pairs), USING columns, or a condition over unmasked columns alone."""
        how = how.lower()
        if how not in ("inner", "left", "right", "full"):
            raise Refused("E_UNSUPPORTED_SYNTAX", "join kind: want inner, left, right or full")
        if using is not None:
            return self._using(other, list(using), how, where)
        pairs = self._pairs(other, on or [])
        a, b, trail = self._joinable(other, pairs)
        clash = {fold(c) for c in a._prov} & {fold(c) for c in b._prov}
        if clash:
            raise Refused("E_UNKNOWN_NAME", f"ambiguous columns {', '.join(sorted(clash)).lower()[:80]}: use prefix or rename")
        provs = {**a._prov, **b._prov}
        both = T.StructType([*a._df.schema.fields, *b._df.schema.fields])
        joined = Governed(a._df.sparkSession.createDataFrame([], both), provs, trail)
        conditions = [f"`{l}` = `{r}`" for l, r in pairs]
        if where is not None:
            p = mixed(provs[c] for c in joined._reads(where))
            if p.sensitive:
                raise Refused("E_MASKED_FILTER", f"a PII column ({p.names()}) may only be joined by equality")
            trail = joined._touch("join", p)
            conditions.append(f"({where})")
        if not conditions:
            raise Refused("E_INVALID_SQL", "a join needs a condition: use cross_join")
        return Governed(a._df.join(b._df, F.expr(" AND ".join(conditions)), how), provs, trail)

    def _using(self, other: Governed, using: list[str], how: str, where: str | None) -> Governed:
        pairs = self._pairs(other, using)
        a, b, trail = self._joinable(other, pairs)
        right = {r: l for l, r in pairs}
        b_df = b._df.select(*[F.col(f"`{c}`").alias(right.get(c, c)) for c in b._prov])
        rest_a = [c for c in a._prov if c not in dict(pairs)]
        rest_b = [c for c in b._prov if c not in right]
        clash = {fold(c) for c in rest_a} & {fold(c) for c in rest_b}
        if clash:
            raise Refused("E_UNKNOWN_NAME", f"ambiguous columns {', '.join(sorted(clash)).lower()[:80]}: use prefix or rename")
        provs = {l: a._prov[l].union(b._prov[r]) for l, r in pairs}
        provs |= {c: a._prov[c] for c in rest_a} | {c: b._prov[c] for c in rest_b}
        df = a._df.join(b_df, [l for l, _ in pairs], how).select(*[F.col(f"`{c}`") for c in provs])
        out = Governed(df, provs, trail)
        return out.filter(where) if where else out

    def natural_join(self, other: Governed, how: str = "inner") -> Governed:
        names = {fold(c): c for c in other._prov}
        shared = [c for c in self._prov if fold(c) in names]
        if not shared:
            raise Refused("E_INVALID_SQL", "no column in common: use cross_join")
        return self.join(other, using=shared, how=how)

    def cross_join(self, other: Governed, max_rows: int = 10_000) -> Governed:
        """All pairs. A product whose smaller side has more than ``max_rows`` rows is refused."""
        a, b, trail = self._joinable(other, [])
        clash = {fold(c) for c in a._prov} & {fold(c) for c in b._prov}
        if clash:
            raise Refused("E_UNKNOWN_NAME", f"ambiguous columns {', '.join(sorted(clash)).lower()[:80]}")
        provs = {**a._prov, **b._prov}
        if all(side.limit(max_rows + 1).count() > max_rows for side in (a._df, b._df)):
            raise Refused("E_COST", f"neither side of the product is within the {max_rows} rows asked for")
        return Governed(a._df.crossJoin(b._df), provs, trail)

    def band_join(self, other: Governed, left: str, right: str, low: float, high: float) -> Governed:
        """Pairs with low <= left - right <= high, over unmasked numbers.

        The number line is cut into buckets as wide as the band: a right value
        reaches two or three of them, and the pairs meet by equality there.
        """
        l, r = self._name(left), other._name(right)
        if low > high:
            raise Refused("E_INVALID_SQL", "a band goes from its low end to its high end")
        a, b, trail = self._joinable(other, [])
        clash = {fold(c) for c in a._prov} & {fold(c) for c in b._prov}
        if clash:
            raise Refused("E_UNKNOWN_NAME", f"ambiguous columns {', '.join(sorted(clash)).lower()[:80]}: use prefix or rename")
        p = mixed([a._prov[l], b._prov[r]])
        if p.sensitive:
            raise Refused("E_MASKED_FILTER", f"{p.names()} is masked: a distance to it would tell its value")
        provs = {**a._prov, **b._prov}
        trail = Governed(a._df, provs, trail)._touch("join", a._prov[l], b._prov[r])
        x, y, width = F.col(f"`{l}`"), F.col(f"`{r}`"), max(high - low, 1)
        reached = b._df.withColumn("_at", F.explode(F.sequence(F.floor((y + low) / width), F.floor((y + high) / width))))
        met = a._df.withColumn("_at", F.floor(x / width)).join(reached, "_at").where((x - y).between(low, high))
        return Governed(met.select(*[F.col(f"`{c}`") for c in provs]), provs, trail)

    def overlap_join(self, other: Governed, left: tuple[str, str], right: tuple[str, str], on: Sequence = ()) -> Governed:
        """Pairs whose intervals [start, end] share a point, over unmasked numbers, dates or timestamps.

        An interval lies in at most two cells of the smallest power of two
        above its length, and in at most two of any larger one. A pair meets,
        by equality, in the cells of its longer interval, once: in the first
        cell that both reach. Only lengths in use have cells (at most 64), so
        a row is copied at most 128 times, however long the other intervals
        are. Nulls and intervals that end before they start meet nothing.
        ``on`` adds equalities between columns.
        """
        l, r = [self._name(c) for c in left], [other._name(c) for c in right]
        pairs = self._pairs(other, list(on))
        a, b, trail = self._joinable(other, pairs)
        both = a._beside(b, trail)
        p = mixed([*[a._prov[c] for c in l], *[b._prov[c] for c in r]])
        if p.sensitive:
            raise Refused("E_MASKED_FILTER", f"{p.names()} is masked: an overlap with it would tell its value")
        trail = both._touch("join", *[a._prov[c] for c in l], *[b._prov[c] for c in r])
        x, y = _with_level(a._df, *l, "_l"), _with_level(b._df, *r, "_r")
        levels = F.array_union(*[d.agg(F.collect_set(c)).scalar() for d, c in ((x, "_level_l"), (y, "_level_r"))])
        same = [F.col(f"`{c}`") == F.col(f"`{d}`") for c, d in pairs]
        met = None
        # The left interval is the longer one or as long; then the right one is longer.
        for mine, theirs in (("own", "any"), ("larger", "own")):
            u, v = _in_cells(x, "_l", levels, mine), _in_cells(y, "_r", levels, theirs)
            at = [F.col("_grain_l") == F.col("_grain_r"), F.col("_cell_l") == F.col("_cell_r"), *same]
            one = u.join(v, at).where(
                (F.col("_from_l") <= F.col("_to_r"))
                & (F.col("_from_r") <= F.col("_to_l"))
                & (F.col(f"`{l[0]}`") <= F.col(f"`{r[1]}`"))
                & (F.col(f"`{r[0]}`") <= F.col(f"`{l[1]}`"))
                & (F.col("_cell_l") == F.greatest(F.col("_first_l"), F.col("_first_r")))
            ).select(*[F.col(f"`{c}`") for c in both._prov])
            met = one if met is None else met.unionAll(one)
        return Governed(met, both._prov, trail)

    def _beside(self, other: Governed, trail: Trail) -> Governed:
        """The columns of both frames, for judging a condition that reads either; no rows."""
        clash = {fold(c) for c in self._prov} & {fold(c) for c in other._prov}
        if clash:
            raise Refused("E_UNKNOWN_NAME", f"ambiguous columns {', '.join(sorted(clash)).lower()[:80]}: use prefix or rename")
        both = T.StructType([*self._df.schema.fields, *other._df.schema.fields])
        return Governed(self._df.sparkSession.createDataFrame([], both), {**self._prov, **other._prov}, trail)

    def _matches(self, other: Governed, pairs, where: str | None, trail: Trail) -> tuple[DataFrame, str, Trail]:
        """What an existence test needs of the other side, its condition, and the trail with what the condition reads."""
        if not pairs:
            raise Refused("E_COST", "an existence test meets its rows by at least one equality")
        keys = [F.col(f"`{r}`").alias(f"_k{i}") for i, (_, r) in enumerate(pairs)]
        tests = [f"`{l}` = _k{i}" for i, (l, _) in enumerate(pairs)]
        if where is not None:
            both = self._beside(other, trail)
            reads = both._reads(where)
            p = mixed(both._prov[c] for c in reads)
            if p.sensitive:
                raise Refused("E_MASKED_FILTER", f"{p.names()} is masked: whether a row exists would tell how it compares")
            trail = both._touch("where", p)
            keys += [F.col(f"`{c}`") for c in reads if c in other._prov]
            tests.append(f"({where})")
        return other._df.select(*keys), " AND ".join(tests), trail

    def semi_join(self, other: Governed, on, where: str | None = None) -> Governed:
        """Rows with a match: IN (subquery), = ANY, EXISTS.

        ``where`` is what EXISTS asks besides the equalities: any condition
        over unmasked columns of both frames.
        """
        pairs = self._pairs(other, on)
        a, b, trail = self._joinable(other, pairs, "where")
        keys, condition, trail = a._matches(b, pairs, where, trail)
        return a._with(a._df.join(keys, F.expr(condition), "left_semi"), a._prov, trail)

    def anti_join(self, other: Governed, on, not_in: bool = False, where: str | None = None) -> Governed:
        """Rows without a match: NOT EXISTS (``where`` as in semi_join), or NOT IN with its rules for nulls."""
        pairs = self._pairs(other, on)
        if not_in and (len(pairs) != 1 or where is not None):
            raise Refused("E_UNSUPPORTED_SYNTAX", "NOT IN compares one column and nothing else")
        a, b = self._settle(), other._settle()
        for l, r in pairs:
            p = mixed([a._prov[l], b._prov[r]])
            if p.sensitive:
                raise Refused("E_MASKED_FILTER", f"{p.names()} is masked: rows are not chosen by what it is not")
        a, b, trail = self._joinable(other, pairs, "where")
        keys, condition, trail = a._matches(b, pairs, where, trail)
        df = a._df.join(keys, F.expr(condition), "left_anti")
        if not_in:
            key = F.col(f"`{pairs[0][0]}`")
            # One null on the right keeps nothing; a null on the left is kept only against no rows.
            any_null = keys.agg(F.coalesce(F.bool_or(F.col("_k0").isNull()), F.lit(False))).scalar()
            no_rows = (keys.agg(F.count(F.lit(1))).scalar()) == 0
            df = df.where(~any_null & (key.isNotNull() | no_rows))
        return a._with(df, a._prov, trail)

    def lateral(self, other: Governed, on, order_by: Sequence[str], limit: int) -> Governed:
        """Per row of this frame, the first rows of other that match it (LATERAL ... ORDER BY ... LIMIT)."""
        pairs = self._pairs(other, on)
        order = [other._order_key(o) for o in order_by]
        ranked = other._df.withColumn(
            "_rn",
            F.expr(
                f"row_number() OVER (PARTITION BY {', '.join(f'`{r}`' for _, r in pairs)} ORDER BY {', '.join(order)})"
            ),
        ).where(F.col("_rn") <= limit)
        top = other._with(ranked.drop("_rn"), other._prov, other._touch("order by", *[other._value(_bare(o)) for o in order_by]))
        return self.join(top, on=pairs)

    def lateral_join(
        self,
        other: Governed,
        on,
        where: str | None = None,
        columns: dict[str, str] | None = None,
        aggs: Sequence[Agg] = (),
        order_by: Sequence[str] = (),
        limit: int | None = None,
        how: str = "inner",
    ) -> Governed:
        """LATERAL: per row of this frame, a body over the rows of other that match it.

        The body may read this frame's columns: in ``where``, in the computed
        ``columns`` (by new name; without them, those of other), in ``aggs``
        (one row, also where nothing matches) and in ``order_by`` with
        ``limit``. A ``left`` lateral keeps rows whose body is empty. Spark
        takes the outer references out itself: the equalities become a join,
        first rows a ranked window on the keys, aggregates a grouping by them.
        A null key matches nothing; repeated outer rows each get their body.
        """
        how = how.lower()
        if how not in ("inner", "left"):
            raise Refused("E_UNSUPPORTED_SYNTAX", "a lateral body is joined inner or left")
        if aggs and (columns or order_by or limit is not None):
            raise Refused("E_UNSUPPORTED_SYNTAX", "a body of aggregates is one row: nothing to compute, order or cut in it")
        if limit is not None and limit < 0:
            raise Refused("E_NO_LIMIT", "LIMIT is a count")
        pairs = self._pairs(other, on)
        if not pairs:
            raise Refused("E_COST", "a lateral body meets its outer row by at least one equality")
        a, b, trail = self._joinable(other, pairs)
        body = a._beside(b, trail)
        texts = [where, *(columns or {}).values(), *[_bare(o) for o in order_by]]
        texts += [x for g in aggs for x in (*g.args, g.where, *[_bare(o) for o in g.order_by])]
        if where is not None:
            body = body.filter(where)
        taken = {fold(c) for c in a._prov}
        for n in [*(columns or {}), *[g.alias for g in aggs]]:
            if fold(n) in taken:
                raise Refused("E_UNKNOWN_NAME", f"ambiguous column {n.lower()[:64]}: the outer row has it")
        if columns:
            body = body.with_columns(columns)
        for o in order_by:
            body._order_key(o)
            body = replace(body, _trail=body._touch("order by", body._value(_bare(o))))
        if aggs:
            done = body.agg(*aggs)
            if len(done.k_checks()) > len(trail.checks):
                raise Refused("E_MASKED_EXPRESSION", "PII columns may be carried out of a lateral body, not aggregated in it")
            body = done
        names = [g.alias for g in aggs] or list(columns or b._prov)
        seen = a._beside(b, trail)
        seen = seen.with_columns(columns) if columns else seen
        read = {c for t in texts if t is not None for c in seen._reads(t) if c in a._prov}
        needed = list(dict.fromkeys([l for l, _ in pairs] + [c for c in a._prov if c in read]))
        # Outer columns go by names of their own, so that none is taken for the body's copy of it.
        out = {c: f"_outer{i}" for i, c in enumerate(a._prov)}
        if read:
            # What the body reads of the outer row comes with the keys, once per distinct combination, by an equality join.
            seen_from = a._df.select(*[F.col(f"`{c}`") for c in needed]).distinct()
            rows = seen_from.join(b._df, F.expr(" AND ".join(f"`{l}` = `{r}`" for l, r in pairs)))
            rows = rows.where(F.expr(where)) if where is not None else rows
            inner = {l: l for l, _ in pairs}
        else:
            rows = b._df.where(F.expr(where)) if where is not None else b._df
            inner = dict(pairs)
        # Equalities alone: Spark then pairs no inner row with outer values it does not equal.
        for l, r in inner.items():
            rows = rows.where(F.col(f"`{r}`") == F.col(out[l]).outer())
        for c in needed if read else ():
            if c not in inner:
                rows = rows.where(F.col(f"`{c}`").eqNullSafe(F.col(out[c]).outer()))
        if aggs:
            rows = rows.select(*[g.column().alias(g.alias) for g in aggs])
        else:
            rows = rows.select("*", *[F.expr(e).alias(n) for n, e in columns.items()]) if columns else rows
            rows = rows.orderBy(*[_sorting(o) for o in order_by]) if order_by else rows
            rows = rows.limit(limit) if limit is not None else rows
            rows = rows.select(*[F.col(f"`{n}`") for n in names])
        met = a._df.select(*[F.col(f"`{c}`").alias(o) for c, o in out.items()]).lateralJoin(rows, how=how)
        df = met.select(*[F.col(o).alias(c) for c, o in out.items()], *[F.col(f"`{n}`") for n in names])
        return Governed(df, {**a._prov, **{n: body._prov[n] for n in names}}, body._trail)

    def with_scalar(self, name: str, other: Governed) -> Governed:
        """The value of a one-row, one-column query as a column."""
        if self._groups is not None:
            return self._settle().with_scalar(name, other)
        if len(other._prov) != 1:
            raise Refused("E_INVALID_SQL", "a scalar subquery returns one column")
        o = other._settle()
        (p,) = o._prov.values()
        df = self._df.withColumn(name, o._df.scalar())
        return self._with(df, {**self._prov, name: p}, self._trail.merge(o._trail))

    # ---- grouping ----

    def group_by(self, *keys: str | tuple[str, str]) -> Grouped:
        """Plain columns, or (alias, expression) over unmasked columns."""
        me = self._settle() if self._groups is not None else self
        plain: dict[str, tuple[Column, Prov]] = {}
        for k in keys:
            if isinstance(k, tuple):
                alias, expr = k
                p = me._value(expr)
                if p.sensitive and not me._is_column(expr):
                    raise Refused("E_MASKED_EXPRESSION", f"a PII column ({p.names()}) is used inside a grouping expression")
                plain[alias] = (F.expr(expr).alias(alias), p)
            else:
                name = me._name(k)
                plain[name] = (F.col(f"`{name}`"), me._prov[name])
        for _, p in plain.values():
            me._dedupe(p, "GROUP BY")
        return Grouped(me, plain)

    def agg(self, *aggs: Agg) -> Governed:
        return self.group_by().agg(*aggs)

    def _dedupe(self, p: Prov, what: str) -> None:
        if p.sensitive and not self._all_pii(p):
            raise Refused("E_MASKED_SET_OP", f"{what} would match masked values against the query's own")

    def having(self, expr: str) -> Governed:
        """A condition on groups: their aggregates and keys that are not masked."""
        return self.filter(expr)

    def distinct(self) -> Governed:
        for p in self._prov.values():
            self._dedupe(p, "DISTINCT")
        pii = any(p.sensitive for p in self._prov.values())
        me = replace(self, _due=self._due or pii)._settle()
        return me._with(me._df.distinct(), me._prov, me._touch("select", *me._prov.values()))

    def distinct_on(self, keys: Sequence[str], order_by: Sequence[str]) -> Governed:
        """The first row per key. Kept as an aggregate, so a hot key is reduced before the shuffle."""
        me = self._settle()
        key_provs = [me._prov[me._name(k)] for k in keys]
        for p in key_provs:
            if p.sensitive:
                raise Refused("E_MASKED_ORDER", f"a PII column ({p.names()}) is not allowed in DISTINCT ON")
        ways = [_direction(me._order_key(o)) for o in order_by]
        down = {d for d, _ in ways}
        row = F.struct(*[F.col(f"`{c}`") for c in me._prov])
        trail = me._touch("order by", *key_provs, *[me._value(_bare(o)) for o in order_by])
        if len(down) == 1:
            # Ahead in the order is small, or large for max_by: so are the nulls that come first.
            ahead = [F.expr(_bare(o)).isNull() == F.lit(first == d) for o, (d, first) in zip(order_by, ways)]
            place = F.struct(*[F.struct(n.alias("n"), F.expr(_bare(o)).alias("v")).alias(f"o{i}") for i, (n, o) in enumerate(zip(ahead, order_by))])
            pick = F.max_by(row, place) if down == {True} else F.min_by(row, place)
            df = me._df.groupBy(*[F.col(f"`{k}`").alias(f"_g{i}") for i, k in enumerate(keys)]).agg(pick.alias("_row"))
            return me._with(df.select("_row.*"), me._prov, trail)
        over = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY {', '.join(me._order_key(o) for o in order_by)}"
        df = me._df.withColumn("_rn", F.expr(f"row_number() OVER ({over})")).where("_rn = 1").drop("_rn")
        return me._with(df, me._prov, trail)

    # ---- windows ----

    def window(self, name: str, fn: str, *args: str, **over) -> Governed:
        """One window function; see ``windows``."""
        return self.windows({name: (fn, *args)}, **over)

    def windows(
        self,
        functions: dict[str, tuple[str, ...]],
        partition_by: Sequence[str] = (),
        order_by: Sequence[str] = (),
        frame: str | None = None,
        hot_rows: int | None = None,
    ) -> Governed:
        """Ranking, analytic or aggregate functions over one window of unmasked columns.

        ``functions`` maps a new column to a function and its arguments. With
        ``hot_rows``, partitions of more rows than that are cut along their
        order, for ranking functions and running sums, counts, minima and
        maxima: no task sorts a whole hot key.
        """
        me = self._settle() if self._due or self._groups is not None else self
        functions = {n: (f[0].lower(), *f[1:]) for n, f in functions.items()}
        for fn, *_ in functions.values():
            if fn not in (*RANKING, *ANALYTIC, *WINDOW_AGGREGATES):
                raise Refused("E_INVALID_SQL", f"{fn[:40]} is not a window function")
        provs = []
        for k in partition_by:
            provs.append(me._value(k))
            if provs[-1].sensitive:
                raise Refused("E_MASKED_ORDER", f"a PII column ({provs[-1].names()}) is not allowed in window PARTITION BY")
        order = [me._order_key(o, "window ORDER BY") for o in order_by]
        provs += [me._value(_bare(o)) for o in order_by]
        given = {n: mixed(me._value(a) for a in args if a != "*") for n, (_, *args) in functions.items()}
        for n, p in given.items():
            if p.sensitive:
                raise Refused("E_MASKED_EXPRESSION", f"a PII column ({p.names()}) is used inside window function {functions[n][0]}")
        if frame is not None and not _FRAME.fullmatch(frame.upper().strip()):
            raise Refused("E_UNSUPPORTED_SYNTAX", "frame: want ROWS or RANGE with integer offsets")
        if not partition_by:
            raise Refused("E_COST", "a window without PARTITION BY runs in one task: partition it, or use order_by with limit")
        if hot_rows is not None:
            df = me._hot(functions, partition_by, order_by, frame, hot_rows)
        else:
            over = []
            if partition_by:
                over.append("PARTITION BY " + ", ".join(partition_by))
            if order:
                over.append("ORDER BY " + ", ".join(order))
            if frame:
                over.append(frame)
            columns = {n: F.expr(f"{fn}({', '.join(args)}) OVER ({' '.join(over)})") for n, (fn, *args) in functions.items()}
            df = me._df.withColumns(columns)
        trail = me._touch("select", *given.values(), *provs)
        outs = {n: replace(mixed([p]), kind=Kind.EXPR) for n, p in given.items()}
        return me._with(df, {**me._prov, **outs}, trail)

    def _hot(self, functions, partition_by, order_by, frame, hot_rows) -> DataFrame:
        upto = frame is not None and frame.upper().split() == _UP_TO_HERE
        args = [a for _, *rest in functions.values() for a in rest]
        plain = all(self._is_column(_bare(c)) for c in (*partition_by, *order_by)) and all(
            a == "*" or a.isdigit() or self._is_column(a) for a in args
        )
        known = all(fn in RANKS and frame is None or fn in RUNNING and upto for fn, *_ in functions.values())
        if not (plain and known and partition_by and order_by):
            raise Refused(
                "E_UNSUPPORTED_SYNTAX",
                "hot_rows: want a ranking function, or a sum, count, min or max with ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW, over plain columns",
            )
        if any("nulls" in o.lower() for o in order_by):
            raise Refused("E_UNSUPPORTED_SYNTAX", "hot_rows: the order keeps its usual place for nulls")
        order = [(self._name(_bare(o)), bool(re.search(r"(?i)\sdesc\s*$", o))) for o in order_by]
        arg = lambda a: int(a) if a.isdigit() else a if a == "*" else self._name(a)
        wanted = {n: (fn, arg(rest[0]) if rest else None) for n, (fn, *rest) in functions.items()}
        return hot_windows(self._df, wanted, [self._name(k) for k in partition_by], order, hot_rows)

    # ---- set operations ----

    def _arms(self, other: Governed, compare: bool, what: str) -> tuple[Governed, Governed, dict[str, Prov], Trail]:
        a, b = self._settle(), other._settle()
        if len(a._prov) != len(b._prov):
            raise Refused("E_INVALID_SQL", f"the arms of {what} have different numbers of columns")
        trail = a._trail.merge(b._trail)
        out, both = {}, Governed(a._df, a._prov, trail)
        for i, ((name, l), r) in enumerate(zip(a._prov.items(), b._prov.values())):
            if compare:
                trail = replace(both, _trail=trail)._touch("set operation", l, r)
                if l.sensitive or r.sensitive:
                    if not (both._all_pii(l) and both._all_pii(r)):
                        raise Refused("E_MASKED_SET_OP", f"column {i + 1} holds masked values in one arm and others in the other")
                    if same_column(l, r):
                        raise Refused("E_MASKED_FILTER", "a PII column is compared with itself")
            out[name] = l.union(r)
        return a, b, out, trail

    def union_all(self, other: Governed) -> Governed:
        a, b, provs, trail = self._arms(other, False, "UNION ALL")
        return Governed(a._df.unionAll(b._df), provs, trail)

    def union(self, other: Governed) -> Governed:
        a, b, provs, trail = self._arms(other, True, "UNION")
        return Governed(a._df.unionAll(b._df).distinct(), provs, trail)

    def intersect(self, other: Governed, all: bool = False) -> Governed:
        a, b, provs, trail = self._arms(other, True, "INTERSECT")
        return Governed(a._df.intersectAll(b._df) if all else a._df.intersect(b._df), provs, trail)

    def except_(self, other: Governed, all: bool = False) -> Governed:
        a, b, provs, trail = self._arms(other, True, "EXCEPT")
        return Governed(a._df.exceptAll(b._df) if all else a._df.subtract(b._df), provs, trail)

    # ---- order, limit, recursion ----

    def _order_key(self, key: str, where: str = "ORDER BY") -> str:
        p = self._value(_bare(key))
        if p.sensitive:
            raise Refused("E_MASKED_ORDER", f"{where}: sorted rows would rank the masked values of {p.names()}")
        return key

    def order_by(self, *keys: str) -> Governed:
        """``"col"``, ``"col desc"``, ``"col asc nulls last"``, positions as numbers, expressions."""
        keys = tuple(list(self._prov)[int(k.split()[0]) - 1] + k[len(k.split()[0]) :] if k.split()[0].isdigit() else k for k in keys)
        order = [self._order_key(k) for k in keys]
        me = self._settle()
        trail = me._touch("order by", *[me._value(_bare(k)) for k in keys])
        return me._with(me._df.orderBy(*[_sorting(k) for k in order]), me._prov, trail)

    def limit(self, n: int, offset: int = 0) -> Governed:
        if n < 0 or offset < 0:
            raise Refused("E_NO_LIMIT", "LIMIT and OFFSET are counts")
        me = self._settle()
        df = me._df.offset(offset) if offset else me._df
        return me._with(df.limit(n), me._prov, _limit=n)

    def recursive(self, step: Callable[[Governed], Governed], distinct: bool = False, max_rounds: int | None = None) -> Governed:
        """A recursive CTE: this frame is the anchor, ``step`` maps the last rows to the next ones.

        The provenance is followed to a fixpoint first. Then each round joins
        only the rows of the round before, until none is left. ``distinct``
        is UNION in place of UNION ALL: a row found before is not followed
        again, so a cycle ends. ``max_rounds`` is a bound for callers that
        want one; there is none by itself.
        """
        me = self._settle()
        provs, trail = me._prov, me._trail
        if distinct:
            for p in provs.values():
                me._dedupe(p, "UNION")
        for _ in range(MAX_PASSES):
            tried = step(Governed(me._df, provs, trail))
            if len(tried.k_checks()) > len(trail.checks):
                raise Refused("E_MASKED_FILTER", "PII columns may be carried through a recursive CTE, not filtered, grouped or aggregated in it")
            if len(tried._prov) != len(provs):
                raise Refused("E_INVALID_SQL", "the arms of a recursive CTE have different numbers of columns")
            wider = {n: l.union(r) for (n, l), r in zip(provs.items(), tried._prov.values())}
            trail = trail.merge(tried._trail)
            if distinct:
                for p in wider.values():
                    replace(me, _trail=trail)._dedupe(p, "UNION")
            if wider == provs:
                break
            provs = wider
        else:
            raise Refused("E_TOO_COMPLEX", "the provenance of a recursive CTE does not converge")
        keep = lambda df: hold(df, "recursion") if _held_whole(df.schema) else cut_lineage(df)
        rows = frontier = keep(me._df.distinct() if distinct else me._df)
        rounds = 0
        while not frontier.isEmpty():
            if rounds == max_rounds:
                raise Refused("E_TOO_COMPLEX", f"the recursion went past the {max_rounds} rounds asked for")
            found = step(Governed(frontier, provs, trail))._df.toDF(*provs)
            frontier = keep(found.subtract(rows) if distinct else found)
            rows, rounds = rows.unionAll(frontier), rounds + 1
        return Governed(rows, provs, trail)

    # ---- results ----

    def result(
        self, limits: Limits | None = None, names=det.DEFAULT_DETECTORS, numbers: tuple[str, ...] = (), labels: Sequence[str] | None = None
    ) -> DataFrame:
        """The masked rows. With limits, a LIMIT within max_rows is required."""
        if limits is not None:
            if self._limit is None:
                raise Refused("E_NO_LIMIT", "a top-level limit is required")
            if self._limit > limits.max_rows:
                raise Refused("E_LIMIT_TOO_HIGH", f"LIMIT {self._limit} exceeds the maximum of {limits.max_rows} rows")
        schema = self._df.schema
        if [fold(f.name) for f in schema.fields] != [fold(c) for c in (labels or self._prov)] or len(schema) != len(self._prov):
            raise Refused("E_MASK_UNCERTAIN", "the columns of the result are not those of the analysis")
        out = []
        for f in schema.fields:
            p = self._prov[f.name]
            c = protect_column(F.col(f"`{f.name}`"), f.dataType, p.mask(), names, f.name in numbers)
            origin = {"origin": next(iter(p.sources))} if p.kind == Kind.IDENTITY and len(p.sources) == 1 else {}
            out.append(c.alias(f.name, metadata=origin))
        return self._df.select(*out)

    def report(self) -> dict:
        """PII uses by clause, steering columns, PII joins, relations read."""
        t = self._settle()._trail
        return {
            "uses": sorted(t.uses),
            "steering": sorted(t.steering),
            "pii_joins": sorted(t.pii_joins),
            "pii_filter": t.pii_filter,
            "relations": sorted(t.relations),
        }

    def k_checks(self) -> tuple[tuple[str, DataFrame, bool], ...]:
        return self._settle()._trail.checks

    def k_report(self, k: int = Limits().k_anonymity) -> DataFrame | None:
        """One row per k-anonymity check; nothing when no check is due."""
        return k_report(self.k_checks(), k)

    def _storable(self, db: str, table: str, rules: RuleSet) -> DataFrame:
        for name, p in self._prov.items():
            if p.sensitive:
                raise Refused("E_MASKED_WRITE", f"{p.names()} would be kept unmasked")
            null = dict(self._df.dtypes)[name] == "void"
            if rules.mode(db, table, name) and not null:
                raise Refused("E_MASKED_WRITE", f"{name.lower()} is masked and takes nulls only")
        return self._df

    def write_to(self, path: str, db: str, table: str, rules: RuleSet, mode: str = "append") -> None:
        """Append to a table's files: no masked value is stored, and a column under a rule takes nulls only."""
        df = self._storable(db, table, rules)
        df.select(*[F.col(f"`{c}`").cast("string") if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes]).write.mode(mode).parquet(path)

    def write_table(self, db: str, table: str, rules: RuleSet, batch: str) -> None:
        """Store a batch in the catalogue table db.table, by the rules of ``write_to``; the same batch again replaces itself.

        Nulls take the type of the table's column, or text where the write makes the table.
        """
        if not all(re.fullmatch(r"\w+", n) for n in (db, table)):
            raise Refused("E_INVALID_SQL", "a table is named by letters, digits and underscores")
        df, name = self._storable(db, table, rules), f"{db}.{table}"
        spark = df.sparkSession
        types = {f.name.lower(): f.dataType for f in spark.table(name).schema.fields} if spark.catalog.tableExists(name) else {}
        cast = lambda c: F.col(f"`{c}`").cast(types.get(c.lower(), "string"))
        df = df.select(*[cast(c).alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes])
        try:
            store_batch(df, name, batch)
        except ValueError as e:
            raise Refused("E_INVALID_SQL", str(e)) from e


# Spark's classes of functions that run a caller's code, call methods by name or tell where rows are kept.
_CALLS_OUT = frozenset(
    "PythonUDF PythonUDAF ScalaUDF ScalaUDAF ScalaAggregator HiveSimpleUDF HiveGenericUDF HiveUDAFFunction SQLFunctionExpression "
    "CallMethodViaReflection TryReflect StaticInvoke Invoke ApplyFunctionExpression V2Aggregator "
    "InputFileName InputFileBlockStart InputFileBlockLength".split()
)
# Functions that Spark itself writes as calls of its own library.
_OWN_CALLS = "org.apache.spark.sql.catalyst."


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan) -> list:
    """A plan and all below it."""
    return [plan, *(n for child in _scala(plan.children()) for n in _nodes(child))]


def _ids(attributes) -> set[int]:
    return {a.exprId().id() for a in _scala(attributes)}


def _sources(plan) -> set[str]:
    """The columns of the one leaf that the output of an analysed plan is made from."""
    need = _ids(plan.output())
    while plan.children().size():
        if plan.nodeName() == "Project":
            made = [e for e in _scala(plan.projectList()) if e.exprId().id() in need]
            need = set().union(*[_ids(e.references().toSeq()) for e in made])
        else:
            need |= _ids(plan.references().toSeq())
        plan = plan.children().head()
    return {a.name() for a in _scala(plan.output()) if a.exprId().id() in need}


def _unknown(expression) -> bool:
    """Whether an analysed expression calls what this library does not know."""
    kind = expression.getClass().getSimpleName()
    own = kind in ("StaticInvoke", "Invoke") and _OWN_CALLS in expression.toString()
    return (kind in _CALLS_OUT and not own) or any(_unknown(e) for e in _scala(expression.children()))


def _with_level(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """Rows with an interval, its ends as whole numbers, and the exponent of the power of two above its length."""

    def whole(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.DateType):
            return F.unix_date(c).cast("long")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(c.cast("timestamp"))
        if isinstance(kind, T.NumericType):
            return F.floor(c).cast("long")
        raise Refused("E_INVALID_SQL", f"{name.lower()[:64]} is no number, date or timestamp")

    ends = df.where(F.col(f"`{start}`") <= F.col(f"`{end}`")).select("*", whole(start).alias(f"_from{side}"), whole(end).alias(f"_to{side}"))
    length = F.col(f"_to{side}") - F.col(f"_from{side}")
    return ends.withColumn(f"_level{side}", F.when(length == 0, 0).otherwise(F.length(F.bin(length))))


def _in_cells(df: DataFrame, side: str, levels: Column, which: str) -> DataFrame:
    """One row per cell an interval reaches: of its own level, of the larger ones in use, or of any of these."""
    own = F.col(f"_level{side}")
    grain, first = f"_grain{side}", f"_first{side}"
    if which == "own":
        at = df.withColumn(grain, own)
    else:
        used = df.select("*", F.explode(levels).alias(grain))
        at = used.where(F.col(grain) > own if which == "larger" else F.col(grain) >= own)
    at = at.select("*", F.expr(f"shiftright(_from{side}, {grain})").alias(first), F.expr(f"shiftright(_to{side}, {grain})").alias("_last"))
    return at.select("*", F.explode(F.sequence(first, "_last")).alias(f"_cell{side}")).drop("_last")


_EMPTY: dict[tuple, DataFrame] = {}


def _empty(df: DataFrame) -> DataFrame:
    """A frame without rows and of the same schema: expressions are resolved against it."""
    key = (df.sparkSession.sparkContext.applicationId, df.schema.json())
    if key not in _EMPTY:
        _EMPTY[key] = df.sparkSession.createDataFrame([], df.schema)
    return _EMPTY[key]


def _sorting(key: str) -> Column:
    c, (down, first) = F.expr(_bare(key)), _direction(key)
    if down:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


@dataclass(frozen=True)
class Grouped:
    """A governed frame with its grouping keys."""

    frame: Governed
    keys: dict[str, tuple[Column, Prov]]

    def agg(self, *aggs: Agg) -> Governed:
        g = self.frame
        provs = {k: p for k, (_, p) in self.keys.items()}
        due = g._due or any(p.sensitive for p in provs.values())
        trail = g._touch("group by", *provs.values())
        for a in aggs:
            p, touched = self._argument(a)
            due = due or touched.sensitive
            provs[a.alias] = p
            trail = replace(g, _trail=trail)._touch("select", touched)
            for extra in (a.where, *a.order_by):
                if extra:
                    q = mixed(g._prov[c] for c in g._reads(_bare(extra) if extra in a.order_by else extra))
                    if q.sensitive:
                        raise Refused("E_MASKED_ORDER", f"{q.names()} is masked: it neither filters nor orders what an aggregate takes in")
                    trail = replace(g, _trail=trail)._touch("select", q)
        columns = [a.column().alias(a.alias) for a in aggs]
        key_columns = [c for c, _ in self.keys.values()]
        if not self.keys:
            me = replace(g, _trail=trail, _due=due)._settle()
            return me._with(g._df.agg(*columns), provs)
        grouped = g._df.groupBy(*key_columns)
        df = grouped.agg(*columns) if columns else g._df.select(*key_columns).distinct()
        groups = grouped.agg(F.count(F.lit(1)).alias("_k"), *columns) if due else None
        return Governed(df, provs, trail, False, groups)

    def _argument(self, a: Agg) -> tuple[Prov, Prov]:
        """The provenance of an aggregate, and of what it reads."""
        g = self.frame
        parts = [g._value(x) for x in a.args]
        for x, p in zip(a.args, parts):
            if p.sensitive and p.kind == Kind.EXPR:
                raise Refused("E_MASKED_EXPRESSION", f"a PII column ({p.names()}) is used inside an expression given to {a.fn}")
        if not parts:
            return Prov(), Prov()
        arg = parts[0]
        for p in parts[1:]:
            arg = Prov(arg.sources | p.sources, max(arg.kind, p.kind), arg.sensitive or p.sensitive, arg.modes | p.modes)
        if a.distinct:
            g._dedupe(arg, f"{a.fn}(DISTINCT ...)")
        if a.fn in COUNTS:
            return Prov(arg.sources, Kind.COUNT), arg
        if a.fn in PICKS and len(parts) == 1:
            if arg.kind in (Kind.CONST, Kind.COUNT):
                return arg, arg
            # MIN and MAX pick by order: over a masked column that reveals more than a plain value.
            if arg.sensitive and a.fn != "any_value":
                return arg.at_least(Kind.AGGREGATE), arg
            return arg.at_least(Kind.IDENTITY), arg
        if arg.kind == Kind.CONST:
            return arg, arg
        return arg.at_least(Kind.AGGREGATE), arg
