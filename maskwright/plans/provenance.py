"""Provenance of a value: where it comes from and how far it was transformed."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum


class Kind(IntEnum):
    """From the least to the most transformed."""

    CONST = 0
    COUNT = 1
    IDENTITY = 2
    AGGREGATE = 3
    EXPR = 4


@dataclass(frozen=True)
class Prov:
    sources: frozenset[str] = frozenset()
    kind: Kind = Kind.CONST
    sensitive: bool = False
    modes: frozenset[str] = frozenset()
    # Some values may be literals of the query.
    lit: bool = False

    def union(self, other: Prov) -> Prov:
        """Either value may be the result."""
        return Prov(
            self.sources | other.sources,
            max(self.kind, other.kind),
            self.sensitive or other.sensitive,
            self.modes | other.modes,
            self.lit or other.lit or Kind.CONST in (self.kind, other.kind),
        )

    def at_least(self, kind: Kind) -> Prov:
        return replace(self, kind=max(self.kind, kind))

    def names(self) -> str:
        short = sorted(".".join(s.split(".")[-2:]).lower() for s in self.sources)
        return ", ".join(short[:3]) + (", …" if len(short) > 3 else "")

    def mask(self) -> str | None:
        """The mask of an output with this provenance."""
        if not self.sensitive:
            return None
        if self.kind == Kind.IDENTITY and len(self.modes) == 1:
            return next(iter(self.modes))
        return "redact"


def mixed(provs) -> Prov:
    """An expression over several values."""
    out = Prov()
    for p in provs:
        out = Prov(
            out.sources | p.sources,
            Kind.EXPR if p.kind != Kind.CONST else out.kind,
            out.sensitive or p.sensitive,
            out.modes | p.modes,
            out.lit or p.lit,
        )
    return out


def same_column(a: Prov, b: Prov) -> bool:
    """Two plain values that share a source: comparing them is a probe on it."""
    return a.kind == b.kind == Kind.IDENTITY and bool(a.sources & b.sources)
