"""The lattice of key domains: finite sets, patterns with fixed ends, and the unbounded."""

from __future__ import annotations

from dataclasses import dataclass, replace

LEXICAL, OPAQUE, USER = "lexical", "opaque", "user-controlled"
_ORIGINS = {LEXICAL: 0, OPAQUE: 1, USER: 2}


@dataclass(frozen=True)
class Domain:
    """``kind``: finite (``keys``), pattern (``prefix``, ``suffix``) or unbounded (``reason``)."""

    kind: str
    keys: tuple[str, ...] = ()
    prefix: str = ""
    suffix: str = ""
    reason: str = ""
    origin: str = LEXICAL
    direct: bool = False
    literal: bool = False

    @property
    def pattern_kind(self) -> str:
        return "surrounded" if self.prefix and self.suffix else "prefix" if self.prefix else "suffix"


def finite(*keys: str, direct: bool = True, literal: bool = True) -> Domain:
    return Domain("finite", keys, direct=direct, literal=literal)


def unbounded(reason: str = "opaque", origin: str = OPAQUE) -> Domain:
    return Domain("unbounded", reason=reason, origin=origin)


def over_budget(origin: str) -> Domain:
    return unbounded("over-budget", origin)


def worse(*origins: str) -> str:
    """Control by a user outweighs the opaque, which outweighs the lexical."""
    return max(origins, key=_ORIGINS.__getitem__)


def union(parts: list[Domain], most: int) -> Domain:
    origin = worse(*(p.origin for p in parts))
    if any(p.reason == "over-budget" for p in parts):
        return over_budget(origin)
    if all(p.kind == "finite" for p in parts):
        keys = tuple(dict.fromkeys(k for p in parts for k in p.keys))
        if len(keys) > most:
            return over_budget(origin)
        return Domain("finite", keys, origin=origin, direct=origin == LEXICAL and all(p.direct for p in parts))
    first = parts[0]
    if first.kind == "pattern" and all(p.kind == "pattern" and (p.prefix, p.suffix) == (first.prefix, first.suffix) for p in parts):
        return replace(first, origin=origin, direct=False)
    return unbounded("opaque" if origin != USER else "user-controlled", origin)


def concat(left: Domain, right: Domain, most: int) -> Domain:
    origin = worse(left.origin, right.origin)
    if "over-budget" in (left.reason, right.reason):
        return over_budget(origin)
    if left.kind == right.kind == "finite":
        if len(left.keys) * len(right.keys) > most:  # before repeats are removed
            return over_budget(origin)
        keys = tuple(dict.fromkeys(a + b for a in left.keys for b in right.keys))
        return Domain("finite", keys, origin=origin, direct=origin == LEXICAL and left.direct and right.direct)
    fixed_left = left.keys[0] if left.kind == "finite" and len(left.keys) == 1 else None
    fixed_right = right.keys[0] if right.kind == "finite" and len(right.keys) == 1 else None
    prefix = fixed_left + (right.prefix if right.kind == "pattern" else "") if fixed_left is not None else left.prefix if left.kind == "pattern" else ""
    suffix = (left.suffix if left.kind == "pattern" else "") + fixed_right if fixed_right is not None else right.suffix if right.kind == "pattern" else ""
    if prefix or suffix:
        return Domain("pattern", prefix=prefix, suffix=suffix, origin=origin)
    return unbounded("user-controlled" if origin == USER else "opaque", origin)
