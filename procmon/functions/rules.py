"""Label rules as data (L7) and their compilation to aggregate Columns.

A rule set names the activities whose cycle time is a regression target and
the gateways (decision points) whose taken branch is a class target.  Gateway
classes come from three kinds of rules:

* ``Follows(gateway, a, b, taken, not_taken)`` - an ``a`` directly followed by
  ``b`` gives ``taken``; followed by another activity gives ``not_taken``.  In a
  case the last matching pair wins.
* ``Present(gateway, ((conditions, cls), ...))`` - presence/absence of
  activities; the first satisfied condition set gives its class.
* ``Count(gateway, activity, ((op, n, cls), ...))`` - number of occurrences.
* ``Counts(gateway, ((((activity, op, n), ...), cls), ...))`` - the numbers of
  several activities together; the first condition set that holds gives its class.

If several rules of a gateway apply to a case, the later one in the rule set wins
(all ``Follows`` rules of a gateway count as one, at the place of the last of them).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "==": lambda c, n: c == n,
    ">": lambda c, n: c > n,
    ">=": lambda c, n: c >= n,
    "<": lambda c, n: c < n,
    "<=": lambda c, n: c <= n,
}


@dataclass(frozen=True)
class Follows:
    gateway: str
    a: str
    b: str
    taken: int
    not_taken: int | None = None


@dataclass(frozen=True)
class Present:
    gateway: str
    cases: tuple  # ((((activity, present: bool), ...), cls), ...)


@dataclass(frozen=True)
class Count:
    gateway: str
    activity: str
    cases: tuple  # ((op, n, cls), ...)


@dataclass(frozen=True)
class Counts:
    gateway: str
    cases: tuple  # ((((activity, op, n), ...), cls), ...)


@dataclass(frozen=True)
class RuleSet:
    activities: tuple[str, ...] = ()
    gateways: tuple[str, ...] = ()
    rules: tuple = ()
    defaults: dict = field(default_factory=dict)  # gateway -> default class (else undefined)

    def default(self, gateway: str) -> int | None:
        return self.defaults.get(gateway)


def rules_from_dict(d: dict) -> RuleSet:
    """Rule set from plain data, e.g. parsed JSON::

        {"activities": [...], "gateways": [...], "defaults": {"x4": 0},
         "rules": [{"kind": "follows", "gateway": "x1", "a": "view", "b": "purchase", "taken": 1, "not_taken": 0},
                   {"kind": "present", "gateway": "x2", "cases": [[{"signup": true, "error": false}, 0], ...]},
                   {"kind": "count", "gateway": "x3", "activity": "purchase", "cases": [["==", 1, 0], [">", 1, 1]]},
                   {"kind": "counts", "gateway": "x5", "cases": [[[["purchase", ">", 0], ["view", "<=", 1]], 0], ...]}]}
    """
    rules = []
    for r in d.get("rules", []):
        kind = r["kind"]
        if kind == "follows":
            rules.append(Follows(r["gateway"], r["a"], r["b"], int(r["taken"]), r.get("not_taken")))
        elif kind == "present":
            cases = tuple((tuple(sorted(cond.items())), int(cls)) for cond, cls in r["cases"])
            rules.append(Present(r["gateway"], cases))
        elif kind == "count":
            rules.append(Count(r["gateway"], r["activity"], tuple((op, int(n), int(c)) for op, n, c in r["cases"])))
        elif kind == "counts":
            rules.append(Counts(r["gateway"], tuple((tuple((a, op, int(n)) for a, op, n in conds), int(cls)) for conds, cls in r["cases"])))
        else:
            raise ValueError(f"unknown rule kind {kind!r}")
    return RuleSet(tuple(d.get("activities", ())), tuple(d.get("gateways", ())), tuple(rules), dict(d.get("defaults", {})))


def cycle_time_col(activity: str, act: Column, delta_us: Column) -> Column:
    """Mean seconds from the previous event over the occurrences of ``activity``
    that have a previous event (an occurrence at position 1 is ignored)."""
    hit = (act == activity) & delta_us.isNotNull()
    s = F.sum(F.when(hit, delta_us))
    n = F.count(F.when(hit, F.lit(1)))
    return F.when(n > 0, s.cast("double") / n / F.lit(1_000_000.0))


def gateway_col(rs: RuleSet, gateway: str, act: Column, nxt: Column, nr: Column) -> Column:
    """Class of ``gateway`` for a case (NULL when undefined)."""
    mine = [r for r in rs.rules if r.gateway == gateway]
    follows = [r for r in mine if isinstance(r, Follows)]
    count_of = lambda a: F.count(F.when(act == a, F.lit(1)))
    parts: list[Column] = []
    for r in mine:
        if isinstance(r, Follows):
            if r is not follows[-1]:
                continue
            v = None
            for f in reversed(follows):  # at one pair the later rule wins
                cond_t = (act == f.a) & (nxt == f.b)
                v = F.when(cond_t, F.lit(f.taken)) if v is None else v.when(cond_t, F.lit(f.taken))
                if f.not_taken is not None:
                    v = v.when((act == f.a) & (nxt != f.b), F.lit(int(f.not_taken)))
            parts.append(F.max_by(v, F.when(v.isNotNull(), nr)))  # the last matching pair wins
        elif isinstance(r, Present):
            has = lambda a: F.coalesce(F.max((act == a).cast("int")) == 1, F.lit(False))
            parts.append(_first_case([([has(a) if present else ~has(a) for a, present in conds], cls) for conds, cls in r.cases]))
        elif isinstance(r, Count):
            parts.append(_first_case([([_OPS[op](count_of(r.activity), n)], cls) for op, n, cls in r.cases]))
        elif isinstance(r, Counts):
            parts.append(_first_case([([_OPS[op](count_of(a), n) for a, op, n in conds], cls) for conds, cls in r.cases]))
    if not parts:
        return F.lit(None).cast("int")
    return (parts[0] if len(parts) == 1 else F.coalesce(*reversed(parts))).cast("int")


def _first_case(cases: list) -> Column:
    """The class of the first list of conditions that all hold (NULL if there is none)."""
    v = None
    for conds, cls in cases:
        ok = conds[0]
        for c in conds[1:]:
            ok = ok & c
        v = F.when(ok, F.lit(cls)) if v is None else v.when(ok, F.lit(cls))
    return v
