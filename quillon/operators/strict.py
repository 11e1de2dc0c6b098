"""A check as one walk in Python: operand by operand, with the depth limit and the errors of such a walk.

It is for single checks whose errors matter, for permissions that recurse through exclusion, intersection or
``.all``, and as the tests' oracle. Its tuples must fit on the driver; ``checked`` raises if there are too many.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import k3
from ..model import ELLIPSIS, MAX_DEPTH, WILDCARD, Arrow, DepthError, Itself, Nil, Ref, Schema

Entry = tuple[int, frozenset] | None


def or_(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    st = max(a[0], b[0])
    return st, frozenset().union(*(x[1] for x in (a, b) if x[0] == k3.U)) if st == k3.U else frozenset()


def and_(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return None
    st = min(a[0], b[0])
    return st, frozenset().union(*(x[1] for x in (a, b) if x[0] == k3.U)) if st == k3.U else frozenset()


def minus(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a
    return None if b[0] == k3.A else and_(a, (2 - b[0], b[1]))


class Walk:
    """tuples: (six parts, entry)."""

    def __init__(self, schema: Schema, tuples: list[tuple[tuple[str, ...], Entry]], depth: int = MAX_DEPTH) -> None:
        self.schema, self.depth = schema, depth
        self.by: dict[tuple[str, str, str], list] = defaultdict(list)
        for key, entry in tuples:
            self.by[key[:3]].append((key[3:], entry))

    def check(self, resource: tuple[str, str, str], subject: tuple[str, str, str], left: int | None = None) -> Entry:
        """The subject's entry in the resource's relation; None if it has none."""
        left = self.depth if left is None else left
        if left <= 0:
            raise DepthError("too deep")
        if resource == subject:
            return k3.A, frozenset()
        relation = self.schema.relation(resource[0], resource[2])
        if relation is None:
            return None
        if relation.is_permission:
            return self._expr(resource, relation.rewrite, subject, left)
        out: Entry = None
        usersets = []
        for (t, i, r), entry in self.by[resource]:
            if (t, i, r) == subject or i == WILDCARD and t == subject[0]:
                out = or_(out, entry)
            elif r != ELLIPSIS:
                usersets.append(((t, i, r), entry))
        for s, entry in usersets:
            if out is not None and out[0] == k3.A:
                break
            out = or_(out, and_(entry, self.check(s, subject, left - 1)))
        return out

    def _expr(self, resource: tuple[str, str, str], e, subject, left: int) -> Entry:
        if isinstance(e, Nil):
            return None
        if isinstance(e, Itself):
            return (k3.A, frozenset()) if (resource[0], resource[1], ELLIPSIS) == subject else None
        if isinstance(e, Ref):
            return self.check((resource[0], resource[1], e.name), subject, left - 1)
        if isinstance(e, Arrow):
            targets: dict[tuple[str, str], Entry] = {}
            for (t, i, _), entry in self.by[(resource[0], resource[1], e.over)]:
                if i != WILDCARD:
                    targets[(t, i)] = or_(targets.get((t, i)), entry)
            got = None
            for n, ((t, i), entry) in enumerate(targets.items()):
                one = and_(entry, self.check((t, i, e.name), subject, left - 1))
                if e.every:
                    got = one if n == 0 else and_(got, one)
                    if one is None:
                        return None
                else:
                    got = or_(got, one)
                    if got is not None and got[0] == k3.A:
                        break
            return got
        got = self._expr(resource, e.parts[0], subject, left)
        for p in e.parts[1:]:
            if e.kind == "union":
                if got is not None and got[0] == k3.A:
                    break
                got = or_(got, self._expr(resource, p, subject, left))
            elif got is None:
                break
            else:
                other = self._expr(resource, p, subject, left)
                got = and_(got, other) if e.kind == "intersection" else minus(got, other)
        return got


def tuples_of(rows: DataFrame, most: int) -> list[tuple[tuple[str, ...], Entry]]:
    from ..model import KEY

    found = rows.select(*KEY, "k.st", "k.missing").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a walk takes {most} relationships at most")
    return [(tuple(r[:6]), (r["st"], frozenset(r["missing"]))) for r in found]


def checked(schema: Schema, rows: DataFrame, type_: str, permission: str, asked: DataFrame, most: int) -> DataFrame:
    """asked (rid, stype, srel, sid) with its entry ``k``, by a walk for each question; the questions stay spread."""
    walk = Walk(schema, tuples_of(rows, most))

    def one(rid: str, stype: str, srel: str, sid: str):
        got = walk.check((type_, rid, permission), (stype, sid, srel))
        return None if got is None else (got[0], sorted(got[1]))

    return asked.withColumn("k", F.udf(one, k3.TYPE)("rid", "stype", "srel", "sid"))
