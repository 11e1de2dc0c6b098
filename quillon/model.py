"""What a schema and a relationship are made of."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ELLIPSIS, WILDCARD = "...", "*"
KEY = ("resource_type", "resource_id", "resource_rel", "subject_type", "subject_id", "subject_rel")
#: Deepest nesting of subproblems.
MAX_DEPTH = 50


class SchemaError(ValueError):
    """A schema that can't be compiled or isn't valid."""


class DepthError(RuntimeError):
    """A result that hangs on a cycle, or on more than MAX_DEPTH nested subproblems."""


def _strings(*names: str, null: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), null) for n in names]


RELATIONSHIPS = T.StructType(
    [*_strings(*KEY), *_strings("caveat_name", "caveat_ctx", null=True), T.StructField("expiration_ns", T.LongType()), T.StructField("created_rev", T.LongType(), False), T.StructField("deleted_rev", T.LongType())]
)
TUPLES = T.StructType(RELATIONSHIPS.fields[:9])
CHANGELOG = T.StructType([T.StructField("rev", T.LongType(), False), T.StructField("seq", T.IntegerType()), *_strings("op", null=True), *TUPLES.fields, T.StructField("schema_changed", T.BooleanType()), *_strings("tx_metadata", null=True)])


@dataclass(frozen=True)
class Allowed:
    """One subject type that a relation takes."""

    type: str
    rel: str = ELLIPSIS
    wildcard: bool = False
    caveat: str | None = None
    expiration: bool = False

    def __str__(self) -> str:
        out = self.type + (":*" if self.wildcard else "" if self.rel == ELLIPSIS else f"#{self.rel}")
        traits = [t for t in (self.caveat, "expiration" if self.expiration else None) if t]
        return out + (" with " + " and ".join(traits) if traits else "")


@dataclass(frozen=True)
class Ref:
    """A relation or permission of the same object."""

    name: str


@dataclass(frozen=True)
class Arrow:
    """A relation or permission of the objects that a relation leads to: of any, or of all of them."""

    over: str
    name: str
    every: bool = False


@dataclass(frozen=True)
class Nil:
    """Nobody."""


@dataclass(frozen=True)
class Itself:
    """The object as its own subject."""


@dataclass(frozen=True)
class Op:
    """union, intersection or exclusion of two or more."""

    kind: str
    parts: tuple


@dataclass
class Relation:
    name: str
    allowed: tuple[Allowed, ...] = ()
    rewrite: object | None = None

    @property
    def is_permission(self) -> bool:
        return self.rewrite is not None


@dataclass
class Definition:
    name: str
    relations: dict[str, Relation] = field(default_factory=dict)


@dataclass
class Caveat:
    name: str
    params: dict[str, str]
    body: str


@dataclass
class Schema:
    definitions: dict[str, Definition] = field(default_factory=dict)
    caveats: dict[str, Caveat] = field(default_factory=dict)

    def relation(self, type_: str, rel: str) -> Relation | None:
        d = self.definitions.get(type_)
        return d.relations.get(rel) if d else None


def walk(expr):
    """The expression and all below it."""
    yield expr
    for p in getattr(expr, "parts", ()):
        yield from walk(p)
