"""Static types and typed values of expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from graphspark.errors import TypeMismatch, Unsupported


@dataclass(frozen=True)
class T:
    """kind: null bool int float str dyn list map node rel path other; elem of lists; fields of maps, nodes, rels.

    A map of the spark type "sparse" has no key whose value is null.
    """

    kind: str
    elem: "T | None" = None
    fields: tuple = ()
    spark: str = ""

    def __str__(self) -> str:
        return f"LIST<{self.elem}>" if self.kind == "list" else self.kind.upper()


NULL, BOOL, INT, FLOAT, STR = (T(k) for k in ("null", "bool", "int", "float", "str"))
#: Scalars of several types.  Fields in this order, so that structs compare as values are ordered: strings, booleans,
#: numbers, NaN (r 1 to 4).  An integer is in f and i.
DYN = T("dyn", spark="struct<r:int,s:string,b:boolean,f:double,i:bigint>")
SCALARS = ("bool", "int", "float", "str", "dyn")
#: A property whose values have several types over the tables that a pattern reads.
MIXED = T("other", spark="struct<mixed:string>")
#: A node of which only the id is known.
BARE = T("node", spark="bare")


def list_of(t: T) -> T:
    return T("list", elem=t)


def map_of(fields: dict) -> T:
    return T("map", fields=tuple(sorted(fields.items())))


def sql(t: T) -> str:
    """The Spark type of a value."""
    if t.kind == "list":
        return f"array<{sql(t.elem)}>"
    if t.kind == "map":
        return "struct<" + ",".join(f"`{k}`:{sql(v)}" for k, v in t.fields) + ">"
    if t.kind == "node":
        return "struct<id:bigint,labels:array<string>,properties:" + sql(map_of(dict(t.fields))) + ">"
    if t.kind == "rel":
        return "struct<id:bigint,src:bigint,dst:bigint,type:string,properties:" + sql(map_of(dict(t.fields))) + ">"
    if t.kind == "path":
        return "struct<nodes:array<bigint>,rels:array<bigint>>"
    return {"null": "string", "bool": "boolean", "int": "bigint", "float": "double", "str": "string"}.get(t.kind) or t.spark


def of_spark(dt: S.DataType) -> T:
    if isinstance(dt, S.BooleanType):
        return BOOL
    if isinstance(dt, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return INT
    if isinstance(dt, (S.FloatType, S.DoubleType)):
        return FLOAT
    if isinstance(dt, S.StringType):
        return STR
    if isinstance(dt, S.ArrayType):
        return list_of(of_spark(dt.elementType))
    if isinstance(dt, S.NullType):
        return NULL
    if dt.simpleString() == DYN.spark:
        return DYN
    return T("other", spark=dt.simpleString())


def unify(a: T, b: T) -> T:
    """The type that holds values of both."""
    if a == b or b.kind == "null":
        return a
    if a.kind == "null":
        return b
    if {a.kind, b.kind} == {"int", "float"}:
        return FLOAT
    if a.kind in SCALARS and b.kind in SCALARS:
        return DYN
    if a.kind == b.kind == "list":
        return list_of(unify(a.elem, b.elem))
    if "bare" in (a.spark, b.spark) and a.kind == b.kind:
        return T(a.kind, spark="bare")
    if a.kind == b.kind and a.kind in ("map", "node", "rel"):
        x, y = dict(a.fields), dict(b.fields)
        return T(a.kind, fields=tuple(sorted((k, unify(x.get(k, NULL), y.get(k, NULL))) for k in {*x, *y})))
    raise Unsupported(f"values of the types {a} and {b} in one place")


@dataclass
class Elem:
    """A node or relationship whose parts are columns ``<prefix>__id`` and so on."""

    kind: str
    prefix: str
    props: dict[str, T]
    tables: tuple | None = None  # the graph's tables that it comes from, where these are known
    gone: bool = False  # deleted by the query

    def at(self, part: str) -> Column:
        return F.col(f"`{self.prefix}__{part}`")

    def names(self) -> list[str]:
        own = ["id", "labels"] if self.kind == "node" else ["id", "src", "dst", "type"]
        return [f"{self.prefix}__{x}" for x in [*own, *(f"p_{k}" for k in self.props)]]


@dataclass
class Path:
    """A path bound by a pattern: elements in order; a relationship may be a list of several."""

    nodes: list
    rels: list
    tables: tuple | None = None  # the relationship tables that it may use


@dataclass
class Val:
    """A typed value: a column, or an element or path made of columns."""

    t: T
    col: Column | None = None
    elem: Elem | None = None
    path: Path | None = None
    const: object = field(default=None)
    name: str | None = None  # of the frame's column that holds it

    def column(self) -> Column:
        """The value as one column."""
        if self.elem is not None:
            e = self.elem
            props = F.struct(*[e.at(f"p_{k}").alias(k) for k in sorted(e.props)]) if e.props else F.expr("named_struct()")
            parts = ["id", "labels"] if e.kind == "node" else ["id", "src", "dst", "type"]
            return F.when(e.at("id").isNotNull(), F.struct(*[e.at(p).alias(p) for p in parts], props.alias("properties")))
        if self.path is not None:
            nodes, rels = path_ids(self.path)
            return F.when(nodes.isNotNull(), F.struct(nodes.alias("nodes"), rels.alias("rels")))
        return self.col


def elem_type(e: Elem) -> T:
    return T(e.kind, fields=tuple(sorted(e.props.items())))


def path_ids(p: Path) -> tuple[Column, Column]:
    """Node and relationship ids of a path, null if it has no match."""
    rels, nodes, empty = [], [F.array(p.nodes[0].at("id"))], F.array().cast("array<bigint>")
    for r, n in zip(p.rels, p.nodes[1:]):
        if isinstance(r, Elem):
            rels.append(F.array(r.at("id")))
            nodes.append(F.array(n.at("id")))
        else:
            ids, start = r
            rels.append(F.transform(ids, lambda x: x["id"]))
            # each next node is the other end
            nodes.append(F.transform(ids, lambda x: x["to"]))
    first = p.nodes[0].at("id").isNotNull()
    return F.when(first, F.concat(*nodes)), F.when(first, F.concat(*rels) if rels else empty)


def coerce(v: Val, t: T) -> Column:
    """The value's column as type ``t``."""
    if v.t.kind == "null":
        return F.lit(None).cast(sql(t))
    if v.t == t or t.kind == "null":
        return v.column()
    if v.t.kind in ("node", "rel") and v.t.kind == t.kind:
        c, have = v.column(), dict(v.t.fields)
        props = F.struct(*[(c["properties"][k] if k in have else F.lit(None)).cast(sql(f)).alias(k) for k, f in t.fields])
        parts = ["id", "labels"] if t.kind == "node" else ["id", "src", "dst", "type"]
        return F.when(c.isNotNull(), F.struct(*[c[p].alias(p) for p in parts], props.alias("properties")))
    if v.t.kind == "map" and t.kind == "map":
        c, have = v.column(), dict(v.t.fields)
        return F.when(c.isNotNull(), F.struct(*[coerce(Val(have[k], c[k]) if k in have else Val(NULL, F.lit(None)), f).alias(k) for k, f in t.fields]))
    if v.t.kind == "list" and t.kind == "list":
        return F.transform(v.column(), lambda x: coerce(Val(v.t.elem, x), t.elem))
    if v.t.kind == "int" and t.kind == "float":
        return v.column().cast("double")
    if t == DYN and v.t.kind in SCALARS:
        c, kind = v.column(), v.t.kind
        rank = {"str": F.lit(1), "bool": F.lit(2), "int": F.lit(3)}.get(kind, F.when(F.isnan(c), 4).otherwise(3) if kind == "float" else None)
        fields = {"s": c if kind == "str" else None, "b": c if kind == "bool" else None, "f": c.cast("double") if kind in ("int", "float") else None, "i": c if kind == "int" else None}
        types = {"s": "string", "b": "boolean", "f": "double", "i": "bigint"}
        return F.when(c.isNotNull(), F.struct(rank.cast("int").alias("r"), *[(F.lit(None) if x is None else x).cast(types[k]).alias(k) for k, x in fields.items()]))
    raise TypeMismatch(f"{v.t} where {t} is needed")


def literal(value) -> Val:
    """A Python value as a typed literal."""
    if value is None:
        return Val(NULL, F.lit(None), const=None)
    if isinstance(value, bool):
        return Val(BOOL, F.lit(value), const=value)
    if isinstance(value, int):
        return Val(INT, F.lit(value).cast("bigint"), const=value)
    if isinstance(value, float):
        return Val(FLOAT, F.lit(value).cast("double"), const=value)
    if isinstance(value, str):
        return Val(STR, F.lit(value), const=value)
    if isinstance(value, (list, tuple)):
        return make_list([literal(x) for x in value])
    if isinstance(value, dict):
        return make_map({k: literal(x) for k, x in value.items()})
    raise TypeMismatch(f"no value for {type(value).__name__}")


def make_list(items: list[Val]) -> Val:
    t = NULL
    for v in items:
        t = unify(t, v.t)
    if not items:
        return Val(list_of(NULL), F.array().cast("array<string>"))
    return Val(list_of(t), F.array(*[coerce(v, t) for v in items]).cast(f"array<{sql(t)}>") if t.kind == "null" else F.array(*[coerce(v, t) for v in items]))


def make_map(fields: dict[str, Val]) -> Val:
    t = map_of({k: v.t for k, v in fields.items()})
    if not fields:
        return Val(t, F.expr("named_struct()"))
    return Val(t, F.struct(*[coerce(fields[k], f).alias(k) for k, f in t.fields]))
